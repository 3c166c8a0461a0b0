"""A folder of files kept in step with an index of their chunks, as a stream that may be killed anywhere.

Each micro-batch compares the files it brings with a ledger of what is indexed: document, digest of
the content, and the batch that brought it. Only files whose digest differs go on. Their chunks are
written as that batch's part of the index, and then the ledger's part; both replace what an earlier
try of the same batch left, and a batch never looks at its own part of the ledger. So a batch that is
repeated after a crash, before or after any of the writes, leaves what one run would have. Of a
document only the chunks of its last batch count: what it had before is out as soon as the ledger's
part is there.

Cases: of files with the same name in a batch the latest counts (the greatest digest of equal times);
Spark's file source leaves files without content out; files that have not changed write nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LEDGER = "document string, digest string, modified timestamp, batch long"
FILES = "path string, modificationTime timestamp, length long, content binary"

Chunks = Callable[[DataFrame], DataFrame]


def _part(root: str, name: str, batch: int) -> str:
    return f"{root.rstrip('/')}/{name}/part={batch}"


def ledger(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """document, digest, modified, batch: the last entry of every document, of the batches before one."""
    every = _read(spark, root, "ledger", LEDGER)
    every = every if before is None else every.where(F.col("batch") < before)
    last = F.max(F.struct("batch", "digest", "modified")).alias("m")
    return every.groupBy("document").agg(last).select("document", "m.digest", "m.modified", "m.batch")


def _read(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path.toString())


def paragraphs(files: DataFrame) -> DataFrame:
    """document, chunk, text: a file's paragraphs, those that are not blank."""
    parts = F.split(F.decode(F.col("content"), "UTF-8"), r"\n\s*\n")
    return files.select("document", F.posexplode(F.filter(parts, lambda x: F.trim(x) != "")).alias("chunk", "text"))


def apply_batch(files: DataFrame, batch: int, root: str, chunks: Chunks = paragraphs) -> None:
    """Bring one batch of files (path, modificationTime, content) into the index below root."""
    spark = files.sparkSession
    named = files.select(F.substring_index("path", "/", -1).alias("document"), F.col("modificationTime").alias("modified"), "content", F.sha2("content", 256).alias("digest"))
    latest = named.groupBy("document").agg(F.max(F.struct("modified", "digest", "content")).alias("m")).select("document", "m.*")
    known = ledger(spark, root, before=batch).select("document", F.col("digest").alias("known"))
    # The files of one batch, written so that both parts come from the same comparison.
    changed = latest.join(known, "document", "left").where(~F.col("digest").eqNullSafe(F.col("known"))).drop("known")
    staged = _part(root, "staged", batch)
    changed.write.mode("overwrite").parquet(staged)
    changed = spark.read.schema("document string, modified timestamp, digest string, content binary").parquet(staged)
    if changed.isEmpty():
        return
    chunks(changed).withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(_part(root, "index", batch))
    changed.select("document", "digest", "modified", F.lit(batch).cast("long").alias("batch")).write.mode("overwrite").parquet(_part(root, "ledger", batch))


def index(spark: SparkSession, root: str, schema: str = "document string, chunk int, text string") -> DataFrame:
    """The chunks of every document as its last batch brought them."""
    held = _read(spark, root, "index", f"{schema}, batch long")
    return held.join(ledger(spark, root).select("document", "batch"), ["document", "batch"]).drop("batch")


def follow(spark: SparkSession, folder: str, root: str, suffix: str = "*", per_batch: int = 1000, chunks: Chunks = paragraphs) -> StreamingQuery:
    """Start a stream that indexes what is in a folder and stops; started again, it goes on with what is new."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", suffix).option("maxFilesPerTrigger", per_batch).load(folder)
    step = lambda rows, batch: apply_batch(rows, batch, root, chunks)
    return files.writeStream.foreachBatch(step).option("checkpointLocation", f"{root.rstrip('/')}/checkpoint").trigger(availableNow=True).start()
