"""Helpers shared by the corpus operators: written intermediate tables and small column idioms."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Words of the size and shingle contracts: everything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def count_words(text: Column) -> Column:
    """Number of white-space separated words; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only where the setting is absent and all is one process (tests) is a temporary folder chosen.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="foliant-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    Cuts the lineage: a lost executor costs the running stage only, never the ones before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/foliant/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives back the memory it has freed, so that idle Python workers hold little."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import ctypes

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has it
            if trim:
                trim(0)

    return whole


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with their number in that order, from 0: sorted by ranges, counts of earlier ranges added.

    What is summed in one place is a row for each partition.
    """
    sorted_ = rows.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in order])
    placed = written(sorted_.select("*", F.monotonically_increasing_id().alias("number")), "numbered").withColumn("range", F.shiftright("number", 33))
    counts = placed.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    within = F.col("number").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(before), "range").withColumn("number", within + F.col("before")).drop("range", "before")


def keyed(rows: DataFrame, key: str = "row_key") -> DataFrame:
    """The rows (doc_id, text and others) with a key of their own: doc_id, where it is unique and never null.

    Else rows are written with their number in the order of doc_id (null last) and digest of the text,
    so that the least key of some rows is that of the least doc_id.
    """
    total, different = rows.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if total == different:
        return rows.withColumn(key, F.col("doc_id"))
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return numbered(rows.withColumn("text_digest", digest), "doc_id", "text_digest").withColumnRenamed("number", key).drop("text_digest")


def by_version(rows: DataFrame, use: Callable[[DataFrame], DataFrame], back: tuple[str, ...] = (), id_col: str = "doc_id", value: Column | None = None, keep: tuple[str, ...] = ("text",)) -> DataFrame:
    """use(rows) for rows whose id may repeat or be null: as many rows as came, by id.

    value is what tells rows of one id apart (the text), keep the columns that use takes. Where ids
    are unique that is all. Else rows of equal id and value count as one; they are numbered by id
    (null last) and digest of the value, used by their numbers, and every row gets its number's
    result. Columns named in back hold numbers that are turned into ids too.
    """
    ids = rows.select(F.col(id_col).cast("long").alias(id_col), *keep)
    total, different = ids.agg(F.count("*"), F.count_distinct(id_col)).first()
    if total == different:
        return use(ids)
    ids = ids.withColumn("digest", F.sha2(F.coalesce(F.col("text") if value is None else value, F.lit("")).cast("binary"), 256))
    versions = written(numbered(ids.select(id_col, "digest").distinct(), id_col, "digest"), "versions")
    theirs = versions.select(F.col(id_col).alias("own_id"), F.col("digest").alias("own_digest"), "number")
    placed = ids.join(theirs, ids[id_col].eqNullSafe(theirs["own_id"]) & (ids["digest"] == theirs["own_digest"]))
    found = written(use(placed.select(F.col("number").alias(id_col), *keep).dropDuplicates([id_col])), "found")
    columns = [c for c in found.columns if c != id_col]
    for name in back:
        found = found.join(versions.select(F.col("number").alias(name), F.col(id_col).alias("was")), name, "left").drop(name).withColumnRenamed("was", name)
    found = found.withColumnRenamed(id_col, "number")
    return placed.select(F.col("own_id").alias(id_col), "number").join(found, "number").select(id_col, *columns)
