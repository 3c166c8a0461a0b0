"""The corpus pipeline: five stages over ``documents``, each one of the corpus operators.

A stage takes (spark, docs, sf_dir) and works on every row that the one before kept. All but the
last return the columns of documents. Null and empty texts are documents like others: they carry
no evidence against them, have no near copies and lose no bytes. So are rows whose doc_id is null or
stands on other rows too: where a doc_id is not one row's alone, a stage numbers its rows and decides
by those numbers; the doc_ids stay as they are. Labels are found by doc_id, for training only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, minhash, mixing, quality, suffix
from foliant.llm.common import keyed, written
from foliant.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _as_docs(rows: DataFrame) -> DataFrame:
    """The rows by their keys, as the operators take documents."""
    return rows.drop("doc_id").withColumnRenamed("row_key", "doc_id")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the labels, does not reject."""
    rows = keyed(docs.select(COLUMNS))
    graded = quality.grade(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), rows=_as_docs(rows))
    return rows.join(graded.where("keep").select(F.col("doc_id").alias("row_key")), "row_key", "left_semi").select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8), that of the least doc_id."""
    rows = keyed(docs.select(COLUMNS))
    kept = minhash.near_duplicates(_as_docs(rows)).where("kept").select(F.col("doc_id").alias("row_key"))
    return rows.join(kept, "row_key", "left_semi").select(COLUMNS)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of passages that start earlier; cut characters go whole."""
    rows = keyed(docs.select(COLUMNS))
    cut = suffix.repeated_passages(_as_docs(rows)).select(F.col("doc_id").alias("row_key"), "kept_text")
    text = F.coalesce("kept_text", "text")
    out = rows.join(cut, "row_key", "left").withColumn("text", text)
    return out.withColumn("n_chars", F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix holds it; copies keep their doc_id."""
    rows = keyed(docs.select(COLUMNS))
    copies = mixing.mix(_as_docs(rows)).where("copies > 0").select(F.col("doc_id").alias("row_key"), "copies")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return rows.join(copies, "row_key").select(*COLUMNS, times.alias("copy")).select(COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, the ids of every document of the mix and the digest of what they decode to."""
    both = bpe.round_trip(docs, *vocabulary(), keep=["source"])
    return both.select("doc_id", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("source_mix", source_mix),
    ("tokenise", tokenise),
]

#: The classifier's fit, the groups and the spans are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; each one's rows are written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
