"""The named queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chroma, hosts, licenses, minhash, mixing, neighbours, packing, periodic, quality, resample, suffix, warc
from .common import WORD


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[list[tuple[bytes, int]], str]:
    """Ranks and split pattern of an installed public tokenizer."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents; digests of the ids and of the decoded bytes."""
    out = bpe.round_trip(_table(spark, sf_dir, "documents"), *vocabulary())
    spelled = F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")
    return out.select("doc_id", "n_tokens", F.sha2(spelled, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: 3-word shingles, Jaccard 0.85 or more."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), n=3, percent=85)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and host reputation for all pages; a page's review is the label of the same number."""
    labels = _table(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    return hosts.judge(_table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mixing.taken_words(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of all documents."""
    return licenses.license_labels(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and probability of the best grade of all documents."""
    return quality.grade(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, as read back from the archives that they were written to."""
    return warc.round_trip(_table(spark, sf_dir, "pages"), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that repeated passages of 100 bytes or more take from each document."""
    return suffix.digests(_table(spark, sf_dir, "documents"))


def op9_chroma_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and alignments of synthetic recordings, one for each row of embeddings.

    Queries are the recordings whose id is divisible by 50, against all.
    """
    media = chroma.synthetic_media(_table(spark, sf_dir, "embeddings"))
    return chroma.matches(media, lambda i: i % 50 == 0)


def op10_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for each row of embeddings whose vec_id is divisible by 20."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def _planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the documents repeats a stretch of its words up to its end.

    By the checksum h of its id in decimal: from word a = h // 10 % n on, every p words are the same.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    rows = rows.withColumn("n", n.cast("long")).withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    rest, a, p = (F.col("n") - F.col("a")).cast("int"), F.col("a").cast("int"), F.col("p").cast("int")
    again = F.flatten(F.array_repeat(F.slice("w", a + 1, p), F.ceil(rest / p).cast("int")))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), a), F.slice(again, F.lit(1), rest)), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of all documents, and digests of the texts without the repetitions."""
    out = periodic.periodic_runs(_planted(_table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    spelled = F.array_join(F.transform("runs", line), "").cast("binary")
    return out.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.n") / -F.col("best.p")).alias("exponent_milli"), F.sha2(spelled, 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and place of every piece of all documents' tokens."""
    import public_tokenizers

    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), *files, public_tokenizers.PATTERN, ids=False)
    return packing.packed(pieces)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of all documents, resampled towards the benchmark's texts."""
    out = resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_minhash_dedup, op3_url_filter, op4_source_mix, op5_license_scan,
        op6_quality_classifier, op7_warc_archive, op8_suffix_dedup, op9_chroma_match, op10_hilbert_neighbours,
        op11_periodic_runs, op12_best_fit_packing, op13_importance_resampling,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": hosts.oracle(),
    "op4_source_mix": mixing.ORACLE,
    "op7_warc_archive": warc.ORACLE,
    "op13_importance_resampling": resample.oracle(),
}
