"""Sinks: append-only JSON lines, keyed replacement, publication, Markdown tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_json_lines(rows: DataFrame, path: str) -> None:
    """One object a line, appended; nulls are left out."""
    rows.write.mode("append").json(path)


def upsert(held: DataFrame | None, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Rows of held whose key is not in fresh, and all of fresh."""
    return fresh if held is None else held.join(fresh.select(*key).distinct(), key, "left_anti").unionByName(fresh)


def delete(held: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """held without the rows of the given keys."""
    return held.join(keys.select(*key).distinct(), key, "left_anti")


def publish(rows: DataFrame, path: str) -> None:
    """Replace a table by a complete new one: written beside it, then renamed over it."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    staging, old = f"{path}.staging-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    rows.write.parquet(staging)
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = fs.exists(to)
    if held:
        fs.rename(to, jvm.org.apache.hadoop.fs.Path(old))
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), to):
        if held:
            fs.rename(jvm.org.apache.hadoop.fs.Path(old), to)
        raise OSError(f"could not publish {path}")
    if held:
        fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)


def cell(value: Column) -> Column:
    """A Markdown table cell: line ends to blanks, pipes escaped, null empty."""
    return F.replace(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\s+", " "), F.lit("|"), F.lit(r"\|"))


def markdown_rows(rows: DataFrame) -> DataFrame:
    """line: each row as a Markdown table row, columns in their order."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(c)) for c in rows.columns]), F.lit(" |")).alias("line"))
