"""The tables that the queries read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name; the time of events becomes a timestamp with zone, as watermarks need."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register the named tables as temporary views."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder named by ``spark.checkpoint.dir``; a temporary one only in tests, where none is set and all is one process."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="foliant-"))
    return df.checkpoint()
