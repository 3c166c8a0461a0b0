"""Event streams: windows, sessions, rolling budgets, inactivity; batch forms of the streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.plans.registry import query
from foliant.streaming import jobs
from foliant.tables import table


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def usage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type."""
    return jobs.usage(table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE - INTERVAL 1 MICROSECOND THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m) SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def usage_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user: gaps of half an hour end them."""
    return jobs.sessions(table(spark, sf_dir, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT event_id, sum(greatest(value, 0)) OVER w <= 2000 AS admitted, round(sum(greatest(value, 0)) OVER w, 4) AS used_60s FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW)""")
def rolling_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of the last sixty seconds by descriptor (type of event), and whether a request fits the budget.

    A descriptor may hold most requests, so windows are kept to its minutes: each request is also
    dealt to the minute that follows, where it only counts. Units are added as decimals, so that a sum
    on the budget is on it in whatever order they come; units that are no decimals are added as doubles.
    """
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.greatest("value", F.lit(0.0)).alias("units"), F.unix_micros("ts").alias("micros"))
    e = e.withColumn("own", F.floor(F.col("micros") / 60_000_000)).withColumn("minute", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    w = Window.partitionBy("event_type", "minute").orderBy("micros").rangeBetween(-60_000_000, 0)
    exact = F.expr("try_cast(units AS decimal(28, 10))")
    as_they_are = F.count_if(exact.isNull() & F.col("units").isNotNull()).over(w) > 0
    used = F.when(as_they_are, F.sum("units").over(w)).otherwise(F.sum(exact).over(w).cast("double"))
    return e.withColumn("used", used).where("own = minute").select("event_id", (F.col("used") <= 2000).alias("admitted"), F.round("used", 4).alias("used_60s"))


@query("SELECT user_id, max(ts) AS latest, max(ts) <= TIMESTAMP '2024-01-29' - INTERVAL 1 DAY AS expired FROM events GROUP BY user_id")
def inactivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users without an event since a date."""
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").cast("timestamp_ntz").alias("latest"))
    return g.select("user_id", "latest", (F.col("latest") <= F.lit("2024-01-28").cast("timestamp_ntz")).alias("expired"))


@query("SELECT event_type, count(*)::BIGINT AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k, max(md5(props)) AS last_hash FROM events GROUP BY event_type")
def json_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values out of JSON payloads, and a content hash."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"), F.max(F.md5(F.col("props").cast("binary"))).alias("last_hash"))


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS position FROM events")
def fifo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue positions by request time within each descriptor (type of event).

    Requests are numbered within an hour; the counts of a descriptor's earlier hours are added.
    """
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.date_trunc("hour", "ts").alias("hour"))
    counts = e.groupBy("event_type", "hour").agg(F.count("*").alias("n"))
    before = counts.select("event_type", "hour", (F.sum("n").over(Window.partitionBy("event_type").orderBy("hour")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("event_type", "hour").orderBy("ts", "event_id"))
    return e.withColumn("within", within).join(before, ["event_type", "hour"]).select("event_id", (F.col("before") + F.col("within")).alias("position"))


@query("SELECT user_id, event_type, max(ts) AS latest, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest change by key."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").cast("timestamp_ntz").alias("latest"), F.count("*").alias("n"))
