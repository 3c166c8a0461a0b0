"""Ranking operators on (query, item, score) tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.tables import settled


def numbered(rows: DataFrame, key: Column, *ties: str, name: str = "position") -> DataFrame:
    """The rows with their number, from 1, in order of a key and then the ties' columns, nulls last.

    Rows are sorted by ranges of all these columns, so that many rows of one key are dealt out by the
    others, and numbered within a range; the counts of the earlier ranges are added. What is summed
    in one place is a row for each range.
    """
    order = [F.col(c).asc_nulls_last() for c in ("_key", *ties)]
    placed = settled(rows.withColumn("_key", key).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + within).drop("_key", "_at", "_range", "_before")


def repaired(returned: DataFrame, wanted: DataFrame) -> DataFrame:
    """query, item, position: a returned order with repeats and strangers out, missing items appended.

    returned: query, item, place; wanted: query, item, nth (input order).
    """
    first = returned.groupBy("query", "item").agg(F.min("place").alias("place"))
    joined = wanted.join(first, ["query", "item"], "left")
    order = Window.partitionBy("query").orderBy(F.col("place").isNull(), "place", "nth")
    return joined.select("query", "item", F.row_number().over(order).alias("position"))


def is_permutation(ranks: DataFrame) -> DataFrame:
    """query, valid: whether a query's ranks are 1 to n, each once."""
    g = ranks.groupBy("query").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    return g.select("query", ((F.col("n") == F.col("d")) & (F.col("lo") == 1) & (F.col("hi") == F.col("n"))).alias("valid"))


def swiss_top_k(items: DataFrame, k: int, batch: int = 16, strength: Callable[[], Column] | None = None, seed: int = 1) -> DataFrame:
    """The k best of items (item, value) by rounds of small groups: each keeps its better half.

    Groups are dealt by a seeded hash in every round until fewer than twice k are left; those are
    ordered at once. An item among the k best of all loses only to better ones, so with batches of
    twice k at least the result is exact.
    """
    if batch < 2 * k:
        batch = 2 * k
    value = strength() if strength else F.col("value")
    held, turn = items.withColumn("value", value), 0
    count = held.count()
    while count >= 2 * k and count > batch:
        group = F.pmod(F.xxhash64("item", F.lit(seed + turn)), F.lit(-(-count // batch)))
        rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("value"), "item"))
        size = F.count("*").over(Window.partitionBy(group))
        held = held.withColumn("r", rank).withColumn("s", size).where((F.col("r") <= F.greatest(F.ceil(F.col("s") / 2), F.lit(k)))).drop("r", "s")
        held = settled(held)
        fresh, turn = held.count(), turn + 1
        if fresh == count:
            break
        count = fresh
    top = held.orderBy(F.desc("value"), "item").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), "item")))
