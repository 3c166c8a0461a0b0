"""Connected components of a link table by rounds of least neighbours with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.tables import settled


def connected(links: DataFrame) -> DataFrame:
    """Of links (a, b): node and component, the least node that it reaches. No links give no rows.

    A round gives every node the least label around it and then that label's own label; labels fall
    along paths at twice the speed each round. Everything stays in tables.
    """
    both = settled(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        theirs = labels.select(F.col("node").alias("b"), F.col("component").alias("other"))
        near = both.join(theirs, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("near"))
        low = labels.join(near, "node").select("node", F.least("component", "near").alias("low"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("next"))
        fresh = settled(low.join(jump, "low", "left").select("node", F.least("low", "next").alias("component"), "was"))
        done = fresh.where("component <> was").isEmpty()
        labels = fresh.select("node", "component")
        if done:
            return labels
