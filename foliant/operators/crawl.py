"""A bounded crawl over a table of links, in rounds: what a queue for each site would fetch.

A round is one depth. The addresses that the pages of the round before link to stand in the order of
those pages and of the links in them; of each address the first place counts, and only if no earlier
round had it. Redirects are followed before a page counts, so two addresses of one page are one. Of
what is left the first up to the site's limit are its pages; the limit goes on over all rounds. A
round's tables are written, so that no round replays the ones before; a site's order only looks at
its first pages.

Cases: addresses that are no page, or lead to another site, are passed over; links to the page itself
too. A site whose start is no page has no pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.tables import settled


def crawled(starts: DataFrame, links: DataFrame, pages: DataFrame, depth: int = 1, limit: int = 50, redirects: DataFrame | None = None) -> DataFrame:
    """site, url, depth and nth (from 1): the pages that are fetched, in order.

    starts: site, url (one for a site); links: src, dst, pos (place in the page); pages: site, url;
    redirects: url, final (where the chain ends).
    """
    fetchable = pages.select("site", F.col("url").alias("final")).distinct()
    front = settled(starts.select("site", "url", F.lit(0).cast("long").alias("by"), F.lit(0).cast("long").alias("pos")))
    seen = saved = None
    for level in range(depth + 1):
        first = front.groupBy("site", "url").agg(F.min(F.struct("by", "pos")).alias("at"))
        if seen is not None:
            first = first.join(seen, ["site", "url"], "left_anti")
        first = settled(first)
        seen = first.select("site", "url") if seen is None else settled(seen.union(first.select("site", "url")))
        led = first.withColumn("final", F.col("url")) if redirects is None else first.join(redirects.select("url", "final"), "url", "left").withColumn("final", F.coalesce("final", "url"))
        found = led.join(fetchable, ["site", "final"], "left_semi").groupBy("site", "final").agg(F.min("at").alias("at"))
        so_far = None
        if saved is not None:
            found = found.join(saved.select("site", F.col("url").alias("final")), ["site", "final"], "left_anti")
            so_far = saved.groupBy("site").agg(F.count("*").alias("had"))
        place = F.row_number().over(Window.partitionBy("site").orderBy("at"))
        ranked = found.withColumn("place", place).where(F.col("place") <= limit)
        ranked = ranked.withColumn("had", F.lit(0).cast("long")) if so_far is None else ranked.join(so_far, "site", "left").withColumn("had", F.coalesce("had", F.lit(0)))
        fresh = settled(ranked.withColumn("nth", F.col("had") + F.col("place")).where(F.col("nth") <= limit).select("site", F.col("final").alias("url"), F.lit(level).alias("depth"), "nth"))
        saved = fresh if saved is None else settled(saved.union(fresh))
        if level < depth:
            if fresh.isEmpty():
                break
            front = settled(fresh.join(links, fresh["url"] == links["src"]).select("site", F.col("dst").alias("url"), F.col("nth").alias("by"), F.col("pos").cast("long").alias("pos")))
    return saved
