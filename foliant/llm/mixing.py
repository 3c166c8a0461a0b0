"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A document's expected copies are its source's target over the source's size. Within a source the
documents stand in a fixed order; the prefix sum of expected copies, moved by one random offset of
the source, crosses integer boundaries, and a document is emitted once for each one it crosses.
Neighbours in the order have about the same size, so the words taken stay near the target.

A source may hold a third of all rows: prefix sums are taken in two levels. A cell is a source,
a size class and a block of doc_id; blocks grow in number with the rows, so that a cell stays at
about BLOCK_ROWS rows even if all texts have one size, and only rows of one cell are ordered among
themselves. What is summed in one place are cells (of a source) and sources, of which there are
many rows fewer; a corpus has at most some thousands of sources.

Cases: a null or empty text has size 0 and adds no words, whatever its copies; a source without
words has target 0; null is a source of its own, last in the order; null doc_ids share a block.
Rows that repeat are documents each, in any order among themselves. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import count_words

#: Weights of the sources in code-point order, repeating; share of all words that is asked for;
#: how often a source may be repeated at most.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
#: Blocks of doc_id within a size class, at least, and rows for which there is one more.
CELLS, BLOCK_ROWS = 64, 50_000
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """Of one row per source (source, source_size): its target, as weight allows, at most repeats * size.

    What a capped source can't take is shared again by weight until no source is above its cap. In
    order of cap per weight, the capped sources are a prefix: the first source whose cap is not
    below its share of what the prefix leaves ends it. Returns source, source_size, target.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    capped = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.partitionBy()
    level = (F.sum("source_size").over(everyone) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levelled = capped.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
    # Levels rise up to the first that fits and fall from there, so it is the greatest of those that
    # fit. Without one, all sources are at their caps.
    final = F.max(F.when(F.col("fits"), F.col("level"))).over(everyone)
    target = F.least(F.col("cap"), F.coalesce(final * F.col("weight"), F.col("cap")))
    return levelled.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: how often the mix holds each document.

    The same rows give the same copies, however they are partitioned.
    """
    blocks = max(CELLS, docs.count() // BLOCK_ROWS)
    sized = docs.select(F.col("doc_id").cast("long"), "source", count_words(F.col("text")).alias("size"))
    # Eight size classes for each power of two, so that neighbours differ by a tenth at most.
    sized = sized.withColumn("class", F.floor(8 * F.log2(1.0 + F.col("size")))).withColumn("block", F.coalesce(F.pmod("doc_id", F.lit(blocks)), F.lit(0)))
    cells = sized.groupBy("source", "class", "block").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    per_source = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, repeats)
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce("source", F.lit("null")))), 1, 8), 16, 10).cast("double") / 2.0**32
    per_source = per_source.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("expected"), draw.alias("offset"))
    earlier = Window.partitionBy("source").orderBy("class", "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    placed = placed.join(per_source, placed["source"].eqNullSafe(per_source["source"])).select(placed["source"], "class", "block", "before", "source_size", "target", "expected", "offset")
    rank = F.row_number().over(Window.partitionBy("source", "class", "block").orderBy("size", "doc_id"))
    ranked = sized.withColumn("rank", rank)
    same = ranked["source"].eqNullSafe(placed["source"]) & (ranked["class"] == placed["class"]) & (ranked["block"] == placed["block"])
    nth = F.col("before") + F.col("rank")
    copies = F.floor(nth * F.col("expected") + F.col("offset")) - F.floor((nth - 1) * F.col("expected") + F.col("offset"))
    return ranked.join(placed, same).select("doc_id", ranked["source"], "size", "source_size", "target", copies.cast("long").alias("copies"))


def taken_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken: the words that the mix takes of each document."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The same in DuckDB, over the documents view.
ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         source_size * 2.0::DOUBLE AS cap FROM source),
levelled AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
     - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
final AS (
  SELECT *, least(cap, coalesce(max(level) FILTER (level <= cap / weight) OVER () * weight, cap)) AS target FROM levelled),
drawn AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS expected,
         ('0x' || substr(md5('{SEED}:' || coalesce(source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start
  FROM final),
ranked AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source
           ORDER BY floor(8 * log2(1.0::DOUBLE + size)), doc_id % greatest({CELLS}, (SELECT count(*) FROM documents) // {BLOCK_ROWS}), size, doc_id) AS nth
  FROM sized)
SELECT r.doc_id, r.size, d.source_size, d.target,
       ((floor(nth * expected + start) - floor((nth - 1) * expected + start))::BIGINT * r.size)::BIGINT AS taken
FROM ranked r JOIN drawn d ON r.source IS NOT DISTINCT FROM d.source
"""
