"""The document that a proposed path means: by the likeness of what both may be called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import common_length
from foliant.operators.similar import similar
from foliant.tables import settled

#: Score from which a path is resolved, and the higher ones that are tried first.
CUTOFF = 70
FIRST = (95, 90, 80)


def normalised(path: Column) -> Column:
    """Lower case, forward slashes, none at the ends."""
    return F.regexp_replace(F.replace(F.lower(F.trim(path)), F.lit("\\"), F.lit("/")), "^/+|/+$", "")


def aliases(path: Column) -> Column:
    """A normalised path and its base name, with and without .md."""
    base, bare = F.substring_index(path, "/", -1), F.regexp_replace(path, r"\.md$", "")
    return F.filter(F.array_distinct(F.array(path, base, bare, F.substring_index(bare, "/", -1))), lambda x: x != "")


def resolved(proposed: DataFrame, paths: DataFrame, cutoff: int = CUTOFF) -> DataFrame:
    """id, path and score for proposed (id, proposed) and paths (path): the closest, null below the cutoff.

    Score: the best of all pairs of aliases; then the whole paths decide, then the later path. Aliases
    meet as distinct strings. Null and empty paths are close to nothing.
    """
    asked = settled(proposed.select("id", normalised(F.col("proposed")).alias("p")))
    known = settled(paths.where("path IS NOT NULL").select("path", normalised(F.col("path")).alias("q")).distinct())
    open_ = settled(asked.select("id", "p", F.explode(aliases(F.col("p"))).alias("a")))
    other = settled(known.select("path", "q", F.explode(aliases(F.col("q"))).alias("b")))
    names = other.select(F.col("b").alias("s")).distinct()
    found = asked.select("id", F.lit(None).cast(known.schema["path"].dataType).alias("path"), F.lit(None).cast("double").alias("score")).limit(0)
    # A best score from a cutoff on is the best of the pairs from that cutoff on: only who has none goes on to the next, where more pairs meet.
    for least in [*[x for x in FIRST if x > cutoff], cutoff]:
        best = settled(_closest(open_, other, similar(open_.select(F.col("a").alias("s")).distinct(), names, least)))
        found = found.union(best)
        open_ = settled(open_.join(best, "id", "left_anti"))
        if open_.isEmpty():
            break
    return asked.select("id").join(found, "id", "left").select("id", "path", "score")


def _closest(one: DataFrame, other: DataFrame, near: DataFrame) -> DataFrame:
    """id, path and score: of the pairs of aliases (a, b, score) that are near, each id's best."""
    met = one.join(near, "a").join(other, "b").groupBy("id", "p", "path", "q").agg(F.max("score").alias("score"))
    # Only the best by alias go on to the whole paths.
    top = met.groupBy("id").agg(F.max("score").alias("score"))
    tied = met.join(top, ["id", "score"]).withColumn("common", common_length.asNondeterministic()("p", "q"))
    whole = 200.0 * F.col("common") / (F.length("p") + F.length("q"))
    return tied.groupBy("id").agg(F.max(F.struct("score", whole.alias("whole"), "path")).alias("m")).select("id", "m.path", "m.score")
