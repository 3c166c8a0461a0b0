"""Similarity joins of strings that lose nothing: by common subsequence, and by containment.

Two strings are similar if twice their longest common subsequence is a share of both lengths. What is
not in it of both is at least what the multisets of their characters differ by; a string's multiset is
a mark of 128 bits, in which no difference counts twice. Strings are dealt in blocks, every block
meets every other one, and a task holds two: strings of lengths that can be similar are compared by
their marks, a few instructions a pair, and by their subsequence only where the marks allow it. So
memory is bounded; time still grows with the square of the distinct strings.

A string that contains another one has its rarest three neighbouring characters; shorter ones are
looked up whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import common_characters
from foliant.tables import settled

#: Strings of a block while there are few blocks, blocks at most of a side, pairs compared at once, tasks.
BLOCK, BLOCKS, AT_ONCE, TASKS = 4096, 96, 1 << 20, 96


@cache
def _bit(c: str, k: int) -> int:
    """The place in a mark of the k-th c of a string."""
    return 1 << (((ord(c) * 0x9E3779B1 + k * 0x85EBCA6B) & 0xFFFFFFFF) >> 25)


def mark(text: str) -> int:
    """128 bits of a multiset of characters: of two strings, no more bits differ than characters."""
    seen: dict[str, int] = {}
    bits = 0
    for c in text:
        seen[c] = k = seen.get(c, 0) + 1
        bits |= _bit(c, k)
    return bits


def marks(texts: list[str]) -> np.ndarray:
    """The marks of strings as two numbers each."""
    return np.frombuffer(b"".join(mark(t).to_bytes(16, "little") for t in texts), np.uint64).reshape(-1, 2)


def _codes(texts: list[str]) -> np.ndarray:
    """The characters of strings of one length as a table of numbers."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(texts), -1)


def common_lengths(x: list[str], y: list[str], at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Of pairs of places in x and y, strings of one length each, the lengths of the common subsequences: common_characters for all pairs at once."""
    if min(len(x[0]), len(y[0])) > 64:
        return np.fromiter((common_characters(x[i], y[j]) for i, j in zip(at, to)), np.int64, len(at))
    if len(y[0]) > 64:
        x, y, at, to = y, x, to, at
    alphabet, letters = np.unique(_codes(y), return_inverse=True)
    letters = letters.reshape(len(y), -1)
    masks = np.zeros((len(alphabet) + 1, len(y)), np.uint64)
    for k in range(letters.shape[1]):
        masks[letters[:, k], np.arange(len(y))] |= np.uint64(1 << k)
    own = _codes(x)
    place = np.minimum(np.searchsorted(alphabet, own), len(alphabet) - 1)
    place = np.where(alphabet[place] == own, place, len(alphabet))
    full = np.uint64((1 << letters.shape[1]) - 1)
    row = np.full(len(at), full)
    for k in range(own.shape[1]):
        both = row & masks[place[at, k], to]
        row = ((row + both) | (row - both)) & full
    return letters.shape[1] - np.bitwise_count(row).astype(np.int64)


def _near(x: np.ndarray, y: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs whose marks differ by so many bits at most, some rows of x at a time."""
    step = max(1, AT_ONCE // len(y))
    for low in range(0, len(x), step):
        at, to = np.nonzero(np.bitwise_count(x[low : low + step, None, 0] ^ y[None, :, 0]) <= most)
        at += low
        # The whole mark of those that the first half allows.
        fits = np.bitwise_count(x[at, 0] ^ y[to, 0]) + np.bitwise_count(x[at, 1] ^ y[to, 1]) <= most
        for part in np.array_split(np.flatnonzero(fits), fits.sum() // AT_ONCE + 1):
            yield at[part], to[part]


def _met(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> Iterator[pd.DataFrame]:
    """a, b and common of the similar pairs of two blocks (s and n, its length; t and m)."""
    if not len(left) or not len(right):
        return
    own, other = ({k: list(g) for k, g in f.groupby(n)[s]} for f, s, n in ((left, "s", "n"), (right, "t", "m")))
    made = {n: marks(g) for n, g in other.items()}
    for n, x in own.items():
        ours = marks(x)
        for m, y in other.items():
            if 200 * min(n, m) < percent * (n + m):
                continue
            for at, to in _near(ours, made[m], (100 - percent) * (n + m) // 100):
                if len(at):
                    common = common_lengths(x, y, at, to)
                    good = np.flatnonzero(200 * common >= percent * (n + m))
                    yield pd.DataFrame({"a": [x[i] for i in at[good]], "b": [y[i] for i in to[good]], "common": common[good]})


def similar(left: DataFrame, right: DataFrame | None = None, percent: int = 85) -> DataFrame:
    """a, b and score (0 to 100): strings with twice their common subsequence percent or more of both lengths.

    left and right hold distinct strings s; without right, pairs of left with a < b. Empty and null
    strings are similar to nothing, equal ones of left and right to each other. percent is 70 or more.
    """
    if percent < 70:
        raise ValueError("of strings that share less nearly all are compared in full")
    none = pd.DataFrame({"a": pd.Series(dtype=str), "b": pd.Series(dtype=str), "common": pd.Series(dtype="int64")})
    one = right is None
    own = settled(left.select("s").where("s <> ''"))
    other = own if one else settled(right.select("s").where("s <> ''"))
    blocks, parts = (min(BLOCKS, -(-rows.count() // BLOCK) or 1) for rows in (own, other))
    deal = lambda n: F.pmod(F.xxhash64("s"), F.lit(n)).cast("int")
    every = lambda low, n: F.explode(F.sequence(low, F.lit(n - 1)))
    spread = lambda rows: rows.repartition(min(TASKS, blocks * parts), "block", "part").groupBy("block", "part")
    # Of one table, each two blocks meet once.
    x = own.select("s", F.length("s").alias("n"), deal(blocks).alias("block")).withColumn("part", every(F.col("block") if one else F.lit(0), parts))
    # A name of its own: of two sides from one table Spark would take the column for one.
    y = other.select(F.col("s").alias("t"), F.length("s").alias("m"), deal(parts).alias("part")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("part") if one else F.lit(blocks - 1))))
    met = spread(x).cogroup(spread(y)).applyInPandas(lambda a, b: pd.concat([none, *_met(a, b, percent)]), "a string, b string, common int")
    if one:
        # Within a block a pair is found from both sides.
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
        met = met.where((F.col("a") < F.col("b")) | (block("a") != block("b")))
        met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "common")
    return met.select("a", "b", F.round(200.0 * F.col("common") / (F.length("a") + F.length("b")), 6).alias("score"))


def _parts(s: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, F.lit(n))))


def contained(strings: DataFrame) -> DataFrame:
    """a and b: distinct strings s of which b contains a and is longer. Empty and null ones take no part."""
    names = strings.select("s").where("s <> ''")
    long = settled(names.where(F.length("s") >= 3).select("s", F.explode(_parts(F.col("s"), 3)).alias("part")))
    holders = long.groupBy("part").agg(F.count("*").alias("holders"))
    rarest = long.join(holders, "part").groupBy(F.col("s").alias("a")).agg(F.min(F.struct("holders", "part"))["part"].alias("part"))
    whole = rarest.join(long.withColumnRenamed("s", "b"), "part").where(F.contains("b", "a") & (F.length("b") > F.length("a"))).select("a", "b")
    short = names.where(F.length("s") < 3).select(F.col("s").alias("a"))
    pieces = names.where(F.length("s") >= 2).select(F.col("s").alias("b"), F.explode(F.array_distinct(F.concat(_parts(F.col("s"), 1), _parts(F.col("s"), 2)))).alias("a"))
    return whole.union(pieces.join(short, "a").where(F.length("b") > F.length("a")).select("a", "b"))
