"""Approximate nearest neighbours by shifted space-filling curves.

Each of several curves projects the vectors to a few random directions, shifts the cube and orders
the cells by their Hilbert key. Spark cuts every curve into ranges of equal weight; a query meets
the ranges around its own key, each range gives its best rows, and the curves' answers are merged
and ranked by the exact inner product.

How far a query looks is measured, not assumed: PILOT queries are answered exactly (in one pass over
all rows), and the fewest curves and the shortest reach are taken that find RECALL of their
neighbours. Ranges grow in number with the rows, so on structured vectors a query meets a few
thousand rows however many there are; on vectors without structure no reach short of most of a
curve finds them, and the work stays a share of queries times rows.

A range is dealt in slices, and a range's queries in slices too, so that a task holds a bounded
block of rows and a bounded block of queries however large the table or a group of equal vectors.

Nearness is the inner product in double precision; ties go to the smaller vec_id.

Cases: null, empty and zero vectors, and those with null or non-finite components or of another
length than the most frequent one, take no part. Fewer rows than asked for give all candidates. A
query is never its own candidate; equal vectors under other ids are. Rows that repeat count once; of
different vectors with one vec_id each is a candidate, and a query's list is that of all of them.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Curves at most (and at least, but for few rows), projected dimensions, bits of a coordinate.
CURVES, FEWEST, DIMENSIONS, BITS = 4, 2, 4, 8
#: Rows of a range, and the least and the greatest number of ranges of a curve.
RANGE_ROWS, RANGES, MOST_RANGES = 2048, 16, 4096
#: Queries of the pilot, and the share of their neighbours that curves and reach have to find.
PILOT, RECALL = 200, 0.94
#: Rows in a slice of a range, and queries in a slice.
SLICE = 4096


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of integer cells (n, d): Gray-code walk from the highest bit down, vectorised."""
    x = cells.T.astype(np.int64).copy()
    d = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations and reflections of the sub-cubes
        low = q - 1
        for i in range(d):
            flip = (x[i] & q) > 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    mask = np.zeros(x.shape[1], np.int64)
    q = top
    while q > 1:
        mask = np.where(x[d - 1] & q, mask ^ (q - 1), mask)
        q >>= 1
    x ^= mask
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> bit & 1)
    return key


class Curve:
    """One projection, shift and Hilbert order."""

    def __init__(self, number: int, length: int):
        draw = np.random.RandomState(1000 + number)
        self.axes = np.linalg.qr(draw.standard_normal((length, max(DIMENSIONS, 1))))[0][:, :DIMENSIONS]
        self.shift = draw.uniform(0, 1, self.axes.shape[1])

    def keys(self, unit: np.ndarray) -> np.ndarray:
        # Components of unit vectors spread by 1/sqrt(length); four deviations fill half the cube.
        scale = np.sqrt(len(self.axes)) / 8
        cube = (unit @ self.axes * scale + 0.5 + self.shift) / 2
        return hilbert(np.clip(cube * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, vector, keys array<bigint>: one Hilbert key for each curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curves: list[Curve] = []
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1))
            curves = curves or [Curve(i, x.shape[1]) for i in range(CURVES)]
            unit = x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)
            keys = np.stack([c.keys(unit) for c in curves], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * CURVES, pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["vec_id", "vector", "keys"])

    return vectors.mapInArrow(run, "vec_id bigint, vector array<double>, keys array<bigint>")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1)


def usable(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vector array<double> of the rows that take part."""
    good = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", good) & F.exists("vector", lambda v: v != 0))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()  # one row
    return rows.where(F.size("vector") == (lengths[0]["n"] if lengths else 0))


def _best(data: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of a block for each query: fast products choose, exact ones decide.

    Everything within rounding of the k-th product is decided exactly, so equal vectors tie.
    """
    out = []
    rough = queries @ data.T
    slack = 1e-12 * (1 + np.abs(queries).sum(axis=1) * np.abs(data).max(initial=0))
    for q in range(len(queries)):
        own = np.where(ids == query_ids[q], -np.inf, rough[q])
        n = min(k, int((ids != query_ids[q]).sum()))
        if not n:
            continue
        kth = np.partition(own, len(own) - n)[len(own) - n]
        some = np.flatnonzero(own >= kth - slack[q])
        exact = np.zeros(len(some))
        for i in range(data.shape[1]):  # in order of components: the same sum wherever a row stands
            exact += queries[q, i] * data[some, i]
        first = np.lexsort((ids[some], -exact))[:n]
        out.append(pd.DataFrame({"query_id": query_ids[q], "vec_id": ids[some[first]], "score": exact[first]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})


def _block(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(left) or not len(right):
        return _best(np.zeros((0, 1)), np.empty(0, np.int64), np.zeros((0, 1)), np.empty(0, np.int64), k)
    data, queries = np.stack(left["vector"]), np.stack(right["vector"])
    parts = [_best(data, left["vec_id"].to_numpy(), queries[i : i + 256], right["query_id"].to_numpy()[i : i + 256], k) for i in range(0, len(queries), 256)]
    return pd.concat(parts)


def _pilot(rows: DataFrame, is_query, k: int, cuts: list[np.ndarray]) -> tuple[int, int]:
    """Number of curves and reach: the cheapest that find RECALL of the exact neighbours of PILOT queries.

    The driver holds the pilot's queries and the keys of their neighbours only.
    """
    asked = rows.where(is_query(F.col("vec_id"))).orderBy(F.xxhash64("vec_id"), "vec_id").limit(PILOT).toPandas()
    if not len(asked):
        return FEWEST, 0
    queries, query_ids = np.stack(asked["vector"]), asked["vec_id"].to_numpy()
    told = rows.sparkSession.sparkContext.broadcast((queries, query_ids))  # PILOT rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, query_ids = told.value
        for batch in batches:
            for part in (batch.slice(i, SLICE) for i in range(0, len(batch), SLICE)):
                ids = np.asarray(part.column(0))
                best = _best(_matrix(part.column(1)), ids, queries, query_ids, k)
                if len(best):
                    keys = pa.table({"vec_id": part.column(0), "keys": part.column(2)}).take(pa.array(np.argsort(ids, kind="stable")[np.searchsorted(np.sort(ids), best["vec_id"])]))
                    yield pa.RecordBatch.from_arrays([pa.array(best["query_id"]), pa.array(best["vec_id"]), pa.array(best["score"]), keys["keys"].combine_chunks()], names=["query_id", "vec_id", "score", "keys"])

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    near = rows.mapInArrow(run, "query_id bigint, vec_id bigint, score double, keys array<bigint>").withColumn("rank", rank).where(F.col("rank") <= k).toPandas()
    if not len(near):
        return FEWEST, 0
    number = {q: i for i, q in enumerate(query_ids)}
    own = np.stack(asked["keys"])[[number[q] for q in near["query_id"]]]
    at = lambda keys: np.stack([np.searchsorted(c, keys[:, i], "right") for i, c in enumerate(cuts)], axis=1)
    asked_at, near_at, ranges = at(own), at(np.stack(near["keys"])), len(cuts[0]) + 1
    best = None
    for n in range(FEWEST, CURVES + 1):
        for reach in range(ranges // 2 + 1):
            first = _first(asked_at[:, :n], reach, ranges)
            met = ((near_at[:, :n] >= first) & (near_at[:, :n] <= first + 2 * reach)).any(axis=1)
            if met.mean() >= RECALL or 2 * reach + 1 >= ranges:
                cost = n * min(2 * reach + 1, ranges)
                best = min(best or (cost, n, reach), (cost, n, reach))
                break
    return best[1], best[2]


def _first(own, reach: int, ranges: int):
    """The first range that a query meets: the ends of a curve reach further on the other side."""
    return np.maximum(0, np.minimum(own - reach, ranges - 1 - 2 * reach))


def _placed(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """vec_id, vector, curve, range: every row once for each curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(2).flatten()).reshape(len(batch), -1)
            for i, c in enumerate(cuts):
                place = np.searchsorted(c, keys[:, i], "right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(batch), i, np.int32)), pa.array(place)], names=["vec_id", "vector", "curve", "range"])

    return rows.mapInArrow(run, "vec_id bigint, vector array<double>, curve int, range int")


def nearest(embeddings: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", curves: int | None = None, reach: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows found nearest to each query row (a condition on vec_id).

    curves and reach are found by a pilot unless they are given.
    """
    rows = written(keyed(usable(embeddings, id_col, vector_col)).distinct(), "keyed")
    total, asked = rows.agg(F.count("*"), F.count_if(is_query(F.col("vec_id")))).first()
    ranges = max(RANGES, min(MOST_RANGES, total // RANGE_ROWS))
    # Where the curves are cut: quantiles of each, a table of bounded size.
    quantiles = [j / ranges for j in range(1, ranges)]
    found = rows.agg(*[F.percentile_approx(F.col("keys")[i], quantiles, F.lit(20 * ranges)).alias(f"c{i}") for i in range(CURVES)]).first()
    cuts = [np.array(c or [0] * (ranges - 1), np.int64) for c in found]
    if curves is None or reach is None:
        curves, reach = _pilot(rows, is_query, k, cuts)
    reach = min(reach, ranges // 2)
    slices = max(1, -(-total // (ranges * SLICE)))
    query_slices = max(1, -(-asked * (2 * reach + 1) // (ranges * SLICE)))

    rows = _placed(rows, cuts[:curves])
    data = rows.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices)))
    data = data.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_slices - 1)))) if query_slices > 1 else data.withColumn("part", F.lit(0))
    asking = rows.where(is_query(F.col("vec_id"))).withColumnRenamed("vec_id", "query_id")
    # The ends of a curve have fewer neighbours on one side; they reach further on the other.
    first = F.greatest(F.lit(0), F.least(F.col("range") - reach, F.lit(ranges - 1 - 2 * reach)))
    asking = asking.withColumn("range", F.explode(F.sequence(first, F.least(first + 2 * reach, F.lit(ranges - 1)))))
    asking = asking.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(query_slices)).cast("int"))
    asking = asking.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<bigint>")))
    block = ["curve", "range", "slice", "part"]
    found = data.groupBy(*block).cogroup(asking.groupBy(*block)).applyInPandas(lambda a, b: _block(a, b, k), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
