"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

A document's set holds its distinct word shingles. One permutation of the hash universe scatters
the shingles, a second one, shifted circularly by k, gives the k-th signature coordinate: all
coordinates come from two permutations. Bands of coordinates deal documents into buckets, and
every link is confirmed on the full sets.

How large groups are kept cheap without losing a link: texts with equal sets count once. In a
bucket the members are compared with a few pivots, and links join into components: a group of
thousands of copies needs about as many comparisons as it has members. What is left are pairs of
different components. A pair is let through to the full sets only if its sizes and a sketch allow
a link: the parities of the numbers of shingles in each of CELLS cells differ in no more places
than the sets do, so no link is lost. Variants of one source that are too far apart to be linked
go there, within the join.

Cases: null or empty texts, and texts without words, have an empty set and are linked with
nothing. With fewer words than a shingle, the whole sequence is the one shingle. Rows with equal
doc_id and text are one document, returned as often as they come; texts that share a doc_id, or
have none (null: last), are told apart by their digests. Ties go to the smaller id. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_version, drop_written, released, written
from .components import components
from .words import slices

#: Size of the hash universe that the two permutations act on; sets of a million shingles still
#: have different minima in it.
UNIVERSE = 1 << 21
#: 36 bands of 7 coordinates: a pair at 0.85 is missed with probability 9e-7, at 0.8 with 2e-4.
BANDS, ROWS = 36, 7
COORDINATES = BANDS * ROWS
#: Cells of the sketch: the parity of the number of shingles in each.
CELLS = 768
PIVOTS = 2


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: A-Z and the six ASCII white spaces only


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text (A-Z lower-cased)."""
    import xxhash

    words = _words(text)
    if not words:
        return np.empty(0, np.int64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n, len(words))
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):  # position-dependent mixing of the words' hashes
        mixed = (mixed ^ hashed[k : k + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed).view(np.int64)


class Circulant:
    """Signatures by two permutations, the second one circularly shifted for each coordinate."""

    def __init__(self, coordinates: int, seed: int = 1):
        draw = np.random.RandomState(seed)
        self.scatter, order = np.arange(UNIVERSE, dtype=np.int32), np.arange(UNIVERSE, dtype=np.int32)
        draw.shuffle(self.scatter)
        draw.shuffle(order)
        ring = np.concatenate([order, order[:coordinates]])
        self.shifted = np.lib.stride_tricks.sliding_window_view(ring, coordinates)[:UNIVERSE]

    def signature(self, items: np.ndarray) -> np.ndarray:
        at = self.scatter[items.view(np.uint64) % np.uint64(UNIVERSE)]
        parts = [self.shifted[at[i : i + 4096]].min(axis=0) for i in range(0, len(at), 4096)]
        return np.minimum.reduce(parts)


_circulant: dict[int, Circulant] = {}


def _bands(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One 64-bit bucket key for each band, and the sketch of CELLS bits."""
    circulant = _circulant.get(COORDINATES) or _circulant.setdefault(COORDINATES, Circulant(COORDINATES))
    parts = circulant.signature(items).astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(ROWS):
        key = (key ^ parts[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    parity = np.bincount((items.view(np.uint64) >> np.uint64(40)).astype(np.int64) % CELLS, minlength=CELLS) & 1
    return key.view(np.int64), np.packbits(parity.astype(bool)).view(np.int64)


def _texts(column: pa.Array) -> Iterator[bytes]:
    for text in column.cast(pa.large_binary()):
        yield text.as_py() or b""


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, same (128-bit digest of the set; null if empty), bands and sketch array<bigint>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, 1):
            sizes, same, bands, sketches = [], [], [], []
            for text in _texts(batch.column(1)):
                items = shingles(text, n)
                sizes.append(len(items))
                same.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                keys, sketch = _bands(items) if len(items) else (None, None)
                bands.append(keys)
                sketches.append(sketch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "same", "bands", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(released(run), "doc_id bigint, n_shingles bigint, same binary, bands array<bigint>, sketch array<bigint>")


def sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, items array<bigint>: the full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            items = pa.array([shingles(text, n) for text in _texts(batch.column(1))], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), items], names=["doc_id", "items"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(released(run), "doc_id bigint, items array<bigint>")


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on the full sets."""
    left, right = full.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), full.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    return (
        pairs.join(left, "a").join(right, "b")
        .withColumn("both", both)
        .where(100 * F.col("both") >= percent * (F.size("x") + F.size("y") - F.col("both")))
        .select("a", "b")
    )


_SKETCH = [f"s{i}" for i in range(CELLS // 64)]
#: What bucket members carry: id, set size, component and the sketch's words.
_MEMBER = ["doc_id", "n_shingles", "component", *_SKETCH]


def _hopeful(percent: int):
    """Set sizes and sketches that allow the similarity at all."""
    apart = sum((F.bit_count(F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}"))) for s in _SKETCH), F.lit(0))
    sizes = 100 * F.least("x.n_shingles", "y.n_shingles") >= percent * F.greatest("x.n_shingles", "y.n_shingles")
    # At the threshold the sets differ in (100 - percent) / (100 + percent) of both sizes.
    parities = (100 + percent) * apart <= (100 - percent) * (F.col("x.n_shingles") + F.col("y.n_shingles"))
    return (F.col("x.component") != F.col("y.component")) & sizes & parities


def _pair(found: DataFrame) -> DataFrame:
    return found.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def _members(signed: DataFrame, reps: DataFrame) -> DataFrame:
    """The representatives that share a bucket: doc_id, n_shingles, sketch, buckets shared (array)."""
    chosen = signed.join(reps, "doc_id", "left_semi")
    dealt = chosen.select("doc_id", F.explode("bands").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("bucket")
    buckets = dealt.join(shared, "bucket", "left_semi").groupBy("doc_id").agg(F.collect_list("bucket").alias("buckets"))
    return chosen.select("doc_id", "n_shingles", *[F.col("sketch")[i].alias(s) for i, s in enumerate(_SKETCH)]).join(buckets, "doc_id")


def _pivot_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Each member of a bucket with a few pivots; minima, so no hot bucket."""
    rows = members.select("doc_id", "n_shingles", F.col("doc_id").alias("component"), *_SKETCH, F.explode("buckets").alias("bucket"))
    one = lambda k: F.min(F.struct(F.xxhash64("doc_id", F.lit(k)).alias("h"), *_MEMBER))
    pivots = rows.groupBy("bucket").agg(F.array(*[one(k) for k in range(PIVOTS)]).alias("pivots"))
    pivots = pivots.select("bucket", F.explode(F.array_distinct(F.transform("pivots", lambda p: F.struct(*[p[c].alias(c) for c in _MEMBER])))).alias("y"))
    pivots = pivots.select("bucket", "y.*")
    return _pair(rows.alias("x").join(pivots.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & _hopeful(percent)))


def _open(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members with their component and their buckets (array) that hold more than one component."""
    now = members.join(groups.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    now = now.withColumn("component", F.coalesce("component", "doc_id"))
    rows = now.select("doc_id", "component", F.explode("buckets").alias("bucket"))
    mixed = rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    left = rows.join(mixed, "bucket", "left_semi").groupBy("doc_id").agg(F.collect_list("bucket").alias("buckets"))
    return now.drop("buckets").join(left, "doc_id")


def _cross_pairs(left: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket in different components that sizes and sketches allow."""
    rows = written(left.select(*_MEMBER, F.explode("buckets").alias("bucket")), "open")
    return _pair(rows.alias("x").join(rows.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.doc_id") < F.col("y.doc_id")) & _hopeful(percent)))


def _links(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The confirmed pairs. Only the sets of documents in pairs are made, from their whole texts."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    full = written(sets(docs.join(wanted, "doc_id", "left_semi"), n), "sets")
    links = written(_confirmed(pairs, full, percent), "confirmed")
    drop_written(full)
    return links


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of percent/100 or more.

    Takes doc_id and text; returns doc_id, n_shingles, component_id (the least doc_id that links
    reach, itself included) and kept (doc_id = component_id).
    """
    found = by_version(docs, lambda own: _groups(own, n, percent), back=("component_id",))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _groups(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id for unique doc_ids."""
    signed = written(signatures(docs, n), "signatures")
    # Equal sets first: one document of each stands for all.
    stands = written(signed.where("same IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("rep")), "alike")
    members = written(_members(signed, stands.select(F.col("rep").alias("doc_id"))), "members")
    tested = written(_pivot_pairs(members, percent), "pairs")
    links = _links(docs, tested, n, percent)
    groups = components(links)
    left = written(_open(members, groups), "left")
    if not left.isEmpty():
        pairs = written(_cross_pairs(left, percent).join(tested, ["a", "b"], "left_anti"), "pairs")
        more = _links(docs, pairs, n, percent)
        if not more.isEmpty():
            groups = components(links.union(more))

    by_rep = stands.join(groups, stands["rep"] == groups["node"], "left").select("same", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "same").join(by_rep, "same", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
