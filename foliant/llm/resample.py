"""Importance resampling towards a target's distribution of words and pairs of words.

Every run of one or two words is a feature, and falls into a bucket by its CRC-32. A bucket's gain
is the logarithm of its smoothed share in the target over that in the source; a document's weight is
the mean gain of its features, and Gumbel noise from a digest of its id turns weights into a draw
without replacement: the documents with the greatest sums.

Features are found once: a document's buckets are one array of two-byte numbers in a written table,
which the counts and then the weights are taken from. The gains (BUCKETS numbers) are all that goes
to every task. The last drawn key is found by a radix selection on the bits of score and id in which
rows differ: each round counts a digit's values among the rows that agree with the digits found so
far. Only rows up to that key are sorted, by ranges, and ranked.

Cases: null and empty texts have no features and weigh 0. A null id draws by the digest of no
number and comes after all others at a tie. Rows of one id are documents each; of rows with equal
score and id at the end of the draw, as many are drawn as there are places. An empty source gives no
rows; with an empty target all shares are smoothed ones.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, written
from .words import LETTERS, LOWER, slices, words_of

BUCKETS = 10_000
#: Share of the documents with LEAST words or more that is drawn, in per cent.
PERCENT, LEAST = 25, 20
SEED = 7
#: Bits of a digit of the selection.
DIGIT = 12
#: Words up to so many bytes are appended to a checksum by table.
TABLED = 48


def _shift_tables() -> np.ndarray:
    """What each byte of a checksum becomes after n further bytes of zero, by n, place and byte."""
    table = np.empty((TABLED + 2, 4, 256), np.uint32)
    for n in range(TABLED + 2):
        zeros = bytes(n)
        for place in range(4):
            table[n, place] = [zlib.crc32(zeros, byte << 8 * place) ^ zlib.crc32(zeros) for byte in range(256)]
    return table


_tables: list[np.ndarray] = []


def buckets_of(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and features of each text, and the buckets of all features, text by text."""
    if not _tables:
        _tables.append(_shift_tables())
    words = words_of(texts, LETTERS, LOWER)
    spelled = words.distinct.to_pylist()
    alone = np.array([zlib.crc32(w) for w in spelled], np.uint32)
    after = np.array([zlib.crc32(b" " + w) for w in spelled], np.uint32)
    size = np.array([len(w) + 1 for w in spelled], np.int64)
    left, right = words.ids[:-1], words.ids[1:]
    base, n = alone[left], size[right] if len(words.ids) else np.empty(0, np.int64)
    # The checksum of two strings is that of the first, carried on by the second's length, and the second's.
    row = np.minimum(n, TABLED + 1) * 4
    pair, flat = after[right] if len(right) else np.empty(0, np.uint32), _tables[0].reshape(-1, 256)
    for place in range(4):
        pair = pair ^ flat[row + place, (base >> np.uint32(8 * place)) & np.uint32(255)]
    for i in np.flatnonzero(n > TABLED + 1).tolist():
        pair[i] = zlib.crc32(b" " + spelled[right[i]], int(base[i]))
    every = np.empty(2 * len(words.ids), np.uint32)
    every[0::2] = alone[words.ids] if len(words.ids) else []
    every[1:-1:2] = pair
    count = np.diff(words.first)
    keep = np.ones(len(every), bool)
    keep[2 * words.first[1:][count > 0] - 1] = False  # the last word of a text has none after it
    return count, np.maximum(2 * count - 1, 0), (every[keep] % np.uint32(buckets)).astype(np.uint16)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """id, n_words, n_features and buckets: little-endian two-byte numbers, one for each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            words, count, flat = buckets_of(batch.column(1), buckets)
            ends = np.concatenate([[0], 2 * np.cumsum(count)]).astype(np.int64)
            lists = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(ends), pa.py_buffer(flat.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.astype(np.int64)), pa.array(count.astype(np.int64)), lists], names=[id_col, "n_words", "n_features", "buckets"])

    return docs.select(id_col, F.col(text_col).cast("binary")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words bigint, n_features bigint, buckets binary")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of two-byte ones, and where each row's begin (and the last's end)."""
    from .words import bytes_of

    data, offsets = bytes_of(column)
    return np.frombuffer(np.ascontiguousarray(data), "<u2"), offsets // 2


def counted(table: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The number of features in each bucket, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0))[0], minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], names=["bucket", "n"])

    # A row for each bucket at most, whatever the corpus.
    found = table.select("buckets").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(smoothed share in the target / smoothed share in the source)) of each bucket."""
    all_source, all_target, buckets = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_source + buckets) / ((s + 1.0) * (all_target + buckets)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def scored(table: DataFrame, gain: np.ndarray, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """id, n_words, n_features, weight (floored mean gain) and score (weight and Gumbel noise), all long."""
    shared = table.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            flat, first = _flat(batch.column(3))
            total = np.concatenate([[0], np.cumsum(gain[flat])])
            size = np.diff(first)
            weight = (total[first[1:]] - total[first[:-1]]) // np.maximum(size, 1)
            noise = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight), pa.array(weight + np.array(noise, np.int64))], names=[id_col, "n_words", "n_features", "weight", "score"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return table.select(id_col, "n_words", "n_features", "buckets", h.alias("h")).select(id_col, "n_words", "n_features", "buckets", "h").mapInArrow(
        run, f"`{id_col}` {dict(table.dtypes)[id_col]}, n_words bigint, n_features bigint, weight bigint, score bigint"
    )


def kth_key(rows: DataFrame, keys: list[Column], k: int, digit: int = DIGIT) -> list[int] | None:
    """The k-th least row's long keys, by the first and then by those that follow; None if there are fewer rows.

    Rounds go through the bits in which rows differ, from the highest; each brings the counts of one
    digit's values to the driver, 2 ** digit numbers at most.
    """
    names = [f"k{i}" for i in range(len(keys))]
    # With the sign's bit turned round, keys in order are unsigned numbers in order.
    left = rows.select(*[key.cast("long").bitwiseXOR(F.lit(-(1 << 63))).alias(n) for key, n in zip(keys, names)])
    found = []
    for name in names:
        low, high = left.agg(F.min(F.col(name).bitwiseXOR(F.lit(-(1 << 63)))), F.max(F.col(name).bitwiseXOR(F.lit(-(1 << 63))))).first()
        if low is None:
            return None
        low, high = low + (1 << 63), high + (1 << 63)
        bits = (low ^ high).bit_length()
        prefix = low >> bits
        same = left
        while bits:
            step = min(digit, bits)
            bits -= step
            value = F.shiftrightunsigned(name, bits)
            counts = same.groupBy(value.bitwiseAND((1 << step) - 1).alias("digit")).agg(F.count("*").alias("n")).collect()
            for d, n in sorted((r.digit, r.n) for r in counts):
                if n >= k:
                    break
                k -= n
            else:
                return None
            prefix = prefix << step | d
            same = left.where(F.shiftrightunsigned(name, bits) == F.lit(prefix if prefix < 1 << 63 else prefix - (1 << 64)))
        found.append(prefix - (1 << 63))
        left = left.where(F.col(name) == F.lit(prefix if prefix < 1 << 63 else prefix - (1 << 64)))
    return found if left.limit(k).count() >= k else None


def drawn(rows: DataFrame, k: int, id_col: str = "doc_id", among: Column | None = None) -> DataFrame:
    """The rows with rank: 1 to k for the greatest scores among some, ties to smaller ids; else null."""
    last, absent = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), F.lit(None).cast("long")
    among = F.lit(True) if among is None else among
    key = kth_key(rows.where(among), [F.bitwise_not("score"), last], k) if k > 0 else None
    if key is None:
        return rows.withColumn("rank", absent)
    down, own = F.bitwise_not("score"), last
    inside = among & ((down < key[0]) | (down == key[0]) & (own <= key[1]))
    chosen = numbered(rows.where(inside).withColumn("down", down).withColumn("last", own), "down", "last", "weight", "n_features")
    rank = F.when(F.col("number") < k, F.col("number") + 1)
    return chosen.select(*rows.columns, rank.alias("rank")).union(rows.where(~inside).select(*rows.columns, absent.alias("rank")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least: int = LEAST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """id, n_words, n_features, weight, score and rank of every document; target: text_col.

    Of the N documents with least words or more, floor(percent * N / 100) are drawn.
    """
    table = written(features(docs, id_col, text_col, buckets), "buckets")
    wanted = features(target.select(F.lit(0).cast("long").alias("item"), text_col), "item", text_col, buckets)
    rows = written(scored(table, gains(counted(table, buckets), counted(wanted, buckets)), id_col, seed), "scored")
    long = F.col("n_words") >= least
    return drawn(rows, percent * rows.where(long).count() // 100, id_col, long)


def oracle(buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST, seed: int = SEED) -> str:
    """The same in DuckDB over the documents and benchmark views; checksums byte by byte, by table, of distinct features."""
    # What a byte does to an empty register: the checksum of one byte, less what its start and end turn round.
    table = [zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)]
    words = lambda col: f"regexp_extract_all(translate(coalesce({col}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    pairs = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""WITH own AS (SELECT doc_id, {words('text')} AS w FROM documents), goal AS (SELECT {words('text')} AS w FROM benchmark),
feature AS (SELECT doc_id, unnest({pairs}) AS f FROM own), wanted AS (SELECT unnest({pairs}) AS f FROM goal),
spelled AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM feature UNION SELECT f FROM wanted)),
bucket AS (SELECT f, xor(list_reduce(list_transform(range(0, (length(h) // 2)::BIGINT), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1]::BIGINT), 4294967295::BIGINT), 4294967295::BIGINT) % {buckets} AS b FROM spelled),
s AS (SELECT b, count(*) AS n FROM feature JOIN bucket USING (f) GROUP BY b), t AS (SELECT b, count(*) AS n FROM wanted JOIN bucket USING (f) GROUP BY b),
gain AS (SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + {buckets})::DOUBLE / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + {buckets})::DOUBLE)))::BIGINT AS g FROM s LEFT JOIN t USING (b)),
weighed AS (SELECT doc_id, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM feature JOIN bucket USING (f) JOIN gain USING (b) GROUP BY doc_id),
scored AS (SELECT o.doc_id, len(o.w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || o.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM own o LEFT JOIN weighed USING (doc_id)),
place AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE words >= {least})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {percent} * (SELECT count(*) FROM place) // 100 THEN rank END AS rank FROM scored LEFT JOIN place USING (doc_id)"""
