"""Removal of repeated passages by a hash-compared suffix sort.

A byte goes if a 100-byte string that covers it also starts earlier (smaller doc_id, or the same
document and an earlier start). No window is ever compared with all others:

1. Each 100-byte window is filed under the smallest hash of the 40-byte strings in it, which any
   equal window shares. Neighbouring windows under one hash make a run; about one run starts every
   32 bytes. One shuffle brings the runs of a hash together.
2. Of runs with equal bytes under one hash, all but the earliest go whole. Hash and content are two
   unrelated 64-bit hashes, 128 bits together.
3. The earliest run of each content is sorted with those of other contents under the same hash:
   suffixes are compared through prefix polynomial hashes (binary search for the common
   extension), merge sort is stable, and neighbours that agree for 100 bytes are repeats, verified
   byte by byte.

A hash may be found in a third of all texts (a common passage in different surroundings). Such hot
hashes are found in a sample of the texts. Their runs are cut where the windows' distance from the
hashed string passes a multiple of CORE and filed under the bytes that all windows of such a piece
share. At the borders of a common passage, windows then part from each other where their
surroundings differ, and only the one piece that holds both kinds of windows meets others. Hot
keys are dealt out by place first; the earliest of each share are dealt out by content, and what
is first under that share is compared once more by an aggregation. The sample decides how rows are
dealt, never the result.

Cases: null and empty texts, and texts under 100 bytes, lose nothing. Copies of a whole text of
at least 100 bytes lose everything but the first. Self-overlapping repeats (``aaaa``) count. Rows
with equal doc_id and text are one document, returned as often as they come; texts that share a
doc_id, or have none (null: last), follow each other by digest. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_version, drop_written, released, written
from .words import slices

WINDOW, GRAM = 100, 40
SPAN = WINDOW - GRAM + 1
#: Windows in a run at most; windows in a piece of a hot run; bytes hashed at a time; runs sorted at
#: a time, and under one share.
RUN, CORE = 64, 4
CHUNK = 1 << 18
SORTED, SHARE = 12_000, 4_000
#: Bytes of compressed texts whose runs or ranges a task opens at a time.
PACKED = 500_000
#: Least number of texts in the sample that hot hashes are found in, and a hot hash's least number
#: of runs in it. The sample grows so that a hash with GROUP runs in all texts is hot; of hot hashes
#: the HOTTEST most frequent ones are told to the tasks, 16 bytes each.
SAMPLE, HOT, GROUP, HOTTEST = 20_000, 200, 200_000, 1 << 16

_BYTES = np.random.RandomState(7).randint(0, 2**63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte strings, put together from those of doubling lengths."""
    base, step, h = 0x5851F42D4C957F2D, 1, _BYTES[data]
    whole, done = np.zeros(len(data) + 1, np.uint64), 0
    while True:
        if GRAM & step:
            n = len(data) - done - step + 1
            whole, done = whole[:n] * np.uint64(base) + h[done : done + n], done + step
        if done == GRAM:
            break
        h = h[:-step] * np.uint64(base) + h[step:]
        base, step = base * base % 2**64, step * 2
    whole ^= whole >> np.uint64(29)
    whole *= np.uint64(0x9E3779B97F4A7C15)
    return whole ^ (whole >> np.uint64(32))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    step, low = 1, values
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    return np.minimum(low[: len(values) - width + 1], low[width - step :][: len(values) - width + 1])


def _runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs of the texts at [start, end) of data: text number, start, windows, key, offset, twice, hot.

    offset: of the hashed string in the run's first window; twice: the string occurs in the run
    again; hot: the number of the key's hash in the sorted array hot, or -1.
    """
    long = ends - starts >= WINDOW
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - WINDOW + 1, -1)
    at = np.flatnonzero(np.cumsum(edge[:-1]))
    if not len(at):
        return (np.empty(0, np.int64),) * 7
    hashes = gram_hashes(data)
    low = _sliding_min(hashes, SPAN)[at]
    cut = np.concatenate([[True], (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(cut)
    within = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(within % RUN == 0)
    n = np.diff(np.append(first, len(at)))
    lo, windows = at[first], np.lib.stride_tricks.sliding_window_view(hashes, SPAN)
    left = windows[lo].argmin(axis=1)
    right = n - 1 + SPAN - 1 - windows[lo + n - 1][:, ::-1].argmin(axis=1)
    key, twice = low[first].view(np.int64), (left != right).astype(np.int64)
    number = np.full(len(lo), -1)
    if len(hot):
        found = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        number[hot[found] == key] = found[hot[found] == key]
    warm = np.flatnonzero(number >= 0)
    if len(warm):
        cool = number < 0
        pieces = _pieces(data, windows, lo[warm], n[warm], left[warm], twice[warm] > 0)
        of = warm[pieces[0]]
        lo, n, key, left = (np.concatenate([x[cool], y]) for x, y in zip((lo, n, key, left), pieces[1:]))
        twice, number = np.concatenate([twice[cool], np.zeros(len(of), np.int64)]), np.concatenate([number[cool], number[of]])
    return np.searchsorted(starts, lo, "right") - 1, lo, n, key, left, twice, number


def _pieces(data: np.ndarray, windows: np.ndarray, lo: np.ndarray, n: np.ndarray, off: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hot runs cut into pieces of at most CORE windows: run number, start, windows, key, offset.

    The windows of a piece have the hashed string at distances of one multiple of CORE, so they all
    hold the WINDOW - CORE + 1 bytes that the key is a hash of, and equal windows have equal keys.
    """
    import xxhash

    run = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    start, depth = lo[run] + i, off[run] - i
    for part in np.array_split(again := np.flatnonzero(twice[run]), len(again) // 4096 + 1):
        depth[part] = windows[start[part]].argmin(axis=1)
    gram, bucket = start + depth, depth // CORE
    cut = np.concatenate([[True], (np.diff(run) != 0) | (np.diff(gram) != 0) | (np.diff(bucket) != 0)])
    first = np.flatnonzero(cut)
    core, view = gram[first] - CORE * bucket[first], memoryview(data)
    keys = [xxhash.xxh64_intdigest(view[a : a + WINDOW - CORE + 1], b) for a, b in zip(core.tolist(), bucket[first].tolist())]
    return run[first], start[first], np.diff(np.append(first, len(run))), np.array(keys, np.uint64).view(np.int64), depth[first]


def _batch_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts (null: empty), and where each begins."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def _chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    start, n = 0, len(offsets) - 1
    while start < n:
        end = min(n, max(start + 1, int(np.searchsorted(offsets, offsets[start] + CHUNK, "right")) - 1))
        yield start, end
        start = end


def runs(docs: DataFrame, hot: np.ndarray | None = None, salts: np.ndarray | None = None) -> DataFrame:
    """All runs: h, salts (over 1: hot), content (hash of the bytes), doc_id, place (start * 2^15 + windows * 2^8 + offset * 2 + twice)."""
    known = np.empty(0, np.int64) if hot is None else hot
    shares = np.ones(1, np.int64) if salts is None or not len(salts) else salts
    told = docs.sparkSession.sparkContext.broadcast((known, shares))  # HOTTEST rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known, shares = told.value
        for batch in batches:
            data, offsets = _batch_bytes(batch.column(1))
            ids = np.asarray(batch.column(0))
            for a, b in _chunks(offsets):
                base = offsets[a]
                part = data[base : offsets[b]]
                text, lo, n, h, off, twice, number = _runs(part, offsets[a:b] - base, offsets[a + 1 : b + 1] - base, known)
                if len(text):
                    view = memoryview(part)
                    content = [xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip(lo.tolist(), (lo + n + WINDOW - 1).tolist())]
                    place = (lo - (offsets[a:b] - base)[text]) << 15 | n << 8 | off << 1 | twice
                    columns = [h, np.where(number < 0, 1, shares[number]), np.array(content, np.uint64).view(np.int64), ids[a:b][text], place.astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "salts", "content", "doc_id", "place"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), "h bigint, salts bigint, content bigint, doc_id bigint, place bigint")


def _hot(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of very many runs, sorted, and how many shares each is dealt to; HOTTEST at most."""
    total = docs.count()
    part = min(1.0, max(SAMPLE / max(total, 1), HOT / GROUP))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)
    counted = runs(chosen).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n"), "h").limit(HOTTEST)
    rows = counted.select("h", F.ceil(F.col("n") / part / SHARE + 1).alias("salts")).toArrow().sort_by("h")
    column = lambda name: np.array(rows[name].to_pylist(), np.int64)
    return column("h"), column("salts")


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed for the one shuffle that brings them to their runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, 1):
            texts = pa.array([pack(x.as_py() or b"") for x in batch.column(1).cast(pa.large_binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "packed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), "doc_id bigint, packed binary")


def _unpack(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def _with_bytes(held: DataFrame) -> DataFrame:
    """For each wanted run of a text: group, salts, doc_id, place, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, PACKED):  # lists of Python's own are many times as large
            for doc, packed, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                text = _unpack(packed)
                rows = [(w["group"], w["salts"], doc, w["place"], text[w["place"] >> 15 :][: (w["place"] >> 8 & 127) + WINDOW - 1]) for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["group", "salts", "doc_id", "place", "bytes"])

    return held.select("doc_id", "packed", "wanted").mapInArrow(released(run), "group bigint, salts bigint, doc_id bigint, place bigint, bytes binary")


class Suffixes:
    """Suffixes of a byte string, compared over WINDOW bytes through prefix polynomial hashes."""

    def __init__(self, data: np.ndarray, base: int = 0xD1342543DE82EF95):
        self.data = data
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(base, -1, 2**64))
            power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), np.uint64(base))]))
            self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), inverse)]))
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[data] * power[:-1])])

    def _hash(self, at: np.ndarray, n: int) -> np.ndarray:
        return (self.sums[at + n] - self.sums[at]) * self.back[at]

    def whole(self, at: np.ndarray) -> np.ndarray:
        """Hashes of WINDOW bytes."""
        return self._hash(at, WINDOW)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension, WINDOW at most: a binary search over hashes."""
        n = np.zeros(len(a), np.int64)
        step = 1 << (WINDOW.bit_length() - 1)
        while step:
            can = np.flatnonzero(n + step <= WINDOW)
            same = can[self._hash(a[can] + n[can], step) == self._hash(b[can] + n[can], step)]
            n[same] += step
            step //= 2
        return n

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(a, b)
        full = n == WINDOW
        last = np.where(full, 0, n)
        return np.where(full, or_equal, self.data[a + last] < self.data[b + last])

    def sort(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Stable merge sort of consecutive groups of suffixes (sizes); gives the order."""
        order = np.arange(len(starts))
        head = np.repeat(np.cumsum(sizes) - sizes, sizes)
        size, rank = np.repeat(sizes, sizes), np.arange(len(starts)) - head
        width = 1
        while width < size.max(initial=0):
            # Every item finds its place in the neighbouring run by binary search.
            run, inside = rank // width, rank % width
            right = run % 2 == 1
            other = np.where(right, run - 1, run + 1) * width
            length = np.clip(size - other, 0, width)
            low, high = np.zeros(len(order), np.int64), length.copy()
            while len(open_ := np.flatnonzero(low < high)):
                mid = (low[open_] + high[open_]) // 2
                there = starts[order[head[open_] + other[open_] + mid]]
                # Items of the left run go before equal ones of the right run.
                less = self.before(there, starts[order[open_]], right[open_])
                low[open_[less]] = mid[less] + 1
                high[open_[~less]] = mid[~less]
            place = head + run // 2 * 2 * width + inside + low
            fresh = np.empty_like(order)
            fresh[place] = order
            order, width = fresh, width * 2
        return order


def repeats(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each suffix: whether an earlier one of its group agrees with it over WINDOW bytes.

    Suffixes whose hash of WINDOW bytes is alone in its group agree with none and are not sorted.
    """
    for base in (0xD1342543DE82EF95, 0xF1357AEA2E62A9C5, 0xAAAAAAAAAAAAAAAB):
        suffixes = Suffixes(data, base)
        group = np.repeat(np.arange(len(sizes)), sizes)
        key = suffixes.whole(starts) ^ (group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ranked = np.argsort(key)
        same = key[ranked[1:]] == key[ranked[:-1]]
        held = np.zeros(len(starts), bool)
        held[ranked[1:][same]] = held[ranked[:-1][same]] = True
        some, group = np.flatnonzero(held), group[held]
        at = starts[some]
        order = suffixes.sort(at, np.unique(group, return_counts=True)[1])
        near = np.flatnonzero(group[1:] == group[:-1])
        near = near[suffixes.common(at[order[near]], at[order[near + 1]]) == WINDOW]
        view = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
        if all((view[at[order[x]]] == view[at[order[x + 1]]]).all() for x in np.array_split(near, len(near) // 10_000 + 1)):
            again = np.zeros(len(starts), bool)
            again[some[order[near + 1]]] = True
            return again
    raise ArithmeticError("three hash bases collide")


def _sorted_groups(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Windows of runs (in order of h, salt, doc_id, place): their run, number in it, repeated or not, digest."""
    place = np.asarray(rows["place"].combine_chunks())
    data, offsets = _batch_bytes(rows["bytes"].combine_chunks())
    n, off, twice = place >> 8 & 127, place >> 1 & 127, place & 1
    run = np.repeat(np.arange(len(n)), n)
    i = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    depth = off[run] - i
    for k in np.flatnonzero(twice):  # the hashed string's leftmost place changes within such a run
        grams = gram_hashes(data[offsets[k] : offsets[k + 1]])
        depth[run == k] = np.lib.stride_tricks.sliding_window_view(grams, SPAN).argmin(axis=1)
    key = np.asarray(rows["group"].combine_chunks())
    fresh = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    group = fresh[run] * 128 + depth
    by_group = np.argsort(group, kind="stable")
    sizes = np.unique(group, return_counts=True)[1]
    starts = (offsets[:-1][run] + i)[by_group]
    again = np.empty(len(run), bool)
    again[by_group] = repeats(data, starts, sizes)
    return run, i, again, offsets[:-1][run] + i, data


def _resolved(runs_with_bytes: DataFrame) -> DataFrame:
    """Removed ranges (doc_id, start, end; key null), and of salted groups the windows left (key, start)."""

    def emit(table: pa.Table) -> pa.RecordBatch:
        import xxhash

        run, i, again, at, data = _sorted_groups(table)
        doc, lo = np.asarray(table["doc_id"].combine_chunks()), np.asarray(table["place"].combine_chunks()) >> 15
        pos = lo[run] + i
        gone = np.flatnonzero(again)
        head = np.concatenate([[True], (np.diff(gone) != 1) | (run[gone[1:]] != run[gone[:-1]])])[: len(gone)]
        tail = np.append(head[1:], True)[: len(gone)]
        left = np.flatnonzero(~again & (np.asarray(table["salts"].combine_chunks()) > 1)[run])
        keys = [xxhash.xxh3_128_digest(data[k : k + WINDOW].tobytes()) for k in at[left]]
        starts = np.concatenate([pos[gone[head]], pos[left]])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([doc[run[gone[head]]], doc[run[left]]])), pa.array(starts), pa.array(np.concatenate([pos[gone[tail]], pos[left]]) + WINDOW), pa.array([None] * int(head.sum()) + keys, pa.binary())],
            names=["doc_id", "start", "end", "key"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < SORTED:
                continue
            table = pa.Table.from_batches(held)
            key = np.asarray(table["group"].combine_chunks())
            last = int(np.flatnonzero(key != key[-1]).max(initial=-1)) + 1  # the last group may go on
            if last:
                yield emit(table.slice(0, last))
            held = table.slice(last).to_batches()
        if held:
            yield emit(pa.Table.from_batches(held))

    dealt = runs_with_bytes.repartition("group").sortWithinPartitions("group", "doc_id", "place")
    return dealt.select("group", "salts", "doc_id", "place", "bytes").mapInArrow(released(run), "doc_id bigint, start bigint, end bigint, key binary")


def _cut(held: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<start,end>>, kept binary, kept_text, of texts with their removed ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, PACKED):
            spans, kept = [], []
            for packed, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text, out, at, own = _unpack(packed), [], 0, []
                for start, end in sorted((r["start"], r["end"]) for r in ranges):
                    if own and start <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], end)
                    else:
                        own.append([start, end])
                for start, end in own:
                    out.append(text[at:start])
                    at = end
                spans.append([{"start": a, "end": b} for a, b in own])
                kept.append(b"".join([*out, text[at:]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()), pa.array([k.decode("utf-8", "ignore") for k in kept])],
                names=["doc_id", "spans", "kept", "kept_text"],
            )

    return held.select("doc_id", "packed", "ranges").mapInArrow(released(run), "doc_id bigint, spans array<struct<start:bigint,end:bigint>>, kept binary, kept_text string")


def _decided(dealt: DataFrame) -> DataFrame:
    """Of rows dealt out by share: whether an earlier one has the same content, and the number of contents."""
    place = F.struct("doc_id", "place")
    late = dealt.withColumn("late", place != F.min(place).over(Window.partitionBy("share", "content")))
    return late.withColumn("contents", F.sum(F.when(F.col("late"), 0).otherwise(1)).over(Window.partitionBy("share")))


def _opened(docs: DataFrame) -> DataFrame:
    """The runs that go whole (share null) and those to be sorted: share, salts, doc_id, place."""
    hot = F.col("salts") > 1
    # One shuffle, by share: both windows are served by it.
    share = F.when(hot, F.xxhash64("h", F.pmod(F.xxhash64("doc_id", "place"), F.col("salts")))).otherwise(F.col("h"))
    first = _decided(runs(docs, *_hot(docs)).withColumn("share", share).repartition("share"))
    open_ = ~F.col("late") & ((F.col("contents") > 1) | (F.col("place").bitwiseAND(1) == 1) | hot)
    keep = [F.when(~F.col("late"), F.col("h")).alias("h"), F.when(~F.col("late"), F.col("content")).alias("content"), "salts", "doc_id", "place"]
    first = written(first.where(F.col("late") | open_).select(*keep), "first")

    # The earliest of each share of a hot key, dealt out by content; keys of a single run are done.
    warm = first.where(hot & F.col("h").isNotNull())
    several = warm.groupBy("h").agg(F.count("*").alias("n"), F.min("content").alias("least"), F.max("content").alias("most")).where("n > 1")
    warm = warm.join(several.select("h", (F.col("least") != F.col("most")).alias("mixed")), "h")
    warm = _decided(warm.withColumn("share", F.xxhash64("h", F.pmod("content", F.col("salts")))).repartition("share"))
    warm = warm.where(F.col("late") | F.col("mixed")).select(F.when(~F.col("late"), F.col("share")).alias("share"), "salts", "doc_id", "place")
    return first.where(~hot | F.col("h").isNull()).select(F.col("h").alias("share"), "salts", "doc_id", "place").union(warm)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Of each text that loses bytes: doc_id, spans (maximal removed runs of bytes), kept (binary), kept_text.

    kept_text leaves out the rests of characters that a span begins or ends in.

    Takes doc_id (unique, see :func:`by_version`) and text. Documents that lose nothing have no row.
    """
    opened = written(_opened(docs), "opened")
    # Runs whose bytes stand earlier go whole.
    start = F.shiftright("place", 15)
    whole = opened.where("share IS NULL").select("doc_id", start.alias("start"), (start + F.shiftright("place", 8).bitwiseAND(127) + (WINDOW - 1)).alias("end"))
    wanted = opened.where("share IS NOT NULL").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("share").alias("group"), "salts", "place")).alias("wanted"))
    resolved = written(_resolved(_with_bytes(_packed(docs).join(wanted, "doc_id"))), "resolved")
    left = resolved.where("key IS NOT NULL")
    earliest = left.groupBy("key").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    late = left.join(earliest, "key").where(F.struct("doc_id", "start") != F.col("first"))
    columns = ["doc_id", "start", "end"]
    ranges = whole.select(columns).union(resolved.where("key IS NULL").select(columns)).union(late.select(columns))
    by_doc = written(ranges.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("ranges")), "ranges")
    drop_written(opened)
    drop_written(resolved)
    return _cut(_packed(docs).join(by_doc, "doc_id"))


def digests(docs: DataFrame) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and the SHA-256 of the remaining bytes."""
    return by_version(docs, _digests)


def _digests(docs: DataFrame) -> DataFrame:
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    whole = docs.select(F.col("doc_id").cast("long"), F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("sha256"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    cut = repeated_passages(docs).select("doc_id", removed.alias("removed"), F.size("spans").cast("long").alias("pieces"), F.sha2("kept", 256).alias("rest"))
    return whole.join(cut, "doc_id", "left").select(
        "doc_id", "n_bytes", F.coalesce("removed", F.lit(0)).alias("n_removed"), F.coalesce("pieces", F.lit(0)).alias("n_spans"), F.coalesce("rest", "sha256").alias("kept_sha256")
    )
