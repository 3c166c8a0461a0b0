"""Best-fit packing of token pieces into sequences, improved by exchanges between underfull bins.

Lengths are whole numbers up to the capacity, so all that a packing depends on is how many pieces
each length has: CAPACITY rows, however large the corpus. The search works on kinds of bins, which
are the lengths that a bin holds and the number of bins that hold the same. Best fit, longest first,
makes a new kind or two for each length. Then, while there are more bins than a lower bound, two
kinds exchange pieces in as many bins as both have: a piece moves, or is given for a shorter one, for
two shorter ones, or two for a shorter one. Each exchange makes the fuller bin fuller and raises the
sum of squared fills, which empties the other bins in the end; without any that does, the search ends.

Pieces are numbered within their length where they are read: each task counts its own, the counts of
earlier tasks are added, and nothing else is ordered. The number decides bin and place.

Cases: a null or empty text is its end token alone. Repeated and null ids are documents each. Pieces
of length 0 or beyond the capacity, or null, are an error. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .words import LETTERS, LOWER, NOT_SPACE, bytes_of, numbered_pieces, slices

CAPACITY = 1024
#: The token after each document.
END = 2
#: Exchanges at most, each of which raises the sum of squared fills.
EXCHANGES = 3_000
#: Stretches of text that a worker remembers.
CACHE = 400_000
#: Bytes of text that a task encodes together.
SLICE = 2_000_000


class Kind(NamedTuple):
    """Bins with equal contents: (length, how often) from long to short, their sum, the number of bins."""

    items: tuple[tuple[int, int], ...]
    fill: int
    bins: int


def _kind(items: dict[int, int], bins: int) -> Kind:
    own = tuple(sorted(((size, n) for size, n in items.items() if n), reverse=True))
    return Kind(own, sum(size * n for size, n in own), bins)


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Bins that no packing can do without: by sum, and by pieces that do not fit together.

    Beside pieces above capacity - least no piece of least or more fits; what is left of the bins of
    the others above half the capacity takes pieces of least or more up to its size only.
    """
    n, size = np.zeros(capacity + 2, np.int64), np.arange(capacity + 2)
    for length, count in counts.items():
        n[length] += count
    total, number = np.concatenate([[0], np.cumsum(n * size)]), np.concatenate([[0], np.cumsum(n)])
    half = capacity // 2
    best = -(-int(total[-1]) // capacity)
    for least in range(1, half + 1):
        above = int(number[capacity + 1] - number[half + 1])
        room = int((number[capacity - least + 1] - number[half + 1]) * capacity - (total[capacity - least + 1] - total[half + 1]))
        best = max(best, above + max(0, -(-(int(total[half + 1] - total[least]) - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Kind]:
    """Every piece, longest first, into the fullest bin that has room for it."""
    room: dict[int, list[tuple[dict[int, int], int]]] = {}

    def put(items: dict[int, int], left: int, bins: int) -> None:
        room.setdefault(left, []).append((items, bins))

    for size in sorted(counts, reverse=True):
        rest = counts[size]
        while rest:
            left = min((r for r in room if r >= size), default=0)
            items, bins = room[left].pop() if left else ({}, rest)
            if left and not room[left]:
                del room[left]
            # The bin stays the fullest with room while it takes pieces of this length.
            each = min((left or capacity) // size, rest)
            used = min(bins, rest // each)
            put(items | {size: each}, (left or capacity) - each * size, used)
            if left and bins > used:
                put(items, left, bins - used)
            rest -= each * used
    return [_kind(items, bins) for own in room.values() for items, bins in own]


@lru_cache(maxsize=20_000)
def _gifts(items: tuple[tuple[int, int], ...]) -> tuple[list, list, list]:
    """Single pieces of a kind's lengths, nothing or one or two of them, and its pairs: each as (sum, lengths), in order."""
    one = [(a, (a,)) for a, _ in items]
    two = [(a + b, (a, b)) for i, (a, n) in enumerate(items) for b, _ in items[i + (n < 2) :]]
    return sorted(one), sorted([(0, ()), *one, *two]), sorted(two)


def _exchange(giver: Kind, taker: Kind, capacity: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
    """What the taker gains most from the giver: the sum it grows by, what it gets, what it gives back."""
    gap, best = capacity - taker.fill, (0, (), ())
    single, back, _ = _gifts(taker.items)
    gifts, _, pairs = _gifts(giver.items)
    # One piece for none, one or two; two for one. The least that is given back leaves the most.
    for from_, to in ((gifts, back), (pairs, single)):
        for got, pieces in from_:
            at = bisect_left(to, (got - gap,))
            # Fills a and b become a + grown and b - grown: the sum of squares rises if a - b + grown > 0.
            if at < len(to) and (grown := got - to[at][0]) > best[0] and taker.fill - giver.fill + grown > 0:
                best = (grown, pieces, to[at][1])
    return best if best[0] else None


def _changed(kind: Kind, less: tuple[int, ...], more: tuple[int, ...], bins: int) -> Kind:
    items = dict(kind.items)
    for size in less:
        items[size] -= 1
    for size in more:
        items[size] = items.get(size, 0) + 1
    return _kind(items, bins)


def improved(kinds: list[Kind], capacity: int = CAPACITY, enough: int = 0, exchanges: int = EXCHANGES) -> list[Kind]:
    """Exchange pieces between underfull bins until none raises the sum of squared fills, or bins are enough.

    The emptiest bins give first. Every exchange is done in as many bins of both kinds as there are.
    """
    held: dict[tuple[tuple[int, int], ...], Kind] = {}

    def add(kind: Kind) -> None:
        if kind.items and kind.bins:
            held[kind.items] = kind._replace(bins=kind.bins + (held[kind.items].bins if kind.items in held else 0))

    for kind in kinds:
        add(kind)
    number = sum(k.bins for k in held.values())
    done: set[tuple] = set()  # pairs of contents that have nothing to exchange
    while number > enough and exchanges:
        open_ = sorted((k for k in held.values() if k.fill < capacity), key=lambda k: (k.fill, k.items))
        found = None
        for giver in open_:
            for taker in reversed(open_):
                if (giver.items, taker.items) in done or giver is taker and giver.bins < 2:
                    continue
                move = _exchange(giver, taker, capacity)
                if move is None:
                    done.add((giver.items, taker.items))
                elif found is None or move[0] > found[2][0]:
                    found = giver, taker, move
                    if move[0] == capacity - taker.fill:
                        break
            if found:
                break
        if found is None:
            break
        giver, taker, (_, got, back) = found
        bins = giver.bins // 2 if giver is taker else min(giver.bins, taker.bins)
        for kind in {giver.items: giver, taker.items: taker}.values():
            del held[kind.items]
            add(kind._replace(bins=kind.bins - bins * (2 if giver is taker else 1)))
        poorer = _changed(giver, got, back, bins)
        add(poorer)
        add(_changed(taker, back, got, bins))
        number -= 0 if poorer.items else bins
        exchanges -= 1
    return sorted(held.values(), key=lambda k: (-k.fill, k.items))


def places(kinds: list[Kind]) -> list[tuple[int, int, int, int, int, int]]:
    """length, low and high (numbers within the length), each, sequence, offset.

    The piece of a number from low to high stands in sequence + (number - low) // each, at
    offset + length * ((number - low) % each).
    """
    out, taken, sequence = [], {}, 0
    for kind in kinds:
        offset = 0
        for size, each in kind.items:
            low = taken.get(size, 0)
            taken[size] = low + each * kind.bins
            out.append((size, low, taken[size], each, sequence, offset))
            offset += size * each
        sequence += kind.bins
    return out


def _numbered(pieces: DataFrame, capacity: int) -> DataFrame:
    """The pieces with part and nth: their task, and how many of their length it had before."""
    names = [*pieces.columns, "part", "nth"]
    at = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            if batch.column(at).null_count or len(batch) and not (1 <= (length := np.asarray(batch.column(at))).min() <= length.max() <= capacity):
                raise ValueError(f"a piece's length is not within 1 and {capacity}")
            if len(batch):
                order = np.argsort(length, kind="stable")
                count = np.bincount(length, minlength=capacity + 1)
                nth = np.empty(len(batch), np.int64)
                nth[order] = np.arange(len(batch)) - np.repeat(np.cumsum(count) - count, count)
                nth += seen[length]
                seen += count
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), part, np.int32)), pa.array(nth)], names=names)

    return pieces.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + ", part int, nth bigint")


def packed(pieces: DataFrame, capacity: int = CAPACITY, exchanges: int = EXCHANGES) -> DataFrame:
    """The pieces (length long, 1 to capacity; other columns stay) with sequence_id and offset.

    The columns part, nth, sequence_id and offset are the result's own and may not come with the pieces.
    """
    columns = pieces.columns
    dealt = written(_numbered(pieces.withColumn("length", F.col("length").cast("long")), capacity), "pieces")
    counts = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length: capacity at most
    found = places(improved(best_fit(total, capacity), capacity, lower_bound(total, capacity), exchanges))
    spark = pieces.sparkSession
    # Two kinds for each length and two for each exchange at most, each of which holds few lengths.
    slots = F.broadcast(spark.createDataFrame(found, "size long, low long, high long, each long, first long, at long"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    number = F.col("before") + F.col("nth")
    placed = dealt.join(before, ["length", "part"]).join(slots, (F.col("length") == F.col("size")) & (number >= F.col("low")) & (number < F.col("high")))
    step = number - F.col("low")
    return placed.select(*columns, (F.col("first") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + F.col("length") * (step % F.col("each"))).alias("offset"))


class Tokens:
    """Ids of texts through a dictionary of stretches that a tokenizer's pattern never crosses.

    A space after a character that is no white space begins a match, whatever precedes it; so a text
    can be cut there and its stretches encoded apart. Where the byte before is beyond ASCII (which
    may end a white space) the byte after has to be ASCII and none. Digits and marks after an ASCII
    letter begin a match as well; that cut is left out where the text of an added token occurs, whose
    stretches go through the tokenizer itself, all others through the same ranks and pattern.
    """

    def __init__(self, file: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        from .bpe import read_ranks

        self.tokenizer = Tokenizer.from_file(file)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=dict(read_ranks(ranks)), special_tokens={})
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def lists(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin (and the last's end)."""
        data, offsets = bytes_of(texts)
        cut = np.zeros(len(data) + 1, bool)
        marked = any(t.encode() in data.tobytes() for t in self.added)
        if len(data) > 2:
            plain = NOT_SPACE[data] & (data < 0x80)
            cut[1:-2] = (data[1:-1] == 0x20) & (plain[:-2] | (data[:-2] >= 0x80) & plain[2:])
            if not marked:
                letter = LETTERS[LOWER[data]] & (data > 0x39) & (data < 0x80)
                cut[1:-1] |= letter[:-1] & plain[1:] & ~letter[1:]
        cut[offsets] = True
        at = np.flatnonzero(cut)
        which, distinct = numbered_pieces(data, np.diff(at))
        first = np.searchsorted(at, offsets)
        which = self._numbers(distinct, self._encoded if marked else self.plain.encode_ordinary)[which]
        count = self.ends[which + 1] - self.ends[which]
        ends = np.concatenate([[0], np.cumsum(count)])
        flat = self.flat[np.arange(ends[-1]) + np.repeat(self.ends[which] - ends[:-1], count)]
        return flat, ends[first]

    def _numbers(self, distinct: pa.Array, encode: Callable[[str], list[int]]) -> np.ndarray:
        """Where the ids of the distinct stretches are kept."""
        if len(self.known) > CACHE:
            self._forget()
        keys = distinct.to_pylist()
        new = [k for k in keys if k not in self.known]
        if new:
            lists = [encode(k.decode()) for k in new]
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(lists), np.uint32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
        return np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))

    def _encoded(self, stretch: str) -> list[int]:
        if any(t in stretch for t in self.added):
            return self.tokenizer.encode(stretch, add_special_tokens=False).ids
        return self.plain.encode_ordinary(stretch)


_tokens: dict[str, Tokens] = {}


def token_pieces(docs: DataFrame, file: str, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, ids: bool = True) -> DataFrame:
    """id, piece (from 0), start, length, ids_crc32 and, if asked for, ids array<int> of every piece of a document.

    Its ids and the end token are one piece if they fit; else all pieces but the first are of the
    capacity. file is a tokenizer's; ranks and pattern are the same vocabulary as a rank file, and what
    splits texts; both files are found on every executor. Special tokens are not added.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if file not in _tokens:
            _tokens[file] = Tokens(file, ranks, pattern)
        for batch in slices(batches, 1, SLICE):
            flat, first = _tokens[file].lists(batch.column(1))
            # Each text's end token follows its last id.
            all_ids = np.insert(flat, first[1:], np.uint32(end))
            first = first + np.arange(len(first))
            size = np.diff(first)
            count = -(-size // capacity)
            doc = np.repeat(np.arange(len(batch)), count)
            piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            lead = size - (count - 1) * capacity
            start = np.where(piece > 0, lead[doc] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, lead[doc])
            raw, at = all_ids.astype("<u4"), first[doc] + start
            crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())), np.int64, len(at))
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            if ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(raw)).astype(np.int32)), pa.array(raw.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * ids
    return docs.select(id_col, F.col(text_col).cast("binary")).mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_pieces and ids of every sequence, of packed pieces with their ids."""
    held = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), F.flatten(F.transform(held, lambda x: x["ids"])).alias("ids"))
