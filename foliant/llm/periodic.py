"""Periodic runs of words by suffix automata with ordered sets of end positions.

A run is a stretch of consecutive words with least period q (words q apart are identical), at least
LEAST and 2 * q words long, that no neighbouring word extends. Its last q words and those q before
end the same stretch of words, and nothing ends it in between. So, in the automaton of a text, both
ends are neighbours in the ordered set of end positions of one state, whose length is exactly what
the stretches before them have in common. The sets are merged from long states to short, the smaller
into the larger; a new pair of neighbours no further apart than the state is long is a square. It
begins where its state begins, and it is the last of its run if the words that follow differ.

Every word of a run lies in a stretch of half of LEAST words that occurs twice in the run. So only
words in such stretches, whose hashes repeat within a text, go into an automaton, and what is left
is looked at again by itself: nothing else can hold a run, and an equal hash of different words
only makes an automaton larger.

Texts are worked on where they are read; nothing is shuffled. A text's automaton is in one task:
about 500 bytes for each word that such stretches cover.

Cases: null and empty texts have no runs and nothing left; a text is its words joined by one space;
repeated and null ids are rows like others, and other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import NOT_SPACE, Words, slices, words_of

#: Words of a run, at least.
LEAST = 12
#: End positions that are kept in one list of a set.
BLOCK = 2048


class Ends:
    """Ordered end positions, in lists of BLOCK at most, so that an insertion moves few of them."""

    __slots__ = ("blocks", "lasts", "size")

    def __init__(self, end: int):
        self.blocks, self.lasts, self.size = [[end]], [end], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def insert(self, end: int) -> tuple[int, int]:
        """Its neighbours before and after; far away where there is none."""
        k = min(bisect_left(self.lasts, end), len(self.blocks) - 1)
        block = self.blocks[k]
        i = bisect_left(block, end)
        before = block[i - 1] if i else self.lasts[k - 1] if k else -(1 << 60)
        after = block[i] if i < len(block) else 1 << 60
        block.insert(i, end)
        self.size += 1
        if len(block) > BLOCK:
            self.blocks[k : k + 1] = [block[: BLOCK // 2], block[BLOCK // 2 :]]
            self.lasts[k : k + 1] = [block[BLOCK // 2 - 1], block[-1]]
        elif i == len(block) - 1:
            self.lasts[k] = end
        return before, after


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length and suffix link of each state, and the prefix that it was made for (-1: none)."""
    length, link, end, step = [0], [-1], [-1], [{}]
    last = 0
    for i, word in enumerate(words):
        state = len(length)
        length.append(i + 1)
        link.append(0)
        end.append(i)
        step.append({})
        while last >= 0 and word not in step[last]:
            step[last][word] = state
            last = link[last]
        if last >= 0:
            to = step[last][word]
            if length[to] > length[last] + 1:
                length.append(length[last] + 1)
                link.append(link[to])
                end.append(-1)
                step.append(step[to].copy())
                link[to] = state + 1
                while last >= 0 and step[last].get(word) == to:
                    step[last][word] = state + 1
                    last = link[last]
                to = state + 1
            link[state] = to
        last = state
    return length, link, end


def runs_of(words: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """start, length and period of every run, in that order."""
    length, link, end = automaton(words)
    ends = [Ends(e) if e >= 0 else None for e in end]
    found: dict[tuple[int, int], int] = {}
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        up = link[state]
        n = length[up]
        if 2 * n < least:
            continue
        small, large = ends[state], ends[up]
        ends[state] = None
        if large is None:
            ends[up] = small
            continue
        if small.size > large.size:
            small, large = large, small
        for e in small:
            before, after = large.insert(e)
            for a, b in ((before, e), (e, after)):
                period = b - a
                if period > n or n + period < least or a >= n and words[a - n] == words[b - n]:
                    continue  # no square, or neighbours already in the set that was merged
                if b + 1 == len(words) or words[a + 1] != words[b + 1]:
                    key = (a - n + 1, n + period)
                    found[key] = min(period, found.get(key, period))
        ends[up] = large
    return sorted((start, size, period) for (start, size), period in found.items())


def _repeating(ids: np.ndarray, bounds: np.ndarray, least: int) -> np.ndarray:
    """The maximal stretches (start, end) within bounds, least words at least, that repeated half-size ones cover."""
    half = (least + 1) // 2
    starts, ends = bounds[bounds[:, 1] - bounds[:, 0] >= least].T
    if not len(starts):
        return np.empty((0, 2), np.int64)
    count = ends - starts - half + 1
    owner = np.repeat(np.arange(len(starts)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + starts[owner]
    key = (owner + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    wide = ids.astype(np.uint64)
    for j in range(half):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + wide[at + j]
    order = np.sort(key)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    at, owner = at[(hit := np.isin(key, again))], owner[hit]
    if not len(at):
        return np.empty((0, 2), np.int64)
    # Stretches of one owner that touch are one.
    fresh = np.concatenate([[True], (np.diff(at) > half) | (np.diff(owner) > 0)])
    heads = np.flatnonzero(fresh)
    out = np.stack([at[heads], at[np.concatenate([heads[1:] - 1, [len(at) - 1]])] + half], axis=1)
    return out[out[:, 1] - out[:, 0] >= least]


def _runs(words: Words, least: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, in the order of their starts."""
    bounds = np.stack([words.first[:-1], words.first[1:]], axis=1)
    for _ in range(3):
        bounds = _repeating(words.ids, bounds, least)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(words.first) - 1)]
    for (start, end), text in zip(bounds.tolist(), (np.searchsorted(words.first, bounds[:, 0], "right") - 1).tolist()):
        shift = start - int(words.first[text])
        out[text] += [(shift + s, size, period) for s, size, period in runs_of(words.ids[start:end].tolist(), least)]
    return out


def _collapsed(words: Words, runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    """The words of each text without those in a run after its first period, joined by one space."""
    gone = np.zeros(len(words.ids) + 1, np.int64)
    for first, own in zip(words.first.tolist(), runs):
        for start, size, period in own:
            gone[first + start + period] += 1
            gone[first + start + size] -= 1
    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    spelled = words.distinct.take(pa.array(words.ids[kept]))
    lists = pa.LargeListArray.from_arrays(pa.array(np.searchsorted(kept, words.first)), spelled)
    return pc.binary_join(lists, pa.scalar(b" ", pa.large_binary()))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """id, n_words, runs array<struct<start,length,period>> by start and period, and collapsed.

    collapsed is the text with each run cut to its first period. A run that begins within another's
    repetitions loses its words too.
    """
    kind = "array<struct<start:bigint,length:bigint,period:bigint>>"
    fields = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            words = words_of(batch.column(1), NOT_SPACE)
            runs = _runs(words, least)
            flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
            offsets = np.concatenate([[0], np.cumsum([len(own) for own in runs])]).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(fields))
            columns = [batch.column(0), pa.array(np.diff(words.first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), values), _collapsed(words, runs).cast(pa.large_string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "runs", "collapsed"])

    return docs.select(id_col, F.col(text_col).cast("binary")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words bigint, runs {kind}, collapsed string")
