"""Byte-level BPE: encoding and decoding by recursive DuckDB queries inside Spark tasks.

Spark splits every text into pieces with the tokenizer's pattern (JVM regex, one row per
document) and deals the documents to tasks. A task collects the distinct pieces of a slice of
its documents and hands their bytes, one row per token position, to DuckDB. A recursive query
joins neighbouring positions with the merge table and contracts each piece's minimum-rank pairs,
leftmost first, until nothing more merges. An ordered aggregation turns the final positions
into ids, and a document's ids back into bytes.

A round contracts a piece's pairs of minimum rank from the left, up to and including the first
that makes a pair of lower rank with a neighbour: contracting them singly gives the same, as
nothing of lower rank stands in the piece before that one. One rule serves pieces of all lengths.
A query goes through as many rounds as its rows leave room for; what is not done then is the start
of the next query, so memory stays bounded however many rounds a piece takes.

Cases: a null text counts as empty; an empty text has no ids and decodes to no bytes. Repeated
rows are encoded once per slice and returned as often as they come. Only the columns named are
read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released

#: Bytes of text that a task takes at a time, and pieces that a worker remembers.
SLICE_BYTES = 4_000_000
CACHE_PIECES = 500_000
#: Memory of a worker's database, and of its spill files (in the worker's own temporary folder).
MEMORY, SPILL = "350MB", "4GB"
#: Rows that the rounds of one query may make, and its least number of rounds.
ROUND_ROWS, ROUNDS = 3_000_000, 6
#: Bytes of new pieces that are encoded at a time, and tokens that are decoded at a time, one piece or text at least.
PART_BYTES, PART_TOKENS = 250_000, 300_000

#: A row is a token position: p its first byte's number, q that of the next token (gaps keep pieces
#: apart), nx the next token. Pairs of one rank can only overlap as runs of one token; every second
#: one is taken, from the left. A piece with one pair of its minimum rank needs none of that: it is
#: contracted where the rows of the piece meet it. A piece without pairs is left out of the next round.
CONTRACT = """
WITH RECURSIVE state(step, w, p, q, tok, nx) AS (
  SELECT 0, w, p, q, tok, lead(tok) OVER (PARTITION BY w ORDER BY p) FROM positions
  UNION ALL
  (WITH pair AS MATERIALIZED (
     SELECT s.*, m.rank FROM state s LEFT JOIN merges m ON m.pair = s.tok::BIGINT * 4294967296 + s.nx WHERE s.step < {rounds}),
   best AS MATERIALIZED (
     SELECT w, min(rank) AS rank FROM pair WHERE rank IS NOT NULL GROUP BY w),
   found AS MATERIALIZED (
     SELECT s.w, s.p, s.q, s.rank FROM pair s JOIN best ON s.w = best.w AND s.rank = best.rank),
   several AS MATERIALIZED (SELECT w FROM found GROUP BY w HAVING count(*) > 1),
   chained AS (
     SELECT *, row_number() OVER own AS nth, lag(q) OVER own IS DISTINCT FROM p AS head
     FROM found WHERE w IN (SELECT w FROM several) WINDOW own AS (PARTITION BY w ORDER BY p)),
   taken AS MATERIALIZED (
     SELECT w, p, q, rank FROM (SELECT *, nth - max(CASE WHEN head THEN nth END) OVER (PARTITION BY w ORDER BY p) AS k FROM chained)
     WHERE k % 2 = 0),
   before AS MATERIALIZED (
     SELECT s.p, s.q, s.tok FROM pair s JOIN taken t ON s.q = t.p),
   around AS MATERIALIZED (
     SELECT t.w, t.p, t.q, t.rank, x.q AS next_q, x.nx AS next_nx, t.alone
     FROM (SELECT *, false AS alone FROM taken UNION ALL SELECT *, true FROM found WHERE w NOT IN (SELECT w FROM several)) t JOIN pair x ON x.p = t.q),
   hit AS MATERIALIZED (
     SELECT * EXCLUDE (low) FROM (
       SELECT a.*, sum((coalesce(l.rank < a.rank, false) OR coalesce(r.rank < a.rank, false))::INTEGER)
                     OVER (PARTITION BY a.w ORDER BY a.p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low
       FROM (SELECT * FROM around WHERE NOT alone) a
       LEFT JOIN before b ON b.q = a.p
       LEFT JOIN taken t ON t.q = b.p
       LEFT JOIN merges l ON l.pair = (CASE WHEN t.p IS NULL THEN b.tok ELSE a.rank END)::BIGINT * 4294967296 + a.rank
       LEFT JOIN merges r ON r.pair = a.rank::BIGINT * 4294967296 + a.next_nx)
     WHERE coalesce(low, 0) = 0)
   SELECT a.step + 1, a.w, a.p,
          CASE WHEN a.p = h.p THEN h.next_q ELSE a.q END, CASE WHEN a.p = h.p THEN h.rank ELSE a.tok END,
          CASE WHEN a.p = h.p THEN h.next_nx WHEN a.q = h.p THEN h.rank ELSE a.nx END
   FROM pair a JOIN around h ON a.w = h.w WHERE h.alone AND a.p <> h.q
   UNION ALL
   SELECT a.step + 1, a.w, a.p, coalesce(h.next_q, a.q), coalesce(h.rank, a.tok),
          CASE WHEN n.p IS NOT NULL THEN n.rank WHEN h.p IS NOT NULL THEN h.next_nx ELSE a.nx END
   FROM (SELECT * FROM pair WHERE w IN (SELECT w FROM several)) a
   LEFT JOIN hit h ON h.p = a.p
   LEFT JOIN hit n ON n.p = coalesce(h.next_q, a.q)
   WHERE a.p NOT IN (SELECT q FROM hit)))
SELECT w, p, q, tok, step FROM state JOIN (SELECT w, max(step) AS step FROM state GROUP BY w) USING (w, step)
"""

#: A piece's ids are its positions after its last round, in order.
ASSEMBLE = """
INSERT INTO cache SELECT piece, ids FROM fresh JOIN (SELECT w, list(tok ORDER BY p) AS ids FROM ended GROUP BY w) USING (w)
"""

DECODE = """
SELECT unhex(coalesce(hex, '')) AS decoded
FROM range({lists}) r(i) LEFT JOIN (
  SELECT i, array_to_string(list(CASE WHEN hex IS NULL THEN error('unknown token id') ELSE hex END ORDER BY pos), '') AS hex
  FROM tokens LEFT JOIN vocabulary ON id = tok GROUP BY i) USING (i)
ORDER BY i
"""


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """A tiktoken rank file: base64 token, space, rank on each line."""
    with open(path, "rb") as lines:
        return [(base64.b64decode(token), int(rank)) for token, rank in (x.split() for x in lines if x.strip())]


def merge_rows(ranks: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The merge table: every split of a token into two tokens, and the rank of the whole."""
    known = dict(ranks)
    rows = [
        (known[token[:i]] << 32 | known[token[i:]], rank)
        for token, rank in ranks
        for i in range(1, len(token))
        if token[:i] in known and token[i:] in known
    ]
    return np.array([x for x, _ in rows], np.int64), np.array([x for _, x in rows], np.int32)


class Encoder:
    """One DuckDB connection with the merge table, the vocabulary and the pieces met so far."""

    def __init__(self, ranks: list[tuple[bytes, int]]):
        import duckdb

        spill = {"temp_directory": tempfile.mkdtemp(prefix="bpe-"), "max_temp_directory_size": SPILL}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, **spill})
        pair, rank = merge_rows(ranks)
        known = dict(ranks)
        self.byte_rank = np.array([known[bytes([i])] for i in range(256)], np.int32)
        self._table("merges", pa.table({"pair": pair, "rank": rank}))
        self._table("vocabulary", pa.table({"id": pa.array([r for _, r in ranks], pa.int32()), "hex": [t.hex() for t, _ in ranks]}))
        self._forget()

    def _table(self, name: str, rows: pa.Table) -> None:
        self.con.register("incoming", rows)
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def _forget(self) -> None:
        self.con.execute("CREATE OR REPLACE TABLE cache(piece BLOB, ids INTEGER[])")
        self.cached = 0

    def pieces(self, distinct: pa.Array) -> pa.ListArray:
        """The ids of each distinct piece (binary)."""
        if self.cached > CACHE_PIECES:
            self._forget()
        self.con.register("piece", pa.table({"i": np.arange(len(distinct), dtype=np.int64), "piece": distinct}))
        missing = self.con.execute(
            "SELECT i FROM piece WHERE NOT EXISTS (SELECT 1 FROM cache WHERE cache.piece = piece.piece) ORDER BY i"
        ).fetchnumpy()["i"]
        if len(missing):
            fresh = distinct.take(pa.array(missing))
            for start, end in _parts(np.asarray(pc.binary_length(fresh)), PART_BYTES):
                self._encode(fresh.slice(start, end - start))
            self.cached += len(missing)
        out = self.con.sql("SELECT c.ids FROM piece JOIN cache c USING (piece) ORDER BY i").to_arrow_table()
        self.con.unregister("piece")
        return out.column("ids").combine_chunks()

    def _encode(self, new: pa.Array) -> None:
        sizes = np.asarray(pc.binary_length(new))
        data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays([0, len(new)], new), b"")[0].as_buffer(), np.uint8)
        w = np.repeat(np.arange(len(new), dtype=np.int32), sizes)
        p = np.arange(len(w), dtype=np.int32) + w
        self.con.register("fresh", pa.table({"w": np.arange(len(new), dtype=np.int32), "piece": new}))
        open_ = pa.table({"w": w, "p": p, "q": p + 1, "tok": self.byte_rank[data]})
        self.con.execute("CREATE OR REPLACE TABLE ended(w INTEGER, p INTEGER, q INTEGER, tok INTEGER)")
        while len(open_):
            self.con.register("positions", open_)
            rounds = max(ROUNDS, ROUND_ROWS // len(open_))
            last = self.con.sql(CONTRACT.format(rounds=rounds)).to_arrow_table()
            done = pc.less(last["step"], rounds)
            self.con.register("final", last.filter(done))
            self.con.execute("INSERT INTO ended SELECT w, p, q, tok FROM final")
            open_ = last.filter(pc.invert(done)).drop_columns("step")
        self.con.execute(ASSEMBLE)
        for name in ("fresh", "positions", "final"):
            self.con.unregister(name)

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids; null lists count as empty, unknown ids fail."""
        sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
        parts = [self._decode(lists.slice(start, end - start)) for start, end in _parts(sizes, PART_TOKENS)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    def _decode(self, lists: pa.ListArray) -> pa.Array:
        flat = lists.flatten()
        number = np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
        self.con.register("tokens", pa.table({"i": number, "pos": np.arange(len(flat)), "tok": flat}))
        out = self.con.sql(DECODE.format(lists=len(lists))).to_arrow_table()
        self.con.unregister("tokens")
        return out.column("decoded").combine_chunks()


_encoders: dict[str, Encoder] = {}


def _encoder(name: str, ranks: list[tuple[bytes, int]]) -> Encoder:
    """The Python worker's encoder for a vocabulary; tasks that follow in the worker reuse it."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(ranks)
    return _encoders[name]


def _parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes come to most together, one row at least."""
    at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    start = 0
    while start < len(sizes):
        end = int(np.searchsorted(at, at[start] + most, "right")) - 1
        end = min(max(start + 1, end), len(sizes))
        yield start, end
        start = end


def _slices(words: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about SLICE_BYTES of text, one document at least."""
    offsets = np.asarray(words.offsets) - words.offsets[0].as_py()
    length = np.asarray(pc.binary_length(words.flatten()))
    at = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])[offsets]
    yield from _parts(np.diff(at), SLICE_BYTES)


def round_trip(docs: DataFrame, ranks: list[tuple[bytes, int]], pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, back: bool = True) -> DataFrame:
    """Encode every whole text and, with back, decode its ids.

    Returns id, the columns in keep, n_tokens long, ids array<int> and decoded binary.
    """
    kept = [id_col, *(keep or [])]
    name = hashlib.sha256(repr(ranks).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a fixed vocabulary, however large the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, shared.value)
        for batch in batches:
            words = _words(batch, pattern)
            for start, end in _slices(words):
                part = words.slice(start, end - start)
                offsets = np.asarray(part.offsets)
                flat = part.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.binary()).dictionary_encode()
                ids = encoder.pieces(flat.dictionary).take(flat.indices)
                first = np.asarray(ids.offsets)
                lists = pa.ListArray.from_arrays(pa.array(first[offsets - offsets[0]] - first[0], pa.int32()), ids.flatten())
                out = [lists, encoder.decode(lists)] if back else [lists]
                yield pa.RecordBatch.from_arrays([c.slice(start, end - start) for c in batch.columns[2:]] + out, names=[*kept, "ids", "decoded"][: len(kept) + len(out)])
                del part, flat, ids, lists, out
            del batch, words  # before the next is read

    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0)).alias("pieces"),
        # Characters that the JVM's Unicode tables do not know yet: those texts are split in Python.
        F.when(text.rlike(r"\p{Cn}"), text).alias("rest"),
        *[F.col(c) for c in kept],
    )
    kinds = dict(docs.dtypes)
    done = split.mapInArrow(released(run), f"{', '.join(f'`{c}` {kinds[c]}' for c in kept)}, ids array<int>" + ", decoded binary" * back)
    return done.select(*kept, F.size("ids").cast("long").alias("n_tokens"), "ids", *["decoded"] * back)


def _words(batch: pa.RecordBatch, pattern: str) -> pa.ListArray:
    """The pieces of each text, with those replaced that have to be split by newer Unicode tables."""
    words, rest = batch.column(0), batch.column(1)
    if rest.null_count == len(rest):
        return words
    import regex

    split = regex.compile(pattern)
    return pa.array([w if r is None else split.findall(r) for w, r in zip(words.to_pylist(), rest.to_pylist())], words.type)


def encode(docs: DataFrame, ranks: list[tuple[bytes, int]], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text: id, ids array<int>."""
    return round_trip(docs, ranks, pattern, id_col, text_col, back=False).select(id_col, "ids")


def decode(tokens: DataFrame, ranks: list[tuple[bytes, int]], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Bytes of every id list: id, decoded binary. Null lists count as empty; unknown ids fail."""
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)
    name = hashlib.sha256(repr(ranks).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), encoder.decode(batch.column(1))], names=[id_col, "decoded"])

    kind = dict(tokens.dtypes)[id_col]
    return tokens.select(id_col, F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")
