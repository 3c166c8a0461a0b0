"""Chroma fingerprints of audio columns, and alignment of recordings by them.

Audio (16-bit mono PCM in a binary column) becomes frames of energy by pitch class. Sixteen filters,
differences of rectangle sums taken from an integral image over a sliding run of frames, give two
bits each: one packed 32-bit integer a frame.

Recordings are aligned through keys of three integers a few frames apart: every place of a key in a
query and every place of it in a recording vote for the offset between them. Every offset with
enough votes is confirmed by the bit errors of the overlapping integers, and the one with the least
share of them stays.

Recordings with equal fingerprints form a class, and only class representatives are aligned, so
thousands of copies cost one. Consecutive places of one key are a run; two runs vote at once for
all offsets at which they overlap, by the length of the overlap. Silence tells no recording from
another: the key of three silent integers does not vote, so recordings that share nothing else are
not aligned. Other keys of many representatives are joined like any and split by the engine's skew
handling.

Cases: null and empty audio, and audio shorter than one run of frames, have an empty fingerprint
and align with nothing. An odd last byte is dropped. Silent frames have zero energy in all classes.
Rows with one id and one fingerprint are one recording, returned as often as they come; fingerprints
that share an id, or have none (null: last), are told apart by their digests. Of equal votes and
errors the longer overlap goes first, then the lesser offset, then the lesser query. Extra columns
are not read. Fingerprints are computed of whole recordings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_version, written

RATE, FRAME, HOP = 4000, 2048, 512
LOWEST, HIGHEST = 60.0, 1800.0
#: Frames that the filters of one integer span.
SPAN = 16
#: Distance in frames of the three integers of a key.
STEP = 4
#: Shared keys at one offset, overlapping frames, and share of wrong bits that an alignment may have.
VOTES, OVERLAP, ERRORS = 3, 32, 0.25
#: Cuts of a filter's value into four levels.
CUTS = (-0.25, 0.0, 0.25)


def filters() -> list[tuple[int, int, int, int, str]]:
    """Sixteen filters by rule: first pitch class, height, first frame, width, and kind of difference."""
    kinds = ("halves in time", "halves in pitch", "checkers", "middle in time")
    return [(3 * (i // 4), 6 if i % 2 else 3 + i // 4 * 3, 4 * (i % 3) // 2, SPAN - 4 * (i % 3), kinds[i % 4]) for i in range(16)]


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Energy by pitch class (frames, 12), each frame scaled to length 1."""
    n = (len(samples) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12))
    view = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    power = np.abs(np.fft.rfft(view * np.hanning(FRAME), axis=1)) ** 2
    pitch = np.fft.rfftfreq(FRAME, 1 / rate)
    heard = (pitch >= LOWEST) & (pitch <= HIGHEST)
    which = np.round(12 * np.log2(pitch[heard] / 440)).astype(int) % 12
    energy = power[:, heard] @ np.eye(12)[which]
    length = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.divide(energy, length, out=np.zeros_like(energy), where=length > 1e-6)


def packed(image: np.ndarray) -> np.ndarray:
    """One integer of 32 bits for each run of SPAN frames."""
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.int32)
    wrapped = np.concatenate([image, image], axis=1)  # pitch classes are a circle
    sums = np.zeros((len(image) + 1, 25))
    sums[1:, 1:] = wrapped.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def area(frame: int, wide: int, tone: int, high: int) -> np.ndarray:
        a, b = t + frame, t + frame + wide
        return sums[b, tone + high] - sums[a, tone + high] - sums[b, tone] + sums[a, tone]

    out = np.zeros(n, np.uint32)
    for tone, high, frame, wide, kind in filters():
        half, up = wide // 2, high // 2
        if kind == "halves in time":
            one, two = area(frame, half, tone, high), area(frame + half, half, tone, high)
        elif kind == "halves in pitch":
            one, two = area(frame, wide, tone, up), area(frame, wide, tone + up, up)
        elif kind == "checkers":
            one = area(frame, half, tone, up) + area(frame + half, half, tone + up, up)
            two = area(frame + half, half, tone, up) + area(frame, half, tone + up, up)
        else:
            one = area(frame + wide // 4, half, tone, high)
            two = area(frame, wide // 4, tone, high) + area(frame + wide // 4 + half, wide - wide // 4 - half, tone, high)
        level = np.searchsorted(CUTS, np.round(np.log1p(one) - np.log1p(two), 9), "right").astype(np.uint32)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1))  # neighbouring levels differ in one bit
    return out.view(np.int32)


#: The integer of silent frames.
SILENT = int(packed(np.zeros((SPAN, 12)))[0])


def fingerprints(media: DataFrame, id_col: str = "id", audio_col: str = "audio", rate: int = RATE) -> DataFrame:
    """id, fingerprint array<int> of every recording."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = []
            for audio in batch.column(1):
                data = audio.as_py() or b""
                prints.append(packed(chroma(np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.float64), rate)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.list_(pa.int32()))], names=["id", "fingerprint"])

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(audio_col).alias("audio")).mapInArrow(run, "id bigint, fingerprint array<int>")


def classes(prints: DataFrame) -> DataFrame:
    """id, class_id: the least id with an equal fingerprint; an empty one is a class of its own."""
    key = F.sha2(F.array_join("fingerprint", ",").cast("binary"), 256)
    keyed = prints.select("id", F.when(F.size("fingerprint") > 0, key).alias("key"))
    first = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("class_id"))
    return keyed.join(first, "key", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))


def _keys(prints: DataFrame) -> DataFrame:
    """id, key (hash of three integers), place, length: the runs of consecutive places of each key."""
    n = F.size("fingerprint") - 2 * STEP
    at = lambda i: F.xxhash64(F.get("fingerprint", i), F.get("fingerprint", i + STEP), F.get("fingerprint", i + 2 * STEP))
    silent = F.lit(SILENT)
    quiet = lambda i: (F.get("fingerprint", i) == silent) & (F.get("fingerprint", i + STEP) == silent) & (F.get("fingerprint", i + 2 * STEP) == silent)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (at(i) != at(i - 1)))
    run = lambda s, i, next_: F.struct(F.when(~quiet(s), at(s)).alias("key"), s.alias("place"), (F.coalesce(F.get(next_, i + 1), n) - s).alias("length"))
    # The starts are bound once, as each run reads the next one's.
    runs = F.when(n > 0, F.get(F.transform(F.array(starts), lambda a: F.transform(a, lambda s, i: run(s, i, a))), F.lit(0)))
    return prints.select("id", F.explode(runs).alias("k")).select("id", "k.*").where("key IS NOT NULL")


def bit_errors(a: Column, b: Column, offset: Column) -> tuple[Column, Column]:
    """Overlapping frames of a at i and b at i - offset, and their different bits."""
    first = F.greatest(offset, F.lit(0))
    frames = F.greatest(F.least(F.size(a), F.size(b) + offset) - first, F.lit(0))
    left = F.slice(a, first + 1, frames)
    right = F.slice(b, first - offset + 1, frames)
    # The built-in counts the bits of a long, so those above the integer's own are masked.
    different = lambda x, y: F.bit_count(x.bitwiseXOR(y).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    return frames, F.aggregate(F.zip_with(left, right, different), F.lit(0), lambda n, x: n + x)


def align(prints: DataFrame, is_query) -> DataFrame:
    """query_id, id, offset, frames, error: confirmed alignments of query classes with all classes.

    Frame i of the recording lies at frame i - offset of the query. Both ids stand for their class;
    a class is a query if one of its members is (a condition on id; None: the column asked).
    """
    members = written(classes(prints), "classes")
    heads = prints.join(members.where("id = class_id").select("id"), "id", "left_semi").select("id", "fingerprint")
    chosen = prints.where(F.col("asked") if is_query is None else is_query(F.col("id"))).select("id")
    asked = members.join(chosen, "id", "left_semi").select(F.col("class_id").alias("id")).distinct()
    keys = _keys(heads)
    queries = keys.join(asked, "id", "left_semi").select(F.col("id").alias("query_id"), "key", F.col("place").alias("there"), F.col("length").alias("lasting"))
    met = keys.join(queries, "key").where("id <> query_id")
    met = met.withColumn("offset", F.explode(F.sequence(F.col("place") - F.col("there") - F.col("lasting") + 1, F.col("place") + F.col("length") - 1 - F.col("there"))))
    shared = F.least(F.col("place") + F.col("length"), F.col("there") + F.col("lasting") + F.col("offset")) - F.greatest(F.col("place"), F.col("there") + F.col("offset"))
    votes = met.groupBy("query_id", "id", "offset").agg(F.sum(shared).alias("votes"))
    tried = votes.where(F.col("votes") >= VOTES).groupBy("query_id", "id").agg(F.collect_list("offset").alias("offsets"))
    found = tried.join(heads, "id").join(heads.select(F.col("id").alias("query_id"), F.col("fingerprint").alias("asked")), "query_id")
    found = found.select("query_id", "id", "fingerprint", "asked", F.explode("offsets").alias("offset"))
    frames, wrong = bit_errors(F.col("fingerprint"), F.col("asked"), F.col("offset"))
    found = found.where(frames >= OVERLAP).select("query_id", "id", "offset", frames.alias("frames"), (wrong / (32 * frames)).alias("error")).where(F.col("error") <= ERRORS)
    # Of equal errors the longest overlap, then the least offset.
    best = found.groupBy("query_id", "id").agg(F.min(F.struct("error", (-F.col("frames")).alias("less"), "offset")).alias("best"))
    return best.select("query_id", "id", "best.offset", (-F.col("best.less")).alias("frames"), "best.error")


def matches(media: DataFrame, is_query, id_col: str = "id", audio_col: str = "audio") -> DataFrame:
    """One row per recording: its fingerprint's digest and class, and its best aligned query class.

    id, n_frames, fingerprint_sha256, class_id, n_links (query classes aligned), best_query, offset,
    error (null without an alignment).
    """
    prints = written(fingerprints(media, id_col, audio_col), "fingerprints")
    asked = prints.select("id", "fingerprint", is_query(F.col("id")).alias("asked"))
    found = by_version(asked, _matched, back=("class_id", "best_query"), id_col="id", value=F.array_join("fingerprint", ","), keep=("fingerprint", "asked"))
    return found.select("id", "n_frames", "fingerprint_sha256", "class_id", "n_links", "best_query", "offset", "error")


def _matched(prints: DataFrame) -> DataFrame:
    """The same for unique ids; asked tells queries."""
    links = written(align(prints, None), "alignments")
    best = links.groupBy("id").agg(F.count("*").alias("links"), F.min(F.struct("error", "query_id", "offset")).alias("best"))
    members = classes(prints).join(best.withColumnRenamed("id", "class_id"), "class_id", "left")
    digest = prints.select("id", F.size("fingerprint").alias("n_frames"), F.sha2(F.array_join("fingerprint", ",").cast("binary"), 256).alias("fingerprint_sha256"))
    return digest.join(members, "id").select(
        "id", "n_frames", "fingerprint_sha256", "class_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.col("best.query_id").alias("best_query"), F.col("best.offset").alias("offset"), F.col("best.error").alias("error")
    )


def melody(vector: np.ndarray, rate: int = RATE, note: float = 0.25) -> bytes:
    """A test recording: each pair of components becomes a note, its pitch by the first, its strength by the second."""
    if len(vector) < 2:
        return b""
    pairs = np.nan_to_num(np.asarray(vector, np.float64)[: len(vector) // 2 * 2].reshape(-1, 2))
    scale = np.abs(pairs).max() or 1.0
    step = np.round(pairs[:, 0] / scale * 12)
    loud = 0.3 + 0.7 * np.abs(pairs[:, 1] / scale)
    t = np.arange(int(rate * note)) / rate
    tone = np.sin(2 * np.pi * 220 * 2.0 ** (step / 12)[:, None] * t) * loud[:, None]
    return (tone.reshape(-1) * 12000).astype("<i2").tobytes()


def synthetic_media(embeddings: DataFrame) -> DataFrame:
    """id, audio: a recording for every row of embeddings, as the tables hold no audio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                audio = [melody(np.array(v.as_py() or [], np.float64)) for v in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(audio, pa.binary())], names=["id", "audio"])

    return embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>")).mapInArrow(run, "id bigint, audio binary")
