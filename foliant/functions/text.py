"""Column functions on text: tokens, normal forms, identities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Words too frequent to carry meaning in English, German and French (fixed values).
STOPWORDS = tuple("""
    a an and are as at be been but by for from had has have he her his if in
    into is it its of on or she that the their them there these they this to
    was were which who will with would you your
    aber alle als am auch auf aus bei bin bis das dass dem den der des die dies
    ein eine einer eines er es fuer für hat haben ich ihre im ist mit nach nicht
    noch nur oder sich sie sind über und uns vom von vor war werden wie wir zu
    zum zur
    au aux avec ce ces dans de des du elle en est et il la le les leur mais ne
    nous ou par pas pour que qui sa se ses son sur un une vous
    """.split())
#: Shortest and longest token that counts.
TOKEN_LENGTHS = (2, 40)


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores, 2 to 40 characters, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    low, high = TOKEN_LENGTHS
    return F.filter(found, lambda w: F.length(w).between(low, high) & ~w.isin(*STOPWORDS))


#: Characters that extracted text may not hold: controls but tab and LF, format and private-use ones.
EXCLUDED = r"[\x00-\x08\x0B-\x1F\x7F-\x9F\u00AD\u200B-\u200F\u202A-\u202E\u2060-\u2064\uE000-\uF8FF\uFEFF]"


def normalized(text: Column) -> Column:
    """Line ends to LF; each run of excluded characters to one blank."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), EXCLUDED + "+", " ")


def private_use_share(text: Column) -> Column:
    """Share of private-use characters, 0 for an empty text."""
    n = F.length(text)
    return F.when(n > 0, F.regexp_count(text, F.lit(r"[\uE000-\uF8FF]")) / n).otherwise(0.0)


def chunk_id(document: Column, content: Column) -> Column:
    """Identity of a chunk: MD5 of document and content as a UUID; equal text in one document is one chunk."""
    h = F.md5(F.concat_ws("_", document, content).cast("binary"))
    parts = [F.substring(h, *p) for p in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *parts)


def slug(text: Column) -> Column:
    """Lower case, everything but letters, digits and underscores to single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9_]+", "-"), "^-+|-+$", "")


def quote_key(text: Column) -> Column:
    """What must agree of a quote and its source: letters (to U+024F) and digits, lower case."""
    return F.lower(F.array_join(F.regexp_extract_all(text, F.lit(r"[0-9A-Za-zÀ-ɏ]+"), F.lit(0)), ""))


def name_key(text: Column) -> Column:
    """Names for comparison: lower case, punctuation to blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def emails(text: Column) -> Column:
    """Distinct lower-case e-mail addresses of a text, in order of their first place."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0)), lambda m: F.lower(m)))


def common_characters(x: str, y: str) -> int:
    """Length of the longest common subsequence of two strings: a row of the usual table is the bits of one number."""
    masks: dict[str, int] = {}
    for i, c in enumerate(y):
        masks[c] = masks.get(c, 0) | 1 << i
    full = row = (1 << len(y)) - 1
    for c in x:
        both = row & masks.get(c, 0)
        row = ((row + both) | (row - both)) & full
    return len(y) - row.bit_count()


def common_with_each(x: str, ys: list[str]) -> np.ndarray:
    """common_characters of x and each of ys at once: they lie side by side in one number, apart by a bit that takes up carries."""
    lengths = np.array([len(y) for y in ys], dtype=np.int64)
    ends = np.cumsum(lengths + 1)
    codes = np.frombuffer("".join(y + "\0" for y in ys).encode("utf-32-le"), dtype=np.uint32).copy()
    codes[ends - 1] = 0xFFFFFFFF
    bits = lambda held: int.from_bytes(np.packbits(held, bitorder="little").tobytes(), "little")
    masks = {c: bits(codes == ord(c)) for c in set(x)}
    full = row = bits(codes != 0xFFFFFFFF)
    for c in x:
        both = row & masks[c]
        row = ((row + both) | (row ^ both)) & full
    left = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(codes) // 8), "little"), dtype=np.uint8), count=len(codes), bitorder="little")
    return lengths - np.add.reduceat(left, ends - 1 - lengths, dtype=np.int64)


@F.pandas_udf(IntegerType())
def common_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two strings; null if one is."""
    return pd.Series([None if x is None or y is None else common_characters(x, y) for x, y in zip(a, b)], dtype="Int32")


def ratio(a: Column, b: Column) -> Column:
    """Similarity of two strings, 0 to 100: twice the common subsequence over both lengths."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(200.0 * common_length(a, b) / total)
