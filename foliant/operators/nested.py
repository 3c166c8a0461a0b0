"""Nested JSON as a table of its nodes: edited by columns, checked by path, written in one spelling.

The parser of Spark reads a text and writes it without blanks, so every case of malformed texts is
its own. A row's document is opened within its task and nothing of it is shuffled; keys are judged
and strings changed by column expressions. Nodes of documents of any shape stand in one table,
from which documents are built again from below, the children of a depth joined into their parents.

Cases: null and malformed texts have no nodes and come back as null. Keys may hold any character;
in paths those that are not letters, digits or underscores are kept as they are. Of keys that are
repeated in an object the parser decides. ids are unique and not null. A document is held whole in
its task. The parser writes a number beyond doubles as the string "Infinity", which it then is.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from foliant.tables import settled

KINDS = ("object", "array", "string", "number", "boolean", "null")
#: Nodes of a batch that is given back, some more for the last document.
NODES = 20_000
#: What is not kept where empty values go.
EMPTY = frozenset(("null", '""', "{}", "[]"))
_STRING = re.compile(r'"([^"\\]*(?:\\.[^"\\]*)*)"(:?)')
_ESCAPED = re.compile(r'[\x00-\x1f"\\]')
_ESCAPES = {chr(i): f"\\u{i:04X}" for i in range(32)} | {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r", '"': '\\"', "\\": "\\\\"}
_NODE = "path string, parent string, pattern string, depth int, key string, pos int, kind string, text string, keys array<string>"


class _Number(str):
    """A number as it is spelled."""


def _read(text: str) -> object:
    sys.setrecursionlimit(10_000)  # the parser opens 1,000 levels
    return json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_Number)


def _quoted(text: str) -> str:
    return '"' + _ESCAPED.sub(lambda m: _ESCAPES[m[0]], text) + '"'


def _scalar(x: object) -> str:
    return "null" if x is None else "true" if x is True else "false" if x is False else str(x) if type(x) is _Number else _quoted(x)


def _spelled(x: object, gone: frozenset, empty: frozenset, fresh: Iterator | None) -> str:
    """A value with its keys in order, without those that are gone and values that count as empty; fresh strings replace the own ones in their order."""
    if type(x) is dict:
        held = [(k, j) for k, v in x.items() if (j := _spelled(v, gone, empty, fresh)) not in empty and k not in gone]
        return "{" + ",".join([_quoted(k) + ":" + j for k, j in sorted(held)]) + "}"
    if type(x) is list:
        return "[" + ",".join([j for v in x if (j := _spelled(v, gone, empty, fresh)) not in empty]) + "]"
    return _scalar(next(fresh) if fresh is not None and type(x) is str else x)


def _opened(x: object, gone: frozenset, wanted: frozenset | None, ways: frozenset, kinds: frozenset) -> Iterator[tuple]:
    """The nodes of a value as rows of _NODE: of the wanted patterns, to which ways lead, and kinds."""
    todo = [("$", None, "$", 0, None, 0, x)]
    while todo:
        path, parent, pattern, depth, key, pos, v = todo.pop()
        keys = text = None
        if type(v) is dict:
            kind, keys = "object", [k for k in v if k not in gone] if gone else list(v)
            for i, k in enumerate(v):
                below = f"{pattern}.{k}"
                if k not in gone and (wanted is None or below in ways):
                    todo.append((f"{path}.{k}", path, below, depth + 1, k, i, v[k]))
        elif type(v) is list:
            kind, below = "array", pattern + "[*]"
            if wanted is None or below in ways:
                todo += [(f"{path}[{i}]", path, below, depth + 1, None, i, y) for i, y in enumerate(v)]
        else:
            kind, text = "null" if v is None else "boolean" if type(v) is bool else "number" if type(v) is _Number else "string", _scalar(v)
        if kind in kinds and (wanted is None or pattern in wanted):
            yield path, parent, pattern, depth, key, pos, kind, text, keys


@F.pandas_udf(StructType([StructField("keys", ArrayType(StringType())), StructField("strings", ArrayType(StringType()))]))
def _words(texts: pd.Series) -> pd.DataFrame:
    """A document's distinct keys, and its strings in their order."""
    plain = lambda s: json.loads(f'"{s}"') if "\\" in s else s
    found = [None if x is None else _STRING.findall(x) for x in texts]
    return pd.DataFrame({"keys": [None if x is None else [plain(s) for s in {s for s, colon in x if colon}] for x in found], "strings": [None if x is None else [plain(s) for s, colon in x if not colon] for x in found]})


@F.pandas_udf(StringType())
def _written(texts: pd.Series, gone: pd.Series, fresh: pd.Series, prune: pd.Series) -> pd.Series:
    """The documents in one spelling, without the keys that are gone; fresh strings, if any, in place of the own."""
    return pd.Series([None if x is None else _spelled(_read(x), frozenset(g), EMPTY if p else frozenset(), None if f is None else iter(f)) for x, g, f, p in zip(texts, gone, fresh, prune)], dtype=object)


def _parsed(rows: DataFrame, drop: str | None) -> DataFrame:
    """id, text (as the parser writes it), gone (the keys that match drop) and strings."""
    held = rows.select("id", F.to_json(F.try_parse_json("json")).alias("text"))
    held = held.select("id", "text", _words.asNondeterministic()("text").alias("w"))
    gone = F.filter("w.keys", lambda k: F.lower(k).rlike(drop)) if drop else F.array().cast("array<string>")
    return held.select("id", "text", F.coalesce(gone, F.array().cast("array<string>")).alias("gone"), "w.strings")


def nodes(rows: DataFrame, drop: str | None = None, patterns: list[str] | None = None, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Of rows (id, json): id, path, parent, pattern, depth, key, pos, kind, text and keys.

    path is like $.a[0].b and pattern the same with [*]; kind is object, array, string, number,
    boolean or null; text is a scalar's JSON, keys those of an object. Keys that match drop (a
    regular expression, lower-case keys) are not opened, wherever they stand. With patterns or kinds
    only nodes of these are made.
    """
    wanted = None if patterns is None else frozenset(patterns)
    ways = frozenset(p[:i] for p in patterns or () for i in range(1, len(p) + 1) if p[i : i + 1] in ("", ".", "["))
    held = _parsed(rows, drop) if drop else rows.select("id", F.to_json(F.try_parse_json("json")).alias("text"), F.array().cast("array<string>").alias("gone"))
    schema = StructType([StructField("id", rows.schema["id"].dataType), *StructType.fromDDL(_NODE)])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]
        names = ["id", *(x.name for x in schema[1:])]
        for batch in batches:
            at, out = [], []
            for n, (text, gone) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                out += _opened(_read(text), frozenset(gone), wanted, ways, frozenset(kinds))
                at += [n] * (len(out) - len(at))
                if len(out) >= NODES or out and n + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(zip(*out), types))], names=names)
                    at, out = [], []

    return held.where("text IS NOT NULL").select("id", "text", "gone").mapInArrow(opened, schema)


def unquoted(text: Column) -> Column:
    """The string that a JSON string stands for; only one with an escape is parsed."""
    return F.when(~F.contains(text, F.lit("\\")), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(F.from_json(F.concat(F.lit('{"s":'), text, F.lit("}")), "s string")["s"])


def strings(found: DataFrame, change) -> DataFrame:
    """The nodes with change(text) in place of every string."""
    return found.withColumn("text", F.when(F.col("kind") == "string", quoted(change(unquoted(F.col("text"))))).otherwise(F.col("text")))


def quoted(text: Column) -> Column:
    """A string as JSON."""
    inner = F.to_json(F.struct(text.alias("s")), {"ignoreNullFields": "false"})
    return F.when(~text.rlike(r'[\x00-\x1F"\\]'), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.substring(inner, F.lit(6), F.length(inner) - 6))


def built(found: DataFrame, prune: bool = False) -> DataFrame:
    """id and json in one spelling: keys in order, no blanks. With prune null, empty strings and what is left empty goes, but for the root."""
    found = settled(found)
    deepest = found.agg(F.max("depth")).first()[0]
    below = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        own = found.where(F.col("depth") == depth)
        if below is None:
            own = own.withColumn("parts", F.lit(None).cast("array<string>"))
        else:
            held = below.groupBy("id", F.col("parent").alias("path")).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("key", F.lit("")).alias("key"), "pos", "json"))).alias("parts"))
            member = lambda x: F.when(F.col("kind") == "object", F.concat(quoted(x["key"]), F.lit(":"), x["json"])).otherwise(x["json"])
            own = own.join(held, ["id", "path"], "left").withColumn("parts", F.transform("parts", member))
        body = F.array_join(F.coalesce("parts", F.array().cast("array<string>")), ",")
        json = F.when(F.col("kind") == "object", F.concat(F.lit("{"), body, F.lit("}"))).when(F.col("kind") == "array", F.concat(F.lit("["), body, F.lit("]"))).otherwise(F.col("text"))
        below = own.select("id", "path", "parent", "key", "pos", json.alias("json"))
        if prune and depth:
            below = below.where(~F.col("json").isin("null", '""', "{}", "[]"))
        below = settled(below)
    return found.where("depth < 0").select("id", F.lit("").alias("json")) if below is None else below.select("id", "json")


def cleaned(rows: DataFrame, drop: str, change) -> DataFrame:
    """id and json of every row: keys that match drop gone at any depth, strings changed, nothing empty left; null as it was."""
    held = _parsed(rows, drop).withColumn("fresh", F.transform("strings", change))
    return held.select("id", _written("text", "gone", "fresh", F.lit(True)).alias("json"))


def cache_keys(rows: DataFrame, ignore: str | None = None) -> DataFrame:
    """id and key: the SHA-256 of each text in one spelling, without keys that match ignore; null where it is no JSON."""
    json = _written("text", "gone", F.lit(None).cast("array<string>"), F.lit(False))
    return _parsed(rows, ignore).select("id", json.alias("json")).select("id", F.sha2(F.col("json").cast("binary"), 256).alias("key"))


def patterns(schema: list[tuple]) -> list[str]:
    """The patterns of a schema and those above them, which problems looks at."""
    return sorted({x for p, *_ in schema for x in (p, re.sub(r"\.[^.\[\]]+$", "", p))})


def problems(found: DataFrame, schema: list[tuple]) -> DataFrame:
    """id, path and problem of what does not fit a schema of (pattern, kind, required, least, most, allowed).

    Each pattern names the kind that its nodes have; numbers may have bounds and strings a list of
    what is allowed. A required key has to stand in every object of the pattern above it.
    """
    spark = found.sparkSession
    rules = spark.createDataFrame([(p, k, r, None if a is None else float(a), None if b is None else float(b), x) for p, k, r, a, b, x in schema], "pattern string, wanted string, required boolean, least double, most double, allowed array<string>")
    # What is judged at a pattern: its own kind and bounds, and the keys that its objects need; the schema's own rows.
    needed = rules.where("required").select(F.regexp_extract("pattern", r"^(.*)\.[^.\[\]]+$", 1).alias("pattern"), F.regexp_extract("pattern", r"([^.\[\]]+)$", 1).alias("needed"))
    judged = F.broadcast(rules.unionByName(needed, allowMissingColumns=True))
    number = F.when(F.col("kind") == "number", F.col("text").try_cast("double"))
    text = unquoted(F.col("text"))
    problem = (
        F.when(F.col("needed").isNotNull(), F.when((F.col("kind") == "object") & ~F.array_contains("keys", F.col("needed")), "is missing"))
        .when(F.col("kind") != F.col("wanted"), F.concat(F.lit("is no "), "wanted")).when(number < F.col("least"), "too small").when(number > F.col("most"), "too large")
        .when((F.col("kind") == "string") & ~F.array_contains("allowed", text), "not allowed")
    )
    path = F.when(F.col("needed").isNotNull(), F.concat("path", F.lit("."), "needed")).otherwise(F.col("path"))
    return found.join(judged, "pattern").select("id", path.alias("path"), problem.alias("problem")).where("problem IS NOT NULL")
