"""Nested JSON against Python's own reading, pruning and writing of it."""

import hashlib
import json
import random
import re

from pyspark.sql import functions as F

from foliant.operators import nested


def tree(r, depth):
    kind = r.choice(["object", "array", "leaf"]) if depth else "leaf"
    if kind == "object":
        return {r.choice(["a", "b", "image", "c d", "é", 'q"', "Urn1"]): tree(r, depth - 1) for _ in range(r.randint(0, 4))}
    if kind == "array":
        return [tree(r, depth - 1) for _ in range(r.randint(0, 4))]
    return r.choice([None, True, False, 0, -7, 123456789, "", "text", 'quote " and \\ slash', "urn:x", "a  https://x/y b", "line\nend", "é"])


def spelled(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def dropped(x, gone):
    if isinstance(x, dict):
        return {k: dropped(v, gone) for k, v in x.items() if not re.search(gone, k.lower())}
    return [dropped(v, gone) for v in x] if isinstance(x, list) else x


def pruned(x, change):
    if isinstance(x, dict):
        return {k: y for k, v in x.items() if (y := pruned(v, change)) not in (None, "", [], {}) or y is False or y == 0 and y is not None and not isinstance(y, (str, list, dict))}
    if isinstance(x, list):
        return [y for v in x if (y := pruned(v, change)) not in (None, "", [], {}) or y is False or y == 0 and y is not None and not isinstance(y, (str, list, dict))]
    return change(x) if isinstance(x, str) else x


def test_documents_of_any_shape(spark):
    r = random.Random(3)
    docs = {i: tree(r, 6) for i in range(120)}
    rows = [(i, json.dumps(x)) for i, x in docs.items()] + [(900, None), (901, "{not json"), (902, "{}"), (903, "[]"), (904, " 5 ")]
    table = spark.createDataFrame(rows, "id long, json string").withColumn("path", F.lit(1))
    want = {**docs, 902: {}, 903: [], 904: 5}
    assert {x.id: x.json for x in nested.built(nested.nodes(table)).collect()} == {i: spelled(x) for i, x in want.items()}
    keys = {x.id: x.key for x in nested.cache_keys(table, "^image$").collect()}
    assert len(keys) == len(rows) and keys[900] is None and keys[901] is None
    assert all(keys[i] == hashlib.sha256(spelled(dropped(x, "^image$")).encode()).hexdigest() for i, x in want.items())
    got = {x.id: x.json for x in nested.cleaned(table, "image|urn", lambda s: F.replace(s, F.lit("urn:x"), F.lit(""))).collect()}
    assert all(got[i] == spelled(pruned(dropped(x, "image|urn"), lambda s: s.replace("urn:x", ""))) for i, x in want.items())
    depth = lambda x: 1 + max(map(depth, x.values() if isinstance(x, dict) else x), default=0) if isinstance(x, (dict, list)) else 0
    assert nested.nodes(table).agg(F.max("depth")).first()[0] == max(map(depth, want.values()))
    assert nested.built(nested.nodes(table.limit(0))).count() == 0


def test_schema_problems_have_paths(spark):
    schema = [("$.a", "number", True, 0, 9, None), ("$.b[*].c", "string", True, None, None, ["x", "y"]), ("$.b[*].d", "boolean", False, None, None, None)]
    rows = [(1, '{"a": 5, "b": [{"c": "x"}, {"c": "z", "d": 1}, {}]}'), (2, '{"a": -1}'), (3, '{"a": 10, "b": []}'), (4, '{"a": "5", "b": {"c": 1}}'), (5, "{}"), (6, None)]
    got = sorted(tuple(x) for x in nested.problems(nested.nodes(spark.createDataFrame(rows, "id long, json string")), schema).collect())
    assert got == [(1, "$.b[1].c", "not allowed"), (1, "$.b[1].d", "is no boolean"), (1, "$.b[2].c", "is missing"), (2, "$.a", "too small"), (3, "$.a", "too large"), (4, "$.a", "is no number"), (5, "$.a", "is missing")]


def test_documents_are_opened_within_their_task(spark, monkeypatch):
    def refuse(df):
        raise AssertionError("a round was written")

    monkeypatch.setattr(nested, "settled", refuse)
    r = random.Random(9)
    docs = {i: tree(r, 5) for i in range(60)} | {900: {"a\x01\n": 'x"\\\x1f', "image": {"b": "gone"}, "b": [1.5, -0.0, 10**30, 1e-7]}}
    table = spark.createDataFrame([(i, json.dumps(x)) for i, x in docs.items()] + [(901, None), (902, "{")], "id long, json string")
    every = nested.nodes(table)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(nested.nodes(table, patterns=["$.b[*].a", "$.a"])) == rows(every.where("pattern IN ('$.b[*].a', '$.a')")) != []
    assert rows(nested.nodes(table, kinds=("string",))) == rows(every.where("kind = 'string'")) != []
    assert nested.nodes(table, patterns=["$.none"]).count() == 0
    spelt = every.where("kind = 'string'").select("text", nested.quoted(nested.unquoted(F.col("text"))).alias("again")).collect()
    assert all(x.text == x.again for x in spelt) and any("u001F" in x.text for x in spelt)
    schema = [("$.a", "number", True, 0, 9, None), ("$.b[*].a", "string", True, None, None, ["text"])]
    found = nested.problems(nested.nodes(table, patterns=nested.patterns(schema)), schema)
    assert rows(found) == rows(nested.problems(every, schema)) != []
    for df in (found, nested.cleaned(table, "image", lambda s: F.upper(s)), nested.cache_keys(table, "image$")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan and df.count() > 0
