"""Random rule trees against an interpreter of three-valued logic."""

import random

import pytest
from foliant.operators import rules

NUMBERS, WORDS, LISTS = ("x", "y", "z"), ("s", "t"), ("u",)


def random_tree(r, depth):
    kind = r.choice(["all", "any", "not", "strict", "leaf", "leaf"]) if depth else "leaf"
    if kind in ("all", "any"):
        return {kind: [random_tree(r, depth - 1) for _ in range(r.randint(0, 3))]}
    if kind in ("not", "strict"):
        return {kind: random_tree(r, depth - 1)}
    form = r.randrange(4)
    bounds = {b: r.randint(-2, 3) for b in r.sample(sorted(rules.BOUNDS), r.randint(1, 2))}
    if form == 0:
        return {"input": r.choice(WORDS), "in": r.sample(["a", "b", "it's"], r.randint(0, 2))}
    if form == 1:
        return {"input": "u", "has": r.choice("ab")}
    return {"input": r.choice(NUMBERS), **bounds} if form == 2 else {"ratio": [r.choice(NUMBERS), r.choice(NUMBERS)], **bounds}


def value(node, row):
    """True, False or None."""
    if "all" in node or "any" in node:
        stop = "any" in node
        parts = [value(x, row) for x in node["any" if stop else "all"]]
        return stop if stop in parts else None if None in parts else not stop
    if "not" in node:
        got = value(node["not"], row)
        return None if got is None else not got
    if "strict" in node:
        return None if any(row[n] is None for n in rules.inputs(node)) else value(node["strict"], row)
    if "ratio" in node:
        a, b = (row[n] for n in node["ratio"])
        got = None if a is None or not b else a / b
    else:
        got = row[node["input"]]
    if got is None:
        return None
    if "in" in node:
        return got in node["in"]
    if "has" in node:
        return node["has"] in got if got else None
    return all(test(got, node[b]) for b, (test, _) in rules.BOUNDS.items() if b in node)


def test_random_trees_equal_an_interpreter(spark):
    import duckdb

    r = random.Random(4)
    pick = lambda xs: r.choice([None, *xs])
    rows = [(i, *[pick([-2.0, -1.0, 0.0, 1.0, 2.5]) for _ in NUMBERS], *[pick(["a", "b", "it's"]) for _ in WORDS], pick([["a"], ["b"], ["a", "b"], []])) for i in range(60)]
    names = ["k", *NUMBERS, *WORDS, *LISTS]
    table = spark.createDataFrame(rows, "k int, x double, y double, z double, s string, t string, u array<string>")
    own = [{"item": f"r{i}", "severity": r.choice(["low", "high"]), "active": r.random() < 0.7, "when": None if i == 0 else random_tree(r, 4)} for i in range(40)]
    want = {}
    for row in rows:
        named = dict(zip(names, row))
        for rule in own:
            node = rule["when"]
            got = value(node, named) if node else None
            status = "open question" if not node or not rule["active"] and got is not None else {None: "not evaluated", True: "flagged", False: "acceptable"}[got]
            missing = [n for n in rules.inputs(node) if named[n] is None] if status == "not evaluated" else []
            want[row[0], rule["item"]] = (status, rule["severity"] if status == "flagged" else "info", missing)
    got = rules.findings(table, ["k"], own).cache()
    assert {(x.k, x["item"]): (x.status, x.severity, x.missing) for x in got.collect()} == want
    assert {x[0] for x in want.values()} == {"open question", "not evaluated", "flagged", "acceptable"}
    con = duckdb.connect()
    con.execute("CREATE TABLE rows(k INTEGER, x DOUBLE, y DOUBLE, z DOUBLE, s VARCHAR, t VARCHAR, u VARCHAR[])")
    con.executemany("INSERT INTO rows VALUES (?, ?, ?, ?, ?, ?, ?)", rows)
    assert {(a, b): (c, d, e) for a, b, c, d, e in con.sql(rules.findings_sql("rows", ["k"], own)).fetchall()} == {k: (s, v, ",".join(m)) for k, (s, v, m) in want.items()}


@pytest.mark.parametrize("node", [{}, {"input": "x"}, {"input": "x", "min": 1, "has": "a"}, {"all": [], "any": []}, {"min": 1}, {"ratio": ["x", "y"], "in": [1]}, {"not": {"input": "x", "min": 0}, "min": 1}])
def test_malformed_conditions_are_errors(node):
    with pytest.raises(ValueError, match="no condition"):
        rules.compiled(node)


def test_kleene(spark):
    row = spark.createDataFrame([(None, 1.0)], "x double, y double")
    unknown, true = {"input": "x", "min": 0}, {"input": "y", "min": 0}
    one = lambda node: row.select(rules.compiled(node).alias("v")).first().v
    assert one({"any": [unknown, true]}) is True and one({"all": [unknown, {"not": true}]}) is False
    assert one({"all": [unknown, true]}) is None and one({"strict": {"any": [unknown, true]}}) is None
