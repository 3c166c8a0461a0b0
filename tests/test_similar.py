"""Similarity joins against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import similar


def common(x, y):
    line = [0] * (len(y) + 1)
    for c in x:
        made = [0]
        for j, d in enumerate(y, 1):
            made.append(line[j - 1] + 1 if c == d else max(line[j], made[-1]))
        line = made
    return line[-1]


def names(n, seed=1):
    """Random names, and some with typos, initials, turned words and one word only."""
    r = random.Random(seed)
    first = ["jon", "john", "ann", "anna", "joanne", "lé", "maria", "mary", "o", "al", "alexander", "smith"]
    out = set()
    while len(out) < n:
        name = f"{r.choice(first)} {''.join(r.choice('abeilnorst') for _ in range(r.randint(1, 9)))}"
        kind = r.randrange(6)
        base = r.choice(sorted(out)) if out and kind < 3 else name
        if kind == 0:
            i = r.randrange(len(base) + 1)
            base = base[:i] + r.choice(["", "x", "e"]) + base[i + r.randint(0, 1) :]
        elif kind == 1:
            base = " ".join(reversed(base.split()))
        elif kind == 2:
            base = r.choice(base.split() or ["z"])
        elif kind == 3:
            base = name[0] + ". " + name.split()[1]
        out.add(base)
    return sorted(out)


@pytest.fixture(scope="module")
def strings(spark):
    rows = [*names(700), "", None, "a", "b", "zz", "q" * 300, "q" * 299 + "r", "aaaa", "aaaaa", "abababab", "babababa"]
    return rows, spark.createDataFrame([(x,) for x in rows], "s string").withColumn("n", F.lit(1))


@pytest.mark.parametrize("percent", [70, 85, 90])
def test_similar_equals_all_pairs(strings, percent):
    rows, table = strings
    known = sorted({x for x in rows if x})
    want = {}
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if 200 * min(len(a), len(b)) >= percent * (len(a) + len(b)) and 200 * (n := common(a, b)) >= percent * (len(a) + len(b)):
                want[a, b] = round(200 * n / (len(a) + len(b)), 6)
    assert {(r.a, r.b): r.score for r in similar.similar(table.distinct(), percent=percent).collect()} == want
    assert len(want) > 20


def test_two_sides(strings):
    rows, table = strings
    known = sorted({x for x in rows if x})
    left, right = known[::3], known[::2]
    want = {(a, b) for a in left for b in right if 200 * min(len(a), len(b)) >= 85 * (len(a) + len(b)) and 200 * common(a, b) >= 85 * (len(a) + len(b))}
    some = lambda xs: table.sparkSession.createDataFrame([(x,) for x in xs], "s string")
    assert {(r.a, r.b) for r in similar.similar(some(left), some(right)).collect()} == want
    assert similar.similar(table.limit(0)).count() == 0 and similar.contained(table.limit(0)).count() == 0
    with pytest.raises(ValueError, match="share less"):
        similar.similar(table, percent=60)


def test_contained_equals_all_pairs(strings):
    rows, table = strings
    known = {x for x in rows if x}
    got = [(r.a, r.b) for r in similar.contained(table.distinct()).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in known for b in known if a != b and a in b}


def test_pairs_at_once_equal_single_ones():
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdé日/.1") for _ in range(n))
    for n, m in ((1, 1), (7, 9), (64, 64), (64, 70), (80, 63), (70, 75)):
        x, y = [text(n) for _ in range(9)], [text(m) for _ in range(8)]
        at, to = [i for i in range(9) for _ in range(8)], [j for _ in range(9) for j in range(8)]
        got = similar.common_lengths(x, y, similar.np.array(at), similar.np.array(to))
        assert got.tolist() == [common(x[i], y[j]) for i, j in zip(at, to)]
        # Marks never differ by more than what is not common.
        assert all((similar.mark(x[i]) ^ similar.mark(y[j])).bit_count() <= n + m - 2 * k for i, j, k in zip(at, to, got.tolist()))


def test_blocks_meet_each_other_once(strings, monkeypatch):
    rows, table = strings
    whole = sorted(map(tuple, similar.similar(table.distinct(), percent=85).collect()))
    monkeypatch.setattr(similar, "BLOCK", 100)
    monkeypatch.setattr(similar, "AT_ONCE", 50)
    assert similar.similar(table.distinct(), table.where("s = 'zz'")).collect() == [("zz", "zz", 100.0)] and similar.similar(table.distinct(), table.limit(0)).count() == 0
    assert sorted(map(tuple, similar.similar(table.distinct(), percent=85).collect())) == whole
