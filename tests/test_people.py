"""Matching and merging of people against all pairs and against one fold over all records."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import people
from tests.test_similar import names


def some(n, seed):
    r = random.Random(seed)
    pool = names(60, seed)
    out = []
    for i in range(n):
        name = r.choice(pool) if r.random() < 0.8 else ""
        mails = [f"{r.choice(pool).replace(' ', r.choice('._'))}@{r.choice('ab')}.com".lower() for _ in range(r.choice([0, 0, 1, 2]))]
        out.append((i, name, r.choice(["", "", "", "p-1", "p-2", "jon-smith-77"]), [m for m in mails if m.isascii() and ". " not in m]))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "seq long, full_name string, profile string, emails array<string>").withColumn("lower", F.lit("x"))


def as_people(rows):
    return [people.Person(s, n or "", p or "", e or []) for s, n, p, e in rows]


@pytest.mark.parametrize("seed", range(3))
def test_best_equals_all_pairs(spark, seed):
    rows = some(150, seed) + [(900, None, None, None), (901, "  ", "", []), (902, "日本 語", "", ["bob@x.com"]), (903, "bob", "", []), (904, "bob", "", [])]
    all_ = as_people(rows)
    for p in all_:
        p.full_name = p.full_name.strip()
    want = {}
    for p in all_:
        others = [q for q in all_ if q is not p]
        same = [q for q in others if p.profile and q.profile == p.profile]
        best = max(((people.score(p, q), -q.seq) for q in same or others), default=(0, 0))
        if best[0] >= people.SAME:
            want[p.seq] = (-best[1], round(best[0], 6))
    assert {r.one: (r.other, round(r.score, 6)) for r in people.best_matches(frame(spark, rows)).collect()} == want
    known = {p.full_name.lower() for p in all_ if p.full_name}
    links = {(a, b): round(people.score(people.Person(0, a, "", []), people.Person(1, b, "", [])), 6) for a in known for b in known if a < b}
    assert {(r.a, r.b): r.score for r in people.name_links(frame(spark, rows)).collect()} == {k: s for k, s in links.items() if s >= people.SAME}


@pytest.mark.parametrize("grouped", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_merging_equals_one_fold(spark, seed, grouped):
    rows = some(120, 10 + seed)
    if seed == 2:  # few links, so that there are many groups
        rows = [(i, f"{chr(97 + i % 26) * 3} {chr(98 + i % 24) * 4}{i % 5}", "", e) for i, _, _, e in rows]
    policy = people.grouped_fold if grouped else people.fold
    plain = lambda ps: sorted((p.seq, sorted(p.members), p.full_name, p.profile, list(p.emails)) for p in ps)
    want = plain(policy(as_people(rows)))
    got = sorted((r.person, list(r.members), r.full_name, r.profile, list(r.emails)) for r in people.merged(frame(spark, rows).repartition(5), grouped).collect())
    assert got == want and (seed == 2 or len(want) < len(rows))


def test_order_and_second_pass():
    person = lambda *rows: as_people([(i, *row) for i, row in enumerate(rows)])
    # Two people who do not match are joined by a third record that brings what they share.
    out = people.fold(person(("Ann Lee", "", []), ("Robert Moss", "", ["x@y.com"]), ("Ann Lee", "", ["x@y.com"])))
    assert [sorted(p.members) for p in out] == [[0, 1, 2]] and out[0].full_name == "Robert Moss"
    # Different profiles are different people, however alike; a containing name is not enough for the other policy.
    rows = (("Jon Smith", "a", []), ("Jon Smith", "b", []), ("Smith", "", []), ("Jon Smith", "", []))
    assert [sorted(p.members) for p in people.fold(person(*rows))] == [[0, 2, 3], [1]]
    assert [sorted(p.members) for p in people.grouped_fold(person(*rows))] == [[0, 3], [1], [2]]
    # Addresses only join the first holder; a hint of an address names its holder.
    rows = (("", "", ["jon.smith@a.com"]), ("Jon Smith", "", ["jon.smith@a.com"]), ("Jon Smyth", "x", []))
    assert [sorted(p.members) for p in people.grouped_fold(person(*rows))] == [[0, 1, 2]]


@pytest.mark.parametrize("policy", [people.fold, people.grouped_fold])
def test_a_fold_scores_only_what_may_match(monkeypatch, policy):
    n = [0]
    real = people._alike
    monkeypatch.setattr(people, "_alike", lambda x, y: n.__setitem__(0, n[0] + 1) or real(x, y))
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    rows = [(i, f"{word()} {word()}", "", []) for i in range(400)]
    out = policy(as_people([*rows, (400, rows[7][1], "", [])]))
    assert [p.members for p in out if len(p.members) > 1] == [[7, 400]] and n[0] < 4000


def test_lost_values(spark):
    rows = frame(spark, [(0, "Ann", "", ["a@b.com"]), (1, "Ann Lee", "", [])])
    got = {r.metric: r.n for r in people.merge_metrics(rows, people.merged(rows)).collect()}
    assert got == {"records": 2, "people": 1, "lost_emails": 0, "lost_full_names": 1, "lost_profiles": 0}
    assert people.merged(rows.limit(0)).count() == 0 and people.best_matches(rows.limit(0)).count() == 0


def test_closest_line_equals_all_lines(spark):
    from foliant.queries.people import closest_lines
    from tests.test_similar import common

    r = random.Random(5)
    line = lambda: "".join(r.choice("abc d,") for _ in range(r.randint(0, 150)))
    rows = [(i, line(), [line() for _ in range(r.randint(0, 9))]) for i in range(80)] + [(100, "", ["a"]), (101, None, ["a"]), (102, "a", None), (103, "A-b!", ["", "ab", "AB "]), (104, "ab" * 90, ["x" * 90 + "ab" * 60])]
    key = lambda x: "".join(c for c in x.lower() if c.isalnum())
    want = {}
    for i, fragment, lines in rows:
        scores = [(200.0 * common(key(fragment), key(x)) / (len(key(fragment)) + len(key(x))), -n) for n, x in enumerate(lines or []) if fragment and key(fragment) and key(x)]
        if scores and max(scores)[0] >= 60:
            want[i] = (lines[-max(scores)[1]].strip(" "), round(max(scores)[0], 6))
    got = {x.id: (x.line, x.score) for x in closest_lines(spark.createDataFrame(rows, "id long, fragment string, lines array<string>")).collect()}
    assert got == want and len(got) > 10


def test_fragment_meets_all_lines_at_once():
    import time

    from foliant.functions.text import common_characters, common_with_each

    r = random.Random(8)
    for _ in range(200):
        word = lambda: "".join(r.choice("abcdé𝔸\0\n") for _ in range(r.randint(0, 70)))  # noqa: E731, B023
        x, ys = word(), [word() for _ in range(r.randint(1, 12))]
        assert common_with_each(x, ys).tolist() == [common_characters(x, y) for y in ys]
    line = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100))
    x, ys, clock = line(), [line() for _ in range(400)], time.process_time
    began = clock()
    each = [common_characters(x, y) for y in ys]
    middle = clock()
    assert common_with_each(x, ys).tolist() == each and clock() - middle < (middle - began) / 3


@pytest.mark.parametrize("grouped", [False, True])
def test_a_merge_scans_no_marks_and_starts_no_task_code_for_single_records(spark, monkeypatch, grouped):
    # A fold gets the links of its names: it neither marks strings nor compares a record with all people.
    def none(*_):
        raise AssertionError("all people of a group were looked through")

    rows = some(90, 40) + [(1000 + i, f"{chr(97 + i % 26) * 4} {chr(98 + i % 24) * 5}{i}", "", ["a@x.com", "a@x.com"] if i == 0 else []) for i in range(30)]
    policy = people.grouped_fold if grouped else people.fold
    plain = lambda ps: sorted((p.seq, sorted(p.members), p.full_name, p.profile, list(p.emails)) for p in ps)
    want = plain(policy(as_people(rows)))
    for name in ("add", "near", "parts"):
        monkeypatch.setattr(people.Marks, name, none)
    all_ = [[x for x in (p.full_name.lower(), people._sorted_words(people._normal(p.full_name)), people._sorted_words(people._slug(p.full_name))) if x] for p in as_people(rows)]
    told = {people._sorted_words(h) for p in as_people(rows) for h in (people._hints(p.profile, p.emails) if grouped else map(people._local, p.emails))}
    names_ = {x for own in all_ for x in own}
    # More links than are needed change nothing.
    links = people.Links([(a, b) for a in names_ for b in names_ if a < b], [(a, b) for a in names_ for b in told])
    assert plain(policy(as_people(rows), links)) == want
    got = people.merged(frame(spark, rows), grouped)
    assert sorted((r.person, list(r.members), r.full_name, r.profile, list(r.emails)) for r in got.collect()) == want
