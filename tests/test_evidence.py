"""Lines, owners, bindings and quotes of small documents; assignments against exhaustive search."""

import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from foliant.operators import evidence

REGISTER = """# Share register
Acme Holding

| No. | Holder | Certificate | Common | Preferred |
|---|---|---|---|---|
| 1 | Jane Roe | C-1 | 1'200 | - |
| 2 |  | C-2 | 300 | - |
<!-- page:2 -->

| 3 |  | C-3 | 28 5 ' | 10 |
| 4 | Fund AG | C-4 | 7,000 | 1.234.567 |
<!-- page:3 -->
Share register
Acme Holding

| 5 |  | C-5 | 40 | - |
Investors
| Founders |  |  |
| Max Muster | 10 | 20 |
<!-- page:4 -->
| Pool | Granted |
|---|---|
| ESOP | 5 |
"""


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(1, REGISTER), (2, None), (3, ""), (4, "no table\nat all"), (5, "| a | 1 |\n| b | 2 |\n| b | 2 |")], "doc_id long, text string").withColumn("idx", F.lit(1))
    return evidence.lines(docs).cache()


def test_lines_and_tables_across_pages(found):
    rows = {r.idx: r for r in found.where("doc_id = 1").collect()}
    at = {r.text[:9]: r for r in rows.values()}
    assert [rows[i].kind for i in range(5)] == ["prose", "prose", "blank", "header", "separator"]
    assert at["| 1 | Jan"].tbl == at["| 3 |  | "].tbl == at["| 4 | Fun"].tbl  # one page mark between them
    assert at["| 5 |  | "].tbl != at["| 4 | Fun"].tbl and at["| 5 |  | "].root == at["| 4 | Fun"].root  # below a running header
    assert at["| 5 |  | "].headers == ["No.", "Holder", "Certificate", "Common", "Preferred"]
    assert at["| Founder"].root != at["| 5 |  | "].root and at["| ESOP | "].root != at["| Max Mus"].root
    assert at["| ESOP | "].headers == ["Pool", "Granted"] and at["| Max Mus"].context == ["Investors"]
    assert at["| 1 | Jan"].context == ["Acme Holding", "# Share register"]
    assert [r.kind for r in found.where("doc_id IN (2, 3)").collect()] == ["blank", "blank"]


def test_owner_is_the_name_above_also_across_pages(found):
    texts = {(r.doc_id, r.idx): r.text for r in found.collect()}
    got = {texts[r.doc_id, r.idx][:5]: texts[r.doc_id, r.owner][:9] for r in evidence.owners(found).collect()}
    assert got["| 2 |"] == got["| 3 |"] == "| 1 | Jan" and got["| 5 |"] == "| 4 | Fun"
    assert "| 1 |" not in got and "| 4 |" not in got


@pytest.mark.parametrize(
    "cell,stated",
    [("1'200", [1200]), ("28 5 '135", [28, 5135]), ("7,000", [7000]), ("1.234.567", [1234567]), ("1.234,5", [Decimal("1234.5")]), ("1,5", [Decimal("1.5")]), ("-", [0]), ("none", [0]), ("", []), ("a1", []), ("12 %", [12]), ("&#124; 3", [3]), ("1 000 shares", [1000])],
)
def test_numbers_of_a_cell(spark, cell, stated):
    got = spark.createDataFrame([(cell,)], "c string").select(evidence.values(F.col("c"))).first()[0]
    assert [float(x) for x in got] == [float(x) for x in stated]


def test_identities_bind_at_the_first_place_that_names_them(spark, found):
    at = {r.text[:9]: r.idx for r in found.where("doc_id = 1").collect()}
    claims = [("| 1 | Jan", "Jane Roe"), ("| 3 |  | ", "jane roe"), ("| 5 |  | ", "Fund AG"), ("| 4 | Fun", "Preferred"), ("| 1 | Jan", "Preferred"), ("| Max Mus", "Founders"), ("| Max Mus", "Investors"), ("| 4 | Fun", "Jane Roe"), ("| ESOP | ", "Share register"), ("| 1 | Jan", "nobody")]
    table = spark.createDataFrame([(1, at[k], who, n) for n, (k, who) in enumerate(claims)] + [(9, 1, "x", 98), (1, 0, "Share", 99)], "doc_id long, idx int, identity string, n int")
    by = lambda scope: {r.n: r.binding for r in evidence.bound(found, table, scope).collect()}
    first = by("row")
    assert [first[n] for n in range(10)] == ["row", "owner", "owner", "header", None, "section", "context", None, None, None] and first[98] is None and first[99] is None
    assert by("table")[7] == "table" and by("headings")[8] == "heading"


def test_column_totals_need_a_number_in_every_row(spark, found):
    at = {r.text[:9]: r.idx for r in found.where("doc_id = 1").collect()}
    rows = spark.createDataFrame([(1, at["| 1 | Jan"], "Jane"), (1, at["| 2 |  | "], "Jane"), (1, at["| 4 | Fun"], "Fund"), (1, at["| 5 |  | "], "Fund")], "doc_id long, idx int, holder string")
    got = {(r.holder, r.col): float(r.total) for r in evidence.column_totals(found, rows).where("col >= 3").collect()}
    assert got == {("Jane", 3): 1500.0, ("Jane", 4): 0.0, ("Fund", 3): 7040.0, ("Fund", 4): 1234567.0}


def exhaustive(candidates):
    naming = {line: named for own in candidates for line, named in own}
    best = None
    for pick in itertools.product(*[[None, *sorted({line for line, _ in own})] for own in candidates]):
        used = [p for p in pick if p is not None]
        if len(used) == len(set(used)):
            key = (-len(used), -sum(naming[p] for p in used), tuple(1 << 30 if p is None else p for p in pick))
            best = min(best or (key, pick), (key, pick), key=lambda x: x[0])
    return list(best[1])


def test_assignments_equal_exhaustive_search():
    r = random.Random(9)
    for _ in range(500):
        named = [r.random() < 0.4 for _ in range(6)]
        own = [[(x, named[x]) for x in r.sample(range(6), r.randint(0, 4))] for _ in range(r.randint(0, 4))]
        assert evidence.assigned(own) == exhaustive(own), own
    assert evidence.assigned([[(0, False), (1, False)], [(0, False)]]) == [1, 0]  # the first gives way


def test_quotes_take_a_row_of_their_own(spark, found):
    at = {(r.doc_id, r.text[:9]): r.idx for r in found.orderBy(F.desc("idx")).collect()}
    quotes = [
        (1, 1, "Jane Roe", "| Jane Roe | 1'200 |\n| C-2 | 300 |"), (1, 2, "Fund AG", "Fund AG | C-4 ... | 5 | | C-5 | 40 |"),
        (1, 3, None, "| Jane Roe | 1'200 |\n| 1 | Jane Roe |"), (5, 4, None, "| b | 2 |\n| b | 2 |\n| b | 2 |"), (1, 5, None, "| 1'200 | Jane Roe |"), (1, 6, None, "7"), (1, 7, None, "jane roe c-1"), (1, 8, None, None), (77, 9, None, "x y z"),
    ]
    got = {(r.quote_id, r.nth): r.idx for r in evidence.quotes_bound(found, spark.createDataFrame(quotes, "doc_id long, quote_id int, identity string, quote string")).collect()}
    assert got == {
        (1, 0): at[1, "| 1 | Jan"], (1, 1): at[1, "| 2 |  | "], (2, 0): at[1, "| 4 | Fun"], (2, 1): at[1, "| 5 |  | "], (3, 0): at[1, "| 1 | Jan"], (3, 1): None,
        (4, 0): 1, (4, 1): 2, (4, 2): None, (5, 0): None, (6, 0): None, (7, 0): at[1, "| 1 | Jan"], (9, 0): None,
    }


def test_what_names_is_made_once_and_names_alike(spark):
    pairs = [("Jane Roe", "| 1 | ROE, Jane |"), ("ab", "x ab y"), ("ab", "xaby"), ("abcd", "xabcdy"), ("", "a"), ("a", ""), (None, "a"), ("!", "!"), ("Zoë", "zoë!")]
    rows = spark.createDataFrame(pairs, "a string, b string").withColumns({"x": evidence._named(F.col("a")), "y": evidence._named(F.col("b"))})
    got = rows.select(evidence._names(F.col("x"), F.col("y")).alias("made"), evidence.named_in(F.col("a"), F.col("b")).alias("whole")).collect()
    assert [r.made for r in got] == [r.whole for r in got] and [bool(r.made) for r in got] == [True, True, False, True, False, False, False, False, True]


def test_bindings_make_keys_of_a_line_once(spark, found, monkeypatch):
    calls = []
    kept = evidence.quote_key
    monkeypatch.setattr(evidence, "quote_key", lambda c: calls.append(1) or kept(c))
    claims = spark.createDataFrame([(1, 5, "Jane Roe")], "doc_id long, idx int, identity string")
    assert [r.binding for r in evidence.bound(found, claims).collect()] == ["row"]
    assert len(calls) <= 6  # identities, lines, headers, context; both sides of a section


def test_owners_where_only_some_tables_tell_the_column_of_names(spark):
    text = "| Max | 1 |\n| | 2 |\n<!-- page:2 -->\n\n| Holder | n |\n|---|---|\n| Eve | 3 |\n|  | 4 |"
    found = evidence.lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    texts = {r.idx: r.text for r in found.collect()}
    assert {texts[r.idx]: texts[r.owner] for r in evidence.owners(found).collect()} == {"| | 2 |": "| Max | 1 |", "|  | 4 |": "| Eve | 3 |"}


def test_quotes_meet_rows_by_document_and_write_nothing(spark, monkeypatch):
    found = evidence.lines(spark.createDataFrame([(1, "| Jane Roe | None |\n| Jane Roe | 5 |")], "doc_id long, text string"))
    monkeypatch.setattr(evidence, "settled", lambda rows: pytest.fail("a table of all runs of characters was written here"))
    quotes = spark.createDataFrame([(1, 1, None, "| Jane Roe | None |"), (1, 2, "Jane Roe", "| Jane Roe |\n| Jane Roe |\n| 5 |")], "doc_id long, quote_id int, identity string, quote string")
    # A marker of zero in capitals is a cell like others; its characters do not stand in the row's key.
    assert sorted((r.quote_id, r.nth, r.idx) for r in evidence.quotes_bound(found, quotes).collect()) == [(1, 0, 0), (2, 0, 0), (2, 1, 1), (2, 2, None)]
