"""A document read within its task against the joins by document, and the registers' queries by what they write."""

import random
from decimal import Decimal

import pytest

import foliant.queries  # noqa: F401  registers the named queries
from foliant.operators import evidence, reading
from foliant.plans import registry
from foliant.queries import evidence as registers
from tests.test_evidence import REGISTER, exhaustive


def document(r):
    cell = lambda: r.choice(["", "-", "Jane Roe", "Fund AG", "1'200", "1.234.567", "7,5", "28 5 ' 135", "Roe, Jane", "No.", "Holder", "Name", "C-1", "a\\|b", "None", "(12)", "CHF 3", "---", ":-:", "é 1", "&#124; 3"])
    row = lambda n: "| " + " | ".join(cell() for _ in range(n)) + r.choice([" |", " |", " |", " | x", ""])
    out = []
    for _ in range(r.randint(0, 14)):
        n = r.randint(1, 4)
        out.append(r.choice(["", "  ", "Acme Holding", "# Share register", "<!-- page:2 -->", "<!--page:3-->", "Jane Roe", *[row(n)] * 5, "| Holder | No. |\n|---|---|\n" + row(2), "\n".join(row(n) for _ in range(4)), row(n) + "\n<!-- page:4 -->\n\n" + row(n), "\t| a |", "|"]))
    return r.choice(["\n", "\n", "\r\n"]).join(out)


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    texts = {1: REGISTER, 2: None, 3: "", 4: "no table"} | {i: document(r) for i in range(10, 300)}
    return texts, evidence.lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).cache()


def test_lines_and_owners_as_joins_find_them(docs):
    texts, found = docs
    want = {(x.doc_id, x.idx): (x.text, x.kind, x.tbl or 0, x.root or 0, x.cells, x.headers, x.context) for x in found.collect()}
    got = {(i, x.idx): (x.text, x.kind, x.tbl, x.root, x.cells, x.headers, x.context) for i, text in texts.items() for x in reading.lines(text)}
    assert got == want
    owners = {(x.doc_id, x.idx): x.owner for x in evidence.owners(found).collect()}
    assert {(i, idx): at for i, text in texts.items() for idx, at in reading.owners(reading.lines(text)).items()} == owners and len(owners) > 50


@pytest.mark.parametrize("scope", ["row", "headings"])
def test_bindings_and_totals_as_joins_find_them(spark, docs, scope):
    texts, found = docs
    r = random.Random(5)
    claims = [(i, idx, r.choice(["Jane Roe", "Holder", "No.", "acme holding", "x", "", None, "Name", "Fund AG"]), n) for n, (i, idx) in enumerate((i, r.randint(0, 25)) for i in texts for _ in range(12))] + [(1, 6, "Jane Roe", 99_999)]
    want = {x.n: x.binding for x in evidence.bound(found, spark.createDataFrame(claims, "doc_id long, idx int, identity string, n int"), scope).collect()}
    got = {}
    for i, text in texts.items():
        own = [c for c in claims if c[0] == i]
        got |= dict(zip([c[3] for c in own], reading.bound(reading.lines(text), [c[1:3] for c in own], scope)))
    assert got == want and {"row", "owner", "header", "section", "context"} <= set(want.values())
    rows = [(i, idx, r.choice("ab")) for i in texts for idx in range(20) if r.random() < 0.3]
    totals = {(x.doc_id, x.holder, x.root, x.col): (x.n_rows, x.total) for x in evidence.column_totals(found, spark.createDataFrame(rows, "doc_id long, idx int, holder string")).collect()}
    assert {(i, h, root, c): (n, Decimal(v).scaleb(-6)) for i, text in texts.items() for h, root, c, n, v in reading.column_totals(reading.lines(text), [x[1:] for x in rows if x[0] == i])} == totals and totals


def test_fragments_are_asked_as_columns_ask_them(spark):
    quotes = ["| a | 1'200 |\nb ... 7 … x|y", "| - | None |", "", None, " |x| ", "12 13\r\nZoë", "a\\|b | c", "|"]
    want = evidence.quotes_bound(evidence.lines(spark.createDataFrame([(1, "| a | 1'200 |")], "doc_id long, text string")), spark.createDataFrame([(1, i, None, q) for i, q in enumerate(quotes)], "doc_id long, quote_id int, identity string, quote string"))
    assert sorted((i, n, f) for i, q in enumerate(quotes) for n, f in enumerate(reading.fragments(q))) == sorted((x.quote_id, x.nth, x.fragment) for x in want.collect())
    assert reading.asked_of("| a | 1'200 | - |") == (["a", "1200", "-"], True, True) and not reading.asked_of("7")[2]


def test_assignments_of_alike_and_many_fragments():
    r = random.Random(3)
    for _ in range(300):
        named = [r.random() < 0.4 for _ in range(5)]
        kinds = [[(x, named[x]) for x in r.sample(range(5), r.randint(0, 3))] for _ in range(2)]
        own = [r.choice(kinds) for _ in range(r.randint(0, 5))]
        assert evidence.assigned(own) == exhaustive(own), own
    assert evidence.assigned([[(i % 3000, i == 5)] for i in range(6000)]) == [*range(3000), *[None] * 3000]
    assert evidence.assigned([[(i, False) for i in range(2000)]] * 2001) == [*range(2000), None]


@pytest.mark.parametrize("name", ["identity_binding", "owner_rows", "column_sums", "extraction_review", "quoted_lines", "quoted_cells"])
def test_registers_are_read_in_one_pass(spark, sf, monkeypatch, name):
    written = []
    for module in (evidence, registers):
        kept = module.settled
        monkeypatch.setattr(module, "settled", lambda df, kept=kept: written.append(set(df.columns)) or kept(df))
    found = registry.queries()[name](spark, sf)
    # No table of lines or entries is written, and lines are not joined again.
    assert not [c for c in written if c & {"text", "cells", "idx", "certificate"}]
    assert found.count() > 0 and found._jdf.queryExecution().executedPlan().toString().count("Join") <= 4


def test_a_register_is_the_text_that_its_entries_make(spark, sf):
    rows = registers.entries(spark, sf).where("doc_id = 1").toArrow()
    own = registers.Register(rows)
    assert own.text().startswith("# Share register\n") and [no for _, no, _, _ in own.rows] == own.no and [h for *_, h in own.rows] == own.holders
    assert sum(x.kind == "page" for x in own.lines) == (len(own.no) - 1) // registers.PAGE_ROWS
