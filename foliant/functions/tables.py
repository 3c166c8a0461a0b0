"""Column functions on Markdown tables: cells, headers, parts, bodies that fit a budget."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows that a header is looked for in, labels that it has at least, and what it stands out by.
SCANNED, LABELS, MARGIN = 6, 2, 2
#: Characters of a table chunk, of a header that is repeated, and of a body at least.
CHUNK, HEADER, BODY = 2000, 400, 300


def cells(row: Column) -> Column:
    """The cells of a row: between unescaped pipes, trimmed; none if it does not begin with a pipe."""
    parts = F.split(F.trim(row), r"(?<!\\)\|")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    return F.when(F.trim(row).startswith("|"), F.transform(inner, lambda c: F.trim(c))).otherwise(F.array().cast("array<string>"))


def is_separator(row: Column) -> Column:
    """Whether all cells that are not empty are dashes with colons."""
    found = cells(row)
    return (F.size(found) > 0) & F.forall(found, lambda c: (c == "") | c.rlike(r"^:?-+:?$"))


def numeric(cell: Column) -> Column:
    """Whether a cell is a number once grouping, percent, currencies and parentheses are gone."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(cell, r"[',%$€]|CHF|EUR|USD", "")), r"^\(+|\)+$", "")
    return F.rlike(bare, F.lit(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"))


def labels(row: Column) -> Column:
    return F.size(F.filter(cells(row), lambda c: (c != "") & ~numeric(c)))


def score(row: Column) -> Column:
    """One more for each label, one less for each number."""
    return F.aggregate(cells(row), F.lit(0), lambda n, c: n + F.when(c == "", 0).when(numeric(c), -1).otherwise(1))


def median(values: Column) -> Column:
    ordered, n = F.array_sort(values), F.size(values)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2.0


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def header_at(rows: Column) -> Column:
    """Number (from 0) of the row that names the columns, -1 if none stands out from the rows beneath."""

    def chosen(scores: Column) -> Column:
        top = F.slice(scores, 1, SCANNED)
        best = F.array_position(top, F.array_max(top)).cast("int") - 1
        below = F.when(F.size(scores) > SCANNED, F.slice(scores, SCANNED + 1, F.greatest(F.size(scores) - SCANNED, F.lit(0)))).otherwise(F.slice(scores, best + 2, F.greatest(F.size(scores) - best - 1, F.lit(0))))
        stands_out = (F.size(below) == 0) | (F.get(scores, best) >= median(below) + MARGIN)
        return F.when((F.size(scores) > 0) & (labels(F.get(rows, best)) >= LABELS) & stands_out, best).otherwise(-1)

    return _bound(F.transform(rows, score), chosen)


def parsed(rows: Column) -> Column:
    """struct(header, separator, rows) of a table's rows: a declared separator within the first rows wins over inference."""
    without = lambda *at: F.filter(rows, lambda _, i: ~F.array_contains(F.array(*at), i))

    def by(at: Column) -> Column:
        declared = F.struct(F.when(at > 0, F.get(rows, at - 1)).otherwise("").alias("header"), F.get(rows, at).alias("separator"), without(at, at - 1).alias("rows"))
        found = lambda h: F.struct(F.when(h >= 0, F.get(rows, h)).otherwise("").alias("header"), F.lit("").alias("separator"), without(h).alias("rows"))
        return F.when(at >= 0, declared).otherwise(_bound(header_at(rows), found))

    marks = F.transform(F.slice(rows, 1, SCANNED), is_separator)
    return _bound(F.array_position(marks, F.lit(True)).cast("int") - 1, by)


def prefix(title: Column, header: Column, separator: Column) -> Column:
    """What every chunk of a table begins with: title, header (cut ones without their separator)."""
    long = F.length(header) > HEADER
    shown = F.when(long, F.concat(F.rtrim(F.substring(header, 1, HEADER)), F.lit(" ..."))).otherwise(header)
    lines = F.array(title, F.when(header != "", shown).otherwise(""), F.when((header != "") & ~long, separator).otherwise(""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def packed(rows: Column, budget: Column) -> Column:
    """Bodies of whole rows that fit a budget, a line end costs one; longer rows are cut into slices."""
    slices = lambda r: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(r) / budget) - 1, F.lit(0)).cast("int")), lambda i: F.substring(r, (i * budget + 1).cast("int"), budget.cast("int")))
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("batch"))

    def step(s: Column, x: Column) -> Column:
        fits = F.length(s["batch"]) + 1 + F.length(x) <= budget
        return (
            F.when(s["batch"].isNull(), F.struct(s["done"].alias("done"), x.alias("batch")))
            .when(fits, F.struct(s["done"].alias("done"), F.concat_ws("\n", s["batch"], x).alias("batch")))
            .otherwise(F.struct(F.array_append(s["done"], s["batch"]).alias("done"), x.alias("batch")))
        )

    return F.aggregate(F.flatten(F.transform(rows, slices)), state, step, lambda s: F.when(s["batch"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["batch"])))


def chunks(title: Column, table: Column) -> Column:
    """The chunks of a parsed table, each with the prefix; the prefix alone if there are no rows."""

    def of(head: Column) -> Column:
        budget = F.greatest(CHUNK - F.length(head), F.lit(BODY))
        whole = lambda body: F.when(head == "", body).otherwise(F.concat_ws("\n", head, body))
        bodies = F.transform(packed(table["rows"], budget), whole)
        return F.when(F.size(table["rows"]) > 0, bodies).when(head != "", F.array(head)).otherwise(F.array().cast("array<string>"))

    return _bound(prefix(title, table["header"], table["separator"]), of)


def segments(lines: Column, least: int = CHUNK) -> Column:
    """array<struct<kind, body>>: tables of at least so many characters on their own, smaller ones with the prose around them.

    One pass over the lines keeps the ranges of segments only; bodies are joined once, from the lines.
    """
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    isrow = lambda x: F.trim(x).startswith("|")
    none, empty = F.lit(-1), F.array().cast("array<struct<kind:string,low:int,high:int>>")
    # prose and table: where the open ones begin, or -1; size: characters of the open table.
    state = F.struct(none.alias("prose"), none.alias("table"), F.lit(0).alias("size"), F.lit(0).alias("at"), empty.alias("out"))
    span = lambda kind, low, high: F.array(F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high")))
    now = lambda s, prose, table, size, at, out: F.struct(prose.alias("prose"), table.alias("table"), size.alias("size"), at.alias("at"), out.alias("out"))

    def shown(s: Column, high: Column) -> Column:
        return F.when(s["prose"] >= 0, F.concat(s["out"], span("prose", s["prose"], high))).otherwise(s["out"])

    def ended(s: Column) -> Column:
        alone = now(s, none, none, F.lit(0), s["at"], F.concat(shown(s, s["table"]), span("table", s["table"], s["at"])))
        joined = now(s, F.when(s["prose"] >= 0, s["prose"]).otherwise(s["table"]), none, F.lit(0), s["at"], s["out"])
        return F.when(s["table"] < 0, s).when(s["size"] >= least, alone).otherwise(joined)

    def step(s: Column, line: Column) -> Column:
        size = F.length(F.trim(line)) + F.when(s["table"] >= 0, s["size"] + 1).otherwise(0)
        more = now(s, s["prose"], F.when(s["table"] >= 0, s["table"]).otherwise(s["at"]), size, s["at"] + 1, s["out"])
        after = lambda e: now(e, F.when(e["prose"] >= 0, e["prose"]).otherwise(e["at"]), none, F.lit(0), e["at"] + 1, e["out"])
        return F.when(isrow(line), more).otherwise(_bound(ended(s), after))

    spans = F.aggregate(lines, state, step, lambda s: _bound(ended(s), lambda e: shown(e, e["at"])))
    clean = F.transform(lines, lambda x: F.when(isrow(x), F.trim(x)).otherwise(x))
    body = lambda c, x: F.array_join(F.slice(c, x["low"] + 1, x["high"] - x["low"]), "\n")
    made = _bound(clean, lambda c: F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), F.when(x["kind"] == "prose", strip(body(c, x))).otherwise(body(c, x)).alias("body"))))
    return F.filter(made, lambda x: x["body"] != "")


def section_chunks(lines: Column, least: int = CHUNK, size: int = 1000, overlap: int = 100) -> Column:
    """array<array<string>>: the chunks of every segment; prose in windows that overlap."""

    def of(x: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(x["body"]) - overlap - 1, F.lit(0)), F.lit(size - overlap))
        prose = F.transform(starts, lambda i: F.substring(x["body"], i + 1, F.lit(size)))
        return F.when(x["kind"] == "table", _bound(F.split(x["body"], "\n"), lambda rows: chunks(F.lit(""), parsed(rows)))).otherwise(prose)

    return F.transform(segments(lines, least), of)
