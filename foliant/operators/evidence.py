"""Evidence in the lines of documents: tables across page breaks, owners of rows, holders' names, quotes.

A document's lines become rows. Runs of lines that begin with a pipe are blocks. Two blocks with one
page mark between them are one table, unless the second declares a header of its own; a block below
a page mark and a few lines of running header continues the table above it if it declares no header
and has as many cells: its root is that of the table above. What a row lacks it finds up that
structure: the row above that names its owner, its column's header, a section row, the text above.

Everything is windows and joins by document; nothing looks at pairs of lines of a document but those
that a quote's longest key brings together. What a task can do with a whole text is in reading.

Cases: a null or empty text has one blank line; texts without tables have prose only; claims and
quotes of documents or lines that are not there find nothing. doc_id is unique and not null.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import tables as T
from foliant.functions.text import name_key, quote_key
from foliant.tables import settled

#: Lines of text above a table that may name what stands in it; opening lines that are a title.
CONTEXT, TITLE = 3, 5
#: Page marks, headings, columns of names and columns of numbers only (fixed values).
PAGE = r"^<!--\s*page:.*-->$"
HEADING = r"^\s*#{1,6}\s+\S"
NAME_COLUMN = r"holder|\bname\b|aktion[äa]r|shareholder|actionnaire|inhaber|group|label|pool|bezeichnung|titulaire|\bnom\b"
NUMBERING = r"^\s*(?:no|nr)\.?\s*$"
#: Cells that state a zero (fixed values).
ZEROS = ("-", "–", "—", "0", "none", "nil", "keine", "aucun", "aucune")


def values(cell: Column) -> Column:
    """The numbers that a cell states; an explicit marker states zero. Groups of three join at apostrophes, blanks and the other mark."""
    text = F.regexp_replace(F.regexp_replace(cell, r"&#\d+;|&#x[0-9a-fA-F]+;|&[a-zA-Z]+;", " "), r"(?<=\d)[  ]*['’][  ]*(?=\d{3}(?!\d))", "")
    text = F.regexp_replace(text, r"(?<=\d)[  ](?=\d{3}(?:\D|$))", "")
    found = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])[+-]?\d+(?:[.,]\d+)*"), F.lit(0))

    def number(x: Column) -> Column:
        comma, dot = F.contains(x, F.lit(",")), F.contains(x, F.lit("."))
        last_dot = F.length(F.substring_index(x, ".", -1)) < F.length(F.substring_index(x, ",", -1))
        both = F.when(last_dot, F.replace(x, F.lit(","), F.lit(""))).otherwise(F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        commas = F.when(x.rlike(r"^[+-]?\d{1,3}(?:,\d{3})+$"), F.replace(x, F.lit(","), F.lit(""))).otherwise(F.replace(x, F.lit(","), F.lit(".")))
        dots = F.when(x.rlike(r"^[+-]?\d{1,3}(?:\.\d{3}){2,}$"), F.replace(x, F.lit("."), F.lit(""))).otherwise(x)
        return F.when(comma & dot, both).when(comma, commas).otherwise(dots).try_cast("decimal(24,6)")

    stated = F.filter(F.transform(found, number), lambda x: x.isNotNull())
    return F.when(F.lower(F.trim(cell)).isin(*ZEROS), F.array(F.lit(0).cast("decimal(24,6)"))).otherwise(stated)


def is_text(cell: Column) -> Column:
    """Whether a cell says something that is no number."""
    word = cell.rlike(r"[a-zA-ZÀ-ɏ]{2,}")
    return (F.trim(cell) != "") & ~F.lower(F.trim(cell)).isin(*ZEROS) & (word | (F.size(values(cell)) == 0))


def _named(text: Column) -> Column:
    """What naming compares of a text: key (letters and digits) and words."""
    return F.struct(quote_key(text).alias("key"), F.filter(F.split(name_key(text), " "), lambda w: w != "").alias("words"))


def _names(identity: Column, text: Column) -> Column:
    """named_in of what _named has made of both."""
    key, own = identity["key"], text["key"]
    apart = (F.size(identity["words"]) > 0) & (F.size(F.array_except(identity["words"], text["words"])) == 0)
    return (key != "") & (own != "") & ((key == own) | ((F.length(key) >= 4) & F.contains(own, key)) | apart)


def named_in(identity: Column, text: Column) -> Column:
    """Whether a text names an identity: in one piece of four letters or more, or by all its words."""
    return _names(_named(identity), _named(text))


def _numbered_lines(docs: DataFrame) -> DataFrame:
    """doc_id, idx, text and kind (blank, page, table, prose), with counts of page marks and prose lines so far."""
    own = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("idx", "text")).withColumn("text", F.trim("text"))
    kind = F.when(F.col("text") == "", "blank").when(F.col("text").rlike(PAGE), "page").when(F.col("text").startswith("|"), "table").otherwise("prose")
    order = Window.partitionBy("doc_id").orderBy("idx")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    of = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).over(so_far)
    counted = own.withColumn("kind", kind).withColumn("pages", of("page")).withColumn("proses", of("prose"))
    # Blanks around a page mark do not end a block; any other line does.
    before = F.lag("kind").over(order)
    begins = (F.col("kind") == "table") & (F.coalesce(before, F.lit("")) != "table")
    return counted.withColumn("at_page", F.last(F.when(F.col("kind") == "page", F.col("proses")), True).over(so_far)).withColumn("block", F.sum(begins.cast("int")).over(so_far))


def _blocks(numbered: DataFrame) -> DataFrame:
    """doc_id, block, tbl and root: which blocks are one table, and which table's rows they go on with."""
    first = F.min_by("text", "idx")
    own = numbered.where("kind = 'table'").groupBy("doc_id", "block").agg(
        F.min("idx").alias("low"), first.alias("first"), F.max_by("text", "idx").alias("last"), F.min_by("pages", "idx").alias("pages"), F.min_by("proses", "idx").alias("proses"),
        F.min_by("at_page", "idx").alias("at_page"), F.get(F.array_sort(F.collect_list(F.struct("idx", "text"))), F.lit(1))["text"].alias("second"),
    )
    declared = F.coalesce(T.is_separator(F.col("second")), F.lit(False))
    head = T.cells(F.col("first"))
    own = own.withColumn("keys", F.when(declared, F.transform(head, quote_key)))
    own = own.withColumn("header", F.when(declared & F.exists(head, is_text) & ~F.exists(head, lambda c: (F.trim(c) != "") & ~is_text(c)), F.col("keys")))
    order = Window.partitionBy("doc_id").orderBy("block")
    was = lambda c: F.lag(c).over(order)
    pages, proses = F.col("pages") - was("pages"), F.col("proses") - was("proses")
    joins = (pages == 1) & (proses == 0) & (F.col("header").isNull() | F.coalesce(F.col("header") == was("keys"), F.lit(False)))
    under = (pages >= 1) & (F.col("at_page") == was("proses")) & (F.col("proses") - F.col("at_page") <= CONTEXT)
    goes_on = under & F.col("keys").isNull() & (F.size(T.cells(F.col("first"))) == F.size(T.cells(was("last"))))
    own = own.withColumn("joins", F.coalesce(joins, F.lit(False))).withColumn("goes_on", F.coalesce(goes_on, F.lit(False)))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    number = lambda same: F.sum(F.when(same, 0).otherwise(1)).over(so_far)
    return own.select("doc_id", "block", number(F.col("joins")).alias("tbl"), number(F.col("joins") | F.col("goes_on")).alias("root"))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, idx, text, kind, tbl, root, cells, headers and context of every line of texts (doc_id, text).

    kind: row, header, separator, prose, blank or page. tbl and root number the tables of a document
    (null outside); headers are those of the table or of the one it goes on with; context is up to
    CONTEXT lines of text directly above the table, the nearest first.
    """
    numbered = settled(_numbered_lines(docs))
    placed = numbered.join(_blocks(numbered), ["doc_id", "block"], "left")
    inside = F.col("kind") == "table"
    placed = placed.select("doc_id", "idx", "text", "kind", *[F.when(inside, F.col(c)).alias(c) for c in ("tbl", "root")], F.when(inside, T.cells(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("cells"))
    placed = settled(placed)

    rows = placed.where("tbl IS NOT NULL").groupBy("doc_id", "root", "tbl").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]).alias("rows"), F.min("idx").alias("low"))
    parsed = rows.withColumn("t", T.parsed(F.col("rows"))).withColumn("own", T.cells(F.col("t.header")))
    numbers = F.size(F.filter("own", lambda c: (F.trim(c) != "") & ~is_text(c)))
    usable = (F.size("own") > 0) & ((numbers == 0) | (numbers < F.size(F.filter("own", is_text))))
    parsed = parsed.select("doc_id", "root", "tbl", "low", F.when(usable, F.col("own")).alias("own"), (usable & (F.col("t.separator") != "")).alias("declared"))
    above = Window.partitionBy("doc_id", "root").orderBy("tbl").rowsBetween(Window.unboundedPreceding, 0)
    headers = parsed.select("doc_id", "tbl", "low", "own", "declared", F.coalesce(F.last("own", True).over(above), F.array().cast("array<string>")).alias("headers"))

    said = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(-CONTEXT, -1)
    nearest = placed.where("kind <> 'blank'").select("doc_id", F.col("idx").alias("low"), F.reverse(F.collect_list(F.struct("kind", "text")).over(said)).alias("near"))
    until = lambda xs: F.array_position(F.transform(xs, lambda x: x["kind"] == "prose"), F.lit(False)).cast("int")
    text = F.transform(F.when(until(F.col("near")) > 0, F.slice("near", F.lit(1), until(F.col("near")) - 1)).otherwise(F.col("near")), lambda x: x["text"])
    headers = headers.join(nearest.select("doc_id", "low", text.alias("context")), ["doc_id", "low"], "left")

    same = F.col("declared") & (F.transform("cells", quote_key) == F.transform("own", quote_key))
    kind = F.when(F.col("kind") != "table", F.col("kind")).when(T.is_separator(F.col("text")), "separator").when(F.coalesce(same, F.lit(False)), "header").otherwise("row")
    none = F.array().cast("array<string>")
    return placed.join(headers, ["doc_id", "tbl"], "left").select("doc_id", "idx", "text", kind.alias("kind"), "tbl", "root", "cells", F.coalesce("headers", none).alias("headers"), F.coalesce("context", none).alias("context"))


def name_column(headers: Column) -> Column:
    """The column that names holders, by its header; null if none does."""
    is_name = F.transform(headers, lambda h: F.lower(h).rlike(NAME_COLUMN) & ~F.lower(h).rlike(NUMBERING))
    at = F.array_position(is_name, F.lit(True)).cast("int") - 1
    return F.when(at >= 0, at)


def rows_of(found: DataFrame) -> DataFrame:
    """doc_id, idx, root, cells and headers of the rows, those of a document in one part."""
    return found.where("kind = 'row'").select("doc_id", "idx", "root", "cells", "headers").repartition("doc_id")


def owners(found: DataFrame) -> DataFrame:
    """doc_id, idx and owner: of each row without a name the nearest row above that has one, across pages.

    Where no header tells the column of names, text above any of the row's empty cells is a name.
    """
    # Dealt by document once; every window below stays in its part.
    rows = rows_of(found).withColumn("names", name_column(F.col("headers"))).withColumn("width", F.size("cells"))
    # Only columns in which some row of that width looks for a name.
    alike = Window.partitionBy("doc_id", "root", "width")
    rows = rows.withColumn("asked", F.collect_set("names").over(alike)).withColumn("all_", F.max(F.col("names").isNull()).over(alike))
    each = rows.select("doc_id", "root", "width", "idx", "names", "asked", "all_", F.posexplode("cells").alias("col", "cell"))
    each = each.where(F.col("all_") | F.array_contains("asked", F.col("col"))).drop("asked", "all_")
    before = Window.partitionBy("doc_id", "root", "width", "col").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("above", F.last(F.when(is_text(F.col("cell")), F.col("idx")), True).over(before))
    counts = F.when(F.col("names").isNotNull(), (F.col("col") == F.col("names")) & ~is_text(F.col("cell"))).otherwise(F.trim("cell") == "")
    return each.groupBy("doc_id", "idx").agg(F.max(F.when(counts, F.col("above"))).alias("owner")).where("owner IS NOT NULL")


def bound(found: DataFrame, claims: DataFrame, scope: str = "row") -> DataFrame:
    """The claims (doc_id, idx, identity and others) with binding: the first place that names the identity.

    row, owner, header (of a column where the row has a positive number), section (a row of one text
    above), context (text above the table); with scope table any line of it, with scope headings also
    headings and the opening lines. Null where none does, or the line is no row of a table.
    """
    known = found.where("kind = 'row'").select("doc_id", "idx", "tbl", "text", "cells")
    asked = settled(claims.withColumn("claim_", F.monotonically_increasing_id()))
    # Keys and words are made once: of identities, of lines, and of a table's headers and context.
    says = known.select("doc_id", "idx", _named(F.col("text")).alias("said"))
    above = found.where("kind = 'row'").groupBy("doc_id", "tbl").agg(F.first("headers").alias("headers"), F.first("context").alias("context"))
    above = above.select("doc_id", "tbl", *[F.transform(c, _named).alias(c) for c in ("headers", "context")])
    rows = known.select("doc_id", "idx", "tbl", "cells").join(says, ["doc_id", "idx"]).join(owners(found), ["doc_id", "idx"], "left")
    rows = rows.join(says.select("doc_id", F.col("idx").alias("owner"), F.col("said").alias("owner_said")), ["doc_id", "owner"], "left").join(above, ["doc_id", "tbl"])
    own = asked.select("claim_", "doc_id", "idx", "identity", _named(F.col("identity")).alias("who")).join(rows, ["doc_id", "idx"])
    holds = lambda c: _names(F.col("who"), c)
    positive = F.exists(F.arrays_zip("cells", "headers"), lambda x: holds(x["headers"]) & F.exists(values(x["cells"]), lambda v: v > 0))
    near = F.when(holds(F.col("said")), "1row").when(F.coalesce(holds(F.col("owner_said")), F.lit(False)), "2owner").when((F.size("headers") == F.size("cells")) & positive, "3header").when(F.exists("context", holds), "5context")
    own = settled(own.select("claim_", "doc_id", "tbl", "idx", "identity", near.alias("near")))
    open_ = own.where("near IS NULL OR near = '5context'").select("claim_", "doc_id", "tbl", F.col("idx").alias("below"), "identity")
    filled = F.filter("cells", lambda c: F.trim(c) != "")
    sections = known.where((F.size(filled) == 1) & is_text(F.get(filled, F.lit(0)))).select("doc_id", "tbl", "idx", "text")
    levels = [own.select("claim_", F.col("near").alias("level")), open_.join(sections, ["doc_id", "tbl"]).where((F.col("idx") < F.col("below")) & named_in(F.col("identity"), F.col("text"))).select("claim_", F.lit("4section").alias("level"))]
    if scope in ("table", "headings"):
        levels.append(open_.join(found.where("tbl IS NOT NULL").select("doc_id", "tbl", "text"), ["doc_id", "tbl"]).where(named_in(F.col("identity"), F.col("text"))).select("claim_", F.lit("6table").alias("level")))
    if scope == "headings":
        prose = found.where("kind = 'prose'").withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")))
        titles = prose.where((F.col("nth") <= TITLE) | F.col("text").rlike(HEADING)).select("doc_id", "text")
        levels.append(open_.join(titles, "doc_id").where(named_in(F.col("identity"), F.col("text"))).select("claim_", F.lit("7heading").alias("level")))
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    best = out.groupBy("claim_").agg(F.substring(F.min("level"), 2, 9).alias("binding"))
    return asked.join(best, "claim_", "left").drop("claim_")


def column_totals(found: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, holder, root, col, n_rows and total of given rows (doc_id, idx, holder): only where every row has one number there."""
    own = rows.join(found.where("kind = 'row'").select("doc_id", "idx", "root", "cells"), ["doc_id", "idx"])
    all_rows = own.groupBy("doc_id", "holder").agg(F.count("*").alias("n_rows"))
    each = own.select("doc_id", "holder", "root", F.posexplode("cells").alias("col", "cell")).where(~is_text(F.col("cell"))).withColumn("v", values(F.col("cell"))).where(F.size("v") > 0)
    sums = each.groupBy("doc_id", "holder", "root", "col").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("most"), F.sum(F.get("v", F.lit(0))).alias("total"))
    return sums.join(all_rows, ["doc_id", "holder"]).where("n = n_rows AND most = 1").select("doc_id", "holder", "root", "col", "n_rows", "total")


def _key(cell: Column) -> Column:
    """What is compared of a cell: letters and digits, or the marker of a zero."""
    return F.when(F.lower(F.trim(cell)).isin(*ZEROS), F.trim(cell)).otherwise(quote_key(cell))


def cells_match(quoted: Column, cells: Column) -> Column:
    """Whether quoted keys stand in the keys of a row's cells in this order, each within one; a cell may hold several."""
    zero = lambda k: F.lower(k).isin(*ZEROS)
    fits = lambda k, c: (c != "") & ((k == c) | (~zero(k) & F.contains(c, k)))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("cell"), F.lit(True).alias("ok"))

    def step(s: Column, k: Column) -> Column:
        later = F.filter(F.transform(cells, lambda c, i: F.when((i >= s["at"]) & fits(k, c), i)), lambda i: i.isNotNull())
        stays = (s["cell"] != "") & ~zero(k) & F.contains(s["cell"], k)
        moved = F.transform(F.array(F.array_min(later)), lambda i: F.struct((F.coalesce(i, F.lit(0)) + 1).alias("at"), F.coalesce(F.get(cells, i), F.lit("")).alias("cell"), i.isNotNull().alias("ok")))
        return F.when(~s["ok"] | stays, s).otherwise(F.get(moved, F.lit(0)))

    return (F.size(quoted) > 0) & F.aggregate(quoted, state, step)["ok"]


def assigned(candidates: list[list[tuple[int, bool]]]) -> list[int | None]:
    """A line for each fragment from its candidates (line, whether it names the holder), none twice.

    As many fragments as can have one do, as many of those as can have a line that names the holder;
    of such assignments the one whose first fragments have the earliest lines. Fragments that share no
    line, nor through others, are settled apart.
    """
    users: dict[int, list[int]] = {}
    for f, own in enumerate(candidates):
        for line, _ in own:
            users.setdefault(line, []).append(f)
    out: list[int | None] = [None] * len(candidates)
    met: set[int] = set()
    asked: set[int] = set()
    for start in range(len(candidates)):
        if start in met:
            continue
        met.add(start)
        group, waiting = [], [start]
        while waiting:
            f = waiting.pop()
            group.append(f)
            for line, _ in candidates[f]:
                if line not in asked:
                    asked.add(line)
                    more = [g for g in users[line] if g not in met]
                    met.update(more)
                    waiting += more
        group.sort()
        own = [candidates[f] for f in group]
        wants = set(own[0])
        settled_ = _shared(wants, len(group)) if all(len(x) == len(own[0]) and set(x) == wants for x in own[1:]) else _matched(own)
        for f, line in zip(group, settled_):
            out[f] = line
    return out


def _shared(lines: set[tuple[int, bool]], n: int) -> list[int | None]:
    """assigned for n fragments with the same candidates."""
    used = sorted(line for line, _ in sorted(lines, key=lambda x: (not x[1], x[0]))[:n])
    return used + [None] * (n - len(used))


def _matched(candidates: list[list[tuple[int, bool]]]) -> list[int | None]:
    """assigned by trial: lines enter one by one, the naming ones first, if fragments can be moved along a path so that all that are in stay in."""
    naming = {line: named for own in candidates for line, named in own}
    order = sorted(naming, key=lambda line: (not naming[line], line))
    wants = [[line for line, _ in own] for own in candidates]

    def worth(fixed: dict[int, int | None]) -> tuple[int, int]:
        taken = {line for line in fixed.values() if line is not None}
        users: dict[int, list[int]] = {}
        for f, own in enumerate(wants):
            if f not in fixed:
                for line in own:
                    users.setdefault(line, []).append(f)
        held: dict[int, int] = {}

        def enter(line: int, seen: set[int]) -> bool:
            for f in users.get(line, ()):
                if f not in seen:
                    seen.add(f)
                    if f not in held or enter(held[f], seen):
                        held[f] = line
                        return True
            return False

        for line in order:
            if line not in taken:
                enter(line, set())
        used = taken | set(held.values())
        return len(used), sum(naming[line] for line in used)

    fixed: dict[int, int | None] = {}
    best = worth(fixed)
    for f, own in enumerate(wants):
        taken = {line for line in fixed.values() if line is not None}
        fixed[f] = next((line for line in sorted(set(own) - taken) if worth(fixed | {f: line}) == best), None)
    return [fixed[f] for f in range(len(wants))]


def fits(quoted: list[str], cells: list[str]) -> bool:
    """cells_match of keys at hand."""
    at, cell = 0, ""
    for k in quoted:
        zero = k.lower() in ZEROS
        if cell and not zero and k in cell:
            continue
        at = next((i + 1 for i in range(at, len(cells)) if cells[i] and (k == cells[i] or not zero and k in cells[i])), 0)
        if not at:
            return False
        cell = cells[at - 1]
    return bool(quoted)


class Rows:
    """The rows of a document (idx, keys of cells, key and words), to find those that a fragment stands in."""

    def __init__(self, rows: Iterable[tuple[int, list[str], str, str]]):
        self.rows = list(rows)
        #: All rows' keys in one text, and where each begins in it.
        self.all = "\n".join(key for _, _, key, _ in self.rows)
        self.begins = [0, *accumulate(len(key) + 1 for _, _, key, _ in self.rows)]

    def holding(self, text: str) -> Iterator[int]:
        """Numbers of the rows whose keys hold the text."""
        at = self.all.find(text)
        while at >= 0:
            i = bisect_right(self.begins, at) - 1
            yield i
            at = self.all.find(text, self.begins[i + 1])

    def candidates(self, keys: list[str], piped: bool, solid: bool, who_key: str, who_words: set[str]) -> list[tuple[int, bool]]:
        """idx and whether it names the holder of the rows that a fragment of these keys stands in."""
        if not solid or not keys:
            return []
        longest = max((k for k in keys if k.lower() not in ZEROS), key=len, default="")
        out = []
        for i in self.holding(longest) if longest else range(len(self.rows)):
            idx, cells, key, words = self.rows[i]
            if fits(keys, cells) if piped else keys[0] in key:
                named = bool(who_key and key) and (who_key == key or len(who_key) >= 4 and who_key in key or bool(who_words) and who_words <= set(words.split(" ")))
                out.append((int(idx), named))
        return out


def _placed(asked: pd.DataFrame, rows: pd.DataFrame) -> Iterator[tuple]:
    """quote_id, nth, fragment and the row of its own of every fragment of a document's quotes. A fragment meets the rows that hold its longest key."""
    known = Rows(zip(rows["idx"], (c.split("|") for c in rows["cells"]), rows["key"], rows["words"]) if len(rows) else [])
    split = lambda text, by: [x for x in (text or "").split(by) if x]
    quotes: dict = {}
    for at, quote in enumerate(asked["quote_id"]):
        quotes.setdefault(quote, []).append((asked["nth"].iat[at], at))
    for quote, parts in quotes.items():
        parts.sort()
        found = [known.candidates(split(asked["keys"].iat[at], "|"), asked["piped"].iat[at], asked["solid"].iat[at], asked["who_key"].iat[at] or "", set(split(asked["who_words"].iat[at], " "))) for _, at in parts]
        for (nth, at), idx in zip(parts, assigned(found)):
            yield quote, nth, asked["fragment"].iat[at], idx


def quotes_bound(found: DataFrame, quotes: DataFrame) -> DataFrame:
    """doc_id, quote_id, nth, fragment and idx: the row of its own that each fragment of a quote is found in, else null.

    quotes: doc_id, quote_id (one for a document), identity and quote. Line ends and ellipses part the
    fragments. One with pipes matches by its cells, another within the row's letters and digits.
    A document's fragments and rows, each once, meet in one task.
    """
    parts = F.filter(F.split(F.coalesce("quote", F.lit("")), r"\r?\n|\.{3,}|…"), lambda x: F.trim(x) != "")
    asked = quotes.select("doc_id", "quote_id", "identity", F.posexplode(parts).alias("nth", "fragment"))
    bare = F.regexp_replace(F.regexp_replace(F.trim("fragment"), r"^\|", ""), r"(?<!\\)\|$", "")
    piped = F.contains("fragment", F.lit("|"))
    keys = F.when(piped, F.filter(F.transform(F.split(bare, r"(?<!\\)\|"), _key), lambda k: k != "")).otherwise(F.array(quote_key(F.col("fragment"))))
    solid = F.col("fragment").rlike("[a-zA-ZÀ-ɏ]") | (F.size(values(F.col("fragment"))) >= 2)
    keys = F.array_join(keys, "|")
    asked = asked.select("doc_id", "quote_id", "nth", "fragment", piped.alias("piped"), keys.alias("keys"), solid.alias("solid"), quote_key(F.col("identity")).alias("who_key"), name_key(F.col("identity")).alias("who_words"))
    rows = found.where("kind = 'row'").select(F.col("doc_id").alias("held_in"), "idx", F.array_join(F.transform("cells", _key), "|").alias("cells"), quote_key(F.col("text")).alias("key"), name_key(F.col("text")).alias("words"))

    def run(key: tuple, own: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(_placed(own, lines) if len(own) else [], columns=["quote_id", "nth", "fragment", "idx"])
        return out.assign(doc_id=key[0], idx=out["idx"].astype("Int32"))[["doc_id", "quote_id", "nth", "fragment", "idx"]]

    kinds = dict(quotes.dtypes)
    return asked.groupBy("doc_id").cogroup(rows.groupBy("held_in")).applyInPandas(run, f"doc_id {kinds['doc_id']}, quote_id {kinds['quote_id']}, nth int, fragment string, idx int")
