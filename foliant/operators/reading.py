"""Evidence of one document at a time, within a task: what evidence reads from the lines of all documents, of one text.

evidence makes a row of every line and joins rows by document, so lines are written and shuffled
several times over. Where a task holds a document's text anyway nothing of it needs to leave the task:
these functions give the same lines, owners, bindings, totals and places, in memory that grows with
the document. Every pass is over the lines once; a quote's fragment is looked up in all lines' keys at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from decimal import ROUND_HALF_UP, Decimal, localcontext
from functools import lru_cache

from foliant.functions.tables import LABELS, MARGIN, SCANNED
from foliant.operators import evidence

#: Texts whose forms are kept, in each task.
KEPT = 1 << 15
_FIT = r"[^\n\r\u0085\u2028\u2029]"
_END = r"(?=(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z)"
#: The patterns of evidence, with the classes and line ends that the JVM's patterns have.
_PAGE = re.compile(rf"^<!--[ \t\n\x0b\f\r]*page:{_FIT}*-->{_END}")
_HEADING = re.compile(r"^[ \t\n\x0b\f\r]*#{1,6}[ \t\n\x0b\f\r]+[^ \t\n\x0b\f\r]")
_NAME_COLUMN = re.compile(r"holder|(?<![A-Za-z0-9_])name(?![A-Za-z0-9_])|aktion[äa]r|shareholder|actionnaire|inhaber|group|label|pool|bezeichnung|titulaire|(?<![A-Za-z0-9_])nom(?![A-Za-z0-9_])")
_NUMBERING = re.compile(rf"^[ \t\n\x0b\f\r]*(?:no|nr)\.?[ \t\n\x0b\f\r]*{_END}")
_PIPE = re.compile(r"(?<!\\)\|")
_DASHES = re.compile(rf"^:?-+:?{_END}")
_WORD = re.compile("[a-zA-ZÀ-ɏ]{2,}")
_LETTER = re.compile("[a-zA-ZÀ-ɏ]")
_NO_KEY = re.compile("[^0-9A-Za-zÀ-ɏ]+")
_WORDS = re.compile(r"[^\W_]+")
_ENTITY = re.compile(r"&#[0-9]+;|&#x[0-9a-fA-F]+;|&[a-zA-Z]+;")
_APOSTROPHE = re.compile(r"(?<=[0-9])[  ]*['’][  ]*(?=[0-9]{3}(?![0-9]))")
_BLANK = re.compile(r"(?<=[0-9])[  ](?=[0-9]{3}(?:[^0-9]|\Z))")
_NUMBER = re.compile(r"(?<!\w)[+-]?[0-9]+(?:[.,][0-9]+)*")
_COMMAS, _DOTS = re.compile(r"^[+-]?[0-9]{1,3}(?:,[0-9]{3})+\Z"), re.compile(r"^[+-]?[0-9]{1,3}(?:\.[0-9]{3}){2,}\Z")
_GROUPING = re.compile(r"[',%$€]|CHF|EUR|USD")
_NUMERIC = re.compile(rf"^[ \t\n\x0b\f\r]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\x0b\f\r]*{_END}")
_FRAGMENTS = re.compile(r"\r?\n|\.{3,}|…")


@lru_cache(KEPT)
def quote_key(text: str) -> str:
    return _NO_KEY.sub("", text).lower()


def words(text: str) -> list[str]:
    """The words of name_key."""
    return _WORDS.findall(text.lower())


_LONGEST = max(map(len, evidence.ZEROS))


def is_zero(cell: str) -> bool:
    bare = cell.strip(" ")
    return len(bare) <= _LONGEST and bare.lower() in evidence.ZEROS


def _millionths(x: str) -> int | None:
    """A number as evidence.values reads it, in millionths; null if it is none of 18 digits before the point."""
    if "," in x and "." in x:
        x = x.replace(",", "") if x.rindex(".") > x.rindex(",") else x.replace(".", "").replace(",", ".")
    elif "," in x:
        x = x.replace(",", "") if _COMMAS.match(x) else x.replace(",", ".")
    elif _DOTS.match(x):
        x = x.replace(".", "")
    if x.count(".") > 1:
        return None
    if "." not in x:
        whole = int(x) * 1_000_000
    else:
        with localcontext() as exact:
            exact.prec = len(x) + 10
            whole = int(Decimal(x).scaleb(6).to_integral_value(ROUND_HALF_UP))
    return whole if abs(whole) < 10**24 else None


@lru_cache(KEPT)
def values(cell: str) -> tuple[int, ...]:
    """The numbers that a cell states, in millionths."""
    if is_zero(cell):
        return (0,)
    text = _BLANK.sub("", _APOSTROPHE.sub("", _ENTITY.sub(" ", cell)))
    return tuple(v for x in _NUMBER.findall(text) if (v := _millionths(x)) is not None)


@lru_cache(KEPT)
def is_text(cell: str) -> bool:
    """Whether a cell says something that is no number."""
    return bool(cell.strip(" ")) and not is_zero(cell) and (bool(_WORD.search(cell)) or not values(cell))


def key(cell: str) -> str:
    """What is compared of a cell: letters and digits, or the marker of a zero."""
    return cell.strip(" ") if is_zero(cell) else quote_key(cell)


def cells(row: str) -> list[str]:
    row = row.strip(" ")
    return [c.strip(" ") for c in (_PIPE.split(row) if "\\" in row else row.split("|"))[1:-1]] if row.startswith("|") else []


def is_separator(found: list[str]) -> bool:
    return bool(found) and all(c == "" or _DASHES.match(c) for c in found)


def _numeric(cell: str) -> bool:
    if cell[:1].isalpha() and not cell.startswith(("CHF", "EUR", "USD")):
        return False
    return bool(_NUMERIC.match(_GROUPING.sub("", cell).strip(" ").lstrip("(").rstrip(")")))


def _header_at(rows: list[list[str]]) -> int:
    """Number of the row that names the columns, -1 if none stands out from the rows beneath."""
    scores = [sum(-1 if _numeric(c) else 1 for c in row if c) for row in rows]
    if not scores:
        return -1
    top = scores[:SCANNED]
    best = top.index(max(top))
    below = sorted(scores[SCANNED:] if len(scores) > SCANNED else scores[best + 1 :])
    stands_out = not below or scores[best] >= (below[(len(below) - 1) // 2] + below[len(below) // 2]) / 2 + MARGIN
    return best if sum(1 for c in rows[best] if c and not _numeric(c)) >= LABELS and stands_out else -1


class Line:
    """A line of a document; tbl and root are 0 outside tables."""

    __slots__ = ("idx", "text", "kind", "tbl", "root", "cells", "headers", "context")

    def __init__(self, idx: int, text: str, kind: str, own: list[str]):
        self.idx, self.text, self.kind, self.cells = idx, text, kind, own
        self.tbl = self.root = 0
        self.headers: list[str] = []
        self.context: list[str] = []


def lines(text: str | None) -> list[Line]:
    """evidence.lines of one text."""
    found: list[Line] = []
    for idx, own in enumerate(re.split(r"\r?\n", text or "")):
        own = own.strip(" ")
        kind = "blank" if not own else "page" if own.startswith("<") and _PAGE.search(own) else "table" if own[0] == "|" else "prose"
        found.append(Line(idx, own, kind, cells(own) if kind == "table" else []))

    tables: list[list[Line]] = []
    pages = proses = tbl = root = 0
    at_page, before, last = None, "", None
    block: list[Line] = []
    for at, line in enumerate(found):
        pages, proses = pages + (line.kind == "page"), proses + (line.kind == "prose")
        if line.kind == "page":
            at_page = proses
        if line.kind == "table":
            if before != "table":
                head, second = line.cells, found[at + 1].cells if at + 1 < len(found) and found[at + 1].kind == "table" else []
                declared = is_separator(second)
                keys = [quote_key(c) for c in head] if declared else None
                header = keys if declared and any(map(is_text, head)) and not any(c.strip(" ") and not is_text(c) for c in head) else None
                joins = goes_on = False
                if last is not None:
                    was_pages, was_proses, was_keys = last
                    joins = pages - was_pages == 1 and proses == was_proses and (header is None or header == was_keys)
                    under = pages - was_pages >= 1 and at_page == was_proses and proses - at_page <= evidence.CONTEXT
                    goes_on = under and keys is None and len(head) == len(block[-1].cells)
                if not joins:
                    tbl += 1
                    tables.append([])
                if not (joins or goes_on):
                    root += 1
                last, block = (pages, proses, keys), []
            block.append(line)
            line.tbl, line.root = tbl, root
            tables[-1].append(line)
        before = line.kind
    _head(found, tables)
    return found


def _head(found: list[Line], tables: list[list[Line]]) -> None:
    """Headers, context and kinds of the tables' lines."""
    spoken = [line for line in found if line.kind != "blank"]
    place = {line.idx: i for i, line in enumerate(spoken)}
    headers: dict[int, list[str]] = {}
    for rows in tables:
        own = [line.cells for line in rows]
        mark = next((i for i, c in enumerate(own[:SCANNED]) if is_separator(c)), -1)
        at = mark - 1 if mark >= 0 else _header_at(own)
        head = own[at] if at >= 0 else []
        numbers, texts = sum(1 for c in head if c and not is_text(c)), sum(1 for c in head if is_text(c))
        usable = bool(head) and (numbers == 0 or numbers < texts)
        declared = usable and mark >= 0
        if usable:
            headers[rows[0].root] = head
        context = []
        first = place[rows[0].idx]
        for line in reversed(spoken[max(0, first - evidence.CONTEXT) : first]):
            if line.kind != "prose":
                break
            context.append(line.text)
        keys = [quote_key(c) for c in head] if declared else None
        for line in rows:
            line.headers, line.context = headers.get(line.root, []), context
            if is_separator(line.cells):
                line.kind = "separator"
            elif declared and len(keys) == len(line.cells) and all(quote_key(c) == k for c, k in zip(line.cells, keys)):
                line.kind = "header"
            else:
                line.kind = "row"


@lru_cache(KEPT)
def _name_column(headers: tuple[str, ...]) -> int | None:
    return next((i for i, h in enumerate(headers) if _NAME_COLUMN.search(h.lower()) and not _NUMBERING.search(h.lower())), None)


def owners(found: list[Line]) -> dict[int, int]:
    """evidence.owners of one document: of a row's idx that of the row above that names it."""
    above: dict[tuple[int, int], dict[int, int]] = {}
    out = {}
    columns: dict[int, int | None] = {}
    for line in found:
        if line.kind != "row":
            continue
        if line.tbl not in columns:
            columns[line.tbl] = _name_column(tuple(line.headers))
        names, own = columns[line.tbl], above.setdefault((line.root, len(line.cells)), {})
        if names is None:
            asked = [i for i, c in enumerate(line.cells) if not c]
        else:
            asked = [names] if names < len(line.cells) and not is_text(line.cells[names]) else []
        if heads := [own[i] for i in asked if i in own]:
            out[line.idx] = max(heads)
        for i, c in enumerate(line.cells):
            if is_text(c):
                own[i] = line.idx
    return out


def named(text: str | None) -> tuple[str, set[str]]:
    """What naming compares of a text: key and words."""
    return quote_key(text or ""), set(words(text or ""))


def names(who: tuple[str, set[str]], text: str, own: set[str] | None = None) -> bool:
    """evidence.named_in of an identity's key and words and a text, its own words made if need be only."""
    of = quote_key(text)
    if not who[0] or not of:
        return False
    return who[0] == of or (len(who[0]) >= 4 and who[0] in of) or (bool(who[1]) and who[1] <= (set(words(text)) if own is None else own))


def bound(found: list[Line], claims: Iterable[tuple[int, str | None]], scope: str = "row") -> list[str | None]:
    """The binding of each claim (idx, identity), as evidence.bound has it."""
    rows = {line.idx: line for line in found if line.kind == "row"}
    owner = owners(found)
    said = {}

    def holds(who: tuple[str, set[str]], idx: int | None) -> bool:
        if idx is None or idx not in rows:
            return False
        if idx not in said:
            said[idx] = set(words(rows[idx].text))
        return names(who, rows[idx].text, said[idx])

    known = lru_cache(KEPT)(named)
    at_place: dict = {}

    def elsewhere(kind: str, identity: str | None, line: Line, texts: Iterable[str]) -> bool:
        """Whether a text that a whole table shares names the identity, looked up once for a table."""
        place = kind, line.tbl, identity
        if place not in at_place:
            at_place[place] = any(names(known(identity), t) for t in texts)
        return at_place[place]

    sections: dict[int, list[Line]] = {}
    tables: dict[int, list[str]] = {}
    for line in found:
        if line.tbl:
            tables.setdefault(line.tbl, []).append(line.text)
        if line.kind == "row" and len(filled := [c for c in line.cells if c.strip(" ")]) == 1 and is_text(filled[0]):
            sections.setdefault(line.tbl, []).append(line)
    prose = [line for line in found if line.kind == "prose"]
    titles = [line.text for nth, line in enumerate(prose, 1) if nth <= evidence.TITLE or _HEADING.search(line.text)]
    columns: dict = {}
    out: list[str | None] = []
    for idx, identity in claims:
        line = rows.get(idx)
        if line is None or identity is None:
            out.append(None)
            continue
        who = known(identity)
        if holds(who, idx):
            out.append("row")
        elif holds(who, owner.get(idx)):
            out.append("owner")
        else:
            if (line.tbl, identity) not in columns:
                columns[line.tbl, identity] = [i for i, h in enumerate(line.headers) if names(who, h)]
            asked = columns[line.tbl, identity] if len(line.headers) == len(line.cells) else []
            if any(v > 0 for i in asked for v in values(line.cells[i])):
                out.append("header")
            elif any(x.idx < idx and holds(who, x.idx) for x in sections.get(line.tbl, ())):
                out.append("section")
            elif elsewhere("context", identity, line, line.context):
                out.append("context")
            elif scope in ("table", "headings") and elsewhere("table", identity, line, tables[line.tbl]):
                out.append("table")
            elif scope == "headings" and elsewhere("heading", identity, line, titles):
                out.append("heading")
            else:
                out.append(None)
    return out


def column_totals(found: list[Line], rows: Iterable[tuple[int, str]]) -> list[tuple[str, int, int, int, int]]:
    """holder, root, col, n_rows and total in millionths of given rows (idx, holder): only where every row has one number there."""
    held = {line.idx: line for line in found if line.kind == "row"}
    n_rows: dict[str, int] = {}
    sums: dict[tuple[str, int, int], list[int]] = {}
    for idx, holder in rows:
        line = held.get(idx)
        if line is None:
            continue
        n_rows[holder] = n_rows.get(holder, 0) + 1
        for col, cell in enumerate(line.cells):
            if not is_text(cell) and (v := values(cell)):
                own = sums.setdefault((holder, line.root, col), [0, 0, 0])
                own[0] += 1
                own[1] = max(own[1], len(v))
                own[2] += v[0]
    return [(holder, root, col, n, total) for (holder, root, col), (n, most, total) in sums.items() if n == n_rows[holder] and most == 1]


def fragments(quote: str | None) -> list[str]:
    """The fragments of a quote: line ends and ellipses part them."""
    return [x for x in _FRAGMENTS.split(quote or "") if x.strip(" ")]


def asked_of(fragment: str) -> tuple[list[str], bool, bool]:
    """keys, whether it has pipes, and whether it says enough to be looked for."""
    piped = "|" in fragment
    bare = re.sub(r"(?<!\\)\|\Z", "", re.sub(r"^\|", "", fragment.strip(" ")))
    keys = [k for c in _PIPE.split(bare) if (k := key(c))] if piped else [quote_key(fragment)]
    return [k for own in keys for k in own.split("|") if k], piped, bool(_LETTER.search(fragment)) or len(values(fragment)) >= 2
