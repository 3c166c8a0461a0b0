"""Rules as data: nested conditions become three-valued columns, with what they lack.

A rule is a dict: item, severity, active and when, a condition. Conditions nest:

    {"input": name, "min": a, "max": b}      within a band, both ends belong to it, either may be absent
    {"input": name, "above": a, "below": b}  beyond a bound, which does not belong to it
    {"input": name, "in": [values]}          one of some values
    {"input": name, "has": value}            an array holds a value; an empty one is unknown
    {"ratio": [over, under], ...bounds}      of two inputs; unknown where the second is 0
    {"all": [...]}, {"any": [...]}, {"not": condition}
    {"strict": condition}                    unknown as soon as one of its inputs is

Unknown inputs are null. As in Kleene's logic a false part decides "all" and a true one "any",
whatever is unknown beside it. Rules without a condition, or inactive ones, are open questions;
those whose condition is unknown are not evaluated. All rules of a table are one expression over
the inputs' columns; what they share is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Condition = dict

#: Bounds of a number: name, and comparison in both forms.
BOUNDS = {"min": (lambda x, b: x >= b, ">="), "max": (lambda x, b: x <= b, "<="), "above": (lambda x, b: x > b, ">"), "below": (lambda x, b: x < b, "<")}
KINDS = ("all", "any", "not", "strict", "ratio", "input")


def kind(node: Condition) -> str:
    """Which condition a node is; a malformed one is an error."""
    found = [k for k in KINDS if k in node]
    tests = [k for k in node if k in (*BOUNDS, "in", "has")]
    if len(found) != 1 or set(node) - {*found, *tests} or (found[0] in ("input", "ratio")) != bool(tests) or ("in" in tests or "has" in tests) and (len(tests) > 1 or found[0] == "ratio"):
        raise ValueError(f"no condition: {node}")
    return found[0]


def inputs(node: Condition) -> list[str]:
    """The inputs of a condition, each once, in order."""
    of = kind(node)
    if of == "input":
        return [node["input"]]
    if of == "ratio":
        return list(dict.fromkeys(node["ratio"]))
    parts = node[of] if of in ("all", "any") else [node[of]]
    return list(dict.fromkeys(name for part in parts for name in inputs(part)))


def compiled(node: Condition) -> Column:
    """The condition as a column: true, false or null."""
    of = kind(node)
    if of in ("all", "any"):
        out = F.lit(of == "all")
        for part in node[of]:
            out = out & compiled(part) if of == "all" else out | compiled(part)
        return out
    if of == "not":
        return ~compiled(node["not"])
    if of == "strict":
        known = F.lit(True)
        for name in inputs(node):
            known = known & F.col(name).isNotNull()
        return F.when(known, compiled(node["strict"]))
    if "in" in node:
        return F.col(node["input"]).isin(*node["in"]) if node["in"] else F.when(F.col(node["input"]).isNotNull(), F.lit(False))
    if "has" in node:
        return F.when(F.size(node["input"]) > 0, F.array_contains(node["input"], node["has"]))
    value = F.col(node["input"]) if of == "input" else F.col(node["ratio"][0]) / F.when(F.col(node["ratio"][1]) != 0, F.col(node["ratio"][1]))
    out = F.lit(True)
    for bound, (test, _) in BOUNDS.items():
        if bound in node:
            out = out & test(value, F.lit(node[bound]))
    return out


def sql(node: Condition) -> str:
    """The condition as SQL; arrays' inputs are null where they are unknown."""
    of, text = kind(node), lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v!r}::DOUBLE"
    if of in ("all", "any"):
        return "(" + f" {'AND' if of == 'all' else 'OR'} ".join([str(of == "all").upper(), *map(sql, node[of])]) + ")"
    if of == "not":
        return f"(NOT {sql(node['not'])})"
    if of == "strict":
        return f"(CASE WHEN {' AND '.join(['TRUE', *[f'{n} IS NOT NULL' for n in inputs(node)]])} THEN {sql(node['strict'])} END)"
    if "in" in node:
        return f"({node['input']} IN ({', '.join(map(text, node['in']))}))" if node["in"] else f"(CASE WHEN {node['input']} IS NOT NULL THEN FALSE END)"
    if "has" in node:
        return f"(CASE WHEN len({node['input']}) > 0 THEN list_contains({node['input']}, {text(node['has'])}) END)"
    value = node["input"] if of == "input" else f"({node['ratio'][0]} / nullif({node['ratio'][1]}, 0))"
    return "(" + " AND ".join(f"{value} {sign} {text(node[b])}" for b, (_, sign) in BOUNDS.items() if b in node) + ")"


def findings(rows: DataFrame, keys: list[str], rules: list[dict]) -> DataFrame:
    """keys, item, status, severity and missing: every row against every rule.

    status: flagged or acceptable; not evaluated where the condition is unknown, with the inputs that
    are missing; open question where the rule is inactive or has no condition.
    """
    none = F.array().cast("array<string>")
    each = []
    for rule in rules:
        node = rule.get("when")
        verdict = compiled(node) if node else F.lit(None).cast("boolean")
        lacks = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in inputs(node)])) if node else none
        open_ = F.lit(not node) | (F.lit(not rule.get("active", True)) & verdict.isNotNull())
        status = F.when(open_, "open question").when(verdict.isNull(), "not evaluated").when(verdict, "flagged").otherwise("acceptable")
        each.append(F.struct(F.lit(rule["item"]).alias("item"), status.alias("status"), F.when(status == "flagged", F.lit(rule["severity"])).otherwise("info").alias("severity"), F.when(status == "not evaluated", lacks).otherwise(none).alias("missing")))
    return rows.select(*keys, F.inline(F.array(*each)))


def findings_sql(source: str, keys: list[str], rules: list[dict]) -> str:
    """The same in DuckDB over a source of the inputs' columns; missing is one string."""
    parts = []
    for rule in rules:
        node = rule.get("when")
        verdict = sql(node) if node else "NULL::BOOLEAN"
        lacks = "concat_ws(',', " + ", ".join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in inputs(node)) + ")" if node and inputs(node) else "''"
        open_ = "TRUE" if not node else "FALSE" if rule.get("active", True) else "v IS NOT NULL"
        parts.append(f"SELECT {', '.join(keys)}, '{rule['item']}' AS item, CASE WHEN {open_} THEN 'open question' WHEN v IS NULL THEN 'not evaluated' WHEN v THEN 'flagged' ELSE 'acceptable' END AS status, '{rule['severity']}' AS severe, lacks FROM (SELECT *, {verdict} AS v, {lacks} AS lacks FROM {source})")
    return f"SELECT {', '.join(keys)}, item, status, CASE WHEN status = 'flagged' THEN severe ELSE 'info' END AS severity, CASE WHEN status = 'not evaluated' THEN lacks ELSE '' END AS missing FROM ({' UNION ALL '.join(parts)})"
