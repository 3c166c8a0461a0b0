"""Documents read by their headings: outlines, lists of checks, terms, reports and rosters in Markdown.

A line's place is the stack of headings that it stands below: for each level the last heading that no
heading of a higher level has come after. Six running values by document and line give it, without
growing strings; what stands below a heading is joined once.

Cases: null and empty texts have one blank line. What a grammar does not allow is a problem with the
number of its line (from 1), beside what could be read. doc_id is unique and not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import tables as T
from foliant.functions.text import slug

#: Types of terms (fixed values).
KINDS = ("string", "number", "boolean", "presence boolean", "enum", "enum list")


def outline(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 1), text, level (of a heading, else null), heads (line of the heading of each level, or null) and path (their titles)."""
    own = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    mark = F.regexp_extract("text", r"^(#{1,6})\s+\S", 1)
    own = own.withColumn("level", F.when(mark != "", F.length(mark))).withColumn("title", F.when(mark != "", F.trim(F.regexp_replace("text", r"^#{1,6}\s+", ""))))
    so_far = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("level") == k, F.struct("line", "title")), True).over(so_far) for k in range(1, 7)]
    own = own.select("doc_id", "line", "text", "level", F.array(*last).alias("last"))
    # A heading of a higher level that came later closes those below it.
    above = lambda i: F.coalesce(F.array_max(F.transform(F.slice("last", F.lit(1), i), lambda x: x["line"])), F.lit(0))
    stack = F.transform("last", lambda x, i: F.when(x["line"] > above(i), x))
    own = own.withColumn("stack", stack)
    return own.select("doc_id", "line", "text", "level", F.transform("stack", lambda x: x["line"]).alias("heads"), F.transform(F.array_compact("stack"), lambda x: x["title"]).alias("path"))


def _bodies(found: DataFrame, level: int) -> DataFrame:
    """doc_id, head and body: the text below each heading of a level up to the next of that or a higher one, as an array of lines that are not blank."""
    own = found.where((F.trim("text") != "") & (F.col("level").isNull() | (F.col("level") > level))).select("doc_id", "line", "text", F.get("heads", F.lit(level - 1)).alias("head")).where("head IS NOT NULL")
    return own.groupBy("doc_id", "head").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("body"))


def checks(docs: DataFrame) -> DataFrame:
    """doc_id, line, chapter, nth, number, title, check and problem: items (- or 1.) below second-level headings, numbered as they come.

    Problems: an item outside of chapters, a chapter without items.
    """
    found = outline(docs)
    item = F.regexp_extract("text", r"^\s{0,3}(?:[-*+]|\d+[.)])\s+(\S.*)$", 1)
    chapter_line = F.get("heads", F.lit(1))
    chapters = found.where("level = 2").select("doc_id", F.col("line").alias("head"), F.element_at("path", -1).alias("title"), F.row_number().over(Window.partitionBy("doc_id").orderBy("line")).alias("chapter"))
    items = found.where(F.col("level").isNull() & (item != "")).select("doc_id", "line", F.trim(item).alias("check"), chapter_line.alias("head"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "head").orderBy("line"))
    placed = chapters.join(items.withColumn("nth", F.when(F.col("head").isNotNull(), nth)), ["doc_id", "head"], "full")
    problem = F.when(F.col("chapter").isNull(), "item outside of chapters").when(F.col("check").isNull(), "chapter without items")
    number = F.when(problem.isNull(), F.concat_ws(".", F.col("chapter").cast("string"), F.col("nth").cast("string")))
    return placed.select("doc_id", F.coalesce("line", "head").alias("line"), "chapter", F.when(F.col("chapter").isNotNull(), F.col("nth")).alias("nth"), number.alias("number"), "title", "check", problem.alias("problem"))


def terms(docs: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """doc_id, line, name, kind, members, grp, guidance and problem of third-level headings like ### name (type: a | b).

    Problems: a heading of another form, a name that came before, an unknown type, an enum without members, no guidance.
    """
    found = outline(docs)
    head = found.where("level = 3").select("doc_id", "line", F.element_at("path", -1).alias("title"), F.get("heads", F.lit(1)).alias("above"))
    group = found.where("level = 2").select("doc_id", F.col("line").alias("above"), F.element_at("path", -1).alias("grp"))
    form = r"^`?([a-z][a-z0-9_]*)`?\s*\(([^()]+)\)$"
    name, spec = F.regexp_extract("title", form, 1), F.regexp_extract("title", form, 2)
    members = F.when(F.contains(spec, F.lit(":")), F.filter(F.transform(F.split(F.regexp_replace(spec, "^[^:]*:", ""), r"\|"), lambda x: F.trim(x)), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    own = head.join(group, ["doc_id", "above"], "left").join(_bodies(found, 3).withColumnRenamed("head", "line"), ["doc_id", "line"], "left")
    own = own.select("doc_id", "line", name.alias("name"), F.trim(F.split_part(spec, F.lit(":"), F.lit(1))).alias("kind"), members.alias("members"), F.coalesce("grp", F.lit("")).alias("grp"), F.array_join(F.transform(F.coalesce("body", F.array().cast("array<string>")), lambda x: F.trim(x)), " ").alias("guidance"))
    again = F.row_number().over(Window.partitionBy("doc_id", "name").orderBy("line")) > 1
    problem = (
        F.when(F.col("name") == "", "malformed heading").when(again, "name came before").when(~F.col("kind").isin(*kinds), "unknown type")
        .when(F.col("kind").startswith("enum") & (F.size("members") == 0), "enum without members").when(F.col("guidance") == "", "no guidance")
    )
    return own.withColumn("problem", problem)


def report_items(docs: DataFrame, sections: list[str]) -> DataFrame:
    """doc_id, section, nth and item: the numbered items below given second-level headings; lines that follow belong to the item before."""
    found = outline(docs)
    own = found.where(F.get("path", F.lit(1)).isin(*sections) | ((F.size("path") == 1) & F.element_at("path", 1).isin(*sections))).where("level IS NULL")
    own = own.withColumn("section", F.element_at("path", -1)).withColumn("head", F.get("heads", F.lit(1)))
    first = F.regexp_extract("text", r"^\d+\.\s+(\S.*)$", 1)
    running = Window.partitionBy("doc_id", "head").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("nth", F.sum((first != "").cast("int")).over(running)).where((F.col("nth") > 0) & (F.trim("text") != ""))
    text = F.when(first != "", F.trim(first)).otherwise(F.rtrim("text"))
    held = F.transform(F.array_sort(F.collect_list(F.struct("line", text.alias("text")))), lambda x: x["text"])
    return own.groupBy("doc_id", "section", "head", "nth").agg(F.array_join(held, "\n").alias("item")).select("doc_id", "section", "nth", "item")


def proposed_action(docs: DataFrame, prefix: str = "Proposed action:") -> DataFrame:
    """doc_id and action: what the first line with the prefix says; null without one."""
    said = outline(docs).where(F.col("text").startswith(prefix))
    first = said.groupBy("doc_id").agg(F.min_by("text", "line").alias("text"))
    return docs.select("doc_id").join(first.select("doc_id", F.trim(F.substring("text", F.lit(len(prefix) + 1), F.length("text"))).alias("action")), "doc_id", "left")


def rosters(docs: DataFrame) -> DataFrame:
    """doc_id, line, full_name, profile and emails: people in tables with the columns full name and profile id, and in lines that are a profile's address.

    A profile, or else the addresses, or else the name, that came before in the document is not repeated.
    """
    found = outline(docs).select("doc_id", "line", F.trim("text").alias("text")).where("text <> '' AND NOT startswith(text, '#')")
    key = lambda c: slug(F.replace(c, F.lit("_"), F.lit(" ")))
    cells = F.transform(T.cells(F.col("text")), lambda c: F.replace(F.replace(c, F.lit("\\_"), F.lit("_")), F.lit("\\-"), F.lit("-")))
    rows = found.where(F.col("text").startswith("|") & F.col("text").endswith("|")).select("doc_id", "line", cells.alias("cells"))
    rows = rows.withColumn("keys", F.transform("cells", key))
    header = rows.where(F.array_contains("keys", "full-name") & F.array_contains("keys", "linkedin-id")).groupBy("doc_id").agg(F.min("line").alias("at"), F.min_by("keys", "line").alias("header"))
    body = rows.join(header, "doc_id").where((F.col("line") > F.col("at")) & ~F.forall("cells", lambda c: c.rlike("^[-:]*$")))
    cell = lambda name: F.coalesce(F.get("cells", F.array_position("header", name).cast("int") - 1), F.lit(""))
    at = r"(?i)linkedin\.com/(?:in|pub)/([^/?#\s]+)"
    own_id = lambda c: F.when(F.contains(F.lower(c), F.lit("linkedin.com/")), F.lower(F.regexp_extract(c, at, 1))).otherwise(slug(c))
    mails = F.array_distinct(F.regexp_extract_all(F.lower(cell("email-addresses")), F.lit(r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"), F.lit(0)))
    listed = body.select("doc_id", "line", cell("full-name").alias("full_name"), own_id(cell("linkedin-id")).alias("profile"), mails.alias("emails"))
    none = F.array().cast("array<string>")
    linked = found.where(F.col("text").rlike(r"(?i)^https?://.*linkedin\.com/")).select("doc_id", "line", F.lit("").alias("full_name"), F.lower(F.regexp_extract("text", at, 1)).alias("profile"), none.alias("emails"))
    every = listed.union(linked).where((F.col("full_name") != "") | (F.col("profile") != "") | (F.size("emails") > 0))
    who = F.when(F.col("profile") != "", F.col("profile")).when(F.size("emails") > 0, F.array_join("emails", ",")).otherwise(F.concat(F.lit("name:"), slug(F.col("full_name"))))
    every = every.withColumn("who", who).withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "who").orderBy("line")))
    return every.where("nth = 1").select("doc_id", "line", "full_name", "profile", "emails")
