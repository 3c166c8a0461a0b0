"""Web pages and applications: visible blocks, spam labels, company websites, links to files, rendered answers, payloads, scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.tables import cells
from foliant.functions.text import slug
from foliant.plans.registry import query
from foliant.tables import table

_HIDDEN = r"(?s)<(script|style|noscript|svg)[^>]*>.*?</(script|style|noscript|svg)>"


@query(f"""WITH h AS (SELECT page_id, regexp_replace(html, '{_HIDDEN}', ' ', 'g') AS b FROM pages),
t AS (SELECT page_id, list_zip(regexp_extract_all(b, '(?s)<(h[1-6]|li|blockquote|td|p)[^>]*>([^<]*)', 1), regexp_extract_all(b, '(?s)<(h[1-6]|li|blockquote|td|p)[^>]*>([^<]*)', 2)) AS z FROM h),
m AS (SELECT page_id, list_filter(list_transform(z, lambda x: CASE WHEN starts_with(x[1], 'h') THEN repeat('#', x[1][2]::INT) || ' ' WHEN x[1] = 'li' THEN '- ' WHEN x[1] = 'blockquote' THEN '> ' ELSE '' END || trim(regexp_replace(x[2], '\\s+', ' ', 'g'))), lambda s: NOT regexp_matches(s, '^[#>-]* ?$')) AS blocks FROM t)
SELECT page_id, len(blocks)::INT AS n_blocks, md5(array_to_string(blocks, chr(10))) AS markdown_md5 FROM m""")
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible blocks of each page in order as Markdown: headings, list items, quotes, cells, paragraphs."""
    shown = F.regexp_replace("html", _HIDDEN, " ")
    open_ = F.lit(r"(?s)<(h[1-6]|li|blockquote|td|p)[^>]*>([^<]*)")
    z = F.arrays_zip(F.regexp_extract_all("b", open_, F.lit(1)).alias("tag"), F.regexp_extract_all("b", open_, F.lit(2)).alias("text"))
    mark = lambda t: F.when(t.startswith("h"), F.concat(F.repeat(F.lit("#"), F.substring(t, 2, 1).cast("int")), F.lit(" "))).when(t == "li", "- ").when(t == "blockquote", "> ").otherwise("")
    blocks = F.filter(F.transform(z, lambda x: F.concat(mark(x["tag"]), F.trim(F.regexp_replace(x["text"], r"\s+", " ")))), lambda s: ~s.rlike("^[#>-]* ?$"))
    m = table(spark, sf_dir, "pages").select("page_id", shown.alias("b")).select("page_id", blocks.alias("m"))
    return m.select("page_id", F.size("m").alias("n_blocks"), F.md5(F.array_join("m", "\n").cast("binary")).alias("markdown_md5"))


#: Labels of gambling spam, words of a label that may be cut out, characters that a page keeps at least (fixed values of the policy here).
_SPAM, _WORDS, _LEAST = "casino|cheap|jackpot|bet now", 6, 80


@query(f"""WITH b AS (SELECT page_id, lower(regexp_extract(html, '(?s)<(?:title|h1)[^>]*>([^<]*)', 1)) AS head, list_filter(list_transform(string_split_regex(regexp_replace(html, '{_HIDDEN}', ' ', 'g'), '<[^>]*>'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS nodes FROM pages),
s AS (SELECT *, list_filter(nodes, lambda x: regexp_matches(lower(x), '{_SPAM}')) AS bad, list_filter(nodes, lambda x: NOT regexp_matches(lower(x), '{_SPAM}')) AS good FROM b)
SELECT page_id, CASE WHEN regexp_matches(head, '{_SPAM}') THEN 'promotion' WHEN len(list_filter(bad, lambda x: len(string_split(x, ' ')) > {_WORDS})) > 0 THEN 'not isolated'
  WHEN len(bad) > 0 AND (length(array_to_string(good, ' ')) < {_LEAST} OR length(array_to_string(good, ' ')) < length(array_to_string(nodes, ' ')) / 2) THEN 'mostly spam' WHEN len(bad) > 0 THEN 'cleaned' ELSE 'clean' END AS verdict, len(bad)::INT AS removed FROM s""")
def spam_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages turned away for promotion in their heading or spam that cannot be cut out; short spam labels go."""
    spam = lambda x: F.lower(x).rlike(_SPAM)
    nodes = F.filter(F.transform(F.split(F.regexp_replace("html", _HIDDEN, " "), "<[^>]*>"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?s)<(?:title|h1)[^>]*>([^<]*)", 1).alias("head"), nodes.alias("nodes"))
    s = p.withColumns({"bad": F.filter("nodes", spam), "good": F.array_join(F.filter("nodes", lambda x: ~spam(x)), " ")})
    some, left = F.size("bad") > 0, F.length("good")
    verdict = F.when(spam(F.col("head")), "promotion").when(F.exists("bad", lambda x: F.size(F.split(x, " ")) > _WORDS), "not isolated").when(some & ((left < _LEAST) | (left < F.length(F.array_join("nodes", " ")) / 2)), "mostly spam").when(some, "cleaned").otherwise("clean")
    return s.select("page_id", verdict.alias("verdict"), F.size("bad").alias("removed"))


@query("""WITH c AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, page_id, url FROM pages), e AS (SELECT page_id // 10 AS company, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, host, contains(host, 'thther') OR contains(host, 'the') AS named, page_id % 3 = 0 AS labelled FROM c WHERE NOT (host = 'example.net' OR ends_with(host, '.example.net'))),
s AS (SELECT company, origin, max(2 * named::INT + labelled::INT) AS score FROM e GROUP BY ALL), b AS (SELECT *, rank() OVER (PARTITION BY company ORDER BY score DESC) AS r, FROM s WHERE score > 0)
SELECT company, min(origin) AS website, max(score)::INT AS score FROM b WHERE r = 1 GROUP BY company HAVING count(*) = 1""")
def company_websites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A company's website from what mentions it: two points for the name in the host, one for a label; a tie gives none."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    p = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 10).alias("company"), F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1).alias("origin"), host.alias("host"), (F.col("page_id") % 3 == 0).cast("int").alias("labelled"))
    e = p.where(~((F.col("host") == "example.net") | F.col("host").endswith(".example.net")))
    named = (F.contains("host", F.lit("thther")) | F.contains("host", F.lit("the"))).cast("int")
    s = e.groupBy("company", "origin").agg(F.max(2 * named + F.col("labelled")).alias("score")).where("score > 0")
    best = s.withColumn("r", F.rank().over(Window.partitionBy("company").orderBy(F.desc("score")))).where("r = 1")
    return best.groupBy("company").agg(F.min("origin").alias("website"), F.max("score").alias("score"), F.count("*").alias("n")).where("n = 1").drop("n")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, answers (map): an application's answers, one with links to files."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    links = F.concat(F.lit("see https://files.crm/a/"), key, F.lit(" and https://files.crm/b/"), F.col("o_custkey").cast("string"), F.lit(", also https://files.crm/a/"), key, F.lit(" or https://other.org/x"))
    return o.select("o_orderkey", F.create_map(F.lit("Team"), "o_orderpriority", F.lit("Deck"), links, F.lit("Note"), F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus"))).alias("answers"))


@query("""SELECT o_orderkey, unnest([1, 2]) AS position, unnest(['https://files.crm/a/' || o_orderkey, 'https://files.crm/b/' || o_custkey]) AS link FROM orders""")
def file_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to the CRM's own files out of an application's answers, each once, in order."""
    text = F.array_join(F.transform(F.array_sort(F.map_entries("answers")), lambda e: e["value"]), " ")
    links = F.array_distinct(F.regexp_extract_all(text, F.lit(r"https://files\.crm/[\w/]+"), F.lit(0)))
    return answers(spark, sf_dir).select("o_orderkey", F.posexplode(links).alias("n", "link")).select("o_orderkey", (F.col("n") + 1).alias("position"), "link")


@query("""SELECT o_orderkey, md5('## Deck' || chr(10) || 'see https://files.crm/a/' || o_orderkey || ' and https://files.crm/b/' || o_custkey || ', also https://files.crm/a/' || o_orderkey || ' or https://other.org/x' || CASE WHEN o_orderstatus = 'F' THEN '' ELSE chr(10) || chr(10) || '## Note' || chr(10) || o_orderstatus END || chr(10) || chr(10) || '## Team' || chr(10) || o_orderpriority) AS markdown_md5 FROM orders""")
def application_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An application's answers that are not empty as sections, by key."""
    kept = F.map_filter("answers", lambda _, v: F.trim(v) != "")
    sections = F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(F.lit("## "), e["key"], F.lit("\n"), e["value"]))
    return answers(spark, sf_dir).select("o_orderkey", F.md5(F.array_join(sections, "\n\n").cast("binary")).alias("markdown_md5"))


@query("""WITH old AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'O'), new AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus <> 'P')
SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey, count(*) FILTER (o.o_orderkey IS NULL)::BIGINT AS added, count(*) FILTER (n.o_orderkey IS NULL)::BIGINT AS stale, count(*) FILTER (o.o_totalprice <> n.o_totalprice)::BIGINT AS changed FROM old o FULL JOIN new n USING (o_orderkey) GROUP BY 1""")
def snapshot_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import against the snapshot before: files that are new, stale or changed, by applicant."""
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderstatus <> 'O'").select("o_orderkey", F.col("o_custkey").alias("c1"), F.col("o_totalprice").alias("p1"))
    new = o.where("o_orderstatus <> 'P'").select("o_orderkey", F.col("o_custkey").alias("c2"), F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("p2"))
    return old.join(new, "o_orderkey", "full").groupBy(F.coalesce("c1", "c2").alias("o_custkey")).agg(F.count_if(F.col("c1").isNull()).alias("added"), F.count_if(F.col("c2").isNull()).alias("stale"), F.count_if(F.col("p1") != F.col("p2")).alias("changed"))


@query("""WITH a AS (SELECT n_name AS name, regexp_replace(lower(n_name), '[^a-z0-9_]+', '-', 'g') AS s, r_name AS domain FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT name, domain FROM a WHERE domain IN ('ASIA', 'EUROPE', 'AMERICA') AND s NOT IN ('nation_2', 'nation_7')""")
def dataset_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets of the domains asked for, without excluded ones; an excluded name that is unknown is an error."""
    a = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), slug(F.col("n_name")).alias("s"), F.col("r_name").alias("domain"))
    excluded = spark.createDataFrame([("nation_2",), ("nation_7",)], "s string")
    known = excluded.join(a.select("s", F.lit(1).alias("held")), "s", "left").select(F.when(F.col("held").isNull(), F.raise_error(F.concat(F.lit("unknown dataset "), "s"))).otherwise(F.col("s")).alias("s"))
    return a.where(F.col("domain").isin("ASIA", "EUROPE", "AMERICA")).join(known, "s", "left_anti").select("name", "domain")


@query("""SELECT regexp_replace(lower(n_name), '[^a-z0-9_]+', '-', 'g') AS slug, count(*) + CASE WHEN n_name = 'NATION_3' THEN 1 ELSE 0 END AS places, count(*) + CASE WHEN n_name = 'NATION_3' THEN 1 ELSE 0 END = 1 AS found FROM nation GROUP BY n_name""")
def dataset_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a dataset lies: in exactly one domain, or it is not found."""
    n = table(spark, sf_dir, "nation").select(slug(F.col("n_name")).alias("slug"))
    every = n.union(n.where("slug = 'nation_3'"))
    return every.groupBy("slug").agg(F.count("*").alias("places")).withColumn("found", F.col("places") == 1)


@query("""WITH m AS (SELECT CASE WHEN n_chars % 7 = 0 THEN 'no model' WHEN n_chars % 5 = 0 THEN 'old settings' WHEN lang = 'fr' THEN 'unknown path' ELSE 'migrated' END AS reason, text FROM documents)
SELECT reason, count(*)::BIGINT AS n, (count(*) - count(DISTINCT text))::BIGINT AS duplicates FROM m GROUP BY reason""")
def migration_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Migrated entries by reason, and how many are duplicates of others."""
    n = F.col("n_chars")
    reason = F.when(n % 7 == 0, "no model").when(n % 5 == 0, "old settings").when(F.col("lang") == "fr", "unknown path").otherwise("migrated")
    m = table(spark, sf_dir, "documents").select(reason.alias("reason"), F.md5(F.col("text").cast("binary")).alias("h"))
    by = m.groupBy("reason", "h").agg(F.count("*").alias("n"))
    return by.groupBy("reason").agg(F.sum("n").alias("n"), (F.sum("n") - F.count("h")).alias("duplicates"))


@query("""WITH r AS (SELECT p_partkey, '| ' || p_name || ' | ' || lower(replace(p_name, ' ', '.')) || '@x.org | ' || p_brand || ' |' AS line FROM part)
SELECT p_partkey, string_split(line, ' | ')[1][3:] AS full_name, string_split(line, ' | ')[2] AS email, rtrim(string_split(line, ' | ')[3], ' |') AS extra FROM r""")
def person_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of Markdown person tables read back: name, address, and other columns by their heading."""


    head = cells(F.lit("| Name | E-mail | Brand |"))
    line = F.concat(F.lit("| "), "p_name", F.lit(" | "), F.lower(F.replace("p_name", F.lit(" "), F.lit("."))), F.lit("@x.org | "), "p_brand", F.lit(" |"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.map_from_arrays(F.transform(head, lambda h: slug(h)), cells(line)).alias("m"))
    return rows.select("p_partkey", F.col("m")["name"].alias("full_name"), F.col("m")["e-mail"].alias("email"), F.col("m")["brand"].alias("extra"))
