"""Markdown that is read by its headings: lists of checks, terms, reports and rosters, made of the given tables' rows and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators import outline
from foliant.plans.registry import query
from foliant.tables import table


def _joined(rows: DataFrame, doc: str, title: str, *order: str) -> DataFrame:
    """doc_id and text: a title and the lines (line) of each document in order."""
    held = F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"])
    return rows.groupBy(F.col(doc).alias("doc_id")).agg(F.concat(F.lit(title + "\n"), F.array_join(held, "\n")).alias("text"))


@query("""WITH t AS (SELECT conv_id, turn, role, trim(string_split(coalesce(text, ''), chr(10))[1]) AS first FROM conversations),
c AS (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS chapter FROM t WHERE role = 'user' OR first <> ''),
i AS (SELECT conv_id, chapter, first, row_number() OVER (PARTITION BY conv_id, chapter ORDER BY turn) AS nth FROM c WHERE role <> 'user')
SELECT conv_id, nullif(chapter, 0)::INT AS chapter, CASE WHEN chapter > 0 THEN nth END::INT AS nth, CASE WHEN chapter > 0 THEN chapter || '.' || nth END AS number, md5(first) AS check_md5, CASE WHEN chapter = 0 THEN 'item outside of chapters' END AS problem FROM i
UNION ALL SELECT conv_id, chapter::INT, NULL, NULL, NULL, 'chapter without items' FROM c WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM i WHERE i.conv_id = c.conv_id AND i.chapter = c.chapter)""")
def checklist_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters (a user's turns) and items (first lines of others) of each conversation's list, numbered as they come."""
    line = F.when(F.col("role") == "user", F.concat(F.lit("## Turn "), F.col("turn").cast("string"))).otherwise(F.concat(F.lit("1. "), F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0))))
    docs = _joined(table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line")), "conv_id", "# List", "turn")
    return outline.checks(docs).select(F.col("doc_id").alias("conv_id"), "chapter", "nth", "number", F.md5(F.col("check").cast("binary")).alias("check_md5"), "problem")


@query("""WITH t AS (SELECT conv_id, role = 'user' AS user, row_number() OVER (PARTITION BY conv_id, role = 'user' ORDER BY turn, text) AS nth, string_split(text, chr(10)) AS ls FROM conversations WHERE trim(string_split(coalesce(text, ''), chr(10))[1]) <> '')
SELECT conv_id, CASE WHEN user THEN 'Eligibility' ELSE 'Missing information' END AS section, nth::BIGINT AS nth, md5(array_to_string(list_concat([trim(ls[1])], list_transform(list_filter(ls[2:], lambda x: trim(x) <> ''), lambda x: rtrim(x))), chr(10))) AS item_md5 FROM t""")
def stated_concerns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of both sections of each conversation's report, with the lines that go on with them."""
    t = table(spark, sf_dir, "conversations").where(F.trim(F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0))) != "")
    user = F.col("role") == "user"
    nth = F.row_number().over(Window.partitionBy("conv_id", user).orderBy("turn", "text"))
    item = t.select("conv_id", (~user).cast("int").alias("part"), "turn", F.concat(nth.cast("string"), F.lit(". "), F.ltrim("text")).alias("line"))
    heads = t.select("conv_id").distinct().select("conv_id", F.inline(F.array(*[F.struct(F.lit(i).alias("part"), F.lit(-1).cast("long").alias("turn"), F.lit("## " + h).alias("line")) for i, h in enumerate(("Eligibility", "Missing information"))])))
    docs = _joined(item.withColumn("turn", F.col("turn").cast("long")).union(heads), "conv_id", "# Report", "part", "turn")
    found = outline.report_items(docs, ["Eligibility", "Missing information"])
    return found.select(F.col("doc_id").alias("conv_id"), "section", "nth", F.md5(F.col("item").cast("binary")).alias("item_md5"))


_TERM = """CASE p_size % 5 WHEN 0 THEN 'number' WHEN 1 THEN 'string' WHEN 2 THEN 'enum: pre | post' WHEN 3 THEN 'enum list' ELSE 'thing' END"""


@query(f"""WITH t AS (SELECT p_partkey // 50 AS doc_id, p_type, p_partkey, replace(p_name, ' ', '_') AS name, {_TERM} AS spec, p_size % 7 > 0 AS said FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY p_type, p_partkey) AS nth FROM t)
SELECT doc_id, name, string_split(spec, ':')[1] AS kind, CASE WHEN contains(spec, ':') THEN 'pre|post' ELSE '' END AS members, p_type AS grp, CASE WHEN said THEN 'As for ' || p_type || '. Number ' || p_partkey || '.' ELSE '' END AS guidance,
  CASE WHEN nth > 1 THEN 'name came before' WHEN spec = 'thing' THEN 'unknown type' WHEN spec = 'enum list' THEN 'enum without members' WHEN NOT said THEN 'no guidance' END AS problem FROM n""")
def term_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms with type, members, group and guidance from lists of fifty parts each, and what is wrong with them."""
    p = table(spark, sf_dir, "part").withColumn("doc", F.floor(F.col("p_partkey") / 50))
    head = F.concat(F.lit("### "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" ("), F.expr(_TERM), F.lit(")"))
    guidance = F.when(F.col("p_size") % 7 > 0, F.concat(F.lit("\nAs for "), "p_type", F.lit(".\n\n  Number "), F.col("p_partkey").cast("string"), F.lit("."))).otherwise("")
    first = F.col("p_partkey") == F.min("p_partkey").over(Window.partitionBy("doc", "p_type"))
    line = F.concat(F.when(first, F.concat(F.lit("## "), "p_type", F.lit("\n"))).otherwise(""), head, guidance)
    docs = _joined(p.select("doc", "p_type", "p_partkey", line.alias("line")), "doc", "# Terms", "p_type", "p_partkey")
    return outline.terms(docs).select("doc_id", "name", "kind", F.array_join("members", "|").alias("members"), "grp", "guidance", "problem")


@query("""WITH r AS (SELECT c_custkey // 50 AS doc_id, c_custkey, c_name, CASE WHEN c_acctbal >= 0 THEN 'p-' || c_nationkey ELSE '' END AS profile, CASE WHEN c_acctbal < 0 THEN lower(c_mktsegment) || '@x.org' ELSE '' END AS mail FROM customer)
SELECT doc_id, c_name AS full_name, profile, mail AS emails FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, profile, mail ORDER BY c_custkey) = 1""")
def roster_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of tables in Markdown, fifty customers each; a profile or an address counts once."""
    mail, site = F.when(F.col("c_acctbal") < 0, F.concat(F.lower("c_mktsegment"), F.lit("@X.org"))).otherwise(""), F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("https://www.linkedin.com/in/P-"), F.col("c_nationkey").cast("string"), F.lit("/"))).otherwise("")
    line = F.concat(F.lit("| "), "c_name", F.lit(" | "), site, F.lit(" | "), mail, F.lit(" |"))
    rows = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 50).alias("doc"), "c_custkey", line.alias("line"))
    docs = _joined(rows, "doc", "# People\n\n| Full name | LinkedIn ID | Email addresses |\n|---|---|---|", "c_custkey")
    return outline.rosters(docs).select("doc_id", "full_name", "profile", F.array_join("emails", ",").alias("emails"))


@query("""WITH r AS (SELECT c_custkey // 50 AS doc_id, c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal >= 0 THEN 'p-' || c_nationkey ELSE '' END AS profile, CASE WHEN c_acctbal < 0 THEN lower(c_mktsegment) || '@x.org' ELSE '' END AS mail FROM customer),
k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, profile, mail ORDER BY c_custkey) = 1)
SELECT doc_id, c_name AS full_name, profile, n_name AS stored, CASE WHEN profile = '' THEN 'no profile' WHEN n_name IS NULL THEN 'not stored' ELSE 'stored' END AS state FROM k LEFT JOIN nation ON profile = 'p-' || n_nationkey AND n_regionkey < 4""")
def roster_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of rosters with the profiles that are stored of them (nations of four regions)."""
    people = roster_tables(spark, sf_dir)
    stored = table(spark, sf_dir, "nation").where("n_regionkey < 4").select(F.concat(F.lit("p-"), F.col("n_nationkey").cast("string")).alias("profile"), F.col("n_name").alias("stored"))
    state = F.when(F.col("profile") == "", "no profile").when(F.col("stored").isNull(), "not stored").otherwise("stored")
    return people.join(stored, "profile", "left").select("doc_id", "full_name", "profile", "stored", state.alias("state"))
