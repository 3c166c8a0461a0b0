"""Reviews of extractions, evidence and runs; resolutions by cascades; rendered and flattened tables; leases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.plans.registry import query
from foliant.tables import table


@query("""WITH d AS (SELECT o_orderkey, o_custkey, o_orderkey % 97 AS borrower, o_custkey % 97 AS lender, o_totalprice > 100000 AS quoted, o_orderstatus = 'P' AS unstated FROM orders)
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT quoted AND NOT unstated THEN 'quote not found' END, CASE WHEN borrower = lender THEN 'borrower is lender' END, CASE WHEN unstated AND quoted THEN 'absent term has a quote' END], lambda x: x IS NOT NULL), '; ') AS problems FROM d""")
def loan_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loan extractions: positive terms need a quote, absent ones none, the borrower is not a lender."""
    quoted, unstated = F.col("o_totalprice") > 100000, F.col("o_orderstatus") == "P"
    problems = F.array_compact(F.array(F.when(~quoted & ~unstated, "quote not found"), F.when(F.col("o_orderkey") % 97 == F.col("o_custkey") % 97, "borrower is lender"), F.when(unstated & quoted, "absent term has a quote")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(problems, "; ").alias("problems"))


@query("""WITH h AS (SELECT p_partkey, p_type AS header FROM part)
SELECT p_partkey, regexp_matches(lower(header), 'econ|promo') AND NOT regexp_matches(lower(header), 'standard') AS excluded, CASE WHEN regexp_matches(lower(header), 'econ|promo') THEN 'amount' WHEN regexp_matches(lower(header), 'standard|small') THEN 'count' ELSE 'any' END AS proves FROM h""")
def column_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns may prove a number, by the words of their headers."""
    h = F.lower("p_type")
    proves = F.when(h.rlike("econ|promo"), "amount").when(h.rlike("standard|small"), "count").otherwise("any")
    return table(spark, sf_dir, "part").select("p_partkey", (h.rlike("econ|promo") & ~h.rlike("standard")).alias("excluded"), proves.alias("proves"))


@query("""SELECT o_orderkey, 'Priority: ' || o_orderpriority || CASE WHEN o_orderstatus = 'P' THEN '' ELSE chr(10) || 'Status: ' || o_orderstatus END AS proposition FROM orders""")
def answer_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named fields of an application that say something, in the order asked for."""
    fields = F.create_map(F.lit("Status"), F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")), F.lit("Clerk"), F.lit("x"), F.lit("Priority"), "o_orderpriority")
    asked = F.array(F.lit("Priority"), F.lit("Status"), F.lit("Missing"))
    lines = F.transform(F.filter(asked, lambda k: F.trim(F.coalesce(F.element_at("f", k), F.lit(""))) != ""), lambda k: F.concat_ws(": ", k, F.element_at("f", k)))
    return table(spark, sf_dir, "orders").select("o_orderkey", fields.alias("f")).select("o_orderkey", F.array_join(lines, "\n").alias("proposition"))


@query("""WITH i AS (SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'), s AS (SELECT s_suppkey, s_nationkey, s_suppkey % 150 AS wanted FROM supplier),
e AS (SELECT s_suppkey, c_custkey, 1 AS level FROM s JOIN i ON c_custkey = wanted UNION ALL SELECT s_suppkey, min(c_custkey), 2 FROM s JOIN i ON c_nationkey = s_nationkey GROUP BY s_suppkey)
SELECT s_suppkey, arg_min(c_custkey, level) AS investor, min(level)::INT AS level FROM e GROUP BY s_suppkey""")
def investor_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested investors by id, else by likeness; one for each request."""
    i = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("c_nationkey"), (F.col("s_suppkey") % 150).alias("c_custkey"))
    near = i.groupBy("c_nationkey").agg(F.min("c_custkey").alias("near"))
    found = s.join(i.select("c_custkey", F.lit(1).alias("own")), "c_custkey", "left").join(near, "c_nationkey", "left").where("own IS NOT NULL OR near IS NOT NULL")
    return found.select("s_suppkey", F.when(F.col("own").isNotNull(), F.col("c_custkey")).otherwise(F.col("near")).alias("investor"), F.when(F.col("own").isNotNull(), 1).otherwise(2).alias("level"))


@query("""WITH p AS (SELECT DISTINCT p_name AS phrase FROM part WHERE length(p_name) >= 8), c AS (SELECT p_partkey, lower(p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_name) AS text FROM part)
SELECT p_partkey, count(*)::BIGINT AS phrases FROM c JOIN p ON contains(' ' || text || ' ', ' ' || phrase || ' ') GROUP BY p_partkey""")
def dossier_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that name a person by one of the phrases: pairs of words of the text meet the phrases by equality."""
    phrases = table(spark, sf_dir, "part").where(F.length("p_name") >= 8).select(F.col("p_name").alias("phrase")).distinct()
    words = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_name")), " ")
    pairs = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))
    c = table(spark, sf_dir, "part").select("p_partkey", words.alias("w")).select("p_partkey", F.explode(F.array_distinct(pairs)).alias("phrase"))
    return c.join(phrases, "phrase").groupBy("p_partkey").agg(F.count("*").alias("phrases"))


@query("""WITH e AS (SELECT event_id, user_id, ts, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)
SELECT event_id, CASE WHEN next IS NULL THEN 'held' WHEN epoch_us(next) - epoch_us(ts) > 1800000000 THEN 'expired' ELSE 'renewed' END AS lease FROM e""")
def leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases by heartbeat: renewed in time, expired after 1,800 seconds without one, or held still."""
    following = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").withColumn("next", following)
    return e.select("event_id", F.when(F.col("next").isNull(), "held").when(F.unix_micros("next") - F.unix_micros("ts") > 1_800_000_000, "expired").otherwise("renewed").alias("lease"))


@query("""SELECT s_suppkey, unnest(['Name: ' || s_name, 'Nation: ' || s_nationkey, 'Balance: ' || printf('%.2f', s_acctbal)]) AS line, unnest([1, 2, 3]) AS position FROM supplier""")
def flattened_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows as pairs of heading and value for print."""
    pairs = F.array(F.concat(F.lit("Name: "), "s_name"), F.concat(F.lit("Nation: "), F.col("s_nationkey").cast("string")), F.concat(F.lit("Balance: "), F.format_string("%.2f", "s_acctbal")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(pairs).alias("p", "line")).select("s_suppkey", "line", (F.col("p") + 1).alias("position"))


@query("""WITH r AS (SELECT n_name, c_custkey, c_name, c_acctbal, row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT n_name, md5('| rank | name | id |' || chr(10) || string_agg('| ' || n || ' | ' || replace(c_name, '#', '\\|') || ' | ' || c_custkey || ' |', chr(10) ORDER BY n)) AS table_md5 FROM r WHERE n <= 10 GROUP BY n_name""")
def ranking_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of each list as a Markdown table, pipes escaped."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("n", F.row_number().over(Window.partitionBy("n_name").orderBy(F.desc("c_acctbal"), "c_custkey"))).where("n <= 10")
    name = F.replace(F.replace("c_name", F.lit("#"), F.lit("|")), F.lit("|"), F.lit("\\|"))
    row = F.concat(F.lit("| "), F.col("n").cast("string"), F.lit(" | "), name, F.lit(" | "), F.col("c_custkey").cast("string"), F.lit(" |"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", row.alias("r")))), lambda x: x["r"]), "\n")
    return r.groupBy("n_name").agg(F.md5(F.concat(F.lit("| rank | name | id |\n"), lines).cast("binary")).alias("table_md5"))


@query("""WITH e AS (SELECT item_id AS id, 'quote' AS kind FROM benchmark UNION SELECT doc_id, 'document' FROM documents WHERE lang = 'en' UNION SELECT vec_id, 'vector' FROM embeddings WHERE label < 5)
SELECT id, string_agg(kind, ',' ORDER BY kind) AS kinds FROM e GROUP BY id""")
def evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of all kinds by id, each kind once."""
    part = lambda df, key, kind: df.select(F.col(key).cast("long").alias("id"), F.lit(kind).alias("kind"))
    e = part(table(spark, sf_dir, "benchmark"), "item_id", "quote").union(part(table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id", "document")).union(part(table(spark, sf_dir, "embeddings").where("label < 5"), "vec_id", "vector"))
    return e.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


@query("""WITH f AS (SELECT doc_id, CASE WHEN n_chars % 4 = 0 THEN 'insights/' || lang ELSE lang END AS old, 'datasets/' || coalesce(source, 'none') || '/' || lang AS new FROM documents)
SELECT new, count(*)::BIGINT AS files, count(DISTINCT old)::BIGINT AS from_places, count(DISTINCT old) > 1 AS conflict FROM f GROUP BY new""")
def layout_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where files move to in a new layout, and targets that more than one old place fills."""
    old = F.when(F.col("n_chars") % 4 == 0, F.concat(F.lit("insights/"), "lang")).otherwise(F.col("lang"))
    new = F.concat(F.lit("datasets/"), F.coalesce("source", F.lit("none")), F.lit("/"), "lang")
    g = table(spark, sf_dir, "documents").groupBy(new.alias("new")).agg(F.count("*").alias("files"), F.countDistinct(old).alias("from_places"))
    return g.withColumn("conflict", F.col("from_places") > 1)
