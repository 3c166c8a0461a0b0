"""Scalar functions and filters over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.text import name_key
from foliant.operators import ranking
from foliant.plans.registry import query
from foliant.tables import table


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS raw,
  CASE o_orderkey % 4 WHEN 0 THEN date_trunc('year', o_orderdate)::DATE WHEN 1 THEN date_trunc('month', o_orderdate)::DATE ELSE o_orderdate::DATE END AS floored FROM orders""")
def date_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of year, month or day precision, kept as text and floored."""
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    d = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return d.select("o_orderkey", "raw", F.to_date(F.concat("raw", F.when(F.length("raw") == 4, "-01-01").when(F.length("raw") == 7, "-01").otherwise(""))).alias("floored"))


@query("SELECT o_orderkey, (strftime(o_orderdate, '%Y-%m') <> '1998-06') AS skew, round((1998 - year(o_orderdate)) * 12 + 6 - month(o_orderdate) + (15 - day(o_orderdate)) / 30.0::DOUBLE, 6) AS months FROM orders")
def date_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skew: another year and month; months between with days as thirtieths."""
    d = F.col("o_orderdate")
    months = (1998 - F.year(d)) * 12 + 6 - F.month(d) + (15 - F.dayofmonth(d)) / 30.0
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.date_format(d, "yyyy-MM") != "1998-06").alias("skew"), F.round(months, 6).alias("months"))


@query("""SELECT p_partkey, floor(p_retailprice * 1000)::BIGINT AS amount FROM part""")
def grouped_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerals with apostrophes, commas or blanks between thousands, read back."""
    n = F.floor(F.col("p_retailprice") * 1000)
    shown = F.format_number(n, 0)
    mark = F.element_at(F.array(F.lit("'"), F.lit(","), F.lit(" "), F.lit("’")), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.replace(shown, F.lit(","), mark).alias("text"))
    return p.select("p_partkey", F.regexp_replace("text", "[', ’]", "").cast("long").alias("amount"))


@query("SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g') AS key, upper(trim(c_mktsegment)) AS currency, coalesce(nullif(trim(c_mktsegment), ''), 'n/a') AS label FROM customer")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name keys, currency codes, labels with blanks as null."""
    return table(spark, sf_dir, "customer").select("c_custkey", name_key(F.col("c_name")).alias("key"), F.upper(F.trim("c_mktsegment")).alias("currency"), F.coalesce(F.nullif(F.trim("c_mktsegment"), F.lit("")), F.lit("n/a")).alias("label"))


@query("SELECT doc_id, (quality IS NULL) AS absent, coalesce(quality = 0 AND toxic IS NULL, false) AS claim, CASE WHEN quality IS NULL THEN 'unstated' WHEN quality = 1 THEN 'present' ELSE 'absent' END AS state FROM documents LEFT JOIN labels USING (doc_id)")
def absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tri-state terms: stated, denied, unstated."""
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    q = F.col("quality")
    return d.select("doc_id", q.isNull().alias("absent"), F.coalesce((q == 0) & F.col("toxic").isNull(), F.lit(False)).alias("claim"), F.when(q.isNull(), "unstated").when(q == 1, "present").otherwise("absent").alias("state"))


@query("SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, count(*)::BIGINT AS pages, (ends_with(regexp_extract(url, '://([^/?#]*)', 1), '.example.net')) AS excluded FROM pages GROUP BY ALL")
def host_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts that equal a suffix or end with it after a dot."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    p = table(spark, sf_dir, "pages").select(host.alias("host"))
    return p.groupBy("host").agg(F.count("*").alias("pages")).withColumn("excluded", F.col("host").endswith(".example.net") | (F.col("host") == "example.net"))


@query("SELECT event_id, epoch_us(ts)::BIGINT AS micros, md5(concat('{\"k\":', json_extract(props, '$.k')::BIGINT, '}')) AS hash FROM events")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON in one spelling, and its hash; times in microseconds."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros("ts").alias("micros"), F.md5(F.to_json(F.struct(k.alias("k"))).cast("binary")).alias("hash"))


@query("SELECT source, lang, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars, grouping(source, lang)::INT AS level FROM documents GROUP BY ROLLUP (source, lang)")
def facet_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by tenant and language, with totals."""
    d = table(spark, sf_dir, "documents")
    return d.rollup("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().cast("int").alias("level"))


@query("SELECT source, count(*)::BIGINT AS n, count(*) FILTER (n_chars > 2000)::BIGINT AS long, count(*) > 40 AS capped FROM documents GROUP BY source")
def size_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by tenant, those beyond the size cap, and whether the tenant is."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 2000).alias("long"), (F.count("*") > 40).alias("capped"))


@query("WITH w AS (SELECT conv_id AS query, turn AS item, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations), r AS (SELECT query, item, -item AS place FROM w WHERE item % 2 = 0) SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY place IS NULL, place, nth)::INT AS position FROM w LEFT JOIN r USING (query, item)")
def ranking_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An incomplete order completed by the input's."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query"), F.col("turn").alias("item"))
    wanted = c.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("item")))
    returned = c.where("item % 2 = 0").withColumn("place", -F.col("item"))
    return ranking.repaired(returned, wanted)


@query("SELECT conv_id AS query, count(*) = count(DISTINCT turn) AND min(turn) = 0 AND max(turn) = count(*) - 1 AS valid FROM conversations GROUP BY conv_id")
def rank_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether turns are numbered without gaps and repeats."""
    return ranking.is_permutation(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query"), (F.col("turn") + 1).alias("rank")))


@query("SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id)::INT AS rank, doc_id FROM documents QUALIFY rank <= 10")
def swiss_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten longest documents by a tournament of small groups."""
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("n_chars").alias("value"))
    return ranking.swiss_top_k(items, 10).select("rank", F.col("item").alias("doc_id"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS mean_discount, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= DATE '2000-09-01' GROUP BY ALL")
def holdings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings by class and status up to a date: the filter reaches the scan."""
    l = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-09-01").cast("timestamp_ntz"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count("*").alias("n"))


@query("SELECT n_name, count(*)::BIGINT AS members, round(sum(c_acctbal), 2) AS balance, max(c_acctbal) AS best FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name HAVING count(*) >= 2")
def tenant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members and balances by tenant with two members or more."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_name").agg(F.count("*").alias("members"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.max("c_acctbal").alias("best")).where("members >= 2")


@query("WITH a AS (SELECT event_id, ts, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, count(*) FILTER (value > p)::BIGINT AS grew, count(*) FILTER (value < p)::BIGINT AS shrank, count(*) FILTER (p IS NULL)::BIGINT AS started FROM a GROUP BY user_id")
def edit_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a user's value grew or shrank from one event to the next."""
    p = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("p", p).groupBy("user_id").agg(F.count_if(F.col("value") > F.col("p")).alias("grew"), F.count_if(F.col("value") < F.col("p")).alias("shrank"), F.count_if(F.col("p").isNull()).alias("started"))
