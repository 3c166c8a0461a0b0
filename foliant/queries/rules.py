"""Rules, taxonomies, dependency graphs, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators import rules as R
from foliant.plans.registry import query
from foliant.tables import table

SEVERITIES = ("info", "low", "medium", "high")
_band = lambda item, name, severity="medium", active=True, **bounds: {"item": item, "severity": severity, "active": active, "when": {"input": name, **bounds}}
_when = lambda item, when, severity="medium", active=True: {"item": item, "severity": severity, "active": active, "when": when}
_unpaid = {"input": "status", "in": ["O"]}
_small, _late = {"input": "principal", "below": 50000.0}, {"input": "days_late", "above": 60.0}

#: The company's view of a loan, and the lenders': conditions that are flagged.
COMPANY = [
    _band("discount", "discount", above=0.08), _band("discount_low", "discount", "low", below=0.01), _band("interest", "interest", "high", above=0.07), _band("interest_low", "interest", "low", False, below=0.005),
    _when("cap_per_share", {"ratio": ["cap", "pieces"], "below": 2000.0}), _when("cap_missing", {"not": {"input": "cap", "min": 0.0}}), _band("maturity", "days_late", "high", above=90.0),
    _when("maturity_unpaid", {"all": [_unpaid, _late]}, "high"), _band("lenders", "lenders", "low", above=6.0), _when("one_lender", {"all": [{"input": "lenders", "max": 1.0}, {"not": _small}]}, "high"),
    _when("returned", {"ratio": ["returned", "lines"], "above": 0.5}), {"item": "governing_law", "severity": "medium", "active": False, "when": None},
]
LENDER = [
    _when("priority", {"input": "priority", "in": ["5-LOW", "4-NOT SPECIFIED"]}, "low"), _when("priority_high", {"strict": {"any": [{"input": "priority", "in": ["1-URGENT"]}, {"input": "balance", "below": 0.0}]}}), _band("ticket", "principal", "low", below=20000.0),
    _band("ticket_large", "principal", "medium", above=300000.0), _when("share_of_cap", {"ratio": ["principal", "cap"], "above": 0.5}, "high"), _when("share_of_balance", {"ratio": ["principal", "balance"], "above": 40.0}), _band("overdrawn", "balance", "high", below=0.0),
    _when("overdrawn_unpaid", {"all": [{"input": "balance", "below": 0.0}, _unpaid]}, "high"), _when("segment", {"input": "segment", "in": ["MACHINERY", "HOUSEHOLD"]}, "low", False), _band("pieces", "pieces", "low", min=200.0), _when("pieces_few", {"all": [{"input": "pieces", "max": 10.0}, {"any": [_small, _late]}]}),
    _when("discount_or_cap", {"not": {"any": [{"input": "discount", "min": 0.0}, {"input": "cap", "min": 0.0}]}}, "high"), _when("interest_band", {"not": {"input": "interest", "min": 0.01, "max": 0.06}}), _when("late_small", {"all": [_late, _small]}, "low"), _when("mixed", {"any": [{"all": [_unpaid, _small]}, {"all": [{"not": _unpaid}, _late]}]}),
    _when("returned_unpaid", {"all": [_unpaid, {"input": "returned", "above": 0.0}]}, "high", False),
]
RULES = COMPANY + LENDER

_INPUTS = """loan AS (SELECT o_orderkey, o_totalprice AS principal, o_orderstatus AS status, o_orderpriority AS priority, c_acctbal AS balance, c_mktsegment AS segment,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice * 3 END AS cap, lines, pieces, lenders, returned, CASE WHEN o_orderstatus <> 'F' THEN discount END AS discount, interest, days_late
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*)::DOUBLE AS lines, sum(l_quantity) AS pieces, count(DISTINCT l_suppkey)::DOUBLE AS lenders, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS returned,
  max(l_discount) AS discount, max(l_tax) AS interest, date_diff('day', min(l_shipdate)::DATE, max(l_shipdate)::DATE)::DOUBLE AS days_late FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""
_FINDINGS = f"{_INPUTS}, findings AS ({R.findings_sql('loan', ['o_orderkey'], RULES)})"


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inputs of the rules for every order as a loan; what is not known is null."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").cast("double").alias("lines"), F.sum("l_quantity").alias("pieces"), F.count_distinct("l_suppkey").cast("double").alias("lenders"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("returned"),
        F.max("l_discount").alias("discount"), F.max("l_tax").alias("interest"), F.datediff(F.max("l_shipdate"), F.min("l_shipdate")).cast("double").alias("days_late"),
    )
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left").join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    status = F.col("o_orderstatus")
    return o.select(
        "o_orderkey", F.col("o_totalprice").alias("principal"), status.alias("status"), F.col("o_orderpriority").alias("priority"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
        F.when(status != "P", F.col("o_totalprice") * 3).alias("cap"), "lines", "pieces", "lenders", "returned", F.when(status != "F", F.col("discount")).alias("discount"), "interest", "days_late",
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every loan against every rule of both views."""
    return R.findings(loans(spark, sf_dir), ["o_orderkey"], RULES)


@query(f"WITH {_FINDINGS} SELECT * FROM findings")
def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged, acceptable, not evaluated (with what is missing) and open questions of every loan."""
    return findings(spark, sf_dir).withColumn("missing", F.array_join("missing", ","))


@query(f"WITH {_FINDINGS} SELECT o_orderkey, ['info', 'low', 'medium', 'high'][max(list_position(['info', 'low', 'medium', 'high'], severity))] AS worst FROM findings WHERE status = 'flagged' GROUP BY o_orderkey")
def worst_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst flagged rule of each loan, by the order of severities."""
    order = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    f = findings(spark, sf_dir).where("status = 'flagged'").groupBy("o_orderkey").agg(F.max(order).alias("n"))
    return f.select("o_orderkey", F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("n").cast("int")).alias("worst"))


@query("""WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region),
c AS (SELECT child, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT c.child, e.parent, depth + 1 FROM c JOIN e ON e.child = c.ancestor) SELECT child, ancestor, depth::INT AS depth FROM c""")
def taxonomy_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of every category, with their distance."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    edges = n.union(table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey"), F.lit("root")))
    return spark.sql("""WITH RECURSIVE c(child, ancestor, depth) AS (
      SELECT child, parent, 1 FROM {edges} UNION ALL SELECT c.child, e.parent, depth + 1 FROM c JOIN {edges} e ON e.child = c.ancestor) SELECT * FROM c""", edges=edges)


#: Reporting groups over what is selected of components; one without a rule is never evaluated.
GROUPS = {
    "clean": {"strict": {"all": [{"any": [{"input": "quality", "has": "1"}]}, {"not": {"input": "toxic", "has": "1"}}]}},
    "european": {"strict": {"any": [{"input": "lang", "has": x} for x in ("de", "fr", "es")]}},
    "good_german": {"strict": {"all": [{"any": [{"input": "lang", "has": "de"}]}, {"not": {"any": [{"input": "quality", "has": "0"}, {"input": "toxic", "has": "1"}]}}]}},
    "unruled": None,
}
_SELECTED = "chosen AS (SELECT doc_id, CASE WHEN lang IS NOT NULL THEN [lang] END AS lang, CASE WHEN quality IS NOT NULL THEN [quality::VARCHAR] END AS quality, CASE WHEN toxic IS NOT NULL THEN [toxic::VARCHAR] END AS toxic FROM documents LEFT JOIN labels USING (doc_id))"
_AS_RULES = [{"item": name, "severity": "info", "when": rule} for name, rule in GROUPS.items()]


@query(f"WITH {_SELECTED} SELECT doc_id, item AS grp, CASE status WHEN 'flagged' THEN 'matched' WHEN 'acceptable' THEN 'unmatched' ELSE 'unevaluated' END AS state FROM ({R.findings_sql('chosen', ['doc_id'], _AS_RULES)})")
def three_valued_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reporting groups of every document: an unknown component is no evidence of absence and leaves a group unevaluated."""
    own = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c).cast("string"))).alias(c)
    s = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", own("lang"), own("quality"), own("toxic"))
    state = F.when(F.col("status") == "flagged", "matched").when(F.col("status") == "acceptable", "unmatched").otherwise("unevaluated")
    return R.findings(s, ["doc_id"], _AS_RULES).select("doc_id", F.col("item").alias("grp"), state.alias("state"))


_CANDIDATES = "c AS (SELECT doc_id, source, 'model_' || (doc_id % 4) AS model, md5(text) AS revision, doc_id % 7 = 0 AS manual FROM documents)"


@query(f"""WITH {_CANDIDATES} SELECT source, doc_id AS selected FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY manual DESC, coalesce(list_position(['model_2', 'model_0'], model), 9), regexp_extract(model, '\\d+')::INT DESC, doc_id) = 1""")
def insight_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preferred insight: manual ones, then configured models in order, then the largest number, then the id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("model_"), F.col("doc_id") % 4).alias("model"), (F.col("doc_id") % 7 == 0).alias("manual"))
    rank = F.array_position(F.array(F.lit("model_2"), F.lit("model_0")), F.col("model"))
    key = F.struct((~F.col("manual")).alias("a"), F.when(rank == 0, 9).otherwise(rank).alias("b"), (-F.regexp_extract("model", r"\d+", 0).cast("int")).alias("c"), F.col("doc_id").alias("d"))
    return d.groupBy("source").agg(F.min(key).alias("k")).select("source", F.col("k.d").alias("selected"))


@query(f"""WITH {_CANDIDATES}, e AS (SELECT source, max(revision) AS expected FROM c GROUP BY source)
SELECT doc_id, CASE WHEN manual THEN 'fresh' WHEN revision = expected THEN 'fresh' ELSE 'stale' END AS state FROM c JOIN e USING (source)""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An insight is fresh if its revision is the expected one; manual ones always are."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("revision"), (F.col("doc_id") % 7 == 0).alias("manual"))
    e = d.groupBy("source").agg(F.max("revision").alias("expected"))
    return d.join(e, "source").select("doc_id", F.when(F.col("manual") | (F.col("revision") == F.col("expected")), "fresh").otherwise("stale").alias("state"))


@query("""SELECT lang, count(*)::BIGINT AS calls, count(quality)::BIGINT AS judged, round(avg(quality), 6) AS pass_rate, round(avg(n_chars), 4) AS mean_chars, count(*) FILTER (toxic = 1)::BIGINT AS failures FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates, means and failures by condition."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg(F.count("*").alias("calls"), F.count("quality").alias("judged"), F.round(F.avg("quality"), 6).alias("pass_rate"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.count_if(F.col("toxic") == 1).alias("failures"))


_PERCENT, _SHARE = r"(\d+(?:\.\d+)?) ?%", r"(\d+)/(\d+)"


@query(f"""WITH c AS (SELECT page_id, html, regexp_extract(html, '{_PERCENT}', 1) AS p, regexp_extract(html, '{_SHARE}', 1) AS a, regexp_extract(html, '{_SHARE}', 2) AS b FROM pages)
SELECT page_id, CASE WHEN p <> '' THEN p::DOUBLE / 100 WHEN try_cast(b AS DOUBLE) > 0 THEN a::DOUBLE / b::DOUBLE WHEN contains(html, 'two thirds') THEN 2.0::DOUBLE / 3 WHEN contains(html, 'majority') THEN 0.5::DOUBLE END AS fraction FROM c""")
def majority_clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first share that a page states as a fraction: per cent, else a/b, else in words."""
    part = lambda r, i: F.regexp_extract("html", r, i).try_cast("double")
    under = part(_SHARE, 2)
    words = F.when(F.contains("html", F.lit("two thirds")), F.lit(2.0) / 3).when(F.contains("html", F.lit("majority")), F.lit(0.5))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(part(_PERCENT, 1) / 100, F.when(under > 0, part(_SHARE, 1) / F.when(under > 0, under)), words).alias("fraction"))


@query("""WITH h AS (SELECT c_nationkey AS nation, sum(CASE WHEN c_mktsegment = 'BUILDING' THEN greatest(c_acctbal, 0) ELSE 0 END) AS founders, sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN greatest(c_acctbal, 0) ELSE 0 END) AS investors, sum(greatest(c_acctbal, 0)) AS total FROM customer GROUP BY 1)
SELECT nation, founders / total < 0.5 AS founders_low, investors > 2 * founders AS investors_high FROM h""")
def red_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Founders below half, investors above twice the founders."""
    own = lambda s: F.sum(F.when(F.col("c_mktsegment") == s, F.greatest("c_acctbal", F.lit(0.0))).otherwise(0.0))
    h = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(own("BUILDING").alias("f"), own("MACHINERY").alias("i"), F.sum(F.greatest("c_acctbal", F.lit(0.0))).alias("t"))
    return h.select("nation", (F.col("f") / F.col("t") < 0.5).alias("founders_low"), (F.col("i") > 2 * F.col("f")).alias("investors_high"))
