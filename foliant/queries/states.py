"""States of datasets, insights, runs and loans: freshness, reuse, plans over dataset and skill, reconciliations, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators.components import connected
from foliant.operators.ranking import numbered
from foliant.plans.registry import query
from foliant.tables import table

NOW = "2024-01-30"


def _nth(values, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


@query(f"""WITH d AS (SELECT user_id, max(ts) AS latest, min(ts) AS created, count(*) FILTER (event_type = 'purchase') > 0 AS archived FROM events GROUP BY user_id)
SELECT user_id, NOT archived AS active, archived AND created < TIMESTAMP '{NOW}' - INTERVAL 20 DAY AS old, created < TIMESTAMP '{NOW}' - INTERVAL 25 DAY AND NOT archived AS purge, epoch_us(TIMESTAMP '{NOW}') - epoch_us(latest) >= 21600000000 AS refresh_due FROM d""")
def dataset_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets by their marks: active, archived long ago, to be purged, due for a refresh."""
    now = F.lit(NOW).cast("timestamp")
    d = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("latest"), F.min("ts").alias("created"), (F.count_if(F.col("event_type") == "purchase") > 0).alias("archived"))
    before = lambda days: F.col("created") < now - F.expr(f"INTERVAL {days} DAYS")
    return d.select("user_id", (~F.col("archived")).alias("active"), (F.col("archived") & before(20)).alias("old"), (before(25) & ~F.col("archived")).alias("purge"), (F.unix_micros(now) - F.unix_micros("latest") >= 21_600_000_000).alias("refresh_due"))


def _revisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Insights (doc_id, model, config, stored map of revisions) of every document, and its expected map."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.coalesce("source", F.lit("")).alias("source"))
    stored = d.select("doc_id", F.when(F.col("n_chars") % 7 == 0, None).otherwise(_nth(["m1", "m2"], F.col("n_chars"))).alias("model"), F.when(F.col("n_chars") % 5 == 0, "c0").otherwise("c1").alias("config"), F.create_map(F.lit("own"), (F.col("n_chars") % 3).cast("string"), "lang", F.lit("1")).alias("stored"))
    return stored, d.select("doc_id", F.create_map(F.lit("own"), F.lit("1"), F.lit("en"), F.lit("1")).alias("expected"))


#: Why a stored insight is not used again (fixed output values).
REASONS = ("freshness metadata missing or invalid", "stored model mismatch", "dataset changed: ", "prompt/configuration/inputs changed")

_REJECT = f"""j AS (SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN NULL ELSE ['m1', 'm2'][n_chars % 2 + 1] END AS model, CASE WHEN n_chars % 5 = 0 THEN 'c0' ELSE 'c1' END AS config, n_chars % 3 AS own, lang FROM documents),
r AS (SELECT doc_id, list_filter([CASE WHEN model IS NULL THEN '{REASONS[0]}' END, CASE WHEN model <> 'm1' THEN '{REASONS[1]}' END,
  CASE WHEN own <> 1 OR lang <> 'en' THEN '{REASONS[2]}' || array_to_string(list_sort(list_filter([CASE WHEN lang <> 'en' THEN lang END, CASE WHEN lang <> 'en' THEN 'en' END, CASE WHEN own <> 1 THEN 'own' END], lambda x: x IS NOT NULL)), ', ') END,
  CASE WHEN config <> 'c1' THEN '{REASONS[3]}' END], lambda x: x IS NOT NULL) AS reasons FROM j)"""


@query(f"WITH {_REJECT} SELECT doc_id, array_to_string(reasons, '; ') AS reasons, len(reasons) = 0 AS reusable FROM r")
def rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a stored insight is not used again: missing data, another model, datasets whose revisions differ, other settings."""
    stored, expected = _revisions(spark, sf_dir)
    j = stored.join(expected, "doc_id")
    changed = F.map_keys(F.map_filter(F.map_zip_with("stored", "expected", lambda k, a, b: ~a.eqNullSafe(b)), lambda k, v: v))
    reasons = F.array_compact(F.array(
        F.when(F.col("model").isNull(), REASONS[0]), F.when(F.col("model") != "m1", REASONS[1]),
        F.when(F.size(changed) > 0, F.concat(F.lit(REASONS[2]), F.array_join(F.array_sort(changed), ", "))), F.when(F.col("config") != "c1", REASONS[3]),
    ))
    return j.select("doc_id", F.array_join(reasons, "; ").alias("reasons"), (F.size(reasons) == 0).alias("reusable"))


@query(f"""WITH {_REJECT}, d AS (SELECT doc_id, source, n_chars FROM documents)
SELECT source, doc_id FROM d JOIN r USING (doc_id) WHERE len(reasons) = 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1""")
def reusable_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest insight of each source that may be used again; the size stands for its time."""
    ok = rejection_reasons(spark, sf_dir).where("reusable").select("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(ok, "doc_id")
    return d.groupBy("source").agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("d"))).alias("m")).select("source", (-F.col("m.d")).alias("doc_id"))


@query("""WITH s AS (SELECT c_custkey // 500 AS project, c_mktsegment AS source, CASE WHEN bool_or(c_acctbal < -900) THEN NULL ELSE md5(string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey)) END AS revision FROM customer GROUP BY ALL)
SELECT project, CASE WHEN count(revision) = count(*) THEN string_agg(source || '=' || revision, ';' ORDER BY source) END AS revisions FROM s GROUP BY project""")
def project_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revisions of a project's sources; none if any source lacks one. A project is a block of 500 accounts."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda x: x.cast("string")), ",")
    s = table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 500).alias("project"), F.col("c_mktsegment").alias("source")).agg(F.when(~F.bool_or(F.col("c_acctbal") < -900), F.md5(joined.cast("binary"))).alias("revision"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "revision"))), lambda x: F.concat_ws("=", x["source"], x["revision"])), ";")
    return s.groupBy("project").agg(F.when(F.count("revision") == F.count("*"), listed).alias("revisions"))


#: Skills, the domains that they run in, the stages that make them mandatory, and what they need.
SKILLS = (("import", "01234", "*", ()), ("convert", "01234", "", ("import",)), ("profile", "0123", "A", ("convert",)), ("sector", "01", "A", ("profile",)), ("market", "4", "*", ("convert",)), ("ranking", "012", "B", ("sector", "market")), ("report", "01", "B", ("ranking", "profile")))
_SKILL = "skill(skill, domains, stages) AS (VALUES " + ", ".join(f"('{s}', '{d}', '{m}')" for s, d, m, _ in SKILLS) + "), need(skill, dep) AS (VALUES " + ", ".join(f"('{s}', '{x}')" for s, _, _, n in SKILLS for x in n) + ")"
_NODES = f"""{_SKILL}, dataset AS (SELECT c_custkey AS dataset, (c_nationkey % 5)::VARCHAR AS domain, CASE WHEN c_acctbal > 5000 THEN 'B' WHEN c_acctbal > 0 THEN 'A' ELSE 'C' END AS stage, c_acctbal < -990 AS broken FROM customer),
node AS (SELECT dataset, s.skill, domain, stage, broken, s.stages = '*' OR s.stages = stage AS chosen FROM dataset JOIN skill s ON contains(s.domains, domain)),
edge AS (SELECT n.dataset, n.skill, n.dep, CASE WHEN m.skill IS NULL THEN 'elsewhere' ELSE 'own' END AS kind FROM (SELECT n.*, x.dep FROM node n JOIN need x USING (skill)) n LEFT JOIN node m ON m.dataset = n.dataset AND m.skill = n.dep)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, skill, domain, stage, broken, chosen: every dataset with the skills of its domain."""
    c = table(spark, sf_dir, "customer")
    d = c.select(F.col("c_custkey").alias("dataset"), (F.col("c_nationkey") % 5).cast("string").alias("domain"), F.when(F.col("c_acctbal") > 5000, "B").when(F.col("c_acctbal") > 0, "A").otherwise("C").alias("stage"), (F.col("c_acctbal") < -990).alias("broken"))
    skills = F.array(*[F.struct(F.lit(s).alias("skill"), F.lit(m).alias("domains"), F.lit(t).alias("stages"), F.lit(",".join(n)).alias("needs")) for s, m, t, n in SKILLS])
    held = d.withColumn("s", F.explode(skills)).select("*", "s.*").drop("s").where(F.contains("domains", F.col("domain")))
    return held.withColumn("chosen", (F.col("stages") == "*") | (F.col("stages") == F.col("stage")))


@query(f"WITH {_NODES} SELECT skill, dep, kind, count(*)::BIGINT AS n FROM edge GROUP BY ALL")
def skill_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needs of all nodes: met within the dataset, or by the nodes of another domain."""
    n = nodes(spark, sf_dir)
    edges = n.where("needs <> ''").select("dataset", "skill", F.explode(F.split("needs", ",")).alias("dep"))
    own = n.select("dataset", F.col("skill").alias("dep"), F.lit(1).alias("own"))
    kind = F.when(F.col("own").isNull(), "elsewhere").otherwise("own")
    return edges.join(own, ["dataset", "dep"], "left").groupBy("skill", "dep", kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_NODES}, own AS (SELECT * FROM edge WHERE kind = 'own'),
plan(dataset, skill) AS (SELECT dataset, skill FROM node WHERE chosen UNION SELECT e.dataset, e.dep FROM plan p JOIN own e ON e.dataset = p.dataset AND e.skill = p.skill),
depth(dataset, skill, level) AS (SELECT p.dataset, p.skill, 0 FROM plan p WHERE NOT EXISTS (SELECT 1 FROM own e WHERE e.dataset = p.dataset AND e.skill = p.skill) UNION ALL SELECT e.dataset, e.skill, level + 1 FROM depth d JOIN own e ON e.dataset = d.dataset AND e.dep = d.skill JOIN plan p ON p.dataset = e.dataset AND p.skill = e.skill),
failed(dataset, skill) AS (SELECT p.dataset, p.skill FROM plan p JOIN node n USING (dataset, skill) WHERE n.broken AND skill = 'convert' UNION SELECT e.dataset, e.skill FROM failed f JOIN own e ON e.dataset = f.dataset AND e.dep = f.skill JOIN plan p ON p.dataset = e.dataset AND p.skill = e.skill)
SELECT d.dataset, d.skill, max(level)::INT AS wave, CASE WHEN f.dataset IS NULL THEN 'run' WHEN d.skill = 'convert' THEN 'failed' ELSE 'skipped' END AS outcome FROM depth d LEFT JOIN failed f ON f.dataset = d.dataset AND f.skill = d.skill GROUP BY ALL""")
def refresh_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mandatory nodes of all datasets with what they need, their waves, and what a failed conversion skips.

    The graph of skills is small and the same for all: its closures are arrays, and datasets stream through.
    """
    need = {s: set(n) for s, _, _, n in SKILLS}
    n = nodes(spark, sf_dir)
    by = n.groupBy("dataset", "broken").agg(F.collect_set("skill").alias("has"), F.collect_set(F.when(F.col("chosen"), F.col("skill"))).alias("plan"))
    wave = {s: F.lit(0) for s, _, _, _ in SKILLS}
    plan = F.col("plan")
    has = lambda s: F.array_contains("has", s)
    for s, _, _, _ in reversed(SKILLS):  # a skill comes after all that it needs
        for dep in sorted(need[s]):
            plan = F.when(F.array_contains(plan, s) & has(dep), F.array_union(plan, F.array(F.lit(dep)))).otherwise(plan)
        by, plan = by.withColumn("plan", plan), F.col("plan")
    levels = by
    for s, _, _, _ in SKILLS:
        above = [F.when(has(dep), F.col(f"w_{dep}") + 1).otherwise(0) for dep in sorted(need[s])]
        lost = [has(dep) & F.col(f"x_{dep}") for dep in sorted(need[s])]
        level = F.greatest(F.lit(0), F.lit(0), *above)
        levels = levels.withColumn(f"w_{s}", level)
        bad = F.lit(False)
        for x in lost:
            bad = bad | x
        levels = levels.withColumn(f"x_{s}", bad | (F.col("broken") & F.lit(s == "convert")))
    rows = F.array(*[F.struct(F.lit(s).alias("skill"), F.col(f"w_{s}").alias("wave"), F.when(~F.col(f"x_{s}"), "run").when(F.lit(s == "convert"), "failed").otherwise("skipped").alias("outcome")) for s, _, _, _ in SKILLS])
    return levels.select("dataset", "plan", F.explode(rows).alias("r")).where(F.array_contains("plan", F.col("r.skill"))).select("dataset", "r.*")


@query("""WITH a AS (SELECT doc_id, source AS path, md5(text) AS h FROM documents WHERE n_chars % 3 <> 0), b AS (SELECT doc_id, md5(CASE WHEN n_chars % 4 = 0 THEN text || '.' ELSE text END) AS h FROM documents WHERE n_chars % 5 <> 0)
SELECT CASE WHEN b.doc_id IS NULL THEN 'copy' WHEN a.doc_id IS NULL THEN 'remove' WHEN a.h = b.h THEN 'unchanged' ELSE 'update' END AS action, count(*)::BIGINT AS n FROM a FULL JOIN b USING (doc_id) GROUP BY 1""")
def hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a generated dataset against those that should be there, by content."""
    d = table(spark, sf_dir, "documents")
    h = lambda c: F.md5(c.cast("binary"))
    a = d.where(F.col("n_chars") % 3 != 0).select("doc_id", h(F.col("text")).alias("a"))
    b = d.where(F.col("n_chars") % 5 != 0).select("doc_id", h(F.when(F.col("n_chars") % 4 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("b"))
    action = F.when(F.col("b").isNull(), "copy").when(F.col("a").isNull(), "remove").when(F.col("a") == F.col("b"), "unchanged").otherwise("update")
    return a.join(b, "doc_id", "full").groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN n_chars > 20000 THEN 'too large' WHEN lang = 'de' AND n_chars % 2 = 0 THEN 'type not allowed' WHEN trim(coalesce(text, '')) = '' THEN 'blank' ELSE 'ok' END AS upload, quality = 1 AS needs_quote,
  coalesce(trim(text) = 'INSUFFICIENT_CONTEXT', false) AS sentinel, CASE WHEN lang = 'fr' THEN 'never' WHEN lang = 'es' THEN CASE WHEN n_chars % 2 = 0 THEN 'retry' ELSE 'never' END ELSE 'retry' END AS conversion, lang IN ('en', 'de') AND source IN ('src1', 'src2') AS tolerable FROM documents LEFT JOIN labels USING (doc_id)""")
def document_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents: upload check, claims that need a quote, the sentinel answer, conversions worth another try, failures that are tolerated."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n, lang = F.col("n_chars"), F.col("lang")
    upload = F.when(n > 20000, "too large").when((lang == "de") & (n % 2 == 0), "type not allowed").when(F.trim(F.coalesce("text", F.lit(""))) == "", "blank").otherwise("ok")
    conversion = F.when(lang == "fr", "never").when(lang == "es", F.when(n % 2 == 0, "retry").otherwise("never")).otherwise("retry")
    return d.select("doc_id", upload.alias("upload"), (F.col("quality") == 1).alias("needs_quote"), F.coalesce(F.trim("text") == "INSUFFICIENT_CONTEXT", F.lit(False)).alias("sentinel"), conversion.alias("conversion"), (lang.isin("en", "de") & F.col("source").isin("src1", "src2")).alias("tolerable"))


@query("""SELECT doc_id, CASE WHEN n_chars % 3 = 0 AND n_chars % 2 = 0 AND length(text) < 400 THEN 'current' ELSE 'again' END AS parse, CASE WHEN n_chars % 3 <> 0 THEN 'The file changed since.' WHEN n_chars % 2 <> 0 THEN 'A newer converter may read it.' WHEN length(text) < 400 THEN 'The file holds too little text.' ELSE 'It will be read again.' END AS reason FROM documents WHERE text IS NOT NULL""")
def ignored_parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ignored documents: whether the state still holds (same hash and version, and a reason), and what to tell."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    same, version, short = F.col("n_chars") % 3 == 0, F.col("n_chars") % 2 == 0, F.length("text") < 400
    reason = F.when(~same, "The file changed since.").when(~version, "A newer converter may read it.").when(short, "The file holds too little text.").otherwise("It will be read again.")
    return d.select("doc_id", F.when(same & version & short, "current").otherwise("again").alias("parse"), reason.alias("reason"))


@query("""WITH r AS (SELECT doc_id, lang AS condition, n_chars % 2 = 0 AS ok FROM documents), p AS (SELECT doc_id // 10 AS item, condition, bool_and(ok) AS ok FROM r GROUP BY ALL)
SELECT a.condition AS one, b.condition AS other, count(*) FILTER (a.ok AND b.ok)::BIGINT AS right_right, count(*) FILTER (a.ok AND NOT b.ok)::BIGINT AS right_wrong, count(*) FILTER (NOT a.ok AND b.ok)::BIGINT AS wrong_right, count(*) FILTER (NOT a.ok AND NOT b.ok)::BIGINT AS wrong_wrong FROM p a JOIN p b ON a.item = b.item AND a.condition < b.condition GROUP BY ALL""")
def paired_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two by two tables of every pair of conditions on the items that both judged; an item has a row for each condition."""
    p = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 10).alias("item"), F.col("lang").alias("one")).agg(F.bool_and(F.col("n_chars") % 2 == 0).alias("a"))
    m = p.join(p.select("item", F.col("one").alias("other"), F.col("a").alias("b")), "item").where("one < other")
    n = lambda x, y, name: F.count_if((F.col("a") == x) & (F.col("b") == y)).alias(name)
    return m.groupBy("one", "other").agg(n(True, True, "right_right"), n(True, False, "right_wrong"), n(False, True, "wrong_right"), n(False, False, "wrong_wrong"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'click')::BIGINT AS running, count(*) FILTER (event_type = 'view')::BIGINT AS waiting, count(*) FILTER (event_type NOT IN ('click', 'view'))::BIGINT AS done FROM events GROUP BY user_id""")
def queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running and waiting requests by descriptor."""
    e = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(e == "click").alias("running"), F.count_if(e == "view").alias("waiting"), F.count_if(~e.isin("click", "view")).alias("done"))


@query("""WITH t AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM orders),
x AS (SELECT o_custkey, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS executed, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS offered FROM t GROUP BY 1)
SELECT o_custkey, CASE WHEN executed IS NULL THEN 'open' WHEN offered IS NULL THEN 'no term sheet' WHEN abs(executed - offered) > 0.01 THEN 'superseded, amounts differ' ELSE 'superseded' END AS state, round(executed - offered, 2) AS difference FROM x WHERE coalesce(executed, offered) IS NOT NULL""")
def term_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term sheets against executed loans of the same lender."""
    of = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    x = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(of("F").alias("e"), of("O").alias("o")).where("e IS NOT NULL OR o IS NOT NULL")
    state = F.when(F.col("e").isNull(), "open").when(F.col("o").isNull(), "no term sheet").when(F.abs(F.col("e") - F.col("o")) > 0.01, "superseded, amounts differ").otherwise("superseded")
    return x.select("o_custkey", state.alias("state"), F.round(F.col("e") - F.col("o"), 2).alias("difference"))


@query("""WITH n AS (SELECT o_orderpriority AS grp, count(DISTINCT o_custkey) AS lenders FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT grp, k::BIGINT AS added, lenders::BIGINT AS lenders, (lenders + k)::BIGINT AS after, lenders + k > 10 AS over_10, lenders + k > 20 AS over_20, lenders <= 20 AND lenders + k > 20 AS crosses FROM n, (VALUES (1), (5), (25)) t(k)""")
def loan_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of lenders before and after one, five or 25 more join a group."""
    n = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_orderpriority").alias("grp")).agg(F.countDistinct("o_custkey").alias("lenders"))
    k = n.withColumn("added", F.explode(F.array(*[F.lit(x).cast("long") for x in (1, 5, 25)]))).withColumn("after", F.col("lenders") + F.col("added"))
    return k.select("grp", "added", "lenders", "after", (F.col("after") > 10).alias("over_10"), (F.col("after") > 20).alias("over_20"), ((F.col("lenders") <= 20) & (F.col("after") > 20)).alias("crosses"))


@query("""WITH t AS (SELECT o_custkey, max(o_totalprice) AS cap, min(o_totalprice) AS floor FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), l AS (SELECT o_custkey, o_orderkey, o_totalprice AS cap, o_totalprice * 0.9::DOUBLE AS floor FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey, array_to_string(list_filter([CASE WHEN l.cap < t.cap THEN 'cap' END, CASE WHEN l.floor > t.floor THEN 'floor' END], lambda x: x IS NOT NULL), ',') AS better_here, array_to_string(list_filter([CASE WHEN t.cap < l.cap THEN 'cap' END, CASE WHEN t.floor > l.floor THEN 'floor' END], lambda x: x IS NOT NULL), ',') AS better_there FROM l JOIN t USING (o_custkey)""")
def favoured_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which terms of an offer are better for the lender than those of the lender's executed loans, and the other way."""
    o = table(spark, sf_dir, "orders")
    t = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("tc"), F.min("o_totalprice").alias("tf"))
    l = o.where("o_orderstatus = 'O'").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("lc"), (F.col("o_totalprice") * 0.9).alias("lf"))
    listed = lambda *c: F.array_join(F.array_compact(F.array(*c)), ",")
    return l.join(t, "o_custkey").select("o_orderkey", listed(F.when(F.col("lc") < F.col("tc"), "cap"), F.when(F.col("lf") > F.col("tf"), "floor")).alias("better_here"), listed(F.when(F.col("tc") < F.col("lc"), "cap"), F.when(F.col("tf") > F.col("lf"), "floor")).alias("better_there"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal > 8000 THEN 'evidenced' WHEN c_mktsegment = 'BUILDING' THEN 'explicit' ELSE 'assumption' END AS provenance, round(CASE WHEN c_acctbal > 8000 THEN c_acctbal WHEN c_mktsegment = 'BUILDING' THEN 5000.0::DOUBLE ELSE 1000.0::DOUBLE END, 2) AS ticket FROM customer""")
def input_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An input as evidenced, as given, or assumed, in this order."""
    evidenced, given = F.when(F.col("c_acctbal") > 8000, F.col("c_acctbal")), F.when(F.col("c_mktsegment") == "BUILDING", F.lit(5000.0))
    label = F.when(evidenced.isNotNull(), "evidenced").when(given.isNotNull(), "explicit").otherwise("assumption")
    return table(spark, sf_dir, "customer").select("c_custkey", label.alias("provenance"), F.round(F.coalesce(evidenced, given, F.lit(1000.0)), 2).alias("ticket"))


@query("""WITH s AS (SELECT s_suppkey AS company, n_regionkey AS parent, s_nationkey AS child, s_suppkey % 3 > 0 AS parent_selected FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT company, child, parent, CASE WHEN parent_selected THEN 'consistent' ELSE 'parent missing' END AS finding FROM s""")
def taxonomy_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected classes whose parent is not selected."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("child"), F.col("n_regionkey").alias("parent"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("company"), F.col("s_nationkey").alias("child")).join(n, "child")
    chosen = s.where("company % 3 > 0").select("company", "parent", F.lit(1).alias("held")).distinct()
    return s.join(chosen, ["company", "parent"], "left").select("company", "child", "parent", F.when(F.col("held").isNull(), "parent missing").otherwise("consistent").alias("finding"))


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, length(text) AS chars FROM documents)
SELECT source, ((n - 1) // 8)::BIGINT AS batch, count(*)::BIGINT AS documents, sum(least(coalesce(chars, 0), 3000))::BIGINT AS chars FROM r GROUP BY ALL""")
def classification_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source in batches of eight, with excerpts of 3,000 characters.

    Documents are numbered within blocks of their ids; the counts of a source's earlier blocks are added.
    """
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").alias("chars"), F.floor(F.col("doc_id") / 10000).alias("block"))
    counts = d.groupBy("source", "block").agg(F.count("*").alias("n"))
    before = counts.select(F.col("source").alias("s"), F.col("block").alias("b"), (F.sum("n").over(Window.partitionBy("source").orderBy("block")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("source", "block").orderBy("doc_id"))
    placed = d.withColumn("own", own).join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    return placed.groupBy("source", F.floor((F.col("before") + F.col("own") - 1) / 8).alias("batch")).agg(F.count("*").alias("documents"), F.sum(F.least(F.coalesce("chars", F.lit(0)), F.lit(3000))).cast("long").alias("chars"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_linestatus = 'F' AND l_tax > 0.02 END AS corroborated FROM lineitem""")
def signature_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether marks corroborate a claimed signature; not applicable to scans."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", (F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.02)).alias("corroborated"))


@query("""WITH c AS (SELECT s_suppkey, s_nationkey % 4 AS chapter, CASE s_nationkey % 3 WHEN 0 THEN 'bio' WHEN 1 THEN 'tech' ELSE 'other' END AS industry FROM supplier)
SELECT s_suppkey, CASE WHEN industry = 'bio' AND chapter < 2 THEN 'chapter' || chapter || '_bio' WHEN industry = 'tech' AND chapter = 3 THEN 'chapter3_tech' ELSE 'chapter' || chapter || '_general' END AS checklist, CASE chapter WHEN 0 THEN 'reject,ask' WHEN 1 THEN 'ask,accept' ELSE 'accept' END AS actions FROM c""")
def checklist_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checklist of a chapter for an industry, else the general one; the actions that a stage allows."""
    known = spark.createDataFrame([("chapter0_bio",), ("chapter1_bio",), ("chapter3_tech",), *[(f"chapter{i}_general",) for i in range(4)]], "name string")
    allowed = spark.createDataFrame([(0, "reject,ask"), (1, "ask,accept"), (2, "accept"), (3, "accept")], "chapter int, actions string")
    industry = F.when(F.col("s_nationkey") % 3 == 0, "bio").when(F.col("s_nationkey") % 3 == 1, "tech").otherwise("other")
    c = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 4).alias("chapter"), industry.alias("industry"))
    name = lambda v: F.concat(F.lit("chapter"), F.col("chapter").cast("string"), F.lit("_"), v)
    own = known.select(F.col("name").alias("own"))
    found = c.join(F.broadcast(own), name(F.col("industry")) == F.col("own"), "left").join(F.broadcast(allowed), "chapter")  # the lists given
    return found.select("s_suppkey", F.coalesce("own", name(F.lit("general"))).alias("checklist"), "actions")


@query("""WITH r AS (SELECT c_custkey, c_name, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS n FROM customer)
SELECT c_mktsegment, c_nationkey, count(*)::BIGINT AS members, count(DISTINCT round(c_acctbal, 0))::BIGINT AS identities, count(*) - count(DISTINCT round(c_acctbal, 0)) AS duplicates, count(*) FILTER (c_acctbal < 0) > 0 AND count(*) FILTER (c_acctbal >= 0) > 0 AS mixed FROM customer GROUP BY ALL""")
def roster_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rosters with identities that come twice, and those that mix verified and unverified ones."""
    a = F.col("c_acctbal")
    g = table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("members"), F.countDistinct(F.round(a, 0)).alias("identities"), (F.count_if(a < 0) > 0).alias("x"), (F.count_if(a >= 0) > 0).alias("y"))
    return g.select("c_mktsegment", "c_nationkey", "members", "identities", (F.col("members") - F.col("identities")).alias("duplicates"), (F.col("x") & F.col("y")).alias("mixed"))


@query("""WITH RECURSIVE e AS (SELECT o_custkey AS a, o_orderkey // 3 AS b FROM orders), n AS (SELECT -1 - a AS x, b AS y FROM e UNION SELECT b, -1 - a FROM e),
r(x, c) USING KEY (x) AS (SELECT DISTINCT x, x FROM n UNION SELECT n.x, min(r.c) FROM r JOIN n ON n.y = r.x JOIN recurring.r o ON o.x = n.x WHERE r.c < o.c GROUP BY n.x)
SELECT x AS alias, c AS identity FROM r""")
def alias_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases joined to identities through whatever links them, however far."""
    e = table(spark, sf_dir, "orders").select((-1 - F.col("o_custkey")).alias("a"), F.floor(F.col("o_orderkey") / 3).alias("b"))
    return connected(e).select(F.col("node").alias("alias"), F.col("component").alias("identity"))


@query("""WITH t AS (SELECT o_custkey AS id, o_orderpriority AS dataset FROM orders UNION SELECT c_custkey, c_mktsegment FROM customer)
SELECT id, string_agg(dataset, ',' ORDER BY dataset) AS datasets, count(*)::BIGINT AS n FROM t GROUP BY id""")
def tracked_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each identity's datasets of all trackers, once."""
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("dataset")).union(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")).distinct()
    return t.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("dataset")), ",").alias("datasets"), F.count("*").alias("n"))


@query("""WITH planned AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P'), done AS (SELECT DISTINCT l_orderkey AS id, max(l_linestatus = 'F') OVER (PARTITION BY l_orderkey) AS ok FROM lineitem)
SELECT CASE WHEN done.id IS NULL THEN 'missing' WHEN planned.id IS NULL THEN 'unplanned' WHEN ok THEN 'succeeded' ELSE 'failed' END AS state, count(*)::BIGINT AS n FROM planned FULL JOIN done USING (id) GROUP BY 1""")
def run_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned work against what was done."""
    planned = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("p"))
    done = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max(F.col("l_linestatus") == "F").alias("ok"))
    state = F.when(F.col("ok").isNull(), "missing").when(F.col("p").isNull(), "unplanned").when(F.col("ok"), "succeeded").otherwise("failed")
    return planned.join(done, "id", "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT l_suppkey AS company, date_trunc('month', l_shipdate)::DATE AS as_of, count(*) AS rows FROM lineitem GROUP BY ALL)
SELECT company, as_of, rows::BIGINT AS rows FROM d WHERE as_of <= DATE '2000-06-30' QUALIFY row_number() OVER (PARTITION BY company ORDER BY as_of DESC) = 1""")
def best_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each company that is not after a date."""
    l = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") < F.lit("2000-07-01").cast("timestamp_ntz"))
    d = l.groupBy(F.col("l_suppkey").alias("company"), F.to_date(F.date_trunc("month", F.col("l_shipdate").cast("timestamp"))).alias("as_of")).agg(F.count("*").alias("rows"))
    return d.groupBy("company").agg(F.max(F.struct("as_of", "rows")).alias("m")).select("company", "m.as_of", "m.rows")


@query("""WITH c AS (SELECT o_custkey, o_orderkey, length(o_orderpriority) * 40 + (o_totalprice / 5000)::INT AS chars, o_totalprice FROM orders), s AS (SELECT *, sum(chars) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS used, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS position FROM c)
SELECT o_custkey, o_orderkey, position::INT AS position, used::BIGINT AS used FROM s WHERE used <= 3000""")
def prompt_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in order of worth as long as a prompt's budget holds. Halves round to even, as casts do in SQL."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    chars = F.length("o_orderpriority") * 40 + F.rint(F.col("o_totalprice") / 5000).cast("int")
    c = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", chars.alias("chars"))
    return c.select("o_custkey", "o_orderkey", F.row_number().over(w).alias("position"), F.sum("chars").over(w).alias("used")).where("used <= 3000")


@query("""WITH g AS (SELECT o_custkey, c_mktsegment, o_orderpriority AS chk, sum(o_totalprice) AS t FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey, c_mktsegment, o_orderpriority),
r AS (SELECT *, rank() OVER (PARTITION BY c_mktsegment, chk ORDER BY t DESC) AS n FROM g)
SELECT c_mktsegment, chk, o_custkey, n::INT AS position FROM r WHERE n <= 3""")
def ranked_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best of each check across audits."""
    g = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("o_custkey", "c_mktsegment", F.col("o_orderpriority").alias("chk")).agg(F.sum("o_totalprice").alias("t"))
    return g.withColumn("position", F.rank().over(Window.partitionBy("c_mktsegment", "chk").orderBy(F.desc("t")))).where("position <= 3").select("c_mktsegment", "chk", "o_custkey", "position")


@query("""WITH a AS (SELECT c_custkey, c_name FROM customer), o AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders),
hit AS (SELECT c_custkey, 1 AS level FROM a JOIN o ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' UNION ALL SELECT c_custkey, 2 FROM a JOIN o ON o_custkey = c_custkey AND o_orderpriority = '2-HIGH' UNION ALL SELECT c_custkey, 3 FROM a JOIN o ON o_custkey = c_custkey)
SELECT c_custkey, coalesce(min(level), 0)::INT AS level FROM a LEFT JOIN hit USING (c_custkey) GROUP BY c_custkey""")
def application_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first level at which an application is found: by name, code or alias; 0 for none."""
    level = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(3)
    best = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(level).alias("level"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(best, "c_custkey", "left").select("c_custkey", F.coalesce("level", F.lit(0)).alias("level"))


@query("""WITH m AS (SELECT c_custkey FROM customer), w AS (SELECT DISTINCT o_custkey AS id, o_orderstatus = 'P' AS optout FROM orders)
SELECT coalesce(c_custkey, id) AS id, CASE WHEN c_custkey IS NULL THEN CASE WHEN bool_or(optout) THEN 'warning' ELSE 'error' END WHEN bool_or(optout) THEN 'left out' WHEN count(id) > 0 THEN 'candidate' ELSE 'member' END AS state FROM m FULL JOIN w ON id = c_custkey GROUP BY c_custkey, id""")
def member_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members, candidates and opt-outs; a candidate who is no member is an error, an opt-out a warning."""
    w = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.bool_or(F.col("o_orderstatus") == "P").alias("optout"))
    m = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("m"))
    state = F.when(F.col("m").isNull(), F.when(F.col("optout"), "warning").otherwise("error")).when(F.col("optout"), "left out").when(F.col("optout").isNotNull(), "candidate").otherwise("member")
    return m.join(w, "id", "full").select("id", state.alias("state"))


@query("""WITH q AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, lower(split_part(text, ' ', 1)) AS a, lower(split_part(text, ' ', 2)) AS b, lower(text) AS t FROM q)
SELECT doc_id, length(a) + length(b) >= 4 AND contains(regexp_replace(t, '[^a-z0-9]', '', 'g'), regexp_replace(b || a, '[^a-z0-9]', '', 'g')) AS contiguous, list_has_all(regexp_split_to_array(t, '[^a-z0-9]+'), list_filter(regexp_split_to_array(a || ' ' || b, '[^a-z0-9]+'), lambda x: x <> '')) AS all_words FROM n""")
def identity_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text holds an identity in one piece, or all its words."""
    a, b, t = F.lower(F.split_part("text", F.lit(" "), F.lit(1))), F.lower(F.split_part("text", F.lit(" "), F.lit(2))), F.lower("text")
    key = lambda x: F.regexp_replace(x, "[^a-z0-9]", "")
    words = F.filter(F.split(F.concat_ws(" ", a, b), "[^a-z0-9]+"), lambda x: x != "")
    held = F.size(F.array_except(words, F.split(t, "[^a-z0-9]+"))) == 0
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", ((F.length(a) + F.length(b) >= 4) & F.contains(key(t), key(F.concat(b, a)))).alias("contiguous"), held.alias("all_words"))


@query("""SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes, row_number() OVER (ORDER BY octet_length(encode(coalesce(text, ''))), source NULLS LAST, doc_id)::BIGINT AS position FROM documents""")
def conversion_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order in which they are converted: smaller ones first, then by source and number."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return numbered(table(spark, sf_dir, "documents").select("doc_id", "source", size.alias("bytes")), F.col("bytes"), "source", "doc_id").select("doc_id", "bytes", "position")


@query("""WITH r AS (SELECT p_type AS rule, bool_or(p_size > 48) AS active, count(*) FILTER (p_size < 3) > 0 AS approved FROM part GROUP BY 1) SELECT rule, active, approved, active AND NOT approved AS invalid FROM r""")
def rule_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that are active without being approved."""
    g = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("rule")).agg(F.bool_or(F.col("p_size") > 48).alias("active"), (F.count_if(F.col("p_size") < 3) > 0).alias("approved"))
    return g.withColumn("invalid", F.col("active") & ~F.col("approved"))
