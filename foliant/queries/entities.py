"""Entities: name matching, best matches, change detection, containment, selection, set operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.text import name_key, quote_key, ratio
from foliant.operators.ranking import numbered
from foliant.plans.registry import query
from foliant.tables import settled, table


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key: normal forms of names in several spellings: two words, with the brand set in, turned round."""
    p = table(spark, sf_dir, "part")
    first, last, brand = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1), F.lower("p_brand")
    spelled = F.explode(F.array(F.col("p_name"), F.concat_ws(" ", first, brand, last), F.concat_ws(", ", last, first)))
    return p.select(spelled.alias("name")).select(name_key(F.col("name")).alias("key")).distinct()


_NAMES = """n AS (SELECT DISTINCT trim(regexp_replace(regexp_replace(lower(s), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM (
  SELECT unnest([p_name, concat_ws(' ', string_split(p_name, ' ')[1], lower(p_brand), string_split(p_name, ' ')[-1]), concat_ws(', ', string_split(p_name, ' ')[-1], string_split(p_name, ' ')[1])]) AS s FROM part)),
t AS (SELECT key, list_distinct(string_split(key, ' ')) AS k FROM n)"""
_MATCH = "(CASE WHEN len(a.k) <= len(b.k) THEN list_has_all(b.k, a.k) ELSE list_has_all(a.k, b.k) END AND (least(len(a.k), len(b.k)) >= 2 OR len(a.k) = len(b.k)))"


def matching(keys: DataFrame) -> DataFrame:
    """a, b: pairs of names (a before b) of which one's words are all in the other's, two at least or all.

    A name's rarest word must be in any name that holds all its words: names meet by that word only.
    """
    held = keys.select("key", F.array_distinct(F.split("key", " ")).alias("k"))
    words = held.select("key", "k", F.explode("k").alias("word"))
    rarity = words.groupBy("word").agg(F.count("*").alias("n"))
    rarest = words.join(rarity, "word").groupBy("key", "k").agg(F.min(F.struct("n", "word")).alias("r")).select(F.col("key").alias("small"), F.col("k").alias("s"), F.col("r.word").alias("word"))
    fits = (F.size(F.array_except("s", "k")) == 0) & ((F.size("s") >= 2) | (F.size("s") == F.size("k")))
    met = rarest.join(words, "word").where((F.col("small") != F.col("key")) & fits)
    return met.select(F.least("small", "key").alias("a"), F.greatest("small", "key").alias("b")).distinct()


@query(f"WITH {_NAMES} SELECT a.key AS left_name, b.key AS right_name FROM t a JOIN t b ON a.key < b.key AND {_MATCH}")
def lender_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of one lender: all words of the shorter are in the longer, in any order."""
    return matching(names(spark, sf_dir)).select(F.col("a").alias("left_name"), F.col("b").alias("right_name"))


@query(f"""WITH RECURSIVE {_NAMES}, o AS (SELECT key, k, row_number() OVER (ORDER BY length(key) DESC, key) AS i FROM t),
e AS (SELECT b.i AS i, a.i AS j FROM o a JOIN o b ON a.i < b.i AND {_MATCH}),
r(round, i, kind) AS (
  SELECT 0, i, 'open' FROM o
  UNION ALL
  (WITH s AS MATERIALIZED (SELECT * FROM r),
   near AS (SELECT e.i, bool_or(s.kind = 'canonical') AS held, bool_and(s.kind = 'attached') AS free FROM e JOIN s ON s.i = e.j GROUP BY e.i)
   SELECT round + 1, s.i, CASE WHEN s.kind <> 'open' THEN s.kind WHEN near.i IS NULL OR near.free THEN 'canonical' WHEN near.held THEN 'attached' ELSE 'open' END
   FROM s LEFT JOIN near USING (i) WHERE EXISTS (SELECT 1 FROM s WHERE kind = 'open'))),
final AS (SELECT i, kind FROM r QUALIFY round = max(round) OVER ()),
best AS (SELECT e.i, min(e.j) AS j FROM e JOIN final f ON f.i = e.j AND f.kind = 'canonical' GROUP BY e.i)
SELECT o.key AS name, CASE WHEN f.kind = 'canonical' THEN o.key ELSE c.key END AS canonical FROM o JOIN final f USING (i) LEFT JOIN best USING (i) LEFT JOIN o c ON c.i = best.j""")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name's canonical spelling: longest first, a name attaches to the first canonical one that it matches.

    Decided in rounds over the matching pairs: a name whose earlier matches are all attached is
    canonical, one with a canonical earlier match is attached. Rounds are as many as matches chain.
    """
    keys = names(spark, sf_dir)
    rank = lambda c: F.struct((-F.length(c)).alias("l"), F.col(c).alias("key"))
    pairs = matching(keys).select(F.when(rank("a") < rank("b"), F.col("a")).otherwise(F.col("b")).alias("before"), F.when(rank("a") < rank("b"), F.col("b")).otherwise(F.col("a")).alias("key"))
    pairs = settled(pairs)
    state = settled(keys.withColumn("kind", F.lit("open")))
    while not state.where("kind = 'open'").isEmpty():
        near = pairs.join(state.select(F.col("key").alias("before"), F.col("kind").alias("theirs")), "before").groupBy("key").agg(F.bool_or(F.col("theirs") == "canonical").alias("held"), F.bool_and(F.col("theirs") == "attached").alias("free"))
        kind = F.when(F.col("kind") != "open", F.col("kind")).when(F.coalesce("free", F.lit(True)), "canonical").when(F.col("held"), "attached").otherwise("open")
        state = settled(state.join(near, "key", "left").select("key", kind.alias("kind")))
    canonical = state.where("kind = 'canonical'").select(F.col("key").alias("before"))
    best = pairs.join(canonical, "before").groupBy("key").agg(F.min(rank("before")).alias("c"))
    return state.join(best, "key", "left").select(F.col("key").alias("name"), F.when(F.col("kind") == "canonical", F.col("key")).otherwise(F.col("c.key")).alias("canonical"))


#: Pairs of names and of variants with the brand set in that share their first word.
_PAIRS = """pairs AS (SELECT DISTINCT p.p_name AS a, v.variant AS b FROM part p JOIN (
  SELECT DISTINCT string_split(p_name, ' ')[1] || ' ' || lower(p_brand) || ' ' || string_split(p_name, ' ')[-1] AS variant FROM part) v ON string_split(p.p_name, ' ')[1] = string_split(v.variant, ' ')[1])"""
_LCS = """list_reduce(string_split(a, ''), lambda line, c: list_reduce(range(1, length(b) + 1), lambda made, j: list_append(made,
  CASE WHEN b[j] = c THEN line[j] + 1 ELSE greatest(line[j + 1], made[-1]) END), [0::BIGINT]), list_resize([]::BIGINT[], length(b) + 1, 0))[-1]"""
_RATIO = f"{_PAIRS}, scored AS (SELECT a, b, round(200.0::DOUBLE * {_LCS} / (length(a) + length(b)), 4) AS ratio FROM pairs)"


@query(f"WITH {_RATIO} SELECT a, b, ratio FROM scored")
def name_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of names and variants with the same first word."""
    p = table(spark, sf_dir, "part")
    n = p.select(F.col("p_name").alias("a"), F.substring_index("p_name", " ", 1).alias("block")).distinct()
    v = p.select(F.concat_ws(" ", F.substring_index("p_name", " ", 1), F.lower("p_brand"), F.substring_index("p_name", " ", -1)).alias("b"), F.substring_index("p_name", " ", 1).alias("block")).distinct()
    return n.join(v, "block").select("a", "b", F.round(ratio(F.col("a"), F.col("b")), 4).alias("ratio"))


@query(f"WITH {_RATIO} SELECT b AS variant, a AS p_name, ratio AS score FROM scored QUALIFY row_number() OVER (PARTITION BY b ORDER BY ratio DESC, a) = 1")
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best name of each variant: highest ratio, ties to the smaller name."""
    best = F.min(F.struct((-F.col("ratio")).alias("r"), F.col("a").alias("a"))).alias("m")
    return name_ratio(spark, sf_dir).groupBy(F.col("b").alias("variant")).agg(best).select("variant", F.col("m.a").alias("p_name"), (-F.col("m.r")).alias("score"))


@query("""WITH b AS (SELECT item_id, lower(regexp_replace(text, '[^0-9A-Za-zÀ-ɏ]', '', 'g')) AS k FROM benchmark), d AS (SELECT doc_id, lower(regexp_replace(text, '[^0-9A-Za-zÀ-ɏ]', '', 'g')) AS k FROM documents)
SELECT item_id, doc_id FROM b JOIN d ON b.k <> '' AND contains(d.k, b.k)""")
def quote_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which quotes, compared by letters and digits."""
    return found_quotes(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


#: Letters of a gram, grams of a window, letters that a quote of one window has at least.
GRAM, WINDOW = 8, 16
LONG = GRAM + WINDOW - 1


def _grams(text: str, size: int, window: int) -> np.ndarray:
    """Distinct hashes of the runs of `size` letters of a text that are the least of `window` consecutive ones."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(code) < size + window - 1:
        return np.empty(0, np.int64)
    found = np.zeros(len(code) - size + 1, np.uint64)
    for i in range(size):
        found = (found ^ code[i : i + len(found)]) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(29)
    if window > 1:
        found = np.lib.stride_tricks.sliding_window_view(found, window).min(axis=1)
    return np.unique(found).view(np.int64)


def grams(keyed: DataFrame, size: int, window: int, first: int | None = None) -> DataFrame:
    """id, gram: the grams of every key (of its first letters only, if a number is given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([_grams((k.as_py() or "")[:first], size, window) for k in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["id", "grams"])

    return keyed.select("id", "key").mapInArrow(run, "id bigint, grams array<bigint>").select("id", F.explode("grams").alias("gram"))


def found_quotes(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, doc_id: documents that hold every fragment of a quote; ellipses part fragments, a quote without letters or digits is nowhere.

    A quote's longest fragment meets documents by one gram of letters: of the fragment's first
    window the least, which every document that holds the fragment has as the least of that window
    (windows of all texts are reduced to their least grams). Fragments shorter than a window meet by
    all grams of their length, in passes of their own that run only where there are such quotes.
    What meets is compared by its letters.
    """
    fragments = F.filter(F.transform(F.split("text", r"\.{3,}|…"), quote_key), lambda x: x != "")
    b = quotes.select("item_id", fragments.alias("fragments")).where(F.size("fragments") > 0)
    longest = F.get(F.array_sort("fragments", lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0)), F.lit(0))
    b = settled(b.withColumn("key", longest))
    lengths = [r.n for r in b.select(F.least(F.length("key"), F.lit(LONG)).alias("n")).distinct().collect()]  # LONG rows at most
    d = docs.select(F.col("doc_id").alias("id"), quote_key(F.col("text")).alias("key"))
    pairs = quotes.sparkSession.createDataFrame([], "item_id bigint, doc_id bigint")
    for n in sorted(lengths):
        size, window = min(n, GRAM), WINDOW if n == LONG else 1
        own = b.where(F.least(F.length("key"), F.lit(LONG)) == n).select(F.col("item_id").alias("id"), "key")
        own = grams(own, size, window, size + window - 1).withColumnRenamed("id", "item_id")
        pairs = pairs.union(own.join(grams(d, size, window).withColumnRenamed("id", "doc_id"), "gram").select("item_id", "doc_id"))
    keyed = docs.select("doc_id", quote_key(F.col("text")).alias("key"))
    held = pairs.distinct().join(b.select("item_id", "fragments"), "item_id").join(keyed, "doc_id")
    return held.where(F.forall("fragments", lambda x: F.contains(F.col("key"), x))).select("item_id", "doc_id")


_STATE = "old AS (SELECT doc_id, md5(text) AS h FROM documents WHERE n_chars % 4 <> 1), new AS (SELECT doc_id, md5(CASE WHEN n_chars % 10 = 2 THEN text || '!' ELSE text END) AS h FROM documents WHERE n_chars % 5 <> 3)"


@query(f"""WITH {_STATE} SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'add' WHEN n.doc_id IS NULL THEN 'remove' WHEN o.h <> n.h THEN 'update' ELSE 'keep' END AS action FROM old o FULL JOIN new n USING (doc_id)""")
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of a folder compared by content hash."""
    d = table(spark, sf_dir, "documents")
    old = d.where(F.col("n_chars") % 4 != 1).select("doc_id", F.md5(F.col("text").cast("binary")).alias("o"))
    new = d.where(F.col("n_chars") % 5 != 3).select("doc_id", F.md5(F.when(F.col("n_chars") % 10 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")).cast("binary")).alias("n"))
    action = F.when(F.col("o").isNull(), "add").when(F.col("n").isNull(), "remove").when(F.col("o") != F.col("n"), "update").otherwise("keep")
    return old.join(new, "doc_id", "full").select("doc_id", action.alias("action"))


@query("SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT d.source FROM documents d JOIN labels l USING (doc_id) JOIN embeddings e ON e.vec_id = d.doc_id WHERE l.toxic = 1 AND d.source IS NOT NULL)")
def orphan_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources without an indexed vector of a reported document."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    held = d.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")
    return d.select("source").distinct().join(held.select("source").distinct(), "source", "left_anti")


@query("""WITH p AS (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY ALL), w AS (SELECT l_partkey, 1.0::DOUBLE / count(*) AS w FROM p GROUP BY 1)
SELECT l_suppkey, round(sum(w), 6) AS weight, row_number() OVER (ORDER BY round(sum(w), 6) DESC, l_suppkey) AS position FROM p JOIN w USING (l_partkey) GROUP BY l_suppkey""")
def document_weight_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All persons by document weight: each document gives one, shared by its distinct persons."""
    p = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    w = p.groupBy("l_partkey").agg((F.lit(1.0) / F.count("*")).alias("w"))
    g = p.join(w, "l_partkey").groupBy("l_suppkey").agg(F.round(F.sum("w"), 6).alias("weight"))
    return numbered(g, -F.col("weight"), "l_suppkey")


@query("""WITH a AS (SELECT DISTINCT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), b AS (SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_orderstatus = 'F')
SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'missing' WHEN a.c_custkey IS NULL THEN 'unexpected' ELSE 'covered' END AS coverage FROM a FULL JOIN b USING (c_custkey)""")
def classification_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against classified: covered, missing, unexpected."""
    a = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit(1).alias("x")).distinct()
    b = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("y")).distinct()
    return a.join(b, "c_custkey", "full").select("c_custkey", F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "unexpected").otherwise("covered").alias("coverage"))


@query("SELECT DISTINCT lower(n_name) AS name FROM nation UNION SELECT DISTINCT lower(r_name) FROM region")
def dataset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of the names of two domains, each once."""
    return table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name")).union(table(spark, sf_dir, "region").select(F.lower("r_name"))).distinct()


@query("""WITH r AS (SELECT c_custkey, c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer WHERE c_mktsegment <> 'MACHINERY')
SELECT c_nationkey, c_custkey, n::INT AS position FROM r WHERE n <= 5""")
def expert_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best members of each category, without excluded ones."""
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return table(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'").withColumn("position", n).where("position <= 5").select("c_nationkey", "c_custkey", "position")


@query("""SELECT c_custkey, count(o_orderkey)::BIGINT AS matches, CASE count(o_orderkey) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'several' END AS found FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey""")
def investor_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records each member matches."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    m = F.coalesce("n", F.lit(0))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", m.alias("matches"), F.when(m == 0, "none").when(m == 1, "one").otherwise("several").alias("found"))
