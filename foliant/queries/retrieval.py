"""Retrieval: tokens, BM25, dense top-k, fusion, interleaving, reranking, diversity, context packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.text import STOPWORDS, tokens
from foliant.operators.search import cosine_top_k, weight_top_k
from foliant.plans.registry import query
from foliant.tables import settled, table

#: BM25: saturation, length share, fixed average length in tokens.
K1, B, AVERAGE = 1.2, 0.75, 120.0
#: Reciprocal-rank fusion constant.
RRF = 60
QUERIES = ((1, "thond ing tion"), (2, "mentelle eauon queaux"), (3, "heit ung schver"))
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
#: The tokens of documents in DuckDB.
TOKENS_SQL = f"""tok AS (
  SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'),
         lambda w: length(w) BETWEEN 2 AND 40 AND w NOT IN ({_STOP}))) AS term FROM documents)"""
_WEIGHT_SQL = f"""weights AS (
  SELECT doc_id, term, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / 120.0::DOUBLE)) AS weight
  FROM (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM tok GROUP BY ALL) JOIN (SELECT doc_id, count(*)::DOUBLE AS n FROM tok GROUP BY ALL) USING (doc_id))"""


def _weight(tf: Column, n: Column) -> Column:
    """A term's weight in a document of n tokens that holds it tf times."""
    tf = tf.cast("double")
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n.cast("double") / AVERAGE))


def document_weights(docs: DataFrame) -> DataFrame:
    """doc_id, term, weight: BM25 document weights, without the collection's share. A text is tokenised once, its tokens counted before they are shuffled."""
    held = docs.select("doc_id", tokens(F.col("text")).alias("t"))
    counted = held.select("doc_id", F.size("t").alias("n"), F.explode("t").alias("term")).groupBy("doc_id", "n", "term").agg(F.count("*").alias("tf"))
    return counted.select("doc_id", "term", _weight(F.col("tf"), F.col("n")).alias("weight"))


@query(f"WITH {TOKENS_SQL} SELECT doc_id, count(*)::BIGINT AS n_tokens, count(DISTINCT term)::BIGINT AS n_distinct FROM tok GROUP BY doc_id")
def doc_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"WITH {TOKENS_SQL}, {_WEIGHT_SQL} SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def doc_bm25_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_weights(table(spark, sf_dir, "documents")).select("doc_id", "term", F.round("weight", 6).alias("weight"))


def asked_terms(spark: SparkSession, queries: tuple[tuple[int, str], ...] = QUERIES) -> DataFrame:
    """query, term of the given query texts."""
    return spark.createDataFrame(sorted({(q, w) for q, text in queries for w in text.split()}), "query long, term string")


def bm25_weights(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id, term, weight (document's and collection's share) of all terms that are asked for (asked: query, term).

    One pass over the texts looks each token up among the asked terms and writes each document's
    counts of those that are found as one text ("term=count", apart by blanks, which no term holds);
    an empty term stands for the document itself. The number of documents, their frequencies and the
    weights are read from that table, term by term but without being written again.
    """
    terms = F.broadcast(asked.select("term").union(asked.sparkSession.range(1).select(F.lit("").alias("term"))).distinct())  # what is asked for
    held = docs.select("doc_id", tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n"), F.array_append("t", F.lit("")).alias("t"))
    # The outer form: the other one would tokenise a second time to leave out empty arrays.
    found = held.select("doc_id", "n", F.explode_outer("t").alias("term")).join(terms, "term", "left_semi")
    # Dealt by document once: both counts below stay in their part.
    counts = found.repartition("doc_id", "n").groupBy("doc_id", "n", "term").agg(F.count("*").alias("tf"))
    lists = settled(counts.groupBy("doc_id", "n").agg(F.array_join(F.collect_list(F.concat("term", F.lit("="), F.col("tf").cast("string"))), " ").alias("posts")))
    each = lists.select("doc_id", "n", F.explode(F.split("posts", " ")).alias("post"))
    posts = each.select("doc_id", "n", F.substring_index("post", "=", 1).alias("term"), F.substring_index("post", "=", -1).cast("long").alias("tf"))
    size = posts.where("term = ''").agg(F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("docs"))
    wanted = posts.where("term <> ''").select("doc_id", "term", _weight(F.col("tf"), F.col("n")).alias("weight"))
    df = posts.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(size)).select("term", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))  # one row
    return wanted.join(F.broadcast(settled(idf)), "term").select("doc_id", "term", (F.col("weight") * F.col("idf")).alias("weight"))  # what is asked for


def bm25_top_k(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query, rank, doc_id, score: the k best documents that share a term with a query (asked: query, term)."""
    own = settled(asked)
    return weight_top_k(bm25_weights(docs, own), own, k)


_ASKED = ", ".join(f"({q}, '{w}')" for q, t in QUERIES for w in sorted(set(t.split())))
_BM25_SQL = f"""{TOKENS_SQL}, {_WEIGHT_SQL},
idf AS (SELECT term, ln(1 + ((SELECT count(DISTINCT doc_id) FROM tok) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM weights GROUP BY term),
bm25 AS (SELECT query, doc_id, round(sum(weight * idf), 6) AS score FROM weights JOIN idf USING (term) JOIN (VALUES {_ASKED}) q(query, term) USING (term) GROUP BY ALL)"""


def top_k(scored: DataFrame, k: int, by: str = "query", item: str = "doc_id") -> DataFrame:
    """Ranks 1 to k of each group, by score, ties to the smaller item."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), item))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


@query(f"WITH {_BM25_SQL} SELECT * FROM (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM bm25) WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_top_k(table(spark, sf_dir, "documents"), asked_terms(spark), 10).select("query", "rank", "doc_id", "score")


def dense(spark: SparkSession, sf_dir: str, k: int, among: Column | None = None) -> DataFrame:
    """query, rank, vec_id, label, score: the k nearest of each query; every fiftieth vec_id is a query.

    A condition on the rows searched comes before the ranking.
    """
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query"), "embedding")
    return cosine_top_k(vectors if among is None else vectors.where(among), queries, k)


_DENSE_SQL = """dense AS (
  SELECT q.vec_id AS query, e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
  FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)"""
_DENSE_TOP = _DENSE_SQL + """, top AS (
  SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INT AS rank, vec_id, label, score FROM dense QUALIFY rank <= 20)"""


@query(f"WITH {_DENSE_TOP} SELECT query, rank, vec_id, score FROM top WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir, 10).select("query", "rank", "vec_id", "score")


@query(f"WITH {_DENSE_TOP} SELECT * FROM (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM dense WHERE label = 3) WHERE rank <= 5")
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense top-k within one tenant: the filter comes before the ranking."""
    return dense(spark, sf_dir, 5, F.col("label") == 3).select("query", "rank", "vec_id", "score")


#: The text of a hybrid query: the first three distinct tokens of the document of the query's number.
_HYBRID_SQL = f"""{TOKENS_SQL}, {_WEIGHT_SQL}, {_DENSE_SQL},
asked AS (SELECT doc_id AS query, unnest(t[1:3]) AS term FROM (
  SELECT doc_id, list_reduce(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) BETWEEN 2 AND 40 AND w NOT IN ({_STOP})),
    lambda acc, w: CASE WHEN len(acc) >= 3 OR list_contains(acc, w) THEN acc ELSE list_append(acc, w) END, []::VARCHAR[]) AS t
  FROM documents WHERE doc_id % 50 = 0 AND doc_id IN (SELECT vec_id FROM embeddings))),
idf AS (SELECT term, ln(1 + ((SELECT count(DISTINCT doc_id) FROM tok) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM weights WHERE term IN (SELECT term FROM asked) GROUP BY term),
sparse AS (SELECT query, doc_id, round(sum(weight * idf), 6) AS score FROM weights JOIN idf USING (term) JOIN asked USING (term) GROUP BY ALL),
lists AS (
  SELECT query, doc_id AS id, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS r FROM sparse QUALIFY r <= 40
  UNION ALL SELECT query, vec_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS r FROM dense QUALIFY r <= 40),
fused AS (SELECT query, id, round(sum(1.0::DOUBLE / ({RRF} + r)), 9) AS score FROM lists GROUP BY ALL)"""


def hybrid(spark: SparkSession, sf_dir: str, limit: int = 40) -> DataFrame:
    """query, id, score: reciprocal-rank fusion of the sparse and the dense branch, each cut to its limit first."""
    docs = table(spark, sf_dir, "documents")
    numbers = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("doc_id"))
    asked = docs.join(numbers, "doc_id", "left_semi").select(F.col("doc_id").alias("query"), F.explode(F.slice(F.array_distinct(tokens(F.col("text"))), 1, 3)).alias("term"))
    sparse = bm25_top_k(docs, asked, limit).select("query", F.col("doc_id").alias("id"), "rank")
    near = dense(spark, sf_dir, limit).select("query", F.col("vec_id").alias("id"), "rank")
    return sparse.union(near).groupBy("query", "id").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 9).alias("score"))


@query(f"""WITH {_HYBRID_SQL} SELECT * FROM (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INT AS rank, id, score FROM fused) WHERE rank <= 10""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of both branches."""
    return top_k(hybrid(spark, sf_dir), 10, item="id").select("query", "rank", "id", "score")


@query(f"""WITH {_DENSE_TOP}, first AS (
  SELECT query // 500 AS request, vec_id, query, rank, row_number() OVER (PARTITION BY query // 500, vec_id ORDER BY rank, query) AS nth FROM top)
SELECT * FROM (SELECT request, row_number() OVER (PARTITION BY request ORDER BY rank, query)::INT AS position, vec_id, query FROM first WHERE nth = 1) WHERE position <= 25""")
def multi_query_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round robin over the lists of a request's queries by depth; the first occurrence of an id wins. Ten queries are a request."""
    lists = dense(spark, sf_dir, 20).withColumn("request", F.floor(F.col("query") / 500))
    first = lists.groupBy("request", "vec_id").agg(F.min(F.struct("rank", "query")).alias("f")).select("request", "vec_id", "f.*")
    position = F.row_number().over(Window.partitionBy("request").orderBy("rank", "query"))
    return first.withColumn("position", position).where("position <= 25").select("request", "position", "vec_id", "query")


@query(f"""WITH {_DENSE_TOP}, judged AS (
  SELECT query, rank, vec_id, (quality = 1)::INT AS good FROM top LEFT JOIN labels ON doc_id = vec_id)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY coalesce(good, -1) DESC, rank)::INT AS position, vec_id AS id FROM judged""")
def rerank_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that the reranker returned come first in its order, the others keep theirs."""
    lists = dense(spark, sf_dir, 20)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), (F.col("quality") == 1).cast("int").alias("good"))
    order = Window.partitionBy("query").orderBy(F.coalesce("good", F.lit(-1)).desc(), "rank")
    return lists.join(labels, "vec_id", "left").select("query", F.row_number().over(order).alias("position"), F.col("vec_id").alias("id"))


@query(f"""WITH {_DENSE_TOP}, held AS (
  SELECT query, rank, vec_id, row_number() OVER (PARTITION BY query, label ORDER BY rank) > greatest(1, round_even(20 * 0.15, 0)) AS demoted FROM top)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY demoted, rank)::INT AS position, vec_id, demoted FROM held""")
def document_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows beyond their document's share go behind the others; none is dropped."""
    k, share = 20, 0.15
    lists = dense(spark, sf_dir, k)
    own = F.row_number().over(Window.partitionBy("query", "label").orderBy("rank"))
    held = lists.withColumn("demoted", own > F.greatest(F.lit(1), F.bround(F.lit(k * share), 0)))
    return held.select("query", F.row_number().over(Window.partitionBy("query").orderBy("demoted", "rank")).alias("position"), "vec_id", "demoted")


@query("""SELECT conv_id, turn, cum_chars FROM (
  SELECT conv_id, turn, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS cum_chars FROM conversations) WHERE cum_chars <= 2000""")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation that fit a budget: a prefix, it stops at the first that does not fit."""
    turns = table(spark, sf_dir, "conversations")
    total = F.sum(F.length(F.coalesce("text", F.lit("")))).over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.select("conv_id", "turn", total.alias("cum_chars")).where("cum_chars <= 2000")


@query("""WITH c AS (SELECT conv_id, count(*) AS k, sum(length(coalesce(text, ''))) AS ctx FROM conversations GROUP BY conv_id)
SELECT conv_id, least(400, greatest(k, k * 4))::INT AS candidates, greatest(1, round_even(k * 0.4, 0))::INT AS per_document, greatest(6000, (ctx * 54) // 25)::BIGINT AS context_chars FROM c""")
def retrieval_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation, asked for as many chunks as it has turns and with as many tokens as it has characters: candidates, cap per document, context budget (0.72 of three characters a token)."""
    k, ctx = F.col("k"), F.col("ctx")
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("k"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("ctx"))
    per = F.greatest(F.lit(1), F.bround(k * F.lit(0.4).cast("decimal(3,1)"), 0)).cast("int")
    return c.select("conv_id", F.least(F.lit(400), F.greatest(k, k * 4)).cast("int").alias("candidates"), per.alias("per_document"), F.greatest(F.lit(6000), F.floor(ctx * 54 / 25)).cast("long").alias("context_chars"))


@query("""WITH ranked AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, (floor(100 / n) + CASE WHEN nth <= 100 % n THEN 1 ELSE 0 END)::BIGINT AS slots FROM ranked""")
def evidence_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of 100 slots over a conversation's questions: equal shares, the first take the rest."""
    w = Window.partitionBy("conv_id")
    nth, n = F.row_number().over(w.orderBy("turn")), F.count("*").over(w)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.floor(100 / n) + F.when(nth <= 100 % n, 1).otherwise(0)).cast("long").alias("slots"))


@query(f"""WITH {_HYBRID_SQL},
wide AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank, id FROM fused QUALIFY rank <= 40),
held AS (SELECT w.*, d.text, row_number() OVER (PARTITION BY w.query, d.source ORDER BY rank) > 4 AS demoted FROM wide w JOIN documents d ON d.doc_id = w.id),
spread AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY demoted, rank) AS place FROM held QUALIFY place <= 10),
judged AS (SELECT s.*, row_number() OVER (PARTITION BY query ORDER BY coalesce((quality = 1)::INT, -1) DESC, place)::INT AS position FROM spread s LEFT JOIN labels l ON l.doc_id = s.id),
packed AS (SELECT query, position, id, sum(length(coalesce(text, ''))) OVER (PARTITION BY query ORDER BY position)::BIGINT AS cum_chars FROM judged)
SELECT query, position, id, cum_chars FROM packed WHERE cum_chars <= 12000""")
def search_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole search: hybrid candidates, four times as many as wanted; share of a source held down; reranked; packed to a budget.

    Ten results are wanted: 40 candidates, at most four of a source before the others, the reranker's
    verdict first, then the prefix that fits 12,000 characters.
    """
    wide = top_k(hybrid(spark, sf_dir), 40, item="id")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).cast("int").alias("good"))
    by = Window.partitionBy("query")
    held = wide.join(docs, "id").withColumn("demoted", F.row_number().over(Window.partitionBy("query", "source").orderBy("rank")) > 4)
    spread = held.withColumn("place", F.row_number().over(by.orderBy("demoted", "rank"))).where("place <= 10")
    judged = spread.join(labels, "id", "left").withColumn("position", F.row_number().over(by.orderBy(F.coalesce("good", F.lit(-1)).desc(), "place")))
    packed = judged.select("query", "position", "id", F.sum("chars").over(by.orderBy("position")).alias("cum_chars"))
    return packed.where("cum_chars <= 12000")
