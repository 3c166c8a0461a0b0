"""Document transforms: normal form, pages, tables, segments, chunks, identities, web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions import text as T
from foliant.plans.registry import query
from foliant.tables import table


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line: the lines of every text."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


_LINES = "lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query("""SELECT doc_id, md5(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F]+', ' ', 'g')) AS text_md5,
  (text <> regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F]+', ' ', 'g')) AS changed, 0.0::DOUBLE AS private_use FROM documents""")
def doc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form, whether it differs, and the share of private-use characters."""
    d = table(spark, sf_dir, "documents").withColumn("clean", T.normalized(F.col("text")))
    return d.select("doc_id", F.md5(F.col("clean").cast("binary")).alias("text_md5"), (F.col("text") != F.col("clean")).alias("changed"), T.private_use_share(F.col("text")).alias("private_use"))


@query("""SELECT conv_id, page, md5(string_agg(text, chr(10) ORDER BY turn)) AS body_md5 FROM (
  SELECT conv_id, turn, text, CASE WHEN count(CASE WHEN turn % 3 = 2 THEN 1 END) OVER w = 0 THEN 'n/a' ELSE (count(CASE WHEN turn % 3 = 2 THEN 1 END) OVER w)::VARCHAR END AS page
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE trim(coalesce(text, '')) <> '' GROUP BY ALL""")
def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines up to the first page marker are page n/a; every third turn stands for a marker; blank ones go."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.count(F.when(F.col("turn") % 3 == 2, 1)).over(w)
    paged = table(spark, sf_dir, "conversations").withColumn("page", F.when(n == 0, "n/a").otherwise(n.cast("string")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return paged.where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy("conv_id", "page").agg(F.md5(body.cast("binary")).alias("body_md5"))


_KIND = "CASE WHEN contains(line, '|') THEN 'table' ELSE 'prose' END"


@query(f"""WITH {_LINES}, marked AS (
  SELECT *, {_KIND} AS kind, CASE WHEN lag({_KIND}) OVER (PARTITION BY doc_id ORDER BY line_no) IS DISTINCT FROM {_KIND} THEN 1 ELSE 0 END AS fresh FROM lines),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_no) AS segment_no FROM marked)
SELECT doc_id, segment_no::BIGINT AS segment_no, any_value(kind) AS kind, count(*)::BIGINT AS n_lines FROM numbered GROUP BY doc_id, segment_no""")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive table lines are one block, the lines between are prose; all within a document's row."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.contains(x, F.lit("|"))).alias("t"))
    starts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    found = F.transform("s", lambda i, k: F.struct(F.when(F.get("t", i), "table").otherwise("prose").alias("kind"), (F.coalesce(F.get("s", k + 1), F.size("t")) - i).cast("long").alias("n_lines")))
    blocks = d.select("doc_id", "t", starts.alias("s")).select("doc_id", F.posexplode(found).alias("n", "b"))
    return blocks.select("doc_id", (F.col("n") + 1).cast("long").alias("segment_no"), "b.kind", "b.n_lines")


@query(f"""WITH {_LINES}, packed AS (
  SELECT doc_id, list_reduce(list(length(line) ORDER BY line_no), lambda acc, x:
    CASE WHEN (acc & 4294967295) = 0 THEN acc + x WHEN (acc & 4294967295) + 1 + x <= 1000 THEN acc + 1 + x ELSE ((acc >> 32) + 1) * 4294967296 + x END, 4294967296::BIGINT) AS last FROM lines GROUP BY doc_id)
SELECT doc_id, (last >> 32)::BIGINT AS n_bodies, (last & 4294967295)::BIGINT AS last_chars FROM packed""")
def pack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rows packed greedily into bodies of 1000 characters, a line end costs one: bodies and the last one's size."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.length(x)).alias("n"))
    state = F.struct(F.lit(1).cast("long").alias("body"), F.lit(0).cast("long").alias("chars"))
    step = lambda s, x: (
        F.when(s["chars"] == 0, F.struct(s["body"].alias("body"), x.cast("long").alias("chars")))
        .when(s["chars"] + 1 + x <= 1000, F.struct(s["body"].alias("body"), (s["chars"] + 1 + x).alias("chars")))
        .otherwise(F.struct((s["body"] + 1).alias("body"), x.cast("long").alias("chars")))
    )
    return rows.select("doc_id", F.aggregate("n", state, step).alias("s")).select("doc_id", F.col("s.body").alias("n_bodies"), F.col("s.chars").alias("last_chars"))


#: Texts with more characters or chunks are not indexed.
MAX_CHARACTERS, MAX_CHUNKS = 500_000, 500


@query("""SELECT doc_id, part, substr(text, (part * 900 + 1)::BIGINT, 1000) AS chunk FROM (
  SELECT doc_id, text, unnest(range(0, (greatest(length(text) - 101, 0) // 900 + 1)::BIGINT)) AS part FROM documents
  WHERE length(text) <= 500000 AND greatest(length(text) - 101, 0) // 900 + 1 <= 500)""")
def overlap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 1000 characters, each 100 into the one before; texts over the size caps are left out."""
    return chunks(table(spark, sf_dir, "documents"))


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, part (from 0), chunk: of every text within the size caps."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 101, F.lit(0)), F.lit(900))
    d = docs.where(F.length("text") <= MAX_CHARACTERS).select("doc_id", "text", starts.alias("starts")).where(F.size("starts") <= MAX_CHUNKS)
    return d.select("doc_id", "text", F.posexplode("starts").alias("part", "at")).select("doc_id", F.col("part").cast("long").alias("part"), F.substring("text", F.col("at") + 1, F.lit(1000)).alias("chunk"))


@query(f"""WITH {_LINES} SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS chunk_id, count(*)::BIGINT AS n_repeats
FROM (SELECT doc_id, md5(doc_id::VARCHAR || '_' || line) AS h FROM lines WHERE trim(line) <> '') GROUP BY ALL""")
def chunk_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal text within a document is one chunk."""
    held = lines(table(spark, sf_dir, "documents")).where(F.trim("line") != "")
    return held.groupBy("doc_id", T.chunk_id(F.col("doc_id").cast("string"), F.col("line")).alias("chunk_id")).agg(F.count("*").alias("n_repeats"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9_]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  lower(regexp_replace(p_name || ', ' || p_brand, '[^0-9A-Za-zÀ-ɏ]', '', 'g')) AS quote_key FROM part""")
def slug_and_quote_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"), T.quote_key(F.concat_ws(", ", "p_name", "p_brand")).alias("quote_key"))


@query("""WITH d AS (SELECT source, doc_id // 10000 AS block, doc_id::VARCHAR || ':' || sha256(text) AS e FROM documents),
b AS (SELECT source, block, sha256(string_agg(e, chr(10) ORDER BY e)) AS h, count(*) AS n FROM d GROUP BY ALL)
SELECT source, sha256(string_agg(h, chr(10) ORDER BY block)) AS sha256, sum(n)::BIGINT AS n_docs FROM b GROUP BY source""")
def dataset_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-independent fingerprint of each source's documents in two levels: of blocks of 10,000 numbers, then of the blocks.

    A task gathers the digests of one block, or one digest for each block of a source.
    """
    d = table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 10000).alias("block"), F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2(F.col("text").cast("binary"), 256)).alias("e"))
    digest = lambda lines: F.sha2(F.array_join(lines, "\n").cast("binary"), 256)
    blocks = d.groupBy("source", "block").agg(digest(F.array_sort(F.collect_list("e"))).alias("h"), F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda x: x["h"])
    return blocks.groupBy("source").agg(digest(ordered).alias("sha256"), F.sum("n").alias("n_docs"))


@query("""SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'), lambda m: lower(m))) AS e, 0 AS x FROM documents""".replace(
    "SELECT doc_id, list_distinct", "SELECT doc_id, array_to_string(list_sort(e), ',') AS emails, len(e)::INT AS n FROM (SELECT doc_id, list_distinct").replace(", 0 AS x FROM documents", " FROM documents) WHERE len(e) > 0"))
def roster_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct e-mail addresses of each document."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.emails(F.col("text")).alias("e")).where(F.size("e") > 0)
    return d.select("doc_id", F.array_join(F.array_sort("e"), ",").alias("emails"), F.size("e").alias("n"))


#: Table headers (DOC6 to DOC9), on rows built from parts.
_NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_CELL_ROWS = "rows AS (SELECT p_brand AS sheet, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INT AS idx, [p_name, p_type, p_size::VARCHAR, round(p_retailprice, 2)::VARCHAR] AS cells FROM part)"


@query(f"""WITH {_CELL_ROWS} SELECT sheet, idx, list_sum(list_transform(cells, lambda c: CASE WHEN trim(c) = '' THEN 0 WHEN regexp_matches(c, '{_NUMERIC}') THEN -1 ELSE 1 END))::INT AS score,
  len(list_filter(cells, lambda c: trim(c) <> '' AND NOT regexp_matches(c, '{_NUMERIC}')))::INT AS labels FROM rows WHERE idx <= 6""")
def table_header_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate header row gains one for a label and loses one for a number."""
    cells = F.array("p_name", "p_type", F.col("p_size").cast("string"), F.round("p_retailprice", 2).cast("string"))
    idx = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("sheet"), idx.alias("idx"), cells.alias("cells")).where("idx <= 6")
    number = lambda c: c.rlike(_NUMERIC)
    score = F.aggregate("cells", F.lit(0), lambda s, c: s + F.when(F.trim(c) == "", 0).when(number(c), -1).otherwise(1))
    return rows.select("sheet", "idx", score.alias("score"), F.size(F.filter("cells", lambda c: (F.trim(c) != "") & ~number(c))).alias("labels"))


#: Web pages.
_STOP_SEGMENTS = ("login", "signin", "register", "cart", "checkout", "privacy", "terms", "imprint", "impressum", "cookies", "legal")
_TITLE = r"(?s)<title>(.*?)</title>"
_SCRIPT = r"(?s)<(script|style|noscript|svg)[^>]*>.*?</(script|style|noscript|svg)>"


@query(f"""SELECT page_id, trim(regexp_extract(html, '{_TITLE}', 1)) AS title, len(list_distinct(regexp_extract_all(html, 'href="([^"#]+)"', 1)))::INT AS n_links,
  length(trim(regexp_replace(regexp_replace(regexp_replace(html, '{_SCRIPT}', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')))::INT AS text_len FROM pages""")
def page_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, distinct links and length of the visible text of each page."""
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", _SCRIPT, " "), "<[^>]*>", " "), r"\s+", " ")
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"#]+)"'), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract("html", _TITLE, 1)).alias("title"), F.size(links).alias("n_links"), F.length(F.trim(body)).alias("text_len"))


_SEGMENT_RE = "/(" + "|".join(_STOP_SEGMENTS) + ")(/|$)"


@query(f"""WITH u AS (SELECT page_id, regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)([^?#]*)(\\?[^#]*)?', ['s', 'h', 'p', 'q']) AS p FROM pages)
SELECT page_id, lower(p.s) || '://' || lower(p.h) || CASE WHEN p.p = '' THEN '/' ELSE p.p END || p.q AS url_norm, regexp_matches(lower(p.p), '{_SEGMENT_RE}') AS excluded FROM u""")
def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheme and host lower-case, no fragment, default path; whether a stop segment excludes it."""
    part = lambda i: F.regexp_extract("url", r"^([A-Za-z]+)://([^/?#]*)([^?#]*)(\?[^#]*)?", i)
    p = table(spark, sf_dir, "pages").select("page_id", *[part(i).alias(c) for i, c in ((1, "s"), (2, "h"), (3, "p"), (4, "q"))])
    norm = F.concat(F.lower("s"), F.lit("://"), F.lower("h"), F.when(F.col("p") == "", "/").otherwise(F.col("p")), "q")
    return p.select("page_id", norm.alias("url_norm"), F.lower("p").rlike(_SEGMENT_RE).alias("excluded"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, html FROM pages),
m AS (SELECT page_id, host, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM p)
SELECT page_id, host, (contains(lower(title), 'cheap') OR contains(lower(title), 'casino') OR contains(host, 'spam') OR contains(host, 'pills')) AS spam FROM m""")
def page_spam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose title or host carries a spam label."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.lower(F.regexp_extract("html", _TITLE, 1)).alias("title"))
    spam = F.contains("title", F.lit("cheap")) | F.contains("title", F.lit("casino")) | F.contains("host", F.lit("spam")) | F.contains("host", F.lit("pills"))
    return p.select("page_id", "host", spam.alias("spam"))


#: Extensions and names that are never ingested (fixed values).
IGNORED_EXTENSIONS = ("svg png jpg jpeg gif webp ico mp4 avi mov mkv wmv mp3 wav aac flac m4a zip rar 7z tar gz exe bin dll so dmg ai eps psd indd sketch fig gdoc gsheet gslide gdraw").split()
IGNORED_NAMES = (".DS_Store", "__active_dataset__.md", "__archived_dataset__.md", "application.raw.json", "manifest.json")
_EXT = ["md", "pdf", "png", "zip", "txt", "json", "xlsx"]


@query(f"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'manifest.json' ELSE 'file_' || doc_id || '.' || {_EXT}[(doc_id % 7 + 1)::INT] END AS name FROM documents)
SELECT doc_id, name FROM f WHERE list_position({IGNORED_EXTENSIONS}, regexp_extract(name, '\\.([^.]+)$', 1)) IS NULL AND list_position({list(IGNORED_NAMES)}, name) IS NULL""".replace("list_position(", "list_position("))
def ingestible_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names that are ingested: no media, archive or design files, no bookkeeping names."""
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXT]), (F.col("doc_id") % 7 + 1).cast("int"))
    name = F.when(F.col("doc_id") % 11 == 0, "manifest.json").otherwise(F.concat(F.lit("file_"), F.col("doc_id"), F.lit("."), ext))
    f = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))
    return f.where(~F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*IGNORED_EXTENSIONS) & ~F.col("name").isin(*IGNORED_NAMES))
