"""Parsing of dates, numbers, JSON, lists, names, urls; file and model names. Raw forms are spelled from typed columns and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.text import STOPWORDS, slug, tokens
from foliant.operators import crawl
from foliant.plans.registry import query
from foliant.tables import settled, table

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"
MONTHS = "January February March April May June July August September October November December".split()


def _nth(values, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), (number % len(values) + 1).cast("int"))


def iso_date(text: Column) -> Column:
    """Year, year and month, or day in one spelling, from five ways of writing; anything else stays as it is."""
    t = F.trim(text)
    number = lambda r, g: F.lpad(F.regexp_extract(t, r, g), 2, "0")
    month = lambda r, g: F.lpad(F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), F.lower(F.regexp_extract(t, r, g))).cast("string"), 2, "0")
    dotted, first, after, bare = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", r"^(\d{1,2})\.?\s+([A-Za-z]+)\s+(\d{4})$", r"^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})$", r"^([A-Za-z]+)\s+(\d{4})$"
    known = lambda r, g: t.rlike(r) & (month(r, g) != "00")
    return (
        F.when(t.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$"), t)
        .when(t.rlike(dotted), F.concat_ws("-", F.regexp_extract(t, dotted, 3), number(dotted, 2), number(dotted, 1)))
        .when(known(first, 2), F.concat_ws("-", F.regexp_extract(t, first, 3), month(first, 2), number(first, 1)))
        .when(known(after, 1), F.concat_ws("-", F.regexp_extract(t, after, 3), month(after, 1), number(after, 2)))
        .when(known(bare, 1), F.concat_ws("-", F.regexp_extract(t, bare, 2), month(bare, 1)))
        .otherwise(text)
    )


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 4 THEN strftime(o_orderdate, '%Y-%m') WHEN 5 THEN strftime(o_orderdate, '%Y') WHEN 6 THEN 'Smarch ' || strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso,
  CASE o_orderkey % 7 WHEN 4 THEN date_trunc('month', o_orderdate)::DATE WHEN 5 THEN date_trunc('year', o_orderdate)::DATE WHEN 6 THEN NULL ELSE o_orderdate::DATE END AS floored FROM orders""")
def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in seven ways, normalised, and as a day with missing parts floored."""
    d = lambda f: F.date_format("o_orderdate", f)
    raw = _nth([d("yyyy-MM-dd"), d("d.M.yyyy"), d("d MMMM yyyy"), d("MMMM d, yyyy"), d("MMMM yyyy"), d("yyyy"), F.concat(F.lit("Smarch "), d("yyyy"))], F.col("o_orderkey"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", iso_date(F.col("raw")).alias("iso"))
    full = F.concat("iso", F.when(F.length("iso") == 4, "-01-01").when(F.length("iso") == 7, "-01").otherwise(""))
    return o.select("o_orderkey", "iso", F.when(F.col("iso").rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$"), F.to_date(full)).alias("floored"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) // 1000000 * 1000000 WHEN 1 THEN epoch_us(ts) // 1000 * 1000 WHEN 2 THEN epoch_us(ts) // 1000000 * 1000000 END AS micros FROM events")
def epoch_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times given as seconds, milliseconds or ISO text, in microseconds of UTC; anything else is unknown."""
    micros = F.unix_micros("ts")
    raw = _nth([F.floor(micros / 1_000_000).cast("string"), F.floor(micros / 1000).cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("soon")], F.col("event_id"))
    e = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    number = F.col("raw").try_cast("double")
    read = F.when(number > 1e11, F.timestamp_millis(number.cast("long"))).when(number.isNotNull(), F.timestamp_seconds(number.cast("long"))).otherwise(F.try_to_timestamp("raw"))
    return e.select("event_id", F.unix_micros(read).alias("micros"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN 0.0 WHEN 1 THEN round(l_extendedprice, 2) WHEN 2 THEN -l_quantity WHEN 3 THEN NULL ELSE l_quantity END AS amount, l_linenumber % 5 = 3 AS percent FROM lineitem""")
def cell_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of cells: zero markers, grouped and bracketed numbers, numbers split by blanks; percentages are none."""
    q = F.format_string("%.0f", "l_quantity")
    cell = _nth([F.lit("–"), F.regexp_replace(F.format_number("l_extendedprice", 2), ",", "'"), F.concat(F.lit("("), q, F.lit(")")), F.concat(q, F.lit(" %")), F.concat(F.lit("CHF "), q)], F.col("l_linenumber"))
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cell.alias("cell"))
    bare = F.regexp_replace(F.regexp_replace("cell", r"CHF|EUR|USD|[$€]", ""), r"['’,\s]", "")
    read = F.when(F.trim("cell").isin("-", "–", "—", "nil"), 0.0).when(F.contains("cell", F.lit("%")), None).when(bare.rlike(r"^\(.*\)$"), -F.regexp_replace(bare, r"[()]", "").try_cast("double")).otherwise(bare.try_cast("double"))
    return c.select("l_orderkey", "l_linenumber", read.alias("amount"), F.contains("cell", F.lit("%")).alias("percent"))


def repaired_json(raw: Column) -> Column:
    """The JSON of an answer: out of a fenced block, from the first brace to the last, stray backslashes doubled, trailing commas gone."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(raw)
    span = F.regexp_extract(body, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.regexp_replace(F.regexp_replace(span, r'\\(?!["\\/bfnrtu])', r"\\\\"), r",\s*([}\]])", "$1")


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, CASE WHEN event_id % 4 = 3 THEN 'a\\x' END AS path FROM events")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects read from fenced, chatty, comma-ended and badly escaped answers."""
    k = F.get_json_object("props", "$.k")
    raw = _nth([F.concat(F.lit("```json\n"), "props", F.lit("\n```")), F.concat(F.lit("Here it is: "), "props", F.lit(" - done")), F.concat(F.lit('{"k": '), k, F.lit(",}")), F.concat(F.lit('{"path": "a\\x", "k": '), k, F.lit("}"))], F.col("event_id"))
    e = table(spark, sf_dir, "events").select("event_id", repaired_json(raw).alias("j"))
    return e.select("event_id", F.get_json_object("j", "$.k").cast("long").alias("k"), F.get_json_object("j", "$.path").alias("path"))


@query("""SELECT c_custkey, lower(substr(c_mktsegment, 1, 3)) || ';' || lower(c_mktsegment) AS chosen, n_name AS stage, 'US' || c_custkey % 3 AS currency, round(c_custkey % 7 / 10.0::DOUBLE, 1) AS rate, lower(replace(c_name, '#', '.')) || '@example.org' AS mail FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def argument_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments as typed: selectors (slugged, first of equals kept), stages by any spelling, rates CUR=RATE, people Name <mail>."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    seg = F.col("c_mktsegment")
    raw = c.select(
        "c_custkey", F.concat_ws(",", F.substring(seg, 1, 3), F.concat(F.lit(" "), seg, F.lit(" ")), F.lower(seg), F.lit("--")).alias("list"),
        F.concat(F.lit("  "), F.regexp_replace(F.initcap("n_name"), " ", "   ")).alias("stage"),
        F.concat(F.lit("us"), (F.col("c_custkey") % 3).cast("string"), F.lit("="), F.round(F.col("c_custkey") % 7 / 10.0, 1).cast("string")).alias("fx"), F.concat("c_name", F.lit(" <"), F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@Example.org>")).alias("who"),
    )
    chosen = F.array_distinct(F.filter(F.transform(F.split("list", ","), lambda x: slug(x)), lambda x: x != ""))
    stages = table(spark, sf_dir, "nation").select(F.col("n_name").alias("known"), F.lower("n_name").alias("fold"))
    fx = F.str_to_map("fx", F.lit(","), F.lit("="))
    out = raw.withColumn("fold", F.lower(F.trim(F.regexp_replace("stage", r"\s+", " ")))).join(F.broadcast(stages), "fold")  # the stages known
    currency = F.upper(F.get(F.map_keys(fx), F.lit(0)))
    return out.select("c_custkey", F.array_join(chosen, ";").alias("chosen"), F.col("known").alias("stage"), currency.alias("currency"), F.get(F.map_values(fx), F.lit(0)).cast("double").alias("rate"), F.lower(F.regexp_extract("who", r"<([^<>@\s]+@[^<>\s]+)>", 1)).alias("mail"))


#: Endings of file names that name a model (fixed values).
MODEL_TAG = r"(?i)-(manual|gpt|claude|gemini|gemma|qwen|deepseek|llama|mixtral|phi|mistral)[\w.-]*$"


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 3 THEN 'report' ELSE regexp_replace(lower(p_name), ' ', '-', 'g') END AS stem, regexp_replace(lower(p_name), ' ', '-', 'g') || '-audit-' || ['model-large', 'model', 'gpt-4'][p_size % 3 + 1] || '.md' AS artifact, 'datasets/' || regexp_replace(lower(p_name), ' ', '-', 'g') || '/insights' AS folder FROM part""")
def artifact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems without the model's tag (longest configured suffix, else a known family), artifact names and folders from a template."""
    s = slug(F.col("p_name"))
    model = _nth(["model-large", "model", "gpt-4"], F.col("p_size"))
    tagged = F.when(F.col("p_size") % 4 == 3, F.lit("report-gpt-4o.md")).otherwise(F.concat(s, F.lit("-"), _nth(["model-large", "model", "claude-x"], F.col("p_size")), F.lit(".md")))
    p = table(spark, sf_dir, "part").select("p_partkey", s.alias("s"), model.alias("m"), F.regexp_replace(tagged, r"\.[^.]*$", "").alias("t"))
    configured = sorted(("model-large", "model"), key=len, reverse=True)
    stem = F.regexp_replace("t", MODEL_TAG, "")
    for m in reversed(configured):
        stem = F.when(F.col("t").endswith("-" + m), F.expr(f"substring(t, 1, length(t) - {len(m) + 1})")).otherwise(stem)
    folder = F.replace(F.lit("datasets/{slug}/insights"), F.lit("{slug}"), F.col("s"))
    return p.select("p_partkey", stem.alias("stem"), F.concat(F.concat_ws("-", "s", F.lit("audit"), "m"), F.lit(".md")).alias("artifact"), folder.alias("folder"))


@query("""SELECT c_custkey, lower(replace(c_name, '#', ' ')) AS clean, 'member-' || c_custkey AS profile, 'Zurich Munster ' || c_custkey AS folded, CASE WHEN c_custkey % 3 = 0 THEN 'a@first.org' WHEN c_custkey % 3 = 1 THEN 'b@second.org' ELSE 'c@other.org' END AS preferred FROM customer""")
def name_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without symbols and controls, profile ids out of urls or text, accents folded, the preferred address by order of domains."""
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("☃ "), F.lower(F.replace("c_name", F.lit("#"), F.lit("\u0007  "))), F.lit(" ★"))
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.replace(name, F.lit("\u0007"), F.lit(" ")), r"[\p{So}\p{C}]", ""), r"\s+", " "))
    url = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("https://www.LinkedIn.com/in/Member-"), "c_custkey", F.lit("/?trk=x"))).otherwise(F.concat(F.lit(" Member "), "c_custkey"))
    bare = F.regexp_replace(F.trim(F.substring_index(url, "?", 1)), "/+$", "")
    found = F.lower(F.regexp_extract(bare, r"(?i)linkedin\.com/(?:in|pub)/([^/]+)", 1))
    profile = F.when(found != "", found).otherwise(slug(bare))
    folded = F.translate(F.concat(F.lit("Zürich Münster "), "c_custkey"), "àâäáãåçèéêëìíîïñòóôöõùúûüýÿÀÂÄÁÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")
    mails = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("c@other.org"), F.lit("b@second.org"), F.lit("a@first.org"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("c@other.org"), F.lit("b@second.org"))).otherwise(F.array(F.lit("c@other.org"), F.lit("d@other.org")))
    of = lambda d: F.get(F.filter(mails, lambda m: m.endswith("@" + d)), F.lit(0))
    return c.select("c_custkey", clean.alias("clean"), profile.alias("profile"), folded.alias("folded"), F.coalesce(of("first.org"), of("second.org"), F.get(mails, F.lit(0))).alias("preferred"))


@query("""SELECT doc_id, CASE WHEN greatest(1, (length(text) + 2) // 3) <= 1024 THEN 1024 ELSE least(131072, pow(2, ceil(log2(greatest(1, (length(text) + 2) // 3))))) END::BIGINT AS context FROM documents WHERE text IS NOT NULL""")
def context_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of a request: the next power of two of a third of its characters, within bounds."""
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / 3))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.when(n <= 1024, 1024).otherwise(F.least(F.lit(131072.0), F.pow(F.lit(2.0), F.ceil(F.log2(n))))).cast("long").alias("context"))


@query("""SELECT o_orderkey, md5('clerk=' || o_orderpriority || ';status=' || o_orderstatus) AS fingerprint, 'see file-' || o_custkey || '.pdf and file-' || o_orderkey || '.pdf' AS answer FROM orders""")
def snapshot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot's hash without its time of making; attachment urls in its answers replaced by file names."""
    o = table(spark, sf_dir, "orders")
    snapshot = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("generated_at"), F.col("o_orderdate").cast("string"), F.lit("clerk"), F.col("o_orderpriority"))
    kept = F.map_filter(snapshot, lambda k, _: k != "generated_at")
    joined = F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    files = F.create_map(F.concat(F.lit("https://files/"), F.col("o_custkey").cast("string")), F.concat(F.lit("file-"), F.col("o_custkey").cast("string"), F.lit(".pdf")), F.concat(F.lit("https://files/x"), F.col("o_orderkey").cast("string")), F.concat(F.lit("file-"), F.col("o_orderkey").cast("string"), F.lit(".pdf")))
    answer = F.concat(F.lit("see https://files/"), F.col("o_custkey").cast("string"), F.lit(" and https://files/x"), F.col("o_orderkey").cast("string"))
    replaced = F.aggregate(F.map_entries(files), answer, lambda a, e: F.replace(a, e["key"], e["value"]))
    return o.select("o_orderkey", F.md5(joined.cast("binary")).alias("fingerprint"), replaced.alias("answer"))


@query("""SELECT s_suppkey, 'CHE-' || lpad((s_suppkey % 1000)::VARCHAR, 3, '0') || '.' || lpad((s_suppkey * 7 % 1000)::VARCHAR, 3, '0') || '.' || lpad((s_suppkey * 13 % 1000)::VARCHAR, 3, '0') AS uid FROM supplier WHERE s_suppkey % 4 <> 3""")
def company_uids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company numbers found in text in any spacing, in one spelling; texts without one are left out."""
    part = lambda n: F.lpad((F.col("s_suppkey") * n % 1000).cast("string"), 3, "0")
    text = F.when(F.col("s_suppkey") % 4 == 3, F.lit("no number")).otherwise(F.concat(F.lit("VAT che"), _nth(["-", " ", ""], F.col("s_suppkey")), part(1), _nth([".", " ", ""], F.col("s_suppkey")), part(7), _nth([".", " ", ""], F.col("s_suppkey")), part(13), F.lit(" MWST")))
    r = r"(?i)\bCHE[-\s]?(\d{3})[.\s]?(\d{3})[.\s]?(\d{3})\b"
    g = lambda i: F.regexp_extract("text", r, i)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text")).where(F.col("text").rlike(r))
    return s.select("s_suppkey", F.concat(F.lit("CHE-"), F.concat_ws(".", g(1), g(2), g(3))).alias("uid"))


@query("""WITH u AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN h = 'old.example' OR false WHEN 2 THEN true ELSE false END AS allowed FROM u""")
def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redirects are followed to the same host (www or not) or an approved one, by http or https only."""
    host = lambda u: F.regexp_replace(F.lower(F.regexp_extract(u, r"^[A-Za-z]+://([^/?#:]*)", 1)), r"^www\.|\.$", "")
    h = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    target = _nth([F.concat(F.lit("https://www."), F.regexp_replace(h, r"^www\.", ""), F.lit("/x")), F.lit("https://old.example/"), F.lit("http://approved.example/a"), F.concat(F.lit("ftp://"), h)], F.col("page_id"))
    p = table(spark, sf_dir, "pages").select("page_id", "url", target.alias("target"))
    ok = (host(F.col("url")) == host(F.col("target"))) | host(F.col("target")).isin("approved.example")
    return p.select("page_id", (F.col("target").rlike(r"^https?://[^/]") & ok).alias("allowed"))


@query("""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"#]+)"', 1)) AS href FROM pages)
SELECT page_id, count(DISTINCT lower(href))::BIGINT AS targets, count(*) FILTER (regexp_matches(lower(href), '/(login|signin|register|cart|checkout|privacy|terms|imprint|impressum|cookies|legal)(/|$)'))::BIGINT AS excluded FROM l GROUP BY page_id""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct link targets of each page, and links that a stop segment excludes."""
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"#]+)"'), F.lit(1))).alias("href"))
    stop = F.lower("href").rlike("/(login|signin|register|cart|checkout|privacy|terms|imprint|impressum|cookies|legal)(/|$)")
    return links.groupBy("page_id").agg(F.countDistinct(F.lower("href")).alias("targets"), F.count_if(stop).alias("excluded"))


@query("""WITH t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS term FROM documents)
SELECT term, ('0x' || substr(sha256(term), 1, 8))::BIGINT AS token, count(*)::BIGINT AS docs FROM t WHERE length(term) BETWEEN 2 AND 40 AND term NOT IN (SELECT unnest($$STOP$$)) GROUP BY term""".replace("$$STOP$$", _STOP))
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 32-bit number for each token of the documents."""
    t = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("docs")).select("term", F.conv(F.substring(F.sha2(F.col("term").cast("binary"), 256), 1, 8), 16, 10).cast("long").alias("token"), "docs")


@query("""WITH q AS (SELECT doc_id, text, lower(split_part(text, ' ', 3)) AS name, strpos(lower(text), lower(split_part(text, ' ', 3))) AS place FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(substr(text, greatest(1, CASE WHEN name = '' OR place = 0 THEN 1 ELSE place - 100 END)::BIGINT, 400)) AS excerpt_md5 FROM q""")
def evidence_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """400 characters around the first place of a name: a quarter before it; from the start where it is not found."""
    name = F.lower(F.split_part("text", F.lit(" "), F.lit(3)))
    at = F.when(name == "", 0).otherwise(F.position(name, F.lower("text")))
    start = F.greatest(F.lit(1), F.when(at == 0, 1).otherwise(at - 100))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(F.substring("text", start, F.lit(400)).cast("binary")).alias("excerpt_md5"))


_ADDRESS = "^([a-z]+://[^/?#]*)([^?#]*)"


@query(f"""WITH RECURSIVE page AS (SELECT page_id, regexp_extract(url, '{_ADDRESS}', 1) AS site, regexp_extract(url, '{_ADDRESS}', 1) || regexp_extract(url, '{_ADDRESS}', 2) AS url, html FROM pages WHERE regexp_matches(url, '{_ADDRESS}')),
href AS (SELECT DISTINCT url AS page, site, site || regexp_extract(h, '^[^?#]*') AS topic FROM (SELECT url, site, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS h FROM page)),
link AS (SELECT page AS a, topic AS b FROM href UNION SELECT topic, page FROM href),
reach AS (SELECT arg_min(url, page_id) AS url, 0 AS depth FROM page GROUP BY site UNION SELECT b, depth + 1 FROM reach JOIN link ON a = reach.url WHERE depth < 3)
SELECT url, min(depth)::INT AS depth FROM reach GROUP BY url""")
def crawl_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that a crawl reaches from each site's first page within three links, and how deep.

    Pages link to the addresses in their hrefs, and such an address to the pages that name it.
    """
    part = lambda i: F.regexp_extract("url", _ADDRESS, i)
    page = table(spark, sf_dir, "pages").where(F.col("url").rlike(_ADDRESS)).select("page_id", part(1).alias("site"), F.concat(part(1), part(2)).alias("url"), "html")
    href = page.select("page_id", "site", "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("pos", "href"))
    href = settled(href.select("page_id", "site", "url", "pos", F.concat("site", F.regexp_extract("href", "^[^?#]*", 0)).alias("topic")))
    back = href.groupBy(F.col("topic").alias("src"), F.col("url").alias("dst")).agg(F.min("page_id").alias("pos"))
    links = href.select(F.col("url").alias("src"), F.col("topic").alias("dst"), "pos").union(back.select("src", "dst", "pos"))
    known = page.select("site", "url").union(href.select("site", F.col("topic").alias("url")))
    starts = page.groupBy("site").agg(F.min_by("url", "page_id").alias("url"))
    return crawl.crawled(starts, links, known, depth=3, limit=1_000_000).select("url", "depth")
