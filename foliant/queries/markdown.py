"""Tables in Markdown: parse, headers, chunks with repeated headers, sheets, sections. Price lists by brand are the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import tables as M
from foliant.functions.text import chunk_id
from foliant.plans.registry import query
from foliant.tables import table


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sheet, rows: a price list for each brand, size and block of 5,000 keys; some with a title row, some with a separator, cells with escaped pipes."""
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 7 == 0, F.replace("p_type", F.lit(" "), F.lit(" \\| "))).otherwise(F.col("p_type"))
    row = F.concat(F.lit("| "), "p_name", F.lit(" | "), kind, F.lit(" | "), F.col("p_size").cast("string"), F.lit(" | "), F.col("p_partkey").cast("string"), F.lit(" |"))
    body = p.groupBy(F.concat_ws("-", "p_brand", F.floor(F.col("p_partkey") / 5000).cast("string"), (F.col("p_size") % 5).cast("string")).alias("sheet")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))).alias("b"))
    none = F.array().cast("array<string>")
    number = F.right("sheet", F.lit(1)).cast("int")
    head = F.concat(F.when(number == 1, F.array(F.lit("| Price list | | | |"))).otherwise(none), F.when(number < 4, F.array(F.lit("| name | type | size | key |"))).otherwise(none), F.when(number == 2, F.array(F.lit("|---|:--|--:|---|"))).otherwise(none))
    return body.select("sheet", F.concat(head, F.transform("b", lambda x: x["r"])).alias("rows"))


def _book():
    """A workbook holds one type and block of 5,000 keys, so that it stays a document's size."""
    return F.concat_ws("-", "p_type", F.floor(F.col("p_partkey") / 5000).cast("string"))


_SHEETS = """sheets AS (SELECT sheet, list_concat(CASE WHEN n = 1 THEN ['| Price list | | | |'] ELSE [] END, CASE WHEN n < 4 THEN ['| name | type | size | key |'] ELSE [] END, CASE WHEN n = 2 THEN ['|---|:--|--:|---|'] ELSE [] END, b) AS rows
  FROM (SELECT p_brand || '-' || p_partkey // 5000 || '-' || (p_size % 5)::VARCHAR AS sheet, any_value(p_size % 5) AS n,
    list('| ' || p_name || ' | ' || CASE WHEN p_size % 7 = 0 THEN replace(p_type, ' ', ' \\| ') ELSE p_type END || ' | ' || p_size::VARCHAR || ' | ' || p_partkey::VARCHAR || ' |' ORDER BY p_partkey) AS b FROM part GROUP BY 1)),
line AS (SELECT sheet, i, r, list_transform(string_split(replace(r, '\\|', chr(1)), '|')[2:-2], lambda c: trim(c)) AS cells FROM (SELECT sheet, unnest(rows) AS r, generate_subscripts(rows, 1) AS i FROM sheets)),
scored AS (SELECT *, list_sum(list_transform(cells, lambda c: CASE WHEN c = '' THEN 0 WHEN regexp_matches(c, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN -1 ELSE 1 END))::INT AS score,
  len(list_filter(cells, lambda c: c <> '' AND NOT regexp_matches(c, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$'))) AS labels, len(list_filter(cells, lambda c: c <> '' AND NOT regexp_matches(c, '^:?-+:?$'))) = 0 AS sep FROM line),
best AS (SELECT sheet, arg_max(i, (score, -i)) FILTER (i <= 6) AS h, min(i) FILTER (i <= 6 AND sep) AS s, max(i) AS n FROM scored GROUP BY sheet),
judged AS (SELECT b.sheet, s, CASE WHEN (SELECT labels FROM scored x WHERE x.sheet = b.sheet AND x.i = h) >= 2
    AND (SELECT score FROM scored x WHERE x.sheet = b.sheet AND x.i = h) >= coalesce((SELECT median(score) FROM scored x WHERE x.sheet = b.sheet AND CASE WHEN n > 6 THEN i > 6 ELSE i > h END), -999) + 2 THEN h END AS h FROM best b),
parsed AS (SELECT sheet, CASE WHEN s IS NOT NULL THEN CASE WHEN s > 1 THEN rows[s - 1] ELSE '' END ELSE coalesce(rows[h], '') END AS header, coalesce(rows[s], '') AS separator,
  CASE WHEN s IS NOT NULL THEN list_concat(rows[1:s - 2], rows[s + 1:]) WHEN h IS NOT NULL THEN list_concat(rows[1:h - 1], rows[h + 1:]) ELSE rows END AS body FROM judged JOIN sheets USING (sheet)),
headed AS (SELECT *, '## ' || sheet || CASE WHEN header <> '' THEN chr(10) || header ELSE '' END || CASE WHEN header <> '' AND separator <> '' THEN chr(10) || separator ELSE '' END AS head FROM parsed),
packed AS (SELECT sheet, head, list_reduce(body, lambda s, x: CASE WHEN s.batch IS NULL THEN {'done': s.done, 'batch': x}
    WHEN length(s.batch) + 1 + length(x) <= greatest(2000 - length(head), 300) THEN {'done': s.done, 'batch': s.batch || chr(10) || x} ELSE {'done': list_append(s.done, s.batch), 'batch': x} END,
  {'done': []::VARCHAR[], 'batch': NULL::VARCHAR}) AS s FROM headed),
chunk AS (SELECT sheet, generate_subscripts(list_append(s.done, s.batch), 1) - 1 AS part, head || coalesce(chr(10) || unnest(list_append(s.done, s.batch)), '') AS chunk FROM packed)"""


@query(f"WITH {_SHEETS} SELECT sheet, header, separator, len(body)::INT AS n_rows, md5(array_to_string(body, chr(10))) AS rows_md5 FROM parsed")
def table_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header, separator and body of every table: a declared separator wins, else the header is inferred."""
    p = sheets(spark, sf_dir).select("sheet", M.parsed(F.col("rows")).alias("t"))
    return p.select("sheet", "t.header", "t.separator", F.size("t.rows").alias("n_rows"), F.md5(F.array_join("t.rows", "\n").cast("binary")).alias("rows_md5"))


@query(f"WITH {_SHEETS} SELECT sheet, part::INT AS part, length(chunk)::INT AS n_chars, md5(chunk) AS chunk_md5 FROM chunk")
def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every table: title and header repeated, whole rows packed to 2,000 characters."""
    p = sheets(spark, sf_dir).select("sheet", M.parsed(F.col("rows")).alias("t"))
    c = p.select("sheet", F.posexplode(M.chunks(F.concat(F.lit("## "), "sheet"), F.col("t"))).alias("part", "chunk"))
    return c.select("sheet", "part", F.length("chunk").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query(f"""WITH {_SHEETS}, named AS (SELECT sheet, list_transform(string_split(replace(header, '\\|', chr(1)), '|')[2:-2], lambda c: trim(c)) AS hs, unnest(body) AS r, generate_subscripts(body, 1) AS nth FROM parsed),
cell AS (SELECT sheet, nth, hs, list_transform(string_split(replace(r, '\\|', chr(1)), '|')[2:-2], lambda c: replace(trim(c), chr(1), '\\|')) AS cs FROM named)
SELECT sheet, nth::INT AS nth, array_to_string(list_transform(list_filter(range(1, len(cs) + 1), lambda i: cs[i] <> ''), lambda i: coalesce(nullif(hs[i], ''), 'column ' || i) || ': ' || cs[i]), '; ') AS line FROM cell""")
def row_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of every table as text: its cells with the names of their columns, from the declared or inferred header."""
    p = sheets(spark, sf_dir).select("sheet", M.parsed(F.col("rows")).alias("t")).select("sheet", M.cells(F.col("t.header")).alias("heads"), F.posexplode("t.rows").alias("at", "row"))
    name = lambda i: F.coalesce(F.nullif(F.get("heads", i), F.lit("")), F.concat(F.lit("column "), (i + 1).cast("string")))
    named = F.transform(M.cells(F.col("row")), lambda c, i: F.when(c != "", F.concat(name(i), F.lit(": "), c)))
    return p.select("sheet", (F.col("at") + 1).alias("nth"), F.array_join(F.array_compact(named), "; ").alias("line"))


@query("""WITH c AS (SELECT doc_id, lang AS page, unnest([substr(text, 1, 600), substr(text, 501, 600)]) AS chunk FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5('### Source: ' || doc_id::VARCHAR || CASE WHEN page <> 'en' THEN ' | Page: ' || page ELSE '' END || chr(10) || chr(10) || trim(chunk, ' ' || chr(9) || chr(10) || chr(13))) AS rendered_md5 FROM c""")
def chunk_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk as a block of its own: source and, where known, page in its heading."""
    page = F.nullif("lang", F.lit("en"))
    c = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", page.alias("page"), F.explode(F.array(F.substring("text", 1, 600), F.substring("text", 501, 600))).alias("chunk"))
    heading = F.concat(F.lit("### Source: "), F.col("doc_id").cast("string"), F.when(F.col("page").isNotNull(), F.concat(F.lit(" | Page: "), "page")).otherwise(""))
    body = F.regexp_replace("chunk", r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    return c.select("doc_id", F.md5(F.concat(heading, F.lit("\n\n"), body).cast("binary")).alias("rendered_md5"))


_MARKED = """marked AS (SELECT conv_id, string_agg(CASE WHEN turn % 4 = 2 THEN '<!-- page:' || turn || ' -->' || chr(10) ELSE '' END || coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"""


@query(f"""WITH {_MARKED}, p AS (SELECT conv_id, string_split_regex(text, '<!-- page:\\d+ -->') AS parts, regexp_extract_all(text, '<!-- page:(\\d+) -->', 1) AS numbers FROM marked),
s AS (SELECT conv_id, unnest(parts) AS body, generate_subscripts(parts, 1) AS i, numbers FROM p)
SELECT conv_id, CASE WHEN i = 1 THEN 'n/a' ELSE numbers[i - 1] END AS page, md5(trim(body, ' ' || chr(9) || chr(10) || chr(13))) AS body_md5 FROM s WHERE trim(body, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text split at its page markers, which carry the number; what stands before the first is page n/a, blank parts go."""
    mark = r"<!-- page:(\d+) -->"
    line = F.concat(F.when(F.col("turn") % 4 == 2, F.concat(F.lit("<!-- page:"), F.col("turn").cast("string"), F.lit(" -->\n"))).otherwise(""), F.coalesce("text", F.lit("")))
    texts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    parts = texts.select("conv_id", F.regexp_extract_all("text", F.lit(mark), F.lit(1)).alias("numbers"), F.posexplode(F.split("text", mark)).alias("i", "body"))
    body = F.regexp_replace("body", r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    page = F.when(F.col("i") == 0, "n/a").otherwise(F.get("numbers", F.col("i") - 1))
    return parts.select("conv_id", page.alias("page"), body.alias("body")).where("body <> ''").select("conv_id", "page", F.md5(F.col("body").cast("binary")).alias("body_md5"))




@query("""WITH rows AS (SELECT p_type || '-' || p_partkey // 5000 AS p_type, p_brand, p_partkey, '| ' || p_name || ' | ' || p_partkey || ' |' AS r FROM part)
SELECT p_type AS book, p_brand AS sheet, count(*)::BIGINT AS n_rows, md5(string_agg(r, chr(10) ORDER BY p_partkey)) AS rows_md5 FROM rows GROUP BY ALL""")
def sheet_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook's Markdown cut at its sheet headings: name and rows of each sheet that has any."""
    p = table(spark, sf_dir, "part")
    row = F.concat(F.lit("| "), "p_name", F.lit(" | "), F.col("p_partkey").cast("string"), F.lit(" |"))
    p = p.withColumn("p_type", _book())
    sheet = p.groupBy("p_type", "p_brand").agg(F.concat(F.lit("## "), "p_brand", F.lit("\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))), lambda x: x["r"]), "\n")).alias("part"))
    books = sheet.groupBy(F.col("p_type").alias("book")).agg(F.array_join(F.array_sort(F.collect_list("part")), "\n").alias("text"))
    # From here on it is text: headings open sheets, blank lines go.
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    cut = books.select("book", F.posexplode(F.split(F.array_join(lines, "\n"), r"(?m)^## ")).alias("i", "s")).where("s <> ''")
    rows = F.filter(F.split("s", "\n"), lambda x: x.startswith("|"))
    return cut.select("book", F.trim(F.substring_index("s", "\n", 1)).alias("sheet"), F.size(rows).cast("long").alias("n_rows"), F.md5(F.array_join(rows, "\n").cast("binary")).alias("rows_md5")).where("n_rows > 0")


@query("""WITH b AS (SELECT p_type || '-' || p_partkey // 5000 AS p_type, p_brand, sum(length('| ' || p_name || ' | ' || p_partkey || ' |') + 1) - 1 AS n FROM part GROUP BY ALL)
SELECT p_type AS book, count(*) FILTER (n >= 200)::BIGINT AS large, count(*) FILTER (n < 200)::BIGINT AS rejoined FROM b GROUP BY p_type""")
def table_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of table lines of each text: large ones stand alone, small ones rejoin the prose around them."""
    row = F.concat(F.lit("| "), "p_name", F.lit(" | "), F.col("p_partkey").cast("string"), F.lit(" |"))
    part = table(spark, sf_dir, "part").withColumn("p_type", _book()).groupBy("p_type", "p_brand").agg(F.concat(F.lit("About "), "p_brand", F.lit("\n"), F.array_join(F.collect_list(row), "\n")).alias("part"))
    texts = part.groupBy(F.col("p_type").alias("book")).agg(F.array_join(F.collect_list("part"), "\n").alias("text"))
    # From here on it is text.
    d = texts.select("book", F.transform(F.split("text", "\n"), lambda x: F.trim(x)).alias("l"))
    state = F.struct(F.lit(-1).alias("open"), F.array().cast("array<int>").alias("sizes"))

    def step(s, x):
        ended = F.when(s["open"] >= 0, F.array_append(s["sizes"], s["open"])).otherwise(s["sizes"])
        return F.when(x.startswith("|"), F.struct((s["open"] + 1 + F.length(x)).alias("open"), s["sizes"].alias("sizes"))).otherwise(F.struct(F.lit(-1).alias("open"), ended.alias("sizes")))

    sizes = F.aggregate(F.array_append("l", F.lit("")), state, step, lambda s: s["sizes"])
    n = d.select("book", sizes.alias("n")).where(F.size("n") > 0)
    return n.select("book", F.size(F.filter("n", lambda x: x >= 200)).cast("long").alias("large"), F.size(F.filter("n", lambda x: x < 200)).cast("long").alias("rejoined"))


@query(f"WITH {_SHEETS} SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS chunk_id, sheet, part::INT AS part FROM (SELECT *, md5(sheet || '_' || chunk) AS h FROM chunk)")
def table_chunk_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identities that table chunks are indexed under."""
    p = sheets(spark, sf_dir).select("sheet", M.parsed(F.col("rows")).alias("t"))
    c = p.select("sheet", F.posexplode(M.chunks(F.concat(F.lit("## "), "sheet"), F.col("t"))).alias("part", "chunk"))
    return c.select(chunk_id(F.col("sheet"), F.col("chunk")).alias("chunk_id"), "sheet", "part")


@query("""WITH b AS (SELECT p_type || '-' || p_partkey // 5000 AS book, p_brand, 'About ' || p_brand AS about, list('| ' || p_name || ' | ' || p_partkey || ' |' ORDER BY p_partkey) AS rows FROM part GROUP BY 1, 2),
t AS (SELECT *, array_to_string(rows, chr(10)) AS body, length(array_to_string(rows, chr(10))) >= 200 AS large FROM b),
s AS (SELECT *, coalesce(count(*) FILTER (large) OVER (PARTITION BY book ORDER BY p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM t),
prose AS (SELECT book, seg * 2 AS segment, string_agg(about || CASE WHEN large THEN '' ELSE chr(10) || body END, chr(10) ORDER BY p_brand) AS body FROM s GROUP BY ALL),
packed AS (SELECT book, seg * 2 + 1 AS segment, list_reduce(rows, lambda s, x: CASE WHEN s.batch IS NULL THEN {'done': s.done, 'batch': x} WHEN length(s.batch) + 1 + length(x) <= 2000 THEN {'done': s.done, 'batch': s.batch || chr(10) || x}
  ELSE {'done': list_append(s.done, s.batch), 'batch': x} END, {'done': []::VARCHAR[], 'batch': NULL::VARCHAR}) AS s FROM s WHERE large),
chunk AS (SELECT book, segment, unnest(range(0, greatest(length(body) - 101, 0) // 900 + 1)) AS part, body, NULL AS whole FROM prose UNION ALL SELECT book, segment, generate_subscripts(list_append(s.done, s.batch), 1) - 1, NULL, unnest(list_append(s.done, s.batch)) FROM packed)
SELECT book, row_number() OVER (PARTITION BY book ORDER BY segment, part)::INT AS position, md5(coalesce(whole, substr(body, part * 900 + 1, 1000))) AS chunk_md5 FROM chunk""")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents chunked: large tables by rows, everything else in windows; each document within its row."""
    row = F.concat(F.lit("| "), "p_name", F.lit(" | "), F.col("p_partkey").cast("string"), F.lit(" |"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))), lambda x: x["r"]), "\n")
    part = table(spark, sf_dir, "part").withColumn("p_type", _book()).groupBy("p_type", "p_brand").agg(F.concat(F.lit("About "), "p_brand", F.lit("\n"), rows).alias("part"))
    texts = part.groupBy(F.col("p_type").alias("book")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_brand", "part"))), lambda x: x["part"]), "\n").alias("text"))
    # From here on it is text.
    chunks = texts.select("book", F.posexplode(F.flatten(M.section_chunks(F.split("text", "\n"), least=200))).alias("n", "chunk"))
    return chunks.select("book", (F.col("n") + 1).alias("position"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))
