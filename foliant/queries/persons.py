"""People named in documents: a document's first two words, its first address, the host of the page of its number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import paths, people
from foliant.plans.registry import query
from foliant.tables import settled, table

_NAME = r"^[^\p{L}]*(\p{L}+)[^\p{L}]+(\p{L}+)"
_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, full_name, profile, emails of every document; what it lacks is empty."""
    part = lambda i: F.regexp_extract("text", _NAME, i)
    mail = F.lower(F.regexp_extract("text", _MAIL, 0))
    host = table(spark, sf_dir, "pages").where("page_id IS NOT NULL").groupBy("page_id").agg(F.min(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("profile"))
    own = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.trim(F.concat_ws(" ", part(1), part(2))).alias("full_name"),
        F.when(mail != "", F.array(mail)).otherwise(F.array().cast("array<string>")).alias("emails"),
    )
    return own.join(host, F.col("seq") == F.col("page_id"), "left").select("seq", "full_name", F.coalesce("profile", F.lit("")).alias("profile"), "emails")


_WORDS = "array_to_string(list_sort(list_filter(string_split({}, ' '), lambda w: w <> '')), ' ')"
_RECORDS = f"""host AS (SELECT page_id, min(regexp_extract(url, '://([^/?#]*)', 1)) AS profile FROM pages WHERE page_id IS NOT NULL GROUP BY page_id),
raw AS (SELECT doc_id AS seq, trim(regexp_extract(text, '{_NAME}', 1) || ' ' || regexp_extract(text, '{_NAME}', 2)) AS full_name, coalesce(profile, '') AS profile, lower(regexp_extract(text, '{_MAIL}')) AS email
  FROM documents LEFT JOIN host ON page_id = doc_id),
record AS (SELECT seq, coalesce(full_name, '') AS full_name, lower(coalesce(full_name, '')) AS lower, {_WORDS.format("lower(coalesce(full_name, ''))")} AS words,
  {_WORDS.format("trim(regexp_replace(lower(regexp_replace(strip_accents(coalesce(full_name, '')), '[^\x00-\x7f]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))")} AS slug,
  profile, coalesce(email, '') AS email, {_WORDS.format(r"regexp_replace(string_split(coalesce(email, ''), '@')[1], '[._+\-]+', ' ', 'g')")} AS local FROM raw)"""


def _alike(a: str, b: str, least: int) -> str:
    """Similarity in SQL; 0 where the lengths alone put it below least, or a side is empty."""
    return f"""CASE WHEN {a} = '' OR {b} = '' OR 200 * least(length({a}), length({b})) < {least} * (length({a}) + length({b})) THEN 0 ELSE round(200.0::DOUBLE * list_reduce(string_split({a}, ''), lambda line, c: list_reduce(range(1, length({b}) + 1), lambda made, j: list_append(made,
      CASE WHEN {b}[j] = c THEN line[j] + 1 ELSE greatest(line[j + 1], made[-1]) END), [0::BIGINT]), list_resize([]::BIGINT[], length({b}) + 1, 0))[-1] / (length({a}) + length({b})), 6) END"""


#: Every name against every other.
_LINKS = f"""{_RECORDS}, name AS (SELECT DISTINCT lower, words, slug FROM record WHERE lower <> ''),
link AS (SELECT x.lower AS a, y.lower AS b, CASE WHEN contains(x.lower, y.lower) OR contains(y.lower, x.lower) THEN 100 ELSE {_alike("x.words", "y.words", 85)} END AS score FROM name x JOIN name y ON x.lower < y.lower)"""


@query(f"WITH {_LINKS} SELECT a, b, score::DOUBLE AS score FROM link WHERE score >= 85")
def person_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of distinct names that may be one person's, with their score."""
    return people.name_links(records(spark, sf_dir))


@query(f"""WITH {_LINKS}, near AS (SELECT a, b, score FROM link WHERE score >= 85 UNION ALL SELECT b, a, score FROM link WHERE score >= 85 UNION ALL SELECT lower, lower, 100 FROM name),
mail AS (SELECT s.slug, l.local, {_alike("s.slug", "l.local", 90)} AS score FROM (SELECT DISTINCT slug FROM name) s, (SELECT DISTINCT local FROM record WHERE local <> '') l),
pair AS (SELECT x.seq AS one, y.seq AS other, CASE WHEN x.profile <> '' AND y.profile <> '' THEN CASE WHEN x.profile = y.profile THEN 100 ELSE 0 END
    WHEN x.email <> '' AND x.email = y.email THEN 100
    WHEN x.lower <> '' AND y.lower <> '' AND len(list_intersect(string_split(x.words, ''), string_split(y.words, ''))) > 0 THEN coalesce(n.score, 0)
    ELSE greatest(coalesce(CASE WHEN m.score >= 90 THEN m.score END, 0), coalesce(CASE WHEN o.score >= 90 THEN o.score END, 0)) END AS score
  FROM record x JOIN record y ON x.seq <> y.seq LEFT JOIN near n ON n.a = x.lower AND n.b = y.lower LEFT JOIN mail m ON m.slug = x.slug AND m.local = y.local LEFT JOIN mail o ON o.slug = y.slug AND o.local = x.local),
chosen AS (SELECT *, max(CASE WHEN same THEN 1 ELSE 0 END) OVER (PARTITION BY one) AS exact FROM (SELECT p.*, x.profile <> '' AND x.profile = y.profile AS same FROM pair p JOIN record x ON x.seq = p.one JOIN record y ON y.seq = p.other WHERE p.score >= 85))
SELECT one, other, score::DOUBLE AS score FROM chosen WHERE exact = 0 OR same QUALIFY row_number() OVER (PARTITION BY one ORDER BY score DESC, other) = 1""")
def person_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best match of every record, ties to the earlier record."""
    return people.best_matches(records(spark, sf_dir))


@query()
def person_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records merged into people in their order (sequential, so without SQL)."""
    return people.merged(records(spark, sf_dir))


@query()
def person_merge_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records merged into people, those with profiles first."""
    return people.merged(records(spark, sf_dir), grouped=True)


@query()
def person_merge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What both ways of merging leave and lose."""
    own = settled(records(spark, sf_dir))
    both = [people.merge_metrics(own, settled(people.merged(own, grouped))).withColumn("policy", F.lit("grouped" if grouped else "ordered")) for grouped in (False, True)]
    return both[0].union(both[1])


_PATH = "trim(lower(regexp_replace(url, '^[a-z]+://', '')), '/')"
_ALIASES = "list_filter(list_distinct([p, string_split(p, '/')[-1], regexp_replace(p, '\\.md$', ''), string_split(regexp_replace(p, '\\.md$', ''), '/')[-1]]), lambda x: x <> '')"


@query(f"""WITH page AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path, {_PATH} AS p FROM pages WHERE url IS NOT NULL), named AS (SELECT page_id, path, p, unnest({_ALIASES}) AS a FROM page),
alias AS (SELECT x.a, y.a AS b, {_alike("x.a", "y.a", 70)} AS score FROM (SELECT DISTINCT a FROM named WHERE page_id % 2 = 1) x, (SELECT DISTINCT a FROM named WHERE page_id % 2 = 0) y),
met AS (SELECT x.page_id AS id, x.p, y.path, y.p AS q, max(s.score) AS score FROM named x JOIN (SELECT * FROM alias WHERE score >= 70) s ON s.a = x.a JOIN (SELECT DISTINCT path, p, a FROM named WHERE page_id % 2 = 0) y ON y.a = s.b WHERE x.page_id % 2 = 1 GROUP BY ALL),
tied AS (SELECT *, {_alike("p", "q", 0)} AS whole FROM met QUALIFY score = max(score) OVER (PARTITION BY id))
SELECT page_id AS id, path, score::DOUBLE AS score FROM (SELECT page_id FROM page WHERE page_id % 2 = 1) LEFT JOIN (SELECT id, path, score FROM tied QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, whole DESC, path DESC) = 1) ON id = page_id""")
def path_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each page with an odd number the address among the others that is closest to its own."""
    page = table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return paths.resolved(page.where("page_id % 2 = 1").select(F.col("page_id").alias("id"), F.col("path").alias("proposed")), page.where("page_id % 2 = 0").select("path"))
