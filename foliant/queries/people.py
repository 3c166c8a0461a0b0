"""People and files: identities, scores, merges, cascades, name phrases, predicates on file names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import common_with_each, quote_key
from foliant.plans.registry import query
from foliant.tables import table


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, full_name, profile, email: records of people; names in full, with an initial or turned round, some without profile, mail or name."""
    p = table(spark, sf_dir, "part")
    first, last, brand = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1), F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "")
    name = F.when(F.col("p_size") % 4 == 1, F.concat(F.substring(first, 1, 1), F.lit(". "), last)).when(F.col("p_size") % 4 == 2, F.concat_ws(" ", last, first)).when(F.col("p_size") % 4 == 3, F.concat_ws(" ", first, brand, last)).otherwise(F.col("p_name"))
    return p.select(
        F.col("p_partkey").alias("seq"), F.when(F.col("p_size") % 11 == 0, "").otherwise(name).alias("full_name"),
        F.when(F.col("p_size") % 3 == 0, F.concat_ws("-", first, last, brand)).otherwise("").alias("profile"),
        F.when(F.col("p_size") % 5 < 2, F.concat(first, F.lit("."), last, F.lit("@"), brand, F.lit(".com"))).otherwise("").alias("email"),
    )


_PEOPLE = """people AS (SELECT p_partkey AS seq,
  CASE WHEN p_size % 11 = 0 THEN '' WHEN p_size % 4 = 1 THEN substr(f, 1, 1) || '. ' || l WHEN p_size % 4 = 2 THEN l || ' ' || f WHEN p_size % 4 = 3 THEN f || ' ' || b || ' ' || l ELSE p_name END AS full_name,
  CASE WHEN p_size % 3 = 0 THEN f || '-' || l || '-' || b ELSE '' END AS profile, CASE WHEN p_size % 5 < 2 THEN f || '.' || l || '@' || b || '.com' ELSE '' END AS email
  FROM (SELECT *, string_split(p_name, ' ')[1] AS f, string_split(p_name, ' ')[-1] AS l, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS b FROM part))"""


@query(f"""WITH {_PEOPLE}, r AS (SELECT * FROM people WHERE seq % 2 = 0), m AS (SELECT * FROM people WHERE seq % 2 = 1),
hits AS (SELECT r.seq, 1 AS level, count(*) AS n, min(m.seq) AS found FROM r JOIN m ON r.email <> '' AND r.email = m.email GROUP BY r.seq
  UNION ALL SELECT r.seq, 2, count(*), min(m.seq) FROM r JOIN m ON r.profile <> '' AND r.profile = m.profile GROUP BY r.seq
  UNION ALL SELECT r.seq, 3, count(*), min(m.seq) FROM r JOIN m ON r.full_name <> '' AND lower(r.full_name) = lower(m.full_name) GROUP BY r.seq)
SELECT seq, level, n::BIGINT AS n, found FROM hits QUALIFY row_number() OVER (PARTITION BY seq ORDER BY level) = 1""")
def member_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References against members by address, then profile, then name; the first level with a hit decides.

    Members are counted by key before they meet a reference.
    """
    p = people(spark, sf_dir)
    refs, members = p.where("seq % 2 = 0"), p.where("seq % 2 = 1")
    out = None
    for level, key in ((1, F.col("email")), (2, F.col("profile")), (3, F.lower("full_name"))):
        held = members.where(key != "").groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("seq").alias("found"))
        hit = refs.where(key != "").select("seq", key.alias("key")).join(held, "key").select("seq", F.lit(level).alias("level"), "n", "found")
        out = hit if out is None else out.union(hit)
    best = out.groupBy("seq").agg(F.min(F.struct("level", "n", "found")).alias("m"))
    return best.select("seq", "m.level", "m.n", "m.found")


@query(f"""WITH {_PEOPLE}, n AS (SELECT DISTINCT lower(full_name) AS name FROM people WHERE full_name <> ''), t AS (SELECT name, list_filter(regexp_split_to_array(name, '[^a-z0-9]+'), lambda w: w <> '') AS w FROM n),
v AS (SELECT DISTINCT name, unnest(list_concat([array_to_string(w, ' ')], flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(w[i + 1:], lambda x: w[i] || ' ' || x))))) AS phrase, array_to_string(w, ' ') AS whole FROM t)
SELECT phrase, min(name) AS name FROM v GROUP BY phrase HAVING count(DISTINCT name) = 1 AND (bool_or(phrase = whole) OR (contains(phrase, ' ') AND length(regexp_replace(phrase, '[^a-z]', '', 'g')) >= 8))""")
def unique_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in full, and ordered pairs of their words of eight letters or more, that belong to one name only."""
    n = people(spark, sf_dir).where("full_name <> ''").select(F.lower("full_name").alias("name")).distinct()
    t = n.select("name", F.filter(F.split("name", "[^a-z0-9]+"), lambda w: w != "").alias("w"))
    pairs = F.flatten(F.transform("w", lambda x, i: F.transform(F.filter("w", lambda _, j: j > i), lambda y: F.concat_ws(" ", x, y))))
    v = t.select("name", F.array_join("w", " ").alias("whole"), F.explode(F.array_union(F.array(F.array_join("w", " ")), pairs)).alias("phrase"))
    g = v.groupBy("phrase").agg(F.countDistinct("name").alias("n"), F.min("name").alias("name"), F.bool_or(F.col("phrase") == F.col("whole")).alias("full"))
    return g.where((F.col("n") == 1) & (F.col("full") | (F.contains("phrase", F.lit(" ")) & (F.length(F.regexp_replace("phrase", "[^a-z]", "")) >= 8)))).select("phrase", "name")


#: Words of personal records in the names of files (fixed values).
PERSONAL = (
    r"\bcvs?\b", r"\bcurriculum vitae\b", r"\bresumes?\b", r"\bpassports?\b", r"\b(?:id|identity) cards?\b", r"\bcriminal records?\b",
    r"\bemployment records?\b", r"\breference letters?\b", r"\brecommendation letters?\b",
)


@query("""WITH f AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'linkedin/' WHEN 1 THEN 'Team\\' ELSE 'files/' END || replace(p_name, ' ', '_') || '-' || ['CV', 'passports scan', 'Pitch', 'Identity Card', 'resume notes', 'cvx'][p_size % 6 + 1] || '.pdf' AS file, p_name FROM part),
s AS (SELECT *, string_split(trim(regexp_replace(lower(string_split(replace(file, '\\', '/'), '/')[-1]), '[^a-z0-9]+', ' ', 'g')), ' ') AS t, string_split(p_name, ' ') AS n FROM f)
SELECT p_partkey, starts_with(replace(file, '\\', '/'), 'linkedin/') AS from_profile, regexp_matches(array_to_string(t, ' '), '""" + "|".join(PERSONAL) + """') AS personal,
  contains(' ' || array_to_string(t, ' ') || ' ', ' ' || p_name || ' ') OR (list_contains(t, n[-1]) AND (list_contains(t, n[1]) OR list_contains(t, substr(n[1], 1, 1)))) AS names_person FROM s""")
def file_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of file names: from the profile folder, a personal record, naming the person (surname with first name or initial)."""
    folder = F.when(F.col("p_size") % 5 == 0, "linkedin/").when(F.col("p_size") % 5 == 1, "Team\\").otherwise("files/")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("CV", "passports scan", "Pitch", "Identity Card", "resume notes", "cvx")]), (F.col("p_size") % 6 + 1).cast("int"))
    f = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.replace(F.concat(folder, F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-"), kind, F.lit(".pdf")), F.lit("\\"), F.lit("/")).alias("file"))
    t = f.withColumn("t", F.trim(F.regexp_replace(F.lower(F.substring_index("file", "/", -1)), "[^a-z0-9]+", " "))).withColumn("w", F.split("t", " "))
    first, last = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    named = F.contains(F.concat(F.lit(" "), "t", F.lit(" ")), F.concat(F.lit(" "), "p_name", F.lit(" "))) | (F.array_contains("w", last) & (F.array_contains("w", first) | F.array_contains("w", F.substring(first, 1, 1))))
    return t.select("p_partkey", F.col("file").startswith("linkedin/").alias("from_profile"), F.col("t").rlike("|".join(PERSONAL)).alias("personal"), named.alias("names_person"))


@query("""SELECT p_partkey, lower('Notes/' || p_name || '.md') AS path, list_sort(list_distinct([lower('Notes/' || p_name || '.md'), lower(p_name || '.md'), lower('Notes/' || p_name), lower(p_name)])) AS aliases FROM part""".replace("list_sort(list_distinct(", "array_to_string(list_sort(list_distinct(").replace(")])) AS aliases", ")])), ';') AS aliases"))
def path_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a path may be called: itself and its base name, with and without .md."""
    path = F.lower(F.concat(F.lit("Notes/"), "p_name", F.lit(".md")))
    base, bare = F.substring_index(path, "/", -1), F.regexp_replace(path, r"\.md$", "")
    aliases = F.array_join(F.array_sort(F.array_distinct(F.array(path, base, bare, F.substring_index(bare, "/", -1)))), ";")
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), aliases.alias("aliases"))


def closest_lines(fragments: DataFrame, cutoff: int = 60) -> DataFrame:
    """id, line, score for id, fragment, lines (array): the line most like the fragment, the first of equals, from a score on.

    Letters and digits are compared, in whole lines. Score: twice their longest common subsequence
    over both lengths, 0 to 100. A row's lines are compared at once; one whose length alone misses
    the cutoff is not. Rows of the same id have one best line.
    """

    @F.pandas_udf("at int, common long, total long")
    def closest(keys: pd.Series, owns: pd.Series) -> pd.DataFrame:
        found = []
        for key, own in zip(keys, owns):
            near = [i for i, y in enumerate(own) if y and 200 * min(len(key), len(y)) >= cutoff * (len(key) + len(y))] if key and own is not None else []
            if near:
                common, total = common_with_each(key, [own[i] for i in near]), np.array([len(key) + len(own[i]) for i in near])
                first = np.argmax(200.0 * common / total)
                near = [(near[first], common[first], total[first])] if 200 * common[first] >= cutoff * total[first] else []
            found.append(near[0] if near else (None, None, None))
        return pd.DataFrame(found, columns=["at", "common", "total"]).astype({"at": "Int32", "common": "Int64", "total": "Int64"})

    each = fragments.select("id", "lines", closest.asNondeterministic()(quote_key(F.col("fragment")), F.transform("lines", quote_key)).alias("c")).where("c.at IS NOT NULL")
    best = each.groupBy("id").agg(F.min(F.struct((-200.0 * F.col("c.common") / F.col("c.total")).alias("s"), F.col("c.at").alias("at"), F.trim(F.get("lines", F.col("c.at"))).alias("line"))).alias("m"))
    return best.select("id", "m.line", F.round(-F.col("m.s"), 6).alias("score"))


@query()
def closest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the line that is most like its last one."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.split(F.trim("text"), "\n").alias("lines"))
    return closest_lines(d.select("id", F.element_at("lines", -1).alias("fragment"), F.slice("lines", F.lit(1), F.size("lines") - 1).alias("lines")))
