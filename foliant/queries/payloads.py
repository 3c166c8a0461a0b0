"""Nested payloads: a customer with orders and lines as JSON of several levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import nested
from foliant.plans.registry import query
from foliant.tables import table

#: Keys of pictures and references that are never kept (fixed values).
DROPPED = r"image|urn|^multilocale"


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and json of every customer, with orders, links, references and empty values."""
    held = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))).alias("orders"))

    def order(o: Column) -> Column:
        url = F.concat(F.lit("https://files/"), o["o_orderkey"].cast("string"))
        note = F.struct(F.concat(F.lit("see  ["), o["o_orderpriority"], F.lit("]("), url, F.lit(")")).alias("text"), F.lit("").alias("alt"))
        return F.struct(o["o_orderkey"].alias("id"), o["o_orderstatus"].alias("status"), F.struct(url.alias("url"), F.lit(1).alias("size")).alias("coverImage"), F.array(note).alias("notes"))

    empty = F.struct(F.lit(None).cast("string").alias("nothing"), F.struct(F.lit("urn:x:1").alias("ref")).alias("inner"))
    c = table(spark, sf_dir, "customer").join(held, F.col("o_custkey") == F.col("c_custkey"), "left").withColumn("orders", F.transform("orders", order))
    whole = F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.concat(F.lit("urn:c:"), F.col("c_custkey").cast("string")).alias("entityUrn"), empty.alias("extra"), "orders", F.concat(F.lit("www.x.com/"), F.col("c_custkey").cast("string")).alias("site"))
    return c.select(F.col("c_custkey").alias("id"), F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


def without_links(text: Column) -> Column:
    """A string without links: their label stays; references are empty."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?i)\[([^\]]+)]\(https?://[^)]+\)", "$1"), r"(?i)(?:https?://|www\.)[^\s<>\"']+", "")
    return F.when(F.lower(F.trim(text)).startswith("urn:"), "").otherwise(F.trim(F.regexp_replace(plain, r"\s+", " ")))


_ORDERS = "held AS (SELECT o_custkey, list({'id': o_orderkey, 'p': o_orderpriority, 's': o_orderstatus} ORDER BY o_orderkey, o_orderstatus, o_orderpriority) AS os FROM orders GROUP BY o_custkey)"


@query(f"""WITH {_ORDERS} SELECT c_custkey AS id, concat('{{"name":"', c_name, '","nation":', c_nationkey, CASE WHEN os IS NULL THEN '' ELSE concat(',"orders":[', array_to_string(list_transform(os, lambda o: concat('{{"id":', o.id, ',"notes":[{{"text":"see ', o.p, '"}}],"status":"', o.s, '"}}')), ','), ']') END, '}}') AS cleaned
FROM customer LEFT JOIN held ON o_custkey = c_custkey""")
def payload_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads without pictures, references, links and what they leave empty, at any depth, in one spelling."""
    return nested.cleaned(payloads(spark, sf_dir), DROPPED, without_links).select("id", F.col("json").alias("cleaned"))


@query(f"""WITH {_ORDERS}, o AS (SELECT o_custkey AS id, unnest(os) AS o, generate_subscripts(os, 1) - 1 AS i FROM held)
SELECT c_custkey AS id, '$.nation' AS path, 'too small' AS problem FROM customer WHERE c_nationkey < 5 UNION ALL SELECT c_custkey, '$.orders', 'is no array' FROM customer LEFT JOIN held ON o_custkey = c_custkey WHERE os IS NULL
UNION ALL SELECT id, concat('$.orders[', i, '].status'), 'not allowed' FROM o JOIN customer ON c_custkey = id WHERE o.s = 'P' UNION ALL SELECT id, concat('$.orders[', i, '].total'), 'is missing' FROM o JOIN customer ON c_custkey = id
UNION ALL SELECT id, concat('$.orders[', i, '].notes[0].text'), 'is no number' FROM o JOIN customer ON c_custkey = id""")
def schema_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What payloads have that a schema does not allow, each with its path."""
    schema = [
        ("$.name", "string", True, None, None, None), ("$.nation", "number", True, 5, None, None), ("$.orders", "array", True, None, None, None), ("$.orders[*].status", "string", True, None, None, ["F", "O"]),
        ("$.orders[*].total", "number", True, 0, None, None), ("$.orders[*].notes[*].text", "number", False, None, None, None),
    ]
    return nested.problems(nested.nodes(payloads(spark, sf_dir), patterns=nested.patterns(schema)), schema)


@query(f"""WITH {_ORDERS} SELECT c_custkey AS id, sha256(concat('{{"extra":{{"inner":{{"ref":"urn:x:1"}},"nothing":null}},"name":"', c_name, '","nation":', c_nationkey, ',"orders":', CASE WHEN os IS NULL THEN 'null' ELSE concat('[', array_to_string(list_transform(os, lambda o: concat('{{"id":', o.id, ',"notes":[{{"alt":"","text":"see  [', o.p, '](https://files/', o.id, ')"}}],"status":"', o.s, '"}}')), ','), ']') END, ',"site":"www.x.com/', c_custkey, '"}}')) AS key
FROM customer LEFT JOIN held ON o_custkey = c_custkey""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of each payload in one spelling, pictures and references left out."""
    return nested.cache_keys(payloads(spark, sf_dir), "image$|^entityurn$")


@query(f"""WITH {_ORDERS}, o AS (SELECT o_custkey AS id, unnest(os) AS r, generate_subscripts(os, 1) - 1 AS i FROM held)
SELECT id, concat('$.orders[', i, '].coverImage.url') AS path, concat('"file:', r.id, '"') AS text FROM o JOIN customer ON c_custkey = id UNION ALL SELECT id, concat('$.orders[', i, '].notes[0].text'), concat('"see  [', r.p, '](file:', r.id, ')"') FROM o JOIN customer ON c_custkey = id""")
def attachment_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strings of payloads that hold an attachment's address, with what stands for it."""
    found = nested.nodes(payloads(spark, sf_dir), kinds=("string",))
    fresh = nested.strings(found, lambda s: F.replace(s, F.lit("https://files/"), F.lit("file:")))
    return fresh.where("contains(text, 'file:')").select("id", "path", "text")
