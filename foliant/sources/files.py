"""Folders of documents as tables: listings, snapshots, formats, change sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Leading bytes of formats (fixed values), as upper-case hexadecimal.
MAGIC = (("pdf", "25504446"), ("zip", "504B0304"), ("png", "89504E47"), ("jpeg", "FFD8FF"), ("gif", "47494638"), ("gzip", "1F8B"), ("ole", "D0CF11E0"), ("rtf", "7B5C727466"))


def listing(spark: SparkSession, root: str, suffix: str | None = None) -> DataFrame:
    """name (relative), modified, length of all files with content below a folder; the contents are not read.

    suffix is compared without regard to case.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    out = found.select(_relative(root).alias("name"), F.col("modificationTime").alias("modified"), "length")
    return out.where(F.lower("name").endswith(suffix.lower())) if suffix else out


def _relative(root: str) -> Column:
    """The path behind the first place of the root, whatever scheme stands before it."""
    top = root.rstrip("/")
    return F.substring("path", F.position(F.lit(top), "path") + len(top) + 1, F.length("path"))


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """name, modified, sha256, format of every file: contents are hashed where they are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select(_relative(root).alias("name"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), sniffed(F.col("content")).alias("format"))


def sniffed(content: Column) -> Column:
    """Format by content: leading bytes, then HTML, JSON or other text; null for unknown bytes."""
    head = F.hex(F.substring(content, 1, 8))
    text = F.lower(F.ltrim(F.substring(content, 1, 256).cast("string")))
    kind = None
    for name, magic in MAGIC:
        kind = F.when(head.startswith(magic), name) if kind is None else kind.when(head.startswith(magic), name)
    return kind.when(text.startswith("<!doctype html") | text.startswith("<html"), "html").when(text.startswith("{") | text.startswith("["), "json").when(~F.contains(head, F.lit("00")), "text")


def decoded(content: Column, charset: Column | None = None) -> Column:
    """The text of bytes: by byte order mark, else UTF-8, else the declared charset; null if it holds control characters or none reads it."""
    head = F.hex(F.substring(content, 1, 3))
    rest = lambda n: F.substring(content, n + 1, F.length(content))
    utf8 = F.try_validate_utf8(content.cast("string"))
    declared = F.lit(None).cast("string")
    if charset is not None:
        for name in ("ISO-8859-1", "US-ASCII", "UTF-16LE", "UTF-16BE"):
            declared = F.when(F.upper(charset) == name, F.decode(content, name)).otherwise(declared)
    text = F.when(head.startswith("EFBBBF"), F.try_validate_utf8(rest(3).cast("string"))).when(head.startswith("FFFE"), F.decode(rest(2), "UTF-16LE")).when(head.startswith("FEFF"), F.decode(rest(2), "UTF-16BE")).otherwise(F.coalesce(utf8, declared))
    return F.when(~text.rlike(r"[\x00-\x08\x0E-\x1F]"), text)


def documents(spark: SparkSession, root: str) -> DataFrame:
    """name, format, text of a folder's files: texts, HTML, JSON and RTF as they are; text is null for what needs a converter. Files without bytes are passed over."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kind = sniffed(F.col("content"))
    text = F.when(kind.isin("text", "html", "json", "rtf"), decoded(F.col("content")))
    return found.select(_relative(root).alias("name"), kind.alias("format"), text.alias("text"))


def profiles(spark: SparkSession, root: str) -> DataFrame:
    """id, payload (variant) of a folder with one JSON object a file, named by id; files that hold none are left out."""
    found = spark.read.format("text").option("wholetext", "true").load(root).select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("payload"))
    return found.where(F.col("file").endswith(".json") & F.schema_of_variant("payload").startswith("OBJECT")).select(F.regexp_replace("file", r"\.json$", "").alias("id"), "payload")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, action: add, update, remove or keep, by sha256 of two snapshots."""
    joined = old.select("name", F.col("sha256").alias("before")).join(new.select("name", F.col("sha256").alias("after")), "name", "full")
    action = F.when(F.col("before").isNull(), "add").when(F.col("after").isNull(), "remove").when(F.col("before") != F.col("after"), "update").otherwise("keep")
    return joined.select("name", action.alias("action"))


def parsed_documents(sources: DataFrame, texts: DataFrame) -> DataFrame:
    """name, text of all sources; fails at a source without text that is not blank."""
    joined = sources.select("name").join(texts.select("name", "text"), "name", "left")
    missing = F.trim(F.coalesce("text", F.lit(""))) == ""
    return joined.select("name", F.when(missing, F.raise_error(F.concat(F.lit("no text of "), "name"))).otherwise(F.col("text")).alias("text"))


def newest(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Of each key the row with the greatest by; ties to any one."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), by).alias("r")).select(key, "r.*")


def running_budget(rows: DataFrame, key: str, order: str, size: Column, budget: int) -> DataFrame:
    """The rows of each key that fit a budget, in order, up to the first that does not."""
    total = F.sum(size).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("total", total).where(F.col("total") <= budget)
