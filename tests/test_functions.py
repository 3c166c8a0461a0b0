"""Pinned values of the column functions."""

import datetime

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.queries.ledger import compound, day_fraction
from foliant.streaming import jobs


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_name_ratio_is_by_common_subsequence(spark):
    got = one(spark, F.round(T.ratio(F.col("a"), F.col("b")), 3), a="lucas", b="lucas du croo de jongh")
    assert got == 37.037
    assert one(spark, T.ratio(F.col("a"), F.col("b")), a="", b="x") == 0.0


def test_tokens_drop_stop_words_and_short_ones(spark):
    assert one(spark, T.tokens(F.col("a")), a="The Quick über x fuchs_1 und") == ["quick", "fuchs_1"]


def test_normalized_runs_become_one_blank(spark):
    assert one(spark, T.normalized(F.col("a")), a="a\r\nb\x00\x01​c\td") == "a\nb c\td"


def test_compounding_stays_on_the_clipped_day(spark):
    d = datetime.date
    got = one(spark, compound(F.col("p"), 0.1, F.col("s"), F.col("e")), p=100.0, s=d(2020, 2, 29), e=d(2024, 2, 28))
    assert abs(got - 146.41) < 1e-9


def test_thirty_day_months(spark):
    d = datetime.date
    assert one(spark, day_fraction(F.col("a"), F.col("b"), "30/360"), a=d(2020, 1, 31), b=d(2020, 3, 31)) == 60 / 360


def test_stream_equals_batch(spark, sf, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf}/events.parquet", tmp_path / "in")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    query = jobs.usage(stream).writeStream.format("memory").queryName("usage").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    batch = jobs.usage(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    assert spark.table("usage").count() == batch.count() > 0


def test_admission_keeps_the_budget(spark, sf, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf}/events.parquet", tmp_path / "in")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    query = jobs.admit(stream, budget=50.0).writeStream.format("memory").queryName("admitted").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    out = spark.table("admitted").toPandas()
    assert len(out) == spark.read.parquet(f"{sf}/events.parquet").count()
    assert (out[out.granted].used <= 50.0).all()


def test_chunks_of_texts_up_to_the_size_caps(spark):
    from foliant.queries.documents import chunks

    sizes = [0, 1, 1000, 1001, 36_000, 36_001, 128_657, 450_100, 450_101, 500_001]
    text = "".join(chr(97 + i * i % 26) for i in range(500_001))
    got = {}
    for r in chunks(spark.createDataFrame([(n, text[:n]) for n in sizes] + [(-1, None)], "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, {})[r.part] = r.chunk
    # 450,100 characters are 500 chunks.
    assert sorted(got) == sizes[:-2]
    for n, parts in got.items():
        assert [parts[k] for k in range(len(parts))] == [text[:n][at : at + 1000] for at in range(0, max(n - 100, 1), 900)]


def test_quotes_short_and_with_ellipses(spark):
    from foliant.queries.entities import found_quotes

    quotes = spark.createDataFrame([(1, "Short one"), (2, "the first ... the LAST"), (3, "the last… the missing"), (4, " ... "), (5, None), (6, "a quote of more than twenty-four letters")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "A short-one."), (2, "The first, some more, the last"), (3, "such is a quote of more than twenty four letters"), (4, None), (5, "")], "doc_id long, text string")
    assert sorted(map(tuple, found_quotes(quotes, docs).collect())) == [(1, 1), (2, 2), (6, 3)]
