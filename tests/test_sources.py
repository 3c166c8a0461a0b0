"""Sources and sinks on small folders."""

from pyspark.sql import functions as F

from foliant.operators import ranking
from foliant.sources import files, sinks


def test_listing_and_snapshot(spark, tmp_path):
    root = tmp_path / "room"
    (root / "sub").mkdir(parents=True)
    (root / "a.PDF").write_bytes(b"%PDF-1.7 x")
    (root / "sub" / "b.html").write_text("  <!DOCTYPE html><p>")
    (root / "c.json").write_text('{"a": 1}')
    (root / "d.txt").write_text("plain")
    assert {r.name for r in files.listing(spark, str(root)).collect()} == {"a.PDF", "sub/b.html", "c.json", "d.txt"}
    assert [r.name for r in files.listing(spark, str(root), ".pdf").collect()] == ["a.PDF"]
    one = files.snapshot(spark, str(root))
    assert {r.name: r.format for r in one.collect()} == {"a.PDF": "pdf", "sub/b.html": "html", "c.json": "json", "d.txt": "text"}
    held = spark.createDataFrame(one.collect(), one.schema)
    (root / "d.txt").write_text("other")
    (root / "c.json").unlink()
    (root / "e.txt").write_text("new")
    got = {r.name: r.action for r in files.changes(held, files.snapshot(spark, str(root))).collect()}
    assert got == {"a.PDF": "keep", "sub/b.html": "keep", "c.json": "remove", "d.txt": "update", "e.txt": "add"}


def test_missing_text_is_an_error(spark):
    import pytest

    sources = spark.createDataFrame([("a",), ("b",)], "name string")
    texts = spark.createDataFrame([("a", "x"), ("b", " ")], "name string, text string")
    assert files.parsed_documents(sources.where("name = 'a'"), texts).count() == 1
    with pytest.raises(Exception, match="no text of b"):
        files.parsed_documents(sources, texts).collect()


def test_upsert_delete_publish(spark, tmp_path):
    held = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    fresh = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    merged = sinks.upsert(held, fresh, ["id"])
    assert sorted(map(tuple, merged.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sinks.delete(merged, fresh, ["id"]).count() == 1
    path = str(tmp_path / "t")
    sinks.publish(held, path)
    sinks.publish(fresh, path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(2, "c"), (3, "d")]
    assert len(list(tmp_path.iterdir())) == 1


def test_markdown_escapes_pipes(spark):
    rows = spark.createDataFrame([("a|b", None), ("c\nd", 1)], "x string, y int")
    assert [r.line for r in sinks.markdown_rows(rows).collect()] == ["| a\\|b |  |", "| c d | 1 |"]


def test_json_lines_append(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, None), (2, "x")], "id int, v string")
    sinks.append_json_lines(rows, path)
    sinks.append_json_lines(rows, path)
    assert spark.read.json(path).count() == 4


def test_swiss_equals_sorting(spark):
    items = spark.range(3000).select(F.col("id").alias("item"), (F.xxhash64("id") % 500).alias("value"))
    got = [r.item for r in ranking.swiss_top_k(items, 5).orderBy("rank").collect()]
    assert got == [r.item for r in items.orderBy(F.desc("value"), "item").limit(5).collect()]


def test_names_below_nested_folders_and_texts(spark, tmp_path):
    root = tmp_path / "room"
    (root / "room").mkdir(parents=True)
    (root / "room" / "a.txt").write_bytes("﻿é".encode())
    (root / "b.txt").write_bytes("zürich".encode("utf-16"))
    (root / "d.pdf").write_bytes(b"%PDF-1.7")
    (root / "e.txt").write_bytes(b"a\x01b")
    assert {r.name for r in files.listing(spark, str(root)).collect()} == {"room/a.txt", "b.txt", "d.pdf", "e.txt"}
    got = {r.name: r.text for r in files.documents(spark, str(root)).collect()}
    assert (got["room/a.txt"], got["d.pdf"], got["e.txt"]) == ("é", None, None)
    one = spark.createDataFrame([(bytearray("zürich".encode("utf-16")), None), (bytearray("zürich".encode("latin-1")), "ISO-8859-1"), (bytearray(b"\xff\xfd"), None)], "c binary, s string")
    assert [r.t for r in one.select(files.decoded(F.col("c"), F.col("s")).alias("t")).collect()] == ["zürich", "zürich", None]


def test_profiles_without_an_object_are_left_out(spark, tmp_path):
    (tmp_path / "anna.json").write_text('{"name": "Anna"}')
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "list.json").write_text("[1]")
    assert [r.id for r in files.profiles(spark, str(tmp_path)).select("id").collect()] == ["anna"]


def test_numbers_in_order_and_components(spark):
    from foliant.operators.components import connected

    rows = spark.range(5000).select(F.col("id"), (F.xxhash64("id") % 40).cast("double").alias("v"))
    got = {r.id: r.position for r in ranking.numbered(rows, -F.col("v"), "id").collect()}
    want = sorted(((-r.v, r.id) for r in rows.collect()))
    assert got == {k: i + 1 for i, (_, k) in enumerate(want)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.component for r in connected(chain).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
