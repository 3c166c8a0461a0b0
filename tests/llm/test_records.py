"""Operators on pages, vectors, audio and labels; the pipeline."""

import hashlib
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import chroma, hosts, neighbours, quality, warc
from foliant.llm.common import shared_dir


def test_rules_and_reputation(spark):
    urls = ["http://A.net/x", "https://www.example.net/en/1?q", "http://example.com/de/", "http://x.example.com/de", "no scheme", None, "http://x.org/fr/1#f", "http://bad.org/1", "http://bad.org/2", "http://"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([(7, 1), (8, 1)] + [(99, 0)], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in hosts.judge(pages, labels).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block")
    assert got[1][2:] == ("example.net/en/", "allow")
    assert got[2][2:] == ("example.com/de/", "block")
    assert got[3][2] is None
    assert got[4][:3] == ("", "", None) and got[5][:3] == ("", "", None)
    assert got[6] == ("x.org", "/fr/1", "org/fr/", "allow")
    assert len(got) == len(urls)
    none = hosts.judge(pages, labels.limit(0)).collect()
    assert {r.verdict for r in none if r.rule is None} == {"allow"}


def test_reputation_shrinks_level_by_level(spark):
    # bad.com is labelled well and mostly bad, poor.com once; new.bad.com not at all; fine.com mostly good.
    pages = [(f"http://a.bad.com/{i}", int(i % 10 > 0)) for i in range(60)] + [(f"http://b.bad.com/{i}", int(i % 9 > 0)) for i in range(60)]
    pages += [(f"http://fine.com/{i}", int(i % 10 == 0)) for i in range(200)] + [(f"http://w{i % 40}.plain{i % 40}.com/{i}", int(i % 3 == 0)) for i in range(1200)]
    pages += [("http://poor.com/1", 1), ("http://new.bad.com/1", None), ("http://new.fine.com/1", None), ("http://fresh.dev/1", None)]
    table = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(pages)], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(pages) if b is not None], "page_id long, bad int")
    rates = {r.host: r for r in hosts.reputation(table, labels).collect()}
    verdict = {r.host: r.verdict for r in hosts.judge(table, labels).collect()}
    assert verdict["a.bad.com"] == verdict["b.bad.com"] == "block" and verdict["fine.com"] == "allow"
    assert verdict["poor.com"] == "allow" and rates["poor.com"].overall < rates["poor.com"].rate < 0.6  # one bad page is little
    assert verdict["new.bad.com"] == "block" and rates["new.bad.com"].rate > 0.7  # by its domain
    assert verdict["new.fine.com"] == "allow" and rates["new.fine.com"].rate < rates["new.fine.com"].overall
    assert abs(rates["fresh.dev"].rate - rates["fresh.dev"].overall) < 1e-9 and verdict["fresh.dev"] == "allow"
    assert abs(rates["a.bad.com"].rate - 54 / 60) < 0.05  # what is known of a host outweighs its prior


def test_archives_round_trip(spark):
    import io

    import zstandard

    long = "<p>" + "x" * 200
    rows = [(1, "http://a/\r\nb", long), (2, None, long), (3, "u", None), (4, "u", "short"), (5, "u", "short"), (6, "u", "é" * 60)] + [(10 + i, f"u{i}", long + str(i)) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(pages, path)
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == len(rows)
    for k, _, html in rows:
        data = (html or "").encode()
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        if got[k].record_type == "response":
            assert bytes(got[k].payload) == data
    assert (got[2].record_type, got[2].refers_to, got[5].record_type) == ("revisit", 1, "response")
    # Repeated rows and null ids are records like others; archives end at a size.
    odd = spark.createDataFrame([(1, "u", long), (1, "u", long), (2, "u", long), (2, "u", long), (None, "u", long), (None, "v", None), (3, "w", long + "!")] + [(50 + i, "z", long * 9 + str(i)) for i in range(40)], "page_id long, url string, html string")
    small = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(odd.coalesce(1), small, size=500)
    back = warc.read_archives(spark, small, payload=False).toPandas()
    assert len(back) == 47 and back.columns.tolist()[-1] == "refers_to"
    kinds = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in warc.read_archives(spark, small).where("url = 'u'").collect())
    assert kinds == [("1", "response", "None")] * 2 + [("2", "revisit", "1")] * 2 + [("None", "revisit", "1")]
    assert spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(small).count() > 1
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).first()["content"]
    size = int.from_bytes(content[4:8], "little")  # the dictionary's frame leads
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(bytes(content[8 : 8 + size])))
    stream = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(bytes(content)), read_across_frames=True)
    assert stream.read().startswith(b"WARC/1.1\r\n")
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_neighbours_recall_and_cases(spark):
    r = np.random.RandomState(2)
    x = r.standard_normal((1500, 32))
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)] + [(2000 + i, [float(v) for v in x[0]]) for i in range(60)]
    odd = [(3000, None), (3001, []), (3002, [0.0] * 32), (3003, [float("nan")] * 32), (3004, [None] + [1.0] * 31), (3005, [float("inf")] + [1.0] * 31), (3006, [1.0, 2.0])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("keys", F.lit(1))
    got = neighbours.nearest(table, lambda i: i % 20 == 0).toPandas()
    ids, y = np.array([k for k, _ in rows]), np.array([v for _, v in rows])
    hits = 0
    asked = [k for k in ids if k % 20 == 0]
    for k in asked:
        s = y @ y[ids == k][0]
        s[ids == k] = -np.inf
        best = ids[np.lexsort((ids, -np.round(s, 9)))[:20]]
        own = got[got.query_id == k].sort_values("rank")
        assert len(own) == 20 and k not in set(own.vec_id) and (np.diff(own.score) <= 0).all()
        hits += len(set(best) & set(own.vec_id))
    assert hits >= 0.9 * 20 * len(asked)
    assert set(got.query_id) == set(asked)
    tied = got[got.query_id == 2000].sort_values("rank").vec_id.tolist()  # 61 equal vectors: least ids first
    assert tied == [0] + [i for i in range(2001, 2020)]
    few = neighbours.nearest(table.where("vec_id < 3"), lambda i: i == 0).collect()
    assert len(few) == 2
    assert neighbours.nearest(table.limit(0), lambda i: i == 0).count() == 0


def test_hilbert_keys_walk_through_neighbouring_cells():
    cells = np.array([[x, y] for x in range(16) for y in range(16)])
    order = cells[np.argsort(neighbours.hilbert(cells, 4))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_recordings_align(spark):
    r = np.random.RandomState(4)
    tunes = [r.standard_normal(160) for _ in range(12)]
    sound = [np.frombuffer(chroma.melody(t), "<i2") for t in tunes]
    noisy = (sound[0] + r.standard_normal(len(sound[0])) * 200).astype("<i2")
    shifted = sound[1][chroma.HOP * 20 :]
    rows = [(i, s.tobytes()) for i, s in enumerate(sound)] + [(50, noisy.tobytes()), (51, shifted.tobytes()), (52, None), (53, b""), (54, b"\0" * 9)] + [(60 + i, sound[2].tobytes()) for i in range(20)]
    media = spark.createDataFrame(rows, "id long, audio binary").withColumn("key", F.lit(1))
    out = chroma.matches(media, lambda i: i < 3).toPandas().set_index("id")
    assert len(out) == len(rows)
    assert out.best_query[50] == 0 and abs(out.offset[50]) <= 1 and out.error[50] < 0.25
    assert out.best_query[51] == 1 and out.offset[51] == -20
    assert (out.class_id[[60 + i for i in range(20)]] == 2).all()
    assert (out.n_frames[[52, 53, 54]] == 0).all() and (out.n_links[list(range(3, 12))] == 0).all()
    assert chroma.matches(media.limit(0), lambda i: i == 0).count() == 0


def alignments(prints, queries):
    """Best alignment of every (query, other) pair by trying all offsets with enough votes, one by one."""
    step, out = chroma.STEP, {}
    keys = {k: [tuple(p[i + j * step] for j in range(3)) for i in range(len(p) - 2 * step)] for k, p in prints.items()}
    for q in queries:
        for k in prints:
            if k == q:
                continue
            votes = {}
            for i, a in enumerate(keys[k]):
                for j, b in enumerate(keys[q]):
                    if a == b and a != (chroma.SILENT,) * 3:
                        votes[i - j] = votes.get(i - j, 0) + 1
            best = None
            for offset, n in votes.items():
                both = [(prints[k][i], prints[q][i - offset]) for i in range(len(prints[k])) if 0 <= i - offset < len(prints[q])]
                wrong = sum(((a ^ b) & 0xFFFFFFFF).bit_count() for a, b in both)
                if n >= chroma.VOTES and len(both) >= chroma.OVERLAP and wrong / (32 * len(both)) <= chroma.ERRORS:
                    best = min(best or (9,), (wrong / (32 * len(both)), -len(both), offset))
            if best:
                out[q, k] = (best[2], -best[1], round(best[0], 9))
    return out


def test_alignments_equal_brute_force(spark):
    r = np.random.RandomState(12)
    parts = [r.randint(-(2**31), 2**31, r.randint(20, 70)).tolist() for _ in range(8)] + [[5] * 40, [chroma.SILENT] * 60]
    prints = {k: sum((parts[i] for i in r.randint(0, len(parts), r.randint(1, 6))), []) for k in range(40)}
    for k in (3, 4, 5):  # a few wrong bits
        prints[k] = [int(np.int32(np.uint32(x & 0xFFFFFFFF) ^ np.uint32(1 << int(r.randint(32))))) if r.rand() < 0.3 else x for x in prints[k]]
    prints = {k: p for i, (k, p) in enumerate(prints.items()) if p not in list(prints.values())[:i]}
    table = spark.createDataFrame(list(prints.items()), "id long, fingerprint array<int>")
    got = {(r.query_id, r.id): (r.offset, r.frames, round(r.error, 9)) for r in chroma.align(table, lambda i: i % 5 == 0).collect()}
    assert got == alignments(prints, [k for k in prints if k % 5 == 0])


def test_recordings_with_repeated_ids(spark):
    r = np.random.RandomState(5)
    one, two = chroma.melody(r.standard_normal(120)), chroma.melody(r.standard_normal(120))
    rows = [(0, one), (1, one), (1, one), (2, two), (2, one), (None, two), (4, b"\0" * 60000), (5, b"\0" * 70000)]
    out = chroma.matches(spark.createDataFrame(rows, "id long, audio binary"), lambda i: i == 0)
    got = sorted((str(r.id), str(r.class_id), r.n_links) for r in out.collect())
    # The class of the second tune is its least holder, 2; silence aligns with nothing.
    assert got == sorted([("0", "0", 0), ("1", "0", 0), ("1", "0", 0), ("2", "2", 0), ("2", "0", 0), ("None", "2", 0), ("4", "4", 0), ("5", "5", 0)])


def test_every_voted_offset_is_tried(spark):
    r = np.random.RandomState(8)
    part = lambda n: r.randint(-(2**31), 2**31, n).tolist()
    v, c, y, x, z = part(100), part(120), part(100), part(300), part(300)
    prints = spark.createDataFrame([(1, v + c + z), (2, y + c + x + v), (3, [7] * 60), (4, [7] * 90), (5, part(80))], "id long, fingerprint array<int>")
    got = {(r.query_id, r.id): (r.offset, r.frames, r.error) for r in chroma.align(prints, lambda i: i.isin(1, 3)).collect()}
    # The shared middle at offset 0 has more votes and fails; a sustained chord has one key.
    assert got == {(1, 2): (520, 100, 0.0), (3, 4): (0, 60, 0.0)}


def test_ordinal_grades_on_held_out_rows(spark):
    r = np.random.RandomState(6)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(1500):
        g = int(r.randint(3))
        text = [str(x) for x in r.choice(words, 40)]
        if g == 1:
            text[3] = "nasty"
        if g == 0:
            text = [t.upper() + "!!" for t in text]
        rows.append((i, " ".join(text), g))
    rows += [(5000, None, 2), (5001, "", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rating int")
    model = quality.fit(df, df.where("doc_id % 3 > 0").select("doc_id", "rating"))
    assert (np.diff(model.thresholds) >= 0).all()
    out = quality.score(df.withColumn("tails", F.lit(1)), model).join(df.select("doc_id", "rating"), "doc_id").toPandas()
    held = out[(out.doc_id % 3 == 0) & (out.doc_id < 5000)]
    assert (np.round(held.expected) == held.rating).mean() > 0.95
    assert len(out) == len(rows) and out.expected.notna().all()
    same = quality.fit(df, df.select("doc_id", F.lit(1).alias("rating")))
    assert abs(quality.score(df.limit(5), same).first().expected - 1) < 1e-6
    none = quality.fit(df, df.limit(0).select("doc_id", "rating"))
    assert quality.score(df.limit(0), none).count() == 0


def odd_documents(spark, sf):
    """Documents of the small table, and rows whose ids are null or repeat, with equal and other texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = docs.where("doc_id < 60").collect()
    long = " ".join(f"word{i}" for i in range(80))
    near = long.replace("word40", "other")
    apart = " ".join(f"clean{i}" for i in range(80))
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in some] + [
        (None, None, None, None, None), (None, "", "en", "src0", 0), (None, long, "en", "src0", len(long)), (None, apart, "en", None, len(apart)),
        (7, apart + " more of it", "en", "src1", 1), (7, some[7].text, "en", "src1", 1), (70, near, "en", "src1", len(near)), (71, near, "en", "src1", len(near)), (71, near, "de", "src1", len(near)),
    ]
    return spark.createDataFrame(rows, docs.schema)


def test_pipeline_keeps_rows_of_any_id(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = odd_documents(spark, sf)
    spelled = lambda df: sorted(repr(tuple(r)) for r in df.select(pipeline.COLUMNS).collect())

    graded = pipeline.quality_filter(spark, docs, sf)
    p_top = {r.doc_id: r.keep for r in quality.grade(docs, spark.read.parquet(f"{sf}/labels.parquet"), rows=docs.select(F.xxhash64("text").alias("doc_id"), "text").distinct()).collect()}
    wanted = [r for r, h in zip(docs.collect(), docs.select(F.xxhash64("text").alias("h")).collect()) if p_top[h.h]]
    assert spelled(graded) == sorted(repr(tuple(r)) for r in wanted)
    assert {r.text for r in graded.where("doc_id IS NULL").collect()} >= {None, ""}

    kept = pipeline.near_dedup(spark, docs, sf).collect()
    texts = [r.text for r in kept]
    near = [r for r in kept if r.text and r.text.startswith("word0 ")]
    assert [(r.doc_id, "other" in r.text) for r in near] == [(70, True)]  # of four copies that of the least id
    assert {None, ""} <= {r.text for r in kept if r.doc_id is None} and sum(r.doc_id == 7 for r in kept) >= 1
    assert sum(t is not None and t.startswith("clean0 ") for t in texts) == 1

    cut = pipeline.passage_dedup(spark, docs, sf)
    assert cut.count() == docs.count()
    by_id = {r.doc_id: r.text for r in cut.where("doc_id IN (70, 71)").collect()}
    assert by_id[70].startswith("word0 ") and len(by_id[71]) < 100
    assert cut.where("doc_id IS NULL AND text IS NULL").count() == 1
    assert all(r.n_chars == len(r.text) for r in cut.where("doc_id = 71").collect())

    mixed = pipeline.source_mix(spark, docs, sf)
    own = {tuple(r) for r in docs.collect()}
    assert all(tuple(r) in own for r in mixed.collect())
    words = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n")).collect()}
    before, after = words(docs), words(mixed)
    assert all(after.get(s, 0) <= 2.1 * (n or 0) + 200 for s, n in before.items())

    out = pipeline.tokenise(spark, docs, sf)
    assert out.count() == docs.count() and out.where("size(ids) <> n_tokens").count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_on_empty_and_wider_tables(spark, sf, stage):
    pipeline = pytest.importorskip("corpus_pipeline")
    name, function = pipeline.STAGES[stage]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 30")
    wide = docs.select("*", *[F.lit(1).alias(c) for c in ("row_key", "number", "digest", "keep", "copies", "component_id", "ids", "kept_text", "range")])
    spelled = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    assert spelled(function(spark, wide, sf)) == spelled(function(spark, docs, sf))
    assert function(spark, docs.limit(0), sf).count() == 0


def test_pipeline_stages(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = odd_documents(spark, sf)
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == pipeline.COLUMNS
    out = pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    assert len(out) > 0 and (out.ids.map(len) == out.n_tokens).all()


def test_ordinal_fit_is_the_likeliest():
    """The penalised likelihood by the textbook's formula does not rise in any direction from the fit."""
    r = np.random.RandomState(3)
    n, size = 300, 4
    doc, column = np.repeat(np.arange(n), 2), r.randint(0, size, 2 * n)
    value = r.rand(2 * n)
    true = np.array([1.5, -1.0, 0.5, 0.0])
    score = np.bincount(doc, true[column], minlength=n)
    rating = (score[:, None] + r.logistic(size=n)[:, None] > np.array([-0.5, 1.0])).sum(axis=1)

    def loss(weight, cuts):
        total = quality.RIDGE / 2 * (weight**2).sum()
        for i in range(n):
            s = sum(weight[c] + v * weight[size + c] for c, v in zip(column[doc == i], value[doc == i]))
            below = [1 / (1 + np.exp(-(c - s))) for c in cuts]
            total -= np.log([below[0], below[1] - below[0], 1 - below[1]][rating[i]])
        return total / n

    weight, cuts = quality.Ordinal(3).fit(doc, column, value, rating, size, steps=1500)
    assert cuts[0] < cuts[1]
    best = loss(weight, cuts)
    for k in range(2 * size):
        for step in (-0.05, 0.05):
            assert loss(weight + step * (np.arange(2 * size) == k), cuts) > best - 2e-5
    for k in range(2):
        for step in (-0.05, 0.05):
            assert loss(weight, cuts + step * (np.arange(2) == k)) > best - 2e-5
    # Mass moved between grades shows in the expected sign of the largest weight.
    assert weight[0] + weight[size] > weight[1] + weight[size + 1]
