"""Sums of term weights in blocks against all pairs."""

import math
import random

from foliant.operators import search


def test_weights_in_blocks_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 7)
    monkeypatch.setattr(search, "ASKED", 3)
    r = random.Random(4)
    held = [(d, t, r.randint(1, 4) / 4) for d in range(40) for t in "abcdef" if r.random() < 0.5]
    asked = [(q, t) for q in range(8) for t in r.sample("abcdefxyz", 3)]
    want = []
    for q in range(8):
        sums = {}
        for d, t, w in held:
            if (q, t) in asked:
                sums[d] = sums.get(d, 0) + w
        want += [(q, n + 1, d, s) for n, (d, s) in enumerate(sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:5])]
    rows = spark.createDataFrame(held, "doc_id long, term string, weight double"), spark.createDataFrame(asked, "query long, term string")
    assert sorted(map(tuple, search.weight_top_k(*rows, 5).collect())) == want
    assert search.weight_top_k(rows[0].limit(0), rows[1], 5).count() == search.weight_top_k(rows[0], rows[1].limit(0), 5).count() == 0


def test_tokens_are_looked_up_among_asked_terms(spark, monkeypatch):
    from foliant.queries import retrieval

    plans, settled = [], retrieval.settled
    monkeypatch.setattr(retrieval, "settled", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or settled(df))
    r = random.Random(6)
    texts = {i: [r.choice(["aa", "bb", "cc", "dd", "the", "x"]) for _ in range(r.randint(0, 12))] for i in range(30)}
    rows = [(i, " ".join(t)) for i, t in texts.items()] + [(100, None), (101, ""), (102, "the")]
    asked = spark.createDataFrame([(1, "aa"), (2, "aa"), (2, "bb"), (3, "none")], "query long, term string")
    got = {(x.doc_id, x.term): x.weight for x in retrieval.bm25_weights(spark.createDataFrame(rows, "doc_id long, text string"), asked).collect()}
    kept = {i: [w for w in t if w not in ("the", "x")] for i, t in texts.items()}
    docs, want = sum(bool(t) for t in kept.values()), {}
    for term in ("aa", "bb"):
        df = sum(term in t for t in kept.values())
        for i, t in kept.items():
            if tf := t.count(term):
                want[i, term] = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / 120)) * math.log(1 + (docs - df + 0.5) / (df + 0.5))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)
    # Comparing a document's tokens with all terms grows with both.
    assert plans[0].count("regexp_extract_all") == 1 and "LeftSemi" in plans[0] and "array_intersect" not in plans[0]


def test_rows_are_shuffled_once_and_postings_written_once(spark, sf, monkeypatch):
    import foliant.queries  # noqa: F401  registers the named queries
    from foliant.plans import registry
    from foliant.queries import retrieval

    assert search.ASKED > 512 * 100  # each block of queries is one more copy of all rows
    written, settled = [], retrieval.settled
    monkeypatch.setattr(retrieval, "settled", lambda df: written.append(df.columns) or settled(df))
    docs = spark.createDataFrame([(i, "aa bb aa") for i in range(5)] + [(7, "aa"), (7, "aa"), (8, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "aa"), (2, "bb"), (2, "cc")], "query long, term string")
    got = retrieval.bm25_top_k(docs, asked, 3).collect()
    assert {(x.query, x.rank): x.doc_id for x in got} == {(1, 1): 7, (1, 2): 0, (1, 3): 1, (2, 1): 0, (2, 2): 1, (2, 3): 2}
    # A row for each document and for each term, not for each term of each document.
    assert [c for c in written if "doc_id" in c] == [["doc_id", "n", "posts"]] and not [c for c in written if "weight" in c]
    assert registry.queries()["hybrid_rrf"](spark, sf).count() > 0


def test_nearest_rows_in_slices_equal_all_pairs(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(search, "AT_ONCE", 50)
    r = np.random.default_rng(3)
    v = r.integers(-2, 3, (60, 4)) + np.array([0.5, 0, 0, 0])  # many equal scores
    rows = [(i, [float(x) for x in v[i]], 0) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    queries = vectors.where("vec_id % 5 = 0").select(vectors.vec_id.alias("query"), "embedding")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6) + 0.0
    want = {(q, n + 1): i for q in range(0, 60, 5) for n, i in enumerate(sorted((i for i in range(60) if i != q), key=lambda i: (-scores[q][i], i))[:7])}
    for block in (8192, 9):
        monkeypatch.setattr(search, "BLOCK", block)
        assert {(x.query, x.rank): x.vec_id for x in search.cosine_top_k(vectors, queries, 7).collect()} == want
