"""Periodic runs, packing and resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import packing, periodic, queries, resample

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(words, least=12):
    """Every run by trying all periods at all places."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(words, found):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found))


@pytest.mark.parametrize("block", [2, 2048])
def test_runs_equal_brute_force(block, monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK", block)
    r = random.Random(3)
    for _ in range(600):
        k = r.randint(1, 4)
        words = [r.randint(1, k) for _ in range(r.randint(0, 70))]
        if words and r.random() < 0.5:
            a = r.randrange(len(words))
            p = 1 + r.randrange(len(words) - a)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        least = r.choice([2, 5, 12])
        assert periodic.runs_of(words, least) == runs(words, least)


def test_end_positions_stay_in_order(monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK", 3)
    order = list(range(200))
    random.Random(1).shuffle(order)
    ends, seen = periodic.Ends(order[0]), [order[0]]
    for e in order[1:]:
        before, after = ends.insert(e)
        assert before == max((x for x in seen if x < e), default=-(1 << 60)) and after == min((x for x in seen if x > e), default=1 << 60)
        seen.append(e)
    assert list(ends) == sorted(seen)


def texts():
    """Random texts of few and of many words with repeated stretches, and odd ones."""
    r = random.Random(11)
    out = []
    for i in range(150):
        words = [f"w{r.randint(0, r.choice([2, 5, 400]))}" for _ in range(r.randint(0, 120))]
        for _ in range(r.randint(0, 3)):
            if words:
                a, p = r.randrange(len(words)), r.randint(1, 20)
                words[a:a] = words[a : a + p] * r.randint(1, 6)
        out.append((i, r.choice([" ", "\n", " \t "]).join(words)))
    same = " ".join(["again"] * 400)
    return out + [(500, None), (501, ""), (502, " \x0b\n"), (503, "Ünï\u00a0cødé " * 30), (None, same), (503, same), (503, same), (504, "x" * 70_000 + " y" * 50)]


def test_periodic_runs_of_documents(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("n_words", F.lit("x"))
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs.repartition(3)).collect())
    want = []
    for k, text in rows:
        words = WORD.findall(text or "")
        found = runs(words)
        want.append((str(k), len(words), found, collapsed(words, found)))
    assert got == sorted(want)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_periodic_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    out = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert len(out) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    some = 0
    for doc in docs:
        words = WORD.findall(doc.text or "")
        h, n = zlib.crc32(str(doc.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 1200:
            continue  # brute force takes the square
        found, got = runs(words), out[doc.doc_id]
        some += len(found)
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        assert (got.n_runs, got.start, got.length, got.period) == (len(found), *best)
        assert got.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert got.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in found)) and got.collapsed_sha256 == sha(collapsed(words, found))
    assert some > 10


def held(kinds):
    out = Counter()
    for kind in kinds:
        assert kind.bins > 0 and kind.fill == sum(s * n for s, n in kind.items)
        for size, n in kind.items:
            out[size] += n * kind.bins
    return out


def fewest(sizes, capacity):
    """Least number of bins, by trying all ways."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


def test_exchanges_keep_pieces_and_save_bins():
    r = random.Random(2)
    saved = exact = 0
    for _ in range(300):
        sizes = sorted((r.randint(3, 12) for _ in range(r.randint(1, 11))), reverse=True)
        counts = Counter(sizes)
        first = packing.best_fit(counts, 20)
        better = packing.improved(first, 20, packing.lower_bound(counts, 20))
        assert held(first) == held(better) == counts and max(k.fill for k in better) <= 20
        number, least = sum(k.bins for k in better), fewest(sizes, 20)
        assert packing.lower_bound(counts, 20) <= least <= number <= sum(k.bins for k in first)
        squares = lambda kinds: sum(k.bins * k.fill**2 for k in kinds)
        assert squares(better) >= squares(first)
        saved += sum(k.bins for k in first) - number
        exact += number == least
    assert exact > 290
    hard = Counter(r.randint(250, 420) for _ in range(1000))
    before, after = packing.best_fit(hard), packing.improved(packing.best_fit(hard), enough=packing.lower_bound(hard))
    assert held(after) == hard and sum(k.bins for k in after) < 0.95 * sum(k.bins for k in before)
    million = {k: 1_000_003 for k in range(300, 360)}  # the work does not grow with the number of pieces
    assert held(packing.best_fit(million)) == million


def test_packing_of_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    own = Tokenizer.from_file(files[0])
    r = random.Random(4)
    odd = ["\u00a0 a\u00a0 \u00a0b  c\u3000 d\u2003\u2003 e", "it's  I'll\n\n x\ty  ", " <|endoftext|> x", "日本 語 text é è", "  ", "a  b   c \n d", "\u0085 x \u0085y"]
    rows = [(i, " ".join(r.choice(["the", "Zürich", "don't", "123", "\n", "\u00a0", "é", "–", ""]) for _ in range(r.randint(0, 300)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(odd)] + [(200, None), (201, ""), (202, "word " * 5000), (203, "a" * 9000), (None, "none"), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("part", F.lit(1)).withColumn("length", F.lit("x"))
    pieces = packing.token_pieces(docs.repartition(3), *files, capacity=128)
    out = packing.packed(pieces, capacity=128)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    got = out.toPandas()
    want = Counter()
    for k, text in rows:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        lead = (len(ids) - 1) % 128 + 1 if len(ids) > 128 else len(ids)
        cuts = [0, *range(lead, len(ids) + 1, 128)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[str(k), i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])] += 1
    have = Counter((str(None if math.isnan(x.doc_id) else int(x.doc_id)), x.piece, x.start, x.length, x.ids_crc32, tuple(x.ids)) for x in got.itertuples())
    assert have == want
    at, full = {}, {}
    for x in got.sort_values(["sequence_id", "offset"]).itertuples():
        assert x.offset == at.get(x.sequence_id, 0)
        at[x.sequence_id] = x.offset + x.length
        full.setdefault(x.sequence_id, []).extend(x.ids)
    assert max(at.values()) <= 128 and len(at) <= packing.lower_bound(Counter(got.length.tolist()), 128) + 1
    assert {r.sequence_id: r.ids for r in packing.sequences(out).collect()} == full
    assert packing.packed(packing.token_pieces(docs.limit(0), *files)).count() == 0
    with pytest.raises(Exception, match="length is not within"):
        packing.packed(spark.createDataFrame([(5,), (200,)], "length long"), capacity=128)


def resampled(docs, target, percent=25, least=20):
    def features(text):
        words = FEATURE.findall((text or "").translate(LOW))
        return words, [zlib.crc32(x.encode()) % 10000 for x in words + [a + " " + b for a, b in zip(words, words[1:])]]

    own = [(k, *features(t)) for k, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    rows = []
    for k, words, f in own:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append((k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    order = sorted((i for i, r in enumerate(rows) if r[4] >= least), key=lambda i: (-rows[i][3], rows[i][0] is None, rows[i][0] or 0, rows[i][2], rows[i][1]))
    rank = {i: n + 1 for n, i in enumerate(order[: percent * len(order) // 100])}
    return sorted((str(r[0]), r[1], r[2], r[3], rank.get(i, 0)) for i, r in enumerate(rows))


def test_resampling_equals_brute_force(spark):
    r = random.Random(7)
    word = lambda: r.choice(["The", "cat", "sat", "ÉTÉ", "été", "x1", "z" * 60, "q" * 49, "Z" * 48, "a-b", "c_d", "日本"])
    rows = [(i * 37 - 900, " ".join(word() for _ in range(r.randint(0, 60)))) for i in range(300)]
    rows += [(20_000, None), (20_001, ""), (20_002, "--- ..."), (20_003, "one"), (None, "a b " * 30)] + [(9, "the cat sat " * 10)] * 30
    target = ["the cat sat on the mat", None, "", "ÉTÉ été x1"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("score", F.lit(1))
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(docs.repartition(5), goal)
    assert sorted((str(x.doc_id), x.n_features, x.weight, x.score, x["rank"] or 0) for x in got.collect()) == resampled(rows, target)
    assert resample.resample(docs.limit(0), goal).count() == 0
    none = resample.resample(docs, goal.limit(0)).collect()
    assert sorted((str(x.doc_id), x.n_features, x.weight, x.score, x["rank"] or 0) for x in none) == resampled(rows, [])


def test_resampling_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted((str(x.doc_id), x.n_features, x.weight, x.score, x["rank"] or 0) for x in queries.op13_importance_resampling(spark, sf).collect())
    assert got == resampled(docs, target)


@pytest.mark.parametrize("digit", [3, 12])
def test_the_kth_key_is_exact(spark, digit):
    r = random.Random(digit)
    ends = [-(1 << 63), (1 << 63) - 1, -1, 0, 1]
    rows = [(r.choice([r.randint(-5, 5), r.choice(ends)]), r.choice([r.randint(-3, 3), r.choice(ends)])) for _ in range(200)]
    table = spark.createDataFrame(rows, "a long, b long").cache()
    for k in (1, 2, 77, 199, 200):
        assert resample.kth_key(table, [F.col("a"), F.col("b")], k, digit) == list(sorted(rows)[k - 1])
    assert resample.kth_key(table, [F.col("a")], 201, digit) is None
    assert resample.kth_key(table.limit(0), [F.col("a")], 1, digit) is None
    same = spark.createDataFrame([(4, 4)] * 9, "a long, b long")
    assert resample.kth_key(same, [F.col("a"), F.col("b")], 9, digit) == [4, 4] and resample.kth_key(same, [F.col("a"), F.col("b")], 10, digit) is None
