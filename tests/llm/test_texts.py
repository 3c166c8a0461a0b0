"""Operators on texts against brute force and the tokenizer's own library."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.llm import bpe, licenses, minhash, mixing, suffix
from foliant.llm.queries import vocabulary


def docs(spark, rows, **extra):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


def near(rows, n, percent):
    """Least reachable id by all pairs."""
    sets = {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in keys}


EDGES = [(900, None), (901, ""), (902, " \t\n"), (903, "Only"), (904, "only"), (905, "two words"), (906, "x " * 3000)]


@pytest.fixture(scope="module")
def copies():
    r = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    out, base = [], [r.choice(words) for _ in range(80)]
    for i in range(160):
        w = list(base) if i % 2 else [r.choice(words) for _ in range(r.randint(1, 60))]
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append((i, " ".join(w)))
    return out + [(300 + i, out[1][1]) for i in range(30)] + EDGES


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(spark, copies, n, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(spark, copies, rep=1, bucket="x"), n, percent).collect()}
    assert got == near(copies, n, percent)


def test_near_duplicates_of_an_empty_table(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def passages(rows):
    seen, out = set(), {}
    for k, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[k] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.fixture(scope="module")
def repeats():
    r = random.Random(3)
    parts = ["".join(r.choice("abcdefgh ") for _ in range(k)) for k in (60, 99, 100, 101, 150, 300)]
    rows = [(i, "".join(r.choice([*parts, "q" * 150, "".join(r.choice("abcé日") for _ in range(40))]) for _ in range(r.randint(0, 8)))) for i in range(200)]
    rows += [(2000 + i, "".join(r.choice("klmno") for _ in range(50)) + parts[1][:90] + "".join(r.choice("pqrs") for _ in range(50))) for i in range(80)]
    return rows + [(1000, None), (1001, ""), (1002, "a" * 3000), (1003, "ab" * 900), (1004, "a" * 99), (1005, "a" * 101 + "b" + "a" * 120), (1006, ("z" * 70 + "\n") * 30)]


@pytest.mark.parametrize("hot", [None, 10])
def test_repeated_passages_equal_brute_force(spark, repeats, hot, monkeypatch):
    if hot:  # deal nearly every hash out in shares
        monkeypatch.setattr(suffix, "HOT", hot)
        monkeypatch.setattr(suffix, "SHARE", hot)
        monkeypatch.setattr(suffix, "SORTED", 300)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digests(docs(spark, repeats, spans=1, h="x")).collect()}
    assert got == passages(repeats)


def test_repeated_ids_come_back_as_often(spark, repeats):
    twice = [*repeats[:60], *repeats[:3], (5, "other text " * 30), (None, repeats[7][1] or "x"), (None, "k" * 200)]
    ranked = sorted({(k, t or "") for k, t in twice}, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    want = passages([(i, t) for i, (_, t) in enumerate(ranked)])
    number = {r: i for i, r in enumerate(ranked)}
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digests(docs(spark, twice)).collect())
    assert got == sorted((str(k), *want[number[k, t or ""]]) for k, t in twice)
    near_ = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.near_duplicates(docs(spark, twice), 3, 85).collect())
    sets = near([(i, t) for i, (_, t) in enumerate(ranked)], 3, 85)
    back = {i: r[0] for r, i in number.items()}
    ends = [(k, sets[number[k, t or ""]]) for k, t in twice]
    assert near_ == sorted((str(k), n, str(back[c]), k == back[c]) for k, (n, c) in ends)


def test_no_passages_in_an_empty_table(spark):
    assert suffix.digests(docs(spark, [])).count() == 0


def test_byte_pairs_equal_the_library(spark):
    import tiktoken

    ranks, pattern = vocabulary()
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=dict(ranks), special_tokens={})
    rows = [(1, None), (2, ""), (3, " " * 300 + "x y\u0085z"), (4, "\U0001df00 it's 'sfoo'd 12३４²Ⅷ"), (5, "a" * 20000), (6, "日本語!!??\n\n  x "), (7, "\x1c\x1d \x1f a\x0b﻿"), (8, "ab" * 500 + "=" * 999), (9, "same"), (10, "same"), (11, "<|endoftext|>")]
    table = docs(spark, rows, ids="clash", n=1)
    got = {r.doc_id: r for r in bpe.round_trip(table, ranks, pattern).collect()}
    for k, t in rows:
        want = theirs.encode_ordinary(t or "")
        assert (got[k].n_tokens, got[k].ids) == (len(want), want)
        assert bytes(got[k].decoded) == (t or "").encode()
    back = bpe.decode(bpe.encode(table, ranks, pattern), ranks).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in back} == {k: t or "" for k, t in rows}
    assert bpe.round_trip(docs(spark, []), ranks, pattern).count() == 0


def test_every_token_encodes_to_itself(spark):
    ranks, _ = vocabulary()
    import pyarrow as pa

    ids = bpe.Encoder(ranks).pieces(pa.array([t for t, _ in ranks], pa.binary()))
    assert ids.to_pylist() == [[r] for _, r in ranks]


def singly(piece, known):
    """Ids by contracting the leftmost pair of minimum rank until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(known[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in known]
        if not pairs:
            return [known[p] for p in parts]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_rounds_equal_single_contractions_for_any_ranks():
    import pyarrow as pa

    for seed in range(25):
        r = random.Random(seed)
        tokens = [bytes([i]) for i in range(256)]
        more = {bytes(r.choice(b"abc") for _ in range(r.randint(2, 6))) for _ in range(60)}
        more = list(more)
        r.shuffle(more)  # wholes may rank below their parts
        ranks = [(t, i) for i, t in enumerate(tokens + more)]
        known = dict(ranks)
        pieces = list({bytes(r.choice(b"abc") for _ in range(n)) for n in (1, 2, 3, 5, 8, 13, 40, 90, 300)} | {b"a" * 65, b"ab" * 40})
        assert bpe.Encoder(ranks).pieces(pa.array(pieces, pa.binary())).to_pylist() == [singly(p, known) for p in pieces]


def test_a_long_piece_and_unknown_ids(spark):
    import tiktoken

    ranks, pattern = vocabulary()
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=dict(ranks), special_tokens={})
    r = random.Random(7)
    text = "".join(r.choice("etaoinshrdluETAOIN") for _ in range(12_000))
    assert bpe.encode(docs(spark, [(1, text)]), ranks, pattern).first().ids == theirs.encode_ordinary(text)
    odd = bpe.decode(spark.createDataFrame([(1, None), (2, []), (3, [64])], "doc_id long, ids array<int>"), ranks).collect()
    assert [bytes(r.decoded) for r in sorted(odd)] == [b"", b"", ranks[64][0]]
    with pytest.raises(Exception, match="unknown token id"):
        bpe.decode(spark.createDataFrame([(1, [70_000])], "doc_id long, ids array<int>"), ranks).collect()

def test_mix_reaches_its_targets(spark):
    r = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 1, 5, 50, 200]))), r.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)] + [(5000, None, "d"), (5001, "x", "a"), (7, "w w", "a"), (7, "w w", "a"), (None, "w w w", "a"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rank", F.lit(1))
    out = mixing.mix(df).toPandas()
    assert len(out) == len(rows) and out.copies.between(0, 2).all()
    key = lambda r: (str(r.doc_id), r.size, r.copies)
    assert sorted(map(key, mixing.mix(df.repartition(7)).collect())) == sorted(map(key, mixing.mix(df).collect()))
    total = out["size"].sum()
    by = out.assign(taken=out.copies * out["size"]).groupby(out.source.fillna("-")).agg(taken=("taken", "sum"), target=("target", "first"), own=("source_size", "first"))
    assert abs(by.target.sum() - 1.5 * total) < 1e-6 * total
    assert ((by.taken - by.target).abs() <= 200 * 2 + 0.01 * by.target).all()
    assert (by.target <= 2 * by.own + 1e-6).all()
    assert mixing.mix(df.limit(0)).count() == 0


def test_license_phrases_and_suppression(spark):
    rows = [(1, None), (2, ""), (3, "Released Under the MIT License."), (4, "CC-BY-NC cc by nc_cc.by.nc"), (5, "Apache License, Version 2.0 or Creative Commons Attribution 4.0 International"), (6, "nothing here"), (7, "é under the mit licenseé"), (8, "x " * 20000 + "under the mit license " * 3)]
    got = {r.doc_id: r for r in licenses.license_labels(docs(spark, rows, joined="x")).collect()}
    assert (got[1].n_words, got[1].first_word, got[1].labels, got[1].score) == (0, None, "", 0.0)
    assert (got[3].n_base, got[3].first_word, got[3].base_labels) == (1, 1, "mit")
    assert (got[4].n_base, got[4].first_word, got[4].last_word) == (3, 0, 6)
    assert set(got[5].labels.split(",")) >= {"apache-2", "cc-by-4.0"} and "cc" not in got[5].labels.split(",")
    assert (got[6].labels, got[6].n_base) == ("", 0)
    assert got[7].n_base == 0
    assert (got[8].n_base, got[8].first_word, got[8].last_word) == (3, 20000, 20008)
    assert licenses.license_labels(docs(spark, [])).count() == 0


def sample(regex):
    """A text that a rule's expression matches: first alternatives, optional parts left out."""
    import re._parser as parser

    def made(parts):
        out = ""
        for kind, value in parts:
            kind = str(kind)
            if kind == "LITERAL":
                out += chr(value)
            elif kind == "ANY":
                out += "x"
            elif kind == "IN":
                out += chr(value[0][1] if str(value[0][0]) == "LITERAL" else value[0][1][0])
            elif kind == "BRANCH":
                out += made(value[1][0])
            elif kind == "SUBPATTERN":
                out += made(value[3])
            elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
                out += made(value[2]) * value[0]
            else:
                raise ValueError(kind)
        return out

    return made(parser.parse(regex))


def test_every_license_rule_has_an_effect_with_and_without_the_gate(spark, monkeypatch):
    own = licenses.rules()
    assert len(licenses.sentences()) > 140 and len({r.regex for r in licenses.sentences()}) == len(licenses.sentences())
    texts = docs(spark, [(i, f"zq {sample(r.regex)} qz") for i, r in enumerate(own)])
    alone = {i: {d["order"] for d in row.detections or []} for i, row in ((r.doc_id, r) for r in licenses.scan(texts, own).collect())}
    monkeypatch.setattr(licenses, "gate", lambda rules: ".")
    ungated = {r.doc_id: {d["order"] for d in r.detections or []} for r in licenses.scan(texts, own).collect()}
    assert alone == ungated
    # Each rule finds its own sentence: itself, or one that contains it.
    assert [own[i] for i, found in alone.items() if not found] == []


def test_suppression_equals_comparing_all_pairs(spark):
    r = random.Random(9)
    rows = []
    for k in range(60):
        found = []
        for order in range(r.randint(0, 25)):
            first = r.randint(0, 12)
            found.append((first, first + r.randint(0, 5), r.randint(1, 4), r.randint(0, 30), "l"))
        rows.append((k, sorted(set(found))))
    table = spark.createDataFrame(rows, "k int, found array<struct<first:int,last:int,priority:int,order:int,label:string>>")
    got = {x.k: sorted(tuple(d) for d in x.kept) for x in table.select("k", licenses._kept(F.col("found")).alias("kept")).collect()}

    def beats(o, d):
        holds = o[0] <= d[0] and o[1] >= d[1]
        longer, equal = o[1] - o[0] > d[1] - d[0], o[1] - o[0] == d[1] - d[0]
        return holds and (o[2] < d[2] or (o[2] == d[2] and (longer or (equal and o[3] < d[3]))))

    assert got == {k: [d for d in found if not any(beats(o, d) for o in found)] for k, found in rows}


def test_license_gate_lets_every_keyword_and_named_license_through(spark):
    own = licenses.rules()
    keywords = sorted({k for r in own for k in r.keyword.split("|")})
    texts = docs(spark, [(i, f"x\n{k.upper().replace(' ', ' -\t')}z") for i, k in enumerate(keywords)] + [(i + 1000, k) for i, k in enumerate(keywords)])
    shut = licenses.scan(texts, own).where("detections IS NULL").select("doc_id").collect()
    assert [keywords[r.doc_id % 1000] for r in shut] == []
    named = {
        "Text: CC BY-SA 4.0": "cc-by-sa-4.0", "Text (CC BY 4.0)": "cc-by-4.0", "see MPL-2.0": "mpl-2.0", "EPL 2.0": "epl-2.0", "EUPL v1.2": "eupl-1.2", "CDDL 1.0": "cddl-1.0", "GFDL 1.3": "gfdl-1.3",
        "ZPL 2.1": "zpl-2.1", "LPPL 1.3": "lppl-1.3", "CeCILL 2.1": "cecill-2.1", "The Software shall be used for Good, not Evil.": "json", "then buy me a beer": "beerware", "by the Independent JPEG Group": "ijg",
    }
    got = {r.doc_id: r for r in licenses.license_labels(docs(spark, list(enumerate(named)))).collect()}
    assert {t: label for i, (t, label) in enumerate(named.items()) if label not in got[i].labels.split(",") or not got[i].score} == {}
    # Behind a negation nothing is detected, but base phrases count.
    no = {r.doc_id: r.labels for r in licenses.license_labels(docs(spark, [(1, "it is not licensed under the Apache License 1.1 here"), (2, "no longer GPL 2"), (3, "not under the MIT license"), (4, "not bad: licensed under the GPL 2")])).collect()}
    assert no[1] == "" and no[2] == "" and no[3] == "mit" and "gpl-2" in no[4]
    # Parts of words and words apart are no keywords.
    none = licenses.scan(docs(spark, [(1, "a simple reply, examples"), (2, "accby"), (3, "cc 1 by"), (4, "épl")]), own)
    assert none.where("detections IS NOT NULL").count() == 0


def test_base_phrases_equal_brute_force(spark):
    """Words, base places and labels of the whole query against a plain search of every place."""
    r = random.Random(8)
    base = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    vocabulary = ["Under", "THE", "mit", "License", "apache", "version", "2", "cc", "BY", "nc", "é", "x_y", "not", "2.0"]
    rows = [(i, "".join(r.choice(vocabulary) + r.choice([" ", "-", "\n", ", ", "…"]) for _ in range(r.randint(0, 60)))) for i in range(300)]
    rows += [(i + 400, " -- ".join(" ".join(p) for p in r.choices(list(base), k=r.randint(1, 5)))) for i in range(60)] + [(900, None), (901, ""), (902, "cc by nc " * 4000), (None, "CC-BY-NC"), (5, "under the MIT license"), (5, "under the MIT license")]
    want = []
    for k, text in rows:
        words = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        found = [(i, label) for p, label in base.items() for i in range(len(words) - len(p) + 1) if tuple(words[i : i + len(p)]) == p]
        at = [i for i, _ in found]
        want.append((str(k), len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    out = licenses.license_labels(docs(spark, rows, labels="clash", score=1)).collect()
    assert sorted(repr((str(x.doc_id), x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels)) for x in out) == sorted(map(repr, want))
    for x in out:
        own, base_own = set(filter(None, x.labels.split(","))), set(filter(None, x.base_labels.split(",")))
        assert base_own <= own and 0 <= x.score <= 1 and x.labels == ",".join(sorted(own)) and (x.score > 0 or not own)
