"""The pipeline's last stage encodes and decodes."""

import hashlib

import numpy as np
import pyarrow as pa

import corpus_pipeline
from foliant.llm import bpe, suffix
from foliant.llm.queries import vocabulary


def test_tokenise_decodes_its_ids(spark, sf):
    texts = ["plain words", "Zoë – 12\n\n x", "", None]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.tokenise(spark, docs, sf).collect()}
    assert [got[i].decoded_sha256 for i in range(4)] == [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
    assert all(len(r.ids) == r.n_tokens for r in got.values()) and got[0].n_tokens > 0


def test_pieces_and_ids_go_through_in_parts(monkeypatch):
    ranks, _ = vocabulary()
    words = pa.array([w.encode() for w in ["some", " words", " of", " a", " longer", " text", "x" * 60]], pa.binary())
    offsets = pa.array([0, 3, 3, 7], pa.int32())
    whole = bpe.Encoder(ranks)
    ids = whole.pieces(words)
    monkeypatch.setattr(bpe, "PART_BYTES", 10)
    monkeypatch.setattr(bpe, "PART_TOKENS", 3)
    cut, sizes = bpe.Encoder(ranks), {"_encode": [], "_decode": []}
    for name, own in sizes.items():
        monkeypatch.setattr(cut, name, lambda rows, f=getattr(cut, name), own=own: own.append(rows) or f(rows))
    assert cut.pieces(words).to_pylist() == ids.to_pylist()
    assert cut.decode(ids).to_pylist() == whole.decode(ids).to_pylist() == words.to_pylist()
    assert cut.decode(pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), ids.flatten())).to_pylist() == [b""] and len(cut.decode(ids.slice(0, 0))) == 0
    assert len(sizes["_encode"]) > 2 and all(len(x) == 1 or sum(map(len, x.to_pylist())) <= 10 for x in sizes["_encode"])
    assert len(sizes["_decode"]) > 2 and all(len(x) == 1 or len(x.flatten()) <= 3 for x in sizes["_decode"])


def test_passages_are_opened_in_slices(spark, monkeypatch):
    r = np.random.RandomState(3)
    passage = bytes(r.randint(97, 123, 300, np.uint8)).decode()
    texts = [bytes(r.randint(97, 123, 400, np.uint8)).decode() + passage for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(suffix, "PACKED", 600)
    got = {x.doc_id: x.kept_text for x in suffix.repeated_passages(docs).collect()}
    assert got == {i: t[:400] for i, t in enumerate(texts) if i}
