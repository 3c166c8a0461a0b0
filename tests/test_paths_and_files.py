"""Resolution of paths against all pairs; a folder in step with its index through crashes."""

import os
import random

import pytest

from foliant.operators import paths
from foliant.streaming import files
from tests.test_similar import common


def ratio(a, b):
    return round(200.0 * common(a, b) / (len(a) + len(b)), 6)


def names(path):
    path = path.strip().lower().replace("\\", "/").strip("/")
    bare = path[:-3] if path.endswith(".md") else path
    return [x for x in {path, path.split("/")[-1], bare, bare.split("/")[-1]} if x], path


def test_paths_equal_all_pairs(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(2, 7)))
    known = sorted({f"{word()}/{word()}.{r.choice(['md', 'pdf'])}" for _ in range(60)} | {"Notes/Plan.md", "old/plan.md"})
    asked = [(i, r.choice(known)[r.randint(0, 3) :].replace("a", r.choice("ax")).upper()) for i in range(60)] + [(100, "plan"), (101, "notes\\plan.md"), (102, ""), (103, None), (104, "zzzzzzzzzz")]
    want = {}
    for i, p in asked:
        own, full = names(p or "")
        scored = [(max(ratio(a, b) for a in own for b in names(k)[0]), ratio(full, names(k)[1]), k) for k in known] if own else []
        want[i] = (max(scored)[2], max(scored)[0]) if scored and max(scored)[0] >= 70 else (None, None)
    got = paths.resolved(spark.createDataFrame(asked, "id long, proposed string"), spark.createDataFrame([(k,) for k in known] + [(None,)], "path string"))
    assert {x.id: (x.path, x.score) for x in got.collect()} == want


def test_only_what_has_no_close_path_meets_the_others(spark, monkeypatch):
    met = []
    real = paths.similar
    monkeypatch.setattr(paths, "similar", lambda a, b, percent: met.append((percent, sorted(x.s for x in a.collect()))) or real(a, b, percent))
    got = paths.resolved(spark.createDataFrame([(1, "www.x.org/en/10000"), (2, "qwertyuiop")], "id long, proposed string"), spark.createDataFrame([("www.x.org/en/10001",), ("qwertyuxyz",)], "path string"))
    assert {x.id: (x.path, x.score) for x in got.collect()} == {1: ("www.x.org/en/10001", 94.444444), 2: ("qwertyuxyz", 70.0)}
    assert met[0][1] == ["10000", "qwertyuiop", "www.x.org/en/10000"] and met[-1] == (70, ["qwertyuiop"])


def write(folder, name, text, at):
    path = os.path.join(folder, name)
    with open(path, "w") as out:
        out.write(text)
    os.utime(path, (at, at))


def state(spark, root):
    return sorted(tuple(x) for x in files.index(spark, root).collect())


@pytest.mark.parametrize("crash", ["before the index", "between index and ledger", "after the ledger"])
def test_a_killed_batch_is_repeated_without_effect(spark, tmp_path, monkeypatch, crash):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(folder)
    for k in range(3):
        write(folder, f"d{k}.md", f"one {k}\n\ntwo {k}", 1_700_000_000 + k)
    files.follow(spark, folder, root, per_batch=2).awaitTermination(120)
    assert len(state(spark, root)) == 6
    write(folder, "d1.new.md", "a\n\n\n\nb\n\nc", 1_700_000_100)
    write(folder, "empty.md", "", 1_700_000_101)
    real = files.apply_batch

    def killed(rows, batch, root, chunks):
        if crash == "before the index":
            raise RuntimeError("killed")
        if crash == "between index and ledger":
            monkeypatch.setattr(files, "_part", lambda root, name, n: (_ for _ in ()).throw(RuntimeError("killed")) if name == "ledger" else f"{root}/{name}/part={n}")
        real(rows, batch, root, chunks)
        raise RuntimeError("killed")

    monkeypatch.setattr(files, "apply_batch", killed)
    with pytest.raises(Exception, match="killed"):
        files.follow(spark, folder, root, per_batch=5).awaitTermination(120)
    monkeypatch.undo()
    files.follow(spark, folder, root, per_batch=5).awaitTermination(120)
    got = state(spark, root)
    whole = str(tmp_path / "whole")
    files.follow(spark, folder, whole).awaitTermination(120)
    assert got == state(spark, whole) and ("d1.new.md", 2, "c") in got
    last = {x.document: (x.digest, x.batch) for x in files.ledger(spark, root).collect()}
    assert set(last) == {"d0.md", "d1.md", "d2.md", "d1.new.md"}  # a file without content is none to the source


def test_only_changed_documents_are_written(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = lambda *xs: spark.createDataFrame([(f"/x/{n}", t, len(c), c.encode()) for n, t, c in xs], "path string, modificationTime long, length long, content binary").selectExpr("path", "timestamp_seconds(modificationTime) AS modificationTime", "length", "content")
    files.apply_batch(rows(("a", 1, "p\n\nq"), ("b", 1, "r"), ("a", 2, "s")), 0, root)
    files.apply_batch(rows(("a", 3, "s"), ("b", 3, "t\n\nu")), 1, root)
    assert state(spark, root) == [("a", 0, "s"), ("b", 0, "t"), ("b", 1, "u")]
    assert {x.document: x.batch for x in files.ledger(spark, root).collect()} == {"a": 0, "b": 1}
    files.apply_batch(rows(("a", 4, "s")), 2, root)
    assert not os.path.exists(f"{root}/index/part=2")
