"""Crawls in rounds against a queue, on random graphs."""

import random
from collections import deque

import pytest

from foliant.operators import crawl


def queue(start, links, pages, redirects, site, depth, limit):
    waiting, seen, saved = deque([(start, 0)]), set(), []
    while waiting:
        url, level = waiting.popleft()
        if url in seen:
            continue
        seen.add(url)
        if len(saved) >= limit:
            continue
        final = redirects.get(url, url)
        if pages.get(final) != site or final in {u for u, _ in saved}:
            continue
        saved.append((final, level))
        if level < depth:
            waiting.extend((dst, level + 1) for dst in links.get(final, []))
    return [(site, u, d, n) for n, (u, d) in enumerate(saved, 1)]


@pytest.mark.parametrize("seed", range(4))
def test_rounds_equal_a_queue(spark, seed):
    r = random.Random(seed)
    pages = {f"{s}/{i}": s for s in "abc" for i in range(30)}
    urls = [*pages, *[f"{s}/x{i}" for s in "abc" for i in range(10)]]
    redirects = {f"{s}/x{i}": r.choice(list(pages)) for s in "abc" for i in range(7)} | {"a/3": "a/4"}
    links = {p: [r.choice([u for u in urls if u[0] == p[0]] if r.random() < 0.8 else urls) for _ in range(r.randint(0, 6))] for p in pages}
    depth, limit = r.randint(0, 5), r.choice([1, 5, 12, 100])
    want = [row for s in "abc" for row in queue(f"{s}/0", links, pages, redirects, s, depth, limit)]
    got = crawl.crawled(
        spark.createDataFrame([(s, f"{s}/0") for s in "abc"] + [("d", "d/0")], "site string, url string"), spark.createDataFrame([(p, d, i) for p, ds in links.items() for i, d in enumerate(ds)], "src string, dst string, pos int"),
        spark.createDataFrame([(s, u) for u, s in pages.items()], "site string, url string"), depth, limit, spark.createDataFrame(list(redirects.items()), "url string, final string"),
    )
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
