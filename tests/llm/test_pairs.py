"""Similarity join, neighbours, url graph and the pipeline, against brute force."""

import random

import numpy as np
import pytest
from cases import ROWS, documents
from pyspark.sql import functions as F

from crownlake.llm import multi_index
from crownlake.llm.jaccard_join import class_links, document_links, linked_groups, one_of_each_group
from crownlake.llm.multi_index import BinaryCode, MultiIndex, kth_largest, nearest
from crownlake.llm.shingles import SEGMENT, sets_of
from crownlake.llm.url_graph import filter_urls, host_edges, propagate


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if len(words) >= width:
        return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def brute_groups(rows, width, percent):
    """key -> (set size, least key of its component), rows without key left out."""
    sets = {k: shingles(t, width) for k, t in rows if k is not None}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {k: (len(s), find(k)) for k, s in sets.items()}


def near_copies(seed, groups=12, singles=40):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage = rng.choices(vocab, k=60)
    rows = []
    for _ in range(groups):
        base = rng.choices(vocab, k=rng.randint(4, 120))
        for _ in range(rng.randint(2, 14)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append(" ".join(words))
    for _ in range(singles):
        rows.append(" ".join(rng.choices(vocab, k=rng.randint(1, 40)) + passage * rng.randint(0, 1)))
    rng.shuffle(rows)
    return [(20 + 3 * k, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize(("width", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (2, 70, 3)])
def test_groups_equal_brute_force(spark, width, percent, seed):
    rows = near_copies(seed) + [r for r in ROWS if r[0] is not None]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in linked_groups(documents(spark, rows), width=width, percent=percent).collect()}
    assert got == brute_groups(rows, width, percent)


def test_groups_of_awkward_rows(spark):
    rows = linked_groups(documents(spark), width=3, percent=90).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[None].component_id is None and by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0 and by[3].n_shingles == 1
    assert by[7].component_id == 6 and by[0].component_id == 0
    assert linked_groups(documents(spark, [])).count() == 0


@pytest.mark.parametrize(("width", "percent", "seed"), [(3, 90, 4), (2, 60, 5), (3, 100, 6)])
def test_links_equal_brute_force(spark, width, percent, seed):
    rows = near_copies(seed) + [r for r in dict.fromkeys(ROWS) if r[0] is not None]
    sets = {k: shingles(t, width) for k, t in rows}
    linked = lambda x, y: bool(x and y) and 100 * len(x & y) >= percent * len(x | y)
    got = document_links(documents(spark, rows), width=width, percent=percent).collect()
    want = {k: (len(x), min([k, *(o for o, y in sets.items() if x and x == y)]), sum(o != k and linked(x, y) for o, y in sets.items())) for k, x in sets.items()}
    assert {r.doc_id: (r.n_shingles, r.class_id, r.n_links) for r in got} == want and len(got) == len(rows)
    members, links = class_links(documents(spark, rows), width=width, percent=percent)
    first = {r.cls: sets[r.doc_id] for r in members.collect()}
    pairs = [(r.a, r.b) for r in links.collect()]
    different = list({x for x in sets.values() if x})
    assert len(pairs) == len(set(pairs)) == sum(linked(x, y) for i, x in enumerate(different) for y in different[:i]) and all(linked(first[a], first[b]) for a, b in pairs)


def test_links_of_awkward_rows(spark):
    assert document_links(documents(spark, [])).count() == 0
    repeated = document_links(documents(spark, [(1, "a b c"), (1, "a b c"), (2, "A b  c"), (None, "a b c"), (3, None)])).collect()
    assert sorted((r.class_id, r.n_links) for r in repeated) == [(1, 3)] * 4 + [(3, 0)]
    keyless = document_links(documents(spark, [(1, "a b c d"), (None, "a b c d e"), (None, "of its own"), (None, None)]), width=1, percent=80).collect()
    assert sorted((r.class_id is None, r.n_links) for r in keyless) == [(False, 1), (True, 0), (True, 0), (True, 1)]


def test_one_of_each_group(spark):
    rows = near_copies(5)
    docs = documents(spark, rows + [(None, "keyless text"), (1, "again"), (1, "again")])
    kept = one_of_each_group(docs, width=5, percent=80)
    groups = brute_groups(rows, 5, 80)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([k for k, (_, c) in groups.items() if c == k] + [None, 1], key=str)


def test_sets_don_t_depend_on_batches():
    texts = [(t or "").encode() for _, t in ROWS] + [b"ab cd " * (SEGMENT // 4), b"y" * (SEGMENT + 5)]
    for width in (3, 5):
        h, limits = sets_of(texts, width)
        alone = [sets_of([t], width)[0] for t in texts]
        assert all(np.array_equal(h[limits[k] : limits[k + 1]], x) for k, x in enumerate(alone))
        assert [len(x) for x in alone] == [len(shingles(t.decode(), width)) for t in texts]


# ---- neighbours -------------------------------------------------------------------------------------


def vectors(n, d=64, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_probing_finds_the_whole_ball():
    x = vectors(2000, seed=1).astype(float)
    code = BinaryCode.fit(x)
    words = code.words(x)
    index = MultiIndex(words)
    for q in range(0, 2000, 97):
        for radius in (0, 3, 9, 20, 31):
            near = np.flatnonzero(np.bitwise_count(words ^ words[q]).sum(axis=1) <= radius)
            assert np.array_equal(index.probe(words[q], radius), near)


@pytest.mark.parametrize("bits", [16, 40, 64, 100])
def test_probing_by_masks_or_by_values_finds_the_same(bits):
    words = np.random.default_rng(bits).integers(0, 1 << 16, (3000, -(-bits // 16))).astype(np.uint16)
    words[::3, -1] = 7
    index = MultiIndex(words)
    for radius in (0, 4, 9, 20, 30):
        for c in words[:6]:
            assert np.array_equal(index.probe(c, radius), np.flatnonzero(np.bitwise_count(words ^ c).sum(axis=1) <= radius))


def test_kth_largest():
    for seed, n in enumerate((20, 21, 159, 320, 321, 5000)):
        x = np.random.default_rng(seed).integers(0, 500, n).astype(float)
        assert kth_largest(x, 20) == np.sort(x)[-20]


def test_rerank_by_one_product_or_by_rows_gives_the_same(spark, monkeypatch):
    x = vectors(1500, seed=4)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = []
    for share in (0.0, 2.0):
        monkeypatch.setattr(multi_index, "DENSE_SHARE", share)
        found.append(sorted(map(tuple, nearest(df, F.col("vec_id") % 20 == 0).collect())))
    assert found[0] == found[1] and len(found[0]) == 75 * 20


def test_recall_and_order(spark):
    x = vectors(3000, seed=2)
    x[5] = x[1000]  # a tie
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    exact = x.astype(float)
    for q in range(0, 3000, 20):
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 21)) and q not in [v for _, v, _ in own]
        assert own == sorted(own, key=lambda t: (-t[2], t[1]))
        score = exact @ exact[q]
        score[q] = -9
        assert all(abs(score[v] - s) < 1e-12 for _, v, s in own)
        hits += len({v for _, v, _ in own} & set(np.argsort(-score)[:20].tolist()))
    assert hits / (20 * 150) >= 0.9


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (20, [0.6, 0.8], 1), (40, None, 1), (60, [0.0, 0.0], 1), (80, [nan, 1.0], 1), (100, [inf, 1.0], 1), (120, [None, 1.0], 1), (140, [1.0], 1), (None, [1.0, 1.0], 1), (3, [2.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [2.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in nearest(df, F.col("vec_id") % 20 == 0).collect()}
    assert got == {(0, 1, 3, 2.0), (0, 2, 4, 2.0), (0, 3, 20, 0.6), (20, 1, 3, 1.2), (20, 2, 4, 1.2), (20, 3, 0, 0.6)}
    assert nearest(df.filter("false"), F.col("vec_id") % 20 == 0).count() == 0


# ---- urls -------------------------------------------------------------------------------------------

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def brute_url(url):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = low(rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


def test_urls_and_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/x?y#z", "https://example.org/en/12", "https://example.org/en/2", "http://org", "http://x.com/fr/1", "http://x.com/de/?q", "http://x.com", "ftp://notexample.org/es/", "http://É.com/fr/", "a://b://c/d", "http://x.com?/fr/", "http://", "http://y.net/#top", "http://y.net/#top"]
    df = spark.createDataFrame([(k, u, None, 1.0, "v") for k, u in enumerate(urls)], "page_id long, url string, html string, trust double, verdict string")
    got = {r.page_id: r for r in filter_urls(df).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        host, path, rule, verdict = brute_url(u)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        if verdict:
            assert got[k].verdict == verdict
        assert got[k].verdict in ("allow", "block")
    assert filter_urls(df.filter("false")).count() == 0


def test_propagation_equals_dense_iteration(spark):
    rng = np.random.default_rng(3)
    n = 12
    w = rng.integers(0, 3, (n, n)) * (rng.random((n, n)) < 0.3)
    np.fill_diagonal(w, 0)
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", int(w[a, b])) for a in range(n) for b in range(n) if w[a, b]], "src string, dst string, pages long")
    s = rng.random((2, n)) * (rng.random((2, n)) < 0.4)
    seeds = spark.createDataFrame([(f"h{k}", float(s[0, k]), float(s[1, k])) for k in range(n)], "host string, trust double, distrust double")
    got = {r.host: (r.trust, r.distrust) for r in propagate(seeds, edges, tolerance=1e-10).collect()}
    assert any(not m.any() for m in w) and any(not m.any() for m in w.T)  # hosts without links, either way
    for row, m in ((0, w), (1, w.T)):
        own = s[row] / s[row].sum()
        total = m.sum(axis=1, keepdims=True)
        step = np.where(total > 0, m / np.where(total > 0, total, 1), own)
        r = np.linalg.solve(np.eye(n) - 0.85 * step.T, 0.15 * own)
        assert r.sum() == pytest.approx(1) and np.allclose([got[f"h{k}"][row] for k in range(n)], r, atol=1e-8)


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    page = lambda k, host, to: (k, f"http://{host}/x", "".join(f'<a href="//{t}/1">' for t in to))
    rows = [(0, "http://bad.com/de/", None), (1, "http://good.com/fr/", '<a href="https://friend.net/">'), page(2, "farm.net", ["bad.com", "BAD.com"]), page(3, "friend.net", []), page(4, "farm.net", ["farm.net"])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {tuple(r) for r in host_edges(df).collect()} == {("good.com", "friend.net", 1), ("farm.net", "bad.com", 1)}
    got = {r.page_id: r.verdict for r in filter_urls(df).collect()}
    assert got == {0: "block", 1: "allow", 2: "block", 3: "allow", 4: "block"}


# ---- pipeline ---------------------------------------------------------------------------------------


def test_pipeline_stages_on_the_test_tables(spark):
    import os

    import corpus_pipeline as P
    from crownlake.llm.common import stored

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(P.STAGES):
        before, docs = docs, stored(stage(spark, docs, data))
        if k < 3:
            assert docs.columns == columns and docs.join(before, columns, "left_anti").isEmpty()
            kept.append(docs.count())
        if k == 2:
            rows = [(r.doc_id, r.text) for r in before.collect()]
            groups = brute_groups(rows, 5, 80)
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, c) in groups.items() if c == i}
            left = {r.doc_id for r in docs.collect()}
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0
    assert {r.doc_id for r in docs.collect()} == left
    assert P.run(spark, data).count() == docs.count()
