"""Hard negatives against a plain search, on clusters, copies and broken rows, with trees of several levels."""

import math
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("chronomart.llm")

from chronomart.llm import negatives

KIND = "vec_id long, embedding array<float>, label int, row string, v int"


def plain(rows, every=100, positives=5, wanted=5, low=80, high=100, scale=256):
    good = [(i, [math.floor(scale * float(np.float32(x))) for x in e], y) for i, e, y in rows if y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = Counter()
    for a, (i, q, y) in enumerate(good):
        if i is None or i % every:
            continue
        scores = [(sum(p * r for p, r in zip(q, e, strict=False)), j, z) for b, (j, e, z) in enumerate(good) if b != a]
        for p, j, _ in sorted((s for s in scores if s[2] == y), key=order)[:positives]:
            window = sorted((s for s in scores if s[2] != y and low * p <= 100 * s[0] <= high * p), key=order)[:wanted]
            for k, (n, m, _) in enumerate(window):
                out[(i, j, k + 1, m, p, n)] += 1
    return out


def cases():
    g = np.random.default_rng(5)
    centres = g.normal(size=(12, 6))
    rows = [(k, [float(x) for x in centres[g.integers(12)] + 0.2 * g.normal(size=6)], int(g.integers(4))) for k in range(1, 1500)]
    copy = [0.5, -0.25, 1.0, 0.0, 0.25, 2.0]
    rows += [(k, copy, int(k % 3)) for k in range(2000, 2400)]  # more copies than a block holds
    nan, inf = float("nan"), float("inf")
    rows += [(100, [1.0, nan], 1), (200, [1.0, inf], 1), (300, None, 1), (400, copy, None), (500, [None, 1.0], 1), (600, [], 1), (None, copy, 1), (None, copy, 0), (700, [3.0], 2), (700, [3.0], 1), (700, [3.0], 2), (-100, copy, 3)]
    return rows


def test_equals_a_plain_search(spark):
    rows = cases()
    d = spark.createDataFrame([(*r, "clash", 1) for r in rows], KIND)
    want = plain(rows)
    assert want
    for options in ({}, {"block": 40, "fan": 4, "leaf": 5, "share": 3, "query_block": 4, "tasks": 8, "sample": 300}):
        got = negatives.hard_negatives(d, **options)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert Counter(map(tuple, got.collect())) == want
    assert Counter(map(tuple, negatives.hard_negatives(d, every=50, positives=2, negatives=3, low=50, high=90, block=100).collect())) == plain(rows, 50, 2, 3, 50, 90)


def test_few_rows(spark):
    d = spark.createDataFrame([(100, [1.0], 1, "", 0), (101, [], 1, "", 0), (102, [], 2, "", 0)], KIND)
    for rows in (d.limit(0), d.filter("vec_id = 100"), d.filter("vec_id > 100")):
        assert negatives.hard_negatives(rows).collect() == []
    assert [tuple(r) for r in negatives.hard_negatives(d).collect()] == [(100, 101, 1, 102, 0, 0)]
    empty = spark.createDataFrame([(100, [], 1, "", 0), (101, [], 1, "", 0), (102, [], 2, "", 0)], KIND)
    assert [tuple(r) for r in negatives.hard_negatives(empty).collect()] == [(100, 101, 1, 102, 0, 0)]


def test_tree_ranges_hold_and_subtrees_are_left_out():
    g = np.random.default_rng(1)
    v = (g.normal(size=(3000, 3)) * 50).astype(np.int64)
    radius2 = float((v**2).sum(1).max())
    z = negatives.lifted(v, radius2)
    t = negatives.grow(z, 8, 32, 1e-6)
    ends, first, split = t["ends"].reshape(-1, 2), t["first"], t["split"].reshape(-1, 8)
    low, high = t["low"].reshape(-1, 8, 8), t["high"].reshape(-1, 8, 8)
    z, ids = z[t["order"]], np.arange(3000)
    assert sorted(t["order"]) == list(range(3000)) and (np.diff(ends[first < 0]) <= 32).all()
    for node in np.flatnonzero(first >= 0):
        m = (split[node] >= 0).sum()
        assert sum(np.diff(ends[first[node] + j])[0] for j in range(m)) == np.diff(ends[node])[0]
        for j in range(m):
            gap = negatives.distances(z[split[node, :m]], z[slice(*ends[first[node] + j])])
            assert np.allclose(gap.min(1), low[node, :m, j], atol=1e-4) and np.allclose(gap.max(1), high[node, :m, j], atol=1e-4)
    block = {"row": ids, "id": ids, "label": ids % 2, "v": v[t["order"]].ravel(), **t}
    f = {"row": np.array([-1]), "label": np.array([0]), "v": np.array([40, -10, 25]), "a": np.array([0]), "least": np.array([5000]), "most": np.array([6000])}
    w, seen = negatives.Windows(f, 3, radius2, True, 5), []
    add = w.add
    w.add = lambda own, i, *rest: (seen.append(len(i)), add(own, i, *rest))
    negatives.search(block, w, np.array([0]), 8, 1e-3)
    scores = v[t["order"]] @ f["v"]
    ok = np.flatnonzero((scores >= 5000) & (scores <= 6000) & (ids % 2 == 0))
    best = ok[np.lexsort((ok, -scores[ok]))][:5]
    assert len(best) == 5 and w.id[0].tolist() == best.tolist() and w.score[0].tolist() == scores[best].tolist()
    assert sum(seen) < 1500
