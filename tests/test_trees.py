"""Boosted trees against a plain version in numpy, the parts of each model, and calibrated gates."""

import numpy as np
from pyspark.sql import functions as F

from chronomart.operators import trees
from chronomart.plans import protocols, registry

SF = "/root/testdata/sf0.001"


def plain(bins, y, part, head, n, depth, least):
    """Scores of all rows by the same boosting on arrays."""
    f, fit = np.zeros(len(y)), (part == 0) & ~np.isnan(y)
    for _ in range(n):
        p = 1 / (1 + np.exp(-f))
        g, h = (p - y, p * (1 - p)) if head.loss == "logistic" else (f - y, np.ones(len(y)))
        node = np.zeros(len(y), int)
        for _ in range(depth):
            go = np.zeros(len(y), int)
            for k in np.unique(node[fit]):
                own = fit & (node == k)
                best = (0.0, 0, 0)
                for c in range(bins.shape[1]):
                    for b in np.unique(bins[own, c]):
                        left = own & (bins[:, c] <= b)
                        gl, hl, gs, hs = g[left].sum(), h[left].sum(), g[own].sum(), h[own].sum()
                        if hl >= least and hs - hl >= least:
                            gain = round(gl**2 / (hl + head.ridge) + (gs - gl) ** 2 / (hs - hl + head.ridge) - gs**2 / (hs + head.ridge), 9)
                            if (gain, -c, -b) > (best[0], -best[1], -best[2]) and gain > 0:
                                best = (gain, c, b)
                if best[0] > 0:
                    go[node == k] = bins[node == k, best[1]] > best[2]
            node = 2 * node + go
        for k in np.unique(node[fit]):
            own = fit & (node == k)
            f[node == k] -= head.rate * g[own].sum() / (h[own].sum() + head.ridge)
    return f


def test_boosting_equals_a_plain_version(spark):
    g = np.random.default_rng(1)
    n = 240
    x = g.normal(size=(n, 3))
    y = np.sin(2 * x[:, 0]) + (x[:, 1] > 0) * x[:, 2] + 0.1 * g.normal(size=n)
    rows = [(str(k % 2), k % 3, k, *map(float, x[k]), float(y[k]) if k % 17 else None, float(y[k] > 0), k % 4 if k % 4 < 3 else 0) for k in range(n)]
    d = spark.createDataFrame(rows, "symbol string, refit int, t long, a double, b double, c double, y double, up double, part int")
    cuts = trees.edges(d, ["a", "b", "c"], 8, ["symbol"])
    heads = {"y": trees.Head("y", rate=0.3), "up": trees.Head("up", "logistic", 0.5, 2.0)}
    state = trees.with_heads(d.join(cuts, "symbol").withColumn("bins", trees.binned(["a", "b", "c"])).drop("edges"), heads)
    scored, splits = trees.boost(state, heads, trees=3, depth=2, least=2.0)
    got = scored.collect()
    for name, head in heads.items():
        for key in {(r.symbol, r.refit) for r in got}:
            own = sorted((r for r in got if (r.symbol, r.refit, r.head) == (*key, name)), key=lambda r: r.t)
            want = plain(np.array([r.bins for r in own]), np.array([np.nan if r.y is None else r.y for r in own]), np.array([r.part for r in own]), head, 3, 2, 2.0)
            assert np.allclose([r.f for r in own], want, atol=1e-9)
            edge = [np.quantile(x[[k for k in range(n) if str(k % 2) == key[0]], i], np.arange(1, 8) / 8) for i in range(3)]
            assert all(r.bins == [int((e < v).sum()) for e, v in zip(edge, x[r.t], strict=True)] for r in own)
    assert splits.filter("gain <= 0").count() == 0 and splits.select("tree").distinct().count() == 3
    total = trees.importances(splits, ["a", "b", "c"], ("symbol", "head")).groupBy("symbol", "head").agg(F.sum("importance").alias("s")).collect()
    assert len(total) == 4 and all(abs(r.s - 1) < 1e-9 for r in total)


def test_models_know_only_what_has_ended(spark):
    rows = [("a", k, float(k % 7), float(k) if k < 95 and k != 20 else None) for k in range(100)] + [("b", k, 1.0, 1.0) for k in range(5)]
    d = spark.createDataFrame(rows, "symbol string, t long, x double, y double")
    got = trees.expanding(d, ["x"], ["y"], gap=4, every=25, least=30).collect()
    for r in (0, 1, 2):
        at = 30 + 25 * r
        known = [k for k in range(100) if k + 4 <= at and rows[k][3] is not None]
        split = min(max(30, int(len(known) * 0.8)), len(known) - 1)
        part = lambda p: sorted(q.t for q in got if q.refit == r and q.part == p)
        assert part(0) == known[:split] and part(1) == known[split:] and part(2) == list(range(at, min(at + 25, 100)))
        assert {q.train for q in got if q.refit == r} == {len(known)}
    assert {q.symbol for q in got} == {"a"}


def test_boosted_queries_gate_on_what_validation_bears_out(spark):
    rows = registry.QUERIES["m1_boosted"](spark, SF).collect()
    assert rows and {r.action for r in rows} <= {"LONG", "SHORT", "NO_TRADE"}
    for r in rows:
        assert (r.action == "NO_TRADE") == (r.calibrated < 0.55) and (r.calibrated == max(r.p, 1 - r.p) or 0.5 <= r.calibrated <= 0.99 or abs(r.calibrated - max(r.p, 1 - r.p)) < 1e-5)
    d = protocols.feat(spark, SF).withColumn("up", (F.col("y") > 0).cast("double"))
    state = trees.expanding(d, protocols.FEATURES, ["up"], gap=3, every=100, least=60).collect()
    key = (rows[0].symbol, rows[0].refit)
    own = sorted((r for r in state if (r.symbol, r.refit) == key), key=lambda r: (r.part, r.t))
    f = plain(np.array([r.bins for r in own]), np.array([np.nan if r.up is None else r.up for r in own]), np.array([r.part for r in own]), protocols.UP, 6, 3, 5.0)
    p = {r.t: 1 / (1 + np.exp(-v)) for r, v in zip(own, f, strict=True) if r.part == 2}
    assert all(abs(p[r.t] - r.p) < 1e-5 for r in rows if (r.symbol, r.refit) == key)
    check = [(max(q, 1 - q), int((q >= 0.5) == (r.up == 1))) for r, v in zip(own, f, strict=True) if r.part == 1 for q in [1 / (1 + np.exp(-v))]]
    for r in rows:
        if (r.symbol, r.refit) == key:
            c = max(p[r.t], 1 - p[r.t])
            near = [h for x, h in check if c - 0.05 <= x <= c + 0.05]
            assert abs(r.calibrated - (min(max(np.mean(near), 0.5), 0.99) if len(near) >= 15 else c)) < 1e-5


def test_pooled_settings_and_importances(spark):
    rows = registry.QUERIES["m6_boosted_trees"](spark, SF).collect()
    state, splits = protocols.pooled(spark, SF)
    own = state.collect()
    mse = {h: round(np.mean([(r.y - r.f) ** 2 for r in own if r.head == h and r.part == 1]), 9) for h in protocols.GRID}
    best = min(mse, key=lambda h: (mse[h], h))
    assert {r.head for r in rows} == {best} and len(rows) == sum(r.part == 2 and r.head == best for r in own)
    one = sorted((r for r in own if r.head == best), key=lambda r: (r.of, r.t))
    want = plain(np.array([r.bins for r in one]), np.array([r.y for r in one]), np.array([r.part for r in one]), protocols.GRID[best], 6, 3, 5.0)
    assert np.allclose([r.f for r in one], want, atol=1e-6)
    gains = {}
    for r in splits.filter("head = 'slow'").collect():
        gains[protocols.FEATURES[r.feature]] = gains.get(protocols.FEATURES[r.feature], 0) + r.gain
    got = registry.QUERIES["k7_importances"](spark, SF).collect()
    assert [r.feature for r in got] == sorted(gains, key=lambda k: -gains[k]) and abs(sum(r.importance for r in got) - 1) < 1e-5
