"""Gates and ladders, placebos against a plain model, and both calibrated sides against plain logistic regressions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronomart.operators import verdicts
from chronomart.plans import protocols, registry
from test_contracts import plain_net

SF = "/root/testdata/sf0.001"


def auc(p, y):
    a, b = p[y == 1], p[y == 0]
    return ((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b))


def test_controls_equal_a_loop(spark):
    rows = [(s, k, float(k * k % 17)) for s in "ab" for k in range(40)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "s string, t long, x double, permuted string").drop("permuted")
    one, two = (sorted(map(tuple, verdicts.controls(d, ["s"], "t", "x", 3, 2, 5, block).collect())) for block in (None, 7))
    assert one == two and len(one) == 80
    for s, t, x, permuted, flipped, lagged, leaked in one:
        own = {k: v for q, k, v in rows if q == s}
        assert (x, flipped, lagged, leaked) == (own[t], -own[t], own.get(t - 3), own.get(t + 2))
    assert sorted(r[3] for r in one if r[0] == "a") == sorted(r[2] for r in one if r[0] == "a") and [r[3] for r in one] != [r[2] for r in one]


def test_a_leak_is_seen_and_placebos_fail(spark):
    g = np.random.default_rng(1)
    n = 900
    signal, noise, ahead = g.normal(size=n), g.normal(size=n), g.normal(size=n)
    y = 6 * signal + 12 * np.roll(ahead, -2) + 8 * g.normal(size=n)
    rows = [("a", k, float(signal[k]), float(noise[k]), float(y[k])) for k in range(n)]
    d = spark.createDataFrame(rows, "s string, t long, x double, z double, y double")
    made = verdicts.controls(d, ["s"], "t", "x", 3, 1, 5, 100).withColumn("leaked", F.when(F.col("t") < n - 5, F.col("y") + 5 * F.col("z"))).withColumn("up", (F.col("y") > 0).cast("int"))
    found = verdicts.diagnostics(made, ["z"], "x", "y", "up", 600)
    got = {r.kind: r for r in found.collect()}
    data = {r.t: r for r in made.collect()}
    for kind in verdicts.KINDS:
        pick = lambda r, train: {"primary": r.x, "leaked": r.x, "permuted": r.permuted, "lagged": r.lagged, "flipped": r.x if train else -r.x}[kind]
        use = [r for _, r in sorted(data.items()) if pick(r, True) is not None and not (kind == "leaked" and r.leaked is None)]
        row = lambda r, train: [r.z, pick(r, train), r.leaked if kind == "leaked" else 0.0]
        x, t = (np.array([row(r, r.t < 600) for r in use if (r.t < 600) == train]) for train in (True, False))
        yt, ys = (np.array([r.y for r in use if (r.t < 600) == train]) for train in (True, False))
        w = plain_net(x, yt, 5e-4, 0.25)
        p = w[0] + t @ w[1:]
        assert got[kind].n == len(ys) and abs(got[kind].auc - auc(p, ys > 0)) < 1e-6 and abs(got[kind].mean_net - (np.sign(p) * ys).mean()) < 1e-6
        assert abs(got[kind].gain - (got[kind].auc - got["primary"].auc)) < 1e-12
    r = verdicts.suite(found, (F.col("auc") >= 0.55) & (F.col("mean_net") > 1)).first()
    assert r.leak_is_seen and r.permuted_fails and r.flipped_fails and r.lagged_fails and r.suite_passes and r.final
    r = verdicts.suite(found.filter("kind <> 'leaked'"), F.col("auc") >= 0.4).first()
    assert not r.leak_is_seen and not r.permuted_fails and not r.suite_passes and not r.final


def test_diagnostic_queries(spark):
    rows = registry.QUERIES["m13_diagnostics"](spark, SF).collect()
    assert {r.kind for r in rows} == set(verdicts.KINDS)
    d = protocols.feat(spark, SF).select("symbol", "t", "r", "r3", "v6", "y")
    made = verdicts.controls(d, ["symbol"], "t", "r", 1, 2, 7, None).dropna(subset=["r3", "v6", "y", "r"]).collect()
    train, test = ([r for r in made if (r.t < protocols.CUT) == k] for k in (True, False))
    x = lambda q: np.array([[r.r3, r.v6, r.r] for r in q])
    w = plain_net(x(train), np.array([r.y for r in train]), 5e-4, 0.25)
    p, y = w[0] + x(test) @ w[1:], np.array([r.y for r in test])
    got = next(r for r in rows if r.kind == "primary")
    assert got.n == len(test) and abs(got.auc - auc(p, y > 0)) < 1e-5
    r = registry.QUERIES["m13_verdict"](spark, SF).first()
    assert r.leak_is_seen == any(q.kind == "leaked" and q.gain >= 0.02 for q in rows)


@pytest.mark.parametrize(
    ("statuses", "want"),
    [
        (["PROMOTED", "PROMOTED"], "PASS"), (["PROMOTED", "REJECTED"], "PARTIAL_PASS"), (["PENDING_COST", "REJECTED"], "PENDING_COST_MODEL"), (["REJECTED", "INCONCLUSIVE"], "PARTIAL_INCONCLUSIVE"),
        (["REJECTED", "UNAVAILABLE"], "FAIL"), (["INCONCLUSIVE", "UNAVAILABLE"], "INCONCLUSIVE"), (["PROMOTED", "INCONCLUSIVE"], "PASS"), ([], "INCONCLUSIVE"),
    ],
)
def test_decisions(spark, statuses, want):
    assert verdicts.decision(spark.createDataFrame([(s,) for s in statuses], "status string")).first().promotion == want


def test_ladder_and_gates(spark):
    rows = [("a", 5, True, True, 8.0), ("b", 5, True, True, None), ("c", 3, True, True, 8.0), ("d", None, True, True, 8.0), ("e", 5, None, True, 8.0), ("f", 5, True, None, 8.0), ("g", 5, False, True, None)]
    got = {r.symbol: r.status for r in verdicts.ladder(spark.createDataFrame(rows, "symbol string, folds long, signal boolean, economic boolean, cost double"), 5).collect()}
    assert got == {"a": "PROMOTED", "b": "PENDING_COST", "c": "INCONCLUSIVE", "d": "UNAVAILABLE", "e": "REJECTED", "f": "REJECTED", "g": "REJECTED"}
    good = [("a", k * 7200, k % 5, 14.0 + k % 3, "LONG") for k in range(150)]
    d = spark.createDataFrame([*good, ("b", 5, None, 9.0, "LONG"), ("c", 5, 0, None, "LONG")], "symbol string, t long, fold long, gross double, side string")
    got = {(r.symbol, r.gate): (r.passed, r.all_passed) for r in verdicts.judged(verdicts.pooled(d, ["symbol"]), ["symbol"], verdicts.structural()).collect()}
    assert all(v == (True, True) for (s, _), v in got.items() if s == "a") and len(got) == 24
    assert got["b", "all_folds"] == (False, False) and got["b", "fold_floor"][0] is False and got["b", "stress_total"][0] is False


def newton(x, y, weight, penalty):
    """Logistic regression with a free intercept: weights that minimise the weighted mean loss + penalty |w|^2 / 2."""
    z, b = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    pen = np.diag([0.0, *[penalty] * x.shape[1]])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z / weight.sum() + pen, z.T @ (weight * (p - y)) / weight.sum() + pen @ b)
    return b


def test_both_sides_equal_plain_regressions(spark):
    got = registry.QUERIES["m8_both_sides"](spark, SF).collect()
    d = protocols.feat(spark, SF).filter(protocols.LABELLED).collect()
    a, b, gap = protocols.CUT - 8 * 86400, protocols.CUT - 4 * 86400, 3 * 3600
    part = lambda lo, hi: [r for r in d if lo <= r.t < hi]
    train, cal, sel, rows = part(0, a - gap), part(a, b - gap), part(b, protocols.CUT - gap), part(protocols.CUT, 1 << 60)
    x = lambda q: np.array([[r[c] for c in protocols.FEATURES] for r in q])
    m, s = x(train).mean(0), x(train).std(0, ddof=1)

    def side(q, sign, c):
        y, yc = (np.array([sign * r.y > 2 for r in k], float) for k in (train, cal))
        n, pos = len(y), y.sum()
        w = newton((x(train) - m) / s, y, np.where(y == 1, n / (2 * pos), n / (2 * (n - pos))), 1 / (c * n))
        logit = lambda k: w[0] + (x(k) - m) / s @ w[1:]
        v = newton(logit(cal)[:, None], yc, np.ones(len(yc)), 0.0)
        net = np.array([sign * r.y - 2 for r in cal])
        p = 1 / (1 + np.exp(-(v[0] + v[1] * logit(q))))
        return p, p * net[yc == 1].mean() + (1 - p) * net[yc == 0].mean()

    def act(q, c):
        (p, u), (r, v) = side(q, 1, c), side(q, -1, c)
        long, short = (p >= 0.55) & (u > 0), (r >= 0.55) & (v > 0)
        return np.where(long & short, np.sign(u - v), long.astype(int) - short.astype(int)), p, r, u, v

    total = {c: sum(k * r.y - 2 * abs(k) for k, r in zip(act(sel, c)[0], sel, strict=True)) for c in (0.1, 1.0)}
    best = 1.0 if total[1.0] > total[0.1] + 1e-9 else 0.1
    action, p, r, u, v = act(rows, best)
    want = {(q.symbol, q.t): (p[k], r[k], u[k], v[k], action[k]) for k, q in enumerate(rows)}
    assert len(got) == len(want) and {q.c for q in got} == {best}
    for q in got:
        w = want[q.symbol, q.t]
        assert np.allclose((q.p_long, q.p_short), w[:2], atol=2e-4) and np.allclose((q.utility_long, q.utility_short), w[2:4], rtol=1e-2, atol=0.5) and q.action == w[4]
