"""Fail-closed scans, abstention, upserts, walk-forward models and books on small hand-made frames, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronomart.functions import features as fx
from chronomart.operators import books, metrics, selection, walk
from chronomart.plans import protocols, registry  # noqa: F401
from chronomart.sources import scans
from chronomart.sources.tables import upsert

SF = "/root/testdata/sf0.001"
HEAD = "symbol,timestamp,open,high,low,close,extra\n"
GOOD = "a,2024-03-01T00:00:00Z,1,2,0.5,1.5,x\n"


@pytest.mark.parametrize(
    "body", ["", "a,2024-03-01T00:00:00Z,1,0.9,0.5,1.5,x\n", GOOD + GOOD, "a,2024-03-01T00:00:00,1,2,0.5,1.5,x\n", "a,2024-03-01T00:00:00Z,0,2,0,1.5,x\n", "a,2024-03-01T00:00:00Z,nan,2,0.5,1.5,x\n", "a,2024-03-01T00:00:00Z,one,2,0.5,1.5,x\n"]
)
def test_bar_scan_fails_closed(spark, tmp_path, body):
    (tmp_path / "bad.csv").write_text(HEAD + body)
    with pytest.raises(ValueError):
        scans.scan_bars(spark, f"file://{tmp_path}/bad.csv")


def test_bar_scan_reads_what_is_good(spark, tmp_path):
    (tmp_path / "good.csv").write_text(HEAD + GOOD + "a,2024-02-29T23:55:00Z,1,2,0.5,1.5,x\n")
    assert sorted(r.t for r in scans.scan_bars(spark, f"file://{tmp_path}/good.csv").collect()) == [1709250900, 1709251200]
    (tmp_path / "short.csv").write_text("symbol,timestamp,open\na,2024-03-01T00:00:00Z,1\n")
    with pytest.raises(ValueError, match="no column"):
        scans.scan_bars(spark, f"file://{tmp_path}/short.csv")


def test_other_scans_fail_closed(spark, tmp_path):
    (tmp_path / "l.csv").write_text("series,known_at,observation_date,value\nx,2024-03-01T00:00:00Z,2024-02-01,NaN\n")
    with pytest.raises(ValueError, match="bad ledger row"):
        scans.scan_ledger(spark, f"file://{tmp_path}/l.csv", ["x"])
    with pytest.raises(ValueError, match="bad ledger row"):
        scans.scan_ledger(spark, f"file://{tmp_path}/l.csv", ["y"])
    (tmp_path / "m.json").write_text('{"rows": [{"decision_timestamp": "2024-03-01T00:00:00Z", "outcome": "LONG"}]}\n')
    with pytest.raises(ValueError, match="manifest row"):
        scans.scan_manifest(spark, f"file://{tmp_path}/m.json")
    spark.createDataFrame([("a", 0, 1), ("a", 2, 1), ("a", 3, 1)], "s string, t long, x int").write.parquet(f"file://{tmp_path}/g")
    for columns, message in ((["x"], "does not go by"), (["y"], "no column")):
        with pytest.raises(ValueError, match=message):
            scans.scan_grid(spark, f"file://{tmp_path}/g", columns, by="s", time="t", step=1)
    days = spark.createDataFrame([(1,), (2,)], "day int")
    with pytest.raises(ValueError, match="sealed"):
        scans.unsealed(days, "day", [2], days)


def test_release_times_follow_daylight_saving(spark):
    d = spark.createDataFrame([("f", 19793, 30600), ("f", 19788, 30600)], "family string, day long, clock long")  # 2024-03-11 and 2024-03-06, 08:30 in New York
    got = {r.known: r.known_at % 86400 for r in scans.release_calendar(d, "America/New_York", 2024, 2024).collect()}
    assert got == {19793: 12 * 3600 + 1800, 19788: 13 * 3600 + 1800}
    assert scans.release_calendar(d, "America/New_York", 2025, 2025).count() == 0


def test_what_is_not_finite_abstains(spark):
    nan = float("nan")
    rows = [(0.9, 0.1, nan, -1.0), (nan, 0.1, 5.0, -1.0), (0.9, nan, 5.0, nan), (None, 0.9, 1.0, 2.0), (0.9, 0.9, 1.0, 1.0), (0.9, 0.9, float("inf"), 1.0)]
    d = spark.createDataFrame(rows, "p double, q double, u double, v double")
    c = [F.col(x) for x in "pquv"]
    assert [r[0] for r in d.select(selection.probabilistic_action(*c, 0.55)).collect()] == [0, 0, 1, -1, 0, -1]
    assert [r[0] for r in d.select(selection.expected_value_side(*c)).collect()] == ["NO_TRADE", "NO_TRADE", "LONG", "SHORT", "SHORT", "SHORT"]
    gate = spark.createDataFrame([("a", nan, 0.9), ("a", 50.0, nan), ("a", 50.0, 0.9), ("a", None, 0.9)], "symbol string, pred double, vol_rank double")
    train = spark.createDataFrame([("a", 1.0)], "symbol string, pred double")
    assert walk.economic_gate(train, gate, 12.0).count() == 1
    assert walk.economic_gate(train, gate, None).count() == 0


def test_later_writes_win(spark):
    base = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0), (None, 1, 1.0)], "k string, t int, x double")
    new = spark.createDataFrame([("a", 1, float(x), x) for x in (3, 2, 5, 4)] + [(None, 1, 9.0, 1), ("c", 1, None, 1)], "k string, t int, x double, seq int").repartition(4)
    got = {r.k: r.x for r in upsert(base, new, ["k", "t"], "seq").collect()}
    assert got == {"a": 5.0, "b": 1.0, None: 9.0, "c": None}


def test_walk_forward_equals_refitting_from_scratch(spark):
    g = np.random.default_rng(2)
    rows = [("a" if k % 3 else "b", k, *map(float, g.normal(size=2))) for k in range(400)]
    rows = [(*r, 2 * r[2] - r[3] + float(g.normal()) if k < 390 else None) for k, r in enumerate(rows)]
    d = spark.createDataFrame(rows, "symbol string, t long, x double, z double, y double")
    got = {(r.symbol, r.t): (r.p_y, r.train) for r in walk.walk_forward(d, ["x", "z"], ["y"], gap=5, every=40, least=30, ridge=3.0).collect()}
    for symbol in "ab":
        own = [r for r in rows if r[0] == symbol]
        for k, r in enumerate(own):
            if k < 30:
                assert (symbol, r[1]) not in got
                continue
            at = 30 + (k - 30) // 40 * 40
            train = np.array([q[2:] for i, q in enumerate(own) if i + 5 <= at and q[4] is not None])
            x, y = train[:, :2], train[:, 2]
            m, s = x.mean(0), x.std(0)
            w = np.linalg.solve(((x - m) / s).T @ ((x - m) / s) + 3 * np.eye(2), ((x - m) / s).T @ (y - y.mean()))
            want = y.mean() + (np.array(r[2:4]) - m) / s @ w
            assert got[symbol, r[1]][1] == len(train) and abs(got[symbol, r[1]][0] - want) < 1e-8


def test_inner_alpha_is_the_best_on_the_last_fifth(spark):
    g = np.random.default_rng(3)
    rows = [("a", k, float(x), float(0.1 * x + g.normal())) for k, x in enumerate(g.normal(size=200))] + [("b", k, 1.0, 1.0) for k in range(5)]
    got = walk.inner_alpha(spark.createDataFrame(rows, "symbol string, t long, x double, y double"), ["x"], "y", [0.1, 10.0, 1000.0]).collect()
    a = np.array([r[2:] for r in rows if r[0] == "a"])
    x, y, m, s = a[:160, 0], a[:160, 1], a[:160, 0].mean(), a[:160, 0].std()
    late = a[160:]
    for r in got:
        if r.symbol == "a":
            w = ((x - m) / s) @ (y - y.mean()) / (160 + r.alpha)
            e = late[:, 1] - (y.mean() + (late[:, 0] - m) / s * w)
            assert abs(r.r2 - (1 - (e**2).sum() / ((late[:, 1] - late[:, 1].mean()) ** 2).sum())) < 1e-9
    best = max((r for r in got if r.symbol == "a"), key=lambda r: r.r2)
    assert [r.alpha for r in got if r.symbol == "a" and r.chosen] == [best.alpha] and [(r.alpha, r.r2) for r in got if r.symbol == "b"] == [(10.0, None)]


def test_nested_days_choose_on_the_day_before(spark):
    g = np.random.default_rng(4)
    rows = [("a", k // 20, (k + 3) // 20, float(x), float(x + g.normal())) for k, x in enumerate(g.normal(size=120))]
    d = spark.createDataFrame(rows, "symbol string, day long, label_end_day long, x double, y double")
    got = {r.day: r for r in walk.nested_days(d, ["x"], "y", [0.1, 100.0]).collect()}
    assert sorted(got) == [3, 4, 5]

    def fit(before, alpha):
        t = np.array([r[3:] for r in rows if r[2] < before])
        m, s = t[:, 0].mean(), t[:, 0].std()
        w = ((t[:, 0] - m) / s) @ (t[:, 1] - t[:, 1].mean()) / (len(t) + alpha)
        return lambda q: ((q[:, 1] - t[:, 1].mean() - (q[:, 0] - m) / s * w) ** 2).mean()

    for day, r in got.items():
        on = lambda k: np.array([q[3:] for q in rows if q[1] == k])
        alpha = min([0.1, 100.0], key=lambda a: fit(day - 1, a)(on(day - 1)))
        assert r.alpha == alpha and r.train_rows == sum(q[2] < day for q in rows) and abs(r.mse - fit(day, alpha)(on(day))) < 1e-9


def test_fitted_models_learn(spark):
    g = np.random.default_rng(5)
    rows = [("a", k, float(x), float(z), float(3 * x + 0.1 * g.normal()), int(x + 0.3 * g.normal() > 0), float(x)) for k, (x, z) in enumerate(g.normal(size=(600, 2)))]
    d = spark.createDataFrame(rows, "symbol string, t long, x double, z double, y double, win int, net double")
    out = walk.calibrated_side(d.filter("t < 300"), d.filter("t >= 300 and t < 450"), d.filter("t >= 450"), ["x", "z"], "win", "net").collect()
    p, y = np.array([q.p for q in out]), np.array([q.win for q in out])
    assert ((p - y) ** 2).mean() < 0.1 and p[y == 1].mean() > p[y == 0].mean() + 0.5
    cal = [q for q in rows if 300 <= q[1] < 450]
    gain, loss = np.mean([q[6] for q in cal if q[5]]), np.mean([q[6] for q in cal if not q[5]])
    assert np.allclose([q.utility for q in out], p * gain + (1 - p) * loss)


def test_books_follow_snapshots_and_latch(spark):
    rows = [
        ("a", 5, 0, False, "bid", 9.0, 1.0),  # before any snapshot: no book
        ("a", 10, 1, True, "bid", 10.0, 2.0), ("a", 10, 2, False, "ask", 12.0, 3.0),
        ("a", 20, 3, False, "bid", 11.0, 1.0), ("a", 30, 4, False, "bid", 13.0, 1.0), ("a", 40, 5, False, "bid", 13.0, 0.0),
        ("a", 50, 6, True, "bid", 8.0, 1.0), ("a", 50, 7, True, "ask", 9.0, 1.0), ("a", 60, 8, False, "ask", 9.0, 4.0),
    ]
    u = spark.createDataFrame(rows, "symbol string, us long, seq long, snapshot boolean, side string, level double, amount double")
    state, blocks = books.books(u, 25)
    state = books.latched(state)
    got = {r.us: (r.valid, [tuple(x) for x in r.bids], [tuple(x) for x in r.asks]) for r in state.filter("not carried").collect()}
    assert got[10] == (True, [(10.0, 2.0)], [(12.0, 3.0)]) and got[20][1] == [(11.0, 1.0), (10.0, 2.0)]
    assert not got[30][0] and got[40] == (False, [(11.0, 1.0), (10.0, 2.0)], [(12.0, 3.0)])  # crossed once: not valid until a snapshot
    assert got[50] == (True, [(8.0, 1.0)], [(9.0, 1.0)]) and 5 not in got
    flow = {r.slot: r for r in books.order_flow(state, books.slots_of(blocks, 25, 25), 25).collect()}
    assert flow[25].ofi1 == 1.0 and flow[75].ofi1 == -3.0 and flow[75].ask_replenished == 3.0
    assert flow[50].ofi1 == 0.0  # the snapshot clears what its slot summed before


def test_local_rate_without_pairs(spark):
    g = np.random.default_rng(6)
    v, q = np.round(g.random(500), 2), np.round(g.random(80), 2)
    hit = g.integers(0, 2, 500)
    d = spark.createDataFrame([(float(x),) for x in q], "confidence double")
    val = spark.createDataFrame([(float(x), int(h)) for x, h in zip(v, hit, strict=True)], "confidence double, hit int")
    got = {r.confidence: r.calibrated for r in metrics.local_calibration(d, val, lo=0.0, hi=1.0).collect()}
    for x in q:
        near = hit[(v >= x - 0.05) & (v <= x + 0.05)]
        assert abs(got[float(x)] - (near.mean() if len(near) >= 15 else x)) < 1e-12


def test_exponential_over_gaps_and_blocks(spark):
    t = [0, 1, 2, 50, 51, 52, 53, 400, 401]
    x = [float(v) for v in (3, 1, 4, 1, 5, 9, 2, 6, 5)]
    d = spark.createDataFrame([("a", a * 10, v) for a, v in zip(t, x, strict=True)], "symbol string, t long, x double")
    got = [r.y for r in fx.exponential(d, "x", 0.3, "y", block=4, step=10).orderBy("t").collect()]
    want = [x[0]]
    for v in x[1:]:
        want.append(0.3 * v + 0.7 * want[-1])
    assert np.allclose(got, want)


def test_model_queries_run(spark):
    for name in ("m1_walk_forward", "m2_four_heads"):
        rows = registry.QUERIES[name](spark, SF).collect()
        assert rows and {r.action for r in rows} <= {"LONG", "SHORT", "NO_TRADE"} and all(r.train > 0 for r in rows)
