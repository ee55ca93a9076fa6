"""Fixed figures of small frames for audits, queues, venues, selection and sinks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronomart.operators import audits, queue, selection, venues
from chronomart.sources import feeds

ORDER = "symbol string, slot long, decision_us long, sign int, limit double, queue double, drift double"
EVENT = ORDER + ", us long, tick_id long, qty double, kind string"


def filled(spark, queue_ahead, trades, **more):
    o = ("a", 1, 0, 1, 5.0, queue_ahead, 0.0)
    e = [(*o, us, k, float(q), kind) for k, (us, q, kind) in enumerate(trades)]
    args = {"size": 1.0, "latency_us": 250_000, "timeout_us": 1_000_000, "credit": 1.0} | more
    return queue.replay(spark.createDataFrame([o], ORDER), spark.createDataFrame(e, EVENT), **args).first()


def test_queue_replay(spark):
    late = filled(spark, 0.0, [(300_000, 0.25, "trade"), (500_000, 0.25, "trade"), (800_000, 1, "trade")])
    assert (late.filled, late.first_fill_us, late.status) == (0.5, 300_000, "partial")
    assert filled(spark, 5.0, [(300_000, 5, "trade")]).status == "miss"
    assert filled(spark, 5.0, [(300_000, 7, "trade")]).filled == 1.0
    assert filled(spark, 5.0, [(200_000, 9, "trade")]).status == "miss"  # before arrival
    both = [(300_000, 4, "cancel"), (300_000, 1.5, "trade"), (400_000, 0.25, "trade")]
    assert filled(spark, 5.0, both).filled == 0.25 and filled(spark, 5.0, both, credit=0.0).filled == 0.0
    assert filled(spark, 0.0, []).filled == 0.0


def test_sequence_gap_lasts_until_the_next_snapshot(spark):
    rows = [(1, 1, 9, 0, None), (2, 0, 0, 0, 15), (3, 5, 10, 4, None), (4, 11, 20, 10, None), (5, 21, 30, 20, None), (6, 32, 40, 31, None), (7, 41, 50, 40, None), (8, 0, 0, 0, 55), (9, 60, 70, 59, None)]
    d = spark.createDataFrame([("a", *r) for r in rows], "symbol string, pos long, first long, last long, previous long, snapshot_id long")
    got = [r.state for r in audits.sequence_state(d).orderBy("pos").collect()]
    assert got == ["invalid", "snapshot", "stale", "bridge", "valid", "gap", "invalid", "snapshot", "gap"]


def test_interior_miss_fails_and_edges_are_trimmed(spark):
    grid = spark.createDataFrame([("a", 59), ("a", 179)], "symbol string, t long")
    s = lambda *opens: spark.createDataFrame([("a", o) for o in opens], "symbol string, open long")
    assert [r.open for r in venues.aligned(s(-60, 0, 120, 180), grid, 59).orderBy("open").collect()] == [0, 120]
    with pytest.raises(ValueError):
        venues.aligned(s(0, 60, 120), grid, 59)


def test_repeated_manifest_keys_fail(spark):
    m = spark.createDataFrame([("a", 1, 1), ("a", 1, 1)], "k string, n long, checksum long")
    with pytest.raises(ValueError):
        audits.verify_manifest(m, m, ["k"])


def test_near_best_depends_on_order(spark):
    d = spark.createDataFrame([("a", 1, 100.0, 5), ("a", 2, 100.5, 4), ("a", 3, 100.9, 6), ("a", 4, 101.5, 1)], "k string, o int, s double, n long")
    assert selection.first_of_near_best(d, ["k"], ["o"], "s", "n").first().o == 3


def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3)) * [1, 5, 0.2] + [0, 2, 1]
    y = x @ [1.0, -0.5, 3.0] + rng.normal(size=200)
    d = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    z = (x - x.mean(0)) / x.std(0)
    for alpha in (0.1, 10.0):
        want = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y - y.mean()))
        got = {r.feature: r.weight for r in selection.ridge(d, ["a", "b", "c"], "y", [alpha]).collect()}
        assert np.allclose([got[k] for k in "abc"], want, atol=1e-6)
    assert selection.ridge(d.limit(0), ["a"], "y", [1.0]).count() == 0


def test_sealed_days():
    assert feeds.require_unsealed(["2024-01-01"], ["2024-02-01"], ["2024-01-01"])
    for day in ("2024-02-01", "2024-03-01"):
        with pytest.raises(ValueError):
            feeds.require_unsealed([day], ["2024-02-01"], ["2024-02-01"])


def test_malformed_trades_fail(spark):
    d = spark.createDataFrame([("a", 1, "7", "hold", 1.0, 1.0)], "symbol string, us long, id string, side string, price double, qty double")
    with pytest.raises(Exception):
        venues.trades_once(d, ["symbol"], ["us"], "id").collect()


def test_csv_sink_flattens_structs(spark, tmp_path):
    d = spark.range(1).select(F.lit("a").alias("k"), F.struct(F.lit(1).alias("x"), F.lit(2).alias("y")).alias("v"), F.lit(float("inf")).alias("factor"))
    feeds.write_results(d, f"file://{tmp_path}/out", ["k"], kind="csv")
    r = spark.read.option("header", True).csv(f"file://{tmp_path}/out").first()
    assert (r.v_x, r.v_y, r.factor, r.k) == ("1", "2", "inf", "a")


def test_policy_metrics_figures(spark):
    """Ties, a miss, an order without side features and policies that take nothing or fill nothing."""
    day, hour = 86_400_000_000, 3_600_000_000
    rows = [
        ("a", 0, 1, "filled", 2.0, hour, 10.0, False), ("a", hour, -1, "partial", 4.0, 2 * hour, -4.0, True), ("a", day, 1, "miss", 6.0, None, None, None),
        ("b", 0, 1, "filled", None, hour, 10.0, False),
    ]
    d = spark.createDataFrame(rows, "symbol string, decision_us long, sign int, status string, queue double, first_fill_us long, gross double, adverse boolean")
    p = {"all": F.lit(True), "none": F.lit(False), "unfilled": F.col("status") == "miss"}
    m = {(r.policy, r.sign): r for r in queue.policy_metrics(d, p, cost=2.0, stress=12.0).collect()}
    assert set(m) == {("all", None), ("all", 1), ("all", -1), ("unfilled", None), ("unfilled", 1)}
    r = m["all", None]
    assert (r.n, r.filled_orders, r.full_fills, r.partial_fills, r.fill_rate, r.timeout_rate, r.cancel_rate) == (4, 3, 2, 1, 0.75, 0.25, 0.5)
    assert (r.total_gross, r.total_net, r.total_stress, r.total_fees, r.worst_net) == (16.0, 10.0, -20.0, 6.0, -6.0)
    assert (r.days, r.positive_days, r.day_concentration, r.hours, r.positive_hours, r.hour_concentration) == (2, 0.5, 1.0, 2, 0.5, 1.0)
    assert (r.drawdown, r.total_over_drawdown, r.fills_a_day, r.queue_p50, r.wait_p99) == (6.0, 10 / 6, 1.5, 4.0, float(hour))
    assert r.profit_factor == 16 / 6 and abs(r.net_p05 - (-6 + 0.1 * 14)) < 1e-9 and r.adverse_rate == 1 / 3
    assert (m["all", 1].profit_factor, m["all", 1].total_over_drawdown, m["all", -1].profit_factor) == (float("inf"), float("inf"), 0.0)
    none = m["unfilled", None]
    assert (none.filled_orders, none.total_net, none.drawdown, none.hours, none.hour_concentration, none.wait_p50, none.net_p01) == (0, 0.0, 0.0, 0, 1.0, None, None)
    deltas = {(r.policy, r.sign): r for r in queue.policy_deltas(queue.policy_metrics(d, p, cost=2.0, stress=12.0), "all").collect()}
    assert deltas["unfilled", None].fees_saved == 6.0 and deltas["unfilled", 1].filled_orders_delta == -2 and deltas["unfilled", 1].mean_net_delta is None
    assert queue.policy_metrics(d.limit(0), p, cost=2.0, stress=12.0).count() == 0
