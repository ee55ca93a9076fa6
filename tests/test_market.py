"""Every registered market query against DuckDB on the small tables, causality, and the fixed figures of small hand-made frames."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from chronomart.functions import features as fx
from chronomart.operators import joins, labels, metrics
from chronomart.operators import quality as qa
from chronomart.plans import feeds, market, protocols, registry, research  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    answer = duck.execute(registry.SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in answer.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", ["w1_rolling_vol", "w3_ema", "w4_rsi", "w8_percentile_rank", "f9_momentum", "w11_sigma_before"])
def test_future_does_not_change_the_past(spark, monkeypatch, name):
    cut = 1704900000
    whole = registry.QUERIES[name](spark, SF).filter(F.col("t") < cut).collect()
    before = market.hourly
    monkeypatch.setattr(market, "hourly", lambda s, d: before(s, d).withColumn("close", F.when(F.col("t") >= cut, F.col("close") * 3).otherwise(F.col("close"))))
    changed = registry.QUERIES[name](spark, SF).filter(F.col("t") < cut).collect()
    assert sorted(map(str, whole)) == sorted(map(str, changed)) and whole


def test_metrics_figures(spark):
    d = spark.createDataFrame([("a", 18.0, 1), ("a", -12.0, 2)], "k string, net double, t long")
    r = metrics.trade_metrics(d, ["k"]).first()
    assert (r.trades, r.win_rate, r.profit_factor, r.expectancy) == (2, 0.5, 1.5, 3.0)
    e = spark.createDataFrame([("a", float(x), k) for k, x in enumerate((5, -2, -4, 3))], "k string, net double, t long")
    assert metrics.drawdowns(e, "k", ["t"]).first().additive_dd == 6
    wins = spark.createDataFrame([("a", 5.0, 0), ("a", 2.0, 1)], "k string, net double, t long")
    assert metrics.drawdowns(wins, "k", ["t"]).first().earlier_peak_dd < 0


def test_non_overlap_figures(spark):
    d = spark.createDataFrame([("a", 0, 30), ("a", 5, 20), ("a", 30, 60)], "k string, s long, e long")
    assert [r.s for r in labels.non_overlapping(d, "k", "s", "e").orderBy("s").collect()] == [0, 30]
    assert [r.s for r in labels.non_overlapping(d, "k", "s", "e", strict=True).orderBy("s").collect()] == [0]


def test_barrier_touches_both_stops_first(spark):
    bars = spark.createDataFrame([("a", 0, 100.0, 100.0, 100.0, 100.0), ("a", 1, 100.0, 100.3, 99.8, 100.0)], "symbol string, t long, open double, high double, low double, close double")
    r = labels.barrier_labels(bars, 1, 20.0, 10.0, 2.0).first()
    assert (r.reason, r.gross_bps, r.net_bps) == ("AMBIGUOUS_BAR_STOP_FIRST", -10.0, -12.0)


def test_asof_takes_equal_times_and_respects_age(spark):
    left = spark.createDataFrame([("a", 10), ("a", 19), ("a", 30), ("b", 10)], "k string, t long")
    right = spark.createDataFrame([("a", 10, 1.0), ("a", 5, 2.0)], "k string, t long, v double")
    want = [("a", 10, 1.0), ("a", 19, 1.0), ("a", 30, None), ("b", 10, None)]
    for block in (None, 10, 16):
        got = joins.asof(left, right, ["v"], by=["k"], max_age=10, block=block)
        assert sorted((r.k, r.t, r.v) for r in got.collect()) == want


def test_exponential_blocks_agree(spark):
    d = spark.createDataFrame([("a", k, float(k * k % 17)) for k in range(200)], "symbol string, t long, x double")
    y, want = None, {}
    for k in range(200):
        x = float(k * k % 17)
        y = x if y is None else 0.3 * x + 0.7 * y
        want[k] = y
    for block in (1, 7, 500):
        assert all(abs(r.y - want[r.t]) < 1e-9 for r in fx.exponential(d, "x", 0.3, "y", block=block).collect())


def test_adjustment_limit(spark):
    bars = spark.createDataFrame([("a", 0, 100.0, 99.0, 98.0, 100.0)], "symbol string, t long, open double, high double, low double, close double")
    with pytest.raises(ValueError):
        qa.require_small_adjustments(qa.canonical_ohlc(bars))
