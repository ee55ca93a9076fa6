"""Running values in blocks against plain loops, and that one hot symbol is many tasks' work."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronomart.operators import audits, joins, metrics, selection
from chronomart.operators.running import cells, running

KINDS = ("sum", "max", "max_before", "last", "previous", "total")


def plain(rows):
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        total = [r[3] for r in own if r[3] is not None]
        for i, r in enumerate(own):
            seen, earlier = ([q[3] for q in part if q[3] is not None] for part in (own[: i + 1], own[:i]))
            out[r[2]] = (
                sum(seen) if seen else None, max(seen, default=None), max(earlier, default=None), seen[-1] if seen else None, own[i - 1][3] if i else None, sum(total) if total else None,
            )
    return out


@pytest.mark.parametrize("block", [None, 1, 7, 1000])
def test_running_equals_a_loop(spark, block):
    g = random.Random(1)
    rows = [(g.choice(["a", "a", "a", "b", None]), g.choice([None, *range(-20, 40)]), k, g.choice([None, 0, 1, -3, 8])) for k in range(300)]
    d = spark.createDataFrame(rows, "k string, t long, id long, x long").withColumns({"sum": F.lit("clash"), "_b": F.lit(1), "_row": F.lit(2)})
    got = running(d, ["k"], ["t", "id"], block, {kind: (kind, F.col("x")) for kind in KINDS})
    assert got.columns == ["k", "t", "id", "x", "_b", "_row", *KINDS]
    assert {r.id: tuple(r[kind] for kind in KINDS) for r in got.collect()} == plain(rows)
    assert running(d.limit(0), ["k"], ["t", "id"], block, {"n": ("sum", F.lit(1))}).collect() == []


def test_a_hot_symbol_is_many_tasks_work(spark):
    d = spark.range(0, 100_000).select(F.lit("a").alias("symbol"), F.col("id").alias("t"), (F.col("id") % 7 - 3.0).alias("net"))
    out = running(d, ["symbol"], ["t"], 1000, {"eq": ("sum", F.col("net"))})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 100_000 and len(sizes) == 8 and max(sizes) < 30_000


def test_asof_carries_over_empty_blocks(spark):
    left = spark.createDataFrame([("a", 3), ("a", 905), ("b", 5), (None, 7)], "k string, t long")
    right = spark.createDataFrame([("a", 4, 1.0), ("a", 12, 2.0), ("b", 6, 3.0), (None, 1, 4.0)], "k string, t long, v double")
    for block in (None, 10, 10_000):
        got = sorted(((r.k or "", r.t, r.v) for r in joins.asof(left, right, ["v"], by=["k"], block=block).collect()), key=repr)
        assert got == sorted([("a", 3, None), ("a", 905, 2.0), ("b", 5, None), ("", 7, 4.0)], key=repr)
        assert joins.asof(left.filter("k = 'a'"), right, ["v"], block=block).filter("t = 905").first().v == 2.0


def test_ranks_and_quantiles_with_ties_and_extremes(spark):
    g = np.random.default_rng(3)
    x = np.concatenate([g.normal(size=200), [0.0, -0.0, 1e300, -1e300, 1e-300], np.repeat(0.5, 90)])
    y = np.concatenate([x[:150] + g.normal(size=150), g.integers(0, 4, len(x) - 150).astype(float)])
    d = spark.createDataFrame([("a", float(p), float(q), int(k % 3 == 0)) for k, (p, q) in enumerate(zip(x, y, strict=True))] + [("c", 1.0, 1.0, 1)] * 5, "k string, p double, q double, y int")
    import pandas as pd

    want = pd.Series(x + 0.0).rank().corr(pd.Series(y).rank())
    got = {r.k: r.spearman for r in metrics.spearman(d, ["k"], "p", "q").collect()}
    assert abs(got["a"] - want) < 1e-12 and got["c"] is None
    pos, neg = x[np.arange(len(x)) % 3 == 0], x[np.arange(len(x)) % 3 != 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    got = {r.k: r for r in metrics.roc_auc(d, ["k"]).collect()}
    assert abs(got["a"].auc - auc) < 1e-12 and got["c"].auc is None and got["c"].positives == 5
    for q in (0.0, 0.25, 0.9, 1.0):
        got = {r.k: r.threshold for r in metrics.threshold_quantile(d.filter("abs(p) < 1e9"), ["k"], "p", q).collect()}
        assert np.isclose(got["a"], np.quantile(np.abs(x[np.abs(x) < 1e9]), q), rtol=1e-12) and got["c"] == 1.0
    none = metrics.threshold_quantile(spark.createDataFrame([("a", None)], "k string, p double"), ["k"], "p", 0.5)
    assert [r.threshold for r in none.collect()] == [None]


def test_cells_grow_with_the_value(spark):
    v = sorted([0.0, float("inf"), float("-inf"), *[s * 10.0**e for e in range(-300, 301, 7) for s in (-1, 1)]])
    got = [r.c for r in spark.createDataFrame([(x,) for x in v], "x double").select("x", cells(F.col("x")).alias("c")).orderBy("x").collect()]
    assert got == sorted(got)
    nan = spark.createDataFrame([(float("nan"),)], "x double").select(cells(F.col("x"))).first()[0]
    assert nan == got[-1]


@pytest.mark.parametrize("block", [None, 5])
def test_folds_and_halves_in_blocks(spark, block):
    rows = [("a", t, t + 3) for t in range(0, 40, 2)] + [("b", 5, 6)]
    d = spark.createDataFrame(rows, "k string, t long, e long")
    for r in selection.expanding_folds(d, "k", "t", "e", 4, block).collect():
        assert r.train == sum(k == r.k and t < r.first and e < r.first for k, t, e in rows)
    part = {r.t: r.part for r in selection.halves(d, ["k"], "t", "e", block).filter("k = 'a'").collect()}
    assert part == {t: "selection" if t >= 20 else "calibration" if t + 3 < 20 else None for t in range(0, 40, 2)}


def test_known_state_counts_an_observation_once(spark):
    ledger = spark.createDataFrame([("s", 1, 10), ("s", 1, 20), ("s", 2, 20), ("s", 3, 31), ("u", 9, 99)], "series string, observed long, known long")
    asked = spark.createDataFrame([(9,), (10,), (30,), (30,)], "day long")
    got = sorted(tuple(r) for r in audits.known_state(asked, ledger).select("day", "series", "observations", "latest_observed", "latest_known").collect())
    assert got == [(10, "s", 1, 1, 10), (30, "s", 2, 2, 20)]


def test_window_imbalance_is_exact_and_takes_no_sliding_frame(spark):
    from chronomart.operators import grids

    g = random.Random(8)
    rows = [(g.choice("ab"), g.choice([g.randrange(-30_000_000, 40_000_000), g.randrange(4) * 3_000_000]), k, float(g.randrange(0, 9)), g.choice(["buy", "sell"])) for k in range(300)]
    rows += [("c", 5, 300, None, "buy"), ("d", None, 301, 2.0, "sell"), ("d", None, 302, 3.0, "buy"), ("e", 5, 303, 4.0, None)]
    d = spark.createDataFrame(rows, "symbol string, us long, tick_id long, qty double, side string")
    got = grids.window_imbalance(d, 3)
    assert "-2999999" not in got._jdf.queryExecution().toString()
    for r in got.collect():
        near = [x for x in rows if x[0] == r.symbol and (x[1] is None if r.us is None else x[1] is not None and r.us - 3_000_000 < x[1] <= r.us) and x[3] is not None]
        total = sum(x[3] for x in near)
        want = sum(x[3] if x[4] == "buy" else -x[3] for x in near) / total if total > 0 else 0.0
        assert abs(r.imbalance - want) < 1e-12, r
    assert got.count() == len(rows)
