"""Elastic net, resumable chunks, the predictor contract, and the bitemporal join by cells, each against a plain version."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronomart.operators import joins, replay, walk
from chronomart.plans import protocols
from chronomart.sources import tables
from chronomart.sources.shared import new_folder

SF = "/root/testdata/sf0.001"


def plain_net(x, y, alpha, l1):
    """Coordinate descent on rows."""
    m, s = x.mean(0), x.std(0)
    z, r = (x - m) / np.where(s > 1e-12, s, 1), y - y.mean()
    w = np.zeros(x.shape[1])
    for _ in range(5000):
        for j in np.flatnonzero(s > 1e-12):
            c = z[:, j] @ (r - z @ w + z[:, j] * w[j]) / len(y)
            w[j] = np.sign(c) * max(abs(c) - alpha * l1, 0) / (z[:, j] @ z[:, j] / len(y) + alpha * (1 - l1))
    w = np.where(s > 1e-12, w / np.where(s > 1e-12, s, 1), 0)
    return np.concatenate([[y.mean() - m @ w], w])


@pytest.mark.parametrize(("alpha", "l1"), [(5e-4, 0.25), (0.5, 0.9), (0.0, 0.5)])
def test_elastic_net_equals_descent_on_rows(spark, alpha, l1):
    g = np.random.default_rng(1)
    x = np.hstack([g.normal(size=(200, 3)), np.ones((200, 1))])
    x[:, 1] += 0.8 * x[:, 0]
    y = 2 * x[:, 0] - 0.2 * x[:, 2] + 3 + 0.5 * g.normal(size=200)
    rows = [(("a", "b")[k % 2], *map(float, x[k]), float(y[k])) for k in range(200)] + [("a", None, 1.0, 1.0, 1.0, 1.0), ("c", 1.0, 1.0, 1.0, 1.0, None)]
    d = spark.createDataFrame(rows, "k string, p double, q double, r double, s double, y double")
    scored, weights = walk.elastic_net(d, d, ["p", "q", "r", "s"], "y", ["k"], alpha, l1)
    got = {(w.k, w.feature): w.weight for w in weights.collect()}
    for k in "ab":
        own = np.arange(200) % 2 == "ab".index(k)
        want = plain_net(x[own], y[own], alpha, l1)
        assert np.allclose([got[k, f] for f in ("intercept", "p", "q", "r", "s")], want, atol=1e-8)
    assert len(got) == 10 and {r.k for r in scored.filter("prediction is null").collect()} == {"a", "c"}
    one = scored.filter("k = 'a' and p is not null").first()
    assert abs(one.prediction - sum(got["a", f] * v for f, v in zip(("intercept", "p", "q", "r", "s"), (1.0, *one[1:5]), strict=True))) < 1e-9


def test_backfill_resumes_and_replaces(spark):
    folder, schema, asked = new_folder(spark, "fill"), "k string, day long, x double", []

    def fetch(value, fail_at=None):
        def run(chunks):
            for c in chunks.collect():
                asked.append((c.start, c.end))
                if c.start == fail_at:
                    raise ConnectionError
            return chunks.filter("start <> 12").select(F.lit("a").alias("k"), F.explode(F.sequence("start", "end")).alias("day"), F.lit(value).alias("x"), "start", "end")

        return run

    with pytest.raises(ConnectionError):
        tables.backfill(spark, folder, 0, 17, 4, fetch(1.0, fail_at=8), schema, at_once=1)
    assert asked == [(0, 3), (4, 7), (8, 11)] and tables.stored(spark, folder, schema, ["k", "day"]).count() == 8
    asked.clear()
    assert tables.backfill(spark, folder, 0, 17, 4, fetch(2.0), schema) == 3 and asked == [(8, 11), (12, 15), (16, 17)]
    got = {r.day: r.x for r in tables.stored(spark, folder, schema, ["k", "day"]).collect()}
    assert got == {d: 1.0 if d < 8 else 2.0 for d in range(18) if not 12 <= d <= 15}
    assert tables.backfill(spark, folder, 0, 17, 4, fetch(3.0), schema) == 0
    # rows that no ledger entry stands for do not count, and are replaced
    orphan = spark.createDataFrame([("a", 20, -1.0, 18, 21)], f"{schema}, start long, end long")
    orphan.write.mode("append").partitionBy("start", "end").parquet(f"{folder}/data")
    assert tables.stored(spark, folder, schema, ["k", "day"]).filter("x < 0").count() == 0
    assert tables.backfill(spark, folder, 0, 21, 4, fetch(5.0), schema) == 2  # 16 to 19 is another chunk now
    got = {r.day: r.x for r in tables.stored(spark, folder, schema, ["k", "day"]).collect()}
    assert got[16] == 5.0 and got[20] == 5.0 and got[8] == 2.0
    # without data the ledger is void
    other = new_folder(spark, "fill")
    spark.createDataFrame([(0, 3, 4, 1)], tables.LEDGER).write.parquet(f"{other}/ledger")
    assert tables.completed(spark, other).count() == 0 and tables.stored(spark, other, schema, ["k"]).count() == 0
    with pytest.raises(ValueError):
        tables.backfill(spark, folder, 0, 1, 0, fetch(1.0), schema)


def test_predictors_must_keep_the_contract(spark):
    bars = protocols.hourly(spark, SF).cache()
    run = lambda f: replay.replay(f, bars, history=24, horizon=6, threshold=0.6, take_bps=20.0, stop_bps=10.0, cost_bps=2.0)
    good = run(protocols.momentum)
    assert good.count() and good.filter("direction = 'NO_TRADE' and (net is not null or hit)").count() == 0
    ahead = F.lead("close").over(protocols.qa.by_time())

    def leaks(b):
        return protocols.momentum(b).drop("confidence").join(b.select("symbol", "t", F.when(ahead > F.col("close"), 0.9).otherwise(0.1).alias("confidence")), ["symbol", "t"])

    def centred(b):
        mean = b.agg(F.avg("close")).first()[0]
        return b.select("symbol", "t", F.col("close").alias("reference_price"), F.when(F.col("close") > mean, "LONG").otherwise("SHORT").alias("direction"), F.lit(0.9).alias("confidence"))

    wrong = {
        "change with what comes after": leaks, "predictions up to": centred,
        "another price": lambda b: protocols.momentum(b).withColumn("reference_price", F.col("reference_price") + 1),
        "at no bar": lambda b: protocols.momentum(b).withColumn("t", F.col("t") + 1),
        "have several": lambda b: protocols.momentum(b).unionByName(protocols.momentum(b)),
    }
    for what, f in wrong.items():
        with pytest.raises(replay.Broken, match=what):
            run(f)
    assert replay.replay(protocols.momentum, bars.limit(0), history=24, horizon=6, threshold=0.6, take_bps=20.0, stop_bps=10.0, cost_bps=2.0).count() == 0
    bars.unpersist()


@pytest.mark.parametrize("cell", [1, 7, 1000])
def test_packets_do_not_depend_on_cells(spark, cell):
    g = random.Random(cell)
    facts = [(g.choice("st"), g.randrange(8) * 10, g.randrange(-5, 60), k, float(g.randrange(1, 50))) for k in range(70)] + [("s", None, 3, 1, 1.0), ("s", 3, None, 1, 1.0), (None, 3, 3, 1, 1.0), ("v", 10, 5, 99, 2.0)]
    days = [*range(-10, 90, 3), 500, None]
    got = {(r.day, r.series): tuple(r)[2:] for r in joins.point_in_time(spark.createDataFrame([(d,) for d in days], "day long"), spark.createDataFrame(facts, "series string, observed long, known long, seq long, value double"), cell=cell).collect()}
    want = {}
    for d in days:
        for s in "stv":
            seen = {}
            for _, o, k, q, v in sorted((f for f in facts if f[0] == s and None not in f and d is not None and f[2] <= d), key=lambda f: (f[2], f[3])):
                seen[o] = (k, v)
            top = [seen[o] for o in sorted(seen, reverse=True)[:3]]
            want[d, s] = (1.0, float(d - top[0][0]), (top[0][1] / top[1][1] - 1) * 100, (top[1][1] / top[2][1] - 1) * 100) if len(top) == 3 else (0.0, 999.0, 0.0, 0.0)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_s13_keeps_every_tick_of_an_instant(spark, tmp_path):
    """Ticks that share a symbol and a time have a row each, as the SQL has it."""
    import duckdb

    from chronomart.plans import feeds, registry  # noqa: F401

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(50)
    e.unionByName(e.withColumn("event_id", F.col("event_id") + 1000)).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    answer = con.execute(registry.SQL["s13_five_levels"])
    names = [d[0] for d in answer.description]
    plain = lambda row: tuple(round(x, 9) if isinstance(x, float) else x for x in row)
    got = [plain(r) for r in registry.QUERIES["s13_five_levels"](spark, str(tmp_path)).select(*names).collect()]
    assert len(got) == 100 and sorted(got, key=repr) == sorted(map(plain, answer.fetchall()), key=repr)
