"""Stateful streams: equal to their batch twins over restarts, missing and late rows, quiet seconds, and arrivals that go back."""

import random

import pytest
from pyspark.sql import functions as F

from chronomart.operators import audits, grids
from chronomart.sources.shared import new_folder
from chronomart.streaming import stateful

FEED = "symbol string, us long, pos long, first long, last long, previous long, snapshot_id long"


def feed(seed, n=120):
    g = random.Random(seed)
    rows = []
    for s in ("a", "b"):
        for pos in range(1, n + 1):
            u = pos * 10
            cut = g.random() < 0.04
            rows.append((s, pos * 1_000_000, pos, u - 5 if cut else u - 9, u, u - 7 if cut else u - 10, u + g.choice([5, 25]) if g.random() < 0.06 else None))
    return rows


class Source:
    """A folder that rows are added to, file by file, and a stream over it that stops and starts again."""

    def __init__(self, spark, schema, make):
        self.spark, self.schema, self.make = spark, schema, make
        self.source, self.out, self.state = (new_folder(spark, x) for x in ("in", "out", "state"))

    def run(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.source)
        d = self.make(self.spark.readStream.schema(self.schema).parquet(self.source))
        with stateful.rocks(self.spark):
            d.writeStream.format("parquet").option("checkpointLocation", self.state).trigger(availableNow=True).start(self.out).awaitTermination()
        return self.spark.read.schema(d.schema).parquet(self.out)


def test_continuity_equals_its_twin_over_restarts(spark):
    rows = feed(1)
    g = random.Random(2)
    want = sorted((r.symbol, r.pos, r.segment, r.state) for r in audits.sequence_state(spark.createDataFrame(rows, FEED)).collect())
    by_time = sorted(rows, key=lambda r: r[1] + g.randrange(8) * 1_000_000)  # a little out of order
    s = Source(spark, FEED, lambda d: stateful.continuity(d, "60 seconds"))
    for k in range(0, len(by_time), 80):
        got = s.run(by_time[k : k + 80])
    assert sorted((r.symbol, r.pos, r.segment, r.state) for r in got.collect()) == want
    gaps = [r for r in got.collect() if r.integrity]
    assert gaps and all(r.state == "gap" for r in gaps)


def test_lost_and_late_positions_are_reported(spark):
    row = lambda pos, us=None: ("a", (us or pos) * 1_000_000, pos, pos * 10 - 9, pos * 10, pos * 10 - 10, 15 if pos == 1 else None)
    s = Source(spark, FEED, lambda d: stateful.continuity(d, "5 seconds"))
    s.run([row(1), row(2), row(5), row(4)])
    assert s.run([row(6)]).count() == 2  # 4 to 6 wait for 3
    s.run([("b", 60_000_000, 1, 1, 10, 0, None)])  # time goes on, and 3 will not come
    got = s.run([row(3, 58), ("b", 61_000_000, 2, 1, 10, 0, None)])
    notes = [(r.pos, r.state, r.integrity) for r in got.filter("symbol = 'a'").collect()]
    assert (None, "lost", "positions 3 to 3") in notes and (3, "late", "position 7 was next") in notes
    assert {p: s for p, s, _ in notes if p in (4, 5, 6)} == {4: "gap", 5: "invalid", 6: "invalid"}


def test_seconds_equal_their_twin_and_quiet_ones_are_there(spark):
    g = random.Random(3)
    kind = "symbol string, us long, tick_id long, price double, qty double, buyer_maker boolean"
    rows = [(g.choice("aab"), g.randrange(0, 90_000_000), k, 100 + g.random(), float(g.randrange(1, 9)), g.random() < 0.5) for k in range(150)]
    rows = sorted(rows, key=lambda r: r[1])
    s = Source(spark, kind, lambda d: stateful.second_flow(d, "2 seconds"))
    for k in range(0, 150, 50):
        s.run(rows[k : k + 50])
    got = s.run([("z", 300_000_000, 1, 1.0, 1.0, True)])
    want = {(r.symbol, r.t): r for r in grids.flow_features(spark.createDataFrame(rows, kind), 16).collect()}
    got = {(r.symbol, r.t): r for r in got.collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        for c in ("price", *stateful.FEATURES):
            assert r[c] == want[k][c] or abs(r[c] - want[k][c]) < 1e-9, (k, c)
    last = {}
    for s, t in sorted(want):
        assert last.get(s, t - 1) == t - 1
        last[s] = t


def test_flow_does_not_depend_on_blocks(spark):
    g = random.Random(4)
    rows = [("a", g.randrange(0, 200_000_000), k, 100 + g.random(), 1.0, g.random() < 0.5) for k in range(80)]
    d = spark.createDataFrame(rows, "symbol string, us long, tick_id long, price double, qty double, buyer_maker boolean")
    one, two = (sorted(map(str, grids.flow_features(d, b).withColumns({c: F.round(c, 9) for c, k in grids.flow_features(d, b).dtypes if k == "double"}).collect())) for b in (10, 100_000))
    assert one == two and len(one) > 100
    assert grids.flow_features(d.limit(0)).count() == 0


def test_late_rows_and_regressions(spark):
    kind = "symbol string, us long, local_us long"
    source, state = new_folder(spark, "in"), new_folder(spark, "state")

    def run(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        return stateful.fan_out(spark.readStream.schema(kind).parquet(source), "arrivals", late_us=100, state=state)

    main, late = run([("a", 10, 50), ("a", 20, 400), ("a", None, 60)])
    assert sorted(map(tuple, main.select("us", "local_us").collect())) == [(10, 50)] and late.count() == 2
    main, late = run([("a", 500, 500)])
    assert main.count() == 2 and {r.batch for r in main.collect()} == {0, 1}
    with pytest.raises(Exception, match="arrival 450 after 500"):
        run([("a", 440, 450)])
    with pytest.raises(Exception, match="arrival 450 after 500"):  # the batch is still there after a restart, and still wrong
        run([("a", 900, 900)])
    main, late = (spark.read.schema(kind).parquet(f"{state}/{k}") for k in ("main", "late"))
    assert main.count() == 2 and late.count() == 2


def test_sampled_rows_equal_their_twin_over_restarts(spark):
    from chronomart.operators import books

    g = random.Random(5)
    kind = "symbol string, us long, seq long, snapshot boolean, side string, level double, amount double, qty double, buyer_maker boolean"
    rows = []
    for k in range(260):
        us, s = g.randrange(1, 60_000_000), g.choice("aab")
        side = g.choice(["bid", "ask"])
        rows.append((s, us, k, g.random() < 0.12, side, float(g.randrange(1, 9) if side == "bid" else g.randrange(8, 20)), float(g.choice([0, 1, 2, 5])), None, None))
    rows += [(g.choice("ab"), g.randrange(1, 60_000_000), None, None, None, None, None, float(g.randrange(1, 5)), g.random() < 0.5) for _ in range(200)]
    rows += [(s, t * 1_000_000 + 7, 900 + t, True, side, level, 2.0, None, None) for s in "ab" for t in range(0, 60, 4) for side, level in (("bid", 5.0), ("ask", 9.0), ("bid", 4.0), ("ask", 21.0))]
    rows.sort(key=lambda r: r[1])
    s = Source(spark, kind, lambda d: stateful.sampled_rows(d, lateness="2 seconds"))
    for k in range(0, len(rows), 160):
        s.run(rows[k : k + 160])
    got = s.run([("z", 300_000_000, None, None, None, None, None, 1.0, True)])
    d = spark.createDataFrame(rows, kind)
    state, blocks = books.books(d.filter("side is not null"), 10_000_000)
    batch = books.sampled_rows(books.latched(state), books.slots_of(blocks, 1_000_000, 10_000_000), d.filter("side is null"), 1_000_000)
    plain = lambda f: {(r.symbol, r.slot): {c: round(r[c], 9) if isinstance(r[c], float) else r[c] for c in batch.columns} for r in f.collect()}
    one, two = plain(got), plain(batch)
    last = {s: max(r[1] for r in rows if r[0] == s) for s in "ab"}
    assert sorted(got.columns) == sorted(batch.columns) and {k: v for k, v in one.items() if k[1] <= last[k[0]]} == {k: v for k, v in two.items() if k[1] <= last[k[0]]} and len(two) > 8


def test_a_file_that_waits_asks_the_state_once_a_packet():
    """Positions 4097 on come before 1 to 4096: few calls to the state, each position judged once, in order."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import Row

    calls = []

    class Store:
        def __init__(self):
            self.held = {}
            get = lambda k=0: self.held[k]
            self.of = {
                "exists": lambda: 0 in self.held, "get": get, "update": lambda v: self.held.__setitem__(0, v), "keys": lambda: iter(list(self.held)), "getValue": get, "updateValue": self.held.__setitem__,
                "removeKey": self.held.__delitem__, "containsKey": self.held.__contains__, "getValueState": lambda *_: Store(), "getMapState": lambda *_: Store(), "registerTimer": lambda _: None,
            }

        def __getattr__(self, name):
            calls.append(name)
            return self.of[name]

    n = 20_000
    column = lambda x: pa.array(x, pa.int64())
    pos = np.arange(1, n + 1)
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * n), column(pos), column(pos), column(pos * 10 - 9), column(pos * 10), column(pos * 10 - 10), column([25, *[None] * (n - 1)])], ["symbol", "us", "pos", "first", "last", "previous", "snapshot_id"])
    sent = [Row(**r) for b in stateful.packets([batch.slice(4096), batch.slice(0, 4096)]) for r in b.to_pylist()]
    c = stateful.Continuity()
    c.init(Store())
    out = [r for half in (sent[:-1], sent[-1:]) for r in c.handleInputRows(("a",), iter(half), None)]
    columns = [[r[c] for r in out] for c in ("symbol", "lo", "segments", "codes", "notes")]
    kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()))
    rows = [r for b in stateful.judgements([pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["symbol", "lo", "segments", "codes", "notes"])]) for r in b.to_pylist()]
    assert [r["pos"] for r in rows] == list(range(1, n + 1)) and len(calls) < 60
    assert [r["state"] for r in rows] == ["snapshot", "stale", "bridge", *["valid"] * (n - 3)]


def test_only_sums_of_seconds_reach_the_state(spark):
    path = new_folder(spark, "ticks")
    spark.createDataFrame([("a", 1, 1, 1.0, 1.0, True)], "symbol string, us long, tick_id long, price double, qty double, buyer_maker boolean").write.parquet(path)
    d = stateful.second_flow(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path))
    plan = d._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan.split("TransformWithState")[1]


def test_only_sums_of_times_reach_the_state_of_a_book(spark):
    path = new_folder(spark, "events")
    kind = "symbol string, us long, seq long, snapshot boolean, side string, level double, amount double, qty double, buyer_maker boolean"
    spark.createDataFrame([("a", 1, 1, True, "bid", 1.0, 1.0, None, None)], kind).write.parquet(path)
    d = stateful.sampled_rows(spark.readStream.schema(kind).parquet(path))
    assert "Aggregate" in d._jdf.queryExecution().analyzed().toString().split("TransformWithState")[1]


def test_joined_packets_are_few_and_hold_every_pair(spark):
    from chronomart.streaming import feeds

    g = random.Random(7)
    made = lambda n: sorted((g.choice("ab"), g.randrange(0, 40_000_000), g.choice([None, 1.0, 2.0])) for _ in range(n))
    books, trades = made(300), made(200)
    one = spark.createDataFrame([*books, (None, 1, 1.0), ("a", None, 1.0)], "symbol string, us long, mid double").coalesce(1)
    two = spark.createDataFrame([*trades, (None, 1, 1.0), ("a", None, 1.0)], "symbol string, us long, qty double").coalesce(1)
    packets = feeds.drain(feeds.sampled_packets(feeds.replay(one, "books"), feeds.replay(two, "trades"), 10, "10 minutes"), "packets")
    got = sorted(map(str, feeds.each_pair(packets).select("symbol", "us", "qty", "book_us", "mid").collect()))
    want = sorted(f"Row(symbol={s!r}, us={t}, qty={q}, book_us={u}, mid={m})" for s, t, q in trades for z, u, m in books if s == z and t // 10_000_000 == u // 10_000_000)
    assert got == want and packets.count() == 8
