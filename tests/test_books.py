"""Order books against a plain loop over updates, for any cut into blocks: carried books, resets, the latch, every slot, order flow."""

import random

import pytest
from pyspark.sql import functions as F

from chronomart.operators import books

STEP, DEPTH = 10, 4
KIND = "symbol string, us long, seq long, snapshot boolean, side string, level double, amount double, block string, kind int"


def made(seed, n=400, span=3000):
    g = random.Random(seed)
    rows = []
    for k in range(n):
        symbol = "a" if g.random() < 0.8 else "b"
        us = g.choice([g.randrange(1, span), g.randrange(1, span) // 40 * 40 + 1])
        side = g.choice(["bid", "ask"])
        level = g.randrange(1, 12) if side == "bid" else g.randrange(11, 24)
        rows.append((symbol, us, k, g.random() < 0.03, side, float(level), float(g.choice([0, 0, 1, 2, 5, 9])), "clash", 1))
    return rows


def plain(rows):
    """By symbol the states after each group (us, segment, bids, asks, valid, fresh) by a loop over dictionaries."""
    out = {}
    for s in {r[0] for r in rows}:
        book, segment, valid, states = {"bid": {}, "ask": {}}, None, True, []
        for us in sorted({r[1] for r in rows if r[0] == s}):
            group = sorted((r for r in rows if r[0] == s and r[1] == us), key=lambda r: (r[2], r[6]))
            if any(r[3] for r in group):
                book, segment, valid = {"bid": {}, "ask": {}}, us, True
            for r in group:
                book[r[4]][r[5]] = r[6]
            if segment is None:
                book = {"bid": {}, "ask": {}}
                continue
            sides = [sorted(((p, q) for p, q in book[k].items() if q > 0), reverse=k == "bid")[:DEPTH] for k in ("bid", "ask")]
            valid = valid and bool(sides[0] and sides[1] and sides[0][0][0] < sides[1][0][0])
            states.append((us, segment, *sides, valid, us == segment))
        out[s] = states
    return out


def flow(old, new, n, sign):
    total = 0.0
    for k in range(n):
        o, w = (x[k] if k < len(x) else None for x in (old, new))
        if o is None and w is None:
            continue
        total += w[1] if o is None else -o[1] if w is None else w[1] if (w[0] - o[0]) * sign > 0 else w[1] - o[1] if w[0] == o[0] else -o[1]
    return total


def moved(old, new, near, sign):
    o, n = dict(old[:near]), dict(new[:near])
    return sum(max((n.get(p, 0.0) - o.get(p, 0.0)) * sign, 0.0) for p in o.keys() | n.keys())


@pytest.mark.parametrize("block", [STEP, 50, 700, 10_000])
def test_states_and_slots_equal_a_loop(spark, block):
    rows = made(block)
    d = spark.createDataFrame(rows, KIND)
    state, blocks = books.books(d, block, DEPTH)
    state, slots = books.latched(state), books.slots_of(blocks, STEP, block)
    want = plain(rows)
    got = {(r.symbol, r.us): ([tuple(x) for x in r.bids], [tuple(x) for x in r.asks], r.valid) for r in state.filter("not carried").collect()}
    assert got == {(s, us): (b, a, v) for s, states in want.items() for us, _, b, a, v, _ in states}
    grid = {(r.symbol, r.slot): (r.bids and [tuple(x) for x in r.bids], r.valid) for r in books.at_slots(state, slots).collect()}
    flows = {(r.symbol, r.slot): (r.ofi1, r.ofi3, r.bid_replenished + r.ask_replenished, r.bid_depleted + r.ask_depleted) for r in books.order_flow(state, slots, STEP, (1, 3), 2).collect()}
    expected, sums = {}, {}
    for s, states in want.items():
        times = [r[1] for r in rows if r[0] == s]
        for slot in range(-(-min(times) // STEP) * STEP, -(-max(times) // STEP) * STEP + 1, STEP):
            last = [x for x in states if x[0] <= slot]
            expected[s, slot] = (last[-1][2] or None if last else None, last[-1][4] if last else False)
            total = [0.0] * 4
            for k, x in enumerate(states):
                if slot - STEP < x[0] <= slot:
                    if x[5]:
                        total = [0.0] * 4
                        continue
                    o, n = states[k - 1], x
                    parts = [flow(o[2], n[2], m, 1) - flow(o[3], n[3], m, -1) for m in (1, 3)] + [moved(o[2], n[2], 2, g) + moved(o[3], n[3], 2, g) for g in (1, -1)]
                    total = [p + q for p, q in zip(total, parts, strict=True)]
            sums[s, slot] = tuple(total)
    assert {k: (b or None, v) for k, (b, v) in grid.items()} == expected
    assert flows == sums


def test_whole_days_have_every_slot(spark):
    day = 86_400_000_000
    rows = [("a", 2 * day + 5_000_000, 1, True, "bid", 9.0, 1.0, "", 0), ("a", 2 * day + 5_000_000, 2, False, "ask", 10.0, 1.0, "", 0), ("a", 3 * day + 1, 3, False, "ask", 11.0, 1.0, "", 0)]
    state, blocks = books.books(spark.createDataFrame(rows, KIND), 3_600_000_000, whole_days=True)
    d = books.at_slots(books.latched(state), books.slots_of(blocks, 250_000, 3_600_000_000))
    got = d.groupBy(F.floor((F.col("slot") - 1) / day).alias("day")).agg(F.count("*").alias("n"), F.count_if("valid").alias("valid")).orderBy("day").collect()
    assert [tuple(r) for r in got] == [(2, 345_600, 345_600 - 19), (3, 345_600, 345_600)]


def test_small_chunks_and_odd_rows(spark, monkeypatch):
    rows = made(3, 200, 500)
    d = spark.createDataFrame([*rows, (None, 5, 1, True, "bid", 1.0, 1.0, "", 0), ("a", None, 1, True, "bid", 1.0, 1.0, "", 0), ("a", 7, 1, None, "bid", 1.0, 1.0, "", 0), ("c", 7, 1, False, "bid", 1.0, 1.0, "", 0)], KIND)
    monkeypatch.setattr(books, "CELLS", 40)
    whole = books.books(d, 1000, DEPTH)[0]
    got = {(r.symbol, r.us): ([tuple(x) for x in r.bids], [tuple(x) for x in r.asks]) for r in whole.filter("not carried").collect()}
    assert got == {(s, us): (b, a) for s, states in plain(rows).items() for us, _, b, a, _, _ in states}
    empty, blocks = books.books(d.limit(0), 1000)
    assert books.latched(empty).count() == 0 and books.slots_of(blocks, 10, 1000).count() == 0


def test_a_fold_gets_one_row_for_each_level_of_a_time(spark, monkeypatch):
    rows = [(*r[:2], r[2] + 1000 * k, *r[3:6], r[6] + k * (k < 19), *r[7:]) for r in made(6) for k in range(20)]
    real = books._fold

    def few(*args):
        fold = real(*args)

        def checked(t):
            assert t.num_rows < 500, t.num_rows
            return fold(t)

        return checked

    monkeypatch.setattr(books, "_fold", few)
    got = {(r.symbol, r.us): ([tuple(x) for x in r.bids], [tuple(x) for x in r.asks]) for r in books.books(spark.createDataFrame(rows, KIND), 10_000, DEPTH)[0].filter("not carried").collect()}
    assert got == {(s, us): (b, a) for s, states in plain(rows).items() for us, _, b, a, _, _ in states}
