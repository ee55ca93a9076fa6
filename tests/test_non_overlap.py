"""Non-overlapping choice in blocks against a plain loop, whatever the blocks, with state carried over folds, and a hot key dealt over tasks."""

import random

import pytest
from pyspark.sql import functions as F

from chronomart.operators import labels

KIND = "k string, s long, e long, _k string, v int"


def plain(rows, strict, carried=None):
    out, carried = [], carried or {}
    for key in {r[0] for r in rows}:
        last = carried.get(key)
        for k, s, e in sorted(r for r in rows if r[0] == key and None not in r[1:]):
            if last is None or (s > last if strict else s >= last):
                out.append((k, s, e))
                last = e
    return sorted(out, key=repr)


def made(seed, n):
    g = random.Random(seed)
    rows = set()
    while len(rows) < n:
        s = g.choice([g.randrange(600), g.randrange(20) * 30])
        rows.add((g.choice(["a", "a", "a", "b", None]), s, s + g.choice([1, 2, 5, 9, 40, 200])))
    return sorted(rows, key=repr) + [("c", 5, 5), ("c", 5, 5), ("c", 5, 6), ("d", 100_000, 100_001), ("d", 3, 4)]


@pytest.mark.parametrize(("block", "strict"), [(None, False), (3, True), (40, False), (40, True), (1e9, True)])
def test_equals_a_loop(spark, block, strict):
    rows = made(1, 150)
    d = spark.createDataFrame([(*r, "x", 1) for r in rows] + [("a", None, 5, "x", 1), ("a", 5, None, "x", 1)], KIND)
    got = labels.non_overlapping(d, "k", "s", "e", strict=strict, block=block)
    assert got.columns == d.columns
    assert sorted((tuple(r)[:3] for r in got.collect()), key=repr) == plain(rows, strict)


def test_state_is_carried_over_folds(spark):
    rows = sorted(set(made(2, 120)), key=repr)
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND)
    kept, carried, out = None, None, []
    for lo, hi in ((0, 100), (100, 101), (101, 350), (350, 10**6)):
        kept = labels.non_overlapping(d.filter((F.col("s") >= lo) & (F.col("s") < hi)), "k", "s", "e", strict=True, block=25, carried=carried)
        carried = labels.last_exits(kept, "k", "e", carried)
        carried = spark.createDataFrame(carried.collect(), carried.schema)
        out += [tuple(r)[:3] for r in kept.collect()]
    assert sorted(out, key=repr) == plain(rows, True)
    assert labels.non_overlapping(d.limit(0), "k", "s", "e").count() == 0


def test_a_hot_key_is_many_tasks_work(spark):
    d = spark.range(0, 40_000).select(F.lit("a").alias("k"), F.col("id").alias("s"), (F.col("id") + 3 + F.col("id") % 5).alias("e"))
    got = sorted(r.s for r in labels.non_overlapping(d, "k", "s", "e", block=500).collect())
    assert got == [r[1] for r in sorted(plain([("a", i, i + 3 + i % 5) for i in range(40_000)], False), key=lambda r: r[1])]
