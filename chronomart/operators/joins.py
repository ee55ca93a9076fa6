"""Point-in-time joins: as-of, bitemporal, grid-aligned and paired."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running


def asof(left: DataFrame, right: DataFrame, values: list[str], *, on: str = "t", by: list[str] | None = None, max_age: int | None = None, block: int | None = None) -> DataFrame:
    """left, with the latest right row at or before it: values, and asof_t, its time. No row older than max_age counts.

    Both sides are united and sorted once by (keys, time, right first); the last right row is carried forward. With `block`
    rows are also dealt by blocks of time, so a hot key spreads over many tasks: where max_age <= block, each right row stands in its own
    and the next block; else the last right row before each block is carried into it.
    """
    by = by or []
    r = right.select(*by, F.col(on).alias("_t"), F.struct(F.col(on).alias("asof_t"), *values).alias("_r"))
    l = left.withColumn("_t", F.col(on)).withColumn("_l", F.struct(*left.columns))  # noqa: E741
    keys = [F.col(c) for c in by]
    carry = block and (max_age is None or max_age > block)
    if block and not carry:
        own = F.floor(F.col("_t") / block)
        r, l = r.withColumn("_b", F.explode(F.array(own, own + 1))), l.withColumn("_b", own)  # noqa: E741
        keys.append(F.col("_b"))
    both = r.withColumn("_side", F.lit(0)).unionByName(l.select(*by, "_t", "_l", *([] if carry or not block else ["_b"])).withColumn("_side", F.lit(1)), allowMissingColumns=True)
    if carry:
        d = running(both, by, ["_t", "_side"], block, {"_last": ("last", F.col("_r"))}) if by else running(both.withColumn("_one", F.lit(0)), ["_one"], ["_t", "_side"], block, {"_last": ("last", F.col("_r"))})
    else:
        order = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
        d = both.withColumn("_last", F.last("_r", ignorenulls=True).over(order))
    d = d.filter("_side = 1")
    if max_age is not None:
        d = d.withColumn("_last", F.when(F.col("_t") - F.col("_last.asof_t") <= max_age, F.col("_last")))
    return d.select("_l.*", "_last.asof_t", *[F.col(f"_last.{v}").alias(v) for v in values])


PACKET = 3  # observations of a packet
KNOWN = "array<struct<observed:long,known:long,seq:long,value:double>>"


def known_at_cells(ledger: DataFrame, cell: int) -> DataFrame:
    """(series, cell, open): the last observations known when a cell of days begins, each with its latest revision, for every cell from the first with facts to one after the last.

    An observation among the last ones is among the last ones of the cell that its latest revision came in, so a cell is summed up to that
    many rows, and the cells of a series are merged in order.
    """
    of = F.floor(F.col("known") / cell).alias("cell")
    fact = F.struct("known", "seq", "value")
    last = ledger.groupBy("series", of, "observed").agg(F.max(fact).alias("_f"))
    row = F.struct("observed", F.col("_f.known").alias("known"), F.col("_f.seq").alias("seq"), F.col("_f.value").alias("value"))
    per = last.groupBy("series", "cell").agg(F.slice(F.sort_array(F.collect_list(row), False), 1, PACKET).alias("facts"))

    def merge(t: pa.Table) -> pa.Table:
        by = dict(zip(t.column("cell").to_pylist(), t.column("facts").to_pylist(), strict=True))
        now, cells, out = {}, [], []
        for c in range(min(by), max(by) + 2):
            cells.append(c)
            out.append(list(now.values()))
            now |= {f["observed"]: f for f in by.get(c, [])}  # later cells have later revisions
            now = {k: now[k] for k in sorted(now)[-PACKET:]}
        kind = pa.list_(pa.struct([("observed", pa.int64()), ("known", pa.int64()), ("seq", pa.int64()), ("value", pa.float64())]))
        return pa.table({"series": pa.array([t.column("series")[0].as_py()] * len(cells), pa.string()), "cell": pa.array(cells, pa.int64()), "open": pa.array(out, kind)})

    return per.groupBy("series").applyInArrow(merge, f"series string, cell long, open {KNOWN}")  # a row a cell


def point_in_time(questions: DataFrame, ledger: DataFrame, series: list[str] | None = None, cell: int = 64) -> DataFrame:
    """A bitemporal join: for each question (day) and series, the packet of its last three observations as known that day.

    Only facts with known <= day count; of an observation's revisions the latest known (ties: higher seq). The packet is
    available, age (days since the latest observation's own known day), change and earlier change in percent;
    fewer than three observations give (0, 999, 0, 0).

    Any number of questions meets the facts of its own cell of days by equality, with the three observations that were open when the cell
    began; a question beyond the last cell meets those. series: the names asked for (None: all of the ledger, at most 1000). Facts
    without series, observed or known go; questions without a day get the packet of no observations.
    """
    facts = ledger.select("series", F.col("observed").cast("long"), F.col("known").cast("long"), F.col("seq").cast("long"), F.col("value").cast("double")).dropna(subset=["series", "observed", "known"])
    if series is None:
        series = [r[0] for r in facts.select("series").distinct().limit(1001).collect()]
        if len(series) > 1000:
            raise ValueError("name the series that are asked for")
    facts = facts.filter(F.col("series").isin(series))
    cells = known_at_cells(facts, cell)
    ends = cells.groupBy("series").agg(F.max("cell").alias("_last"))  # a row a series
    of = F.floor(F.col("day") / cell)
    asked = questions.select("day").distinct().withColumn("series", F.explode(F.array(*map(F.lit, series)) if series else F.array().cast("array<string>")))
    asked = asked.join(ends, "series", "left").withColumn("cell", F.least(of, F.col("_last"))).drop("_last")
    carried = asked.join(cells, ["series", "cell"]).select("day", "series", F.explode("open").alias("f")).select("day", "series", "f.*")
    own = asked.join(facts.withColumn("cell", F.floor(F.col("known") / cell)), ["series", "cell"]).filter("known <= day").select("day", "series", "observed", "known", "seq", "value")
    seen = carried.unionByName(own).groupBy("day", "series", "observed").agg(F.max(F.struct("known", "seq", "value")).alias("_f"))
    latest = Window.partitionBy("day", "series").orderBy(F.desc("observed"))
    j = seen.select("day", "series", "observed", "_f.*").withColumn("_k", F.row_number().over(latest)).filter(F.col("_k") <= PACKET)
    pick = lambda k, c: F.max(F.when(F.col("_k") == k, F.col(c)))
    p = j.groupBy("day", "series").agg(pick(1, "known").alias("_known"), *[pick(k, "value").alias(f"_v{k}") for k in (1, 2, 3)])
    whole = questions.withColumn("series", F.explode(F.array(*map(F.lit, series)) if series else F.array().cast("array<string>"))).join(p, ["day", "series"], "left")
    ok = F.col("_v3").isNotNull()
    return whole.select(
        "day", "series", F.when(ok, 1.0).otherwise(0.0).alias("available"), F.when(ok, (F.col("day") - F.col("_known")).cast("double")).otherwise(999.0).alias("age"),
        F.when(ok, (F.col("_v1") / F.col("_v2") - 1) * 100).otherwise(0.0).alias("change"), F.when(ok, (F.col("_v2") / F.col("_v3") - 1) * 100).otherwise(0.0).alias("earlier_change"),
    )


def paired(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Transitions A->B of the verdicts of two result sets on shared keys, with counts."""
    j = a.select(*key, F.col("verdict").alias("va")).join(b.select(*key, F.col("verdict").alias("vb")), key)
    return j.groupBy(F.concat_ws("->", "va", "vb").alias("transition")).agg(F.count("*").alias("n"))


def grid(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """A one-to-one join on a grid; rows without a partner on either side fail it."""
    if left.join(right, key, "left_anti").limit(1).count() or right.join(left, key, "left_anti").limit(1).count():
        raise ValueError("grids differ")
    return left.join(right, key)


def missing_and_extra(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Keys that only one side has, with which one."""
    e, a = expected.select(*key).distinct(), actual.select(*key).distinct()
    return e.join(a, key, "left_anti").withColumn("what", F.lit("missing")).unionByName(a.join(e, key, "left_anti").withColumn("what", F.lit("extra")))


def masked_packet(joined: DataFrame, values: list[str], age: Column, max_age: float) -> DataFrame:
    """An as-of packet with every row kept: any missing value gives (0, 1.25, 0...), else (1, age / max_age, values...)."""
    ok = F.lit(True)
    for v in values:
        ok = ok & F.col(v).isNotNull()
    return joined.withColumns({"available": F.when(ok, 1.0).otherwise(0.0), "relative_age": F.when(ok, age / max_age).otherwise(1.25)} | {v: F.when(ok, F.col(v)).otherwise(0.0) for v in values})
