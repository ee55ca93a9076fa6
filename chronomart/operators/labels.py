"""Labels and decisions: forward returns, first-touch barriers, non-overlapping choice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import written
from .quality import by_time, rows


def forward_return(h: int) -> Column:
    return F.log(F.lead("close", h).over(by_time()) / F.col("close")) * 1e4


def executable_return(h: int) -> Column:
    """From the next bar's open to the close h bars ahead, in bps."""
    return (F.lead("close", h).over(by_time()) / F.lead("open", 1).over(by_time()) - 1) * 1e4


def direction_outcome(h: int) -> dict[str, Column]:
    """future close, LONG if it is higher, else SHORT (ties too); null without a full horizon."""
    future = F.lead("close", h).over(by_time())
    return {"future": future, "outcome": F.when(future > F.col("close"), "LONG").when(future.isNotNull(), "SHORT")}


def cost_excess(gross: Column, cost: float) -> Column:
    return F.signum(gross) * F.greatest(F.abs(gross) - cost, F.lit(0.0))


def barrier_labels(bars: DataFrame, horizon: int, take_bps: float, stop_bps: float, cost_bps: float, side: str = "LONG") -> DataFrame:
    """First touch of a trade's barriers within the next bars: reason, exit_bars, gross and net in bps, won. A short trade's take lies below, its stop above.

    A bar that touches both stops first; without a touch the trade ends at the last close. Rows without a full horizon go.
    The path is an array of bounded length from a window frame, searched in place.
    """
    path = F.collect_list(F.struct("high", "low", "close")).over(rows(1, horizon))
    d = bars.withColumn("_p", path).filter(F.size("_p") == horizon)
    sign = 1 if side == "LONG" else -1
    above, below = (take_bps, stop_bps) if sign > 0 else (stop_bps, take_bps)
    up, down = F.col("close") * (1 + above / 1e4), F.col("close") * (1 - below / 1e4)
    d = d.withColumns({"_up": up, "_down": down})
    hit = F.transform("_p", lambda b, k: F.when((b["high"] >= F.col("_up")) | (b["low"] <= F.col("_down")), k + 1))
    d = d.withColumn("exit_bars", F.coalesce(F.array_min(hit), F.lit(horizon)))
    bar = F.element_at("_p", F.col("exit_bars"))
    touched_up, touched_down = bar["high"] >= F.col("_up"), bar["low"] <= F.col("_down")
    d = d.withColumn("reason", F.when(touched_up & touched_down, "AMBIGUOUS_BAR_STOP_FIRST").when(touched_down if sign > 0 else touched_up, "STOP").when(touched_up if sign > 0 else touched_down, "TAKE_PROFIT").otherwise("HORIZON"))
    gross = F.when(F.col("reason") == "TAKE_PROFIT", take_bps).when(F.col("reason") == "HORIZON", (bar["close"] / F.col("close") - 1) * 1e4 * sign).otherwise(-stop_bps)
    d = d.withColumn("gross_bps", gross).withColumn("net_bps", F.col("gross_bps") - cost_bps)
    return d.withColumn("won", F.col("gross_bps") > 0).drop("_p", "_up", "_down")


class _Chain:
    """The trades of one block in order of start and end: after each the first that may follow, and the end of the last one that a chain from it keeps here."""

    def __init__(self, start: np.ndarray, end: np.ndarray, strict: bool) -> None:
        self.order = np.lexsort((end, start))
        self.start, self.end, self.side = start[self.order], end[self.order], "right" if strict else "left"
        n = len(self.start)
        self.next = np.append(np.maximum(np.searchsorted(self.start, self.end, self.side), np.arange(n) + 1), n)
        last, jump, self.jumps = np.arange(n + 1), self.next, [self.next]
        while (jump[:-1] < n).any():  # doubles the trades that a jump passes
            last = np.where(jump < n, last[jump], last)
            jump = jump[jump]
            self.jumps.append(jump)
        self.exit = self.end[last[:-1]]

    def place(self, after: np.ndarray) -> np.ndarray:
        """The first trade that may be kept after these ends."""
        return np.searchsorted(self.start, after, self.side)

    def kept(self, first: int) -> np.ndarray:
        """Rows of the chain from a trade on."""
        mark = np.zeros(len(self.next), bool)
        mark[first] = True
        for jump in reversed(self.jumps):
            mark[jump[mark]] = True
        return np.sort(self.order[mark[:-1]])


def non_overlapping(trades: DataFrame, key: str, start: str, end: str, *, strict: bool = False, block: float | None = None, carried: DataFrame | None = None) -> DataFrame:
    """Greedy, earliest first: a trade is kept if it starts at or after (strict: after) the end of the last kept one.

    A key is dealt over tasks by blocks of `block` in start (None: so wide that the densest key has some 65,536 trades in one). What a block
    keeps depends only on the end at which a chain enters it, and it leaves with one of few ends: those of the trades that are open at its edge.
    These ends are the nodes of a small graph, a block's exits point to those of the next block that they enter, and the exits on each key's chain
    are found by doubling the pointers, in as many rounds as the number of blocks has digits. Then each block picks its trades.

    carried (key, last): the last end that an earlier fold kept of a key; its trades must start at or after (strict: after) that.
    Trades without start or end are never kept; of trades with equal start and end one is kept (all, if they have no length and not strict),
    Spark's choice which. A null key is a key like others. An empty table stays empty.
    """
    spark, kind = trades.sparkSession, dict(trades.dtypes)[end]
    rest = [c for c in trades.columns if c not in (key, start, end)]
    d = trades.select(F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.struct(*rest).alias("_rest") if rest else F.lit(True).alias("_rest")).filter("_s is not null and _e is not null")
    if block is None:
        width = lambda: F.max("_s") - F.min("_s") + 1
        densest = d.groupBy("_k").agg((F.count("*") / width()).alias("n")).agg(F.max("n")).first()[0]
        block = max(65_536 / (densest or 1), 1e-9)
    at = lambda c: F.floor(c / block).cast("long")
    d = d.withColumn("_b", at(F.col("_s")))
    narrow = written(d.select("_k", "_b", "_s", "_e"), "spans")
    start_kind, key_kind = dict(narrow.dtypes)["_s"], dict(narrow.dtypes)["_k"]
    ends = f"_k {key_kind}, _b long, _e {kind}, _first boolean"

    def column(t: pa.Table, name: str) -> np.ndarray:
        return t.column(name).to_numpy()

    def exits(t: pa.Table) -> pa.Table:
        c = _Chain(column(t, "_s"), column(t, "_e"), strict)
        out = np.append(c.exit[0], np.unique(c.exit))
        same = lambda name: pa.chunked_array([pa.repeat(t.column(name)[0], len(out))])
        return pa.table({"_k": same("_k"), "_b": same("_b"), "_e": pa.array(out, t.schema.field("_e").type), "_first": np.arange(len(out)) == 0})

    found = written(narrow.groupBy("_k", "_b").applyInArrow(exits, ends), "exits")
    by_block = Window.partitionBy("_k").orderBy("_b")
    blocks = found.filter("_first").select("_k", "_b", F.lead("_b").over(by_block).alias("_next"), F.lead("_e").over(by_block).alias("_next_exit"))  # a row a block
    nodes = found.filter("not _first").select("_k", "_b", "_e", F.greatest(F.col("_b") + 1, at(F.col("_e"))).alias("_to"), F.lit(False).alias("_root"))
    roots = found.filter("_first").groupBy("_k").agg(F.min("_b").alias("_lo"))
    if carried is None:
        roots = roots.select("_k", (F.col("_lo") - 1).alias("_b"), F.lit(None).cast(kind).alias("_e"), F.col("_lo").alias("_to"), F.lit(True).alias("_root"))
    else:
        c = carried.select(F.col(key).alias("_c"), F.col("last").cast(kind).alias("_e")).groupBy("_c").agg(F.max("_e").alias("_e"))
        roots = roots.join(c, F.col("_k").eqNullSafe(F.col("_c")), "left").select("_k", (F.col("_lo") - 1).alias("_b"), "_e", F.greatest("_lo", at(F.col("_e"))).alias("_to"), F.lit(True).alias("_root"))
    # the first block at or after the one that a node points to
    ahead = Window.partitionBy("_k").orderBy(F.desc("_at"), F.desc("_is")).rowsBetween(Window.unboundedPreceding, 0)
    both = nodes.unionByName(roots).select("_k", F.col("_to").alias("_at"), F.lit(0).alias("_is"), "_b", "_e", "_root").unionByName(
        blocks.select("_k", F.col("_b").alias("_at"), F.lit(1).alias("_is"), F.lit(None).cast("long").alias("_b"), F.lit(None).cast(kind).alias("_e"), F.lit(None).cast("boolean").alias("_root")))
    asked = both.withColumn("_c", F.last(F.when(F.col("_is") == 1, F.col("_at")), ignorenulls=True).over(ahead)).filter("_is = 0 and _c is not null").select("_k", "_c", "_b", "_e", "_root")

    def enter(t: pa.Table, q: pa.Table) -> pa.Table:
        if not t.num_rows or not q.num_rows:
            return q.slice(0, 0).append_column("_out", pa.nulls(0, q.schema.field("_e").type))
        c = _Chain(column(t, "_s"), column(t, "_e"), strict)
        free = q.column("_e").is_null().to_numpy(zero_copy_only=False) if q.column("_e").null_count else np.zeros(q.num_rows, bool)
        place = np.where(free, 0, c.place(q.column("_e").fill_null(0).to_numpy()))
        out = np.append(c.exit, c.exit[:1])[place]
        return q.append_column("_out", pa.array(out, q.schema.field("_e").type, mask=place >= len(c.exit)))

    edge = f"_k {key_kind}, _c long, _b long, _e {kind}, _root boolean, _out {kind}"
    edges = narrow.withColumn("_c", F.col("_b")).groupBy("_k", "_c").cogroup(asked.groupBy("_k", "_c")).applyInArrow(enter, edge)
    # an entry after all trades of its block goes to the first trade of the next one
    e, n = edges.alias("e"), blocks.withColumnRenamed("_k", "_nk").withColumnRenamed("_b", "_nb")
    past = F.col("_out").isNull()
    edges = e.join(n, F.col("_k").eqNullSafe(F.col("_nk")) & (F.col("_c") == F.col("_nb")), "left").select(
        "_k", "_b", "_e", "_root", F.when(past, F.col("_next")).otherwise(F.col("_c")).alias("_c"), F.when(past, F.col("_next_exit")).otherwise(F.col("_out")).alias("_out")
    ).filter("_c is not null")
    edges = written(edges, "edges")
    node = lambda b, x: F.struct(F.col("_k").alias("k"), F.col(b).alias("b"), F.col(x).alias("x"))
    jump = edges.filter("not _root").select(node("_b", "_e").alias("_from"), node("_c", "_out").alias("_to"))
    on = edges.filter("_root").select(node("_c", "_out").alias("_n"))
    most = blocks.groupBy("_k").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    for _ in range(int(most).bit_length() if most > 1 else 0):
        on = written(on.unionByName(on.join(jump, F.col("_n").eqNullSafe(F.col("_from"))).select(F.col("_to").alias("_n"))).distinct(), "reached")
        a, b = jump.alias("a"), jump.select(F.col("_from").alias("_mid"), F.col("_to").alias("_end"))
        jump = written(a.join(b, F.col("_to").eqNullSafe(F.col("_mid"))).select("_from", F.col("_end").alias("_to")), "jumps")
    way = edges.filter("not _root").withColumn("_n", node("_b", "_e")).join(on.withColumnRenamed("_n", "_m"), F.col("_n").eqNullSafe(F.col("_m")), "left_semi")
    entries = way.select("_k", "_c", "_e").unionByName(edges.filter("_root").select("_k", "_c", "_e"))

    def pick(t: pa.Table, q: pa.Table) -> pa.Table:
        names = [key, start, end, "_rest"]
        t = t.select(["_k", "_s", "_e", "_rest"]).rename_columns(names)
        if not t.num_rows or not q.num_rows:
            return t.slice(0, 0)
        c = _Chain(column(t, start), column(t, end), strict)
        first = 0 if q.column("_e")[0].as_py() is None else int(c.place(np.array([q.column("_e")[0].as_py()]))[0])
        return t.take(pa.array(c.kept(first)))

    schema = T.StructType([T.StructField(key, trades.schema[key].dataType), T.StructField(start, trades.schema[start].dataType), T.StructField(end, trades.schema[end].dataType), T.StructField("_rest", d.schema["_rest"].dataType)])
    own = d.withColumn("_c", F.col("_b")).groupBy("_k", "_c").cogroup(entries.groupBy("_k", "_c")).applyInArrow(pick, schema)
    return own.select(*[F.col(c) if c in (key, start, end) else F.col(f"_rest.{c}") for c in trades.columns])


def last_exits(kept: DataFrame, key: str, end: str, carried: DataFrame | None = None) -> DataFrame:
    """(key, last): the last end that was kept of each key, in this fold or an earlier one: what the next fold carries on."""
    d = kept.select(key, F.col(end).alias("last"))
    return (d if carried is None else d.unionByName(carried.select(key, "last"))).groupBy(key).agg(F.max("last").alias("last"))
