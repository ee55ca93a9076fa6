"""Trade and book grids: buckets, carried prices, rolling flow, gap segments, level metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import overlapped, own, running


def trade_buckets(ticks: DataFrame, seconds: int) -> DataFrame:
    """By symbol and slot: quantity, count and notional of buys and sells (a buyer that made the market sells), last price by time."""
    slot = F.floor(F.col("us") / (seconds * 1_000_000)).cast("long") * seconds
    sell = F.col("buyer_maker")
    part = lambda c, f: F.sum(F.when(f, c).otherwise(F.lit(0.0)))
    return ticks.withColumn("t", slot).groupBy("symbol", "t").agg(
        part(F.col("qty"), ~sell).alias("buy_qty"), part(F.col("qty"), sell).alias("sell_qty"), F.count_if(~sell).alias("buys"), F.count_if(sell).alias("sells"),
        part(F.col("qty") * F.col("price"), ~sell).alias("buy_notional"), part(F.col("qty") * F.col("price"), sell).alias("sell_notional"),
        F.max_by("price", F.struct("us", "tick_id")).alias("price"),
    )


def filled_grid(buckets: DataFrame, step: int, block: int = 4096) -> DataFrame:
    """Every slot between a symbol's first and last one: sums are 0 and the price is carried where nothing traded. `block` slots are one task's."""
    wide = block * step
    ends = buckets.groupBy("symbol").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    blocks = ends.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / wide), F.floor(F.col("hi") / wide))))
    # slots are counted from the first one, so that a block starts with the first of them in it
    first = F.col("lo") + F.greatest(F.ceil((F.col("_b") * wide - F.col("lo")) / step), F.lit(0)) * step
    inside = blocks.withColumns({"_from": first.cast("long"), "_to": F.least("hi", (F.col("_b") + 1) * wide - 1).cast("long")}).filter("_from <= _to")
    g = inside.select("symbol", F.explode(F.sequence("_from", "_to", F.lit(step).cast("long"))).alias("t")).join(buckets, ["symbol", "t"], "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("buy_qty", "sell_qty", "buys", "sells", "buy_notional", "sell_notional")}
    return running(g.withColumns(zero), ["symbol"], ["t"], wide, {"price": ("last", F.col("price"))}).select(*buckets.columns)


def flow_features(ticks: DataFrame, block: int = 4096) -> DataFrame:
    """17 features of every second from a symbol's fourth on, seconds without a trade too, a label, and the carried price.

    ret1 and ret3: log returns in bps over 1 and 3 s; quantity and count imbalance over 1, 3, 5 and 10 s; log quantity and count over 1 and 5 s; buy
    against sell VWAP over 5 s in bps (0 unless both traded); whether buys and sells are there. label: log return over the next 10 s, null
    without a full horizon. Windows are shorter at a symbol's start. `block` seconds, with those its windows reach, are one task's.
    """
    d, order = overlapped(filled_grid(trade_buckets(ticks, 1), 1, block), ["symbol"], "t", block, 9, 10)
    s = lambda c, n: F.sum(c).over(order.rowsBetween(-(n - 1), 0))
    over = lambda x, y: F.when(y > 0, x / F.when(y > 0, y))
    out = {f"ret{k}": F.log(F.col("price") / F.lag("price", k).over(order)) * 1e4 for k in (1, 3)}
    for n in (1, 3, 5, 10):
        for name, a, b in (("qty", "buy_qty", "sell_qty"), ("count", "buys", "sells")):
            out[f"{name}_imbalance{n}"] = F.coalesce(over((s(a, n) - s(b, n)).cast("double"), s(a, n) + s(b, n)), F.lit(0.0))
    for n in (1, 5):
        out |= {f"log_qty{n}": F.log1p(s("buy_qty", n) + s("sell_qty", n)), f"log_count{n}": F.log1p((s("buys", n) + s("sells", n)).cast("double"))}
    gap = over(s("buy_notional", 5), s("buy_qty", 5)) / over(s("sell_notional", 5), s("sell_qty", 5))
    out |= {"vwap_gap_bps": F.coalesce((gap - 1) * 1e4, F.lit(0.0)), "has_buys": F.col("buys") > 0, "has_sells": F.col("sells") > 0}
    label = F.log(F.lead("price", 10).over(order) / F.col("price")) * 1e4
    d = own(d.select("symbol", "t", "price", "_own", "_b", *[c.alias(k) for k, c in out.items()], label.alias("label")))
    first = ticks.groupBy("symbol").agg(F.floor(F.min("us") / 1_000_000).alias("_first"))
    return d.join(first, "symbol").filter(F.col("t") >= F.col("_first") + 3).drop("_first")


def gap_segments(d: DataFrame, most_us: int, block: int | None = 86_400_000_000) -> DataFrame:
    """Adds segment: a new one begins where the gap exceeds `most_us`, or this or the last row is invalid. Symbols are dealt over tasks by blocks of us."""
    order = ["us", "tick_id"]
    d = running(d, ["symbol"], order, block, {"_us": ("previous", F.col("us")), "_ok": ("previous", F.col("valid"))})
    cut = (F.col("us") - F.col("_us") > most_us) | ~F.col("valid") | ~F.col("_ok")
    return running(d, ["symbol"], order, block, {"segment": ("sum", F.coalesce(cut, F.lit(False)).cast("int"))}).drop("_us", "_ok")


def window_imbalance(ticks: DataFrame, seconds: int) -> DataFrame:
    """Quantity imbalance over (us - window, us] at each tick, on integer time.

    A block is as long as the window, so a window is the end of one block and the start of the next: each row counts into its own block's running sum
    and, moved on by the window, into the next block's sum from behind. No frame slides, work is that of two sorts of each block, and a task holds one.
    """
    wide = seconds * 1_000_000
    sign = F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))
    rows = ticks.select("symbol", F.floor(F.col("us") / wide).alias("_b"), F.col("us").alias("_at"), F.col("qty").alias("_q"), sign.alias("_s"), F.struct(*ticks.columns).alias("_row"))
    # a row of the block before is within the window of us up to its own time and the window's length less one
    before = rows.filter("_at is not null").select("symbol", (F.col("_b") + 1).alias("_b"), (F.col("_at") + wide - 1).alias("_at"), F.col("_q").alias("_q0"), F.col("_s").alias("_s0"))
    d = rows.unionByName(before, allowMissingColumns=True)
    each = Window.partitionBy("symbol", "_b")
    so_far, on = (each.orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.col("_at"), F.desc("_at")))
    both = {c: F.coalesce(F.sum(f"_{c}").over(so_far) + F.sum(f"_{c}0").over(on), F.sum(f"_{c}").over(so_far), F.sum(f"_{c}0").over(on)) for c in "qs"}
    d = d.withColumns({"_total": both["q"], "_signed": both["s"]}).filter("_row is not null")
    return d.select("_row.*", F.when(F.col("_total") > 0, F.col("_signed") / F.when(F.col("_total") > 0, F.col("_total"))).otherwise(0.0).alias("imbalance"))


def ceil_slots(ticks: DataFrame, step_us: int) -> DataFrame:
    """Distinct grid slots at or after each row's time (right-closed)."""
    return ticks.select("symbol", (F.ceil(F.col("us") / step_us) * step_us).cast("long").alias("slot_us")).distinct()


def trade_bins(ticks: DataFrame, step_us: int) -> DataFrame:
    """Right-closed trade bins. After the first trade exactly on a grid time its slot is out, so others of that instant fall in the next."""
    w = Window.partitionBy("symbol", "us").orderBy("tick_id")
    late = (F.col("us") % step_us == 0) & (F.row_number().over(w) > 1)
    slot = (F.ceil(F.col("us") / step_us) * step_us + F.when(late, step_us).otherwise(0)).cast("long")
    buy = F.col("side") == "buy"
    return ticks.withColumn("_late", late).withColumn("slot_us", slot).groupBy("symbol", "slot_us").agg(
        F.sum(F.when(buy, F.col("qty")).otherwise(F.lit(0.0))).alias("buy_qty"), F.sum(F.when(~buy, F.col("qty")).otherwise(F.lit(0.0))).alias("sell_qty"), F.count_if(buy).alias("buys"), F.count_if(~buy).alias("sells")
    )


def valid_flow(grid: DataFrame, short: int, long: int) -> DataFrame:
    """Quantity imbalance over `short` and `long` slots, null unless that many slots exist and all are valid."""
    w = lambda n: Window.partitionBy("symbol").orderBy("t").rowsBetween(-(n - 1), 0)

    def block(n: int) -> Column:
        buy, sell = F.sum("buy_qty").over(w(n)), F.sum("sell_qty").over(w(n))
        ok = (F.count("*").over(w(n)) == n) & (F.min(F.col("valid").cast("int")).over(w(n)) == 1)
        return F.when(ok, F.when(buy + sell > 0, (buy - sell) / F.when(buy + sell > 0, buy + sell)).otherwise(0.0))

    return grid.select("symbol", "t", block(short).alias("short_imbalance"), block(long).alias("long_imbalance"))
