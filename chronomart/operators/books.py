"""Order books by update group: the open book carried from block to block, states, latch, metrics and order flow on every slot of a grid.

A block is a stretch of time of one symbol and the unit of work. A first pass sums each block up to the last amount of each level; from these
rows comes the book that stands open at each block's start. A second pass folds a block's updates onto that book. Windows range over
a block, or over one row a block; no step orders or holds a whole symbol.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import overlapped, own

LEVELS = "array<struct<level:double,amount:double>>"
STATE = f"symbol string, block long, us long, segment long, carried boolean, seq long, bids {LEVELS}, asks {LEVELS}"
CELLS = 1 << 20  # groups times levels that are held at once


def _block(c: str, block_us: int) -> Column:
    """Blocks are right-closed, as slots are: (k - 1) * block_us < us <= k * block_us has number k."""
    return F.ceil(F.col(c) / block_us).cast("long")


def blocks_of(updates: DataFrame, block_us: int, whole_days: bool = False) -> DataFrame:
    """Every block from a symbol's first to its last, quiet ones too: symbol, block, open (a snapshot came before it), next_snapshot (block of the next one after it), last (block), first_us, last_us of the symbol.

    whole_days: from the start of the first day to the end of the last.
    """
    day = 86_400_000_000
    met = updates.groupBy("symbol", _block("us", block_us).alias("block")).agg(F.max(F.col("snapshot").cast("int")).alias("_s"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    ends = met.groupBy("symbol").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
    if whole_days:
        ends = ends.withColumns({"first_us": (F.floor((F.col("first_us") - 1) / day) * day + 1).cast("long"), "last_us": (F.ceil(F.col("last_us") / day) * day).cast("long")})
    last = _block("last_us", block_us)
    every = ends.select("symbol", F.explode(F.sequence(_block("first_us", block_us), last)).alias("block"), last.alias("last"), "first_us", "last_us")
    w = Window.partitionBy("symbol").orderBy("block")  # one row a block
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    snap = F.when(F.col("_s") == 1, F.col("block"))
    d = every.join(met.select("symbol", "block", "_s"), ["symbol", "block"], "left")
    return d.withColumns({"open": F.coalesce(F.max("_s").over(before), F.lit(0)) == 1, "next_snapshot": F.min(snap).over(after)}).drop("_s")


def open_books(updates: DataFrame, blocks: DataFrame, block_us: int) -> DataFrame:
    """(symbol, block, side, level, amount): the levels that stand at each block's start.

    A block leaves of each level its last amount, unless a snapshot came after it. That amount holds up to the level's next row or the next
    snapshot, and is open in all blocks that begin on the way: the carried value is the book as a map of rows.
    """
    at = _block("us", block_us).alias("block")
    last = updates.groupBy("symbol", at, "side", "level").agg(F.max(F.struct("us", "seq", "amount")).alias("_l"))
    cleared = updates.filter("snapshot").groupBy("symbol", at).agg(F.max("us").alias("_clear"))
    last = last.join(cleared, ["symbol", "block"], "left").filter("_clear is null or _l.us >= _clear")
    again = F.lead("block").over(Window.partitionBy("symbol", "side", "level").orderBy("block"))
    held = last.select("symbol", "block", "side", "level", F.col("_l.amount").alias("amount"), again.alias("_again")).filter("amount > 0")
    held = held.join(blocks.select("symbol", "block", "next_snapshot", "last"), ["symbol", "block"])
    until = F.least(F.coalesce("_again", "last"), F.coalesce("next_snapshot", "last"), F.col("last"))
    return held.filter(until > F.col("block")).select("symbol", F.explode(F.sequence(F.col("block") + 1, until)).alias("block"), "side", "level", "amount")


def _one_a_level(updates: DataFrame) -> DataFrame:
    """Of a level's rows in a group the one that counts, with the group's last seq of the level and whether any was of a snapshot: a block's fold does not grow with the rows of a time."""
    g = updates.groupBy("symbol", "us", "side", "level").agg(F.max(F.struct("seq", "amount")).alias("_l"), F.max("snapshot").alias("snapshot"))
    return g.select("symbol", "us", "_l.seq", "snapshot", "side", "level", "_l.amount")


def _fold(depth: int, block_us: int, cells: int):
    """The states of one block: its open book, then the book after each of its groups."""

    def fold(t: pa.Table) -> pa.Table:
        symbol, block = t.column("symbol")[0], t.column("block")[0].as_py()
        kind, us, seq, snap = (t.column(c).to_numpy() for c in ("kind", "us", "seq", "snapshot"))
        bid, level, amount = t.column("bid").to_numpy(zero_copy_only=False), t.column("level").to_numpy(), t.column("amount").to_numpy()
        is_open = bool((kind == 2).any() and snap[kind == 2].any())
        rows = kind < 2
        pair, of = np.unique(np.stack([np.where(bid, 0.0, 1.0), np.where(bid, -level, level)])[:, rows], axis=1, return_inverse=True)
        column = np.zeros(len(kind), np.int64)
        column[rows] = of.ravel()
        bids = int((pair[0] == 0).sum())  # best first, bids before asks
        price = np.abs(pair[1]) * np.sign(np.where(pair[0] == 0, -pair[1], pair[1]))
        state = np.zeros(pair.shape[1])
        state[column[kind == 0]] = amount[kind == 0]
        own = np.flatnonzero(kind == 1)
        times, group = np.unique(us[own], return_inverse=True)
        ids = np.full(len(times), np.iinfo(np.int64).min)
        np.maximum.at(ids, group, seq[own])
        clears = np.zeros(len(times), bool)
        clears[group[snap[own].astype(bool)]] = True
        by = np.lexsort((amount[own], seq[own], column[own], group))
        group, own = group[by], own[by]
        final = np.ones(len(own), bool)  # of a level's rows in a group the last
        final[:-1] = (group[1:] != group[:-1]) | (column[own][1:] != column[own][:-1])
        group, own = group[final], own[final]
        first = 0 if is_open else int(np.argmax(clears)) if clears.any() else len(times)
        segment = np.maximum.accumulate(np.where(clears, times, -1)) if len(times) else times
        sides: list[list[np.ndarray]] = [[], [], [], [], [], []]  # of bids and asks: levels, amounts, levels a row

        def put(m: np.ndarray) -> None:
            for k, part in enumerate((slice(0, bids), slice(bids, None))):
                stands = m[:, part] > 0
                r, c = np.nonzero(stands & (np.cumsum(stands, 1) <= depth))
                for place, x in zip(sides[3 * k : 3 * k + 3], (price[part][c], m[:, part][r, c], np.bincount(r, minlength=len(m))), strict=True):
                    place.append(x)

        if is_open:
            put(state[None])
        step = max(1, cells // max(len(state), 1))
        for a in range(first, len(times), step):
            b = min(a + step, len(times))
            m = np.full((b - a + 1, len(state)), np.nan)
            m[0] = state
            m[1:][clears[a:b]] = 0.0
            some = slice(*np.searchsorted(group, [a, b]))
            m[group[some] - a + 1, column[own[some]]] = amount[own[some]]
            since = np.maximum.accumulate(np.where(np.isnan(m), 0, np.arange(len(m))[:, None]), 0)
            m = np.take_along_axis(m, since, 0)
            state = m[-1]
            put(m[1:])
        n = len(times) - first
        us = np.concatenate([[(block - 1) * block_us] if is_open else [], times[first:]]).astype(np.int64)
        segment = np.concatenate([[-1] if is_open else [], segment[first:]]).astype(np.int64)
        cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        lists = []
        for k in (0, 3):
            cuts = np.concatenate([[0], np.cumsum(cat(sides[k + 2], np.int64))]).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(cat(sides[k], float)), pa.array(cat(sides[k + 1], float))], ["level", "amount"])))
        carried = np.arange(len(us)) < len(us) - n
        ids = np.concatenate([[0] if is_open else [], ids[first:]]).astype(np.int64)
        return pa.Table.from_arrays([pa.array([symbol.as_py()] * len(us), pa.string()), pa.array(np.full(len(us), block)), pa.array(us), pa.array(segment), pa.array(carried), pa.array(ids, mask=carried), *lists], ["symbol", "block", "us", "segment", "carried", "seq", "bids", "asks"])

    return fold


def books(updates: DataFrame, block_us: int, depth: int = 10, whole_days: bool = False) -> tuple[DataFrame, DataFrame]:
    """States and blocks of updates (symbol, us, seq, snapshot, side, level, amount).

    All rows of one time are a group. A group with any snapshot row clears the book first; an amount of 0 removes a level; of a level's rows
    in a group the one with the last seq counts (ties: the largest amount). Rows before a symbol's first snapshot belong to no book and go.
    Rows with a null among these columns go too; a level below 0 is a price like others.

    States: symbol, block, us, segment (time of the snapshot that the book goes back to; -1 if that lies before the block), carried (the open
    book at the block's left edge, no group of its own), seq (the last of the group; see latched), bids and asks: the best `depth` levels as arrays of (level, amount), best first.
    Blocks: see blocks_of. block_us must be a multiple of every step that is asked of the states.
    """
    u = updates.select("symbol", F.col("us").cast("long"), F.col("seq").cast("long"), "snapshot", "side", F.col("level").cast("double"), F.col("amount").cast("double")).dropna()
    u = _one_a_level(u)
    blocks = blocks_of(u, block_us, whole_days)
    none = {c: F.lit(0).cast(k) for c, k in (("us", "long"), ("seq", "long"), ("snapshot", "boolean"), ("level", "double"), ("amount", "double"), ("bid", "boolean"))}
    order = ["symbol", "block", "kind", "us", "seq", "snapshot", "bid", "level", "amount"]
    bid = (F.col("side") == "bid").alias("bid")
    carried = open_books(u, blocks, block_us).select("symbol", "block", "level", "amount", bid).withColumns({c: none[c] for c in ("us", "seq", "snapshot")} | {"kind": F.lit(0)})
    rows = u.select("symbol", _block("us", block_us).alias("block"), "us", "seq", "snapshot", bid, "level", "amount", F.lit(1).alias("kind"))
    edge = blocks.select("symbol", "block", F.col("open").alias("snapshot")).withColumns({c: none[c] for c in ("us", "seq", "bid", "level", "amount")} | {"kind": F.lit(2)})
    whole = rows.select(order).unionByName(carried.select(order)).unionByName(edge.select(order))
    return whole.groupBy("symbol", "block").applyInArrow(_fold(depth, block_us, CELLS), STATE), blocks


def latched(state: DataFrame) -> DataFrame:
    """Adds valid: both sides stand and do not cross, now and after every earlier group since the snapshot; an open book has the seq of the last group before it.

    Within a block that is a running minimum; over blocks the last verdict of a block with a snapshot or a fault is carried, one row a block.
    """
    bid, ask = F.get("bids", F.lit(0))["level"], F.get("asks", F.lit(0))["level"]
    own = Window.partitionBy("symbol", "block", "segment").orderBy("us").rowsBetween(Window.unboundedPreceding, 0)
    d = state.withColumn("_bad", F.when(F.col("carried"), 0).otherwise((~F.coalesce(bid < ask, F.lit(False))).cast("int")))
    tail = d.groupBy("symbol", "block", "segment").agg(F.max("_bad").alias("_bad"), F.max_by("seq", "us").alias("_seq")).groupBy("symbol", "block").agg(F.max(F.struct("segment", "_bad", "_seq")).alias("_t"))
    verdict = F.when((F.col("_t.segment") >= 0) | (F.col("_t._bad") == 1), F.col("_t._bad"))
    earlier = Window.partitionBy("symbol").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.last(verdict, ignorenulls=True).over(earlier).alias("_before"), F.last("_t._seq", ignorenulls=True).over(earlier).alias("_id")]
    d = d.join(tail.select("symbol", "block", *before), ["symbol", "block"])
    fault = F.max("_bad").over(own) + F.when(F.col("segment") >= 0, 0).otherwise(F.coalesce("_before", F.lit(0)))
    return d.withColumns({"valid": fault == 0, "seq": F.coalesce("seq", "_id")}).drop("_bad", "_before", "_id")


def slots_of(blocks: DataFrame, step_us: int, block_us: int) -> DataFrame:
    """(symbol, block, slot): every slot of the grid from the one of a symbol's first time to that of its last."""
    up = lambda c: (F.ceil(F.col(c) / step_us) * step_us).cast("long")
    left, right = (F.col("block") - 1) * block_us + step_us, F.col("block") * block_us
    d = blocks.withColumns({"_from": F.greatest(left, up("first_us")), "_to": F.least(right, up("last_us"))}).filter("_from <= _to")
    return d.select("symbol", "block", F.explode(F.sequence("_from", "_to", F.lit(step_us).cast("long"))).alias("slot"))


def at_slots(state: DataFrame, slots: DataFrame) -> DataFrame:
    """The state at every slot, of all groups up to it. Slots without a book have valid = false and null levels."""
    rest = ["bids", "asks", "valid", "seq"]
    w = Window.partitionBy("symbol", "block").orderBy("_at", "_slot").rowsBetween(Window.unboundedPreceding, 0)
    one = state.select("symbol", "block", F.col("us").alias("_at"), F.lit(0).alias("_slot"), F.struct(*rest).alias("_r"))
    two = slots.select("symbol", "block", F.col("slot").alias("_at"), F.lit(1).alias("_slot"), F.lit(None).cast(one.schema["_r"].dataType).alias("_r"))
    d = one.unionByName(two).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_slot = 1")
    return d.select("symbol", F.col("_at").alias("slot"), "_r.bids", "_r.asks", F.coalesce("_r.valid", F.lit(False)).alias("valid"), "_r.seq")


def book_metrics(slots: DataFrame, depths: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Best prices and quantities, mid, spread and microprice offset in bps, microprice, depth and imbalance of the first levels; null where the book is not valid."""
    b0, a0 = F.get("bids", F.lit(0)), F.get("asks", F.lit(0))
    bp, ap, bq, aq = b0["level"], a0["level"], b0["amount"], a0["amount"]
    mid, micro = (bp + ap) / 2, (bp * aq + ap * bq) / (bq + aq)
    out = {"bid": bp, "ask": ap, "bid_qty": bq, "ask_qty": aq, "mid": mid, "spread_bps": (ap - bp) / mid * 1e4, "microprice": micro, "microprice_bps": (micro / mid - 1) * 1e4}
    total = lambda c, n: F.aggregate(F.slice(c, 1, n), F.lit(0.0), lambda s, x: s + x["amount"])
    for n in depths:
        b, a = total("bids", n), total("asks", n)
        out |= {f"bid_depth{n}": b, f"ask_depth{n}": a, f"imbalance{n}": (b - a) / (b + a)}
    return slots.select("symbol", "slot", "valid", *[F.when(F.col("valid"), c).alias(k) for k, c in out.items()])


def _change(sign: int):
    """What a rank adds: a better price its quantity, an equal one the change, a worse one takes off the old quantity; a rank on one side only counts in full."""

    def change(old: Column, new: Column) -> Column:
        up, same = (new["level"] - old["level"]) * sign > 0, new["level"] == old["level"]
        return F.when(old.isNull(), new["amount"]).when(new.isNull(), -old["amount"]).when(up, new["amount"]).when(same, new["amount"] - old["amount"]).otherwise(-old["amount"])

    return change


def order_flow(state: DataFrame, slots: DataFrame, step_us: int, depths: tuple[int, ...] = (1, 5, 10), near: int = 5) -> DataFrame:
    """By slot: order-flow imbalance of the first ranks, and quantity replenished and depleted at the nearest prices of a side, summed over update groups, 0 where nothing happened; snapshots: groups with one.

    Each group is taken against the state before it in its block, the first against the open book; a snapshot adds nothing and clears what its slot has summed so far.
    """
    w = Window.partitionBy("symbol", "block").orderBy("us")
    d = state.withColumns({"_b": F.lag("bids").over(w), "_a": F.lag("asks").over(w)}).filter("not carried")

    def flow(old: str, new: str, n: int, sign: int) -> Column:
        return F.aggregate(F.zip_with(F.slice(old, 1, n), F.slice(new, 1, n), _change(sign)), F.lit(0.0), lambda s, x: s + x)

    def moved(old: str, new: str, sign: int) -> Column:
        held = lambda a: F.map_from_entries(F.slice(a, 1, near))
        both = F.map_zip_with(held(old), held(new), lambda k, x, y: F.greatest((F.coalesce(y, F.lit(0.0)) - F.coalesce(x, F.lit(0.0))) * sign, F.lit(0.0)))
        return F.aggregate(F.map_values(both), F.lit(0.0), lambda s, x: s + x)

    parts = {f"ofi{n}": flow("_b", "bids", n, 1) - flow("_a", "asks", n, -1) for n in depths}
    for name, sign in (("replenished", 1), ("depleted", -1)):
        parts |= {f"bid_{name}": moved("_b", "bids", sign), f"ask_{name}": moved("_a", "asks", sign)}
    slot = (F.ceil(F.col("us") / step_us) * step_us).cast("long").alias("slot")
    snapshot = F.col("us") == F.col("segment")
    d = d.select("symbol", slot, "segment", snapshot.cast("long").alias("snapshots"), *[F.when(snapshot, 0.0).otherwise(c).alias(k) for k, c in parts.items()])
    quiet = slots.select("symbol", "slot", F.lit(-2).cast("long").alias("segment"), F.lit(0).cast("long").alias("snapshots"), *[F.lit(0.0).alias(k) for k in parts])
    per = d.unionByName(quiet).groupBy("symbol", "slot", "segment").agg(*[F.sum(c).alias(c) for c in ("snapshots", *parts)])
    return per.groupBy("symbol", "slot").agg(F.max_by(F.struct(*parts), "segment").alias("_p"), F.sum("snapshots").alias("snapshots")).select("symbol", "slot", "_p.*", "snapshots")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, (a - b) / F.when(a + b > 0, a + b)).otherwise(0.0)


def slot_trades(trades: DataFrame, step_us: int, after: DataFrame | None = None) -> DataFrame:
    """(symbol, slot, buy_qty, sell_qty, buys, sells) of right-closed slots. after (symbol, slot, us): of these slots only trades later than us count."""
    d = trades.select("symbol", (F.ceil(F.col("us") / step_us) * step_us).cast("long").alias("slot"), F.col("us").alias("_us"), "qty", "buyer_maker")
    if after is not None:
        d = d.join(after.select("symbol", "slot", F.col("us").alias("_cut")), ["symbol", "slot"], "left").filter("_cut is null or _us > _cut")
    sell = F.col("buyer_maker")
    part = lambda f: F.sum(F.when(f, F.col("qty")).otherwise(0.0))
    return d.groupBy("symbol", "slot").agg(part(~sell).alias("buy_qty"), part(sell).alias("sell_qty"), F.count_if(~sell).alias("buys"), F.count_if(sell).alias("sells"))


def flow_block(metrics: DataFrame, flow: DataFrame, trades: DataFrame, step_us: int, block: int = 4096, short: int = 4, long: int = 12) -> DataFrame:
    """43 columns of every slot, in three layers that are null where they do not hold.

    Layer 0 (11, where the book is valid): spread, microprice offset, imbalance of the first 1, 5 and 10 levels, log quantities and depths.
    Layer 1 (15): order flow of 1, 5 and 10 ranks and imbalance of traded quantity and count over one slot, `short` and `long` slots. It holds
    from slot number `long` on, where layer 0 does and the flow of the last `long` slots is whole: the book valid at their ends, and no snapshot in them.
    Layer 2 (17): changes of imbalances, spread and microprice offset over 1 and `short` slots, quantity replenished and depleted over `short`
    slots, and three products. It holds where layer 1 does and the books 1 and `short` slots before are valid.

    metrics, flow and trades: see book_metrics, order_flow and slot_trades, on one grid. `block` slots, with those they reach back to, are one task's.
    """
    zero = ("buy_qty", "sell_qty", "buys", "sells")
    d = metrics.join(flow, ["symbol", "slot"]).join(trades, ["symbol", "slot"], "left").fillna(0, subset=list(zero))
    first = metrics.groupBy("symbol").agg(F.min("slot").alias("_first"))
    d = d.join(first, "symbol").withColumn("_k", ((F.col("slot") - F.col("_first")) / step_us).cast("long")).drop("_first")
    d = d.withColumn("_whole", (F.col("valid") & (F.col("snapshots") == 0)).cast("int"))
    d, order = overlapped(d, ["symbol"], "_k", block, long)
    total = lambda c, n: F.sum(c).over(order.rowsBetween(-(n - 1), 0)).cast("double")
    back = lambda c, n: F.lag(c, n).over(order)
    spans = {"slot": 1, "short": short, "long": long}
    log = lambda c: F.log1p(F.greatest(F.col(c), F.lit(0.0)))
    zeroth = {"spread_bps": F.col("spread_bps"), "microprice_bps": F.col("microprice_bps"), **{f"imbalance{n}": F.col(f"imbalance{n}") for n in (1, 5, 10)}}
    zeroth |= {f"log_{c}": log(c) for c in ("bid_qty", "ask_qty", "bid_depth5", "ask_depth5", "bid_depth10", "ask_depth10")}
    one = {f"ofi{n}_{k}": total(f"ofi{n}", m) for n in (1, 5, 10) for k, m in spans.items()}
    one |= {f"trade_qty_{k}": _ratio(total("buy_qty", m), total("sell_qty", m)) for k, m in spans.items()}
    one |= {f"trade_count_{k}": _ratio(total("buys", m), total("sells", m)) for k, m in spans.items()}
    two = {f"d_{c}_{k}": F.col(c) - back(c, m) for c in ("imbalance1", "imbalance5", "imbalance10", "spread_bps", "microprice_bps") for k, m in (("slot", 1), ("short", short))}
    two |= {f"{c}_short": total(c, short) for c in ("bid_replenished", "ask_replenished", "bid_depleted", "ask_depleted")}
    two |= {"trade_qty_x_imbalance5": one["trade_qty_short"] * F.col("imbalance5"), "trade_qty_x_microprice": one["trade_qty_short"] * F.col("microprice_bps"), "ofi5_x_spread": one["ofi5_short"] * F.col("spread_bps")}
    valid0 = F.col("valid")
    valid1 = valid0 & (F.col("_k") >= long) & (F.min("_whole").over(order.rowsBetween(-(long - 1), 0)) == 1)
    valid2 = valid1 & F.coalesce(back("valid", 1) & back("valid", short), F.lit(False))
    out = [F.when(ok, c).alias(k) for ok, layer in ((valid0, zeroth), (valid1, one), (valid2, two)) for k, c in layer.items()]
    d = d.select("symbol", "slot", "_own", "_b", valid0.alias("valid0"), valid1.alias("valid1"), valid2.alias("valid2"), *out)
    return own(d)


def sampled_rows(state: DataFrame, slots: DataFrame, trades: DataFrame, step_us: int) -> DataFrame:
    """The book and its slot's trades, one row for each slot at which the book is valid: 25 columns.

    Trades up to the last time within the slot at which the book was not valid do not count, as their bucket is cleared then. Columns: symbol, slot,
    the book's metrics of 1, 5 and 10 levels (spread and microprice offset in bps), quantities and counts of buys and sells, both imbalances, valid and last_id.
    """
    cut = state.filter("not valid and not carried").groupBy("symbol", (F.ceil(F.col("us") / step_us) * step_us).cast("long").alias("slot")).agg(F.max("us").alias("us"))
    at = at_slots(state, slots)
    d = book_metrics(at).filter("valid").join(at.select("symbol", "slot", F.col("seq").alias("last_id")), ["symbol", "slot"])
    d = d.join(slot_trades(trades, step_us, cut), ["symbol", "slot"], "left").fillna(0, subset=["buy_qty", "sell_qty", "buys", "sells"])
    more = {"qty_imbalance": _ratio(F.col("buy_qty"), F.col("sell_qty")), "count_imbalance": _ratio(F.col("buys"), F.col("sells"))}
    return d.withColumns(more).drop("bid_depth1", "ask_depth1")
