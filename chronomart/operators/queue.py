"""Passive orders: candidates, the trades that may fill them, replay of the queue ahead of them, and metrics of policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof
from .metrics import quantiles
from .running import running


def candidates(quotes: DataFrame, spacing_us: int, limit: Column, queue: Column, signed: dict[str, Column]) -> DataFrame:
    """One order a symbol and slot of time, at the slot's first microsecond, from the latest quote before it.

    Even slots buy and odd ones sell, also where slots are empty. Features are multiplied by the side (1 or -1). A slot
    without a quote in the one before has no order.
    """
    slot = F.floor(F.col("us") / spacing_us).cast("long") + 1
    last = quotes.groupBy("symbol", slot.alias("slot")).agg(F.max_by(F.struct(*quotes.columns), F.struct("us", "tick_id")).alias("q"))
    d = last.select("slot", "q.*").withColumn("sign", F.when(F.col("slot") % 2 == 0, 1).otherwise(-1))
    out = {k: (c * F.col("sign")).alias(k) for k, c in signed.items()}
    return d.select("symbol", "slot", (F.col("slot") * spacing_us).alias("decision_us"), "sign", limit.alias("limit"), queue.alias("queue"), *out.values())


def attach(orders: DataFrame, trades: DataFrame, spacing_us: int) -> DataFrame:
    """Trades (symbol, us, tick_id, level, side, qty, kind) of an order: in its slot, after its decision, at its limit, from the other side.

    An equality join on symbol, slot and limit; a slot belongs to one order only, so rows do not multiply.
    """
    t = trades.withColumn("slot", F.floor(F.col("us") / spacing_us).cast("long")).withColumnRenamed("level", "limit")
    j = orders.join(t, ["symbol", "slot", "limit"])
    other = F.when(F.col("sign") == 1, "sell").otherwise("buy")
    return j.filter((F.col("us") > F.col("decision_us")) & (F.col("side") == other))


def replay(orders: DataFrame, events: DataFrame, *, size: float, latency_us: int, timeout_us: int, credit: float) -> DataFrame:
    """What each order fills. Trades drain the queue ahead and fill beyond it; inferred cancels drain it by `credit` of their quantity.

    Events count after the order has arrived (decision + latency) and before its cancel takes effect: timeout + latency, or
    first fill + latency if that is earlier. Trades come before cancels of the same instant. The queue left before an event is the first queue less all
    drained before, so one running sum replaces a loop. Adds filled, first_fill_us, status.
    """
    e = events.filter(F.col("us") > F.col("decision_us") + latency_us).filter(F.col("us") < F.col("decision_us") + timeout_us + latency_us)
    w = Window.partitionBy("symbol", "slot").orderBy("us", (F.col("kind") != "trade").cast("int"), "tick_id")
    drain = F.when(F.col("kind") == "trade", F.col("qty")).otherwise(credit * F.col("qty"))
    before = F.coalesce(F.sum(drain).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ahead = F.greatest(F.col("queue") - before, F.lit(0.0))
    e = e.withColumn("fill", F.when(F.col("kind") == "trade", F.greatest(F.col("qty") - ahead, F.lit(0.0))).otherwise(F.lit(0.0)))
    first = F.min(F.when(F.col("fill") > 0, F.col("us"))).over(Window.partitionBy("symbol", "slot"))
    e = e.withColumn("first_fill_us", first).filter(F.col("us") < F.col("first_fill_us") + latency_us)
    f = e.groupBy("symbol", "slot").agg(F.least(F.sum("fill"), F.lit(size)).alias("filled"), F.min("first_fill_us").alias("first_fill_us"))
    d = orders.join(f, ["symbol", "slot"], "left").withColumn("filled", F.coalesce("filled", F.lit(0.0)))
    return d.withColumn("status", F.when(F.col("filled") >= size, "filled").when(F.col("filled") > 0, "partial").otherwise("miss"))


def policy_metrics(orders: DataFrame, policies: dict[str, Column], *, cost: float, stress: float, block: int = 86_400_000_000) -> DataFrame:
    """What each policy's orders come to, whole (null sign) and by side: rates, waits, queues, net results of fills, their tails and how they spread over days and hours.

    orders: symbol, decision_us, sign, status, queue, first_fill_us, gross (bps, null without fill), adverse. cost and stress (bps) give net
    and stressed results. Days are those of decisions, idle ones too, hours those of first fills; a concentration is the best one's share of all
    gains, 1 without gains. The drawdown is additive from the running peak (from 0), in order of decisions; ratios without a divisor are infinite for a
    gain, else 0. A row is copied twice for each policy that takes it. Empty tables give none.
    """
    hit, by = F.col("status") != "miss", ["policy", "side"]
    chosen = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in policies.items()]))
    d = orders.withColumn("policy", F.explode(chosen)).withColumn("side", F.explode(F.array(F.lit(0), F.col("sign").cast("int"))))
    d = d.select(
        *by, "symbol", "decision_us", "status", "queue", "gross", "adverse", (F.col("gross") - cost).alias("net"), (F.col("gross") - stress).alias("stress"),
        F.when(hit, F.col("first_fill_us") - F.col("decision_us")).alias("wait_us"), F.floor(F.col("decision_us") / 86_400_000_000).alias("day"), F.floor(F.col("first_fill_us") / 3_600_000_000).alias("hour"),
    )
    rate = lambda c: F.avg(c.cast("double"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    net = F.col("net")
    out = d.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(hit).alias("filled_orders"), F.count_if(F.col("status") == "filled").alias("full_fills"), F.count_if(F.col("status") == "partial").alias("partial_fills"),
        rate(hit).alias("fill_rate"), rate(F.col("status") == "partial").alias("partial_rate"), rate(~hit).alias("timeout_rate"), rate(F.col("status") != "filled").alias("cancel_rate"),
        F.avg("wait_us").alias("mean_wait_us"), F.max("wait_us").alias("longest_wait_us"), F.avg("queue").alias("mean_queue"),
        F.avg("gross").alias("mean_gross"), F.avg("net").alias("mean_net"), F.avg("stress").alias("mean_stress"),
        total("gross").alias("total_gross"), total("net").alias("total_net"), total("stress").alias("total_stress"), total(F.col("gross") - net).alias("total_fees"),
        total(F.when(net > 0, net)).alias("_gain"), total(F.when(net < 0, -net)).alias("_loss"), F.min("net").alias("worst_net"), F.avg(F.when(hit, F.col("adverse").cast("double"))).alias("adverse_rate"),
    )

    def spread(rows: DataFrame, unit: str) -> DataFrame:
        gain = F.greatest("_x", F.lit(0.0))
        each = rows.groupBy(*by, unit).agg(total("net").alias("_x"))
        share = F.max(gain) / F.when(F.sum(gain) > 0, F.sum(gain))
        return each.groupBy(*by).agg(F.count("*").alias(f"{unit}s"), rate(F.col("_x") > 0).alias(f"positive_{unit}s"), F.coalesce(share, F.lit(1.0)).alias(f"{unit}_concentration"))

    fills, order = d.filter(hit), ["decision_us", "symbol"]
    curve = running(fills, by, order, block, {"_eq": ("sum", net)})
    curve = running(curve, by, order, block, {"_peak": ("max", F.col("_eq"))}).groupBy(*by).agg(F.max(F.greatest("_peak", F.lit(0.0)) - F.col("_eq")).alias("drawdown"))
    levels = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
    parts = [
        spread(d, "day"), spread(fills, "hour"), curve, quantiles(d, by, F.col("wait_us"), {f"wait_{k}": q for k, q in levels.items()}),
        quantiles(d, by, F.col("queue"), {f"queue_{k}": q for k, q in levels.items()}), quantiles(d, by, net, {"net_p01": 0.01, "net_p05": 0.05}),
    ]
    for p in parts:
        out = out.join(p, by, "left")
    out = out.fillna({"drawdown": 0.0, "hours": 0, "positive_hours": 0.0, "hour_concentration": 1.0})
    ratio = lambda a, b, gain: F.when(F.col(b) > 0, F.col(a) / F.when(F.col(b) > 0, F.col(b))).when(F.col(gain) > 0, F.lit(float("inf"))).otherwise(0.0)
    out = out.withColumns({"profit_factor": ratio("_gain", "_loss", "_gain"), "total_over_drawdown": ratio("total_net", "drawdown", "total_net"), "fills_a_day": F.col("filled_orders") / F.col("days")})
    return out.withColumn("sign", F.when(F.col("side") != 0, F.col("side"))).drop("side", "_gain", "_loss")


def markouts(orders: DataFrame, prices: DataFrame, horizons: dict[str, int], block: int = 86_400_000_000) -> DataFrame:
    """What the price did after each first fill: symbol, slot, horizon, markout (bps, in the order's favour), from the last price (symbol, us, price) at or before first_fill_us + horizon.

    orders: symbol, slot, sign, first_fill_us (null without a fill: no row), fill_price. All horizons are one as-of join, dealt by blocks of time; without any price before, the markout is null.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("horizon"), F.lit(h).cast("long").alias("_h")) for k, h in horizons.items()])).alias("_e")
    d = orders.filter("first_fill_us is not null").select("symbol", "slot", "sign", "first_fill_us", "fill_price", each)
    d = d.select("symbol", "slot", "sign", "fill_price", "_e.horizon", (F.col("first_fill_us") + F.col("_e._h")).alias("us"))
    j = asof(d, prices.select("symbol", "us", "price"), ["price"], on="us", by=["symbol"], block=block)
    return j.select("symbol", "slot", "horizon", (F.col("sign") * (F.col("price") / F.col("fill_price") - 1) * 1e4).alias("markout"))


def policy_markouts(orders: DataFrame, policies: dict[str, Column], marks: DataFrame, horizons: list[str]) -> DataFrame:
    """By policy, and by policy and side (null sign: both), in one pass of grouping sets: orders, those that met no queue at arrival, quantiles of order size over the depth ahead, and for each horizon the
    mean markout of fills and the share of them that it went against.

    orders: symbol, slot, sign, size, queue; a row for each policy that takes it. marks: see markouts; fills without a markout do not count. A depth of 0 has no ratio.
    """
    wide = marks.groupBy("symbol", "slot").agg(*[F.max(F.when(F.col("horizon") == h, F.col("markout"))).alias(f"_{h}") for h in horizons])
    chosen = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in policies.items()]))
    d = orders.withColumn("policy", F.explode(chosen)).join(wide, ["symbol", "slot"], "left")
    ratio = F.col("size") / F.when(F.col("queue") > 0, F.col("queue"))
    out = [F.count("*").alias("orders"), F.count_if(F.col("queue") <= 0).alias("first_in_queue"), *[F.percentile(ratio, F.lit(q)).alias(f"depth_ratio_{k}") for k, q in (("p50", 0.5), ("p90", 0.9))]]
    for h in horizons:
        out += [F.avg(f"_{h}").alias(f"markout_{h}"), F.avg((F.col(f"_{h}") < 0).cast("double")).alias(f"adverse_{h}")]
    d = d.withColumn("side", F.col("sign").cast("int"))
    return d.groupingSets([[F.col("policy")], [F.col("policy"), F.col("side")]], "policy", "side").agg(*out).withColumnRenamed("side", "sign")


def policy_deltas(metrics: DataFrame, base: str) -> DataFrame:
    """What each other policy changes against the base policy, whole and by side; null where either has no value. A side that the base lacks is left out."""
    names = ("mean_net", "total_net", "filled_orders", "fill_rate", "adverse_rate")
    own = metrics.select("policy", "sign", *names, "total_fees")
    b = own.filter(F.col("policy") == base).select(F.col("sign").alias("_sign"), *[F.col(c).alias(f"_{c}") for c in (*names, "total_fees")])
    j = own.filter(F.col("policy") != base).join(b, F.col("sign").eqNullSafe(F.col("_sign")))
    return j.select("policy", "sign", *[(F.col(c) - F.col(f"_{c}")).alias(f"{c}_delta") for c in names], (F.col("_total_fees") - F.col("total_fees")).alias("fees_saved"))
