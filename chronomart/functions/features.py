"""Causal features of bars as window expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.quality import by_time, rows


def full(c: Column, n: int) -> Column:
    """c where the last n rows all exist, else null."""
    return F.when(F.count("*").over(rows(-(n - 1), 0)) == n, c)


def simple_return(k: int, c: str = "close") -> Column:
    return (F.col(c) / F.lag(c, k).over(by_time()) - 1) * 1e4


def log_return(k: int, c: str = "close") -> Column:
    return F.log(F.col(c) / F.lag(c, k).over(by_time())) * 1e4


def with_log_return(bars: DataFrame) -> DataFrame:
    return bars.withColumn("r", log_return(1))


def rolling_vol(n: int) -> Column:
    """Population deviation of the last n one-bar log returns (column r); null until there are n."""
    return F.when(F.count("r").over(rows(-(n - 1), 0)) == n, F.stddev_pop("r").over(rows(-(n - 1), 0)))


def sigma_before(n: int) -> Column:
    """Population deviation of the n returns that end one bar earlier; zero counts as missing."""
    s = F.when(F.count("r").over(rows(-n, -1)) == n, F.stddev_pop("r").over(rows(-n, -1)))
    return F.when(s > 0, s)


def sma_distance(n: int) -> Column:
    return full((F.col("close") / F.avg("close").over(rows(-(n - 1), 0)) - 1) * 1e4, n)


def rsi(n: int) -> Column:
    """Column d is the change of close. Without losses: 100, or 50 where there are no gains either."""
    up, down = F.avg(F.greatest("d", F.lit(0.0))).over(rows(-(n - 1), 0)), F.avg(F.greatest(-F.col("d"), F.lit(0.0))).over(rows(-(n - 1), 0))
    value = F.when(down > 0, 100 - 100 / (1 + up / down)).when(up > 0, 100.0).otherwise(50.0)
    return F.when(F.count("d").over(rows(-(n - 1), 0)) == n, value)


def atr(n: int) -> Column:
    """Mean of the last n true ranges (column tr) over the close, in bps."""
    return F.when(F.count("tr").over(rows(-(n - 1), 0)) == n, F.avg("tr").over(rows(-(n - 1), 0)) / F.col("close") * 1e4)


def true_range() -> Column:
    before = F.lag("close").over(by_time())
    return F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def range_position(n: int) -> Column:
    lo, hi = F.min("low").over(rows(-(n - 1), 0)), F.max("high").over(rows(-(n - 1), 0))
    return full(F.when(hi > lo, (F.col("close") - lo) / F.when(hi > lo, hi - lo)).otherwise(0.5), n)


def candle() -> dict[str, Column]:
    top, bottom, c = F.greatest("open", "close"), F.least("open", "close"), F.col("close")
    return {
        "range_bps": (F.col("high") - F.col("low")) / c * 1e4, "body_bps": (c - F.col("open")) / c * 1e4,
        "upper_bps": (F.col("high") - top) / c * 1e4, "lower_bps": (bottom - F.col("low")) / c * 1e4,
    }


def cyclical_time() -> dict[str, Column]:
    """Sine and cosine of the UTC minute of the day and of the weekday (Monday is 0)."""
    minute, weekday = F.floor(F.col("t") % 86400 / 60), F.pmod(F.floor(F.col("t") / 86400) + 3, F.lit(7))
    angle = lambda x, n: F.lit(2) * F.pi() * x / n
    return {"sin_day": F.sin(angle(minute, 1440)), "cos_day": F.cos(angle(minute, 1440)), "sin_week": F.sin(angle(weekday, 7)), "cos_week": F.cos(angle(weekday, 7))}


def session_flags() -> dict[str, Column]:
    """London and New York hours (8 to 17 local), their overlap and US regular hours (9:30 to 16:00 New York), weekdays only.

    Column ts is a timestamp in a UTC session.
    """
    out = {}
    local = {k: F.from_utc_timestamp("ts", z) for k, z in (("london", "Europe/London"), ("new_york", "America/New_York"))}
    for k, c in local.items():
        out[k] = ((F.weekday(c) < 5) & F.hour(c).between(8, 16)).cast("double")
    ny = local["new_york"]
    minute = F.hour(ny) * 60 + F.minute(ny)
    return out | {"overlap": out["london"] * out["new_york"], "us_regular": ((F.weekday(ny) < 5) & (minute >= 570) & (minute < 960)).cast("double")}


def imbalance(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, (a - b) / F.when(a + b > 0, a + b)).otherwise(0.0)


def momentum_signal(lookback: int, least_bps: float = 2.0) -> dict[str, Column]:
    """Momentum in bps, a confidence that saturates with its size, and a direction (none for small moves)."""
    m = simple_return(lookback - 1)
    confidence = F.least(F.lit(0.95), 0.5 + 0.45 * (1 - F.exp(-F.abs(m) / 20)))
    return {"momentum": m, "confidence": confidence, "direction": F.when(F.abs(m) < least_bps, "NO_TRADE").when(m > 0, "LONG").when(m < 0, "SHORT")}


def prior_z(c: str, n: int) -> Column:
    """c against the mean and population deviation of the n values before it; 0 where they are all alike, null until there are n."""
    w = rows(-n, -1)
    sd = F.stddev_pop(c).over(w)
    return F.when(F.count(c).over(w) == n, F.when(sd > 0, (F.col(c) - F.avg(c).over(w)) / F.when(sd > 0, sd)).otherwise(0.0))


def percentile_rank(c: str, n: int, empty: float | None = 0.5) -> Column:
    """Share of the last n earlier values that are at most the current one."""
    seen = F.collect_list(c).over(rows(-n, -1))
    at_most = F.size(F.filter(seen, lambda x: x <= F.col(c)))
    return F.when(F.col(c).isNotNull(), F.when(F.size(seen) > 0, at_most / F.when(F.size(seen) > 0, F.size(seen))).otherwise(F.lit(empty)))


def trend_consistency(n: int) -> Column:
    """Share of the last n one-bar moves (column d) with the sign of the whole move; 0.5 where that is flat."""
    up, down = F.sum((F.col("d") > 0).cast("int")).over(rows(-(n - 1), 0)), F.sum((F.col("d") < 0).cast("int")).over(rows(-(n - 1), 0))
    whole = F.col("close") - F.lag("close", n).over(by_time())
    return F.when(whole > 0, up / n).when(whole < 0, down / n).when(whole == 0, 0.5)


def realized_vol(n: int) -> Column:
    return F.when(F.count("r").over(rows(-(n - 1), 0)) == n, F.sqrt(F.sum(F.col("r") * F.col("r")).over(rows(-(n - 1), 0))))


def z_price(n: int) -> Column:
    sd = F.stddev_pop("close").over(rows(-(n - 1), 0))
    return full(F.when(sd > 0, (F.col("close") - F.avg("close").over(rows(-(n - 1), 0))) / F.when(sd > 0, sd)).otherwise(0.0), n)


def vol_barriers(vol: str, horizon: int, take: float, stop: float) -> dict[str, Column]:
    scale = F.col(vol) * F.sqrt(F.lit(float(horizon)))
    return {"take_bps": scale * take, "stop_bps": scale * stop}


def exponential(series: DataFrame, value: str, alpha: float, out: str, block: int = 4096, step: int = 3600) -> DataFrame:
    """y = alpha * x + (1 - alpha) * y', seeded with the first value, for each symbol in order of t.

    The recurrence is affine, so blocks of rows are folded on their own, and one number a block is carried on, over as many blocks as
    still weigh 2 ** -60 or more. Blocks are stretches of time that hold about `block` rows of the given step (more where
    rows are denser), so no task sorts or folds a whole series.
    """
    d = series.withColumn("_b", F.floor(F.col("t") / (block * step)))
    first = series.groupBy("symbol").agg(F.min("t").alias("_first"))
    d = d.join(first, "symbol")
    x = F.when(F.col("t") == F.col("_first"), F.col(value)).otherwise(alpha * F.col(value))
    # y within a block from zero: the fold of the values so far, in one array a block of bounded length
    packed = d.groupBy("symbol", "_b").agg(F.sort_array(F.collect_list(F.struct("t", x.alias("x")))).alias("_a"), F.count("*").alias("_size"))
    state = F.aggregate(
        "_a", F.struct(F.lit(0.0).alias("y"), F.array().cast("array<double>").alias("ys")),
        lambda s, e: F.struct(((1 - alpha) * s["y"] + e["x"]).alias("y"), F.concat(s["ys"], F.array((1 - alpha) * s["y"] + e["x"])).alias("ys")),
    )
    packed = packed.withColumn("_s", state).select("symbol", "_b", "_size", F.col("_s.y").alias("_end"), F.col("_s.ys").alias("_ys"), "_a")
    # a block has one row at least: beyond so many blocks nothing of a value is left in a double
    carry = Window.partitionBy("symbol").orderBy("_b").rowsBetween(-max(1, math.ceil(-60 * math.log(2) / math.log(1 - alpha))), -1)
    ends = F.collect_list(F.struct("_size", "_end")).over(carry)
    before = F.aggregate(ends, F.lit(0.0), lambda y, e: y * F.pow(F.lit(1 - alpha), e["_size"]) + e["_end"])
    packed = packed.withColumn("_before", before)
    flat = packed.select("symbol", "_before", F.posexplode(F.arrays_zip("_a", "_ys")).alias("_k", "_e"))
    value_of = flat.select("symbol", F.col("_e._a.t").alias("t"), (F.col("_e._ys") + F.col("_before") * F.pow(F.lit(1 - alpha), F.col("_k") + 1)).alias(out))
    return series.join(value_of, ["symbol", "t"])


def ewma_volatility(bars: DataFrame, *, span: int, least: int, step: int, block: int | None = 7 * 86400) -> DataFrame:
    """symbol, t, vol: root of exponential second moment less squared mean of one-step log returns (bps) of pairs of eligible bars.

    Gaps and bars that are not eligible do not update it; its last value is carried over them. Null until `least` updates. The bar before, the count
    of updates and the last value are carried from block to block of t.
    """
    from ..operators.running import running

    d = running(bars.select("symbol", "t", "close", "eligible"), ["symbol"], ["t"], block, {"_t": ("previous", F.col("t")), "_c": ("previous", F.col("close")), "_e": ("previous", F.col("eligible"))})
    pair = (F.col("t") - F.col("_t") == step) & F.col("eligible") & F.col("_e")
    d = d.select("symbol", "t", F.when(pair, F.log(F.col("close") / F.col("_c")) * 1e4).alias("x"))
    used = d.filter("x is not null").withColumn("xx", F.col("x") * F.col("x"))
    alpha = 2.0 / (span + 1)
    m = running(exponential(exponential(used, "x", alpha, "m1"), "xx", alpha, "m2"), ["symbol"], ["t"], block, {"_seen": ("sum", F.lit(1))})
    vol = F.when(F.col("_seen") >= least, F.sqrt(F.greatest(F.col("m2") - F.col("m1") * F.col("m1"), F.lit(0.0))))
    back = d.select("symbol", "t").join(m.select("symbol", "t", vol.alias("vol")), ["symbol", "t"], "left")
    return running(back.withColumnRenamed("vol", "_v"), ["symbol"], ["t"], block, {"vol": ("last", F.col("_v"))}).drop("_v")


def executable_outcomes(h: int) -> dict[str, Column]:
    """Entry one row later and exit h rows after it: long buys at ask and sells at bid, short the reverse, bps; null unless the book is valid at both."""
    w = by_time()
    at = lambda c, k: F.lead(c, k).over(w)
    ok = at("valid", 1) & at("valid", 1 + h)
    return {"long_bps": F.when(ok, F.log(at("bid", 1 + h) / at("ask", 1)) * 1e4), "short_bps": F.when(ok, F.log(at("bid", 1) / at("ask", 1 + h)) * 1e4)}


def macro_change(value: Column, prior: Column, percent: Column) -> Column:
    """Percent change where `percent`, else the change of level; null without a prior value, or a percent change from zero."""
    return F.when(percent, (value / F.when(prior != 0, prior) - 1) * 100).otherwise(value - prior)


def drift_bps(current: Column, frozen: Column) -> Column:
    return F.when(frozen == 0, 0.0).otherwise((current / F.when(frozen != 0, frozen) - 1) * 1e4)


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, block: int = 4096, step: int = 3600) -> DataFrame:
    """symbol, t, ema_fast, ema_slow, macd, signal and histogram: averages as they are, the other three in bps of close."""
    d = bars.select("symbol", "t", "close")
    for name, span in (("ema_fast", fast), ("ema_slow", slow)):
        d = exponential(d, "close", 2 / (span + 1), name, block, step)
    d = exponential(d.withColumn("_m", F.col("ema_fast") - F.col("ema_slow")), "_m", 2 / (signal + 1), "_s", block, step)
    bps = lambda c: c / F.col("close") * 1e4
    return d.select("symbol", "t", "ema_fast", "ema_slow", bps(F.col("_m")).alias("macd"), bps(F.col("_s")).alias("signal"), bps(F.col("_m") - F.col("_s")).alias("histogram"))
