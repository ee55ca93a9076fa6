"""Data quality of bars: session calendar, flags, contiguity, canonical OHLC, completeness.

All operators take bars (symbol, t in seconds, open, high, low, close) and partition by symbol; a value at t uses rows up to t only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Asset classes by symbol.
ALWAYS_OPEN, WEEKDAYS = "always", "weekdays"


def by_time():
    return Window.partitionBy("symbol").orderBy("t")


def rows(lo: int, hi: int):
    return by_time().rowsBetween(lo, hi)


def tradability(bars: DataFrame, classes: dict[str, str]) -> DataFrame:
    """Adds eligible and reason: some symbols always trade, others not on UTC weekends; unknown ones do, with their own reason."""
    weekday = F.pmod(F.floor(F.col("t") / 86400) + 3, F.lit(7))
    kind = F.coalesce(*[F.when(F.col("symbol") == s, F.lit(c)) for s, c in classes.items()], F.lit("unknown"))
    d = bars.withColumn("_kind", kind).withColumn("_closed", (F.col("_kind") == WEEKDAYS) & (weekday >= 5))
    reason = F.when(F.col("_kind") == ALWAYS_OPEN, "always_open").when(F.col("_kind") == "unknown", "unknown_symbol")
    reason = reason.when(F.col("_closed"), "weekend").otherwise("open")
    return d.withColumns({"eligible": ~F.col("_closed"), "reason": reason}).drop("_kind", "_closed")


def quality_flags(bars: DataFrame, tiny_bps: float = 0.10) -> DataFrame:
    """Adds zero_range, tiny_range, repeated_close and repeated_ohlc (against the bar before; false for the first)."""
    same = lambda c: F.coalesce(F.col(c) == F.lag(c).over(by_time()), F.lit(False))
    return bars.withColumns(
        {
            "zero_range": F.col("high") == F.col("low"),
            "tiny_range": (F.col("high") / F.col("low") - 1) * 1e4 <= tiny_bps,
            "repeated_close": same("close"),
            "repeated_ohlc": same("open") & same("high") & same("low") & same("close"),
        }
    )


def quality_summary(flagged: DataFrame) -> DataFrame:
    """Counts and shares of each flag by symbol."""
    flags = ("zero_range", "tiny_range", "repeated_close", "repeated_ohlc")
    return flagged.groupBy("symbol").agg(
        F.count("*").alias("bars"), *[F.count_if(f).alias(f) for f in flags], *[F.avg(F.col(f).cast("double")).alias(f + "_share") for f in flags]
    )


def hard_eligible(flagged: DataFrame) -> DataFrame:
    """Adds hard_eligible: session open, not zero range, not a repeated bar (tiny ranges pass)."""
    return flagged.withColumn("hard_eligible", F.col("eligible") & ~F.col("zero_range") & ~F.col("repeated_ohlc"))


def gap(step: int) -> Column:
    return F.coalesce(F.col("t") - F.lag("t").over(by_time()) != step, F.lit(False)).cast("int")


def contiguous(bars: DataFrame, horizon: int, step: int) -> DataFrame:
    """Adds contiguous: all of the next `horizon` steps exist and are one `step` long."""
    return bars.withColumn("_gap", gap(step)).withColumn(
        "contiguous", (F.count("*").over(rows(1, horizon)) == horizon) & (F.coalesce(F.sum("_gap").over(rows(1, horizon)), F.lit(1)) == 0)
    ).drop("_gap")


def event_eligible(bars: DataFrame, horizon: int, step: int) -> DataFrame:
    """Adds event_eligible: the horizon is contiguous and each bar from the decision to its end is eligible."""
    d = contiguous(bars, horizon, step)
    return d.withColumn("event_eligible", F.col("contiguous") & (F.min(F.col("hard_eligible").cast("int")).over(rows(0, horizon)) == 1))


def clean_history(bars: DataFrame, lookback: int, step: int) -> DataFrame:
    """Adds clean_history: the last `lookback` bars and this one are all eligible and contiguous."""
    d = bars.withColumn("_gap", gap(step))
    ok = (F.min(F.col("hard_eligible").cast("int")).over(rows(-lookback, 0)) == 1) & (F.sum("_gap").over(rows(-lookback + 1, 0)) == 0)
    return d.withColumn("clean_history", ok & (F.count("*").over(rows(-lookback, 0)) == lookback + 1)).drop("_gap")


def ohlc_violations(raw: DataFrame) -> DataFrame:
    """Rows that break OHLC order, with the reasons in order, shortfalls and the closes two rows around."""
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    reasons = F.array_compact(
        F.array(
            F.when(F.least("open", "high", "low", "close") <= 0, "NON_POSITIVE_PRICE"),
            F.when(F.col("high") < top, "HIGH_BELOW_OPEN_OR_CLOSE"),
            F.when(F.col("low") > bottom, "LOW_ABOVE_OPEN_OR_CLOSE"),
        )
    )
    d = raw.withColumns(
        {
            "reasons": reasons, "high_short": F.greatest(top - F.col("high"), F.lit(0.0)), "low_short": F.greatest(F.col("low") - bottom, F.lit(0.0)),
            "near": F.collect_list("close").over(rows(-2, 2)),
        }
    )
    return d.filter(F.size("reasons") > 0)


def canonical_ohlc(raw: DataFrame) -> DataFrame:
    """high and low widened to hold open and close; adds adjusted and adjust_bps, the larger of both corrections."""
    top, bottom = F.greatest("high", "open", "close"), F.least("low", "open", "close")
    d = raw.withColumns({"_h": top, "_l": bottom})
    bps = F.greatest((F.col("_h") - F.col("high")) / F.greatest("open", "close"), (F.col("low") - F.col("_l")) / F.least("open", "close")) * 1e4
    d = d.withColumns({"adjusted": (F.col("_h") != F.col("high")) | (F.col("_l") != F.col("low")), "adjust_bps": bps})
    return d.withColumns({"high": F.col("_h"), "low": F.col("_l")}).drop("_h", "_l")


def require_small_adjustments(canonical: DataFrame, most_bps: float = 5.0) -> DataFrame:
    """Fails when any correction exceeds the limit, as one aggregate; returns its input."""
    worst = canonical.agg(F.max("adjust_bps")).first()[0]
    if worst is not None and worst > most_bps:
        raise ValueError(f"an OHLC correction of {worst:.3f} bps exceeds {most_bps}")
    return canonical


def coverage(bars: DataFrame, required: DataFrame, first_day: int, last_day: int, least: int) -> DataFrame:
    """One row for each required symbol: first and last day, bars, and whether it covers the range with enough bars."""
    day = F.floor(F.col("t") / 86400).cast("long")
    got = bars.groupBy("symbol").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("bars"))
    ok = (F.col("first_day") <= first_day) & (F.col("last_day") >= last_day) & (F.col("bars") >= least)
    return required.join(got, "symbol", "left").withColumns({"bars": F.coalesce("bars", F.lit(0)), "pass": F.coalesce(ok, F.lit(False))})


def completeness(bars: DataFrame, step: int) -> DataFrame:
    """By symbol and day: expected, present, duplicate, missing and extra slots of a grid of `step` seconds."""
    day = F.floor(F.col("t") / 86400).cast("long")
    per_day = 86400 // step
    on_grid = F.col("t") % step == 0
    d = bars.groupBy("symbol", day.alias("day")).agg(
        F.count("*").alias("present"), (F.count("*") - F.countDistinct("t")).alias("duplicates"),
        F.countDistinct(F.when(on_grid, F.col("t"))).alias("_slots"), F.count_if(~on_grid).alias("extra"),
    )
    return d.withColumns({"expected": F.lit(per_day).cast("long"), "missing": F.lit(per_day) - F.col("_slots")}).drop("_slots")


def exclude_windows(bars: DataFrame, windows: list[tuple[int, int]], back: int, ahead: int) -> DataFrame:
    """Adds reserved (t in an inclusive window) and touches (any bar from `back` before to `ahead` after is reserved)."""
    hit = F.lit(False)
    for lo, hi in windows:
        hit = hit | F.col("t").between(lo, hi)
    d = bars.withColumn("reserved", hit)
    return d.withColumn("touches", F.max(F.col("reserved").cast("int")).over(rows(-back, ahead)) == 1)
