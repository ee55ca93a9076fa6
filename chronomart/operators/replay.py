"""Replay of a predictor: a function from bars to predictions that may use nothing later than each bar, which is checked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .labels import barrier_labels, direction_outcome
from .running import numbered

#: bars -> symbol, t, reference_price, direction (LONG or SHORT) and confidence of the bars it has an opinion on
Predictor = Callable[[DataFrame], DataFrame]
PREDICTION = ("symbol", "t", "reference_price", "direction", "confidence")


class Broken(ValueError):
    """A predictor that does not keep the contract."""


def require_contract(bars: DataFrame, predictions: DataFrame) -> None:
    """Each prediction stands at a bar of its symbol, one a bar at most, and its reference price is that bar's close."""
    p = predictions.groupBy("symbol", "t").agg(F.count("*").alias("n"), F.min("reference_price").alias("price"))
    j = p.join(bars.select("symbol", "t", F.col("close").alias("_close")), ["symbol", "t"], "left")
    wrong = j.agg(F.count_if(F.expr("n > 1")).alias("twice"), F.count_if(F.expr("_close is null")).alias("elsewhere"), F.count_if(F.expr("_close is not null and not (price <=> _close)")).alias("price")).first()
    if wrong.twice or wrong.elsewhere or wrong.price:
        raise Broken(f"{wrong.elsewhere} predictions are at no bar, {wrong.twice} bars have several, {wrong.price} have another price than their close")


def require_causal(predict: Predictor, bars: DataFrame, predictions: DataFrame, cuts: list[int]) -> None:
    """What the predictor says up to each cut is the same without the bars after it; both ways, null-safe, doubles to nine digits."""
    kinds = dict(predictions.dtypes)
    row = F.struct(*[F.round(c, 9).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in PREDICTION[2:]])
    for cut in cuts:
        past = predict(bars.filter(F.col("t") <= cut)).filter(F.col("t") <= cut).select("symbol", "t", row.alias("_a"))
        j = predictions.filter(F.col("t") <= cut).select("symbol", "t", row.alias("_b")).join(past, ["symbol", "t"], "full")
        n = j.filter(~F.col("_a").eqNullSafe(F.col("_b"))).count()
        if n:
            raise Broken(f"{n} predictions up to {cut} change with what comes after")


def replay(predict: Predictor, bars: DataFrame, *, history: int, horizon: int, threshold: float, take_bps: float, stop_bps: float, cost_bps: float, cuts: list[int] | None = None, block: int | None = 7 * 86400) -> DataFrame:
    """Decisions of a predictor and their trades: symbol, t, direction, confidence, hit, reason, net.

    The predictor must keep require_contract, and require_causal at the cuts (none: two thirds of the time span). Decisions begin at a symbol's bar
    number `history` and end where the horizon is no longer whole; those below the threshold are NO_TRADE. hit: the direction is that of the
    close `horizon` bars ahead (no rise counts as SHORT). Trades run into barriers as barrier_labels has them. Empty bars have no decisions.
    """
    p = written(predict(bars).select(*PREDICTION), "predictions")
    require_contract(bars, p)
    if cuts is None:
        lo, hi = bars.agg(F.min("t"), F.max("t")).first()
        cuts = [] if lo is None else [lo + (hi - lo) * 2 // 3]
    require_causal(predict, bars, p, cuts)
    ends = numbered(bars, ["symbol"], ["t"], block).withColumns(direction_outcome(horizon)).filter(f"k >= {history - 1} and future is not null")
    d = ends.select("symbol", "t", "outcome").join(p, ["symbol", "t"])
    d = d.withColumn("direction", F.when(F.col("confidence") >= threshold, F.col("direction")).otherwise("NO_TRADE"))
    side = lambda s: barrier_labels(bars, horizon, take_bps, stop_bps, cost_bps, s).select("symbol", "t", F.lit(s).alias("direction"), "reason", F.col("net_bps").alias("net"))
    trades = side("LONG").unionByName(side("SHORT"))
    return d.withColumn("hit", F.col("direction") == F.col("outcome")).join(trades, ["symbol", "t", "direction"], "left").select("symbol", "t", "direction", "confidence", "hit", "reason", "net")
