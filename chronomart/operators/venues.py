"""Joins across venues, peers and frozen sets, and blocks of features built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof
from .quality import by_time, rows


def lag_packet(bars: DataFrame, lags: tuple[int, ...], sigma: int, step: int) -> DataFrame:
    """For each bar, simple returns of single bars that ended 0, 1, ... bars ago (lag 1: the latest) over the deviation as of their end.

    A return counts if its two bars follow each other at one step and the deviation of the last `sigma` log returns is above
    zero; else it is 0 and its flag ok<lag> is 0.
    """
    prior = F.lag("close").over(by_time())
    d = bars.withColumns({"_s": (F.col("close") / prior - 1) * 1e4, "_r": F.log(F.col("close") / prior) * 1e4, "_next": F.col("t") - F.lag("t").over(by_time()) == step})
    dev = F.when(F.count("_r").over(rows(-(sigma - 1), 0)) == sigma, F.stddev_pop("_r").over(rows(-(sigma - 1), 0)))
    d = d.withColumn("_dev", dev).withColumn("_z", F.when(F.col("_next") & (F.col("_dev") > 0), F.col("_s") / F.col("_dev")))
    out = {k: F.lag("_z", k - 1).over(by_time()) for k in lags}
    flags = [F.when(c.isNotNull(), 1.0).otherwise(0.0).alias(f"ok{k}") for k, c in out.items()]
    return d.select("symbol", "t", *[F.coalesce(c, F.lit(0.0)).alias(f"z{k}") for k, c in out.items()], *flags)


def delayed_packet(decisions: DataFrame, quotes: DataFrame, *, delay_us: int, anchors_us: tuple[int, ...], max_age_us: int) -> DataFrame:
    """The venue's state as known `delay` before each decision (symbol, us, tick_id): log returns from anchors before the cut to it, in bps.

    quotes: symbol, us, price, segment. The current quote and those at all anchors must be at most max_age old and of one
    segment; else valid is false and returns are null. One as-of pass for the cut and each anchor.
    """
    d = decisions.select("symbol", "us", "tick_id")
    for k, back in enumerate((0, *anchors_us)):
        d = d.withColumn("_cut", F.col("us") - delay_us - back)
        q = quotes.select("symbol", F.col("us").alias("_cut"), F.col("price").alias(f"_p{k}"), F.col("segment").alias(f"_s{k}"))
        j = asof(d, q, [f"_p{k}", f"_s{k}"], on="_cut", by=["symbol"], max_age=max_age_us, block=max(max_age_us, 86_400_000_000))
        d = j.withColumn(f"_a{k}", F.col("_cut") - F.col("asof_t")).drop("asof_t", "_cut")
    ok = F.col("_p0").isNotNull()
    for k in range(1, len(anchors_us) + 1):
        ok = ok & F.coalesce(F.col(f"_s{k}") == F.col("_s0"), F.lit(False))
    moves = [F.when(ok, F.log(F.col("_p0") / F.col(f"_p{k}")) * 1e4).alias(f"r{k}") for k in range(1, len(anchors_us) + 1)]
    return d.select("symbol", "us", "tick_id", ok.alias("valid"), F.when(ok, F.col("_a0")).alias("age_us"), *moves)


def aligned(states: DataFrame, grid: DataFrame, offset: int) -> DataFrame:
    """States (symbol, open, ...) at their decision time open + offset, joined to the grid (symbol, t, ...).

    States outside a symbol's span of the grid are trimmed; one inside it without a row of the grid fails the join.
    """
    s = states.withColumn("t", F.col("open") + offset)
    ends = grid.groupBy("symbol").agg(F.min("t").alias("_lo"), F.max("t").alias("_hi"))
    s = s.join(ends, "symbol").filter(F.col("t").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    if s.join(grid, ["symbol", "t"], "left_anti").limit(1).count():
        raise ValueError("the grid misses a state's time")
    return s.join(grid, ["symbol", "t"])


def common_support(sources: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Rows that all sources (key, x, valid) hold as valid: the columns of each, named after it."""
    out = None
    for name, d in sources.items():
        d = d.filter("valid").select(*key, F.col("x").alias(name))
        out = d if out is None else out.join(d, key)
    return out


def frozen_join(frozen: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """Frozen rows (symbol, t, t_future, label) with both bars, exactly `horizon` places apart, and whether prices agree with the label.

    status: matched, mismatch (another direction), not_apart, no_bar.
    """
    n = bars.select("symbol", "t", "close", F.row_number().over(by_time()).alias("k"))
    a = n.select("symbol", "t", F.col("close").alias("_c"), F.col("k").alias("_k"))
    b = n.select("symbol", F.col("t").alias("t_future"), F.col("close").alias("_cf"), F.col("k").alias("_kf"))
    d = frozen.join(a, ["symbol", "t"], "left").join(b, ["symbol", "t_future"], "left")
    now = F.when(F.col("_cf") > F.col("_c"), "LONG").otherwise("SHORT")
    status = (
        F.when(F.col("_k").isNull() | F.col("_kf").isNull(), "no_bar").when(F.col("_kf") - F.col("_k") != horizon, "not_apart").when(now != F.col("label"), "mismatch").otherwise("matched")
    )
    return d.select("symbol", "t", "label", status.alias("status"))


def decision_gate(d: DataFrame) -> DataFrame:
    """The first gate that a row fails, in this order; columns has_bar, clean, vol, event, score."""
    return d.withColumn(
        "gate",
        F.when(~F.coalesce("has_bar", F.lit(False)), "UNAVAILABLE_BAR").when(~F.coalesce("clean", F.lit(False)), "BLOCK_FEATURE_HISTORY").when(F.col("vol").isNull() | (F.col("vol") <= 0), "BLOCK_VOLATILITY")
        .when(F.col("event").isNull(), "BLOCK_FUTURE_EVENT").when(F.col("score").isNull(), "UNAVAILABLE_MODEL").otherwise("PASS"),
    )


def streams_to_columns(closes: DataFrame, names: dict[int, str]) -> DataFrame:
    """Closes (symbol, t, stream, close) of several streams side by side, only where all have one: one aggregation instead of joins."""
    d = closes.groupBy("symbol", "t").agg(*[F.max(F.when(F.col("stream") == k, F.col("close"))).alias(n) for k, n in names.items()])
    return d.dropna(subset=list(names.values()))


def basis_block(state: DataFrame, z_rows: int) -> DataFrame:
    """State (symbol, t, mark, index, premium) with basis in bps, simple returns and differences over 1, 5 and 15 rows, z-scores before the row, and return gaps."""
    from ..functions.features import prior_z, simple_return

    d = state.withColumn("basis", (F.col("mark") / F.col("index") - 1) * 1e4)
    w = by_time()
    out: dict[str, Column] = {}
    for k in (1, 5, 15):
        out |= {f"mark_r{k}": simple_return(k, "mark"), f"index_r{k}": simple_return(k, "index")}
        out |= {f"basis_d{k}": F.col("basis") - F.lag("basis", k).over(w), f"premium_d{k}": F.col("premium") - F.lag("premium", k).over(w)}
    d = d.withColumns(out | {"basis_z": prior_z("basis", z_rows), "premium_z": prior_z("premium", z_rows)})
    return d.withColumns({f"gap_r{k}": F.col(f"mark_r{k}") - F.col(f"index_r{k}") for k in (1, 5, 15)})


def trades_once(trades: DataFrame, key: list[str], order: list[str], trade_id: str) -> DataFrame:
    """The first row of each trade id within key; rows with an empty id all stay. A signed side is added; other sides, prices or quantities fail."""
    named = F.coalesce(F.col(trade_id).cast("string"), F.lit("")) != ""
    w = Window.partitionBy(*key, F.when(named, F.col(trade_id).cast("string")), F.when(~named, F.struct(*order))).orderBy(*order)
    good = F.col("side").isin("buy", "sell") & (F.col("price") > 0) & (F.col("qty") > 0)
    checked = F.when(F.coalesce(good, F.lit(False)), F.when(F.col("side") == "buy", 1).otherwise(-1)).otherwise(F.raise_error(F.lit("a trade is malformed")).cast("int"))
    return trades.withColumn("_k", F.row_number().over(w)).filter(~named | (F.col("_k") == 1)).drop("_k").withColumn("sign", checked)
