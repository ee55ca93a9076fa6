"""The registered market queries, each with SQL for another engine. Doubles are rounded to six digits on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as fx
from ..operators import grids, joins, labels, metrics
from ..operators import quality as qa
from ..sources.adapters import HOUR, LEDGER_SQL, TICKS_SQL, bars_sql, hourly, ledger, table, ticks
from . import registry

BARS = bars_sql()
CLASSES = {"click": qa.ALWAYS_OPEN, "view": qa.WEEKDAYS, "purchase": qa.WEEKDAYS, "signup": qa.ALWAYS_OPEN}
W = "partition by symbol order by t"
#: Blocks of time by which hot symbols are dealt over tasks.
WEEK, DAY_US = 7 * 86400, 86_400_000_000


def query(name: str, sql: str | None = None, ctes: str = BARS, rounded: bool = False) -> Callable:
    """Register a query; its doubles are rounded, unless it has rounded them itself, as are those listed after '##' in its SQL."""
    body, _, doubles = (sql or "").partition("##")
    names = [x.strip() for x in doubles.split(",") if x.strip()]
    whole = f"with {ctes}, answer as ({body}) select * replace ({', '.join(f'round(cast({x} as double), 6) + 0.0 as {x}' for x in names)}) from answer" if names else f"with {ctes} {body}"

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            d = f(spark, sf_dir)
            return d if rounded else d.select(*[(F.round(c, 6) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in d.dtypes])

        run.__name__ = name
        registry.query(name, whole if sql else None)(run)
        return run

    return put


def over(lo: int | str, hi: int | str) -> str:
    bound = lambda x: x if isinstance(x, str) else "current row" if x == 0 else f"{abs(x)} {'preceding' if x < 0 else 'following'}"
    return f"over ({W} rows between {bound(lo)} and {bound(hi)})"


ALL = "unbounded preceding"
WEEKDAY_SQL = "((t // 86400 + 3) % 7)"
FLAGGED = f"""{BARS}, flagged as (
  select *, not (symbol in ('view', 'purchase') and {WEEKDAY_SQL} >= 5) as eligible, high = low as zero_range, (high / low - 1) * 1e4 <= 0.10 as tiny_range,
    coalesce(close = lag(close) over ({W}), false) as repeated_close,
    coalesce(open = lag(open) over ({W}) and high = lag(high) over ({W}) and low = lag(low) over ({W}) and close = lag(close) over ({W}), false) as repeated_ohlc from bars
), hard as (select *, eligible and not zero_range and not repeated_ohlc as hard_eligible, case when coalesce(t - lag(t) over ({W}) <> 3600, false) then 1 else 0 end as gap from flagged)"""


def flagged(spark, sf):
    return qa.hard_eligible(qa.quality_flags(qa.tradability(hourly(spark, sf), CLASSES)))


@query("s1_bars", "select symbol, t, open, high, low, close, n from bars ## open, high, low, close")
def s1(spark, sf):
    return hourly(spark, sf)


@query("q1_tradability", f"""select symbol, t, not (symbol in ('view', 'purchase') and {WEEKDAY_SQL} >= 5) as eligible,
  case when symbol in ('click', 'signup') then 'always_open' when symbol not in ('view', 'purchase') then 'unknown_symbol' when {WEEKDAY_SQL} >= 5 then 'weekend' else 'open' end as reason from bars""")
def q1(spark, sf):
    return qa.tradability(hourly(spark, sf), CLASSES).select("symbol", "t", "eligible", "reason")


@query("q2_quality_flags", "select symbol, t, zero_range, tiny_range, repeated_close, repeated_ohlc from flagged", FLAGGED)
def q2(spark, sf):
    return flagged(spark, sf).select("symbol", "t", "zero_range", "tiny_range", "repeated_close", "repeated_ohlc")


@query("q3_quality_summary", """select symbol, count(*) as bars, count(*) filter (where zero_range) as zero_range, count(*) filter (where tiny_range) as tiny_range,
  count(*) filter (where repeated_close) as repeated_close, count(*) filter (where repeated_ohlc) as repeated_ohlc, avg(cast(zero_range as double)) as zero_range_share, avg(cast(tiny_range as double)) as tiny_range_share,
  avg(cast(repeated_close as double)) as repeated_close_share, avg(cast(repeated_ohlc as double)) as repeated_ohlc_share from flagged group by symbol
  ## zero_range_share, tiny_range_share, repeated_close_share, repeated_ohlc_share""", FLAGGED)
def q3(spark, sf):
    return qa.quality_summary(flagged(spark, sf))


@query("q4_hard_eligible", "select symbol, t, hard_eligible from hard", FLAGGED)
def q4(spark, sf):
    return flagged(spark, sf).select("symbol", "t", "hard_eligible")


@query("q5_contiguous", f"select symbol, t, count(*) {over(1, 6)} = 6 and coalesce(sum(gap) {over(1, 6)}, 1) = 0 as contiguous from hard", FLAGGED)
def q5(spark, sf):
    return qa.contiguous(hourly(spark, sf), 6, HOUR).select("symbol", "t", "contiguous")


@query("q6_event_eligible", f"""select symbol, t, count(*) {over(1, 6)} = 6 and coalesce(sum(gap) {over(1, 6)}, 1) = 0
  and min(cast(hard_eligible as integer)) {over(0, 6)} = 1 as event_eligible from hard""", FLAGGED)
def q6(spark, sf):
    return qa.event_eligible(flagged(spark, sf), 6, HOUR).select("symbol", "t", "event_eligible")


@query("q7_clean_history", f"""select symbol, t, min(cast(hard_eligible as integer)) {over(-12, 0)} = 1 and sum(gap) {over(-11, 0)} = 0 and count(*) {over(-12, 0)} = 13 as clean_history from hard""", FLAGGED)
def q7(spark, sf):
    return qa.clean_history(flagged(spark, sf), 12, HOUR).select("symbol", "t", "clean_history")


RAW = f"""{BARS}, raw as (select symbol, t, open, case when n % 5 = 0 then least(open, close) * 0.9999 else high end as high, case when n % 7 = 0 then greatest(open, close) * 1.0001 else low end as low, close from bars)"""


def raw_bars(spark, sf):
    b = hourly(spark, sf)
    return b.select(
        "symbol", "t", "open", F.when(F.col("n") % 5 == 0, F.least("open", "close") * 0.9999).otherwise(F.col("high")).alias("high"),
        F.when(F.col("n") % 7 == 0, F.greatest("open", "close") * 1.0001).otherwise(F.col("low")).alias("low"), "close",
    )


@query("q8_ohlc_violations", f"""select symbol, t, high < greatest(open, close) as high_bad, low > least(open, close) as low_bad, greatest(greatest(open, close) - high, 0.0) as high_short,
  greatest(low - least(open, close), 0.0) as low_short, around from (select *, count(close) {over(-2, 2)} as around from raw) where high < greatest(open, close) or low > least(open, close) or least(open, high, low, close) <= 0 ## high_short, low_short""", RAW)
def q8(spark, sf):
    d = qa.ohlc_violations(raw_bars(spark, sf))
    has = lambda x: F.array_contains("reasons", x)
    return d.select("symbol", "t", has("HIGH_BELOW_OPEN_OR_CLOSE").alias("high_bad"), has("LOW_ABOVE_OPEN_OR_CLOSE").alias("low_bad"), "high_short", "low_short", F.size("near").cast("long").alias("around"))


@query("q9_canonical_ohlc", """select symbol, t, greatest(high, open, close) as high, least(low, open, close) as low, greatest(high, open, close) <> high or least(low, open, close) <> low as adjusted,
  greatest((greatest(high, open, close) - high) / greatest(open, close), (low - least(low, open, close)) / least(open, close)) * 1e4 as adjust_bps from raw ## high, low, adjust_bps""", RAW)
def q9(spark, sf):
    return qa.canonical_ohlc(raw_bars(spark, sf)).select("symbol", "t", "high", "low", "adjusted", "adjust_bps")


@query("q10_coverage", """select r.symbol, min(t // 86400) as first_day, max(t // 86400) as last_day, count(t) as bars,
  coalesce(min(t // 86400) <= 19724 and max(t // 86400) >= 19750 and count(t) >= 20, false) as pass
  from (values ('click'), ('view'), ('absent')) r(symbol) left join bars b on b.symbol = r.symbol group by r.symbol""")
def q10(spark, sf):
    return qa.coverage(hourly(spark, sf), spark.createDataFrame([("click",), ("view",), ("absent",)], "symbol string"), 19724, 19750, 20)


@query("q11_completeness", "select symbol, t // 86400 as day, count(*) as present, count(*) - count(distinct t) as duplicates, 0::bigint as extra, 24::bigint as expected, 24 - count(distinct t) as missing from bars group by 1, 2")
def q11(spark, sf):
    return qa.completeness(hourly(spark, sf), HOUR)


RESERVED = [(1704240000, 1704326400), (1705000000, 1705100000)]


@query("q15_reserved_windows", f"""select symbol, t, r as reserved, max(cast(r as integer)) {over(-3, 3)} = 1 as touches
  from (select *, t between 1704240000 and 1704326400 or t between 1705000000 and 1705100000 as r from bars)""")
def q15(spark, sf):
    return qa.exclude_windows(hourly(spark, sf), RESERVED, 3, 3).select("symbol", "t", "reserved", "touches")


LAGGED = f"""{BARS}, lagged as (select *, ln(close / lag(close) over ({W})) * 1e4 as r, close - lag(close) over ({W}) as d,
  case when lag(close) over ({W}) is not null then greatest(high - low, abs(high - lag(close) over ({W})), abs(low - lag(close) over ({W}))) end as tr from bars)"""


def lagged(spark, sf):
    b = fx.with_log_return(hourly(spark, sf))
    return b.withColumns({"d": F.col("close") - F.lag("close").over(qa.by_time()), "tr": fx.true_range()})


def features(spark, sf, **columns):
    return lagged(spark, sf).select("symbol", "t", *[c.alias(k) for k, c in columns.items()])


@query("f1_simple_returns", "select symbol, t, " + ", ".join(f"(close / lag(close, {k}) over ({W}) - 1) * 1e4 as r{k}" for k in (1, 3, 6, 12, 24)) + " from bars ## r1, r3, r6, r12, r24")
def f1(spark, sf):
    return features(spark, sf, **{f"r{k}": fx.simple_return(k) for k in (1, 3, 6, 12, 24)})


@query("f2_log_returns", "select symbol, t, " + ", ".join(f"ln(close / lag(close, {k}) over ({W})) * 1e4 as r{k}" for k in (1, 6, 24)) + " from bars ## r1, r6, r24")
def f2(spark, sf):
    return features(spark, sf, **{f"r{k}": fx.log_return(k) for k in (1, 6, 24)})


@query("f3_lag_diff", f"select symbol, t, close - lag(close, 1) over ({W}) as d1, close - lag(close, 4) over ({W}) as d4 from bars ## d1, d4")
def f3(spark, sf):
    return features(spark, sf, **{f"d{k}": F.col("close") - F.lag("close", k).over(qa.by_time()) for k in (1, 4)})


@query("f4_candle_shape", """select symbol, t, (high - low) / close * 1e4 as range_bps, (close - open) / close * 1e4 as body_bps, (high - greatest(open, close)) / close * 1e4 as upper_bps,
  (least(open, close) - low) / close * 1e4 as lower_bps from bars ## range_bps, body_bps, upper_bps, lower_bps""")
def f4(spark, sf):
    return features(spark, sf, **fx.candle())


@query("f5_cyclical_time", f"""select symbol, t, sin(2 * pi() * ((t % 86400) // 60) / 1440) as sin_day, cos(2 * pi() * ((t % 86400) // 60) / 1440) as cos_day,
  sin(2 * pi() * {WEEKDAY_SQL} / 7) as sin_week, cos(2 * pi() * {WEEKDAY_SQL} / 7) as cos_week from bars ## sin_day, cos_day, sin_week, cos_week""")
def f5(spark, sf):
    return features(spark, sf, **fx.cyclical_time())


@query("f7_imbalance", """select symbol, t, buy_qty, sell_qty, case when buy_qty + sell_qty > 0 then (buy_qty - sell_qty) / (buy_qty + sell_qty) else 0.0 end as imbalance from
  (select symbol, us // 3600000000 * 3600 as t, sum(case when not buyer_maker then qty else 0.0 end) as buy_qty, sum(case when buyer_maker then qty else 0.0 end) as sell_qty from ticks group by 1, 2) ## buy_qty, sell_qty, imbalance""", TICKS_SQL)
def f7(spark, sf):
    d = grids.trade_buckets(ticks(spark, sf), HOUR)
    return d.select("symbol", "t", "buy_qty", "sell_qty", fx.imbalance(F.col("buy_qty"), F.col("sell_qty")).alias("imbalance"))


@query("f8_vol_barriers", f"""select symbol, t, v * sqrt(6.0) * 1.5 as take_bps, v * sqrt(6.0) * 1.0 as stop_bps from (select *, case when count(r) {over(-11, 0)} = 12 then stddev_pop(r) {over(-11, 0)} end as v from lagged) ## take_bps, stop_bps""", LAGGED)
def f8(spark, sf):
    d = lagged(spark, sf).withColumn("v", fx.rolling_vol(12))
    return d.select("symbol", "t", *[c.alias(k) for k, c in fx.vol_barriers("v", 6, 1.5, 1.0).items()])


@query("f9_momentum", f"""select symbol, t, m as momentum, least(0.95, 0.5 + 0.45 * (1 - exp(-abs(m) / 20))) as confidence, case when abs(m) < 2 then 'NO_TRADE' when m > 0 then 'LONG' when m < 0 then 'SHORT' end as direction
  from (select *, (close / lag(close, 5) over ({W}) - 1) * 1e4 as m from bars) where m is not null ## momentum, confidence""")
def f9(spark, sf):
    return features(spark, sf, **fx.momentum_signal(6)).filter("momentum is not null")


SIGNALS = f"""{BARS}, signals as (select symbol, t, c as confidence, direction, lead(close) over ({W}) as future, close from
  (select *, least(0.95, 0.5 + 0.45 * (1 - exp(-abs(m) / 20))) as c, case when abs(m) < 2 then 'NO_TRADE' when m > 0 then 'LONG' when m < 0 then 'SHORT' end as direction
  from (select *, (close / lag(close, 5) over ({W}) - 1) * 1e4 as m from bars)) where m is not null),
outcomes as (select *, case when future > close then 'LONG' when future is not null then 'SHORT' end as outcome, (future / close - 1) * 1e4 * case direction when 'LONG' then 1 when 'SHORT' then -1 else 0 end as gross from signals),
trades as (select *, gross - 2.0 as net, t + 3600 as t_end, t // 86400 as day, direction as side from outcomes where direction <> 'NO_TRADE' and future is not null)"""


def outcomes(spark, sf):
    b = hourly(spark, sf)
    d = b.select("symbol", "t", "close", *[c.alias(k) for k, c in fx.momentum_signal(6).items()], *[c.alias(k) for k, c in labels.direction_outcome(1).items()]).filter("momentum is not null")
    sign = F.when(F.col("direction") == "LONG", 1).when(F.col("direction") == "SHORT", -1).otherwise(0)
    return d.withColumn("gross", (F.col("future") / F.col("close") - 1) * 1e4 * sign)


def trades(spark, sf):
    d = outcomes(spark, sf).filter("direction <> 'NO_TRADE' and future is not null")
    return d.withColumns({"net": F.col("gross") - 2.0, "t_end": F.col("t") + HOUR, "day": F.floor(F.col("t") / 86400).cast("long"), "side": F.col("direction")})


@query("f10_confidence_gate", """select k as threshold, count(*) as n, count(*) filter (where direction <> 'NO_TRADE' and confidence >= k) as acted,
  count(*) filter (where direction = outcome and confidence >= k) as hits from outcomes cross join (values (0.6), (0.8), (0.9)) g(k) where outcome is not null group by k ## threshold""", SIGNALS)
def f10(spark, sf):
    g = spark.createDataFrame([(0.6,), (0.8,), (0.9,)], "threshold double")
    d = outcomes(spark, sf).filter("outcome is not null").crossJoin(F.broadcast(g))
    ok = F.col("confidence") >= F.col("threshold")
    return d.groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(ok & (F.col("direction") != "NO_TRADE")).alias("acted"), F.count_if(ok & (F.col("direction") == F.col("outcome"))).alias("hits"))


@query("f11_outcomes", "select symbol, t, outcome, case when direction = 'NO_TRADE' then 'NO_TRADE' when direction = outcome then 'CORRECT' else 'WRONG' end as verdict from outcomes where outcome is not null", SIGNALS)
def f11(spark, sf):
    v = F.when(F.col("direction") == "NO_TRADE", "NO_TRADE").when(F.col("direction") == F.col("outcome"), "CORRECT").otherwise("WRONG")
    return outcomes(spark, sf).filter("outcome is not null").select("symbol", "t", "outcome", v.alias("verdict"))


@query("f12_cost_excess", "select symbol, t, sign(gross) * greatest(abs(gross) - 12, 0.0) as target from outcomes where gross is not null ## target", SIGNALS)
def f12(spark, sf):
    return outcomes(spark, sf).filter("gross is not null").select("symbol", "t", labels.cost_excess(F.col("gross"), 12.0).alias("target"))


@query("w1_rolling_vol", "select symbol, t, " + ", ".join(f"case when count(r) {over(-n + 1, 0)} = {n} then stddev_pop(r) {over(-n + 1, 0)} end as v{n}" for n in (6, 12, 24, 48)) + " from lagged ## v6, v12, v24, v48", LAGGED)
def w1(spark, sf):
    return features(spark, sf, **{f"v{n}": fx.rolling_vol(n) for n in (6, 12, 24, 48)})


@query("w2_sma_distance", "select symbol, t, " + ", ".join(f"case when count(*) {over(-n + 1, 0)} = {n} then (close / avg(close) {over(-n + 1, 0)} - 1) * 1e4 end as s{n}" for n in (12, 24)) + " from bars ## s12, s24")
def w2(spark, sf):
    return features(spark, sf, **{f"s{n}": fx.sma_distance(n) for n in (12, 24)})


@query("w3_ema", f"""select symbol, t, e as ema from (with recursive n as (select symbol, t, close, row_number() over ({W}) as k from bars), e as (
  select symbol, t, k, close as e from n where k = 1 union all select n.symbol, n.t, n.k, 2.0 / 13 * n.close + 11.0 / 13 * e.e from e join n on n.symbol = e.symbol and n.k = e.k + 1) select * from e) ## ema""")
def w3(spark, sf):
    return fx.exponential(hourly(spark, sf), "close", 2 / 13, "ema", block=64).select("symbol", "t", "ema")


@query("w4_rsi", f"""select symbol, t, case when count(d) {over(-13, 0)} = 14 then case when dn > 0 then 100 - 100 / (1 + up / dn) when up > 0 then 100.0 else 50.0 end end as rsi from
  (select *, avg(greatest(d, 0.0)) {over(-13, 0)} as up, avg(greatest(-d, 0.0)) {over(-13, 0)} as dn from lagged) ## rsi""", LAGGED)
def w4(spark, sf):
    return features(spark, sf, rsi=fx.rsi(14))


@query("w5_atr", f"select symbol, t, case when count(tr) {over(-13, 0)} = 14 then avg(tr) {over(-13, 0)} / close * 1e4 end as atr from lagged ## atr", LAGGED)
def w5(spark, sf):
    return features(spark, sf, atr=fx.atr(14))


@query("w6_range_position", "select symbol, t, " + ", ".join(f"case when count(*) {over(-n + 1, 0)} = {n} then case when max(high) {over(-n + 1, 0)} > min(low) {over(-n + 1, 0)} then (close - min(low) {over(-n + 1, 0)}) / (max(high) {over(-n + 1, 0)} - min(low) {over(-n + 1, 0)}) else 0.5 end end as p{n}" for n in (12, 24)) + " from bars ## p12, p24")
def w6(spark, sf):
    return features(spark, sf, **{f"p{n}": fx.range_position(n) for n in (12, 24)})


@query("w8_percentile_rank", """select a.symbol, a.t, case when count(b.close) = 0 then 0.5 else count(*) filter (where b.close <= a.close) / count(b.close)::double end as rank from
  (select *, row_number() over (partition by symbol order by t) as k from bars) a left join (select *, row_number() over (partition by symbol order by t) as k from bars) b
  on a.symbol = b.symbol and b.k between a.k - 48 and a.k - 1 group by a.symbol, a.t, a.close ## rank""")
def w8(spark, sf):
    return features(spark, sf, rank=fx.percentile_rank("close", 48))


@query("w9_drawdowns", """select symbol, max((1 - exp(lg - pk)) * 100) as compounded_dd, max(before - eq) as earlier_peak_dd, max(pa - eq) as additive_dd from (
  select *, greatest(0, max(lg) over (partition by symbol order by t rows unbounded preceding)) as pk, greatest(0, max(eq) over (partition by symbol order by t rows unbounded preceding)) as pa,
    greatest(coalesce(max(eq) over (partition by symbol order by t rows between unbounded preceding and 1 preceding), 0), 0) as before from (
  select symbol, t, sum(net) over (partition by symbol order by t rows unbounded preceding) as eq, sum(ln(1 + net / 1e4)) over (partition by symbol order by t rows unbounded preceding) as lg from trades where net > -9999)) group by symbol
  ## compounded_dd, earlier_peak_dd, additive_dd""", SIGNALS)
def w9(spark, sf):
    return metrics.drawdowns(trades(spark, sf).filter("net > -9999"), "symbol", ["t"], WEEK)


@query("w10_trend_consistency", f"""select symbol, t, case when w > 0 then up / 12.0::double when w < 0 then dn / 12.0::double when w = 0 then 0.5 end as trend from (select *, close - lag(close, 12) over ({W}) as w,
  sum(case when d > 0 then 1 else 0 end) {over(-11, 0)} as up, sum(case when d < 0 then 1 else 0 end) {over(-11, 0)} as dn from lagged) ## trend""", LAGGED)
def w10(spark, sf):
    return features(spark, sf, trend=fx.trend_consistency(12))


@query("w11_sigma_before", f"select symbol, t, case when count(r) {over(-48, -1)} = 48 and stddev_pop(r) {over(-48, -1)} > 0 then stddev_pop(r) {over(-48, -1)} end as sigma from lagged ## sigma", LAGGED)
def w11(spark, sf):
    return features(spark, sf, sigma=fx.sigma_before(48))


@query("w12_non_overlap", f"""select symbol, t, t_end from (with recursive n as (select symbol, t, t + 3 * 3600 as t_end, row_number() over ({W}) as k from bars), c as (
  select symbol, t, t_end, k, true as keep, t_end as last from n where k = 1 union all
  select n.symbol, n.t, n.t_end, n.k, n.t >= c.last, case when n.t >= c.last then n.t_end else c.last end from c join n on n.symbol = c.symbol and n.k = c.k + 1) select * from c where keep)""")
def w12(spark, sf):
    d = hourly(spark, sf).select("symbol", "t", (F.col("t") + 3 * HOUR).alias("t_end"))
    return labels.non_overlapping(d, "symbol", "t", "t_end", block=WEEK)


@query("w13_realized_vol", f"""select symbol, t, case when count(r) {over(-23, 0)} = 24 then sqrt(sum(r * r) {over(-23, 0)}) end as rv24,
  case when count(*) {over(-23, 0)} = 24 then case when stddev_pop(close) {over(-23, 0)} > 0 then (close - avg(close) {over(-23, 0)}) / stddev_pop(close) {over(-23, 0)} else 0.0 end end as z24 from lagged ## rv24, z24""", LAGGED)
def w13(spark, sf):
    return features(spark, sf, rv24=fx.realized_vol(24), z24=fx.z_price(24))


@query("w14_prior_z", f"""select symbol, t, case when count(close) {over(-60, -1)} = 60 then case when stddev_pop(close) {over(-60, -1)} > 0 then (close - avg(close) {over(-60, -1)}) / stddev_pop(close) {over(-60, -1)} else 0.0 end end as z from bars ## z""")
def w14(spark, sf):
    return features(spark, sf, z=fx.prior_z("close", 60))


@query("w15_gap_segments", """select symbol, us, tick_id, sum(cut) over (partition by symbol order by us, tick_id rows unbounded preceding)::bigint as segment from (
  select *, case when coalesce(us - lag(us) over (partition by symbol order by us, tick_id) > 1800000000 or not valid or not lag(valid) over (partition by symbol order by us, tick_id), false) then 1 else 0 end as cut
  from (select *, qty > 5 as valid from ticks))""", TICKS_SQL)
def w15(spark, sf):
    return grids.gap_segments(ticks(spark, sf).withColumn("valid", F.col("qty") > 5), 1_800_000_000).select("symbol", "us", "tick_id", "segment")


@query("w16_window_imbalance", """select symbol, us, tick_id, case when tot > 0 then s / tot else 0.0 end as imbalance from (select *, sum(qty) over w as tot, sum(case when side = 'buy' then qty else -qty end) over w as s from ticks
  window w as (partition by symbol order by us range between 3599999999 preceding and current row)) ## imbalance""", TICKS_SQL)
def w16(spark, sf):
    return grids.window_imbalance(ticks(spark, sf), HOUR).select("symbol", "us", "tick_id", "imbalance")


@query("w17_forward_returns", f"select symbol, t, ln(lead(close, 3) over ({W}) / close) * 1e4 as f3, (lead(close, 3) over ({W}) / lead(open, 1) over ({W}) - 1) * 1e4 as x3 from bars ## f3, x3")
def w17(spark, sf):
    return features(spark, sf, f3=labels.forward_return(3), x3=labels.executable_return(3))


BARRIER = """select symbol, t, exit_bars, reason, gross_bps, gross_bps - 2.0 as net_bps, gross_bps > 0 as won from (
  select *, case reason when 'TAKE_PROFIT' then 3000.0 when 'HORIZON' then (xc / close - 1) * 1e4 else -2000.0 end as gross_bps from (
  select f.symbol, f.t, f.close, coalesce(x, 6) as exit_bars, p.close as xc,
    case when p.high >= f.close * 1.3 and p.low <= f.close * 0.8 then 'AMBIGUOUS_BAR_STOP_FIRST' when p.low <= f.close * 0.8 then 'STOP' when p.high >= f.close * 1.3 then 'TAKE_PROFIT' else 'HORIZON' end as reason
  from (select a.symbol, a.t, a.k, a.close, count(b.k) as m, min(case when b.high >= a.close * 1.3 or b.low <= a.close * 0.8 then b.k - a.k end) as x
    from numbered a join numbered b on a.symbol = b.symbol and b.k between a.k + 1 and a.k + 6 group by a.symbol, a.t, a.k, a.close) f
  join numbered p on p.symbol = f.symbol and p.k = f.k + coalesce(f.x, 6) where f.m = 6)) ## gross_bps, net_bps"""
NUMBERED = f"{BARS}, numbered as (select *, row_number() over ({W}) as k from bars)"


@query("w19_barrier_labels", BARRIER, NUMBERED)
def w19(spark, sf):
    d = labels.barrier_labels(hourly(spark, sf), 6, 3000.0, 2000.0, 2.0)
    return d.select("symbol", "t", F.col("exit_bars").cast("long"), "reason", "gross_bps", "net_bps", "won")


@query("ag15_label_audit", "select symbol, reason, count(*) as n, avg(net_bps) as mean_net from (" + BARRIER.split("##")[0] + ") group by symbol, reason ## mean_net", NUMBERED)
def ag15(spark, sf):
    return labels.barrier_labels(hourly(spark, sf), 6, 3000.0, 2000.0, 2.0).groupBy("symbol", "reason").agg(F.count("*").alias("n"), F.avg("net_bps").alias("mean_net"))


@query("w20_equity_series", """select symbol, t, avg(case when net > 0 then 1.0 else 0.0 end) over (partition by symbol order by t rows unbounded preceding) as hit_rate,
  (exp(sum(ln(1 + net / 1e4)) over (partition by symbol order by t rows unbounded preceding)) - 1) * 100 as equity_pct from trades where net > -9999 ## hit_rate, equity_pct""", SIGNALS)
def w20(spark, sf):
    return metrics.equity_series(trades(spark, sf).filter("net > -9999"), "symbol", ["t"], WEEK).select("symbol", "t", "hit_rate", "equity_pct")


PEER = f"""{BARS}, peer as (select symbol, us, tick_id, price, row_number() over (partition by symbol, us order by tick_id desc) as u from ticks where venue = 0)"""


@query("j1_asof", """select symbol, us, tick_id, case when us - pus <= 7200000000 then pus end as asof_t, case when us - pus <= 7200000000 then pprice end as peer_price from (
  select l.symbol, l.us, l.tick_id, p.us as pus, p.price as pprice from ticks l asof left join (select * from peer where u = 1) p on l.symbol = p.symbol and l.us >= p.us where l.venue = 1) ## peer_price""", PEER)
def j1(spark, sf):
    t = ticks(spark, sf)
    peer = t.filter("venue = 0").select("symbol", "us", F.col("price").alias("peer_price"))
    return joins.asof(t.filter("venue = 1").select("symbol", "us", "tick_id"), peer, ["peer_price"], on="us", by=["symbol"], max_age=7_200_000_000, block=86_400_000_000)


@query("j2_peer_packet", """select symbol, us, tick_id, case when ok then 1.0 else 0.0 end as available, case when ok then (us - pus) / 7200000000.0::double else 1.25 end as relative_age, case when ok then pprice else 0.0 end as peer_price from (
  select l.symbol, l.us, l.tick_id, p.us as pus, p.price as pprice, coalesce(l.us - p.us <= 7200000000, false) as ok from ticks l asof left join (select * from peer where u = 1) p on l.symbol = p.symbol and l.us >= p.us where l.venue = 1) ## available, relative_age, peer_price""", PEER)
def j2(spark, sf):
    t = ticks(spark, sf)
    j = joins.asof(t.filter("venue = 1").select("symbol", "us", "tick_id"), t.filter("venue = 0").select("symbol", "us", F.col("price").alias("peer_price")), ["peer_price"], on="us", by=["symbol"], max_age=7_200_000_000, block=DAY_US)
    return joins.masked_packet(j, ["peer_price"], F.col("us") - F.col("asof_t"), 7_200_000_000.0).drop("asof_t")


@query("j5_last_valid", """select l.symbol, l.us, l.tick_id, p.price as peer_price, ln(1 + (l.us - p.us) / 3600000000.0::double) as log_age, coalesce(l.us - p.us <= 300000000, false) as fresh from (select * from ticks where venue = 1) l
  asof left join (select * from ticks where venue = 0 and qty >= 50) p on l.symbol = p.symbol and l.us >= p.us ## peer_price, log_age""", TICKS_SQL)
def j5(spark, sf):
    t = ticks(spark, sf)
    peer = t.filter("venue = 0 and qty >= 50").select("symbol", "us", F.col("price").alias("peer_price"))
    j = joins.asof(t.filter("venue = 1").select("symbol", "us", "tick_id"), peer, ["peer_price"], on="us", by=["symbol"], block=DAY_US)
    age = F.col("us") - F.col("asof_t")
    return j.select("symbol", "us", "tick_id", "peer_price", F.log1p(age / 3.6e9).alias("log_age"), F.coalesce(age <= 300_000_000, F.lit(False)).alias("fresh"))


@query("j6_bitemporal", """select d.day, s.series, case when v3 is not null then 1.0 else 0.0 end as available, case when v3 is not null then (d.day - k1)::double else 999.0 end as age,
  case when v3 is not null then (v1 / v2 - 1) * 100 else 0.0 end as change, case when v3 is not null then (v2 / v3 - 1) * 100 else 0.0 end as earlier_change
  from (values (9300::bigint), (9700::bigint), (10500::bigint), (11400::bigint)) d(day) cross join (select distinct series from ledger) s left join (
  select day, series, max(case when k = 1 then value end) as v1, max(case when k = 2 then value end) as v2, max(case when k = 3 then value end) as v3, max(case when k = 1 then known end) as k1 from (
    select *, row_number() over (partition by day, series order by observed desc) as k from (
      select d.day, l.*, row_number() over (partition by d.day, series, observed order by known desc, seq desc) as r from (values (9300::bigint), (9700::bigint), (10500::bigint), (11400::bigint)) d(day) join ledger l on l.known <= d.day) where r = 1) group by day, series) p
  on p.day = d.day and p.series = s.series ## available, age, change, earlier_change""", LEDGER_SQL)
def j6(spark, sf):
    days = spark.createDataFrame([(9300,), (9700,), (10500,), (11400,)], "day long")
    return joins.point_in_time(days, ledger(spark, sf))


@query("j6_every_day", """select d.day, s.series, case when v3 is not null then 1.0 else 0.0 end as available, case when v3 is not null then (d.day - k1)::double else 999.0 end as age,
  case when v3 is not null then (v1 / v2 - 1) * 100 else 0.0 end as change, case when v3 is not null then (v2 / v3 - 1) * 100 else 0.0 end as earlier_change
  from (select unnest(generate_series((select min(known) - 5 from ledger), (select max(known) + 90 from ledger), 7)) as day) d cross join (select distinct series from ledger) s left join (
  select day, series, max(case when k = 1 then value end) as v1, max(case when k = 2 then value end) as v2, max(case when k = 3 then value end) as v3, max(case when k = 1 then known end) as k1 from (
    select *, row_number() over (partition by day, series order by observed desc) as k from (
      select d.day, l.*, row_number() over (partition by d.day, l.series, observed order by known desc, seq desc) as r from (select unnest(generate_series((select min(known) - 5 from ledger), (select max(known) + 90 from ledger), 7)) as day) d join ledger l on l.known <= d.day and l.known > d.day - 200) where r = 1) group by day, series) p
  on p.day = d.day and p.series = s.series ## available, age, change, earlier_change""", LEDGER_SQL)
def j6_days(spark, sf):
    """A question each week."""
    d = ledger(spark, sf)
    lo, hi = d.agg(F.min("known") - 5, F.max("known") + 90).first()
    return joins.point_in_time(spark.range(lo, hi + 1, 7).toDF("day"), d, cell=32)


@query("j8_snapshot_slots", "select distinct symbol, cast(ceil(us / 250000.0) as bigint) * 250000 as slot_us from ticks where qty > 90", TICKS_SQL)
def j8(spark, sf):
    return grids.ceil_slots(ticks(spark, sf).filter("qty > 90"), 250_000)


@query("j12_paired", "select concat(a.v, '->', b.v) as transition, count(*) as n from (select symbol, t, case when direction = outcome then 'CORRECT' else direction end as v from outcomes where outcome is not null) a join (select symbol, t, case when confidence < 0.9 then 'NO_TRADE' when direction = outcome then 'CORRECT' else direction end as v from outcomes where outcome is not null) b on a.symbol = b.symbol and a.t = b.t group by 1", SIGNALS)
def j12(spark, sf):
    o = outcomes(spark, sf).filter("outcome is not null")
    v = F.when(F.col("direction") == F.col("outcome"), "CORRECT").otherwise(F.col("direction"))
    a = o.select("symbol", "t", v.alias("verdict"))
    b = o.select("symbol", "t", F.when(F.col("confidence") < 0.9, "NO_TRADE").otherwise(v).alias("verdict"))
    return joins.paired(a, b, ["symbol", "t"])


@query("j16_grid", "select h, q, count(*) as n from bars cross join (values (1), (3), (6)) a(h) cross join (values (0.1), (0.2)) b(q) where n >= h group by h, q ## q")
def j16(spark, sf):
    g = spark.createDataFrame([(1,), (3,), (6,)], "h int").crossJoin(spark.createDataFrame([(0.1,), (0.2,)], "q double"))
    return hourly(spark, sf).crossJoin(F.broadcast(g)).filter("n >= h").groupBy("h", "q").agg(F.count("*").alias("n"))


@query("ag1_signal_metrics", """select symbol, count(*) as trades, avg(case when net > 0 then 1.0 else 0.0 end) as win_rate, avg(net) as expectancy, coalesce(sum(case when net > 0 then net end), 0) as gain, coalesce(-sum(case when net < 0 then net end), 0) as loss,
  (exp(sum(ln(1 + net / 1e4))) - 1) * 100 as compounded_pct, sum(net) as sum_net, sum(net * net) as sum_sq, case when sum(case when net < 0 then net end) < 0 then coalesce(sum(case when net > 0 then net end), 0) / -sum(case when net < 0 then net end) else 0.0 end as profit_factor
  from trades where net > -9999 group by symbol ## win_rate, expectancy, gain, loss, compounded_pct, sum_net, sum_sq, profit_factor""", SIGNALS)
def ag1(spark, sf):
    return metrics.trade_metrics(trades(spark, sf).filter("net > -9999"), ["symbol"])


@query("ag3_rich_metrics", """select symbol, count(*) as n, avg(net) as mean, avg(case when net > 0 then net end) as avg_win, avg(case when net < 0 then net end) as avg_loss, sum(net) as total, sum(net * net) as total_sq,
  avg(net) / stddev_samp(net) as sharpe, avg(net) / stddev_samp(case when net < 0 then net end) as sortino from trades group by symbol ## mean, avg_win, avg_loss, total, total_sq, sharpe, sortino""", SIGNALS)
def ag3(spark, sf):
    return metrics.rich_metrics(trades(spark, sf), ["symbol"])


@query("ag4_economics", """select symbol, c as cost_bps, count(*) as trades, sum(gross - c) as total, min(gross - c) as worst, avg(case when gross - c > 0 then 1.0 else 0.0 end) as positive, count(*) filter (where side = 'LONG') as longs, count(*) filter (where side = 'SHORT') as shorts
  from trades cross join (values (4.0), (8.0), (12.0)) g(c) group by symbol, c ## cost_bps, total, worst, positive""", SIGNALS)
def ag4(spark, sf):
    return metrics.economics(trades(spark, sf), spark.createDataFrame([(4.0,), (8.0,), (12.0,)], "cost_bps double"), ["symbol"])


@query("ag5_daily", """select symbol, count(*) as days, avg(n) as trades_a_day, count(*) filter (where n > 0) as active_days, median(case when n > 0 then n end)::double as median_active, avg(case when n > 0 then case when net > 0 then 1.0 else 0.0 end end) as positive_share,
  median(net) as median_net, avg(net) as mean_net, coalesce(min(five), sum(net)) as worst_five from (
  select *, case when count(*) over w = 5 then sum(net) over w end as five from (select s.symbol, d.day, coalesce(x.n, 0) as n, coalesce(x.net, 0.0) as net from (select distinct symbol from trades) s cross join (select unnest(generate_series(19720, 19755)) as day) d
  left join (select symbol, day, count(*) as n, sum(net) as net from trades group by 1, 2) x on x.symbol = s.symbol and x.day = d.day) window w as (partition by symbol order by day rows between 4 preceding and current row)) group by symbol
  ## trades_a_day, median_active, positive_share, median_net, mean_net, worst_five""", SIGNALS)
def ag5(spark, sf):
    return metrics.daily_statistics(trades(spark, sf), "symbol", 19720, 19755)


@query("ag6_hourly_share", "select symbol, count(*) as active_hours, avg(case when s > 0 then 1.0 else 0.0 end) as positive_share from (select symbol, t // 3600 % 24 as h, sum(net) as s from trades group by 1, 2) group by symbol ## positive_share", SIGNALS)
def ag6(spark, sf):
    d = trades(spark, sf).groupBy("symbol", (F.floor(F.col("t") / 3600) % 24).alias("h")).agg(F.sum("net").alias("s"))
    return d.groupBy("symbol").agg(F.count("*").alias("active_hours"), F.avg((F.col("s") > 0).cast("double")).alias("positive_share"))


PRED = f"{LAGGED}, preds as (select * from (select symbol, t, ln(lead(close, 1) over ({W}) / close) * 1e4 as y, -0.5 * r as pred from lagged) where y is not null and pred is not null)"


def preds(spark, sf):
    return lagged(spark, sf).select("symbol", "t", labels.forward_return(1).alias("y"), (-0.5 * F.col("r")).alias("pred")).dropna(subset=["y", "pred"])


@query("ag8_regression_quality", """select symbol, count(*) as n, avg((y - pred) ** 2) as mse, avg(abs(y - pred)) as mae, corr(y, pred) as pearson, avg(case when sign(y) = sign(pred) then 1.0 else 0.0 end) as sign_accuracy, sqrt(avg((y - pred) ** 2)) as rmse,
  1 - avg((y - pred) ** 2) / var_pop(y) as r2 from preds group by symbol ## mse, mae, pearson, sign_accuracy, rmse, r2""", PRED)
def ag8(spark, sf):
    return metrics.regression_quality(preds(spark, sf), ["symbol"])


@query("ag9_spearman", """select symbol, count(*) as n, corr(a, b) as spearman from (select symbol, rank() over (partition by symbol order by pred) + (count(*) over (partition by symbol, pred) - 1) / 2.0 as a,
  rank() over (partition by symbol order by y) + (count(*) over (partition by symbol, y) - 1) / 2.0 as b from preds) group by symbol ## spearman""", PRED)
def ag9(spark, sf):
    return metrics.spearman(preds(spark, sf), ["symbol"], "pred", "y")


BINARY = f"{SIGNALS}, twoclass as (select symbol, t, confidence as p, case when direction = outcome then 1 else 0 end as y from outcomes where outcome is not null and direction <> 'NO_TRADE')"


def binary(spark, sf):
    o = outcomes(spark, sf).filter("outcome is not null and direction <> 'NO_TRADE'")
    return o.select("symbol", "t", F.col("confidence").alias("p"), (F.col("direction") == F.col("outcome")).cast("int").alias("y"))


@query("ag11_calibration", """select symbol, least(floor(p * 10), 9)::integer as bin, count(*) as n, avg(p) as mean_p, avg(y) as rate, count(*) / (sum(count(*)) over (partition by symbol))::double * abs(avg(p) - avg(y)) as ece_part from twoclass group by 1, 2 ## mean_p, rate, ece_part""", BINARY)
def ag11(spark, sf):
    return metrics.calibration(binary(spark, sf), ["symbol"])


@query("ag11_brier_log_loss", "select symbol, avg((p - y) ** 2) as brier, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) as log_loss from twoclass group by symbol ## brier, log_loss", BINARY)
def ag11b(spark, sf):
    return metrics.brier_log_loss(binary(spark, sf), ["symbol"])


@query("ag12_roc_auc", """select symbol, count(*) filter (where y = 1) as positives, count(*) filter (where y = 0) as negatives, (sum(case when y = 1 then r end) - count(*) filter (where y = 1) * (count(*) filter (where y = 1) + 1) / 2.0) / (count(*) filter (where y = 1) * count(*) filter (where y = 0)) as auc
  from (select *, rank() over (partition by symbol order by p) + (count(*) over (partition by symbol, p) - 1) / 2.0 as r from twoclass) group by symbol ## auc""", BINARY)
def ag12(spark, sf):
    return metrics.roc_auc(binary(spark, sf), ["symbol"])


@query("ag13_confidence_buckets", "select lo, hi, count(y) as n, avg(y) as accuracy from (values (0.5, 0.6), (0.6, 0.7), (0.7, 0.8), (0.8, 0.9), (0.9, 0.94), (0.94, 1.01)) b(lo, hi) left join twoclass on p >= lo and p < hi group by lo, hi ## lo, hi, accuracy", BINARY)
def ag13(spark, sf):
    d = binary(spark, sf).select(F.col("p").alias("confidence"), F.col("y").alias("hit"))
    return metrics.confidence_buckets(d, [0.5, 0.6, 0.7, 0.8, 0.9, 0.94, 1.01])


@query("ag14_local_calibration", """select q.symbol, q.t, case when n >= 15 then least(greatest(h / n::double, 0.5), 0.99) else q.p end as calibrated from (select * from twoclass where t >= 1705276800) q left join (
  select c.p, count(*) as n, sum(y) as h from (select distinct p from twoclass where t >= 1705276800) c join (select p as vp, y from twoclass where t < 1705276800) v on vp between c.p - 0.05::double and c.p + 0.05::double group by c.p) x on x.p = q.p ## calibrated""", BINARY)
def ag14(spark, sf):
    d = binary(spark, sf).withColumnsRenamed({"p": "confidence", "y": "hit"})
    return metrics.local_calibration(d.filter("t >= 1705276800"), d.filter("t < 1705276800")).select("symbol", "t", "calibrated")


@query("ag16_transitions", f"select a, b, count(*) as n from (select direction as b, lag(direction) over ({W}) as a from outcomes) where a is not null group by a, b", SIGNALS)
def ag16(spark, sf):
    d = outcomes(spark, sf).withColumn("a", F.lag("direction").over(qa.by_time()))
    return d.filter("a is not null").groupBy("a", F.col("direction").alias("b")).agg(F.count("*").alias("n"))


@query("ag18_trade_buckets", """select symbol, us // 60000000 * 60 as t, sum(case when not buyer_maker then qty else 0.0 end) as buy_qty, sum(case when buyer_maker then qty else 0.0 end) as sell_qty, count(*) filter (where not buyer_maker) as buys, count(*) filter (where buyer_maker) as sells,
  sum(case when not buyer_maker then qty * price else 0.0 end) as buy_notional, sum(case when buyer_maker then qty * price else 0.0 end) as sell_notional, last(price order by us, tick_id) as price from ticks group by 1, 2 ## buy_qty, sell_qty, buy_notional, sell_notional, price""", TICKS_SQL)
def ag18(spark, sf):
    return grids.trade_buckets(ticks(spark, sf), 60)


@query("ag19_gram", """select i, j, s from (select 0 as i, 0 as j, count(*)::double as s from preds union all select 0, 1, sum(pred) from preds union all select 0, 2, sum(y) from preds union all select 1, 1, sum(pred * pred) from preds union all
  select 1, 2, sum(pred * y) from preds union all select 2, 2, sum(y * y) from preds) ## s""", PRED)
def ag19(spark, sf):
    return metrics.gram(preds(spark, sf), ["pred"], "y")


@query("ag20_threshold", "select symbol, quantile_cont(abs(pred), 0.75) as threshold from preds group by symbol ## threshold", PRED)
def ag20(spark, sf):
    return metrics.threshold_quantile(preds(spark, sf), ["symbol"], "pred", 0.75)


@query("k1_evenly_spaced", """select symbol, t, p as place from (select symbol, t, row_number() over (partition by symbol order by t) - 1 as p, count(*) over (partition by symbol) as n from bars)
  where n <= 50 or p in (select j * (n - 1) // 49 from (select unnest(generate_series(0, 49)) as j))""")
def k1(spark, sf):
    return metrics.evenly_spaced(hourly(spark, sf), "symbol", "t", 50, WEEK).select("symbol", "t", F.col("place").cast("long"))


@query("k2_top_fraction", """select symbol, count(*) as chosen, avg(y) as mean_outcome from (select *, row_number() over (partition by symbol order by pred desc, t) as k, count(*) over (partition by symbol) as n from preds) where k <= greatest(1, round_even(n * 0.1, 0)) group by symbol ## mean_outcome""", PRED)
def k2(spark, sf):
    d = preds(spark, sf).select("symbol", F.col("t").alias("seq"), F.col("pred").alias("score"), F.col("y").alias("outcome"))
    return metrics.top_fraction_mean(d, ["symbol"], 0.1)


@query("k4_leaderboard", "select symbol, t, net, place from (select symbol, t, net, cast(row_number() over (partition by symbol order by net desc, t) as integer) as place from trades) where place <= 10 ## net", SIGNALS)
def k4(spark, sf):
    return metrics.leaderboard(trades(spark, sf), "symbol", [F.desc("net"), F.col("t")]).select("symbol", "t", "net", "place")


@query("k8_stride", "select symbol, t from (select *, row_number() over (partition by symbol order by t) - 1 as k from bars) where k % 4 = 0")
def k8(spark, sf):
    return metrics.stride(hourly(spark, sf), "symbol", "t", 4, WEEK).select("symbol", "t")


@query("u1_shared_keys", "select t from bars where symbol = 'click' intersect select t from bars where symbol = 'view'")
def u1(spark, sf):
    b = hourly(spark, sf)
    return b.filter("symbol = 'click'").select("t").intersect(b.filter("symbol = 'view'").select("t"))


@query("u2_missing_and_extra", "select t, 'missing' as what from (select t from bars where symbol = 'click' except select t from bars where symbol = 'view') union all select t, 'extra' from (select t from bars where symbol = 'view' except select t from bars where symbol = 'click')")
def u2(spark, sf):
    b = hourly(spark, sf)
    return joins.missing_and_extra(b.filter("symbol = 'click'"), b.filter("symbol = 'view'"), ["t"])


@query("r8_trade_bins", """select symbol, slot_us, sum(case when side = 'buy' then qty else 0.0 end) as buy_qty, sum(case when side = 'buy' then 0.0 else qty end) as sell_qty, count(*) filter (where side = 'buy') as buys, count(*) filter (where side <> 'buy') as sells from (
  select *, cast(ceil(us / 250000.0) as bigint) * 250000 + case when us % 250000 = 0 and row_number() over (partition by symbol, us order by tick_id) > 1 then 250000 else 0 end as slot_us from ticks) group by 1, 2 ## buy_qty, sell_qty""", TICKS_SQL)
def r8(spark, sf):
    return grids.trade_bins(ticks(spark, sf), 250_000)


@query("s6_ledger_summary", "select series, count(*) as n, min(known) as first_known, max(known) as last_known, count(distinct observed) as months from ledger group by series", LEDGER_SQL)
def s6(spark, sf):
    return ledger(spark, sf).groupBy("series").agg(F.count("*").alias("n"), F.min("known").alias("first_known"), F.max("known").alias("last_known"), F.countDistinct("observed").alias("months"))


@query("s5_upsert", "select symbol, t, close from (select *, row_number() over (partition by symbol, t order by seq desc) as k from (select symbol, t, close, 1 as seq from bars union all select symbol, t, close * 2, 2 from bars where n % 2 = 0)) where k = 1 ## close")
def s5(spark, sf):
    from ..sources.tables import upsert

    b = hourly(spark, sf)
    new = b.filter("n % 2 = 0").select("symbol", "t", "close", F.explode(F.array(*map(F.lit, (5, 2, 4)))).alias("k"))
    new = new.select("symbol", "t", (F.col("close") * F.col("k")).alias("close"), (-F.col("k")).alias("seq"))  # three writes of each key
    return upsert(b.select("symbol", "t", "close"), new, ["symbol", "t"], "seq")


@query("s2_columnar_payload", "select symbol, t, open, high, low, close from bars where n % 3 <> 0 ## open, high, low, close")
def s2(spark, sf):
    from ..sources.tables import parse_columnar

    b = hourly(spark, sf)
    hole = b.withColumn("close", F.when(F.col("n") % 3 != 0, F.col("close")))
    pack = [F.col(f"rows.{c}").alias(n) for n, c in (("timestamp", "t"), ("open", "open"), ("high", "high"), ("low", "low"), ("close", "close"))]
    day = hole.groupBy("symbol", F.floor(F.col("t") / 86400).alias("day")).agg(F.sort_array(F.collect_list(F.struct("t", "open", "high", "low", "close"))).alias("rows"))
    # to_json leaves nulls inside arrays as null, so a hole stays at its place
    return parse_columnar(day.select("symbol", F.to_json(F.struct(*pack)).alias("payload")), "payload").select("symbol", F.col("t"), "open", "high", "low", "close")


@query("s18_fingerprint", """select count(*) as n, sum(cast(h as decimal(38,0)))::varchar as total, bit_xor(h) as mixed from (select cast('0x' || substr(md5(concat_ws('|', o_orderkey::varchar, o_custkey::varchar, o_orderstatus,
  cast(round(o_totalprice * 100) as bigint)::varchar, date_diff('day', date '1970-01-01', cast(o_orderdate as date))::varchar, o_orderpriority)), 1, 15) as bigint) as h from orders)""")
def s18(spark, sf):
    from ..sources.tables import fingerprint

    text = lambda c: F.col(c).cast("string")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return fingerprint(table(spark, sf, "orders"), [text("o_orderkey"), text("o_custkey"), text("o_orderstatus"), cents.cast("string"), day.cast("string"), text("o_orderpriority")])
