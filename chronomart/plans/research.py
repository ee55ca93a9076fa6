"""Further registered queries: audits, venues, order books, passive orders, selection. Each has SQL for another engine."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import features as fx
from ..operators import audits, grids, joins, labels, metrics, queue, selection, venues, verdicts
from ..sources.adapters import HOUR, LEDGER_SQL, TICKS_SQL, bars, hourly, ledger, ticks
from .market import ALL, BARS, FLAGGED, LAGGED, NUMBERED, PEER, PRED, SIGNALS, WEEKDAY_SQL, DAY_US, W, WEEK, binary, flagged, over, preds, query, trades

BY_TICK = "partition by symbol order by us, tick_id"


@query("q12_event_audit", f"""select symbol, day, count(*) as n, count(*) filter (where back) as bad_order, count(*) filter (where not price > 101) as bad_price, count(*) filter (where not coalesce(qty >= 3, false)) as bad_amount,
  count(*) filter (where qty > 95) as snapshots, count(*) filter (where early) as before_snapshot from (select *, coalesce(us < lag(us) over (partition by symbol, day order by tick_id), false) as back,
  max(case when qty > 95 then 1 else 0 end) over (partition by symbol, day order by tick_id rows unbounded preceding) = 0 as early from (select *, us // {DAY_US} as day from ticks)) group by symbol, day""", TICKS_SQL)
def q12(spark, sf):
    t = ticks(spark, sf).withColumn("day", F.floor(F.col("us") / DAY_US).cast("long"))
    checks = {"bad_price": F.col("price") > 101, "bad_amount": F.col("qty") >= 3}
    return audits.event_audit(t, ["symbol", "day"], ["tick_id"], time="us", checks=checks, snapshot=F.col("qty") > 95)


def aged(spark, sf):
    t = ticks(spark, sf)
    return joins.asof(t.filter("venue = 1").select("symbol", "us", "tick_id"), t.filter("venue = 0").select("symbol", "us", "price"), ["price"], on="us", by=["symbol"], block=DAY_US)


AGED = f"{PEER}, aged as (select l.symbol, l.us, l.tick_id, p.us as asof_t, l.us - p.us as age from ticks l asof left join (select * from peer where u = 1) p on l.symbol = p.symbol and l.us >= p.us where l.venue = 1)"


@query("q13_peer_alignment", """select symbol, count(*) as n, count(asof_t) as available, count(*) filter (where age <= 3600000000) as complete, count(*) filter (where not coalesce(age <= 3600000000, false)) as stale_or_missing,
  count(*) filter (where age < 0) as future from aged group by symbol""", AGED)
def q13(spark, sf):
    return audits.alignment(aged(spark, sf), ["symbol"], on="us", max_age=3_600_000_000)


@query("q13_staleness_histogram", "select symbol, age // 60000000 as age, count(*) as n from (select symbol, age from aged where age is not null) group by 1, 2", AGED)
def q13b(spark, sf):
    return audits.age_histogram(aged(spark, sf), ["symbol"], on="us", unit=60_000_000)


@query("q14_known_state", """select d.day, series, count(distinct observed) as observations, max(observed) as latest_observed, max(known) as latest_known from (values (9300::bigint), (9700::bigint), (10500::bigint)) d(day)
  join ledger on known <= d.day group by d.day, series""", LEDGER_SQL)
def q14(spark, sf):
    return audits.known_state(spark.createDataFrame([(9300,), (9700,), (10500,)], "day long"), ledger(spark, sf))


@query("q16_age_profile", "select symbol, count(a) as n, min(a) as least, max(a) as most, avg(a) as mean, " + ", ".join(f"quantile_cont(a, {q}) as p{round(100 * q):02d}" for q in (0.01, 0.05, 0.5, 0.95, 0.99)) + """, count(a) / count(*)::double as valid
  from (select symbol, cast(age // 1000000 as double) as a from aged) group by symbol ## least, most, mean, p01, p05, p50, p95, p99, valid""", AGED)
def q16(spark, sf):
    return audits.age_profile(aged(spark, sf), ["symbol"], on="us", unit=1_000_000)


@query("q16_coverage_ratio", f"""select symbol, day, b as base_rows, o as other_rows, case when b > 0 then o / b::double end as ratio from (select symbol, us // {DAY_US} as day, count(*) filter (where venue = 0) as b, count(*) filter (where venue = 1) as o
  from ticks group by 1, 2) ## ratio""", TICKS_SQL)
def q16b(spark, sf):
    t = ticks(spark, sf).withColumn("day", F.floor(F.col("us") / DAY_US).cast("long"))
    return audits.coverage_ratio(t, ["symbol", "day"], "venue", 0, 1)


@query("q17_manifest", """select symbol, day, case when an is null then 'missing' when en is null then 'extra' when en <> an then 'rows' when ec <> ac then 'content' else 'ok' end as status from
  (select symbol, day, n + case when day % 5 = 0 then 1 else 0 end as en, checksum + case when day % 3 = 0 then 1 else 0 end as ec from m where not (day % 7 = 0 and symbol = 'click')) e full join
  (select symbol, day, n as an, checksum as ac from m where not (day % 11 = 0 and symbol = 'view')) a using (symbol, day)""", f"{BARS}, m as (select symbol, t // 86400 as day, count(*) as n, cast(sum(n * 31 + t % 1009) as bigint) as checksum from bars group by 1, 2)")
def q17(spark, sf):
    m = hourly(spark, sf).groupBy("symbol", F.floor(F.col("t") / 86400).cast("long").alias("day")).agg(F.sum(F.col("n") * 31 + F.col("t") % 1009).alias("checksum"), F.count("*").alias("n"))
    one = lambda k: (F.col("day") % k == 0).cast("long")
    expected = m.filter("not (day % 7 = 0 and symbol = 'click')").select("symbol", "day", (F.col("n") + one(5)).alias("n"), (F.col("checksum") + one(3)).alias("checksum"))
    return audits.verify_manifest(expected, m.filter("not (day % 11 = 0 and symbol = 'view')"), ["symbol", "day"])


@query("f6_session_flags", """select symbol, t, lo as london, ny as new_york, lo * ny as overlap, us_regular from (select symbol, t, case when wd < 5 and h between 8 and 16 then 1.0 else 0.0 end as lo, case when nwd < 5 and nm // 60 between 8 and 16 then 1.0 else 0.0 end as ny,
  case when nwd < 5 and nm >= 570 and nm < 960 then 1.0 else 0.0 end as us_regular from (select *, """ + WEEKDAY_SQL + """ as wd, t // 3600 % 24 as h, ((t - 18000) // 86400 + 3) % 7 as nwd, (t - 18000) % 86400 // 60 as nm from bars)) ## london, new_york, overlap, us_regular""")
def f6(spark, sf):
    d = hourly(spark, sf).withColumn("ts", F.timestamp_seconds("t"))
    return d.select("symbol", "t", *[c.alias(k) for k, c in fx.session_flags().items()])


@query("f13_macro_change", """select series, known, seq, case when series in ('1-URGENT', '2-HIGH') then (value / prior - 1) * 100 else value - prior end as change from (select *, lag(value) over (partition by series order by known, seq) as prior from ledger) ## change""", LEDGER_SQL)
def f13(spark, sf):
    prior = F.lag("value").over(Window.partitionBy("series").orderBy("known", "seq"))
    return ledger(spark, sf).select("series", "known", "seq", fx.macro_change(F.col("value"), prior, F.col("series").isin("1-URGENT", "2-HIGH")).alias("change"))


@query("f14_drift", f"select symbol, us, tick_id, (price / first(price) over (partition by symbol, us // {DAY_US} order by us, tick_id) - 1) * 1e4 as drift_bps from ticks ## drift_bps", TICKS_SQL)
def f14(spark, sf):
    frozen = F.first("price").over(Window.partitionBy("symbol", F.floor(F.col("us") / DAY_US)).orderBy("us", "tick_id"))
    return ticks(spark, sf).select("symbol", "us", "tick_id", fx.drift_bps(F.col("price"), frozen).alias("drift_bps"))


STREAMS = f"""{TICKS_SQL}, streams as (select symbol, t, max(case when venue = 0 then close end) as mark, max(case when venue = 1 then close end) as index, max(case when venue = 2 then close end) as premium from
  (select symbol, venue, us // 3600000000 * 3600 as t, last(price order by us, tick_id) as close from ticks group by 1, 2, 3) group by 1, 2
  having count(distinct venue) = 3), based as (select *, (mark / index - 1) * 1e4 as basis from streams)"""


def streams(spark, sf):
    t = ticks(spark, sf).withColumn("t", (F.floor(F.col("us") / 3_600_000_000) * 3600).cast("long"))
    closes = t.groupBy("symbol", "t", F.col("venue").alias("stream")).agg(F.max_by("price", F.struct("us", "tick_id")).alias("close"))
    return venues.streams_to_columns(closes, {0: "mark", 1: "index", 2: "premium"})


@query("s12_streams", "select * from streams ## mark, index, premium", STREAMS)
def s12(spark, sf):
    return streams(spark, sf)


def _block_sql() -> str:
    lag = lambda c, k: f"lag({c}, {k}) over ({W})"
    ret = lambda c, k: f"({c} / {lag(c, k)} - 1) * 1e4"
    parts, names = [], ["mark", "index", "premium", "basis"]
    for k in (1, 5, 15):
        for name, x in ((f"mark_r{k}", ret("mark", k)), (f"index_r{k}", ret("index", k)), (f"basis_d{k}", f"basis - {lag('basis', k)}"), (f"premium_d{k}", f"premium - {lag('premium', k)}"), (f"gap_r{k}", f"{ret('mark', k)} - {ret('index', k)}")):
            parts.append(f"{x} as {name}")
            names.append(name)
    for c in ("basis", "premium"):
        o = over(-24, -1)
        parts.append(f"case when count({c}) {o} = 24 then case when stddev_pop({c}) {o} > 0 then ({c} - avg({c}) {o}) / stddev_pop({c}) {o} else 0.0 end end as {c}_z")
        names.append(f"{c}_z")
    return f"select symbol, t, mark, index, premium, basis, {', '.join(parts)} from based ## {', '.join(names)}"


@query("f15_basis_block", _block_sql(), STREAMS)
def f15(spark, sf):
    return venues.basis_block(streams(spark, sf), 24)


@query("w7_ewma_volatility", f"""select symbol, t, last(case when k >= 12 then sqrt(greatest(m2 - m1 * m1, 0.0)) end ignore nulls) {over(ALL, 0)} as vol from (select f.symbol, f.t, c.k, c.m1, c.m2 from flagged f left join (
  with recursive u as (select symbol, t, x, row_number() over ({W}) as k from (select symbol, t, case when t - lag(t) over ({W}) = 3600 and eligible and lag(eligible) over ({W}) then ln(close / lag(close) over ({W})) * 1e4 end as x from flagged) where x is not null),
  c as (select symbol, t, k, x as m1, x * x as m2 from u where k = 1 union all select u.symbol, u.t, u.k, 2.0::double / 49 * u.x + (1 - 2.0::double / 49) * c.m1, 2.0::double / 49 * u.x * u.x + (1 - 2.0::double / 49) * c.m2 from c join u on u.symbol = c.symbol and u.k = c.k + 1) select * from c) c
  on c.symbol = f.symbol and c.t = f.t) ## vol""", FLAGGED)
def w7(spark, sf):
    return fx.ewma_volatility(flagged(spark, sf), span=48, least=12, step=HOUR)


@query("w18_executable_outcomes", f"""select symbol, t, case when ok then ln(xb / ea) * 1e4 end as long_bps, case when ok then ln(eb / xa) * 1e4 end as short_bps from (select symbol, t, lead(n, 1) over ({W}) >= 2 and lead(n, 4) over ({W}) >= 2 as ok,
  lead(close, 4) over ({W}) * 0.9999::double as xb, lead(close, 1) over ({W}) * 1.0001::double as ea, lead(close, 1) over ({W}) * 0.9999::double as eb, lead(close, 4) over ({W}) * 1.0001::double as xa from bars) ## long_bps, short_bps""")
def w18(spark, sf):
    b = hourly(spark, sf).select("symbol", "t", (F.col("close") * 0.9999).alias("bid"), (F.col("close") * 1.0001).alias("ask"), (F.col("n") >= 2).alias("valid"))
    return b.select("symbol", "t", *[c.alias(k) for k, c in fx.executable_outcomes(3).items()])


_ZS = ", ".join(f"lag(z, {k - 1}) over ({W}) as l{k}" for k in (1, 2, 3, 6))


PEERS = {"click": "view", "view": "error", "error": "purchase", "purchase": "signup", "signup": "click"}
PEERS_SQL = ", ".join(f"('{a}', '{b}')" for a, b in PEERS.items())


@query("j3_lag_packet", f"""select l.symbol, l.us, l.tick_id, p.t as asof_t, {', '.join(f'coalesce(l{k}, 0.0) as z{k}, case when l{k} is null then 0.0 else 1.0 end as ok{k}' for k in (1, 2, 3, 6))} from (select p.peer, t.* from ticks t join (values {PEERS_SQL}) p(symbol, peer) on p.symbol = t.symbol where venue = 1) l asof left join (
  select symbol, t, {_ZS} from (select symbol, t, case when t - lag(t) over ({W}) = 3600 and dev > 0 then (close / lag(close) over ({W}) - 1) * 1e4 / dev end as z from (
  select *, case when count(r) {over(-11, 0)} = 12 then stddev_pop(r) {over(-11, 0)} end as dev from lagged))) p on p.symbol = l.peer and l.us // 1000000 >= p.t + 3600 ## z1, z2, z3, z6, ok1, ok2, ok3, ok6""", LAGGED)
def j3(spark, sf):
    # a bar is known when its hour is over
    names = [f"{p}{k}" for k in (1, 2, 3, 6) for p in ("z", "ok")]
    packet = venues.lag_packet(hourly(spark, sf), (1, 2, 3, 6), 12, HOUR).withColumn("at", F.col("t") + HOUR)
    peer = F.coalesce(*[F.when(F.col("symbol") == a, F.lit(b)) for a, b in PEERS.items()]).alias("peer")
    left = ticks(spark, sf).filter("venue = 1").select("symbol", "us", "tick_id", peer, F.floor(F.col("us") / 1_000_000).cast("long").alias("at"))
    j = joins.asof(left, packet.withColumnRenamed("symbol", "peer"), names, on="at", by=["peer"], block=WEEK)
    return j.select("symbol", "us", "tick_id", (F.col("asof_t") - HOUR).alias("asof_t"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])


@query("j4_fresh_sensor", """select symbol, us, tick_id, p1, p3 from (select l.symbol, l.us, l.tick_id, l.us - p.us as age, p1, p3 from (select * from ticks where venue = 1) l asof join (select symbol, us, (price / lag(price, 1) over w - 1) * 1e4 as p1, (price / lag(price, 3) over w - 1) * 1e4 as p3
  from ticks where venue = 0 window w as (partition by symbol order by us, tick_id)) p on p.symbol = l.symbol and l.us >= p.us) where age <= 300000000 and p1 is not null and p3 is not null ## p1, p3""", TICKS_SQL)
def j4(spark, sf):
    t = ticks(spark, sf)
    w = Window.partitionBy("symbol").orderBy("us", "tick_id")
    sensor = t.filter("venue = 0").select("symbol", "us", *[((F.col("price") / F.lag("price", k).over(w) - 1) * 1e4).alias(f"p{k}") for k in (1, 3)])
    j = joins.asof(t.filter("venue = 1").select("symbol", "us", "tick_id"), sensor, ["p1", "p3"], on="us", by=["symbol"], max_age=300_000_000, block=3_600_000_000)
    return j.dropna(subset=["p1", "p3"]).drop("asof_t")


_J7 = "l.us - 600000000 - a.us <= 7200000000 and l.us - 2400000000 - b.us <= 7200000000 and l.us - 4200000000 - c.us <= 7200000000 and a.segment = b.segment and a.segment = c.segment"


@query("j7_delayed_packet", f"""select symbol, us, tick_id, ok as valid, case when ok then us - 600000000 - u0 end as age_us, case when ok then ln(p0 / p1) * 1e4 end as r1, case when ok then ln(p0 / p2) * 1e4 end as r2 from (
  select l.symbol, l.us, l.tick_id, a.us as u0, a.price as p0, b.price as p1, c.price as p2, coalesce({_J7}, false) as ok from (select * from ticks where venue = 1) l asof left join q a on a.symbol = l.symbol and l.us - 600000000 >= a.us
  asof left join q b on b.symbol = l.symbol and l.us - 2400000000 >= b.us asof left join q c on c.symbol = l.symbol and l.us - 4200000000 >= c.us) ## r1, r2""",
  f"{TICKS_SQL}, q as (select symbol, us, price, sum(cut) over ({BY_TICK} rows unbounded preceding) as segment from (select *, case when us - lag(us) over ({BY_TICK}) > 14400000000 then 1 else 0 end as cut from ticks where venue = 0))")
def j7(spark, sf):
    t = ticks(spark, sf)
    quotes = grids.gap_segments(t.filter("venue = 0").withColumn("valid", F.lit(True)), 14_400_000_000).select("symbol", "us", "price", "segment")
    return venues.delayed_packet(t.filter("venue = 1"), quotes, delay_us=600_000_000, anchors_us=(1_800_000_000, 3_600_000_000), max_age_us=7_200_000_000)


@query("j9_state_on_grid", """select b.symbol, b.t as open, b.t + 3540 as t, b.close, last(m.price order by m.t) as price from bars b join (select symbol, min(us // 60000000 * 60) as lo, max(us // 60000000 * 60) as hi from ticks group by 1) e on e.symbol = b.symbol and b.t + 3540 between lo and hi
  join (select symbol, us // 60000000 * 60 as t, last(price order by us, tick_id) as price from ticks group by 1, 2) m on m.symbol = b.symbol and m.t <= b.t + 3540 group by 1, 2, 3, 4 ## close, price""")
def j9(spark, sf):
    states = hourly(spark, sf).select("symbol", F.col("t").alias("open"), "close")
    grid = grids.filled_grid(grids.trade_buckets(ticks(spark, sf), 60), 60).select("symbol", "t", "price")
    return venues.aligned(states, grid, 3540).select("symbol", "open", "t", "close", "price")


@query("j10_grid_join", """select symbol, t, close, n, buys, sells from bars join (select symbol, us // 3600000000 * 3600 as t, count(*) filter (where not buyer_maker) as buys, count(*) filter (where buyer_maker) as sells from ticks group by 1, 2) using (symbol, t) ## close""")
def j10(spark, sf):
    t = ticks(spark, sf)
    return joins.grid(bars(t).select("symbol", "t", "close", "n"), grids.trade_buckets(t, HOUR).select("symbol", "t", "buys", "sells"), ["symbol", "t"])


@query("j11_common_support", """select symbol, t, max(case when venue = 0 then close end) as base, max(case when venue = 1 then close end) as spot, max(case when venue = 2 then close end) as other from
  (select symbol, venue, us // 3600000000 * 3600 as t, last(price order by us, tick_id) as close, count(*) as n from ticks group by 1, 2, 3 having count(*) >= 2) group by 1, 2 having count(*) = 3 ## base, spot, other""", TICKS_SQL)
def j11(spark, sf):
    t = ticks(spark, sf)
    one = lambda v: bars(t.filter(F.col("venue") == v)).select("symbol", "t", F.col("close").alias("x"), (F.col("n") >= 2).alias("valid"))
    return venues.common_support({"base": one(0), "spot": one(1), "other": one(2)}, ["symbol", "t"])


@query("j13_frozen_join", """select f.symbol, f.t, f.label, case when a.k is null or b.k is null then 'no_bar' when b.k - a.k <> 3 then 'not_apart' when case when b.close > a.close then 'LONG' else 'SHORT' end <> f.label then 'mismatch' else 'matched' end as status
  from (select symbol, t, t + 10800 as u, case when n % 2 = 0 then 'LONG' else 'SHORT' end as label from bars) f left join numbered a on a.symbol = f.symbol and a.t = f.t left join numbered b on b.symbol = f.symbol and b.t = f.u""", NUMBERED)
def j13(spark, sf):
    b = hourly(spark, sf)
    frozen = b.select("symbol", "t", (F.col("t") + 3 * HOUR).alias("t_future"), F.when(F.col("n") % 2 == 0, "LONG").otherwise("SHORT").alias("label"))
    return venues.frozen_join(frozen, b, 3)


@query("j14_decision_gate", f"""select m.symbol, m.t, case when b.t is null then 'UNAVAILABLE_BAR' when not clean then 'BLOCK_FEATURE_HISTORY' when vol is null or vol <= 0 then 'BLOCK_VOLATILITY' when event is null then 'BLOCK_FUTURE_EVENT' when score is null then 'UNAVAILABLE_MODEL' else 'PASS' end as gate
  from (select symbol, t + case when n % 9 = 0 then 1 else 0 end as t from bars) m left join (select symbol, t, min(cast(hard_eligible as integer)) {over(-3, 0)} = 1 and sum(gap) {over(-2, 0)} = 0 and count(*) {over(-3, 0)} = 4 as clean,
  case when count(r) {over(-11, 0)} = 12 then stddev_pop(r) {over(-11, 0)} end as vol, lead(close, 6) over ({W}) as event, case when n % 4 > 0 then r end as score from (select *, ln(close / lag(close) over ({W})) * 1e4 as r from hard)) b on b.symbol = m.symbol and b.t = m.t""", FLAGGED)
def j14(spark, sf):
    from ..operators.quality import by_time, clean_history

    d = fx.with_log_return(clean_history(flagged(spark, sf), 3, HOUR))
    own = d.select("symbol", "t", F.lit(True).alias("has_bar"), F.col("clean_history").alias("clean"), fx.rolling_vol(12).alias("vol"), F.lead("close", 6).over(by_time()).alias("event"), F.when(F.col("n") % 4 > 0, F.col("r")).alias("score"))
    frozen = hourly(spark, sf).select("symbol", (F.col("t") + F.when(F.col("n") % 9 == 0, 1).otherwise(0)).alias("t"))
    return venues.decision_gate(frozen.join(own, ["symbol", "t"], "left")).select("symbol", "t", "gate")


@query("s14_trades_once", """select symbol, us, tick_id, case when side = 'buy' then 1 else -1 end as sign from (select *, case when tick_id % 5 = 0 then '' else cast(tick_id // 3 as varchar) end as id, row_number() over (partition by symbol, case when tick_id % 5 = 0 then 'row' || tick_id else 'id' || (tick_id // 3) end order by us, tick_id) as k from ticks where qty > 0) where k = 1""", TICKS_SQL)
def s14(spark, sf):
    t = ticks(spark, sf).filter("qty > 0").withColumn("id", F.when(F.col("tick_id") % 5 == 0, "").otherwise(F.floor(F.col("tick_id") / 3).cast("string")))
    return venues.trades_once(t, ["symbol"], ["us", "tick_id"], "id").select("symbol", "us", "tick_id", "sign")


SPACING = 14_400_000_000
ORDERS = f"""{TICKS_SQL}, orders as (select symbol, slot, slot * {SPACING} as decision_us, sign, floor(price / 25) as lim, qty / 10 as queue, sign * (price - 100) as drift from (select *, us // {SPACING} + 1 as slot, case when (us // {SPACING} + 1) % 2 = 0 then 1 else -1 end as sign,
  row_number() over (partition by symbol, us // {SPACING} order by us desc, tick_id desc) as k from ticks) where k = 1),
attached as (select o.*, t.us, t.tick_id, t.qty, case when t.qty > 70 then 'cancel' else 'trade' end as kind from orders o join ticks t on t.symbol = o.symbol and t.us // {SPACING} = o.slot and floor(t.price / 25) = o.lim and t.us > o.decision_us and t.side = case when o.sign = 1 then 'sell' else 'buy' end),
fills as (select symbol, slot, least(sum(fill), 30.0) as filled, min(ff) as first_fill_us from (select *, min(case when fill > 0 then us end) over (partition by symbol, slot) as ff from (
  select *, case when kind = 'trade' then greatest(qty - greatest(queue - coalesce(sum(case when kind = 'trade' then qty else 0.5 * qty end) over (partition by symbol, slot order by us, case when kind = 'trade' then 0 else 1 end, tick_id rows between unbounded preceding and 1 preceding), 0.0), 0.0), 0.0) else 0.0 end as fill
  from attached where us > decision_us + 600000000 and us < decision_us + 10800000000 + 600000000)) where us < ff + 600000000 group by 1, 2),
replayed as (select o.*, coalesce(filled, 0.0) as filled, first_fill_us, case when coalesce(filled, 0.0) >= 30 then 'filled' when coalesce(filled, 0.0) > 0 then 'partial' else 'miss' end as status, lead(sign * drift) over (partition by symbol order by slot) + 100 as exit from orders o left join fills using (symbol, slot))"""


def orders(spark, sf):
    t = ticks(spark, sf)
    level = F.floor(F.col("price") / 25).cast("double")
    made = queue.candidates(t, SPACING, level, F.col("qty") / 10, {"drift": F.col("price") - 100})
    events = t.select("symbol", "us", "tick_id", "side", "qty", level.alias("level"), F.when(F.col("qty") > 70, "cancel").otherwise("trade").alias("kind"))
    return made, queue.attach(made, events, SPACING)


def replayed(spark, sf):
    made, events = orders(spark, sf)
    d = queue.replay(made, events, size=30.0, latency_us=600_000_000, timeout_us=10_800_000_000, credit=0.5)
    return d.withColumn("exit", F.lead(F.col("sign") * F.col("drift")).over(Window.partitionBy("symbol").orderBy("slot")) + 100)


@query("f16_passive_candidates", 'select symbol, slot, decision_us, sign, lim as "limit", queue, drift from orders ## "limit", queue, drift', ORDERS)
def f16(spark, sf):
    return orders(spark, sf)[0]


@query("j15_trades_of_orders", "select symbol, slot, us, tick_id, kind, qty from attached ## qty", ORDERS)
def j15(spark, sf):
    return orders(spark, sf)[1].select("symbol", "slot", "us", "tick_id", "kind", "qty")


@query("r11_queue_replay", "select symbol, slot, filled, first_fill_us, status from replayed ## filled", ORDERS)
def r11(spark, sf):
    return replayed(spark, sf).select("symbol", "slot", "filled", "first_fill_us", "status")


POLICIES = f"""{ORDERS}, taken as (select *, gross - 6 as net, gross - 10 as stress from (
  select symbol, decision_us, sign, status, queue, policy, side, status <> 'miss' as hit, case when status <> 'miss' then first_fill_us - decision_us end as wait_us, decision_us // 86400000000 as day, first_fill_us // 3600000000 as hour,
  case when status <> 'miss' then sign * (exit / (sign * drift + 100) - 1) * 1e4 end as gross, case when status <> 'miss' then case when sign * (exit - 100) < drift then 1.0 else 0.0 end end as adverse
  from replayed join (values ('all'), ('rising')) p(policy) on policy = 'all' or drift > 100 join (values (0), (1), (-1)) s(side) on side = 0 or side = sign where exit is not null)),
by_day as (select policy, side, count(*) as days, avg(case when x > 0 then 1.0 else 0.0 end) as positive_days, coalesce(max(greatest(x, 0)) / nullif(sum(greatest(x, 0)), 0), 1.0) as day_concentration
  from (select policy, side, day, coalesce(sum(net), 0.0) as x from taken group by 1, 2, 3) group by 1, 2),
by_hour as (select policy, side, count(*) as hours, avg(case when x > 0 then 1.0 else 0.0 end) as positive_hours, coalesce(max(greatest(x, 0)) / nullif(sum(greatest(x, 0)), 0), 1.0) as hour_concentration
  from (select policy, side, hour, coalesce(sum(net), 0.0) as x from taken where hit group by 1, 2, 3) group by 1, 2),
curve as (select policy, side, max(greatest(peak, 0) - eq) as drawdown from (select *, max(eq) over (partition by policy, side order by decision_us, symbol rows unbounded preceding) as peak from (
  select policy, side, symbol, decision_us, sum(net) over (partition by policy, side order by decision_us, symbol rows unbounded preceding) as eq from taken where hit)) group by 1, 2),
sums as (select policy, side, count(*) as n, count(*) filter (where hit) as filled_orders, count(*) filter (where status = 'filled') as full_fills, count(*) filter (where status = 'partial') as partial_fills,
  avg(case when hit then 1.0 else 0.0 end) as fill_rate, avg(case when status = 'partial' then 1.0 else 0.0 end) as partial_rate, avg(case when hit then 0.0 else 1.0 end) as timeout_rate, avg(case when status = 'filled' then 0.0 else 1.0 end) as cancel_rate,
  avg(wait_us) as mean_wait_us, max(wait_us) as longest_wait_us, avg(queue) as mean_queue, avg(gross) as mean_gross, avg(net) as mean_net, avg(stress) as mean_stress,
  coalesce(sum(gross), 0.0) as total_gross, coalesce(sum(net), 0.0) as total_net, coalesce(sum(stress), 0.0) as total_stress, coalesce(sum(gross - net), 0.0) as total_fees,
  coalesce(sum(net) filter (where net > 0), 0.0) as gain, coalesce(-sum(net) filter (where net < 0), 0.0) as loss, min(net) as worst_net, avg(adverse) as adverse_rate,
  quantile_cont(wait_us::double, 0.5) as wait_p50, quantile_cont(wait_us::double, 0.9) as wait_p90, quantile_cont(wait_us::double, 0.99) as wait_p99,
  quantile_cont(queue, 0.5) as queue_p50, quantile_cont(queue, 0.9) as queue_p90, quantile_cont(queue, 0.99) as queue_p99, quantile_cont(net, 0.01) as net_p01, quantile_cont(net, 0.05) as net_p05 from taken group by 1, 2),
judged as (select s.* exclude (side, gain, loss), nullif(side, 0) as sign, days, positive_days, day_concentration, coalesce(hours, 0) as hours, coalesce(positive_hours, 0.0) as positive_hours, coalesce(hour_concentration, 1.0) as hour_concentration,
  coalesce(drawdown, 0.0) as drawdown, case when loss > 0 then gain / loss when gain > 0 then 'inf'::double else 0.0 end as profit_factor,
  case when drawdown > 0 then total_net / drawdown when total_net > 0 then 'inf'::double else 0.0 end as total_over_drawdown, filled_orders / days as fills_a_day
  from sums s join by_day using (policy, side) left join by_hour using (policy, side) left join curve using (policy, side))"""


def policies(spark, sf):
    d = replayed(spark, sf).filter("exit is not null").withColumns({
        "adverse": F.col("sign") * (F.col("exit") - 100) < F.col("drift"),
        "gross": F.when(F.col("status") != "miss", F.col("sign") * (F.col("exit") / (F.col("sign") * F.col("drift") + 100) - 1) * 1e4),
    })
    return queue.policy_metrics(d, {"all": F.lit(True), "rising": F.col("drift") > 100}, cost=6.0, stress=10.0)


@query("ag17_policy_metrics", """select * from judged ## fill_rate, partial_rate, timeout_rate, cancel_rate, mean_wait_us, mean_queue, mean_gross, mean_net, mean_stress, total_gross, total_net, total_stress, total_fees, worst_net, adverse_rate,
  positive_days, day_concentration, positive_hours, hour_concentration, drawdown, profit_factor, total_over_drawdown, fills_a_day, wait_p50, wait_p90, wait_p99, queue_p50, queue_p90, queue_p99, net_p01, net_p05""", POLICIES)
def ag17(spark, sf):
    return policies(spark, sf)


@query("ag17_policy_deltas", """select a.policy, a.sign, a.mean_net - b.mean_net as mean_net_delta, a.total_net - b.total_net as total_net_delta, a.filled_orders - b.filled_orders as filled_orders_delta, a.fill_rate - b.fill_rate as fill_rate_delta,
  a.adverse_rate - b.adverse_rate as adverse_rate_delta, b.total_fees - a.total_fees as fees_saved from judged a join judged b on b.policy = 'all' and a.policy <> 'all' and a.sign is not distinct from b.sign
  ## mean_net_delta, total_net_delta, fill_rate_delta, adverse_rate_delta, fees_saved""", POLICIES)
def ag17_deltas(spark, sf):
    return queue.policy_deltas(policies(spark, sf), "all")


MARKS = {"1h": 3_600_000_000, "3h": 10_800_000_000, "10h": 36_000_000_000}
MARKED = f"""{ORDERS}, marks as (select r.symbol, r.slot, h.name, r.sign * (t.price / (lim * 25 + 12.5::double) - 1) * 1e4 as m from (select * from replayed where first_fill_us is not null) r cross join (values {', '.join(f"('{k}', {v})" for k, v in MARKS.items())}) h(name, us)
  asof left join ticks_by_time t on t.symbol = r.symbol and t.us <= r.first_fill_us + h.us),
marked as (select r.*, policy, {', '.join(f'"m{k}"' for k in MARKS)} from replayed r join (values ('all'), ('rising')) p(policy) on policy = 'all' or drift > 100 left join (select symbol, slot, {', '.join(f"max(m) filter (where name = '{k}') as m{k}" for k in MARKS)} from marks group by 1, 2) m on m.symbol = r.symbol and m.slot = r.slot)"""


@query("ag17_markouts", f"""select policy, sign, count(*) as orders, count(*) filter (where queue <= 0) as first_in_queue, quantile_cont(case when queue > 0 then 30.0::double / queue end, 0.5) as depth_ratio_p50, quantile_cont(case when queue > 0 then 30.0::double / queue end, 0.9) as depth_ratio_p90,
  {', '.join(f"avg(m{k}) as markout_{k}, avg(case when m{k} < 0 then 1.0 when m{k} is not null then 0.0 end) as adverse_{k}" for k in MARKS)} from marked group by grouping sets ((policy), (policy, sign)) ## depth_ratio_p50, depth_ratio_p90, {', '.join(f'markout_{k}, adverse_{k}' for k in MARKS)}""",
  MARKED.replace("ticks_by_time", "(select symbol, us, last(price order by tick_id) as price from ticks group by 1, 2)"))
def ag17_markouts(spark, sf):
    """Orders of 30 by policy and side: place in the queue, size over depth, and markouts one, three and ten hours after the first fill."""
    d = replayed(spark, sf).withColumns({"fill_price": F.col("limit") * 25 + 12.5, "size": F.lit(30.0)})
    one = ticks(spark, sf).groupBy("symbol", "us").agg(F.max_by("price", "tick_id").alias("price"))
    return queue.policy_markouts(d, {"all": F.lit(True), "rising": F.col("drift") > 100}, queue.markouts(d, one, MARKS), list(MARKS))


SEQUENCE = f"""{TICKS_SQL}, feed as (select symbol, pos, u as last, case when tick_id % 37 = 0 then u - 5 else u - 9 end as first, case when tick_id % 37 = 0 then u - 7 else u - 10 end as previous, case when tick_id % 29 = 0 then u + case when tick_id % 2 = 0 then 5 else 25 end end as snapshot_id
  from (select *, pos * 10 as u from (select symbol, tick_id, row_number() over ({BY_TICK}) as pos from ticks))),
parts as (select *, count(snapshot_id) over (partition by symbol order by pos rows unbounded preceding) as segment from feed),
owned as (select *, max(snapshot_id) over (partition by symbol, segment) as sid from parts),
live as (select *, case when first_value(pos) over (partition by symbol, segment order by pos) = pos then first <= sid else coalesce(previous = lag(last) over (partition by symbol, segment order by pos), false) end as ok, row_number() over (partition by symbol, segment order by pos) as k from owned where snapshot_id is null and segment > 0 and last >= sid),
broken as (select symbol, segment, min(pos) as gap from live where not ok group by 1, 2)"""


def depth_feed(spark, sf):
    t = ticks(spark, sf).withColumn("pos", F.row_number().over(Window.partitionBy("symbol").orderBy("us", "tick_id")).cast("long"))
    u, cut = F.col("pos") * 10, F.col("tick_id") % 37 == 0
    return t.select(
        "symbol", "us", "pos", u.alias("last"), F.when(cut, u - 5).otherwise(u - 9).alias("first"), F.when(cut, u - 7).otherwise(u - 10).alias("previous"),
        F.when(F.col("tick_id") % 29 == 0, u + F.when(F.col("tick_id") % 2 == 0, 5).otherwise(25)).alias("snapshot_id"),
    )


@query("r4_sequence", """select f.symbol, f.pos, f.segment, case when f.snapshot_id is not null then 'snapshot' when f.segment = 0 then 'invalid' when f.pos = gap then 'gap' when f.pos > gap then 'invalid' when l.k = 1 then 'bridge' when l.k > 1 then 'valid' else 'stale' end as state
  from owned f left join live l on l.symbol = f.symbol and l.pos = f.pos left join broken b on b.symbol = f.symbol and b.segment = f.segment""", SEQUENCE)
def r4(spark, sf):
    return audits.sequence_state(depth_feed(spark, sf)).select("symbol", "pos", "segment", "state")


@query("r9_valid_flow", f"""select symbol, t, case when count(*) {over(-1, 0)} = 2 and min(v) {over(-1, 0)} = 1 then case when sum(b + s) {over(-1, 0)} > 0 then sum(b - s) {over(-1, 0)} / sum(b + s) {over(-1, 0)} else 0.0 end end as short_imbalance,
  case when count(*) {over(-3, 0)} = 4 and min(v) {over(-3, 0)} = 1 then case when sum(b + s) {over(-3, 0)} > 0 then sum(b - s) {over(-3, 0)} / sum(b + s) {over(-3, 0)} else 0.0 end end as long_imbalance from (
  select g.symbol, g.t, coalesce(b, 0.0) as b, coalesce(s, 0.0) as s, case when b is null then 0 else 1 end as v from (select symbol, unnest(generate_series(min(us // 3600000000 * 3600), max(us // 3600000000 * 3600), 3600)) as t from ticks group by symbol) g left join
  (select symbol, us // 3600000000 * 3600 as t, sum(case when not buyer_maker then qty else 0.0 end) as b, sum(case when buyer_maker then qty else 0.0 end) as s from ticks group by 1, 2) x on x.symbol = g.symbol and x.t = g.t) ## short_imbalance, long_imbalance""", TICKS_SQL)
def r9(spark, sf):
    g = grids.filled_grid(grids.trade_buckets(ticks(spark, sf), HOUR), HOUR)
    return grids.valid_flow(g.withColumn("valid", F.col("buys") + F.col("sells") > 0), 2, 4)


SPACED = SIGNALS + f""", spaced as (with recursive n as (select symbol, t, net, row_number() over ({W}) as k from trades where net > -9999), c as (
  select symbol, t, net, k, true as keep, t + 10800 as last from n where k = 1 union all
  select n.symbol, n.t, n.net, n.k, n.t >= c.last, case when n.t >= c.last then n.t + 10800 else c.last end from c join n on n.symbol = c.symbol and n.k = c.k + 1) select * from c where keep)"""


@query("ag2_portfolio_metrics", """select symbol, count(*) as trades, avg(case when net > 0 then 1.0 else 0.0 end) as win_rate, avg(net) as expectancy, sum(net) as sum_net from spaced group by symbol ## win_rate, expectancy, sum_net""", SPACED)
def ag2(spark, sf):
    d = trades(spark, sf).filter("net > -9999").withColumn("t_end", F.col("t") + 3 * HOUR)
    kept = labels.non_overlapping(d.select("symbol", "t", "t_end"), "symbol", "t", "t_end", block=WEEK).select("symbol", "t")
    return metrics.trade_metrics(d.join(kept, ["symbol", "t"]), ["symbol"]).select("symbol", "trades", "win_rate", "expectancy", "sum_net")


@query("ag7_pool_folds", """select symbol, sum(net) as total, cast(sum(n) as bigint) as trades, count(*) filter (where n is null) as missing_folds, count(*) filter (where net > 0) as positive_folds, coalesce(max(case when net > 0 then net end) / sum(case when net > 0 then net end), 1.0) as largest_share from (
  select s.symbol, f.fold, x.net, x.n from (select distinct symbol from trades) s cross join (select unnest(generate_series(0, 5)) as fold) f left join (select symbol, day % 5 as fold, sum(net) as net, count(*) as n from trades group by 1, 2) x on x.symbol = s.symbol and x.fold = f.fold) group by symbol ## total, largest_share""", SIGNALS)
def ag7(spark, sf):
    return selection.pool_folds(trades(spark, sf).withColumn("fold", F.col("day") % 5), ["symbol"], spark.range(6).toDF("fold"))


@query("ag10_pooled_increment", """select count(*) as targets, 1 - sum(b) / sum(v) as base_r2, 1 - sum(c) / sum(v) as cross_r2, sum(b) / sum(v) - sum(c) / sum(v) as increment from (select symbol, sum((y - pred) ** 2) as b, sum((y - 0.8::double * pred) ** 2) as c, var_pop(y) * count(*) as v from preds group by symbol)
  ## base_r2, cross_r2, increment""", PRED)
def ag10(spark, sf):
    return selection.pooled_increment(preds(spark, sf).select("symbol", "y", F.col("pred").alias("base"), (0.8 * F.col("pred")).alias("cross")), "symbol")


SCORED = SIGNALS + """, scored as (select symbol, k as threshold, count(*) as trades, avg(net) as expectancy, avg(case when net > 0 then 1.0 else 0.0 end) as accuracy from trades join (values (0.5), (0.7), (0.9), (0.94)) g(k) on confidence >= k group by 1, 2)"""


def scored(spark, sf):
    g = spark.createDataFrame([(0.5,), (0.7,), (0.9,), (0.94,)], "threshold double")
    d = trades(spark, sf).join(F.broadcast(g), F.col("confidence") >= F.col("threshold"))
    return d.groupBy("symbol", "threshold").agg(F.count("*").alias("trades"), F.avg("net").alias("expectancy"), F.avg((F.col("net") > 0).cast("double")).alias("accuracy"))


@query("k3_first_of_near_best", """select symbol, bt as threshold, bs as expectancy, bn as trades from (with recursive n as (select *, row_number() over (partition by symbol order by threshold) as k from scored), c as (
  select symbol, k, threshold as bt, expectancy as bs, trades as bn from n where k = 1 union all select symbol, k, case when w then threshold else bt end, case when w then expectancy else bs end, case when w then trades else bn end from (
  select n.*, bt, bs, bn, case when abs(n.expectancy - bs) / greatest(abs(n.expectancy), abs(bs), 1e-12) > 0.01 then n.expectancy > bs else n.trades > bn end as w from c join n on n.symbol = c.symbol and n.k = c.k + 1))
  select * from c where (symbol, k) in (select symbol, max(k) from n group by 1)) ## threshold, expectancy""", SCORED)
def k3(spark, sf):
    return selection.first_of_near_best(scored(spark, sf), ["symbol"], ["threshold"], "expectancy", "trades")


@query("k5_version_ranking", "select threshold, symbol, trades, expectancy, accuracy, cast(row_number() over (partition by threshold order by accuracy desc, expectancy desc, symbol) as integer) as place from scored ## threshold, expectancy, accuracy", SCORED)
def k5(spark, sf):
    return metrics.leaderboard(scored(spark, sf), "threshold", [F.desc("accuracy"), F.desc("expectancy"), F.col("symbol")], 1000).select("threshold", "symbol", "trades", "expectancy", "accuracy", "place")


@query("k6_best_threshold", "select symbol, threshold, trades, expectancy, accuracy from (select *, row_number() over (partition by symbol order by trades < 20, expectancy desc, accuracy desc, threshold) as k from scored) where k = 1 ## threshold, expectancy, accuracy", SCORED)
def k6(spark, sf):
    return metrics.best_with_minimum(scored(spark, sf), "symbol", 20, [F.desc("expectancy"), F.desc("accuracy"), F.col("threshold")]).select("symbol", "threshold", "trades", "expectancy", "accuracy")


@query("m4_expanding_folds", """select symbol, fold, first, last, n, (select count(*) from bars p where p.symbol = f.symbol and p.t < f.first and p.t + 21600 < f.first) as train from (select symbol, cast(fold as integer) as fold, min(t) as first, max(t) as last, count(*) as n from (
  select symbol, t, case when p >= round_even(n * 1 / 5, 0) then 1 else 0 end + case when p >= round_even(n * 2 / 5, 0) then 1 else 0 end + case when p >= round_even(n * 3 / 5, 0) then 1 else 0 end + case when p >= round_even(n * 4 / 5, 0) then 1 else 0 end as fold from (
  select symbol, t, row_number() over (partition by symbol order by t) - 1 as p, count(*) over (partition by symbol) as n from bars)) group by 1, 2) f""")
def m4(spark, sf):
    d = hourly(spark, sf).select("symbol", "t", (F.col("t") + 6 * HOUR).alias("t_end"))
    return selection.expanding_folds(d, "symbol", "t", "t_end", 5, WEEK)


@query("m9_halves", """select symbol, t, case when p >= n // 2 then 'selection' when t + 21600 < start then 'calibration' end as part from (select *, min(case when p >= n // 2 then t end) over (partition by symbol) as start from (
  select symbol, t, row_number() over (partition by symbol order by t) - 1 as p, count(*) over (partition by symbol) as n from bars))""")
def m9(spark, sf):
    d = hourly(spark, sf).select("symbol", "t", (F.col("t") + 6 * HOUR).alias("t_end"))
    return selection.halves(d, ["symbol"], "t", "t_end", WEEK).select("symbol", "t", "part")


@query("m10_probabilistic_actions", """select symbol, t, case when l and s then case when ul > us then 1 when us > ul then -1 else 0 end when l then 1 when s then -1 else 0 end as action from (select *, p >= 0.55 and ul > 0 as l, q >= 0.55 and us > 0 as s from (
  select symbol, t, p, 1.3::double - p as q, (p - 0.6::double) * 10 as ul, (0.8::double - p) * 12 as us from twoclass))""", SIGNALS + ", twoclass as (select symbol, t, confidence as p from outcomes where outcome is not null and direction <> 'NO_TRADE')")
def m10(spark, sf):
    p = F.col("p")
    return binary(spark, sf).select("symbol", "t", selection.probabilistic_action(p, 1.3 - p, (p - 0.6) * 10, (0.8 - p) * 12, 0.55).alias("action"))


@query("m2_expected_value_policy", """select symbol, t, case when l and s then case when ul > us then 'LONG' else 'SHORT' end when l then 'LONG' when s then 'SHORT' else 'NO_TRADE' end as action from (select *, p >= 0.55 and ul > 0 as l, q >= 0.55 and us > 0 as s from (
  select symbol, t, p, 1.3::double - p as q, (p - 0.6::double) * 10 as ul, (0.8::double - p) * 12 as us from twoclass))""", SIGNALS + ", twoclass as (select symbol, t, confidence as p from outcomes where outcome is not null and direction <> 'NO_TRADE')")
def m2(spark, sf):
    p = F.col("p")
    return binary(spark, sf).select("symbol", "t", selection.expected_value_side(p, 1.3 - p, (p - 0.6) * 10, (0.8 - p) * 12).alias("action"))


@query("m13_controls", f"""select a.symbol, a.t, a.r, b.r as permuted, -a.r as flipped, lag(a.r, 2) over (partition by a.symbol order by a.t) as lagged, lead(a.r, 1) over (partition by a.symbol order by a.t) as leaked from (select *, row_number() over ({W}) as k from lagged) a
  join (select *, row_number() over (partition by symbol order by md5('7:' || t)) as k from lagged) b on a.symbol = b.symbol and a.k = b.k ## r, permuted, flipped, lagged, leaked""", LAGGED)
def m13(spark, sf):
    d = fx.with_log_return(hourly(spark, sf)).select("symbol", "t", "r")
    return verdicts.controls(d, ["symbol"], "t", "r", 2, 1, 7, WEEK)


@query("m15_promotion", """select symbol, gate, passed, case when n < 30 then 'UNAVAILABLE' when min(cast(passed as integer)) over (partition by symbol) = 1 then 'PROMOTE' when avg(cast(passed as integer)) over (partition by symbol) > 0.5 then 'INCONCLUSIVE' else 'REJECT' end as verdict from (
  select symbol, n, gate, case gate when 'expectancy' then m > 0 when 'accuracy' then a > 0.5 else b > 0 end as passed from (select symbol, count(*) as n, avg(net) as m, avg(case when net > 0 then 1.0 else 0.0 end) as a, max(net) as b from trades group by 1) cross join (values ('expectancy'), ('accuracy'), ('best')) g(gate))""", SIGNALS)
def m15(spark, sf):
    s = trades(spark, sf).groupBy("symbol").agg(F.count("*").alias("n"), F.avg("net").alias("m"), F.avg((F.col("net") > 0).cast("double")).alias("a"), F.max("net").alias("b"))
    return selection.promotion(s, ["symbol"], {"expectancy": F.col("m") > 0, "accuracy": F.col("a") > 0.5, "best": F.col("b") > 0}, 30)


@query("u3_union_of_sources", "select symbol, venue, n from (select symbol, 'a' as venue, count(*) as n from ticks where venue = 0 group by 1 union all select symbol, 'b', count(*) from ticks where venue = 1 group by 1 union all select symbol, 'c', count(*) from ticks where venue = 2 group by 1)", TICKS_SQL)
def u3(spark, sf):
    t = ticks(spark, sf)
    one = lambda k, name: t.filter(F.col("venue") == k).withColumn("venue", F.lit(name))
    return one(0, "a").unionByName(one(1, "b")).unionByName(one(2, "c")).groupBy("symbol", "venue").agg(F.count("*").alias("n"))


@query("u4_first_and_last_wins", "select symbol, day, arg_min(price, us) as first_price, arg_max(price, us) as last_price from (select *, us // 86400000000 as day from ticks) group by 1, 2 ## first_price, last_price", TICKS_SQL)
def u4(spark, sf):
    at = F.struct("us", "tick_id")
    return ticks(spark, sf).groupBy("symbol", F.floor(F.col("us") / DAY_US).cast("long").alias("day")).agg(F.min_by("price", at).alias("first_price"), F.max_by("price", at).alias("last_price"))


@query("m5_ridge", """select a as alpha, 'pred' as feature, n * c / s / (n + a) as weight, m as intercept from (select count(*)::double as n, covar_pop(pred, y) as c, stddev_pop(pred) as s, avg(y) as m from preds) cross join (values (0.1::double), (1.0), (10.0), (100.0)) g(a)
  ## alpha, weight, intercept""", PRED)
def m5(spark, sf):
    return selection.ridge(preds(spark, sf), ["pred"], "y", [0.1, 1.0, 10.0, 100.0])
