"""Registered queries: fail-closed scans, 250 ms books, wider features, model protocols and gates. Each but the fitted models has SQL for another engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as fx
from ..operators import books, grids, labels, metrics, replay, trees, verdicts, walk
from ..operators import quality as qa
from ..sources import scans, tables
from ..sources.adapters import HOUR, LEDGER_SQL, TICKS_SQL, hourly, ledger, table, ticks
from ..sources.shared import new_folder, written
from .market import ALL, BARS, BINARY, DAY_US, FLAGGED, LAGGED, NUMBERED, SIGNALS, W, WEEK, binary, flagged, lagged, over, outcomes, query, trades

CUT = 1705795200  # 2024-01-21
FEATURES = ["r", "r3", "v6"]


def stored(df, name: str, kind: str, **options) -> str:
    """df written into the shared folder in a source's format, as an external feed would leave it."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).format(kind).save(path)
    return path


@query("s1_bar_scan", "select symbol, t, open, high, low, close from bars ## open, high, low, close")
def s1_scan(spark, sf):
    b = hourly(spark, sf).select("symbol", scans.iso_text(F.col("t")).alias("timestamp"), "open", "high", "low", "close", "n")
    return scans.scan_bars(spark, stored(b, "bars", "csv", header=True))


SERIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE")


@query("s6_ledger_scan", f"select name as series, count(l.series) as n from (values {', '.join(f"('{s}')" for s in SERIES)}) v(name) left join ledger l on l.series = v.name group by name", LEDGER_SQL)
def s6_scan(spark, sf):
    d = ledger(spark, sf).select("series", scans.iso_text(F.col("known") * 86400).alias("known_at"), F.date_from_unix_date(F.col("observed").cast("int")).alias("observation_date"), "value")
    return scans.scan_ledger(spark, stored(d, "ledger", "csv", header=True), list(SERIES))[1]


@query("s9_release_calendar", """select family, known_at // 86400 as known, known_at from (select family, cast(epoch(timezone('America/New_York', day + to_minutes(minutes))) as bigint) as known_at
  from (select distinct cast(cast(o_orderdate as date) as timestamp) as day from orders) cross join (values ('jobs', 510), ('growth', 600)) f(family, minutes)) where year(make_timestamp(known_at * 1000000)) between 1996 and 2000""")
def s9(spark, sf):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    clock = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(c).alias("clock")) for f, c in (("jobs", 30600), ("growth", 36000))])).alias("c")
    days = table(spark, sf, "orders").select(day.alias("day")).distinct().select("day", clock).select("c.family", "day", "c.clock")
    return scans.release_calendar(days, "America/New_York", 1996, 2000)


@query("s10_manifest", """select symbol, t, k - 1 as place from (select *, count(*) over (partition by symbol) as m from numbered) where k - 1 >= 24 and m - k >= 3 and t in (select t from numbered where k % 10 = 0)""", NUMBERED)
def s10(spark, sf):
    b = hourly(spark, sf)
    chosen = walk.placed(b).filter("(k + 1) % 10 = 0").select("symbol", F.floor(F.col("t") / 86400).alias("day"), F.struct(scans.iso_text(F.col("t")).alias("decision_timestamp")).alias("row"))
    one = chosen.groupBy("symbol", "day").agg(F.collect_list("row").alias("rows")).select(F.to_json(F.struct("rows")).alias("value"))  # a day's rows a document
    manifest = scans.scan_manifest(spark, stored(one, "manifest", "text"))
    return scans.manifest_bars(manifest, b, 24, 3).select("symbol", "t", F.col("place").cast("long"))


@query("s15_grid_scan", f"""select symbol, t, buys, sum(coalesce(buys, 0)) {over(-2, 0)}::bigint as buys3 from (select g.symbol, g.t, coalesce(buys, 0) as buys from (select symbol, unnest(generate_series(min(us // 3600000000 * 3600), max(us // 3600000000 * 3600), 3600)) as t from ticks group by symbol) g
  left join (select symbol, us // 3600000000 * 3600 as t, count(*) filter (where not buyer_maker) as buys from ticks group by 1, 2) b on b.symbol = g.symbol and b.t = g.t)""", TICKS_SQL)
def s15(spark, sf):
    grid = grids.filled_grid(grids.trade_buckets(ticks(spark, sf), HOUR), HOUR)
    d = scans.scan_grid(spark, stored(grid, "grid", "parquet"), ["buys"], by="symbol", time="t", step=HOUR)
    return d.withColumns({"buys": F.col("buys").cast("long"), "buys3": F.sum("buys").over(qa.rows(-2, 0)).cast("long")})


@query("s19_unsealed_days", "select us // 86400000000 as day, count(*) as n from ticks where us // 86400000000 <> 19752 group by 1", TICKS_SQL)
def s19(spark, sf):
    t = ticks(spark, sf).withColumn("day", F.floor(F.col("us") / 86_400_000_000))
    return scans.unsealed(t, "day", [19752], t.select("day").distinct().filter("day <> 19752")).groupBy("day").agg(F.count("*").alias("n"))


@query("f17_finite", "select symbol, us, tick_id, case when qty % 10 not in (0, 1, 2) then qty end as finite from ticks ## finite", TICKS_SQL)
def f17(spark, sf):
    k = F.col("qty") % 10
    broken = F.when(k == 0, F.lit(float("inf"))).when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(float("-inf"))).otherwise(F.col("qty"))
    return ticks(spark, sf).select("symbol", "us", "tick_id", fx.finite(broken).alias("finite"))


def ema_sql(source: str, value: str, span: int) -> str:
    """An exponential average by recursion over k: (symbol, k, e)."""
    a = f"2.0::double / {span + 1}"
    return f"select symbol, k, {value} as e from {source} where k = 1 union all select n.symbol, n.k, {a} * n.{value} + (1 - {a}) * e.e from"


@query("w3_macd", f"""select symbol, t, f as ema_fast, s as ema_slow, (f - s) / close * 1e4 as macd, g / close * 1e4 as signal, (f - s - g) / close * 1e4 as histogram from (
  with recursive ef as ({ema_sql('numbered', 'close', 12)} ef e join numbered n on n.symbol = e.symbol and n.k = e.k + 1),
  es as ({ema_sql('numbered', 'close', 26)} es e join numbered n on n.symbol = e.symbol and n.k = e.k + 1),
  m as (select n.symbol, n.t, n.k, n.close, ef.e as f, es.e as s, ef.e - es.e as m from numbered n join ef on ef.symbol = n.symbol and ef.k = n.k join es on es.symbol = n.symbol and es.k = n.k),
  eg as ({ema_sql('m', 'm', 9)} eg e join m n on n.symbol = e.symbol and n.k = e.k + 1)
  select m.*, eg.e as g from m join eg on eg.symbol = m.symbol and eg.k = m.k) ## ema_fast, ema_slow, macd, signal, histogram""", NUMBERED)
def w3_macd(spark, sf):
    return fx.macd(hourly(spark, sf), block=64)


RANKS = """rank as (select a.symbol, a.t, case when count(b.x) = 0 then {empty} else count(*) filter (where b.x <= a.x) / count(b.x)::double end as rank from {source} a left join {source} b on a.symbol = b.symbol and b.k between a.k - {n} and a.k - 1 where a.x is not null group by a.symbol, a.t, a.x)"""


def ranks(name: str, source: str, n: int, empty: str) -> str:
    return RANKS.format(source=source, n=n, empty=empty).replace("rank as", f"{name} as", 1)


@query("w8_histories", f"""select h.symbol, h.t, a.rank as clean, b.rank as previous, c.rank as any_distance from hard h left join rank_clean a on a.symbol = h.symbol and a.t = h.t left join rank_bars b on b.symbol = h.symbol and b.t = h.t
  left join rank_any c on c.symbol = h.symbol and c.t = h.t ## clean, previous, any_distance""",
  f"""{FLAGGED}, clean as (select symbol, t, close as x, row_number() over ({W}) as k from hard where hard_eligible), holes as (select symbol, t, case when n % 3 <> 0 then close end as x, row_number() over ({W}) as k from hard),
  filled as (select symbol, t, x, row_number() over ({W}) as k from holes where x is not null), {ranks('rank_clean', 'clean', 36, '0.5')}, {ranks('rank_bars', 'holes', 24, '0.5')}, {ranks('rank_any', 'filled', 12, 'null')}""")
def w8_histories(spark, sf):
    d = flagged(spark, sf).withColumn("x", F.when(F.col("n") % 3 != 0, F.col("close")))
    clean = d.filter("hard_eligible").select("symbol", "t", fx.percentile_rank("close", 36).alias("clean"))
    anyd = d.filter("x is not null").select("symbol", "t", fx.percentile_rank("x", 12, None).alias("any_distance"))
    return d.select("symbol", "t", fx.percentile_rank("x", 24).alias("previous")).join(clean, ["symbol", "t"], "left").join(anyd, ["symbol", "t"], "left")


def greedy_sql(source: str, test: str) -> str:
    """Rows that are kept in order of k (start, stop) by a test of start against last."""
    return f"""(with recursive c as (select *, true as keep, stop as last from {source} where k = 1 union all
  select n.*, n.start {test} c.last, case when n.start {test} c.last then n.stop else c.last end from c join {source} n on n.symbol = c.symbol and n.k = c.k + 1) select * from c where keep)"""


@query("w12_strict", f"select symbol, t, stop as t_end from {greedy_sql('spans', '>')}", f"{NUMBERED}, spans as (select symbol, t, t as start, t + 10800 as stop, k from numbered)")
def w12_strict(spark, sf):
    d = hourly(spark, sf).select("symbol", "t", (F.col("t") + 3 * HOUR).alias("t_end"))
    return labels.non_overlapping(d, "symbol", "t", "t_end", strict=True, block=WEEK)


@query("w12_grid", f"select symbol, t, start as place from {greedy_sql('spans', '>=')}", f"{NUMBERED}, spans as (select symbol, t, k - 1 as start, k - 1 + 4 as stop, k from numbered)")
def w12_grid(spark, sf):
    """On a grid the next place is horizon + 1 after the chosen one, whatever gaps in time lie between."""
    d = walk.placed(hourly(spark, sf)).select("symbol", "t", F.col("k").cast("long").alias("place"), (F.col("k") + 4).cast("long").alias("next"))
    return labels.non_overlapping(d, "symbol", "place", "next", block=50).drop("next")


@query("w12_carried", f"select symbol, t, stop as t_end, t >= {CUT} as second from {greedy_sql('spans', '>')}", f"{NUMBERED}, spans as (select symbol, t, t as start, t + 3600 * (1 + n % 7) as stop, k from numbered)")
def w12_carried(spark, sf):
    """Two folds, of which the second goes on from the last ends that the first kept; trades last as long as their bar had ticks."""
    d = hourly(spark, sf).select("symbol", "t", (F.col("t") + HOUR * (1 + F.col("n") % 7)).alias("t_end"))
    first = written(labels.non_overlapping(d.filter(F.col("t") < CUT), "symbol", "t", "t_end", strict=True, block=WEEK), "fold")
    second = labels.non_overlapping(d.filter(F.col("t") >= CUT), "symbol", "t", "t_end", strict=True, block=WEEK / 3, carried=labels.last_exits(first, "symbol", "t_end"))
    return first.withColumn("second", F.lit(False)).unionByName(second.withColumn("second", F.lit(True)))


def barrier_sql(side: str) -> str:
    high, low = ("1.3", "0.8") if side == "LONG" else ("1.2", "0.7")
    sign, up, down = (1, "TAKE_PROFIT", "STOP") if side == "LONG" else (-1, "STOP", "TAKE_PROFIT")
    return f"""select symbol, t, reason, case reason when 'TAKE_PROFIT' then 3000.0::double when 'HORIZON' then (xc / close - 1) * 1e4 * {sign} else -2000.0::double end - 2.0 as net from (select f.symbol, f.t, f.close, p.close as xc,
    case when p.high >= f.close * {high} and p.low <= f.close * {low} then 'AMBIGUOUS_BAR_STOP_FIRST' when p.high >= f.close * {high} then '{up}' when p.low <= f.close * {low} then '{down}' else 'HORIZON' end as reason
  from (select a.symbol, a.t, a.k, a.close, count(b.k) as m, min(case when b.high >= a.close * {high} or b.low <= a.close * {low} then b.k - a.k end) as x
    from numbered a join numbered b on a.symbol = b.symbol and b.k between a.k + 1 and a.k + 6 group by a.symbol, a.t, a.k, a.close) f join numbered p on p.symbol = f.symbol and p.k = f.k + coalesce(f.x, 6) where f.m = 6)"""


def both_sides(spark, sf):
    b = hourly(spark, sf)
    of = lambda side: labels.barrier_labels(b, 6, 3000.0, 2000.0, 2.0, side).select("symbol", "t", F.col("reason").alias(f"{side.lower()}_reason"), F.col("net_bps").alias(f"{side.lower()}_net"))
    d = of("LONG").join(of("SHORT"), ["symbol", "t"])
    return d.withColumn("best_side", F.when(F.col("long_net") >= F.col("short_net"), "LONG").otherwise("SHORT"))


@query("w19_both_sides", f"""select l.symbol, l.t, l.reason as long_reason, l.net as long_net, s.reason as short_reason, s.net as short_net, case when l.net >= s.net then 'LONG' else 'SHORT' end as best_side
  from ({barrier_sql('LONG')}) l join ({barrier_sql('SHORT')}) s on s.symbol = l.symbol and s.t = l.t ## long_net, short_net""", NUMBERED)
def w19_both(spark, sf):
    return both_sides(spark, sf)


@query("ag15_label_rejections", f"""select symbol, status, count(*) as n, count(*) / (sum(count(*)) over (partition by symbol))::double as share from (select symbol, case when gapped then 'gap' when v6 is null then 'warm_up' when not hard_eligible then 'quality' else 'labelled' end as status from (
  select *, lead(t, 2) over ({W}) as ahead, coalesce(lead(t, 2) over ({W}) - t <> 7200, true) as gapped, case when count(r) {over(-5, 0)} = 6 then stddev_pop(r) {over(-5, 0)} end as v6 from (select *, ln(close / lag(close) over ({W})) * 1e4 as r from hard)) where ahead is not null) group by symbol, status ## share""", FLAGGED)
def ag15_rejections(spark, sf):
    d = fx.with_log_return(flagged(spark, sf))
    ahead = F.lead("t", 2).over(qa.by_time())
    d = d.select("symbol", ahead.alias("ahead"), (ahead - F.col("t") != 2 * HOUR).alias("gap"), fx.rolling_vol(6).alias("v6"), "hard_eligible").filter("ahead is not null")
    status = F.when(F.col("gap"), "gap").when(F.col("v6").isNull(), "warm_up").when(~F.col("hard_eligible"), "quality").otherwise("labelled")
    from pyspark.sql import Window

    n = d.groupBy("symbol", status.alias("status")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("symbol")))


@query("ag15_side_audit", f"""select symbol, side, count(*) as n, count(*) filter (where reason = 'TAKE_PROFIT') as takes, count(*) filter (where reason = 'STOP') as stops, count(*) filter (where reason = 'HORIZON') as horizons, count(*) filter (where reason like 'AMB%') as ambiguous,
  avg(net) as mean_net, count(*) filter (where net >= other and side = 'LONG' or net > other and side = 'SHORT') as best from (select l.symbol, 'LONG' as side, l.reason, l.net, s.net as other from ({barrier_sql('LONG')}) l join ({barrier_sql('SHORT')}) s on s.symbol = l.symbol and s.t = l.t
  union all select l.symbol, 'SHORT', s.reason, s.net, l.net from ({barrier_sql('LONG')}) l join ({barrier_sql('SHORT')}) s on s.symbol = l.symbol and s.t = l.t) group by symbol, side ## mean_net""", NUMBERED)
def ag15_sides(spark, sf):
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s.lower()}_reason").alias("reason"), F.col(f"{s.lower()}_net").alias("net")) for s in ("LONG", "SHORT")])).alias("s")
    d = both_sides(spark, sf).select("symbol", "best_side", sides).select("symbol", "best_side", "s.*")
    of = lambda r: F.count_if(F.col("reason") == r)
    return d.groupBy("symbol", "side").agg(
        F.count("*").alias("n"), of("TAKE_PROFIT").alias("takes"), of("STOP").alias("stops"), of("HORIZON").alias("horizons"), of("AMBIGUOUS_BAR_STOP_FIRST").alias("ambiguous"),
        F.avg("net").alias("mean_net"), F.count_if(F.col("best_side") == F.col("side")).alias("best"),
    )


REPLAYED = f"""{NUMBERED}, said as (select symbol, t, close, k, least(0.5 + abs(move), 0.99) as confidence, case when move > 0 then 'LONG' else 'SHORT' end as direction, lead(close, 6) over ({W}) as future
  from (select *, close / lag(close, 3) over ({W}) - 1 as move from numbered)),
gated as (select symbol, t, confidence, case when confidence >= 0.6 then direction else 'NO_TRADE' end as direction, case when future > close then 'LONG' else 'SHORT' end as outcome from said where k >= 24 and future is not null and confidence is not null)"""


@query("replay_predictor", f"""select g.symbol, g.t, g.direction, confidence, g.direction = outcome as hit, reason, net from gated g left join (select symbol, t, 'LONG' as direction, reason, net from ({barrier_sql('LONG')}) union all select symbol, t, 'SHORT', reason, net from ({barrier_sql('SHORT')})) b
  on b.symbol = g.symbol and b.t = g.t and b.direction = g.direction ## confidence, net""", REPLAYED)
def replay_predictor(spark, sf):
    """A momentum rule as a predictor, held to the contract and replayed bar by bar."""
    return replay.replay(momentum, hourly(spark, sf), history=24, horizon=6, threshold=0.6, take_bps=3000.0, stop_bps=2000.0, cost_bps=2.0)


def momentum(bars):
    move = F.col("close") / F.lag("close", 3).over(qa.by_time()) - 1
    d = bars.withColumn("_m", move).filter("_m is not null")
    return d.select("symbol", "t", F.col("close").alias("reference_price"), F.when(F.col("_m") > 0, "LONG").otherwise("SHORT").alias("direction"), F.least(0.5 + F.abs("_m"), F.lit(0.99)).alias("confidence"))


@query("s5_ledger", f"select symbol, t, close from bars where t // 86400 between 19723 and 19750 ## close")
def s5_ledger(spark, sf):
    """Hourly bars fetched a week at a time: a run that dies between data and ledger, and one that goes on after it."""
    folder, b = new_folder(spark, "backfill"), hourly(spark, sf)

    def fetch(chunks):
        day = F.floor(F.col("t") / 86400)
        return b.select("symbol", "t", "close").join(F.broadcast(chunks), (day >= F.col("start")) & (day <= F.col("end")))

    def dies(chunks):
        fetch(chunks).withColumn("close", F.lit(-1.0)).select("symbol", "t", "close", "start", "end").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("start", "end").parquet(f"{folder}/data")
        raise ConnectionError

    schema = "symbol string, t long, close double"
    tables.backfill(spark, folder, 19723, 19729, 7, fetch, schema)
    try:
        tables.backfill(spark, folder, 19723, 19750, 7, dies, schema)
    except ConnectionError:
        tables.backfill(spark, folder, 19723, 19750, 7, fetch, schema, at_once=2)
    return tables.stored(spark, folder, schema, ["symbol", "t"])


COSTS = [(4.0,), (8.0,), (12.0,)]


def economics_sql(by: str, costs: str) -> str:
    return f"""select {by}, cost_bps, count(*) as trades, sum(net) as total, sum(greatest(net, 0.0)) / nullif(-sum(least(net, 0.0)), 0) as profit_factor, max(dd) as drawdown, min(net) as worst, count(*) filter (where side = 'LONG') as longs, count(*) filter (where side = 'SHORT') as shorts,
  case when max(dd) > 0 then sum(net) / max(dd) when sum(net) > 0 then 'inf'::double else 0.0 end as total_over_drawdown from (select *, greatest(max(eq) over w, 0.0) - eq as dd from (select *, sum(net) over w as eq from (select trades.* exclude (net), gross - c as net, c as cost_bps from trades cross join (values {costs}) g(c))
  window w as (partition by {by}, cost_bps order by t rows unbounded preceding)) window w as (partition by {by}, cost_bps order by t rows unbounded preceding)) group by {by}, cost_bps"""


@query("ag4_full_economics", economics_sql("symbol", "(4.0::double), (8.0), (12.0)") + " ## cost_bps, total, profit_factor, drawdown, worst, total_over_drawdown", SIGNALS)
def ag4_full(spark, sf):
    return metrics.full_economics(trades(spark, sf), spark.createDataFrame(COSTS, "cost_bps double"), ["symbol"], block=WEEK)


@query("ag14_local_rate", """select q.symbol, q.t, case when n >= 30 then least(greatest(h / n::double, 0.01), 0.99) else q.p end as calibrated from (select * from twoclass where t >= 1705276800) q left join (
  select c.p, count(*) as n, sum(y) as h from (select distinct p from twoclass where t >= 1705276800) c join (select p as vp, y from twoclass where t < 1705276800) v on vp between c.p - 0.05::double and c.p + 0.05::double group by c.p) x on x.p = q.p ## calibrated""", BINARY)
def ag14_rate(spark, sf):
    d = binary(spark, sf).withColumnsRenamed({"p": "confidence", "y": "hit"})
    return metrics.local_calibration(d.filter("t >= 1705276800"), d.filter("t < 1705276800"), least=30, lo=0.01, hi=0.99).select("symbol", "t", "calibrated")


def fast_ticks(spark, sf):
    """Ticks on a fast clock: an hour in ten seconds."""
    return ticks(spark, sf).withColumn("us", F.floor(F.col("us") / 360))


FLOW_SQL = f"""{TICKS_SQL}, fast as (select * replace (us // 360 as us) from ticks), seconds as (select symbol, us // 1000000 as t, last(price order by us, tick_id) as price, sum(case when not buyer_maker then qty else 0.0 end) as bq, sum(case when buyer_maker then qty else 0.0 end) as sq,
  count(*) filter (where not buyer_maker) as bn, count(*) filter (where buyer_maker) as sn, sum(case when not buyer_maker then qty * price else 0.0 end) as bv, sum(case when buyer_maker then qty * price else 0.0 end) as sv from fast group by 1, 2),
every as (select g.symbol, g.t, last(price ignore nulls) over (partition by g.symbol order by g.t) as price, {', '.join(f'coalesce({c}, 0) as {c}' for c in ('bq', 'sq', 'bn', 'sn', 'bv', 'sv'))}
  from (select symbol, unnest(generate_series(min(t), max(t))) as t from seconds group by symbol) g left join seconds s on s.symbol = g.symbol and s.t = g.t)"""


def _flow_columns() -> dict[str, str]:
    w = lambda n: f"over (partition by symbol order by t rows between {n - 1} preceding and current row)"
    out = {f"ret{k}": f"ln(price / lag(price, {k}) over (partition by symbol order by t)) * 1e4" for k in (1, 3)}
    for n in (1, 3, 5, 10):
        for name, a, b in (("qty", "bq", "sq"), ("count", "bn", "sn")):
            out[f"{name}_imbalance{n}"] = f"coalesce((sum({a}) {w(n)} - sum({b}) {w(n)})::double / nullif(sum({a}) {w(n)} + sum({b}) {w(n)}, 0), 0.0)"
    for n in (1, 5):
        out |= {f"log_qty{n}": f"ln(1 + sum(bq + sq) {w(n)})", f"log_count{n}": f"ln(1 + sum(bn + sn) {w(n)})"}
    out["vwap_gap_bps"] = f"coalesce(((sum(bv) {w(5)} / nullif(sum(bq) {w(5)}, 0)) / (sum(sv) {w(5)} / nullif(sum(sq) {w(5)}, 0)) - 1) * 1e4, 0.0)"
    return out


FLOW_DOUBLES = ["price", *_flow_columns()]


def flow_sql() -> str:
    out = [f"{x} as {k}" for k, x in _flow_columns().items()]
    out += ["bn > 0 as has_buys", "sn > 0 as has_sells", "ln(lead(price, 10) over (partition by symbol order by t) / price) * 1e4 as label", "min(t) over (partition by symbol) as first"]
    return f"select * exclude (first, bq, sq, bn, sn, bv, sv) from (select *, {', '.join(out)} from every) where t >= first + 3"


@query("r1_rolling_flow", f"{flow_sql()} ## {', '.join([*FLOW_DOUBLES, 'label'])}", FLOW_SQL)
def r1(spark, sf):
    return grids.flow_features(fast_ticks(spark, sf), 1024)


STEP = 250_000


def updates(spark, sf):
    """Ticks as book updates on a fast clock, an hour a second: ticks of an hour that share tick_id % 4 are a group; about one in 40 ticks is of a snapshot."""
    t = ticks(spark, sf)
    bid = F.col("side") == "buy"
    level = F.when(bid, F.floor(F.col("price") / 25)).otherwise(F.floor(F.col("price") / 25) + 16).cast("double")
    us = F.floor(F.col("us") / 3_600_000_000) * 1_000_000 + F.col("tick_id") % 4 * 200_000
    return t.select("symbol", us.alias("us"), F.col("tick_id").alias("seq"), (F.col("tick_id") % 41 == 0).alias("snapshot"), F.when(bid, "bid").otherwise("ask").alias("side"), level.alias("level"), F.greatest(F.col("qty") - 20, F.lit(0.0)).alias("amount"))


UPDATES_SQL = f"""{TICKS_SQL}, updates as (select symbol, us // 3600000000 * 1000000 + tick_id % 4 * 200000 as us, tick_id as seq, tick_id % 41 = 0 as snapshot, case when side = 'buy' then 'bid' else 'ask' end as side,
  case when side = 'buy' then floor(price / 25) else floor(price / 25) + 16 end as level, greatest(qty - 20, 0.0) as amount from ticks),
groups as (select *, coalesce(lag(us) over (partition by symbol, segment order by us), -1) as prev, cast(ceil(us / 250000.0) as bigint) * 250000 as slot from (select symbol, us, max(case when snap then us end) over (partition by symbol order by us rows unbounded preceding) as segment
  from (select symbol, us, bool_or(snapshot) as snap from updates group by 1, 2)) where segment is not null),
states as (select symbol, us, segment, slot, prev, side, level, amount, row_number() over (partition by symbol, us, side order by case when side = 'bid' then -level else level end) as k from (
  select g.*, u.side, u.level, u.amount, row_number() over (partition by g.symbol, g.us, u.side, u.level order by u.us desc, u.seq desc) as last from groups g join updates u on u.symbol = g.symbol and u.us between g.segment and g.us) where last = 1 and amount > 0),
tops as (select g.symbol, g.segment, g.us, g.slot, g.prev, max(level) filter (where side = 'bid' and k = 1) as bid, max(level) filter (where side = 'ask' and k = 1) as ask, max(amount) filter (where side = 'bid' and k = 1) as bid_qty, max(amount) filter (where side = 'ask' and k = 1) as ask_qty,
  {', '.join(f"coalesce(sum(amount) filter (where side = '{s}' and k <= {n}), 0.0) as {s}_depth{n}" for n in (1, 5, 10) for s in ('bid', 'ask'))} from groups g left join states s on s.symbol = g.symbol and s.us = g.us group by 1, 2, 3, 4, 5),
valid as (select *, min(case when coalesce(bid < ask, false) then 1 else 0 end) over (partition by symbol, segment order by us rows unbounded preceding) = 1 as valid, row_number() over (partition by symbol, slot order by us desc) as late from tops),
slots as (select symbol, unnest(generate_series(cast(ceil(min(us) / 250000.0) as bigint) * 250000, cast(ceil(max(us) / 250000.0) as bigint) * 250000, 250000)) as slot from updates group by symbol),
grid as (select s.symbol, s.slot as due, coalesce(v.valid, false) as valid, v.* exclude (symbol, slot, valid) from slots s asof left join valid v on v.symbol = s.symbol and v.us <= s.slot)"""


BLOCK = 60_000_000


def states(spark, sf, block: int = BLOCK, whole_days: bool = False):
    """States with their latch, and every slot of the grid."""
    state, blocks = books.books(updates(spark, sf), block, whole_days=whole_days)
    return books.latched(state), books.slots_of(blocks, STEP, block)


@query("r5_book_levels", """select g.symbol, g.due as slot, g.valid, s.side, s.k as place, s.level, s.amount from grid g join states s on s.symbol = g.symbol and s.us = g.us where s.k <= 10 ## level, amount""", UPDATES_SQL)
def r5(spark, sf):
    d = books.at_slots(*states(spark, sf))
    one = lambda s: d.select("symbol", "slot", "valid", F.lit(s).alias("side"), F.posexplode(f"{s}s").alias("place", "x"))
    return one("bid").unionByName(one("ask")).select("symbol", "slot", "valid", "side", (F.col("place") + 1).cast("long").alias("place"), "x.level", "x.amount")


def only_valid(names: dict[str, str]) -> str:
    return ", ".join(f"case when valid then {x} end as {k}" for k, x in names.items())


R6 = {"bid": "bid", "ask": "ask", "bid_qty": "bid_qty", "ask_qty": "ask_qty", "mid": "(bid + ask) / 2", "spread_bps": "(ask - bid) / ((bid + ask) / 2) * 1e4", "microprice": "(bid * ask_qty + ask * bid_qty) / (bid_qty + ask_qty)",
      "microprice_bps": "((bid * ask_qty + ask * bid_qty) / (bid_qty + ask_qty) / ((bid + ask) / 2) - 1) * 1e4"}
for _n in (1, 5, 10):
    R6 |= {f"bid_depth{_n}": f"bid_depth{_n}", f"ask_depth{_n}": f"ask_depth{_n}", f"imbalance{_n}": f"(bid_depth{_n} - ask_depth{_n}) / (bid_depth{_n} + ask_depth{_n})"}


@query("r6_book_metrics", f"select symbol, due as slot, valid, {only_valid(R6)} from grid ## {', '.join(R6)}", UPDATES_SQL)
def r6(spark, sf):
    return books.book_metrics(books.at_slots(*states(spark, sf)))


@query("r6_day_grid", f"""select s.symbol, s.day, 345600 as slots, coalesce(n, 0) as valid, mid from (select symbol, unnest(generate_series(min((us - 1) // {DAY_US}), max((us - 1) // {DAY_US}))) as day from updates group by symbol) s left join (
  select symbol, day, cast(sum(n) as bigint) as n, sum(n * (bid + ask) / 2) / sum(n) as mid from (select symbol, bid, ask, day, (least((day + 1) * {DAY_US}, coalesce(until, (day + 1) * {DAY_US})) - greatest(slot, day * {DAY_US} + 250000)) // 250000 + 1 as n from (
    select *, unnest(generate_series((slot - 1) // {DAY_US}, coalesce(until - 1, edge) // {DAY_US})) as day from (select symbol, valid, bid, ask, slot, lead(slot) over (partition by symbol order by slot) - 250000 as until, max(us - 1) over (partition by symbol) as edge from valid where late = 1)) where valid) group by 1, 2) v on v.symbol = s.symbol and v.day = s.day ## mid""", UPDATES_SQL)
def r6_days(spark, sf):
    """All 345,600 slots of each day that a symbol has updates in: how many are valid, and the mean of their mids."""
    d = books.book_metrics(books.at_slots(*states(spark, sf, 15 * BLOCK, whole_days=True))).withColumn("day", F.floor((F.col("slot") - 1) / DAY_US))
    return d.groupBy("symbol", "day").agg(F.count("*").cast("int").alias("slots"), F.count_if("valid").alias("valid"), F.avg("mid").alias("mid"))


R7 = ("ofi1", "ofi5", "ofi10", "bid_replenished", "ask_replenished", "bid_depleted", "ask_depleted")
R7_SQL = f"""{UPDATES_SQL}, ranks as (select unnest(generate_series(1, 10)) as k), sides as (select unnest(['bid', 'ask']) as side),
flows as (select g.symbol, g.segment, g.us, g.slot, r.k, case when s.side = 'bid' then 1 else -1 end * case when o.level is null and n.level is null then 0.0 when o.level is null then n.amount when n.level is null then -o.amount
    when (n.level - o.level) * case when s.side = 'bid' then 1 else -1 end > 0 then n.amount when n.level = o.level then n.amount - o.amount else -o.amount end as f
  from groups g cross join ranks r cross join sides s left join states o on o.symbol = g.symbol and o.us = g.prev and o.side = s.side and o.k = r.k left join states n on n.symbol = g.symbol and n.us = g.us and n.side = s.side and n.k = r.k where g.prev >= 0),
near as (select symbol, us, side, level, sum(d) as d from (select symbol, us, side, level, amount as d from states where k <= 5 and prev >= 0 union all
  select g.symbol, g.us, o.side, o.level, -o.amount from groups g join states o on o.symbol = g.symbol and o.us = g.prev and o.k <= 5 where g.prev >= 0) group by 1, 2, 3, 4),
per as (select f.symbol, f.segment, f.slot, f.us, {', '.join(f'sum(case when k <= {n} then f else 0.0 end) as ofi{n}' for n in (1, 5, 10))} from flows f group by 1, 2, 3, 4),
moved as (select symbol, us, {', '.join(f"sum(case when side = '{s}' then greatest({g}d, 0.0) else 0.0 end) as {s}_{n}" for n, g in (('replenished', ''), ('depleted', '-')) for s in ('bid', 'ask'))} from near group by 1, 2),
sums as (select g.symbol, g.slot, {', '.join(f'coalesce(sum({c}), 0.0) as {c}' for c in R7)} from slots g left join
  (select symbol, slot, max(segment) as segment from groups group by 1, 2) s on s.symbol = g.symbol and s.slot = g.slot left join per p on p.symbol = s.symbol and p.slot = s.slot and p.segment = s.segment left join moved m on m.symbol = p.symbol and m.us = p.us group by 1, 2),
flow as (select s.*, coalesce(n, 0) as snapshots from sums s left join (select symbol, slot, count(*) as n from groups where us = segment group by 1, 2) x on x.symbol = s.symbol and x.slot = s.slot)"""


@query("r7_order_flow", f"select * from flow ## {', '.join(R7)}", R7_SQL)
def r7(spark, sf):
    state, slots = states(spark, sf)
    return books.order_flow(state, slots, STEP)


def deals(spark, sf):
    """Ticks as trades on the clock of the updates."""
    return ticks(spark, sf).withColumn("us", F.floor(F.col("us") / 3_600_000_000) * 1_000_000 + F.col("tick_id") % 4 * 200_000)


DEALS = """deals as (select symbol, us // 3600000000 * 1000000 + tick_id % 4 * 200000 as us, qty, buyer_maker from ticks)"""


def block_sql() -> tuple[str, str]:
    """The three layers on the grid by plain windows over a symbol: the query's text and its doubles."""
    w = lambda n: f"over (partition by symbol order by slot rows between {n - 1} preceding and current row)"
    lag = lambda c, n: f"lag({c}, {n}) over (partition by symbol order by slot)"
    ratio = lambda a, b, n: f"case when sum({a} + {b}) {w(n)} > 0 then (sum({a}) {w(n)} - sum({b}) {w(n)})::double / sum({a} + {b}) {w(n)} else 0.0 end"
    spans = {"slot": 1, "short": 4, "long": 12}
    zeroth = {c: c for c in ("spread_bps", "microprice_bps", "imbalance1", "imbalance5", "imbalance10")} | {f"log_{c}": f"ln(1 + {c})" for c in ("bid_qty", "ask_qty", "bid_depth5", "ask_depth5", "bid_depth10", "ask_depth10")}
    one = {f"ofi{n}_{k}": f"sum(ofi{n}) {w(m)}" for n in (1, 5, 10) for k, m in spans.items()}
    one |= {f"trade_qty_{k}": ratio("bq", "sq", m) for k, m in spans.items()} | {f"trade_count_{k}": ratio("bn", "sn", m) for k, m in spans.items()}
    two = {f"d_{c}_{k}": f"{c} - {lag(c, m)}" for c in ("imbalance1", "imbalance5", "imbalance10", "spread_bps", "microprice_bps") for k, m in (("slot", 1), ("short", 4))}
    two |= {f"{c}_short": f"sum({c}) {w(4)}" for c in R7[3:]} | {"trade_qty_x_imbalance5": f"({ratio('bq', 'sq', 4)}) * imbalance5", "trade_qty_x_microprice": f"({ratio('bq', 'sq', 4)}) * microprice_bps", "ofi5_x_spread": f"sum(ofi5) {w(4)} * spread_bps"}
    one_ok = f"valid and row_number() over (partition by symbol order by slot) > 12 and min(case when valid and snapshots = 0 then 1 else 0 end) {w(12)} = 1"
    two_ok = f"{one_ok} and coalesce({lag('valid', 1)} and {lag('valid', 4)}, false)"
    out = [f"case when {ok} then {x} end as {k}" for ok, layer in (("valid", zeroth), (one_ok, one), (two_ok, two)) for k, x in layer.items()]
    text = f"""select symbol, slot, valid as valid0, {one_ok} as valid1, {two_ok} as valid2, {', '.join(out)} from (select b.*, f.* exclude (symbol, slot), coalesce(bq, 0.0) as bq, coalesce(sq, 0.0) as sq, coalesce(bn, 0) as bn, coalesce(sn, 0) as sn
  from (select symbol, due as slot, valid, {only_valid(R6)} from grid) b join flow f on f.symbol = b.symbol and f.slot = b.slot left join ({DEALS_AT.format(step=250000)}) t on t.symbol = b.symbol and t.slot = b.slot)"""
    return text, ", ".join([*zeroth, *one, *two])


DEALS_AT = """select symbol, cast(ceil(us / {step}.0) as bigint) * {step} as slot, sum(case when not buyer_maker then qty else 0.0 end) as bq, sum(case when buyer_maker then qty else 0.0 end) as sq, count(*) filter (where not buyer_maker) as bn, count(*) filter (where buyer_maker) as sn from deals group by 1, 2"""


@query("r9_flow_block", " ## ".join(block_sql()), f"{R7_SQL}, {DEALS}")
def r9_block(spark, sf):
    """43 columns on every slot of 250 ms."""
    state, slots = states(spark, sf)
    return books.flow_block(books.book_metrics(books.at_slots(state, slots)), books.order_flow(state, slots, STEP), books.slot_trades(deals(spark, sf), STEP), STEP, block=1024)


R2 = ", ".join(k for k in R6 if k not in ("bid_depth1", "ask_depth1"))


SAMPLED_SQL = f"""select symbol, slot, valid, {R2}, last_id, coalesce(bq, 0.0) as buy_qty, coalesce(sq, 0.0) as sell_qty, coalesce(bn, 0) as buys, coalesce(sn, 0) as sells, case when bq + sq > 0 then (bq - sq) / (bq + sq) else 0.0 end as qty_imbalance,
  case when bn + sn > 0 then (bn - sn)::double / (bn + sn) else 0.0 end as count_imbalance from (select g.symbol, g.slot, v.valid, {only_valid(R6)}, i.last_id, t.bq, t.sq, t.bn, t.sn
  from (select symbol, unnest(generate_series(cast(ceil(min(us) / 1000000.0) as bigint) * 1000000, cast(ceil(max(us) / 1000000.0) as bigint) * 1000000, 1000000)) as slot from updates group by symbol) g asof join valid v on v.symbol = g.symbol and v.us <= g.slot
  join (select symbol, us, max(seq) as last_id from updates group by 1, 2) i on i.symbol = v.symbol and i.us = v.us left join (select d.symbol, cast(ceil(d.us / 1000000.0) as bigint) * 1000000 as slot, sum(case when not buyer_maker then qty else 0.0 end) as bq, sum(case when buyer_maker then qty else 0.0 end) as sq,
    count(*) filter (where not buyer_maker) as bn, count(*) filter (where buyer_maker) as sn from deals d left join (select symbol, cast(ceil(us / 1000000.0) as bigint) * 1000000 as slot, max(us) as cut from valid where not valid group by 1, 2) c on c.symbol = d.symbol and c.slot = cast(ceil(d.us / 1000000.0) as bigint) * 1000000
    where cut is null or d.us > cut group by 1, 2) t on t.symbol = g.symbol and t.slot = g.slot where v.valid)"""
SAMPLED_DOUBLES = f" {R2}, buy_qty, sell_qty, qty_imbalance, count_imbalance"


@query("r2_sampled_rows", f"{SAMPLED_SQL} ##{SAMPLED_DOUBLES}", f"{UPDATES_SQL}, {DEALS}")
def r2_rows(spark, sf):
    """25 columns a second, while the book is valid."""
    state, blocks = books.books(updates(spark, sf), BLOCK)
    return books.sampled_rows(books.latched(state), books.slots_of(blocks, 1_000_000, BLOCK), deals(spark, sf), 1_000_000)


FEAT = f"""{LAGGED}, feat as (select symbol, t, close, t // 86400 as day, r, (close / lag(close, 3) over ({W}) - 1) * 1e4 as r3, case when count(r) {over(-5, 0)} = 6 then stddev_pop(r) {over(-5, 0)} end as v6, ln(lead(close, 3) over ({W}) / close) * 1e4 as y,
  lead(t, 3) over ({W}) // 86400 as label_end_day, row_number() over ({W}) - 1 as k from lagged)"""


def feat(spark, sf):
    """Bars with three features and the log return over the next three bars, y."""
    d = lagged(spark, sf)
    return d.select(
        "symbol", "t", "close", F.floor(F.col("t") / 86400).alias("day"), "r", fx.simple_return(3).alias("r3"), fx.rolling_vol(6).alias("v6"), labels.forward_return(3).alias("y"),
        F.floor(F.lead("t", 3).over(qa.by_time()) / 86400).alias("label_end_day"),
    )


LABELLED = "y is not null and r is not null and r3 is not null and v6 is not null"


def refits_sql(gap: int) -> str:
    return f"""select s.symbol, s.refit, 30 + s.refit * 50 as stands_at, (select count(*) from feat f where f.symbol = s.symbol and f.k + {gap} <= 30 + s.refit * 50 and y is not null and r is not null and r3 is not null and v6 is not null) as train, s.scored
  from (select symbol, (k - 30) // 50 as refit, count(*) as scored from feat where k >= 30 group by 1, 2) s"""


@query("m1_refits", refits_sql(3), FEAT)
def m1_refits(spark, sf):
    d = walk.placed(feat(spark, sf)).withColumn("labelled", F.expr(LABELLED))
    return walk.refits(d, gap=3, every=50, least=30).withColumnRenamed("at", "stands_at")


@query("m2_refits", refits_sql(9), FEAT)
def m2_refits(spark, sf):
    d = walk.placed(feat(spark, sf)).withColumn("labelled", F.expr(LABELLED))
    return walk.refits(d, gap=9, every=50, least=30).withColumnRenamed("at", "stands_at")


@query("m1_walk_forward")
def m1(spark, sf):
    """Linear heads: a fast stand-in for the trees of m1_boosted."""
    d = feat(spark, sf).withColumn("up", (F.col("y") > 0).cast("double"))
    d = walk.walk_forward(d, FEATURES, ["up"], gap=3, every=50, least=30)
    p = F.least(F.greatest("p_up", F.lit(0.01)), F.lit(0.99))
    confidence = F.greatest(p, 1 - p)
    return d.select("symbol", "t", "train", p.alias("p"), F.when(confidence < 0.55, "NO_TRADE").when(p >= 0.5, "LONG").when(p < 0.5, "SHORT").alias("action"))


@query("m1_boosted")
def m1_boosted(spark, sf):
    """Boosted trees, refitted every 100 bars; the gate stands on confidence as the last fifth of each model's rows bears it out."""
    d = feat(spark, sf).withColumn("up", (F.col("y") > 0).cast("double"))
    state = trees.with_heads(trees.expanding(d, FEATURES, ["up"], gap=3, every=100, least=60), {"up": UP})
    scored = trees.calibrated(trees.boost(written(state, "state"), {"up": UP}, trees=6, depth=3)[0])
    action = F.when(F.col("calibrated") < 0.55, "NO_TRADE").when(F.col("p") >= 0.5, "LONG").otherwise("SHORT")
    return scored.select("symbol", "t", "refit", "train", "p", "calibrated", action.alias("action"))


UP = trees.Head("up", "logistic", 0.2, 1.5)
FOUR = {"win_long": "logistic", "win_short": "logistic", "ev_long": "squared", "ev_short": "squared"}


def sides(d):
    y = F.col("y")
    return d.withColumns({"win_long": (y > 2).cast("double"), "win_short": (y < -2).cast("double"), "ev_long": y - 2, "ev_short": -y - 2})


def four_heads(d, names):
    from ..operators.selection import expected_value_side

    d = walk.walk_forward(sides(d), names, list(FOUR), gap=9, every=50, least=30)
    return d.select("symbol", "t", "train", "p_win_long", "p_win_short", "p_ev_long", "p_ev_short", expected_value_side(*[F.col(f"p_{c}") for c in FOUR]).alias("action"))


def four_trees(d, names, every):
    """Two probabilities and two expected values by boosted trees, and the side they choose."""
    from ..operators.selection import expected_value_side

    heads = {n: trees.Head(n, loss, 0.2, 1.5) for n, loss in FOUR.items()}
    state = trees.with_heads(trees.expanding(sides(d), names, list(FOUR), gap=9, every=every, least=60), heads)
    scored = trees.boost(written(state, "state"), heads, trees=4, depth=3)[0].filter("part = 2")
    value = lambda n: F.max(F.when(F.col("head") == n, 1 / (1 + F.exp(-F.col("f"))) if FOUR[n] == "logistic" else F.col("f"))).alias(n)
    d = scored.groupBy("symbol", "t", "refit", "train").agg(*map(value, FOUR))
    return d.select("symbol", "t", "refit", "train", *FOUR, expected_value_side(*map(F.col, FOUR)).alias("action"))


@query("m2_four_heads")
def m2_heads(spark, sf):
    return four_heads(feat(spark, sf), FEATURES)


@query("m2_boosted")
def m2_boosted(spark, sf):
    return four_trees(feat(spark, sf), FEATURES, 200)


WIDE = ["rsi", "atr", "sma12", "range12", "trend12", "r6", "v12"]


def wider(spark, sf):
    """More columns: averages, range, RSI, clock, and the last valid return of every other symbol, 0 where it has none."""
    d = lagged(spark, sf)
    wide = dict(zip(WIDE, (fx.rsi(14), fx.atr(14), fx.sma_distance(12), fx.range_position(12), fx.trend_consistency(12), fx.simple_return(6), fx.rolling_vol(12)), strict=True))
    more = d.select("symbol", "t", *[c.alias(k) for k, c in wide.items()], F.sin(F.col("t") % 86400 / 86400 * 6.283185307179586).alias("clock"))
    peers = ("click", "error", "purchase", "signup", "view")
    packet = d.groupBy("t").agg(*[F.max(F.when(F.col("symbol") == s, F.col("r"))).alias(f"r_{s}") for s in peers])  # a row a bar
    rows = feat(spark, sf).join(more, ["symbol", "t"]).join(packet, "t", "left")
    return rows.withColumns({f"r_{s}": F.when(F.col("symbol") == s, 0.0).otherwise(F.coalesce(f"r_{s}", F.lit(0.0))) for s in peers}), [*FEATURES, *WIDE, "clock", *[f"r_{s}" for s in peers]]


@query("m3_wider_features")
def m3(spark, sf):
    """The same policy on more columns."""
    return four_heads(*wider(spark, sf))


@query("m3_boosted")
def m3_boosted(spark, sf):
    return four_trees(*wider(spark, sf), 300)


@query("m5_inner_alpha")
def m5_alpha(spark, sf):
    return walk.inner_alpha(feat(spark, sf).filter(LABELLED), FEATURES, "y", [0.1, 1.0, 10.0, 100.0])


GRID = {"slow": trees.Head("y", rate=0.1), "fast": trees.Head("y", rate=0.3), "stiff": trees.Head("y", rate=0.3, ridge=100.0)}


def pooled(spark, sf):
    """One model over all symbols, in three settings: rows before the cut fit, the last of them validate, later ones are scored."""
    d = feat(spark, sf).filter(LABELLED)
    inner = CUT - 5 * 86400
    part = F.when(F.col("t") < inner - 3 * HOUR, 0).when((F.col("t") >= inner) & (F.col("t") < CUT - 3 * HOUR), 1).when(F.col("t") >= CUT, 2)
    d = d.withColumns({"part": part, "_all": F.lit("all"), "refit": F.lit(0)}).filter("part is not null")
    cuts = trees.edges(d.filter("part = 0"), FEATURES, 16, ["_all"])
    d = d.join(F.broadcast(cuts), "_all").select(F.col("_all").alias("symbol"), "refit", "part", "t", F.col("symbol").alias("of"), trees.binned(FEATURES).alias("bins"), "y")
    return trees.boost(written(trees.with_heads(d, GRID), "state"), GRID, trees=6, depth=3)


@query("m5_elastic_net")
def m5_elastic(spark, sf):
    """Weights by symbol of an elastic net on the rows before the cut, and how it does after it."""
    d = feat(spark, sf).filter(LABELLED)
    scored, weights = walk.elastic_net(d.filter(F.col("t") < CUT - 3 * HOUR), d.filter(F.col("t") >= CUT), FEATURES, "y", ["symbol"])
    error = scored.groupBy("symbol").agg(F.count("*").alias("scored"), F.avg((F.col("y") - F.col("prediction")) ** 2).alias("mse"))
    return weights.join(error, "symbol", "left")


@query("m6_boosted_trees")
def m6(spark, sf):
    """Predictions of the setting that did best on the validation rows."""
    state = pooled(spark, sf)[0]
    errors = state.filter("part = 1").groupBy("head").agg(F.avg((F.col("y") - F.col("f")) ** 2).alias("mse"))
    best = errors.agg(F.min_by("head", F.struct(F.round("mse", 9), "head")).alias("head"), F.min("mse").alias("mse"))
    return state.filter("part = 2").join(F.broadcast(best), "head").select(F.col("of").alias("symbol"), "t", "y", F.col("f").alias("prediction"), "head")


@query("k7_importances")
def k7(spark, sf):
    return trees.importances(pooled(spark, sf)[1].filter("head = 'slow'"), FEATURES).orderBy(F.desc("importance"), "feature").limit(20)


@query("m7_nested_rows", """select e.symbol, e.day, (select count(*) from feat f where f.symbol = e.symbol and f.label_end_day < e.day and y is not null and r3 is not null and v6 is not null) as train_rows, e.n as eval_rows from
  (select symbol, day, count(*) as n, row_number() over (partition by symbol order by day) as k from feat where y is not null and r3 is not null and v6 is not null group by 1, 2) e where k > 3""", FEAT)
def m7_rows(spark, sf):
    return nested(spark, sf).select("symbol", "day", "train_rows", "eval_rows")


def nested(spark, sf):
    return walk.nested_days(feat(spark, sf).filter(LABELLED), FEATURES, "y", [0.1, 1.0, 10.0, 100.0])


@query("m7_nested_choice")
def m7(spark, sf):
    return nested(spark, sf)


@query("m8_calibrated_utility")
def m8(spark, sf):
    d = feat(spark, sf).filter(LABELLED).withColumns({"win": (F.col("y") > 2).cast("int"), "net": F.col("y") - 2})
    middle = CUT - 5 * 86400
    return walk.calibrated_side(d.filter(F.col("t") < middle - 3 * HOUR), d.filter((F.col("t") >= middle) & (F.col("t") < CUT - 3 * HOUR)), d.filter(F.col("t") >= CUT), FEATURES, "win", "net").select("symbol", "t", "p", "utility")


ORDERS_SQL = f"""{SIGNALS}, orders_ as (select symbol, side, t, gross, (t // 3600) % 3 <> 0 as filled from trades), history as (select symbol, side, avg(case when filled then 1.0 else 0.0 end) as p, avg(gross) filter (where filled) as g from orders_ where t < {CUT} group by 1, 2),
scored as (select o.*, p * (g - 6) as ev from orders_ o left join history h on h.symbol = o.symbol and h.side = o.side where t >= {CUT}), sums as (select th as threshold, count(ev) as submitted, count(*) filter (where filled) as fills, coalesce(sum(case when filled then gross - 6 end), 0.0) as total
  from (values (0.0::double), (0.1), (0.25)) v(th) left join scored on ev > th group by th)"""


@query("m11_expected_value", """select threshold, submitted, fills, total, ok and row_number() over (order by ok desc, total desc, threshold) = 1 as chosen from (select *, submitted >= 5 and fills >= 3 as ok from sums) ## threshold, total""", ORDERS_SQL)
def m11(spark, sf):
    d = trades(spark, sf).select("symbol", "side", "t", "gross", (F.floor(F.col("t") / 3600) % 3 != 0).alias("filled"))
    return walk.fill_times_markout(d.filter(F.col("t") < CUT), d.filter(F.col("t") >= CUT), ["symbol", "side"], 6.0, [0.0, 0.1, 0.25], submitted=5, filled=3)[1]


GATE_SQL = f"""{FEAT}, sized as (select f.symbol, f.t, f.y, s.m as pred, case when f.v6 is not null then case when count(b.v6) = 0 then 0.5 else count(*) filter (where b.v6 <= f.v6) / count(b.v6)::double end end as vol_rank from feat f
  join (select symbol, t, (close / lag(close, 5) over ({W}) - 1) * 1e4 as m from bars) s on s.symbol = f.symbol and s.t = f.t left join feat b on b.symbol = f.symbol and b.k between f.k - 48 and f.k - 1 group by 1, 2, 3, 4, f.v6),
limits as (select symbol, quantile_cont(abs(pred), 0.75) as least from sized where t < {CUT} and pred is not null group by symbol),
spans as (select s.symbol, s.t, s.t as start, s.t + 10800 as stop, sign(pred) * y as gross, row_number() over (partition by s.symbol order by s.t) as k from sized s join limits l on l.symbol = s.symbol where t >= {CUT} and y is not null and abs(pred) >= least and vol_rank >= 0.6 and abs(pred) > 18)"""


@query("m12_economic_gate", f"""select symbol, m as cost_multiple, count(*) as trades, sum(gross - 12 * m) as total from {greedy_sql('spans', '>')} cross join (values (1.0::double), (1.5), (2.0)) c(m) group by symbol, m ## cost_multiple, total""", GATE_SQL)
def m12(spark, sf):
    momentum = hourly(spark, sf).select("symbol", "t", fx.simple_return(5).alias("pred"))
    d = feat(spark, sf).select("symbol", "t", "y", fx.percentile_rank("v6", 48).alias("vol_rank")).join(momentum, ["symbol", "t"])
    passed = walk.economic_gate(d.filter(F.col("t") < CUT).dropna(subset=["pred"]), d.filter((F.col("t") >= CUT) & F.col("y").isNotNull()), 12.0)
    kept = labels.non_overlapping(passed.select("symbol", "t", (F.col("t") + 3 * HOUR).alias("t_end"), (F.signum("pred") * F.col("y")).alias("gross")), "symbol", "t", "t_end", strict=True, block=WEEK)
    many = kept.select("symbol", "gross", F.explode(F.array(*map(F.lit, (1.0, 1.5, 2.0)))).alias("cost_multiple"))
    return many.groupBy("symbol", "cost_multiple").agg(F.count("*").alias("trades"), F.sum(F.col("gross") - 12 * F.col("cost_multiple")).alias("total"))


@query("m14_survivors", f"""select a.symbol, a.side, a.trades, a.total, a.profit_factor from economics a join economics b on b.symbol = a.symbol and b.side = a.side where a.cost_bps = 8 and b.cost_bps = 12 and a.trades >= 5 and a.total > 0 and coalesce(a.profit_factor, 1e9) >= 1.05 and b.total > 0 ## total, profit_factor""",
  SIGNALS + f", economics as ({economics_sql('symbol, side', '(8.0::double), (12.0)')})")
def m14(spark, sf):
    e = metrics.full_economics(trades(spark, sf), spark.createDataFrame(COSTS[1:], "cost_bps double"), ["symbol", "side"])
    return walk.survivors(e, ["symbol", "side"], 8.0, 12.0, trades=5, factor=1.05)


def pooled_sql(name: str, source: str) -> str:
    """What the structural gates judge, by symbol: a CTE over trades (symbol, t, fold, gross)."""
    at = lambda c: f"""select symbol, count(*) as trades, sum(net) as total, avg(net) as mean_net, sum(greatest(net, 0.0)) / nullif(-sum(least(net, 0.0)), 0) as profit_factor, case when max(dd) > 0 then sum(net) / max(dd) when sum(net) > 0 then 'inf'::double else 0.0 end as total_over_drawdown
    from (select *, greatest(max(eq) over w, 0.0) - eq as dd from (select *, sum(net) over w as eq from (select symbol, t, gross - {c} as net from {source}) window w as (partition by symbol order by t rows unbounded preceding)) window w as (partition by symbol order by t rows unbounded preceding)) group by symbol"""  # noqa: E731
    return f"""{name} as (select a.*, b.total as stress_total, b.mean_net as stress_mean, folds, positive_folds, worst_fold, positive_hours, coalesce(day_share, 1.0) as day_share from ({at('8.0')}) a join ({at('12.0')}) b on b.symbol = a.symbol
  join (select symbol, count(*) as folds, count(*) filter (where m > 0) as positive_folds, min(m) as worst_fold from (select symbol, fold, avg(gross - 8.0) as m from {source} group by 1, 2) group by 1) f on f.symbol = a.symbol
  join (select symbol, avg(case when s > 0 then 1.0 else 0.0 end) as positive_hours from (select symbol, t // 3600 as h, sum(gross - 8.0) as s from {source} group by 1, 2) group by 1) h on h.symbol = a.symbol
  join (select symbol, max(greatest(s, 0.0)) / nullif(sum(greatest(s, 0.0)), 0) as day_share from (select symbol, t // 86400 as d, sum(gross - 8.0) as s from {source} group by 1, 2) group by 1) d on d.symbol = a.symbol)"""


GATES = {
    "all_folds": "folds = 5", "positive_folds": "positive_folds >= 4", "mean_net": "mean_net >= 1.0", "total": "total > 0", "profit_factor": "coalesce(profit_factor, 1e300) >= 1.25", "total_over_drawdown": "total_over_drawdown >= 2.0",
    "trades": "trades >= 100", "positive_hours": "positive_hours >= 0.55", "stress_mean": "stress_mean > 0", "stress_total": "stress_total > 0", "fold_floor": "worst_fold >= -2.0", "day_share": "day_share <= 0.5",
}
JUDGED = f"""{SIGNALS}, folded as (select symbol, t, gross, day % 5 as fold from trades), {pooled_sql('pooled', 'folded')},
judged as (select symbol, gate, passed, min(cast(passed as integer)) over (partition by symbol) = 1 as all_passed from ({' union all '.join(f"select symbol, '{k}' as gate, coalesce({x}, false) as passed from pooled" for k, x in GATES.items())}))"""


def folded(spark, sf):
    return trades(spark, sf).withColumn("fold", F.col("day") % 5)


@query("m15_structural", "select * from judged", JUDGED)
def m15_structural(spark, sf):
    """Twelve gates of trades pooled over five folds, at 8 bps and under stress at 12."""
    return verdicts.judged(verdicts.pooled(folded(spark, sf), ["symbol"], block=WEEK), ["symbol"], verdicts.structural())


STATUSES = f"""{JUDGED}, weeks as (select symbol, count(distinct t // 604800) as folds, count(distinct t // 604800) filter (where gross > 0) as up from trades group by 1),
targets as (select w.symbol, cast(case when w.symbol = 'error' then 2 when w.symbol = 'signup' then 0 else w.folds end as bigint) as folds, mean_net > 0 as signal, all_passed as economic, case when w.symbol <> 'view' then 8.0::double end as cost from weeks w join pooled p on p.symbol = w.symbol join (select distinct symbol, all_passed from judged) j on j.symbol = w.symbol),
statuses as (select *, case when folds = 0 then 'UNAVAILABLE' when folds < 4 then 'INCONCLUSIVE' when signal and cost is null then 'PENDING_COST' when signal and economic then 'PROMOTED' else 'REJECTED' end as status from targets)"""


def ladder_rows(spark, sf):
    """Targets as runs left them: one has too few folds, one none, one no cost."""
    p = verdicts.pooled(folded(spark, sf), ["symbol"], block=WEEK)
    economic = verdicts.judged(p, ["symbol"], verdicts.structural()).select("symbol", F.col("all_passed").alias("economic")).distinct()
    weeks = trades(spark, sf).groupBy("symbol").agg(F.countDistinct(F.floor(F.col("t") / WEEK)).alias("_w"))
    folds = F.when(F.col("symbol") == "error", 2).when(F.col("symbol") == "signup", 0).otherwise(F.col("_w")).cast("long")
    d = p.select("symbol", (F.col("mean_net") > 0).alias("signal")).join(economic, "symbol").join(weeks, "symbol")
    return verdicts.ladder(d.select("symbol", folds.alias("folds"), "signal", "economic", F.when(F.col("symbol") != "view", 8.0).alias("cost")), 4)


@query("m15_ladder", "select * from statuses ## cost", STATUSES)
def m15_ladder(spark, sf):
    return ladder_rows(spark, sf)


@query("m15_decision", """select *, case when promoted > 0 and promoted = scored then 'PASS' when promoted > 0 then 'PARTIAL_PASS' when pending_cost > 0 then 'PENDING_COST_MODEL' when scored > 0 and inconclusive > 0 then 'PARTIAL_INCONCLUSIVE' when scored > 0 then 'FAIL' else 'INCONCLUSIVE' end as promotion,
  case when promoted > 0 then 'PROMOTE_TARGETS' when pending_cost > 0 then 'SIGNALS_NEED_COSTS' when scored > 0 and inconclusive > 0 then 'NO_DECISION' when scored > 0 then 'REJECT' else 'REPAIR_FEASIBILITY' end as decision from (
  select count(*) filter (where status = 'UNAVAILABLE') as unavailable, count(*) filter (where status = 'INCONCLUSIVE') as inconclusive, count(*) filter (where status = 'PENDING_COST') as pending_cost, count(*) filter (where status = 'PROMOTED') as promoted,
    count(*) filter (where status = 'REJECTED') as rejected, count(*) filter (where status in ('PENDING_COST', 'PROMOTED', 'REJECTED')) as scored from statuses)""", STATUSES)
def m15_decision(spark, sf):
    d = verdicts.decision(ladder_rows(spark, sf))
    return d.withColumn("scored", F.col("pending_cost") + F.col("promoted") + F.col("rejected"))


def diagnosed(spark, sf):
    """Kinds of the last return as external column, beside two slower ones; y is the return over the next three bars, and the leak a return that lies in it."""
    d = feat(spark, sf).select("symbol", "t", "r", "r3", "v6", "y")
    return verdicts.diagnostics(verdicts.controls(d, ["symbol"], "t", "r", 1, 3, 7, WEEK).withColumn("up", (F.col("y") > 0).cast("int")), ["r3", "v6"], "r", "y", "up", CUT)


@query("m13_diagnostics")
def m13_diagnostics(spark, sf):
    return diagnosed(spark, sf)


@query("m13_verdict")
def m13_verdict(spark, sf):
    """Whether the leak is seen (AUC up by 0.02) and the placebos fail what the primary must pass: an AUC of 0.52 and a mean above 2 bps."""
    return verdicts.suite(diagnosed(spark, sf), (F.col("auc") >= 0.52) & (F.col("mean_net") > 2.0))


@query("m8_both_sides")
def m8_pair(spark, sf):
    """Both sides calibrated on the first half of an inner stretch, c chosen by what the actions bring on the second half."""
    d = feat(spark, sf).filter(LABELLED).withColumns({"win_long": (F.col("y") > 2).cast("int"), "win_short": (F.col("y") < -2).cast("int"), "net_long": F.col("y") - 2, "net_short": -F.col("y") - 2})
    a, b, gap = CUT - 8 * 86400, CUT - 4 * 86400, 3 * HOUR
    part = lambda lo, hi: d.filter((F.col("t") >= lo) & (F.col("t") < hi))
    sides = {"long": ("win_long", "net_long"), "short": ("win_short", "net_short")}
    out = walk.calibrated_pair(part(0, a - gap), part(a, b - gap), part(b, CUT - gap), d.filter(F.col("t") >= CUT), FEATURES, sides, [0.1, 1.0])
    return out.select("symbol", "t", "p_long", "p_short", "utility_long", "utility_short", "action", "c")
