"""Market views over the given tables: ticks, bars, a revised macro ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3600


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, from its fields, so that no session zone matters."""
    c = F.col(ts)
    day = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    second = F.date_part(F.lit("SECOND"), c).cast("decimal(8,6)")
    return (day * 86400 + F.hour(c) * 3600 + F.minute(c) * 60) * 1_000_000 + (second * 1_000_000).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, us, tick_id, price, qty, side, buyer_maker, venue."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("symbol"), micros("ts").alias("us"), F.col("event_id").alias("tick_id"), (100 + F.col("value")).alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("qty"), F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell").alias("side"),
        (F.col("user_id") % 2 == 1).alias("buyer_maker"), (F.col("user_id") % 3).cast("int").alias("venue"),
    )


def bars(source: DataFrame, seconds: int = HOUR) -> DataFrame:
    """OHLC bars of ticks: symbol, t (start, seconds since 1970), open, high, low, close, n. Empty windows stay absent."""
    t = (F.floor(F.col("us") / (seconds * 1_000_000)) * seconds).cast("long")
    first = F.struct("us", "tick_id")
    return source.withColumn("t", t).groupBy("symbol", "t").agg(
        F.min_by("price", first).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", first).alias("close"), F.count("*").alias("n"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(ticks(spark, sf_dir))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, known (day number), observed (first day number of the month), value, seq: facts with two times and revisions."""
    o = table(spark, sf_dir, "orders")
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    d = F.col("o_orderdate").cast("date")
    return o.select(
        F.col("o_orderpriority").alias("series"), day(d).alias("known"), day(F.trunc(d, "month")).alias("observed"),
        F.col("o_totalprice").cast("double").alias("value"), F.col("o_orderkey").alias("seq"),
    )


TICKS_SQL = """ticks as (
  select event_type as symbol, epoch_us(ts) as us, event_id as tick_id, 100 + value as price, cast(json_extract_string(props, '$.k') as double) as qty,
    case when user_id % 2 = 0 then 'buy' else 'sell' end as side, user_id % 2 = 1 as buyer_maker, cast(user_id % 3 as integer) as venue from events
)"""


def bars_sql(seconds: int = HOUR) -> str:
    return f"""{TICKS_SQL}, bars as (
  select symbol, cast(us // {seconds * 1_000_000} as bigint) * {seconds} as t, first(price order by us, tick_id) as open, max(price) as high, min(price) as low,
    last(price order by us, tick_id) as close, count(*) as n from ticks group by 1, 2
)"""


LEDGER_SQL = """ledger as (
  select o_orderpriority as series, date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as known,
    date_diff('day', date '1970-01-01', cast(date_trunc('month', o_orderdate) as date)) as observed, cast(o_totalprice as double) as value, o_orderkey as seq from orders
)"""
