"""Structured Streaming twins: bars, routing, trades once, joined samples, stale rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from ..sources.shared import new_folder
from .stateful import rocks


def bars(ticks: DataFrame, seconds: int, lateness: str) -> DataFrame:
    """OHLC bars of a stream of ticks (symbol, us, tick_id, price); a bar is given when the watermark has passed its end, later ticks are dropped."""
    at = F.struct("us", "tick_id")
    d = ticks.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", lateness)
    g = d.groupBy("symbol", F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count("*").alias("n")
    )
    return g.select("symbol", F.unix_seconds("w.start").alias("t"), "open", "high", "low", "close", "n")


def kind_of(event_type: Column, stream: Column) -> Column:
    """depth, agg_trade, book_ticker or other: by the payload's type, else by the stream's name."""
    of = lambda c, *words: F.coalesce(F.lower(c).rlike("|".join(words)), F.lit(False))
    typed = F.when(of(event_type, "^depthupdate$"), "depth").when(of(event_type, "^aggtrade$"), "agg_trade").when(of(event_type, "^bookticker$"), "book_ticker")
    named = F.when(of(stream, "@depth"), "depth").when(of(stream, "@aggtrade"), "agg_trade").when(of(stream, "@bookticker"), "book_ticker")
    return F.coalesce(typed, named, F.lit("other"))


def trades_once(trades: DataFrame, key: list[str], within: str) -> DataFrame:
    """The first arrival of each key within the watermark's span."""
    return trades.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", within).dropDuplicatesWithinWatermark(key).drop("ts")


def packed(rows: DataFrame, seconds: int, lateness: str) -> DataFrame:
    """Rows (symbol, us, ...) of a stream as packets: those of a symbol and a slot (w) within a batch of Arrow, one array a column."""
    names = [c for c in rows.columns if c != "symbol"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = pa.Table.from_batches([b]).group_by(["symbol", "_slot"], use_threads=False).aggregate([(c, "list") for c in names])
            yield from g.select(["symbol", *[f"{c}_list" for c in names]]).rename_columns(["symbol", *names]).to_batches()

    d = rows.filter("symbol is not null and us is not null").select("symbol", *names, F.floor(F.col("us") / (seconds * 1_000_000)).alias("_slot"))
    kept = StructType([StructField("symbol", rows.schema["symbol"].dataType), *[StructField(c, ArrayType(rows.schema[c].dataType)) for c in names]])
    d = d.mapInArrow(pack, kept).withColumn("ts", F.timestamp_micros(F.array_max("us"))).withWatermark("ts", lateness)
    return d.withColumn("w", F.window("ts", f"{seconds} seconds")).drop("ts")


def sampled_packets(books: DataFrame, trades: DataFrame, seconds: int, lateness: str) -> DataFrame:
    """Packets of trades with the packets of book samples (symbol, us, mid) of their slot: a join of two streams whose state the watermarks bound.

    What is joined, kept in the state and given grows with the rows, as far as rows of a slot come together; each_pair makes the pairs of them.
    """
    b = packed(books.select("symbol", "us", "mid"), seconds, lateness).withColumnRenamed("us", "book_us")
    return packed(trades, seconds, lateness).join(b, ["symbol", "w"]).drop("w")


def each_pair(packets: DataFrame) -> DataFrame:
    """Every trade with every book sample of its slot."""
    names = [c for c in packets.columns if c not in ("symbol", "book_us", "mid")]
    d = packets.select("symbol", F.explode(F.arrays_zip(*names)).alias("_t"), F.arrays_zip("book_us", "mid").alias("_b"))
    return d.select("symbol", "_t", F.explode("_b").alias("_b")).select("symbol", *[F.col("_t")[c].alias(c) for c in names], "_b.book_us", "_b.mid")


def sampled(books: DataFrame, trades: DataFrame, seconds: int, lateness: str) -> DataFrame:
    """Trades with the book samples (symbol, us, mid) of their slot, as a stream of pairs. Their number is a product by slot: a table of packets (sampled_packets) stays small, and can be read as pairs (each_pair)."""
    return each_pair(sampled_packets(books, trades, seconds, lateness))


def with_staleness(d: DataFrame, most_us: int) -> DataFrame:
    """Adds age_us (arrival less exchange time) and valid; stale rows are kept as invalid."""
    return d.withColumn("age_us", F.col("local_us") - F.col("us")).withColumn("valid", F.col("age_us") <= most_us)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there now into a table of the shared folder, and read that. State lies in RocksDB."""
    spark = stream.sparkSession
    path = new_folder(spark, name)
    with rocks(spark):
        stream.writeStream.format("parquet").option("checkpointLocation", new_folder(spark, f"{name}-state")).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def replay(table: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """A table as a stream of files: it is written to the shared folder once and read as it arrived, at most so many files a micro-batch."""
    path = new_folder(table.sparkSession, name)
    table.write.parquet(path)
    reader = table.sparkSession.readStream.schema(table.schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)
