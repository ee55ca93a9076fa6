"""Payload parsing, upserts and fingerprints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUOTE = "struct<timestamp:array<bigint>,open:array<double>,high:array<double>,low:array<double>,close:array<double>>"


def parse_columnar(payloads: DataFrame, column: str) -> DataFrame:
    """Parallel arrays of a JSON payload as rows (t, open, high, low, close); rows with a missing part go."""
    d = payloads.withColumn("_p", F.from_json(column, QUOTE)).drop(column)
    keep = d.columns[:-1]
    zipped = F.arrays_zip(*[F.col(f"_p.{c}").alias(c) for c in ("timestamp", "open", "high", "low", "close")])
    rows = d.select(*keep, F.explode(zipped).alias("_r"))
    parts = [F.col("_r.timestamp").alias("t"), *[F.col(f"_r.{c}").alias(c) for c in ("open", "high", "low", "close")]]
    return rows.select(*keep, *parts).dropna(subset=["t", "open", "high", "low", "close"])


def parse_rows(payloads: DataFrame, column: str) -> DataFrame:
    """A JSON array of objects with string numbers as rows (datetime, open, high, low, close); malformed items go."""
    item = "array<struct<datetime:string,open:string,high:string,low:string,close:string>>"
    rows = payloads.withColumn("_r", F.explode(F.from_json(F.get_json_object(column, "$.values"), item)))
    number = [F.expr(f"try_cast(_r.{c} as double)").alias(c) for c in ("open", "high", "low", "close")]
    keep = [c for c in payloads.columns if c != column]
    return rows.select(*keep, F.expr("try_cast(_r.datetime as timestamp_ntz)").alias("datetime"), *number).dropna(subset=["datetime", "open", "high", "low", "close"])


def upsert(base: DataFrame, new: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """Last write wins: new rows replace base rows of the same key, and of new rows of one key the one with the highest sequence does.

    sequence: a column of new alone that tells in which order its rows were written; ties go to the largest row by its columns. Keys compare null-safe.
    """
    row = F.struct(*[c for c in base.columns if c not in key])
    of = lambda d, side, at: d.select(*key, F.struct(F.lit(side).alias("side"), at.alias("at"), row.alias("row")).alias("_r"))
    both = of(base, 0, F.lit(None).cast(new.schema[sequence].dataType)).unionByName(of(new, 1, F.col(sequence)))
    last = both.groupBy(*key).agg(F.max("_r").alias("_r"))
    return last.select(*key, "_r.row.*").select(*base.columns)


def pending_chunks(spark, first_day: int, last_day: int, days: int, done: DataFrame) -> DataFrame:
    """Chunks (start, end) of a range of days that the ledger of completed ones does not hold."""
    chunks = spark.range(first_day, last_day + 1, days).select(F.col("id").alias("start"), F.least(F.col("id") + days - 1, F.lit(last_day)).alias("end"))
    return chunks.join(done, ["start", "end"], "left_anti")


LEDGER = "start long, end long, rows long, seq long"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def completed(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger of chunks that were written whole: start, end, rows, seq. Without data there is none, whatever the ledger says."""
    if not (_exists(spark, f"{folder}/data") and _exists(spark, f"{folder}/ledger")):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{folder}/ledger")


def backfill(spark: SparkSession, folder: str, first_day: int, last_day: int, days: int, fetch: Callable[[DataFrame], DataFrame], schema: str, at_once: int = 64) -> int:
    """Fill a folder chunk by chunk; gives the number of chunks that were fetched. To be called again after any failure.

    fetch takes a table of pending chunks (start, end: day numbers, both inside) and returns their rows with the columns of schema, and start and end of
    their chunk. `at_once` chunks are fetched together. Their rows replace the partitions of these chunks alone (dynamic overwrite), and only
    then the ledger takes them on: what fails in between is fetched again and replaces what it left. Chunks in the ledger are skipped. A chunk without rows
    is completed too. Chunks of another length are other chunks; where they overlap, stored() takes the later write.
    """
    if days < 1 or at_once < 1:
        raise ValueError("days and at_once must be 1 at least")
    done = completed(spark, folder)
    seq = (done.agg(F.max("seq")).first()[0] or 0) + 1
    todo = pending_chunks(spark, first_day, last_day, days, done.select("start", "end")).orderBy("start").collect()  # a row a chunk, as in any ledger
    for at in range(0, len(todo), at_once):
        part = spark.createDataFrame(todo[at : at + at_once], "start long, end long")
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        rows = fetch(part).select(*names, "start", "end")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("start", "end").parquet(f"{folder}/data")
        written = spark.read.schema(f"{schema}, start long, end long").parquet(f"{folder}/data").join(F.broadcast(part), ["start", "end"], "left_semi").groupBy("start", "end").agg(F.count("*").alias("rows"))
        entry = part.join(written, ["start", "end"], "left").select("start", "end", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), F.lit(seq).cast("long").alias("seq"))
        entry.coalesce(1).write.mode("append").parquet(f"{folder}/ledger")
        seq += 1
    return len(todo)


def stored(spark: SparkSession, folder: str, schema: str, key: list[str]) -> DataFrame:
    """The rows of all completed chunks; of rows with one key, the one of the chunk that was completed last (then the later chunk). What no ledger entry stands for does not count."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    done = completed(spark, folder)
    if not _exists(spark, f"{folder}/data"):
        return spark.createDataFrame([], schema)
    d = spark.read.schema(f"{schema}, start long, end long").parquet(f"{folder}/data").join(done.select("start", "end", "seq"), ["start", "end"])
    rest = F.struct("seq", "start", "end", *[c for c in names if c not in key])
    return d.groupBy(*key).agg(F.max(rest).alias("_r")).select(*[F.col(c) if c in key else F.col(f"_r.{c}") for c in names])


def fingerprint(df: DataFrame, text: list[Column]) -> DataFrame:
    """An order-free digest of rows by the given texts of their columns: their number, and sum and exclusive or of 60 bits of each row's MD5.

    Both are added up in any order and by any number of tasks; repeated rows count in the number and the sum. A null is an empty text.
    """
    part = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in text]).cast("binary")), 1, 15), 16, 10).cast("long")
    d = df.select(part.alias("h"))
    return d.agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("total"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("mixed"))
