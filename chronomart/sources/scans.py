"""Scans that fail closed: bars, macro ledgers, release calendars, manifests, grids, sealed days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR = "symbol string, timestamp string, open double, high double, low double, close double"
FACT = "series string, known_at string, observation_date date, value double"


def iso_seconds(text):
    """Seconds since 1970 of an ISO 8601 time with Z, whatever the session's zone; null for anything else."""
    whole = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})T(\d{2}):(\d{2}):(\d{2})Z$", 1)
    part = lambda k: F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})T(\d{2}):(\d{2}):(\d{2})Z$", k).try_cast("long")
    return F.datediff(whole.try_cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + part(2) * 3600 + part(3) * 60 + part(4)


def iso_text(seconds):
    """The inverse of iso_seconds."""
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    day, rest = F.floor(seconds / 86400), F.pmod(seconds, F.lit(86400))
    return F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest % 3600 / 60)), F.lit(":"), two(rest % 60), F.lit("Z"))


def scan_bars(spark: SparkSession, path: str) -> DataFrame:
    """symbol, t, open, high, low, close of CSV files with a header and these columns, among others (timestamp in ISO 8601 with Z).

    Fails on a malformed row, an empty input, a time that does not parse, a price that is not finite and above zero, a high below or a low
    above open or close, and on a repeated (symbol, timestamp): one aggregate over all rows and one by key before any row is given out.
    """
    raw = spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    missing = {f.split(" ")[0] for f in BAR.split(", ")} - set(raw.columns)
    if missing:
        raise ValueError(f"no column {sorted(missing)}")
    prices = ("open", "high", "low", "close")
    d = raw.select("symbol", iso_seconds(F.col("timestamp")).alias("t"), *[F.col(c).try_cast("double").alias(c) for c in prices])
    good = F.col("symbol").isNotNull() & F.col("t").isNotNull() & (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close"))
    for c in prices:
        good = good & (F.col(c) > 0) & (F.col(c) < float("inf"))
    n, bad = d.agg(F.count("*"), F.count_if(~F.coalesce(good, F.lit(False)))).first()
    if not n or bad:
        raise ValueError(f"{bad} of {n} bars are not valid")
    if d.groupBy("symbol", "t").count().filter("count > 1").limit(1).count():
        raise ValueError("repeated timestamp")
    return d


def scan_ledger(spark: SparkSession, path: str, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(series, known_at in seconds, observed, value) of CSV files, and rows by allowed series, those without any too.

    Fails on another series, a value that is not finite or a time without zone.
    """
    d = spark.read.schema(FACT).option("header", True).option("mode", "FAILFAST").csv(path)
    d = d.select("series", iso_seconds(F.col("known_at")).alias("known_at"), F.col("observation_date").alias("observed"), "value")
    good = F.col("series").isin(allowed) & F.col("known_at").isNotNull() & F.col("observed").isNotNull() & (F.abs("value") < float("inf"))
    bad = d.filter(~F.coalesce(good, F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"bad ledger row {bad[0].asDict()}")
    names = spark.createDataFrame([(s,) for s in allowed], "series string")
    return d, names.join(d.groupBy("series").agg(F.count("*").alias("n")), "series", "left").select("series", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def release_calendar(days: DataFrame, zone: str, first_year: int, last_year: int) -> DataFrame:
    """(family, known, known_at) of local release times (family, day: days since 1970, clock: seconds): the UTC day and second, daylight saving included,
    within a range of UTC years."""
    wall = F.timestamp_seconds(F.col("day") * 86400 + F.col("clock"))
    d = days.select("family", F.unix_seconds(F.to_utc_timestamp(wall, zone)).alias("known_at"))
    year = F.year(F.date_from_unix_date(F.floor(F.col("known_at") / 86400).cast("int")))
    return d.filter(year.between(first_year, last_year)).select("family", F.floor(F.col("known_at") / 86400).alias("known"), "known_at")


def scan_manifest(spark: SparkSession, path: str, key: str = "decision_timestamp") -> DataFrame:
    """t of JSON documents (one a line) {"rows": [{key: ISO time}]}. Fails if a row has any other key, so that no label can be read along."""
    rows = spark.read.text(path).select(F.explode(F.from_json("value", "rows array<map<string,string>>")["rows"]).alias("r"))
    d = rows.select(F.map_keys("r").alias("keys"), iso_seconds(F.col("r")[key]).alias("t"))
    bad = d.filter((F.size("keys") != 1) | (F.get("keys", F.lit(0)) != key) | F.col("t").isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"a manifest row holds {bad[0].keys}")
    return d.select("t")


def manifest_bars(manifest: DataFrame, bars: DataFrame, history: int, future: int, block: int | None = 7 * 86400) -> DataFrame:
    """Bars at the manifest's times exactly, with their place; only those with enough bars before and after them. Places are counted in blocks of t."""
    from ..operators.running import running

    d = running(bars, ["symbol"], ["t"], block, {"place": ("sum", F.lit(1)), "_n": ("total", F.lit(1))}).withColumn("place", F.col("place") - 1)
    return d.filter((F.col("place") >= history) & (F.col("_n") - 1 - F.col("place") >= future)).drop("_n").join(manifest.distinct(), "t")


def scan_grid(spark: SparkSession, path: str, columns: list[str], *, by: str, time: str, step: int, rows: int | None = None) -> DataFrame:
    """The named columns of a Parquet grid and no others. Fails on a missing one, on another number of rows, and where time does not go by the step.

    The step is checked without ordering a whole key: rows of a key are as many as its range of times holds steps, all on the step and distinct.
    """
    d = spark.read.parquet(path)
    if missing := [c for c in (by, time, *columns) if c not in d.columns]:
        raise ValueError(f"no column {missing}")
    d = d.select(by, time, *columns)
    lo = d.groupBy(by).agg(F.min(time).alias("lo"), F.max(time).alias("hi"), F.count("*").alias("n"))
    if rows is not None and d.count() != rows:
        raise ValueError("unexpected number of rows")
    uneven = lo.filter((F.col("hi") - F.col("lo")) != (F.col("n") - 1) * step).limit(1).count()
    off = d.join(lo.select(by, "lo"), by).filter((F.col(time) - F.col("lo")) % step != 0).limit(1).count()
    if uneven or off or d.groupBy(by, time).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{time} does not go by {step}")
    return d


def unsealed(df: DataFrame, day: str, sealed: list, allowed: DataFrame) -> DataFrame:
    """Rows of allowed days. Fails if a sealed day is among the allowed ones, which are looked at before any row of df is."""
    if sealed and allowed.filter(F.col(day).isin(sealed)).limit(1).count():
        raise ValueError("a sealed day may not be read")
    return df.join(allowed.select(day).distinct(), day, "left_semi")
