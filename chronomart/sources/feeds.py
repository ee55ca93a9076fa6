"""Reference data and feeds: symbol maps, vintages and release times, column aliases, five-level books, result sinks, sealed days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_symbol(symbol: Column, names: dict[str, str]) -> Column:
    """The provider's name of a symbol by upper case without outer spaces; one that is not mapped passes unchanged."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.upper(F.trim(symbol))), symbol)


def vintages(raw: DataFrame, first_day: int, last_day: int) -> DataFrame:
    """Distinct (series, known, observed, value) of text values: empty ones, '.' and such as are no number go, and vintages outside the days."""
    d = raw.withColumn("value", F.expr("try_cast(nullif(trim(value), '.') as double)")).filter("value is not null")
    return d.filter(F.col("known").between(first_day, last_day)).select("series", "known", "observed", "value").distinct()


def release_times(vintage: DataFrame, families: dict[str, str], calendar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vintages with the official release time of their family and day, and by series the number of those without one, which are left out.

    calendar: family, known, known_at; its size is that of a list of release days, so it is left to the optimizer whether to broadcast it.
    """
    family = F.try_element_at(F.create_map(*[F.lit(x) for pair in families.items() for x in pair]), F.col("series"))
    d = vintage.withColumn("family", family)
    hit = d.join(calendar, ["family", "known"]).select("series", "known_at", "observed", "value").distinct()
    return hit, d.join(calendar, ["family", "known"], "left_anti").groupBy("series").agg(F.count("*").alias("excluded"))


def with_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns found by the first of their names that df has, in any case; a missing one fails."""
    have = {c.lower(): c for c in df.columns}
    out = []
    for name, options in aliases.items():
        found = [have[o.lower()] for o in options if o.lower() in have]
        if not found:
            raise ValueError(f"no column for {name}")
        out.append(F.col(found[0]).alias(name))
    return df.select(*out)


def flag(c: Column) -> Column:
    """A boolean from true, 1, t and false, 0, f in any case; anything else fails."""
    x = F.lower(F.trim(c.cast("string")))
    return F.when(x.isin("true", "1", "t"), True).when(x.isin("false", "0", "f"), False).otherwise(F.raise_error(F.lit("no boolean")).cast("boolean"))


def five_levels(books: DataFrame, levels: int = 5, *, last_of_time: bool = True) -> DataFrame:
    """Snapshots (symbol, us, pos, asks, bids: arrays of price and amount): the last of equal times, validity, mid, spread, imbalance at 1 and all levels.

    last_of_time: False gives every snapshot a row, those of equal times too, and takes no pos.

    Valid: all values finite and above zero, asks rise, bids fall, the best bid below the best ask. Figures of others are null.
    """
    d = books
    if last_of_time:
        last = Window.partitionBy("symbol", "us").orderBy(F.desc("pos"))
        d = d.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")
    p = lambda s, k: F.get(s, F.lit(k))["price"]
    good = lambda s: (F.size(s) == levels) & F.forall(s, lambda x: (x["price"] > 0) & (x["amount"] > 0) & (x["price"] < float("inf")) & (x["amount"] < float("inf")))
    ok = good("asks") & good("bids") & (p("bids", 0) < p("asks", 0))
    for k in range(1, levels):
        ok = ok & (p("asks", k) > p("asks", k - 1)) & (p("bids", k) < p("bids", k - 1))
    d = d.withColumn("valid", F.coalesce(ok, F.lit(False)))
    total = lambda s, n: F.aggregate(F.slice(s, 1, n), F.lit(0.0), lambda a, x: a + x["amount"])
    mid = (p("bids", 0) + p("asks", 0)) / 2
    imb = lambda n: (total("bids", n) - total("asks", n)) / (total("bids", n) + total("asks", n))
    only = lambda c: F.when(F.col("valid"), c)
    return d.select("symbol", "us", "valid", only(mid).alias("mid"), only((p("asks", 0) - p("bids", 0)) / mid * 1e4).alias("spread_bps"), only(imb(1)).alias("imbalance1"), only(imb(levels)).alias("imbalance5"))


def write_results(d: DataFrame, path: str, by: list[str], *, kind: str = "json", mode: str = "errorifexists") -> None:
    """Rows as compressed JSON lines or CSV in a folder a group; structs become columns named struct_field, infinities text."""
    flat: list[Column] = []
    for f in d.schema.fields:
        if f.dataType.typeName() == "struct" and kind == "csv":
            flat += [F.col(f"{f.name}.{g}").alias(f"{f.name}_{g}") for g in f.dataType.names]
        elif f.dataType.typeName() == "double":
            text = F.when(F.col(f.name) == float("inf"), "inf").when(F.col(f.name) == float("-inf"), "-inf").otherwise(F.col(f.name).cast("string"))
            flat.append(text.alias(f.name))
        else:
            flat.append(F.col(f.name))
    writer = d.select(*flat).write.mode(mode).partitionBy(*by).option("compression", "gzip")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def require_unsealed(days: list[str], sealed: list[str], allowed: list[str]) -> list[str]:
    """The days to read, if none names a sealed ISO date and all are allowed; checked before any file is opened."""
    for day in days:
        if any(s in day for s in sealed) or day not in allowed:
            raise ValueError(f"{day} may not be read")
    return days
