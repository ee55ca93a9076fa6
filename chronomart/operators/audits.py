"""Audits: event files, alignment of peers, ledgers, ages of sources, manifests, continuity of a book's sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running


def event_audit(events: DataFrame, keys: list[str], order: list[str], *, time: str, checks: dict[str, Column], snapshot: Column) -> DataFrame:
    """By file (keys): rows, those whose time regresses, those that fail each check (null fails), snapshots, rows before the first one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    seen = F.max(F.coalesce(snapshot, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = events.withColumns({"_back": F.coalesce(F.col(time) < F.lag(time).over(w), F.lit(False)), "_early": seen == 0})
    bad = [F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()]
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("_back").alias("bad_order"), *bad, F.count_if(snapshot).alias("snapshots"), F.count_if("_early").alias("before_snapshot"))


def alignment(joined: DataFrame, by: list[str], *, on: str, max_age: int) -> DataFrame:
    """Of an as-of join without limit of age: rows, rows with a partner, complete ones, stale or missing ones, and partners from the future."""
    age = F.col(on) - F.col("asof_t")
    complete = F.coalesce(age <= max_age, F.lit(False))
    return joined.groupBy(*by).agg(
        F.count("*").alias("n"), F.count("asof_t").alias("available"), F.count_if(complete).alias("complete"), F.count_if(~complete).alias("stale_or_missing"), F.count_if(age < 0).alias("future")
    )


def age_histogram(joined: DataFrame, by: list[str], *, on: str, unit: int) -> DataFrame:
    """Rows by whole units of age of their partner."""
    age = F.floor((F.col(on) - F.col("asof_t")) / unit).cast("long")
    return joined.filter("asof_t is not null").groupBy(*by, age.alias("age")).agg(F.count("*").alias("n"))


def known_state(questions: DataFrame, ledger: DataFrame) -> DataFrame:
    """By day asked (a small list) and series: how many observations are known, the latest one and the latest time of knowing; series of which none is known are absent.

    An observation counts from its first known day on, so running sums over the ledger's days answer all questions without a range join.
    """
    first = ledger.groupBy("series", "observed").agg(F.min("known").alias("at")).groupBy("series", "at").agg(F.count("observed").alias("_n"), F.max("observed").alias("_obs"))
    facts = first.unionByName(ledger.groupBy("series", F.col("known").alias("at")).agg(F.max("known").alias("_known")), allowMissingColumns=True).withColumn("_q", F.lit(0))
    asked = ledger.select("series").distinct().crossJoin(questions.distinct()).select("series", F.col("day").alias("at"), F.lit(1).alias("_q"))
    both = facts.filter("at is not null").unionByName(asked, allowMissingColumns=True)
    d = running(both, ["series"], ["at", "_q"], None, {"observations": ("sum", F.col("_n")), "latest_observed": ("max", F.col("_obs")), "latest_known": ("max", F.col("_known"))})
    return d.filter("_q = 1 and latest_known is not null").select(F.col("at").alias("day"), "series", F.coalesce("observations", F.lit(0)).alias("observations"), "latest_observed", "latest_known")


def age_profile(joined: DataFrame, by: list[str], *, on: str, unit: int, quantiles: tuple[float, ...] = (0.01, 0.05, 0.5, 0.95, 0.99)) -> DataFrame:
    """Count, extremes, mean and interpolated quantiles of a source's age in whole units, and the share of rows that have a partner.

    Whole units keep the number of distinct ages bounded by the greatest age, so the exact quantiles need bounded memory a group.
    """
    age = F.floor((F.col(on) - F.col("asof_t")) / unit).cast("double")
    d = joined.select(*by, age.alias("age"))
    q = [F.percentile("age", F.lit(x)).alias(f"p{round(100 * x):02d}") for x in quantiles]
    return d.groupBy(*by).agg(F.count("age").alias("n"), F.min("age").alias("least"), F.max("age").alias("most"), F.avg("age").alias("mean"), *q, F.avg(F.col("age").isNotNull().cast("double")).alias("valid"))


def coverage_ratio(rows: DataFrame, by: list[str], source: str, base: int, other: int) -> DataFrame:
    """Rows of two sources by group and the ratio other : base (null without base rows)."""
    n = lambda k: F.count_if(F.col(source) == k)
    return rows.groupBy(*by).agg(n(base).alias("base_rows"), n(other).alias("other_rows")).withColumn("ratio", F.col("other_rows") / F.when(F.col("base_rows") > 0, F.col("base_rows")))


def verify_manifest(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Each key of either side (columns n, checksum) with its status: missing, extra, rows, content or ok. A key that repeats on a side fails."""
    for side in (expected, actual):
        if side.groupBy(*key).count().filter("count > 1").limit(1).count():
            raise ValueError("keys repeat")
    e, a = expected.select(*key, F.struct("n", "checksum").alias("e")), actual.select(*key, F.struct("n", "checksum").alias("a"))
    status = (
        F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("e.n") != F.col("a.n"), "rows")
        .when(F.col("e.checksum") != F.col("a.checksum"), "content").otherwise("ok")
    )
    return e.join(a, key, "full").select(*key, status.alias("status"))


def sequence_state(events: DataFrame, block: int | None = 65_536) -> DataFrame:
    """Continuity of a depth feed. events: symbol, pos, first, last, previous (ids), snapshot_id (of snapshots, else null).

    After a snapshot, updates that end before its id are stale. The first other one must span the id (it bridges); each later one's
    previous id must equal the id that the one before ended with. From the first failure on all is invalid until the next
    snapshot; so is all before the first snapshot. Adds segment (number of the snapshot) and state: snapshot, stale, bridge, valid, gap or invalid.
    """
    d = running(events, ["symbol"], ["pos"], block, {"segment": ("sum", F.col("snapshot_id").isNotNull().cast("long")), "_id": ("last", F.col("snapshot_id"))})
    live = F.col("snapshot_id").isNull() & (F.col("last") >= F.col("_id"))
    d = d.withColumn("_live", F.coalesce(live, F.lit(False)))
    own = Window.partitionBy("symbol", "segment", "_live").orderBy("pos")
    first = F.row_number().over(own) == 1
    ok = F.when(first, F.col("first") <= F.col("_id")).otherwise(F.col("previous") == F.lag("last").over(own))
    d = d.withColumns({"_first": first, "_ok": F.when(F.col("_live"), F.coalesce(ok, F.lit(False)).cast("int"))})
    so_far = Window.partitionBy("symbol", "segment").orderBy("pos")
    fine = lambda hi: F.coalesce(F.min("_ok").over(so_far.rowsBetween(Window.unboundedPreceding, hi)), F.lit(1)) == 1
    state = (
        F.when(F.col("snapshot_id").isNotNull(), "snapshot").when(F.col("segment") == 0, "invalid").when(~F.col("_live"), F.when(fine(0), "stale").otherwise("invalid"))
        .when(fine(0), F.when(F.col("_first"), "bridge").otherwise("valid")).when(fine(-1), "gap").otherwise("invalid")
    )
    return d.withColumn("state", state).drop("_id", "_live", "_first", "_ok")
