"""Verdicts: structural gates on pooled folds, the ladder from unavailable to promoted, and what placebos and a planted leak say of a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics, walk
from .running import numbered

#: The limits of the structural gates, costs in bps a round trip.
LIMITS = {
    "folds": 5, "positive_folds": 4, "mean_net": 1.0, "profit_factor": 1.25, "total_over_drawdown": 2.0, "trades": 100, "positive_hours": 0.55, "fold_floor": -2.0, "day_share": 0.5,
}
PRIMARY, STRESS = 8.0, 12.0


def pooled(trades: DataFrame, key: list[str], *, block: int | None = None) -> DataFrame:
    """A row a key of what the gates judge, pooled over folds: trades (key, t, fold, gross, side) at the primary and at the stress cost.

    Folds, days and hours are sums of their own; a day's share is the best day's of all positive days, 1 without one. Trades without gross
    do not count; a null fold is no fold.
    """
    d = trades.filter("gross is not null").withColumns({"net": F.col("gross") - PRIMARY, "day": F.floor(F.col("t") / 86400), "hour": F.floor(F.col("t") / 3600)})
    costs = d.sparkSession.createDataFrame([(PRIMARY,), (STRESS,)], "cost_bps double")
    e = metrics.full_economics(d, costs, key, block=block)
    one = e.filter(F.col("cost_bps") == PRIMARY).select(*key, "trades", "total", "profit_factor", "total_over_drawdown", (F.col("total") / F.col("trades")).alias("mean_net"))
    two = e.filter(F.col("cost_bps") == STRESS).select(*key, F.col("total").alias("stress_total"), (F.col("total") / F.col("trades")).alias("stress_mean"))
    folds = d.filter("fold is not null").groupBy(*key, "fold").agg(F.avg("net").alias("m")).groupBy(*key).agg(F.count("*").alias("folds"), F.count_if(F.col("m") > 0).alias("positive_folds"), F.min("m").alias("worst_fold"))
    hours = d.groupBy(*key, "hour").agg(F.sum("net").alias("s")).groupBy(*key).agg(F.avg((F.col("s") > 0).cast("double")).alias("positive_hours"))
    gain = F.greatest("s", F.lit(0.0))
    days = d.groupBy(*key, "day").agg(F.sum("net").alias("s")).groupBy(*key).agg(F.coalesce(F.max(gain) / F.when(F.sum(gain) > 0, F.sum(gain)), F.lit(1.0)).alias("day_share"))
    for other in (two, folds, hours, days):
        one = one.join(other, key, "left")
    return one.fillna({"folds": 0, "positive_folds": 0})


def structural(limits: dict[str, float] | None = None) -> dict[str, Column]:
    """The gates on a row of pooled(): all must hold; one without a value fails, but no losses are a profit factor above any limit."""
    x = LIMITS | (limits or {})
    c = F.col
    return {
        "all_folds": c("folds") == x["folds"], "positive_folds": c("positive_folds") >= x["positive_folds"], "mean_net": c("mean_net") >= x["mean_net"], "total": c("total") > 0,
        "profit_factor": F.coalesce(c("profit_factor"), F.lit(float("inf"))) >= x["profit_factor"], "total_over_drawdown": c("total_over_drawdown") >= x["total_over_drawdown"], "trades": c("trades") >= x["trades"],
        "positive_hours": c("positive_hours") >= x["positive_hours"], "stress_mean": c("stress_mean") > 0, "stress_total": c("stress_total") > 0, "fold_floor": c("worst_fold") >= x["fold_floor"],
        "day_share": c("day_share") <= x["day_share"],
    }


def judged(summary: DataFrame, key: list[str], gates: dict[str, Column]) -> DataFrame:
    """(key, gate, passed, all_passed): gates in long form, and whether all of a key's hold."""
    each = F.array(*[F.struct(F.lit(k).alias("gate"), F.coalesce(c, F.lit(False)).alias("passed")) for k, c in gates.items()])
    d = summary.select(*key, F.explode(each).alias("_g")).select(*key, "_g.*")
    return d.withColumn("all_passed", F.min(F.col("passed").cast("int")).over(Window.partitionBy(*key)) == 1)


def ladder(targets: DataFrame, required: int) -> DataFrame:
    """Adds status to targets (folds, signal, economic, cost): UNAVAILABLE without a scored fold, INCONCLUSIVE below the required number of folds, then
    PROMOTED if the economic gate holds too, PENDING_COST if a signal has no cost to be judged by, else REJECTED. Nulls in signal or economic are false; without a cost nothing is promoted."""
    signal, economic = F.coalesce("signal", F.lit(False)), F.coalesce("economic", F.lit(False))
    folds = F.coalesce("folds", F.lit(0))
    status = (
        F.when(folds == 0, "UNAVAILABLE").when(folds < required, "INCONCLUSIVE").when(signal & F.col("cost").isNull(), "PENDING_COST").when(signal & economic, "PROMOTED").otherwise("REJECTED")
    )
    return targets.withColumn("status", status)


def decision(statuses: DataFrame) -> DataFrame:
    """One row on all targets: their number by status, promotion and decision.

    PASS if all scored ones are promoted, PARTIAL_PASS if some are; else PENDING_COST_MODEL if one waits for its cost; else FAIL if any was scored and none
    was inconclusive, PARTIAL_INCONCLUSIVE if both; else INCONCLUSIVE.
    """
    n = {s: F.count_if(F.col("status") == s).alias(s.lower()) for s in ("UNAVAILABLE", "INCONCLUSIVE", "PENDING_COST", "PROMOTED", "REJECTED")}
    d = statuses.agg(*n.values())
    scored = F.col("pending_cost") + F.col("promoted") + F.col("rejected")
    cases = [
        ((F.col("promoted") > 0) & (F.col("promoted") == scored), "PASS", "PROMOTE_TARGETS"), (F.col("promoted") > 0, "PARTIAL_PASS", "PROMOTE_TARGETS"),
        (F.col("pending_cost") > 0, "PENDING_COST_MODEL", "SIGNALS_NEED_COSTS"), ((scored > 0) & (F.col("inconclusive") > 0), "PARTIAL_INCONCLUSIVE", "NO_DECISION"),
        (scored > 0, "FAIL", "REJECT"), (F.lit(True), "INCONCLUSIVE", "REPAIR_FEASIBILITY"),
    ]
    pick = lambda k: F.coalesce(*[F.when(c[0], F.lit(c[k])) for c in cases])
    return d.withColumns({"promotion": pick(1), "decision": pick(2)})


def controls(d: DataFrame, key: list[str], order: str, column: str, back: int, ahead: int, seed: int, block: int | None = None) -> DataFrame:
    """Placebos and a leak of a column: permuted within key (by a hash of seed and order), flipped, lagged, and taken from the future.

    Places in both orders are counted in blocks (of `order`, and of the hash), and met by equality: a hot key is many tasks' work. order must be unique within a key.
    """
    a = numbered(d, key, [order], block, "_k")
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col(order).cast("string")).cast("binary"))
    by_hash = d.select(*key, F.col(column).alias("permuted"), h.alias("_h"))
    b = numbered(by_hash, key, ["_h"], None if block is None else F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"), "_k").drop("_h")
    at = lambda name, shift: a.select(*key, (F.col("_k") + shift).alias("_k"), F.col(column).alias(name))
    out = a.join(b, [*key, "_k"]).join(at("lagged", back), [*key, "_k"], "left").join(at("leaked", -ahead), [*key, "_k"], "left").drop("_k")
    return out.withColumn("flipped", -F.col(column)).select(*d.columns, "permuted", "flipped", "lagged", "leaked")


KINDS = ("primary", "permuted", "flipped", "lagged", "leaked")
PLACEBOS = ("permuted", "flipped", "lagged")


def diagnostics(rows: DataFrame, features: list[str], external: str, target: str, label: str, cut: int, *, alpha: float = 5e-4, l1: float = 0.25) -> DataFrame:
    """(kind, n, auc, gain, mean_net): what a model on features and one external column is worth after the cut, and with that column
    permuted, flipped after training, lagged, or joined by a leak from the future.

    rows: controls() of external, with t, features, target (a return in bps; its label tells 1 from 0). One elastic net a kind is fitted on the rows before the cut, all from the same pass;
    the flipped kind keeps the primary model. gain: AUC less the primary one's; mean_net: mean of target in the direction that is predicted. Rows with a null go from the kind they are null in.
    """
    value = {"primary": F.col(external), "permuted": F.col("permuted"), "flipped": F.when(F.col("t") < cut, F.col(external)).otherwise(F.col("flipped")), "lagged": F.col("lagged"), "leaked": F.col(external)}
    each = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("double").alias("_x"), (F.col("leaked") if k == "leaked" else F.lit(0.0)).cast("double").alias("_leak")) for k, v in value.items()])
    d = rows.withColumn("_e", F.explode(each)).select("t", *features, F.col(target).alias("_y"), F.col(label).alias("y"), "_e.*").dropna()
    scored, _ = walk.elastic_net(d.filter(F.col("t") < cut), d.filter(F.col("t") >= cut), [*features, "_x", "_leak"], "_y", ["kind"], alpha, l1)
    auc = metrics.roc_auc(scored.withColumn("p", F.col("prediction")), ["kind"]).select("kind", "auc")
    out = scored.groupBy("kind").agg(F.count("*").alias("n"), F.avg(F.signum("prediction") * F.col("_y")).alias("mean_net")).join(auc, "kind", "left")
    base = F.max(F.when(F.col("kind") == "primary", F.col("auc"))).over(Window.partitionBy())  # five rows
    return out.withColumn("gain", F.col("auc") - base)


def suite(found: DataFrame, passes: Column, least: float = 0.02) -> DataFrame:
    """One row: whether the leak gains at least so much AUC, whether each placebo fails what the primary must pass, and both verdicts. What is missing fails."""
    d = found.withColumn("_p", F.coalesce(passes, F.lit(False)))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, c))
    row = d.agg(
        F.coalesce(of("leaked", F.col("gain")) >= least, F.lit(False)).alias("leak_is_seen"), *[F.coalesce(~of(k, F.col("_p")), F.lit(False)).alias(f"{k}_fails") for k in PLACEBOS],
        F.coalesce(of("primary", F.col("_p")), F.lit(False)).alias("primary_passes"),
    )
    whole = F.col("leak_is_seen")
    for k in PLACEBOS:
        whole = whole & F.col(f"{k}_fails")
    return row.withColumn("suite_passes", whole).withColumn("final", F.col("suite_passes") & F.col("primary_passes"))
