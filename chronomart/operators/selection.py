"""Folds, pooled figures, choice of configurations, action scoring, controls and promotion gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import finite
from .running import running


def pool_folds(trades: DataFrame, by: list[str], folds: DataFrame) -> DataFrame:
    """Results pooled over all folds of a small list: total, trades, folds without trades, positive folds, largest share of gains in one fold (1 without gains)."""
    per = trades.groupBy(*by, "fold").agg(F.sum("net").alias("_net"), F.count("*").alias("_n"))
    whole = trades.select(*by).distinct().crossJoin(F.broadcast(folds)).join(per, [*by, "fold"], "left")
    gain = F.sum(F.when(F.col("_net") > 0, F.col("_net")))
    return whole.groupBy(*by).agg(
        F.sum("_net").alias("total"), F.sum("_n").alias("trades"), F.count_if(F.col("_n").isNull()).alias("missing_folds"), F.count_if(F.col("_net") > 0).alias("positive_folds"),
        F.coalesce(F.max(F.when(F.col("_net") > 0, F.col("_net"))) / gain, F.lit(1.0)).alias("largest_share"),
    )


def pooled_increment(d: DataFrame, target: str) -> DataFrame:
    """R2 of predictions base and cross of y, with errors and totals summed over targets, and the increment."""
    per = d.groupBy(target).agg(F.sum((F.col("y") - F.col("base")) ** 2).alias("b"), F.sum((F.col("y") - F.col("cross")) ** 2).alias("c"), (F.var_pop("y") * F.count("y")).alias("t"))
    s = per.agg(F.count("*").alias("targets"), *[F.sum(c).alias(c) for c in "bct"])
    r2 = lambda c: 1 - F.col(c) / F.when(F.col("t") > 0, F.col("t"))
    return s.select("targets", r2("b").alias("base_r2"), r2("c").alias("cross_r2"), (r2("c") - r2("b")).alias("increment"))


def first_of_near_best(configs: DataFrame, key: list[str], order: list[str], score: str, tie: str, tolerance: float = 0.01) -> DataFrame:
    """The configuration that a scan in `order` ends with: a later one wins by a score higher by more than `tolerance` (relative), or,
    within it, by a higher tie value. This is no total order, so the list (one row a configuration) is folded in order."""
    item = F.struct(*order, F.col(score).alias("_s"), F.col(tie).alias("_t"))
    packed = configs.groupBy(*key).agg(F.sort_array(F.collect_list(item)).alias("_a"))

    def better(best: Column, x: Column) -> Column:
        scale = F.greatest(F.abs(x["_s"]), F.abs(best["_s"]), F.lit(1e-12))
        apart = F.abs(x["_s"] - best["_s"]) / scale > tolerance
        return F.when(F.when(apart, x["_s"] > best["_s"]).otherwise(x["_t"] > best["_t"]), x).otherwise(best)

    best = F.aggregate(F.slice("_a", 2, F.greatest(F.size("_a") - 1, F.lit(0))), F.get("_a", F.lit(0)), better)
    return packed.withColumn("_b", best).select(*key, *[F.col(f"_b.{c}").alias(c) for c in order], F.col("_b._s").alias(score), F.col("_b._t").alias(tie))


def expanding_folds(rows: DataFrame, key: str, order: str, label_end: str, folds: int, block: int | None = None) -> DataFrame:
    """Contiguous folds by row count (bounds rounded half to even): rows, first and last time, and earlier rows whose label ends before the fold begins.

    A row counts for each fold that begins after the later of its time and its label's end, so it is put once, under the first such fold, and folds are summed up."""
    d = running(rows, [key], [order], block, {"_n": ("total", F.lit(1)), "_p": ("sum", F.lit(1))}).withColumn("_p", F.col("_p") - 1)
    fold = F.lit(0)
    for k in range(1, folds):
        fold = fold + (F.col("_p") >= F.bround(F.col("_n") * k / folds)).cast("int")
    d = d.withColumn("fold", fold)
    f = d.groupBy(key, "fold").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    free = d.filter(F.col(order).isNotNull() & F.col(label_end).isNotNull()).groupBy(key, F.greatest(order, label_end).alias("_free")).agg(F.count("*").alias("_c"))
    # a fold's start comes before what becomes free at that very time
    both = free.select(key, F.col("_free").alias("_at"), F.lit(1).alias("_s"), "_c").unionByName(f.select(key, "fold", "last", "n", F.col("first").alias("_at"), F.lit(0).alias("_s")), allowMissingColumns=True)
    done = running(both, [key], ["_at", "_s", "fold"], block, {"train": ("sum", F.col("_c"))}).filter("_s = 0")
    return done.select(key, "fold", F.col("_at").alias("first"), "last", "n", F.coalesce("train", F.lit(0)).cast("long").alias("train"))


def halves(rows: DataFrame, key: list[str], order: str, label_end: str, block: int | None = None) -> DataFrame:
    """Adds part: first half of a key's rows 'calibration' (its rows whose label crosses the second half's start: null), second half 'selection'."""
    d = running(rows, key, [order], block, {"_n": ("total", F.lit(1)), "_p": ("sum", F.lit(1))})
    late = F.col("_p") - 1 >= F.floor(F.col("_n") / 2)
    # just one row of a key starts its second half
    d = running(d, key, [order], block, {"_start": ("total", F.when(F.col("_p") - 1 == F.floor(F.col("_n") / 2), F.col(order)))})
    return d.withColumn("part", F.when(late, "selection").when(F.col(label_end) < F.col("_start"), "calibration")).drop("_n", "_p", "_start")


def probabilistic_action(p_long: Column, p_short: Column, u_long: Column, u_short: Column, least: float) -> Column:
    """A side needs its probability and a utility above zero; of two, the higher utility; equal utilities abstain. 1, -1 or 0. What is null or not finite abstains."""
    p_long, p_short, u_long, u_short = (finite(c) for c in (p_long, p_short, u_long, u_short))
    l, s = (p_long >= least) & (u_long > 0), (p_short >= least) & (u_short > 0)  # noqa: E741
    return F.when(l & s, F.when(u_long > u_short, 1).when(u_short > u_long, -1).otherwise(0)).when(l, 1).when(s, -1).otherwise(0)


def expected_value_side(p_long: Column, p_short: Column, ev_long: Column, ev_short: Column, least: float = 0.55) -> Column:
    """A side trades at its probability with an expected value above zero; of two, the higher value, SHORT on ties. What is null or not finite does not trade."""
    p_long, p_short, ev_long, ev_short = (finite(c) for c in (p_long, p_short, ev_long, ev_short))
    l, s = (p_long >= least) & (ev_long > 0), (p_short >= least) & (ev_short > 0)  # noqa: E741
    return F.when(l & s, F.when(ev_long > ev_short, "LONG").otherwise("SHORT")).when(l, "LONG").when(s, "SHORT").otherwise("NO_TRADE")


def promotion(summary: DataFrame, key: list[str], gates: dict[str, Column], least_n: int) -> DataFrame:
    """Gates in long form (gate, passed) with the verdict of their key: UNAVAILABLE below least_n rows, PROMOTE if all pass, INCONCLUSIVE if more
    than half do, else REJECT. A gate without value fails."""
    d = summary.select(*key, "n", F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), F.coalesce(c, F.lit(False)).alias("passed")) for k, c in gates.items()])).alias("g")).select(*key, "n", "g.*")
    w = Window.partitionBy(*key)
    share = F.avg(F.col("passed").cast("double")).over(w)
    return d.withColumn("verdict", F.when(F.col("n") < least_n, "UNAVAILABLE").when(share == 1, "PROMOTE").when(share > 0.5, "INCONCLUSIVE").otherwise("REJECT")).drop("n")


def ridge(d: DataFrame, features: list[str], y: str, alphas: list[float]) -> DataFrame:
    """(alpha, feature, weight, intercept) of ridge regressions on features scaled by their population deviation; a constant feature weighs 0.

    Spark sums one Gram matrix for all alphas; the driver solves systems as large as the number of features squared.
    """
    import numpy as np

    from .metrics import gram

    k = len(features)
    g = np.zeros((k + 2, k + 2))
    for r in gram(d, features, y).collect():
        g[r.i, r.j] = g[r.j, r.i] = r.s or 0.0
    n, out = g[0, 0], []
    if n:
        mean = g[0, 1:] / n
        cov = g[1:, 1:] / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov)[:k], 0))
        scale = np.where(sd > 0, sd, 1.0)
        a, b = n * cov[:k, :k] / np.outer(scale, scale), n * cov[:k, k] / scale
        for alpha in alphas:
            w = np.where(sd > 0, np.linalg.solve(a + alpha * np.eye(k), b), 0.0)
            out += [(float(alpha), f, float(x), float(mean[k])) for f, x in zip(features, w, strict=True)]
    return d.sparkSession.createDataFrame(out, "alpha double, feature string, weight double, intercept double")
