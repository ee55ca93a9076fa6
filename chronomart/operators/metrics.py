"""Evaluation: signal and trade metrics, drawdowns, ranks, calibration, choices and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import cells, running


def trade_metrics(trades: DataFrame, by: list[str]) -> DataFrame:
    """trades, win_rate, profit_factor (inf without losses, 0 without both), expectancy and compounded return of net (bps)."""
    gain, loss = F.coalesce(F.sum(F.when(F.col("net") > 0, F.col("net"))), F.lit(0.0)), F.coalesce(-F.sum(F.when(F.col("net") < 0, F.col("net"))), F.lit(0.0))
    d = trades.groupBy(*by).agg(
        F.count("*").alias("trades"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"), F.avg("net").alias("expectancy"),
        gain.alias("gain"), loss.alias("loss"), ((F.exp(F.sum(F.log1p(F.col("net") / 1e4))) - 1) * 100).alias("compounded_pct"),
        F.sum("net").alias("sum_net"), F.sum(F.col("net") * F.col("net")).alias("sum_sq"),
    )
    factor = F.when(F.col("loss") > 0, F.col("gain") / F.when(F.col("loss") > 0, F.col("loss"))).when(F.col("gain") > 0, F.lit(float("inf"))).otherwise(0.0)
    return d.withColumn("profit_factor", factor)


def rich_metrics(trades: DataFrame, by: list[str]) -> DataFrame:
    """Sharpe (sample deviation), Sortino (sample deviation of losses), average win and loss, and sums that folds can merge."""
    win, loss = F.when(F.col("net") > 0, F.col("net")), F.when(F.col("net") < 0, F.col("net"))
    d = trades.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("net").alias("mean"), F.stddev_samp("net").alias("_sd"), F.stddev_samp(loss).alias("_dd"),
        F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"), F.sum("net").alias("total"), F.sum(F.col("net") ** 2).alias("total_sq"),
    )
    ratio = lambda c: F.when(F.col(c) > 0, F.col("mean") / F.when(F.col(c) > 0, F.col(c)))
    return d.withColumns({"sharpe": ratio("_sd"), "sortino": ratio("_dd")}).drop("_sd", "_dd")


def drawdowns(trades: DataFrame, key: str, order: list[str], block: int | None = None) -> DataFrame:
    """Three drawdowns of net (bps): compounded percent from the running peak; additive against the peak of earlier equity only (from 0); additive with the current point.

    `block`, here and below, deals a hot key over tasks by stretches of the order."""
    d = running(trades, [key], order, block, {"_eq": ("sum", F.col("net")), "_lg": ("sum", F.log1p(F.col("net") / 1e4))})
    d = running(d, [key], order, block, {"_plg": ("max", F.col("_lg")), "_before": ("max_before", F.col("_eq")), "_peak": ("max", F.col("_eq"))})
    peak_lg, earlier, current = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)) for c in ("_plg", "_before", "_peak"))
    d = d.withColumns({"_c": (1 - F.exp(F.col("_lg") - peak_lg)) * 100, "_a": earlier - F.col("_eq"), "_i": current - F.col("_eq")})
    return d.groupBy(key).agg(F.max("_c").alias("compounded_dd"), F.max("_a").alias("earlier_peak_dd"), F.max("_i").alias("additive_dd"))


def equity_series(trades: DataFrame, key: str, order: list[str], block: int | None = None) -> DataFrame:
    """Running hit rate and compounded return."""
    net = F.col("net")
    d = running(trades, [key], order, block, {"_n": ("sum", net.isNotNull().cast("long")), "_hits": ("sum", (net > 0).cast("long")), "_lg": ("sum", F.log1p(net / 1e4))})
    return d.withColumns({"hit_rate": F.col("_hits") / F.when(F.col("_n") > 0, F.col("_n")), "equity_pct": (F.exp("_lg") - 1) * 100}).drop("_n", "_hits", "_lg")


def economics(trades: DataFrame, costs: DataFrame, by: list[str]) -> DataFrame:
    """Net totals by cost level (costs: a small frame of cost_bps): trades, total, worst, share positive, longs and shorts."""
    d = trades.crossJoin(F.broadcast(costs)).withColumn("net", F.col("gross") - F.col("cost_bps"))
    return d.groupBy(*by, "cost_bps").agg(
        F.count("*").alias("trades"), F.sum("net").alias("total"), F.min("net").alias("worst"), F.avg((F.col("net") > 0).cast("double")).alias("positive"),
        F.count_if(F.col("side") == "LONG").alias("longs"), F.count_if(F.col("side") == "SHORT").alias("shorts"),
    )


def full_economics(trades: DataFrame, costs: DataFrame, by: list[str], order: str = "t", block: int | None = None) -> DataFrame:
    """economics with profit factor (null without losses), additive drawdown from the running peak (from 0) and total over drawdown (without one: infinite for a gain, else 0)."""
    d = trades.crossJoin(F.broadcast(costs)).withColumn("net", F.col("gross") - F.col("cost_bps"))
    d = running(d, [*by, "cost_bps"], [order], block, {"_eq": ("sum", F.col("net"))})
    d = running(d, [*by, "cost_bps"], [order], block, {"_peak": ("max", F.col("_eq"))}).withColumn("_dd", F.greatest("_peak", F.lit(0.0)) - F.col("_eq"))
    loss = -F.sum(F.when(F.col("net") < 0, F.col("net")).otherwise(0.0))
    out = d.groupBy(*by, "cost_bps").agg(
        F.count("*").alias("trades"), F.sum("net").alias("total"), (F.sum(F.when(F.col("net") > 0, F.col("net")).otherwise(0.0)) / F.when(loss > 0, loss)).alias("profit_factor"), F.max("_dd").alias("drawdown"),
        F.min("net").alias("worst"), F.count_if(F.col("side") == "LONG").alias("longs"), F.count_if(F.col("side") == "SHORT").alias("shorts"),
    )
    ratio = F.when(F.col("drawdown") > 0, F.col("total") / F.when(F.col("drawdown") > 0, F.col("drawdown"))).when(F.col("total") > 0, F.lit(float("inf"))).otherwise(0.0)
    return out.withColumn("total_over_drawdown", ratio)


def daily_statistics(trades: DataFrame, key: str, first_day: int, last_day: int) -> DataFrame:
    """Over every calendar day of the window, idle ones too: trades a day, active days, share of positive active days, median and mean net, worst five days in a row."""
    days = trades.select(key).distinct().withColumn("day", F.explode(F.sequence(F.lit(first_day).cast("long"), F.lit(last_day).cast("long"))))
    sums = trades.groupBy(key, "day").agg(F.count("*").alias("_n"), F.sum("net").alias("_net"))
    d = days.join(sums, [key, "day"], "left").withColumns({"n": F.coalesce("_n", F.lit(0)), "net": F.coalesce("_net", F.lit(0.0))})
    five = Window.partitionBy(key).orderBy("day").rowsBetween(-4, 0)
    d = d.withColumn("five", F.when(F.count("*").over(five) == 5, F.sum("net").over(five)))
    active = F.col("n") > 0
    return d.groupBy(key).agg(
        F.count("*").alias("days"), F.avg("n").alias("trades_a_day"), F.count_if(active).alias("active_days"), F.percentile(F.when(active, F.col("n")), F.lit(0.5)).alias("median_active"),
        F.avg(F.when(active, (F.col("net") > 0).cast("double"))).alias("positive_share"), F.percentile("net", F.lit(0.5)).alias("median_net"),
        F.avg("net").alias("mean_net"), F.coalesce(F.min("five"), F.sum("net")).alias("worst_five"),
    )


def regression_quality(d: DataFrame, by: list[str]) -> DataFrame:
    """R2, MSE, MAE, RMSE, Pearson and sign accuracy of pred against y."""
    e = F.col("y") - F.col("pred")
    out = d.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop("y").alias("_v"), F.corr("y", "pred").alias("pearson"),
        F.avg((F.signum("y") == F.signum("pred")).cast("double")).alias("sign_accuracy"),
    )
    return out.withColumns({"rmse": F.sqrt("mse"), "r2": F.when(F.col("_v") > 0, 1 - F.col("mse") / F.when(F.col("_v") > 0, F.col("_v")))}).drop("_v")


def counted_below(counts: DataFrame, by: list[str], value: str, below: dict[str, str]) -> DataFrame:
    """counts has one row for each value of a key: adds below[c], the sum of column c over the key's values up to and with this one."""
    return running(counts, by, [value], cells(F.col(value)), {out: ("sum", F.col(c)) for c, out in below.items()})


def mid_ranks(d: DataFrame, by: list[str], values: dict[str, str]) -> DataFrame:
    """Adds values[c], the rank of c within a key, ties sharing their mean. Counts of distinct values are summed up in blocks of values, so no task ranks a whole key.

    Column _weight, where there is one, counts a row as so many. Rows with a null value get a null rank."""
    weight = F.col("_weight") if "_weight" in d.columns else F.lit(1)
    for c, out in values.items():
        n = d.filter(F.col(c).isNotNull()).groupBy(*by, c).agg(F.sum(weight).alias("_n"))
        r = counted_below(n, by, c, {"_n": "_upto"}).select(*by, c, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))
        d = d.join(r, [*by, c], "left")
    return d


def spearman(d: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation with mean ranks for ties; null below 3 rows or where a side is constant. Equal pairs are counted first, so no frequent value is one task's."""
    pairs = d.groupBy(*by, x, y).agg(F.count("*").alias("_weight"))
    r = mid_ranks(pairs, by, {x: "_x", y: "_y"})
    both, n = F.when(F.col("_x").isNotNull() & F.col("_y").isNotNull(), F.col("_weight")), F.sum("_weight")
    mean = r.groupBy(*by).agg((F.sum(both * F.col("_x")) / F.sum(both)).alias("_ax"), (F.sum(both * F.col("_y")) / F.sum(both)).alias("_ay"))
    # centred before squaring: ranks are large numbers
    dx, dy = F.col("_x") - F.col("_ax"), F.col("_y") - F.col("_ay")
    r = r.join(mean.select(*by, "_ax", "_ay"), by).groupBy(*by).agg(n.alias("n"), F.sum(both * dx * dx).alias("_vx"), F.sum(both * dy * dy).alias("_vy"), F.sum(both * dx * dy).alias("_c"))
    r = r.withColumn("_c", F.col("_c") / F.when((F.col("_vx") > 0) & (F.col("_vy") > 0), F.sqrt(F.col("_vx")) * F.sqrt(F.col("_vy"))))
    return r.withColumn("spearman", F.when((F.col("n") >= 3) & (F.col("_vx") > 0) & (F.col("_vy") > 0), F.col("_c"))).drop("_c", "_vx", "_vy")


def calibration(d: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """By bin of the probability p: count, mean p, rate of y, and the bin's share of the calibration error. Empty bins are absent."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    d = d.withColumn("bin", b).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("rate"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return d.withColumn("ece_part", F.col("n") / total * F.abs(F.col("mean_p") - F.col("rate")))


def brier_log_loss(d: DataFrame, by: list[str]) -> DataFrame:
    p, y = F.least(F.greatest("p", F.lit(1e-12)), F.lit(1 - 1e-12)), F.col("y").cast("double")
    return d.groupBy(*by).agg(F.avg((F.col("p") - y) ** 2).alias("brier"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def roc_auc(d: DataFrame, by: list[str]) -> DataFrame:
    """AUC of p for y in {0, 1}: the share of pairs of both classes in order, ties by half; null where a class is missing.

    Rows are counted by p first; the negatives below each p are running sums in blocks of p."""
    n = d.groupBy(*by, "p").agg(F.count_if(F.col("y") == 1).alias("_pos"), F.count_if(F.col("y") == 0).alias("_neg"))
    won = F.col("_pos").cast("double") * (F.col("_upto") - F.col("_neg") / 2)
    r = counted_below(n, by, "p", {"_neg": "_upto"}).groupBy(*by).agg(F.sum(won).alias("_s"), F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"))
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return r.withColumn("auc", F.col("_s") / F.when(pairs > 0, pairs)).drop("_s")


def confidence_buckets(d: DataFrame, edges: list[float]) -> DataFrame:
    """Fixed [lo, hi) buckets of confidence: count and accuracy; empty ones stay, with null accuracy."""
    spark = d.sparkSession
    dim = spark.createDataFrame(list(zip(edges, edges[1:], strict=False)), "lo double, hi double")
    k = F.coalesce(*[F.when((F.col("confidence") >= lo) & (F.col("confidence") < hi), F.lit(lo)) for lo, hi in zip(edges, edges[1:], strict=False)])
    got = d.withColumn("lo", k).groupBy("lo").agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("accuracy"))
    return dim.join(got, "lo", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def quantiles(d: DataFrame, by: list[str], value: Column, at: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles (name -> q) of a value by key, from counts of distinct values that are summed up in blocks of values; null without values."""
    n = d.withColumn("_a", value).groupBy(*by, "_a").agg(F.count("_a").alias("_n"))
    r = running(n, by, ["_a"], cells(F.col("_a")), {"_upto": ("sum", F.col("_n")), "_all": ("total", F.col("_n"))})
    place = {k: (F.col("_all") - 1) * F.lit(q) for k, q in at.items()}
    here = lambda k: F.max(F.when((k >= F.col("_upto") - F.col("_n")) & (k < F.col("_upto")), F.col("_a")))
    parts = [x for k, c in place.items() for x in (here(F.floor(c)).alias(f"_lo_{k}"), here(F.ceil(c)).alias(f"_hi_{k}"), F.max(c - F.floor(c)).alias(f"_part_{k}"))]
    r = r.groupBy(*by).agg(*parts)
    return r.select(*by, *[(F.col(f"_lo_{k}") + F.col(f"_part_{k}") * (F.col(f"_hi_{k}") - F.col(f"_lo_{k}"))).alias(k) for k in at])


def threshold_quantile(d: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    """The exact quantile q of |value|, interpolated; null without values."""
    return quantiles(d, by, F.abs(value), {"threshold": q})


def top_fraction_mean(d: DataFrame, by: list[str], fraction: float) -> DataFrame:
    """Mean outcome of the highest scores: max(1, half-even round of n * fraction) of them, ties by seq; NaN counts as the highest score, null as the lowest. Places are counted in cells of scores."""
    score = F.col("score").cast("double")
    down = F.when(F.isnan(score), float("-inf")).otherwise(-score)
    d = d.withColumns({"_last": score.isNull(), "_down": down})
    cell = F.when(F.col("_last"), F.lit(1 << 62)).otherwise(cells(F.col("_down")))
    d = running(d, by, ["_last", "_down", "seq"], cell, {"_k": ("sum", F.lit(1)), "_n": ("total", F.lit(1))})
    most = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(fraction)))
    return d.filter(F.col("_k") <= most).groupBy(*by).agg(F.count("*").alias("chosen"), F.avg("outcome").alias("mean_outcome"))


def evenly_spaced(d: DataFrame, key: str, order: str, samples: int, block: int | None = None) -> DataFrame:
    """Row number floor(j * (n - 1) / (k - 1)) for j < k of each key, all rows where k >= n, the middle one for k = 1; adds place."""
    d = running(d, [key], [order], block, {"_n": ("total", F.lit(1)), "place": ("sum", F.lit(1))}).withColumn("place", F.col("place") - 1)
    if samples == 1:
        return d.filter(F.col("place") == F.floor((F.col("_n") - 1) / 2)).drop("_n")
    # the row at p is chosen if some j has floor(j (n-1) / (k-1)) = p, that is if the first j at or above p's bound gives p
    j = F.ceil(F.col("place") * (samples - 1) / (F.col("_n") - 1))
    hit = (F.floor(j * (F.col("_n") - 1) / (samples - 1)) == F.col("place")) & (j < samples)
    return d.filter((F.col("_n") <= samples) | hit).drop("_n")


def stride(d: DataFrame, key: str, order: str, every: int, block: int | None = None) -> DataFrame:
    return running(d, [key], [order], block, {"_k": ("sum", F.lit(1))}).filter((F.col("_k") - 1) % every == 0).drop("_k")


def leaderboard(d: DataFrame, key: str, by: list[Column], n: int = 10) -> DataFrame:
    return d.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*by))).filter(F.col("place") <= n)


def best_with_minimum(d: DataFrame, key: str, least: int, by: list[Column]) -> DataFrame:
    """The best row of each key among those with enough trades, or among all where none has."""
    return leaderboard(d.withColumn("_few", F.col("trades") < least), key, [F.col("_few"), *by], 1).drop("_few", "place")


def local_calibration(d: DataFrame, validation: DataFrame, width: float = 0.05, least: int = 15, lo: float = 0.5, hi: float = 0.99, cells: int = 4096, key: list[str] | None = None) -> DataFrame:
    """Share of hits of the validation rows (of the same key) with confidence in [p - width, p + width], clipped; the raw value where there are too few.

    Running sums in two levels, over cells of confidence and within a cell, looked up at both ends of the range: no pair of rows is ever formed.
    """
    key = key or []
    cell = lambda c: F.floor(c * cells)
    v = validation.groupBy(*key, F.col("confidence").alias("x")).agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("h")).withColumn("cell", cell(F.col("x")))
    before = Window.partitionBy(*key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most `cells` rows a key and those of confidences above 1
    per = v.groupBy(*key, "cell").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))
    asked = d.select(*key, "confidence").distinct()
    ends = asked.select(*key, "confidence", F.lit(0).alias("end"), (F.col("confidence") - width).alias("x")).unionByName(asked.select(*key, "confidence", F.lit(1).alias("end"), (F.col("confidence") + width).alias("x")))
    ends = ends.withColumn("cell", cell(F.col("x")))
    # rows at the lower end itself count, so it comes before them, and the upper end after
    both = v.select(*key, "cell", "x", F.lit(1).alias("_o"), "n", "h").unionByName(ends.select(*key, "cell", "x", (F.col("end") * 2).alias("_o"), "confidence", "end"), allowMissingColumns=True)
    inside = Window.partitionBy(*key, "cell").orderBy("x", "_o").rowsBetween(Window.unboundedPreceding, 0)
    run = both.withColumns({c: F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in ("n", "h")}).filter("confidence is not null")
    all_cells = per.unionByName(ends.select(*key, "cell").distinct(), allowMissingColumns=True).groupBy(*key, "cell").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))
    base = all_cells.select(*key, "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("h").over(before), F.lit(0)).alias("h0"))
    at = run.join(base, [*key, "cell"]).withColumns({"n": F.col("n") + F.col("n0"), "h": F.col("h") + F.col("h0")})
    side = F.when(F.col("end") == 1, 1).otherwise(-1)
    near = at.groupBy(*key, "confidence").agg(F.sum(side * F.col("n")).alias("n"), F.sum(side * F.col("h")).alias("h"))
    local = F.least(F.greatest(F.col("h") / F.when(F.col("n") > 0, F.col("n")), F.lit(lo)), F.lit(hi))
    return d.join(near, [*key, "confidence"], "left").withColumn("calibrated", F.when(F.col("n") >= least, local).otherwise(F.col("confidence"))).drop("n", "h")


def gram(d: DataFrame, features: list[str], y: str) -> DataFrame:
    """One pass of sufficient statistics: (i, j, s) with the sums of products of (1, features, y) for i <= j."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in features], F.col(y).cast("double")]
    ij = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    one = d.agg(*[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i, j in ij])
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{i}_{j}").alias("s")) for i, j in ij])).alias("e")).select("e.*")
