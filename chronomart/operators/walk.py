"""Walk-forward models and their protocols: who trains when, nested choice, calibration, economic gates, survivors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import threshold_quantile
from .running import running


def placed(rows: DataFrame, block: int = 7 * 86400) -> DataFrame:
    """Adds k: the place of a row in its symbol's order of t, from 0. Symbols are dealt over tasks by blocks of t."""
    return running(rows, ["symbol"], ["t"], block, {"k": ("sum", F.lit(1))}).withColumn("k", (F.col("k") - 1).cast("int"))


def refits(rows: DataFrame, *, gap: int, every: int, least: int) -> DataFrame:
    """(symbol, refit, at, train, scored): refit r stands at place least + r * every, trains on rows with k + gap <= at, and scores the rows from there to the next.

    gap is the label's horizon and any embargo after it. rows: symbol, k and labelled (whether the row has a label); a row counts from its first refit on, so
    the training sizes are running sums over refits.
    """
    first = F.greatest(F.ceil((F.col("k") + gap - least) / every), F.lit(0)).cast("long")
    own = F.floor((F.col("k") - least) / every)
    d = rows.filter("labelled").groupBy("symbol", first.alias("refit")).agg(F.count("*").alias("_t"))
    s = rows.filter(F.col("k") >= least).groupBy("symbol", own.alias("refit")).agg(F.count("*").alias("scored"))
    w = Window.partitionBy("symbol").orderBy("refit").rowsBetween(Window.unboundedPreceding, 0)
    both = s.join(d, ["symbol", "refit"], "full").withColumn("train", F.sum(F.coalesce("_t", F.lit(0))).over(w))
    return both.filter("scored is not null").select("symbol", "refit", (least + F.col("refit") * every).alias("at"), "train", "scored")


def _sums(features: list[str], targets: list[str]) -> list[Column]:
    """Sums of products of (1, features) among each other and with each target, row by row of the matrix."""
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    return [F.sum(a * b) for i, a in enumerate(x) for b in [*x[i:], *[F.col(t).cast("double") for t in targets]]]


def solve(sums: np.ndarray, d: int, targets: int, ridge: float) -> np.ndarray:
    """Weights (targets x (1 + d)) from the sums that _sums lists: ridge on features scaled by their deviation, intercept free."""
    g, b, at = np.zeros((d + 1, d + 1)), np.zeros((d + 1, targets)), 0
    for i in range(d + 1):
        n = d + 1 - i
        g[i, i:] = g[i:, i] = sums[at : at + n]
        b[i] = sums[at + n : at + n + targets]
        at += n + targets
    n = max(g[0, 0], 1.0)
    mean = g[0, 1:] / n
    cov = g[1:, 1:] - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov) / n, 0))
    scale = np.where(sd > 1e-12, sd, 1.0)
    w = np.linalg.solve(cov / np.outer(scale, scale) + ridge * np.eye(d), (b[1:] - np.outer(mean, b[0])) / scale[:, None]) / scale[:, None]
    w[sd <= 1e-12] = 0
    return np.vstack([b[0] / n - mean @ w, w]).T


def walk_forward(rows: DataFrame, features: list[str], targets: list[str], *, gap: int, every: int, least: int, ridge: float = 10.0) -> DataFrame:
    """rows with a prediction p_<target> for each target, by models that are refitted every `every` rows on all rows whose labels had ended before.

    Linear heads on one matrix of sums: each row's products are summed into its first refit, running sums over refits give every model, and small
    systems are solved in tasks. The whole history is read once, whatever the number of refits. rows: symbol, t, features, targets (null
    where the label is not known or a feature is missing: such rows do not train, and without features they are not scored).
    """
    d, n_t = len(features), len(targets)
    p = placed(rows)
    first = F.greatest(F.ceil((F.col("k") + gap - least) / every), F.lit(0)).cast("long")
    full = p.dropna(subset=[*features, *targets])
    sums = _sums(features, targets)
    g = full.groupBy("symbol", first.alias("refit")).agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)], F.count("*").alias("n"))
    own = F.floor((F.col("k") - least) / every)
    asked = p.filter(F.col("k") >= least).select("symbol", own.alias("refit")).distinct()
    w = Window.partitionBy("symbol").orderBy("refit").rowsBetween(Window.unboundedPreceding, 0)
    run = asked.join(g, ["symbol", "refit"], "full").select("symbol", "refit", F.sum("n").over(w).alias("n"), F.array(*[F.coalesce(F.sum(f"s{i}").over(w), F.lit(0.0)) for i in range(len(sums))]).alias("sums"))

    def fit(batches):
        import pyarrow as pa

        for b in batches:
            weights = [solve(np.array(s), d, n_t, ridge).ravel().tolist() if n else None for s, n in zip(b.column("sums").to_pylist(), b.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("symbol"), b.column("refit"), b.column("n"), pa.array(weights, pa.list_(pa.float64()))], ["symbol", "refit", "train", "weights"])

    models = run.mapInArrow(fit, "symbol string, refit long, train long, weights array<double>")
    j = p.withColumn("refit", own).filter(F.col("k") >= least).join(models, ["symbol", "refit"], "left")
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    head = lambda t: sum((F.get("weights", F.lit(t * (d + 1) + i)) * x[i] for i in range(1, d + 1)), F.get("weights", F.lit(t * (d + 1))))
    return j.select(*rows.columns, "k", "refit", "train", *[head(t).alias(f"p_{name}") for t, name in enumerate(targets)])


def nested_days(rows: DataFrame, features: list[str], target: str, alphas: list[float], least: int = 3) -> DataFrame:
    """(symbol, day, train_rows, eval_rows, alpha, mse): each day is predicted by the ridge weight that did best on the day before it, refitted on all earlier days.

    rows: symbol, day, label_end_day, features, target. A row trains only for days after the one in which its label ends (purge), and is evaluated on its own
    day. Sums are additive over days, so the choice reads days, not rows: one matrix a day.
    """
    d = len(features)
    sums = _sums(features, [target])
    one = lambda key: rows.groupBy("symbol", F.col(key).alias("day")).agg(F.array(*sums).alias("sums"), F.count("*").alias("n"), F.sum(F.col(target) ** 2).alias("yy"))
    days = one("day").withColumn("part", F.lit("eval")).unionByName(one("label_end_day").withColumn("part", F.lit("train")))

    def choose(key, table):
        import pyarrow as pa

        by = {"train": {}, "eval": {}}
        for r in table.to_pylist():
            by[r["part"]][r["day"]] = (np.array(r["sums"]), r["n"], r["yy"])
        before = lambda day: [v for k, v in by["train"].items() if k < day]
        out = []

        def error(w, day):
            s, n, yy = by["eval"][day]
            g, b, at = np.zeros((d + 1, d + 1)), np.zeros(d + 1), 0
            for i in range(d + 1):
                m = d + 1 - i
                g[i, i:] = g[i:, i] = s[at : at + m]
                b[i] = s[at + m]
                at += m + 1
            return (yy - 2 * w @ b + w @ g @ w) / n

        ordered = sorted(by["eval"])
        for at, day in enumerate(ordered):
            if at < least:
                continue
            inner, outer = before(ordered[at - 1]), before(day)
            alpha = alphas[0]
            if inner:
                total = sum(x[0] for x in inner)
                errors = [error(solve(total, d, 1, a)[0], ordered[at - 1]) for a in alphas]
                alpha = alphas[int(np.argmin(errors))]
            mse = error(solve(sum(x[0] for x in outer), d, 1, alpha)[0], day) if outer else None
            out.append((key[0].as_py(), day, sum(x[1] for x in outer), by["eval"][day][1], alpha, mse))
        names = [("symbol", pa.string()), ("day", pa.int64()), ("train_rows", pa.int64()), ("eval_rows", pa.int64()), ("alpha", pa.float64()), ("mse", pa.float64())]
        return pa.table({name: pa.array([r[i] for r in out], kind) for i, (name, kind) in enumerate(names)})

    return days.groupBy("symbol").applyInArrow(choose, "symbol string, day long, train_rows long, eval_rows long, alpha double, mse double")


def inner_alpha(rows: DataFrame, features: list[str], target: str, alphas: list[float], least: int = 30, fallback: float = 10.0) -> DataFrame:
    """(symbol, alpha, r2) for each ridge weight on the last fifth of a symbol's rows, fitted on the rest; with chosen: the best R2, ties to the smaller alpha.

    A symbol with fewer than `least` rows takes the fallback, without R2. rows: symbol, t, features, target.
    """
    d = len(features)
    p = running(rows, ["symbol"], ["t"], 7 * 86400, {"k": ("sum", F.lit(1)), "_n": ("total", F.lit(1))})
    p = p.withColumn("_late", F.col("k") - 1 >= F.floor(F.col("_n") * 0.8))
    g = p.groupBy("symbol", "_late").agg(F.array(*_sums(features, [target])).alias("sums"), F.count("*").alias("n"), F.sum(F.col(target) ** 2).alias("yy"))

    def choose(key, table):
        import pyarrow as pa

        by = {r["_late"]: r for r in table.to_pylist()}
        out, n = [], sum(r["n"] for r in by.values())
        if n >= least and len(by) == 2:
            s, best = np.array(by[True]["sums"]), None
            m, b, at = np.zeros((d + 1, d + 1)), np.zeros(d + 1), 0
            for i in range(d + 1):
                k = d + 1 - i
                m[i, i:] = m[i:, i] = s[at : at + k]
                b[i] = s[at + k]
                at += k + 1
            spread = by[True]["yy"] - b[0] ** 2 / by[True]["n"]
            for a in sorted(alphas):
                w = solve(np.array(by[False]["sums"]), d, 1, a)[0]
                r2 = 1 - (by[True]["yy"] - 2 * w @ b + w @ m @ w) / spread if spread > 0 else None
                out.append([key[0].as_py(), a, r2, False])
                if r2 is not None and (best is None or r2 > best[2]):
                    best = out[-1]
            (best or out[0])[3] = True
        else:
            out.append([key[0].as_py(), fallback, None, True])
        kinds = [("symbol", pa.string()), ("alpha", pa.float64()), ("r2", pa.float64()), ("chosen", pa.bool_())]
        return pa.table({name: pa.array([r[i] for r in out], kind) for i, (name, kind) in enumerate(kinds)})

    return g.groupBy("symbol").applyInArrow(choose, "symbol string, alpha double, r2 double, chosen boolean")


def shrink(sums: np.ndarray, d: int, alpha: float, l1: float, steps: int = 10_000, least: float = 1e-12) -> np.ndarray:
    """Weights (intercept first) that minimise |y - Xw|^2 / 2n + alpha * (l1 |w|_1 + (1 - l1) |w|^2 / 2), on features scaled by their deviation: coordinate descent on the sums of _sums with one target."""
    g, b, at = np.zeros((d + 1, d + 1)), np.zeros(d + 1), 0
    for i in range(d + 1):
        g[i, i:] = g[i:, i] = sums[at : at + d + 1 - i]
        b[i] = sums[at + d + 1 - i]
        at += d + 2 - i
    n = max(g[0, 0], 1.0)
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    live = sd > 1e-12
    scale = np.where(live, sd, 1.0)
    cov, c, w = cov / np.outer(scale, scale), (b[1:] - mean * b[0]) / n / scale, np.zeros(d)
    for _ in range(steps):
        before = w.copy()
        for j in np.flatnonzero(live):
            r = c[j] - cov[j] @ w + cov[j, j] * w[j]
            w[j] = np.sign(r) * max(abs(r) - alpha * l1, 0.0) / (cov[j, j] + alpha * (1 - l1))
        if np.abs(w - before).max(initial=0) <= least:
            break
    w = w / scale
    return np.concatenate([[b[0] / n - mean @ w], w])


def elastic_net(train: DataFrame, rows: DataFrame, features: list[str], target: str, key: list[str], alpha: float = 5e-4, l1: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(rows with prediction, weights: key, feature, weight) of an elastic net by key, from one matrix of sums a key.

    Rows of train without target or a feature do not count; keys without any have no weights, and null predictions. A feature that does not vary has weight 0.
    """
    d = len(features)
    g = train.dropna(subset=[*features, target]).groupBy(*key).agg(F.array(*_sums(features, [target])).alias("_sums"))
    kinds = dict(g.dtypes)

    def fit(batches):
        import pyarrow as pa

        for b in batches:
            w = [shrink(np.array(s), d, alpha, l1).tolist() for s in b.column("_sums").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in key], pa.array(w, pa.list_(pa.float64()))], [*key, "_w"])

    models = g.mapInArrow(fit, ", ".join([*[f"{k} {kinds[k]}" for k in key], "_w array<double>"]))
    names = F.array(*map(F.lit, ["intercept", *features]))
    weights = models.select(*key, F.posexplode("_w").alias("_i", "weight")).select(*key, F.get(names, F.col("_i")).alias("feature"), "weight")
    value = F.get("_w", F.lit(0))
    for i, c in enumerate(features):
        value = value + F.get("_w", F.lit(i + 1)) * F.col(c)
    return rows.join(models, key, "left").withColumn("prediction", value).drop("_w"), weights


def calibrated_side(train: DataFrame, calibration: DataFrame, rows: DataFrame, features: list[str], label: str, net: str, c: float = 1.0) -> DataFrame:
    """rows with p and utility of one side: balanced logistic regression on features scaled by train, Platt scaling on the calibration slice,
    utility = p * mean net of positives + (1 - p) * mean net of others, both of the calibration slice."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    put = VectorAssembler(inputCols=features, outputCol="_v")
    scaler = StandardScaler(inputCol="_v", outputCol="_x", withMean=True).fit(put.transform(train))
    of = lambda d: scaler.transform(put.transform(d))
    n, pos = train.agg(F.count("*"), F.sum(F.col(label).cast("double"))).first()
    weight = F.when(F.col(label) == 1, F.lit(n / (2 * max(pos, 1.0)))).otherwise(n / (2 * max(n - pos, 1.0)))
    fit = LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", regParam=1 / (c * n), standardization=False, maxIter=100, tol=1e-9).fit(of(train).withColumn("_w", weight))
    logit = VectorAssembler(inputCols=["_z"], outputCol="_l")
    scored = lambda d: logit.transform(fit.transform(of(d)).withColumn("_z", F.get(vector_to_array("rawPrediction"), F.lit(1))).drop("rawPrediction", "probability", "prediction"))
    platt = LogisticRegression(featuresCol="_l", labelCol=label, regParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(scored(calibration))
    gain, loss = calibration.agg(F.coalesce(F.avg(F.when(F.col(label) == 1, F.col(net))), F.lit(0.0)), F.coalesce(F.avg(F.when(F.col(label) == 0, F.col(net))), F.lit(0.0))).first()
    out = platt.transform(scored(rows)).withColumn("p", F.get(vector_to_array("probability"), F.lit(1)))
    return out.select(*rows.columns, "p", (F.col("p") * gain + (1 - F.col("p")) * loss).alias("utility"))


def calibrated_pair(train: DataFrame, calibration: DataFrame, selection: DataFrame, rows: DataFrame, features: list[str], sides: dict[str, tuple[str, str]], cs: list[float], *, least: float = 0.55) -> DataFrame:
    """rows with p and utility of both sides, action (1, -1, 0) and the c that was chosen: the setting whose actions bring the highest total on the selection slice, ties to the smaller c.

    sides: long and short -> (label, net) columns. See calibrated_side for a side's model, and probabilistic_action for the choice of a side. A slice without
    rows brings 0.
    """
    from .selection import probabilistic_action

    def scored(d: DataFrame, c: float) -> DataFrame:
        for side, (label, net) in sides.items():
            d = calibrated_side(train, calibration, d, features, label, net, c).withColumnsRenamed({"p": f"p_{side}", "utility": f"utility_{side}"})
        return d.withColumn("action", probabilistic_action(*[F.col(f"{x}_{side}") for x in ("p", "utility") for side in ("long", "short")], least))

    best = None
    for c in sorted(cs):
        act = F.when(F.col("action") == 1, F.col(sides["long"][1])).when(F.col("action") == -1, F.col(sides["short"][1])).otherwise(0.0)
        total = scored(selection, c).agg(F.coalesce(F.sum(act), F.lit(0.0))).first()[0]
        if best is None or total > best[1] + 1e-9:
            best = (c, total)
    return scored(rows, best[0]).withColumn("c", F.lit(best[0]))


def fill_times_markout(history: DataFrame, rows: DataFrame, key: list[str], cost: float, thresholds: list[float], *, submitted: int, filled: int) -> tuple[DataFrame, DataFrame]:
    """Expected value of a passive order, P(fill) * (E[gross given fill] - cost), from the history of its key; and by threshold what the orders above it bring.

    Returns (rows with ev, thresholds with submitted, fills, total and chosen): the highest total among those with enough orders and fills, ties to the lower threshold.
    """
    h = history.groupBy(*key).agg(F.avg(F.col("filled").cast("double")).alias("p_fill"), F.avg(F.when(F.col("filled"), F.col("gross"))).alias("markout"))
    d = rows.join(h, key, "left").withColumn("ev", F.col("p_fill") * (F.col("markout") - cost))
    t = rows.sparkSession.createDataFrame([(x,) for x in thresholds], "threshold double")
    above = d.withColumn("threshold", F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda x: F.col("ev") > x)))
    s = above.groupBy("threshold").agg(
        F.count("ev").alias("submitted"), F.count_if(F.col("filled")).alias("fills"), F.coalesce(F.sum(F.when(F.col("filled"), F.col("gross") - cost)), F.lit(0.0)).alias("total")
    )
    s = t.join(s, "threshold", "left").fillna({"submitted": 0, "fills": 0, "total": 0.0})  # as many rows as thresholds
    enough = (F.col("submitted") >= submitted) & (F.col("fills") >= filled)
    best = F.row_number().over(Window.orderBy(F.desc(enough.cast("int")), F.desc("total"), "threshold"))  # as many rows as thresholds
    return d.drop("p_fill", "markout"), s.withColumn("chosen", (best == 1) & enough)


def economic_gate(train: DataFrame, rows: DataFrame, cost: float | None, *, share: float = 0.75, volatility: float = 0.60, times: float = 1.5) -> DataFrame:
    """rows (symbol, t, pred, vol_rank ...) that pass: |pred| at least the share's quantile of |pred| in train, volatility rank high enough, and |pred| over
    `times` the cost. Without a cost nothing is evaluated: no row passes. A null or NaN figure does not pass."""
    from ..functions.features import finite

    if cost is None:
        return rows.limit(0)
    least = threshold_quantile(train, ["symbol"], "pred", share).withColumnRenamed("threshold", "_least")
    size = F.abs(finite(F.col("pred")))
    return rows.join(least, "symbol").filter((size >= F.col("_least")) & (finite(F.col("vol_rank")) >= volatility) & (size > times * cost)).drop("_least")


def survivors(economics: DataFrame, key: list[str], primary: float, stress: float, *, trades: int, factor: float) -> DataFrame:
    """Keys with enough trades, a total above zero and a profit factor of at least `factor` at the primary cost, and a total above zero at the stress cost.

    economics: key, cost_bps, trades, total, profit_factor (null without losses, which passes)."""
    at = lambda c: economics.filter(F.col("cost_bps") == c)
    ok = at(primary).filter((F.col("trades") >= trades) & (F.col("total") > 0) & (F.coalesce(F.col("profit_factor"), F.lit(float("inf"))) >= factor))
    return ok.join(at(stress).filter("total > 0").select(*key), key, "left_semi").select(*key, "trades", "total", "profit_factor")
