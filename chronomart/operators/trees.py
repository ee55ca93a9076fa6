"""Boosted trees on histograms: all models and heads of a walk-forward protocol grow at once, level by level, from Spark aggregates.

A row of the state is a row of the data within one model and head: its bins, target, part (0 fits, 1 validates, 2 is scored) and score so far.
A level sums gradients by model, node, feature and bin, so what is shuffled is a histogram a model and node; the best splits, a row a
node, go back to the rows by an equi-join. No task holds a model's rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .running import running
from .walk import placed, refits

MODEL = ["symbol", "refit", "head"]


@dataclass(frozen=True)
class Head:
    """What a model predicts: a target column, logistic or squared loss, its step and the weight of leaf sizes."""

    target: str
    loss: str = "squared"
    rate: float = 0.1
    ridge: float = 1.0


def edges(rows: DataFrame, features: list[str], bins: int, key: list[str]) -> DataFrame:
    """(key, edges): for each feature bins - 1 exact quantiles of the rows given, which should be a bounded and causal start of the history."""
    q = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    return rows.groupBy(*key).agg(F.array(*[F.percentile(F.col(c).cast("double"), q) for c in features]).alias("edges"))


def binned(features: list[str]) -> Column:
    """The number of edges below each feature."""
    one = lambda i, c: F.size(F.filter(F.get("edges", F.lit(i)), lambda e: e < F.col(c)))
    return F.array(*[one(i, c) for i, c in enumerate(features)])


def with_heads(rows: DataFrame, heads: dict[str, Head]) -> DataFrame:
    """Each row once a head, with its target y and score f = 0."""
    each = F.array(*[F.struct(F.lit(n).alias("head"), F.col(h.target).cast("double").alias("y")) for n, h in heads.items()])
    targets = {h.target for h in heads.values()}
    return rows.withColumn("_h", F.explode(each)).select(*[c for c in rows.columns if c not in targets], "_h.head", "_h.y", F.lit(0.0).alias("f"))


def _of(heads: dict[str, Head], field: str) -> Column:
    c = F.lit(None)
    for name, h in heads.items():
        c = F.when(F.col("head") == name, F.lit(getattr(h, field))).otherwise(c)
    return c


def boost(state: DataFrame, heads: dict[str, Head], *, trees: int, depth: int, least: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """(state with final scores f, splits: symbol, refit, head, tree, level, node, feature, bin, gain).

    state: symbol, refit, head, part, bins, y, f, other columns. Each tree follows the gradient at the scores so far. A node splits where the gain is highest (compared to nine
    digits; ties: first feature, lowest bin), if both sides weigh at least `least` in second derivatives; else its rows stay together. A leaf
    adds -rate * sum g / (sum h + ridge). Rows with a null target do not fit.
    """
    ridge, rate, loss = _of(heads, "ridge"), _of(heads, "rate"), _of(heads, "loss")
    p = 1 / (1 + F.exp(-F.col("f")))
    g, h = F.when(loss == "logistic", p).otherwise(F.col("f")) - F.col("y"), F.when(loss == "logistic", p * (1 - p)).otherwise(1.0)
    names, found = state.columns, []
    for tree in range(trees):
        d = state.withColumns({"_g": g, "_h": h, "_node": F.lit(0)})
        for level in range(depth):
            fits = d.filter("part = 0 and y is not null")
            cells = fits.select(*MODEL, "_node", "_g", "_h", F.posexplode("bins").alias("feature", "bin")).groupBy(*MODEL, "_node", "feature", "bin").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"))
            line = Window.partitionBy(*MODEL, "_node", "feature")
            left = line.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
            cells = cells.withColumns({"gl": F.sum("g").over(left), "hl": F.sum("h").over(left), "gs": F.sum("g").over(line), "hs": F.sum("h").over(line)})
            score = lambda a, b: a * a / (b + ridge)
            gr, hr = F.col("gs") - F.col("gl"), F.col("hs") - F.col("hl")
            gain = F.round(score(F.col("gl"), F.col("hl")) + score(gr, hr) - score(F.col("gs"), F.col("hs")), 9)
            ok = cells.withColumn("gain", gain).filter((F.col("hl") >= least) & (hr >= least) & (F.col("gain") > 0))
            best = ok.groupBy(*MODEL, "_node").agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))).alias("_s"))
            best = written(best.select(*MODEL, "_node", (-F.col("_s.f")).alias("_feature"), (-F.col("_s.b")).alias("_bin"), F.col("_s.gain").alias("_gain")), "splits")
            found.append(best.select(*MODEL, F.lit(tree).alias("tree"), F.lit(level).alias("level"), F.col("_node").alias("node"), F.col("_feature").alias("feature"), F.col("_bin").alias("bin"), F.col("_gain").alias("gain")))
            right = F.coalesce(F.get("bins", F.col("_feature")) > F.col("_bin"), F.lit(False)).cast("int")
            d = d.join(best, [*MODEL, "_node"], "left").withColumn("_node", F.col("_node") * 2 + right).drop("_feature", "_bin", "_gain")
        leaves = d.filter("part = 0 and y is not null").groupBy(*MODEL, "_node").agg((-rate * F.sum("_g") / (F.sum("_h") + ridge)).alias("_v"))
        d = d.join(leaves, [*MODEL, "_node"], "left").withColumn("f", F.col("f") + F.coalesce("_v", F.lit(0.0)))
        state = written(d.select(*names), "boosted")
    splits = found[0]
    for s in found[1:]:
        splits = splits.unionByName(s)
    return state, splits


def expanding(rows: DataFrame, features: list[str], targets: list[str], *, gap: int, every: int, least: int, bins: int = 16, validation: float = 0.2) -> DataFrame:
    """Rows of every model of a walk-forward protocol: symbol, refit, t, k, part, train, bins and the targets.

    Model r stands at place least + r * every, and knows the rows with all targets whose place + gap is not beyond that. Their last `validation` share (at least
    one row; `least` rows stay to fit where there are that many) is part 1, the rest part 0; rows from its place to the next one's are part 2. A model
    that knows fewer than two rows is left out. Features are binned by quantiles of a symbol's first `least` rows, which every model knows. Rows without
    a feature go. A row stands in all later models: that is the protocol's own growth.
    """
    p = placed(rows)
    d = p.dropna(subset=features)
    cuts = edges(d.filter(F.col("k") < least), features, bins, ["symbol"])
    d = d.join(cuts, "symbol").select("symbol", "t", "k", binned(features).alias("bins"), *targets)
    whole = F.lit(True)
    for c in targets:
        whole = whole & F.col(c).isNotNull()
    models = refits(d.withColumn("labelled", whole), gap=gap, every=every, least=least).filter("train >= 2")
    last = models.groupBy("symbol").agg(F.max("refit").alias("_last"))
    first = F.greatest(F.ceil((F.col("k") + gap - least) / every), F.lit(0)).cast("long")
    known = running(d.filter(whole), ["symbol"], ["k"], 65_536, {"_j": ("sum", F.lit(1))}).join(last, "symbol").filter(first <= F.col("_last"))
    known = known.withColumn("refit", F.explode(F.sequence(first, "_last"))).join(models.select("symbol", "refit", "train"), ["symbol", "refit"])
    split = F.least(F.greatest(F.lit(least), F.floor(F.col("train") * (1 - validation))), F.col("train") - 1)
    known = known.withColumn("part", F.when(F.col("_j") <= split, 0).otherwise(1)).drop("_j", "_last")
    asked = d.filter(F.col("k") >= least).withColumn("refit", F.floor((F.col("k") - least) / every)).join(models.select("symbol", "refit", "train"), ["symbol", "refit"]).withColumn("part", F.lit(2))
    names = ["symbol", "refit", "t", "k", "part", "train", "bins", *targets]
    return known.select(*names).unionByName(asked.select(*names))


def calibrated(scored: DataFrame, width: float = 0.05, least: int = 15) -> DataFrame:
    """Scored rows of a logistic head with p, confidence max(p, 1 - p), and calibrated: how often the model's own validation rows of about that confidence were right; too few leave it as it is."""
    from .metrics import local_calibration

    p = 1 / (1 + F.exp(-F.col("f")))
    d = scored.withColumns({"p": p, "confidence": F.greatest(p, 1 - p)})
    d = d.withColumn("hit", ((F.col("p") >= 0.5).cast("int") == F.col("y").cast("int")).cast("int"))
    return local_calibration(d.filter("part = 2").drop("hit"), d.filter("part = 1"), width, least, key=["symbol", "refit"])


def importances(splits: DataFrame, features: list[str], key: tuple[str, ...] = ()) -> DataFrame:
    """(key, feature, importance): each feature's share of all gain."""
    names = F.array(*map(F.lit, features))
    d = splits.groupBy(*key, F.get(names, F.col("feature")).alias("feature")).agg(F.sum("gain").alias("_g"))
    return d.withColumn("importance", F.col("_g") / F.sum("_g").over(Window.partitionBy(*key))).drop("_g")  # as many rows as features
