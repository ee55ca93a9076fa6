"""Hard negatives by a multiway hyperplane tree whose split points know the distance ranges of their sibling subtrees.

All vectors are lifted onto a sphere (one more component makes their norms equal) and anchors are stretched to it, so that an anchor's inner
product falls as the distance grows, and a window of scores is an annulus around the anchor. A node of the tree deals its vectors to the nearest of a few split points; each
split point keeps the least and the largest distance to every sibling subtree. A subtree is left out where one of these ranges does not meet
the annulus; what is left is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import map_file, new_folder, pack, put_file, ship, unpack, written
from .topk import _matrix

NONE = -(1 << 62)  # the score of an empty place
LAST = (1 << 63) - 1  # where a missing id sorts


def labelled_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(row long, vec_id long, label long, v array<long>): floor(scale * x) of each component x, taken as double.

    Rows with a null label, a null vector or any null or non-finite component are left out. All others stay: repeated ids are vectors of
    their own, told apart by row; a null id sorts after all others (row is odd then); a vector without components scores 0.
    """
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    d = vectors.filter(F.col("label").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    row = F.monotonically_increasing_id() * 2 + F.col("vec_id").isNull().cast("long")
    return d.select(row.alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))


def lifted(v: np.ndarray, radius2: float) -> np.ndarray:
    """Vectors with the component that puts them on a sphere."""
    v = v.astype(np.float64)
    return np.hstack([v, np.sqrt(np.maximum(radius2 - (v**2).sum(1), 0))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))


def spread(points: np.ndarray, fan: int, least: float) -> np.ndarray:
    """Places of up to `fan` points far from one another, picked greedily; fewer where others lie within `least` of those picked."""
    chosen = [0]
    gap = distances(points, points[:1])[:, 0]
    while len(chosen) < fan and gap.max() > least:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, distances(points, points[chosen[-1:]])[:, 0])
    return np.array(chosen)


class Top:
    """The levels above the blocks: split points of each node, chosen from a bounded sample of vectors. A cell is a path through them."""

    def __init__(self, points: np.ndarray, there: np.ndarray, fan: int) -> None:
        self.points, self.there, self.fan = points, there, fan  # (levels, nodes of a level at most, fan, width), whether a split point stands
        self.depth = len(points)

    @classmethod
    def choose(cls, sample: np.ndarray, fan: int, depth: int, least: float) -> Top:
        points, there = np.zeros((depth, fan ** (depth - 1), fan, sample.shape[1])), np.zeros((depth, fan ** (depth - 1), fan), bool)
        cell = np.zeros(len(sample), np.int64)
        for level in range(depth):
            for node in np.unique(cell):
                own = sample[cell == node]
                chosen = own[spread(own, fan, least)]
                points[level, node, : len(chosen)], there[level, node, : len(chosen)] = chosen, True
            cell = cls(points[: level + 1], there[: level + 1], fan).descend(sample)[0]
        return cls(points, there, fan)

    def descend(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and its distances to the split points of the nodes on its way (infinite where none stands)."""
        cell, out = np.zeros(len(z), np.int64), np.full((len(z), self.depth * self.fan), np.inf)
        for level in range(self.depth):
            nearest = np.zeros(len(z), np.int64)
            for node in np.unique(cell):
                own = np.flatnonzero(cell == node)
                gap = np.where(self.there[level, node], distances(z[own], self.points[level, node]), np.inf)
                out[own, level * self.fan : (level + 1) * self.fan], nearest[own] = gap, gap.argmin(1)
            cell = cell * self.fan + nearest
        return cell, out

    def path(self, cells: np.ndarray) -> np.ndarray:
        """For each cell the places of its split points among all, level by level."""
        nodes = [cells // self.fan ** (self.depth - level) for level in range(self.depth)]
        return np.concatenate([((level * self.points.shape[1] + node) * self.fan)[:, None] + np.arange(self.fan) for level, node in enumerate(nodes)], 1)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"points": self.points.ravel(), "there": self.there.ravel().astype(np.int8), "shape": np.array(self.points.shape)}

    @classmethod
    def of(cls, a: dict[str, np.ndarray]) -> Top:
        shape = tuple(int(x) for x in a["shape"])
        return cls(a["points"].reshape(shape), a["there"].reshape(shape[:3]) != 0, shape[2])


def grow(z: np.ndarray, fan: int, leaf: int, least: float) -> dict[str, np.ndarray]:
    """A tree over the vectors of a block: their order (each node holds a stretch of it), the nodes, and for each two siblings the range of distances from the one's split point to the other's vectors."""
    order, nodes = np.arange(len(z)), [(0, len(z))]
    first, split, low, high = [], [], [], []
    for start, end in nodes:  # grows while it runs
        own = order[start:end]
        children, places = -1, np.full(fan, -1)
        lo, hi = np.zeros((fan, fan)), np.full((fan, fan), np.inf)
        if end - start > leaf:
            some = own[np.linspace(0, len(own) - 1, min(len(own), 4 * fan)).astype(int)]
            chosen = some[spread(z[some], fan, least)]
            if (m := len(chosen)) > 1:
                gap = distances(z[own], z[chosen])
                near = gap.argmin(1)
                near[np.searchsorted(own, chosen)] = np.arange(m)  # each stretch keeps its rows in order
                by = np.argsort(near, kind="stable")
                order[start:end] = own[by]
                cuts = np.concatenate([[0], np.cumsum(np.bincount(near, minlength=m))])
                lo[:m, :m], hi[:m, :m] = np.minimum.reduceat(gap[by], cuts[:-1]).T, np.maximum.reduceat(gap[by], cuts[:-1]).T
                children, places[:m] = len(nodes), chosen
                nodes += [(start + a, start + b) for a, b in zip(cuts, cuts[1:], strict=False)]
        first.append(children)
        split.append(places)
        low.append(lo)
        high.append(hi)
    at = np.argsort(order)
    split = np.array(split)
    return {"order": order, "ends": np.array(nodes).ravel(), "first": np.array(first), "split": np.where(split >= 0, at[split], -1).ravel(), "low": np.array(low).ravel(), "high": np.array(high).ravel()}


class Windows:
    """Questions of one block of anchors: for anchor a, the k best scores within [least, most] of rows with the same label or with others."""

    def __init__(self, f: dict[str, np.ndarray], width: int, radius2: float, same: bool, k: int) -> None:
        self.row, self.label, self.v, self.a = f["row"], f["label"], f["v"].reshape(-1, width), f["a"]
        self.same, self.k, self.radius2 = same, k, radius2
        self.least, self.most = f["least"].astype(np.float64), f["most"].astype(np.float64)
        norm = np.sqrt((self.v.astype(np.float64) ** 2).sum(1))
        self.stretch = np.where(norm > 0, radius2**0.5 / np.maximum(norm, 1e-300), 1.0)
        self.z = np.hstack([self.v * self.stretch[:, None], np.zeros((len(self.v), 1))])
        self.norm = np.where(norm > 0, radius2, 0.0)
        n = len(self.a)
        self.score, self.id, self.of = np.full((n, k), NONE), np.full((n, k), LAST), np.full((n, k), -1)
        self.inner, self.outer = (self.radius(np.arange(n), x) for x in (self.most, self.least))

    def radius(self, w: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which rows have a score with the anchors of windows w."""
        return np.sqrt(np.maximum(self.norm[self.a[w]] + self.radius2 - 2 * self.stretch[self.a[w]] * score, 0))

    def bound(self, gap: np.ndarray, low: np.ndarray, high: np.ndarray, active: np.ndarray, slack: float) -> np.ndarray:
        """For windows `active`, gap their anchors' distances to split points (n, m), and ranges (m) of a subtree: the least distance to its rows, infinite where its largest lies within the inner radius."""
        nearest = np.maximum(low[None] - gap, gap - high[None]).max(1)
        farthest = (gap + high[None]).min(1)
        return np.where(farthest + slack < self.inner[active], np.inf, nearest)

    def add(self, active: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        """Scores (anchors of `active`, rows) enter where they are allowed and good enough; ties go to the smaller id."""
        a = self.a[active]
        ok = (scores >= self.least[active, None]) & (scores <= self.most[active, None]) & (rows[None] != self.row[a, None])
        ok &= (labels[None] == self.label[a, None]) == self.same
        some = np.flatnonzero(ok.any(1))
        if not len(some):
            return
        ok, w = ok[some], active[some]
        columns = np.flatnonzero(ok.any(0))
        ok, found = ok[:, columns], scores[some][:, columns]
        score = np.concatenate([self.score[w], np.where(ok, found, NONE)], 1)
        ident = np.concatenate([self.id[w], np.broadcast_to(ids[columns], ok.shape)], 1)
        of = np.concatenate([self.of[w], np.where(ok, rows[columns], -1)], 1)
        best = np.lexsort((ident, -score), axis=1)[:, : self.k]
        self.score[w], self.id[w], self.of[w] = (np.take_along_axis(x, best, 1) for x in (score, ident, of))
        full = self.score[w, -1] > NONE
        self.least[w[full]] = np.maximum(self.least[w[full]], self.score[w[full], -1])
        self.outer[w] = self.radius(w, self.least[w])


def search(block: dict[str, np.ndarray], windows: Windows, active: np.ndarray, fan: int, slack: float) -> None:
    """Take windows down the tree of a block."""
    v = block["v"].reshape(len(block["row"]), -1)
    exact = max(float(np.abs(v).max(initial=0)) * float(np.abs(windows.v).max(initial=0)), 1.0) * max(v.shape[1], 1) < 2**52
    x, q = (v.astype(np.float64), windows.v.astype(np.float64)) if exact else (v, windows.v)
    z = lifted(v, windows.radius2)
    ends, split = block["ends"].reshape(-1, 2), block["split"].reshape(-1, fan)
    low, high = block["low"].reshape(-1, fan, fan), block["high"].reshape(-1, fan, fan)
    stack = [(0, active, np.zeros(len(active)))]
    while stack:
        node, own, bound = stack.pop()
        own = own[bound <= windows.outer[own] + slack]
        if not len(own):
            continue
        anchors, back = np.unique(windows.a[own], return_inverse=True)
        if block["first"][node] < 0:
            part = slice(*ends[node])
            windows.add(own, block["id"][part], block["row"][part], block["label"][part], (q[anchors] @ x[part].T).astype(np.int64)[back])
            continue
        m = int((split[node] >= 0).sum())
        gap = distances(windows.z[anchors], z[split[node, :m]])[back]
        bounds = [windows.bound(gap, low[node, :m, j], high[node, :m, j], own, slack) for j in range(m)]
        for j in sorted(range(m), key=lambda j: -bounds[j].min()):
            stack.append((int(block["first"][node]) + j, own, bounds[j]))


def hard_negatives(
    vectors: DataFrame, *, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    fan: int = 8, leaf: int = 64, sample: int = 4096, block: int = 4096, query_block: int = 512, share: int = 8, tasks: int = 64,
) -> DataFrame:
    """For each anchor (vec_id divisible by `every`) and each of its `positives` best rows of the same label: the first `negatives` rows of other labels whose score lies within low to high percent of the positive's.

    Scores are integer inner products with the anchor, higher first, ties by smaller vec_id. vectors: vec_id, embedding, label; which rows
    take part: see labelled_vectors. Each row is a vector and, by its id, an anchor of its own; only the anchor's own row is no positive. A
    shorter vector counts as if zeros followed. Fewer rows, or none, where fewer stand in the window (a window of a negative positive score is
    empty). An empty table gives an empty table; other columns are left out.

    The upper levels of the tree take their split points from a sample (the first `sample` vectors by a hash of the id) and deal all vectors
    into cells, cells into blocks of about `block` rows by a hash, so that copies of one vector, however many, fill several. A block is a subtree
    in a file of the shared folder, with the ranges of its distances to each split point above it; `share` blocks are listed in one file. A task
    takes a block of anchors through shares of the tree, nearest first, and carries each window's last score on. Positives are searched
    first, then their windows. Exact.

    Returns anchor_id, positive_id, rank int (from 1), negative_id, positive_score, negative_score.
    """
    spark = vectors.sparkSession
    d = written(labelled_vectors(vectors, scale), "labelled")
    norm = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    width, n, radius2 = d.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*"), F.coalesce(F.max(norm), F.lit(0.0))).first()
    width, slack = max(width, 1), 1e-6 * radius2**0.5 + 1e-9
    depth = 1 if n <= block * fan else 2 if n <= block * fan * fan else 3
    some = d.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(sample).select("v").toArrow()
    points = lifted(_matrix(some.column("v"), width), radius2)
    top = Top.choose(points, fan, depth, slack) if n else Top(np.zeros((1, 1, fan, width + 1)), np.zeros((1, 1, fan), bool), fan)
    tree, folder = ship(spark, "split-points", pack(top.arrays())), new_folder(spark, "hyperplane-tree")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = Top.of(unpack(SparkFiles.get(tree)))
        for b in batches:
            cell = upper.descend(lifted(_matrix(b.column("v"), width), radius2))[0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], [*b.schema.names, "cell"])

    d = written(d.mapInArrow(place, "row long, vec_id long, label long, v array<long>, cell long"), "cells")
    counts = {r.cell: (r.n, r.asked) for r in d.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asked")).collect()}  # at most fan**3 cells
    parts, begun, dealt = [], 0, 0
    for c in sorted(counts):
        k = -(-counts[c][0] // block)
        parts.append((c, begun, k, dealt, max(counts[c][1], 1)))
        begun, dealt = begun + k, dealt + counts[c][1]
    cells = F.broadcast(spark.createDataFrame(parts, "cell long, begun long, k long, dealt long, asked long"))
    salt = lambda c: F.pmod(F.xxhash64("row"), F.col(c))
    d = d.join(cells, "cell")

    def write_block(t: pa.Table) -> pa.Table:
        upper = Top.of(unpack(SparkFiles.get(tree)))
        v = _matrix(t.column("v"), width)
        z = lifted(v, radius2)
        gaps = upper.descend(z)[1]
        own = grow(z, fan, leaf, slack)
        by = own.pop("order")
        number = t.column("block")[0].as_py()
        ids = t.column("vec_id").fill_null(LAST).to_numpy()
        put_file(f"{folder}/block-{number}", pack({"row": t.column("row").to_numpy()[by], "id": ids[by], "label": t.column("label").to_numpy()[by], "v": v[by].ravel(), **own}))
        ranges = np.where(np.isfinite(gaps.min(0)), [gaps.min(0), gaps.max(0)], [[0.0], [np.inf]]).ravel()
        return pa.table({"block": pa.array([number], pa.int64()), "cell": pa.array([t.column("cell")[0].as_py()], pa.int64()), "ranges": pa.array([ranges.tolist()], pa.list_(pa.float64()))})

    blocks = d.withColumn("block", F.col("begun") + salt("k")).select("row", "vec_id", "label", "v", "cell", "block").groupBy("block")
    blocks = written(blocks.applyInArrow(write_block, "block long, cell long, ranges array<double>"), "blocks")

    def write_share(t: pa.Table) -> pa.Table:
        number = t.column("share")[0].as_py()
        put_file(f"{folder}/share-{number}", pack({"block": t.column("block").to_numpy(), "cell": t.column("cell").to_numpy(), "ranges": t.column("ranges").combine_chunks().flatten().to_numpy()}))
        return pa.table({"share": pa.array([number], pa.int64())})

    shares = written(blocks.withColumn("share", F.floor(F.col("block") / share)).groupBy("share").applyInArrow(write_share, "share long"), "shares").count()
    asked = written(d.filter(F.col("vec_id") % every == 0).withColumn("asking", F.floor((F.col("dealt") + salt("asked")) / query_block)).select("asking", "row", "vec_id", "label", "v"), "anchors")
    n_asking = -(-dealt // query_block)
    groups = max(1, min(shares, tasks // max(n_asking, 1)))
    search_all = _search_all(spark, folder, tree, width, radius2, slack, fan, shares, groups, n_asking)

    whole = F.array(F.struct(F.lit(None).cast("long").alias("of"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("score")))
    found = search_all(asked.withColumn("windows", whole), "first", True, positives, None)
    best = lambda key, k: F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), F.col("id").isNull(), "id", "of")) <= k
    chosen = written(found.filter("of is not null").withColumn("_ok", best(["anchor"], positives)).filter("_ok"), "positives")
    mine = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("of", "id", "score"))).alias("windows"))  # a few an anchor
    found = search_all(asked.join(mine, asked["row"] == mine["anchor"]).drop("anchor"), "second", False, negatives, (low, high))
    rank = F.row_number().over(Window.partitionBy("anchor", "window_of").orderBy(F.desc("score"), F.col("id").isNull(), "id", "of"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= negatives).select(
        F.col("anchor_id"), F.col("window_id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("window_score").alias("positive_score"), F.col("score").alias("negative_score")
    )


FOUND = "anchor long, anchor_id long, window_of long, window_id long, window_score long, of long, id long, score long"


def _search_all(spark: SparkSession, folder: str, tree: str, width: int, radius2: float, slack: float, fan: int, shares: int, groups: int, n_asking: int):
    """A function that puts anchors with their windows into files and takes each file through all shares of the tree."""

    def search_all(asked: DataFrame, kind: str, same: bool, k: int, percent: tuple[int, int] | None) -> DataFrame:
        def write(t: pa.Table) -> pa.Table:
            number, windows = t.column("asking")[0].as_py(), t.column("windows").combine_chunks()
            flat = windows.flatten()
            a = np.repeat(np.arange(t.num_rows), windows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            score = flat.field("score").fill_null(0).to_numpy(zero_copy_only=False)
            least, most = (-(-percent[0] * score // 100), percent[1] * score // 100) if percent else (np.full(len(a), -np.inf), np.full(len(a), np.inf))
            own = {"row": t.column("row").to_numpy(), "id": t.column("vec_id").to_numpy(), "label": t.column("label").to_numpy(), "v": _matrix(t.column("v"), width).ravel()}
            own |= {"a": a, "least": least, "most": most, "of": flat.field("of").fill_null(-1).to_numpy(zero_copy_only=False), "window_id": flat.field("id").fill_null(0).to_numpy(zero_copy_only=False), "score": score}
            put_file(f"{folder}/{kind}-{number}", pack(own))
            return pa.table({"asking": pa.array([number], pa.int64())})

        files = written(asked.groupBy("asking").applyInArrow(write, "asking long"), kind)
        n_tasks = max(1, n_asking * groups)
        todo = files.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(min(n_tasks, 20_000))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = Top.of(unpack(SparkFiles.get(tree)))
            flat, there = top.points.reshape(-1, width + 1), top.there.ravel()
            for b in batches:
                for number, group in zip(b.column("asking").to_pylist(), b.column("group").to_pylist(), strict=True):
                    f = map_file(f"{folder}/{kind}-{number}")
                    w = Windows(f, width, radius2, same, k)
                    gap = distances(w.z, flat[there])
                    place = np.cumsum(there) - 1
                    for s in range(group, shares, groups):
                        listed = map_file(f"{folder}/share-{s}")
                        ranges, path = listed["ranges"].reshape(len(listed["block"]), 2, -1), top.path(listed["cell"])
                        every = np.arange(len(w.a))
                        bounds = []
                        for block in range(len(path)):
                            on = there[path[block]]
                            near = gap[:, place[path[block][on]]][w.a]
                            bounds.append(w.bound(near, ranges[block, 0][on], ranges[block, 1][on], every, slack))
                        for block in sorted(range(len(path)), key=lambda i: bounds[i].mean()):
                            own = np.flatnonzero(bounds[block] <= w.outer + slack)
                            if len(own):
                                search(map_file(f"{folder}/block-{listed['block'][block]}"), w, own, fan, slack)
                    i, j = np.nonzero(w.score > NONE)
                    a, of = w.a[i], w.of[i, j]
                    missing = lambda x, rows: pa.array(x, pa.int64(), mask=(rows & 1) == 1)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(w.row[a]), pa.array(f["id"][a]), pa.array(f["of"][i]), missing(f["window_id"][i], f["of"][i]), pa.array(f["score"][i]), pa.array(of), missing(w.id[i, j], of), pa.array(w.score[i, j]),
                    ], ["anchor", "anchor_id", "window_of", "window_id", "window_score", "of", "id", "score"])

        return todo.mapInArrow(run, FOUND)

    return search_all
