"""Exact top-k search by inner product with a table of distances to pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import map_file, new_folder, pack, put_file, ship, unpack, written

LAST = (1 << 63) - 1  # where a missing id sorts
FOUND = "query_row long, query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(row long, vec_id long, v array<long>): floor(scale * x) of each component x, taken as double; row tells rows of equal ids apart.

    Null vectors and those that hold null or non-finite components are left out. All others stay, repeated ids too; one without components scores 0; a
    null id sorts after all others (row is odd then).
    """
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    d = vectors.filter(x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    row = F.monotonically_increasing_id() * 2 + F.col("vec_id").isNull().cast("long")
    return d.select(row.alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of numbers; shorter ones are filled up with zeros, which add nothing to an inner product."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    at = np.repeat(np.arange(len(column)), size)
    out[at, np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def choose_pivots(d: DataFrame, pivots: int, sample: int, width: int) -> np.ndarray:
    """Pivots far from one another, picked greedily from a bounded sample (the first vectors by a hash of the id)."""
    found = d.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(sample).select("v").toArrow()
    rows = _matrix(found.column("v"), width).astype(np.float64)
    if not len(rows):
        return np.zeros((0, width))
    chosen = [int(np.argmax((rows**2).sum(1)))]
    gap = ((rows - rows[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(rows)) and gap.max() > 0:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    return rows[chosen]


class Block:
    """Vectors of a mapped file with their distances to the pivots."""

    def __init__(self, a: dict[str, np.ndarray], width: int) -> None:
        self.row, self.id, self.v = a["row"], a["id"], a["v"].reshape(-1, width)
        self.gaps = a["gaps"].reshape(len(self.id), -1)
        self.norm = (self.v.astype(np.float64) ** 2).sum(1)


class Best:
    """The k best of each query so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.id, self.score, self.row = k, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
        self.least = np.full(n, -np.inf)

    def add(self, q: int, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        rows, ids, scores = np.concatenate([self.row[q], rows]), np.concatenate([self.id[q], ids]), np.concatenate([self.score[q], scores])
        keep = np.lexsort((ids, -scores))[: self.k]
        self.row[q], self.id[q], self.score[q] = rows[keep], ids[keep], scores[keep]
        if len(keep) == self.k:
            self.least[q] = self.score[q][-1]


def search(block: Block, queries: Block, best: Best) -> None:
    """Improve the best of each query by a block.

    The largest gap between a query's and a vector's distances to a pivot bounds their distance from below, and so
    their inner product from above. Vectors are evaluated in order of that bound until it falls below the k-th score so far.
    """
    exact = max(float(np.abs(block.v).max(initial=0)) * float(np.abs(queries.v).max(initial=0)), 1.0) * block.v.shape[1] < 2**52
    v = block.v.astype(np.float64) if exact else block.v
    for at in range(0, len(queries.id), 64):
        part = slice(at, at + 64)
        low = np.zeros((len(queries.id[part]), len(v)))
        for p in range(block.gaps.shape[1]):
            np.maximum(low, np.abs(queries.gaps[part, p, None] - block.gaps[None, :, p]), out=low)
        bound = (queries.norm[part, None] + block.norm[None, :] - low**2) / 2
        bound += 1 + 1e-9 * np.abs(bound)
        bound[queries.row[part, None] == block.row[None]] = -np.inf
        for n, b in enumerate(bound):
            q = at + n
            may = np.flatnonzero(b >= max(best.least[q], -1e300))
            order = may[np.argsort(-b[may], kind="stable")]
            one, i, step = queries.v[q].astype(v.dtype), 0, 64
            while i < len(order) and b[order[i]] >= best.least[q]:
                own = order[i : i + step]
                best.add(q, block.row[own], block.id[own], (v[own] @ one).astype(np.int64))
                i, step = i + step, step * 2


def top_k(vectors: DataFrame, *, every: int = 100, k: int = 10, scale: int = 1024, pivots: int = 24, sample: int = 2000, block: int = 8192, query_block: int = 4096, tasks: int = 64) -> DataFrame:
    """The k highest integer inner products of each query (vec_id divisible by `every`) with all other vectors.

    Vectors and queries are dealt into blocks by a hash, and each block is written once, with its pivot table, as a file that tasks map. A
    task takes a block of queries through a share of the blocks, nearest first, and carries each query's k-th score from block to block:
    blocks whose bounds lie below it are not opened. Only the best of each share are shuffled and merged. Ties go to the smaller
    vec_id. Exact.

    Which vectors take no part: see integer_vectors. Each row is a vector and, by its id, a query of its own, repeated ids too; only the
    query's own row is no candidate. A shorter vector counts as if zeros followed. Fewer than k others give fewer rows; an empty
    table gives an empty table; other columns are left out.

    Returns query_id long, rank int from 1, vec_id long, score long.
    """
    spark = vectors.sparkSession
    d = written(integer_vectors(vectors, scale), "vectors")
    is_query = F.col("vec_id") % every == 0
    width, n, asked = d.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*"), F.count_if(is_query)).first()
    width = max(width, 1)
    table = choose_pivots(d, pivots, sample, width)
    blocks, q_blocks = -(-n // block), -(-asked // query_block)
    folder = new_folder(spark, "pivot-index")

    def write(kind: str):
        def put(t: pa.Table) -> pa.Table:
            v = _matrix(t.column("v"), width)
            x = v.astype(np.float64)
            gaps = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (table**2).sum(1)[None] - 2 * x @ table.T, 0))
            number = t.column("block")[0].as_py()
            uri = f"{folder}/{kind}-{number}"
            put_file(uri, pack({"row": t.column("row").to_numpy(), "id": t.column("vec_id").fill_null(LAST).to_numpy(), "v": v.ravel(), "gaps": gaps.ravel()}))
            bounds = [*gaps.min(0), *gaps.max(0), (x**2).sum(1).max()]
            return pa.table({"block": pa.array([number], pa.int32()), "uri": [uri], "bounds": pa.array([bounds], pa.list_(pa.float64()))})

        return put

    def files(rows: DataFrame, kind: str, parts: int) -> list:
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(parts, 1))).cast("int")).groupBy("block")
        return written(dealt.applyInArrow(write(kind), "block int, uri string, bounds array<double>"), kind).orderBy("block").collect()  # one row a block

    index, asking = files(d, "index", blocks), files(d.filter(is_query), "queries", q_blocks)
    bounds = ship(spark, "pivot-bounds", pack({"bounds": np.array([r.bounds for r in index], np.float64).ravel(), "uris": np.frombuffer("\n".join(r.uri for r in index).encode() or b" ", np.uint8)}))
    shares = max(1, min(len(index), max(-(-len(index) // 64), tasks // max(len(asking), 1))))
    query_uris = [r.uri for r in asking]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = unpack(SparkFiles.get(bounds))
        uris, edges = bytes(a["uris"]).decode().split("\n"), a["bounds"].reshape(-1, 2 * len(table) + 1)
        for b in batches:
            for number in b.column("id").to_pylist():
                queries = Block(map_file(query_uris[number // shares]), width)
                own = np.arange(number % shares, len(uris), shares)
                lo, hi, norm = edges[own, : len(table)], edges[own, len(table) : -1], edges[own, -1]
                gap = np.maximum(np.maximum(lo[None] - queries.gaps[:, None], queries.gaps[:, None] - hi[None]), 0).max(2)
                most = (queries.norm[:, None] + norm[None] - gap**2) / 2
                most += 1 + 1e-9 * np.abs(most)
                best = Best(len(queries.id), k)
                for at in np.argsort(-most.max(0), kind="stable"):
                    if (most[:, at] >= best.least).any():
                        search(Block(map_file(uris[own[at]]), width), queries, best)
                size = [len(x) for x in best.id]
                columns = [np.repeat(queries.row, size), np.repeat(queries.id, size), np.concatenate(best.id), np.concatenate(best.score)]
                missing = np.concatenate(best.row) & 1 == 1
                yield pa.RecordBatch.from_arrays([pa.array(c, mask=missing if at == 2 else None) for at, c in enumerate(columns)], ["query_row", "query_id", "vec_id", "score"])

    n_tasks = len(asking) * shares if len(index) else 0
    found = spark.range(0, n_tasks, 1, max(n_tasks, 1)).mapInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").isNull(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
