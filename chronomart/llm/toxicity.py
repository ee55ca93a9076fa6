"""Toxicity by non-negative positive-unlabelled learning over hashed words and word beginnings."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._shared import as_doc_text, pack, ship, slices, unpack, written

DIMENSIONS = 1 << 20
REMEMBERED = 100_000
WORD = re.compile(r"[^\W\d_]+")
SPACED = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))  # ASCII without letters is no part of a word


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def hashed(word: str) -> list[int]:
    """The features of a word: itself and its first four and five letters."""
    raw = (f"w{word}", f"4{word[:4]}", f"5{word[:5]}")
    return [zlib.crc32(x.encode()) % DIMENSIONS for x in raw]


class Remembered(dict):
    """What a function gives for each word, kept."""

    def __init__(self, of: Callable[[str], object]) -> None:
        self.of = of

    def __missing__(self, word: str) -> object:
        out = self[word] = self.of(word)
        return out


def words_of(text: str) -> set[str]:
    """The distinct matches of WORD in lower case; only pieces that are not ASCII need the expression."""
    found = set(text.lower().encode("utf-8", "surrogatepass").translate(SPACED).decode("utf-8", "surrogatepass").split())
    if odd := [w for w in found if not w.isascii()]:
        found.difference_update(odd)
        found.update(WORD.findall(" ".join(odd)))
    return found


def nn_risk(z: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative PU risk of logits z with logistic loss, and the direction of the step by z.

    The risk is prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)). Where the second part is negative, the direction
    is against its gradient, which brings it back, and not along the risk's.
    """
    n_p, n_u = max(int(positive.sum()), 1), max(int((~positive).sum()), 1)
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    rest = np.logaddexp(0, z[~positive]).sum() / n_u - prior * np.logaddexp(0, z[positive]).sum() / n_p
    g_rest = np.where(positive, -prior / n_p * s, s / n_u)
    g = g_rest + np.where(positive, prior / n_p * (s - 1), 0) if rest >= 0 else -g_rest
    return prior * np.logaddexp(0, -z[positive]).sum() / n_p + max(0.0, rest), g


def nnpu(rows: list[np.ndarray], positive: np.ndarray, size: int, prior: float, *, steps: int = 300, rate: float = 0.05, decay: float = 5e-4) -> tuple[np.ndarray, float]:
    """Weights of `size` features and bias of a linear classifier of rows (lists of features) that minimises the non-negative PU risk (full-batch Adam)."""
    row, column = np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64)
    w, b = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        _, g = nn_risk(np.bincount(row, w[column], minlength=len(rows)) + b, positive, prior)
        gw = np.bincount(column, g[row], minlength=len(w)) + decay * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        k = rate / (1 - 0.9**t)
        w -= k * m / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
        b -= k * mb / (np.sqrt(vb / (1 - 0.999**t)) + 1e-6)
    return w, float(b)


def _features(docs: DataFrame, candidates: str | None = None) -> DataFrame:
    """features binary: the distinct 32-bit features of each text, or their places in a shipped sorted array, where those it lacks are left out."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {int(f): i for i, f in enumerate(unpack(SparkFiles.get(candidates))["features"])} if candidates else None
        begins = Remembered(lambda x: place.get(zlib.crc32(x.encode()) % DIMENSIONS))
        known = Remembered(hashed if place is None else lambda w: tuple([f for f in (place.get(zlib.crc32(f"w{w}".encode()) % DIMENSIONS), begins["4" + w[:4]], begins["5" + w[:5]]) if f is not None]))
        for b in slices(batches, 500, 2 << 20):
            out = []
            for t in b.column("text").to_pylist():
                if len(known) > REMEMBERED:
                    known.clear()
                    begins.clear()
                found = set(chain.from_iterable(map(known.__getitem__, words_of(t or ""))))
                out.append(np.array(sorted(found), np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["features"])

    return docs.select("text").mapInArrow(extract, "features binary")


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[np.ndarray]]:
    held: list[np.ndarray] = []
    for b in batches:
        for raw in b.column("features").to_pylist():
            held.append(np.frombuffer(raw, np.int32))
            if len(held) == size:
                yield held
                held = []
    if held:
        yield held


def train_toxicity(docs: DataFrame, labels: DataFrame, *, positives: int = 2000, chunk: int = 6000, ratio: float = 2.5, least: int = 3) -> tuple[np.ndarray, float]:
    """Fit on confirmed toxic documents (at most `positives`, the first by a hash of the id) and on all unlabelled text.

    Only rows with crc32(doc_id) mod 4 other than 2 take part. The prior is the share of toxic rows among those labelled. Features that at
    least `least` positives have are counted over all unlabelled texts; those that positives have at least `ratio` times as often, or as seldom, enter,
    the others weigh zero. Each chunk of at most `chunk` unlabelled texts is set against the positives, and the model is the mean of
    the chunks' models by their sizes: every text counts, and no task or driver holds more than one chunk and the positives.
    """
    ours = labels.filter((fold(F.col("doc_id"), 4) != 2) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    ours = ours.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    prior = ours.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    prior = min(max(prior or 0.0, 1e-3), 0.9)
    docs = as_doc_text(docs)
    toxic = ours.filter("toxic = 1").orderBy(F.xxhash64("doc_id")).limit(positives).select("doc_id")  # bounded, so the broadcast is too
    held = [np.frombuffer(r.features, np.int32) for r in _features(docs.join(F.broadcast(toxic), "doc_id")).collect()]
    in_p = np.bincount(np.concatenate([*held, np.zeros(0, np.int32)]), minlength=DIMENSIONS)
    candidates = np.flatnonzero(in_p >= least)
    spark, none = docs.sparkSession, (np.zeros(DIMENSIONS), float(np.log(prior / (1 - prior))))
    if not len(candidates):
        return none
    name = ship(spark, "candidates", pack({"features": candidates}))
    training = docs.filter((fold(F.col("doc_id"), 4) != 2) & F.col("doc_id").isNotNull())
    unlabelled = written(_features(training, name), "unlabelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs = np.zeros(len(candidates), np.int64), 0
        for rows in _chunks(batches, 1000):
            n += np.bincount(np.concatenate(rows), minlength=len(n))
            docs += len(rows)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[at], docs))], ["i", "n"])

    counted = {r.i: r.n for r in unlabelled.mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}  # one row a candidate
    n_u = counted.pop(-1, 0)
    in_u = np.zeros(len(candidates))
    in_u[list(counted)] = list(counted.values())
    share = (in_p[candidates] + 0.5) / (len(held) + 1) / ((in_u + 0.5) / (n_u + 1))
    used = np.flatnonzero((share >= ratio) | (share <= 1 / ratio))
    place = np.full(len(candidates), -1, np.int32)
    place[used] = np.arange(len(used))
    of = lambda r: (x := place[r])[x >= 0]
    at_candidates = [of(np.searchsorted(candidates, r[in_p[r] >= least])) for r in held]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(len(used) + 1), 0
        for rows in _chunks(batches, chunk):
            positive = np.arange(len(held) + len(rows)) < len(held)
            w, b = nnpu([*at_candidates, *map(of, rows)], positive, len(used), prior)
            total += len(rows) * np.append(w, b)
            docs += len(rows)
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), docs))], ["i", "w", "n"])

    # small partitions are read together, so that chunks are whole ones
    models = unlabelled.coalesce(max(1, n_u // chunk)).mapInArrow(fit, "i long, w double, n long").groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w")).collect()
    if not models:
        return none
    found = np.zeros(len(used) + 1)
    found[[r.i for r in models]] = [r.w for r in models]
    out = np.zeros(DIMENSIONS)
    out[candidates[used]] = found[:-1]
    return out, float(found[-1])


def score_toxicity(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """Probability that each whole text is toxic: the sigmoid of the bias and the weights of its distinct words.

    Null and empty texts, and texts without letters, get the bias alone; each row is scored by its text only; repeated
    rows get equal scores; an empty table gives an empty table. Returns docs' columns (a clashing score goes) and score double.
    """
    keep = [c for c in docs.columns if c.lower() != "score"]
    docs = docs.select(*keep)
    name = ship(docs.sparkSession, "toxicity", pack({"w": weights.astype(np.float64), "b": np.array([bias])}))
    at = [c.lower() for c in keep].index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unpack(SparkFiles.get(name))
        w, b0 = model["w"], float(model["b"][0])
        at_all = np.flatnonzero(w)
        weight = dict(zip(at_all.tolist(), w[at_all].tolist(), strict=True)).get
        begins = Remembered(lambda x: weight(zlib.crc32(x.encode()) % DIMENSIONS, 0.0))
        known = Remembered(lambda x: weight(zlib.crc32(f"w{x}".encode()) % DIMENSIONS, 0.0) + begins["4" + x[:4]] + begins["5" + x[:5]])
        for b in slices(batches, 500, 2 << 20):
            out = []
            for t in b.column(at).to_pylist():
                if len(known) > REMEMBERED:
                    known.clear()
                    begins.clear()
                z = sum(map(known.__getitem__, words_of(t or "")))
                out.append(z + b0)
            p = 1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -700, 700)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], [*b.schema.names, "score"])

    return docs.mapInArrow(score, StructType([*docs.schema, StructField("score", DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, positives: int = 2000, chunk: int = 6000) -> DataFrame:
    """Train and score in one call; adds score, held_out and predicted (1 from the threshold on) to docs.

    Columns of docs with these names, in any case, are replaced. A null id is in the fold of an empty text and never trains.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("held_out", "predicted")])
    w, b = train_toxicity(docs, labels, positives=positives, chunk=chunk)
    return score_toxicity(docs, w, b).withColumns({"held_out": fold(F.col("doc_id"), 4) == 2, "predicted": (F.col("score") >= threshold).cast("int")})
