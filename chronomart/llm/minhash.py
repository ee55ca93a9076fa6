"""Near duplicates: improved consistent weighted samples of TF-IDF shingles, banded, verified by weighted Jaccard similarity.

A shingle is five consecutive words; its weight is its count in the text times its inverse document frequency, ln(N / df) as a
share of ln(RARE), at most 1. Shingles in up to one of RARE documents thus weigh alike, and those in more are at most RARE times the
mean number of shingles a text, however many documents there are. Their frequencies are counted exactly over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import buffers, pack, semi_join, ship, slices, small_enough, unpack, written

WORDS, RARE, FLOOR = 5, 1000, 0.05
BANDS, ROWS = 10, 4
#: Shingles whose frequencies a task counts at once; members and bytes of text that are compared at once; members that all blocks of a bucket meet.
COUNTED, BLOCK, BLOCK_BYTES, LEADERS = 6_000_000, 512, 4 << 20, 8
#: Rows and bytes that numpy works on at a time.
SLICE = (250, 1 << 20)
#: Columns of one product of the matrices that give common weights.
COLUMNS = 2048
LEVELS = 1 << 16


def _gamma() -> np.ndarray:
    """The quantiles of Gamma(2, 1) in the middle of each of LEVELS equal steps, by bisection of its distribution 1 - (1 + x) exp(-x)."""
    want, low, high = (np.arange(LEVELS) + 0.5) / LEVELS, np.zeros(LEVELS), np.full(LEVELS, 40.0)
    for _ in range(50):
        x = (low + high) / 2
        under = 1 - (1 + x) * np.exp(-x) < want
        low, high = np.where(under, x, low), np.where(under, high, x)
    return (low + high) / 2


_RANDOM = np.random.default_rng(20240601)
_LETTER = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = _gamma()
_R, _LOG_C = _R.astype(np.float32), np.log(_R).astype(np.float32)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class _Powers:
    """Powers of an odd number modulo 2 ** 64, kept up to a bounded length."""

    def __init__(self, base: int) -> None:
        self.base, self.all = base, np.ones(1, np.uint64)

    def first(self, n: int) -> np.ndarray:
        out = self.all
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(self.base, len(out), 1 << 64))])
        if len(out) <= 1 << 22:
            self.all = out
        return out[:n]


_UP, _DOWN = _Powers(0x9E3779B97F4A7C15), _Powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(z: np.ndarray) -> np.ndarray:
    for _ in range(2):
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(32))


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of x[i] * base ** i before each place: a run's difference times base ** -start is its hash wherever it stands."""
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * _UP.first(len(x)), out=out[1:])
    return out


def word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words a text) of the texts data[cuts[k]:cuts[k + 1]], in UTF-8."""
    space, edge = _SPACE[data], np.zeros(len(data) + 1, bool)
    edge[cuts] = True
    first = np.flatnonzero(~space & (np.append(True, space[:-1])[: len(data)] | edge[:-1]))
    end = np.flatnonzero(~space & (np.append(space[1:], True)[: len(data)] | edge[1:])) + 1
    sums = _sums(_LETTER[data])
    return _mixed((sums[end] - sums[first]) * _DOWN.first(len(data))[first]), np.diff(np.searchsorted(first, cuts))


def count_shingles(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct shingles, by text and hash, and each text's number of words.

    A text of one to four words is one shingle; a text without words has none.
    """
    h, size = word_hashes(data, cuts)
    sums, end = _sums(h), np.cumsum(size)
    n = np.where(size > 0, np.maximum(size - WORDS + 1, 1), 0)
    stop = np.cumsum(n)
    text = np.repeat(np.arange(len(size)), n)
    first = np.repeat(end - size - (stop - n), n) + np.arange(len(text))
    last = np.minimum(first + WORDS, end[text])
    s = _mixed((sums[last] - sums[first]) * _DOWN.first(len(h))[first] + (last - first).astype(np.uint64))
    for i, j in zip((stop - n).tolist(), stop.tolist(), strict=True):
        s[i:j].sort()
    start = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (text[1:] != text[:-1]))[: len(s)])
    return text[start], s[start], np.diff(np.append(start, len(s))), size


class Table:
    """Numbers by shingle hash: a sorted array, and a bit by the hash's first bits, which answers for most of those that are absent."""

    def __init__(self, h: np.ndarray, value: np.ndarray) -> None:
        self.h, self.value = h, value
        self.shift = np.uint64(64 - min(24, max(12, (8 * len(h)).bit_length())))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[h >> self.shift] = True

    def find(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in s of hashes that the table has, their places in the table)."""
        maybe = np.flatnonzero(self.seen[s >> self.shift])
        at = np.minimum(np.searchsorted(self.h, s[maybe]), max(len(self.h) - 1, 0))
        hit = self.h[at] == s[maybe] if len(self.h) else np.zeros(0, bool)
        return maybe[hit], at[hit]


def idf_table(arrays: dict[str, np.ndarray]) -> Table:
    return Table(arrays["h"], arrays["w"])


_TABLES: dict[str, Table] = {}


def _shipped(name: str) -> Table:
    """The table of a shipped file, opened once by each Python worker."""
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = idf_table(unpack(SparkFiles.get(name)))
    return _TABLES[name]


def idf_of(s: np.ndarray, idf: Table) -> np.ndarray:
    """The weight of one occurrence: 1 for shingles that are in no table, FLOOR and a share of the rest for frequent ones."""
    out = np.ones(len(s))
    at, of = idf.find(s)
    out[at] = FLOOR + (1 - FLOOR) * idf.value[of]
    return out


def signatures(text: np.ndarray, s: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Improved consistent weighted sampling: for each of n texts BANDS * ROWS samples (shingle, level), hashed to 32 bits.

    For a shingle of weight w and each sample, r and c are Gamma(2, 1) and b is uniform, drawn from separate bits of a hash:
    t = floor(ln w / r + b), and the sample is the shingle with the least ln c - r (t - b + 1), with its t.
    """
    out = np.zeros((n, BANDS * ROWS), np.int32)
    if not len(s):
        return out
    start = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
    group, own = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(s)))), text[start]
    other = np.flatnonzero(weight != 1)  # elsewhere ln w is 0 and so is t
    lw, level = np.log(weight[other]).astype(np.float32), np.zeros(len(s), np.int64)
    for k in range(BANDS * ROWS):
        z = s * _MULTIPLY[k]
        r = _R.take((z >> np.uint64(48)).view(np.int64))
        c = _LOG_C.take((z >> np.uint64(32) & np.uint64(LEVELS - 1)).view(np.int64))
        b = (z & np.uint64(0xFFFFFFFF)).astype(np.float32) * np.float32(2**-32)
        if len(other):
            t = np.floor(lw / r[other] + b[other])
            level[other] = t
            b[other] -= t
        a = c + r * (b - 1)
        hit = np.flatnonzero(a == np.minimum.reduceat(a, start).take(group))
        best = hit[np.searchsorted(hit, start)]
        z = (s[best] ^ _MULTIPLY[k]) + level[best].view(np.uint64) * np.uint64(0xA0761D6478BD642F)
        out[own, k] = (_mixed(z) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def shingle_weights(docs: DataFrame) -> str:
    """Count in how many texts each frequent shingle stands, and ship the inverse document frequencies of those in over one of RARE.

    A first pass tells which can be frequent: of the N texts, a block of n passes on the shingles in n / (2 RARE) of its own or more. Those
    that it holds back have less than that in it, so the sums of what came bound each frequency from above; at most
    2 RARE times the mean number of shingles a text can reach N / RARE. A second pass counts these exactly. Blocks must
    be of several times 2 RARE texts to hold anything back, so smaller partitions are read together.
    """

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, total = [], 0, 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            often = n * (2 * RARE) >= docs
            h, n = h[often].view(np.int64), n[often]
            columns = [pa.concat_arrays([pa.array(h), pa.nulls(1, pa.int64())]), pa.array(np.append(n, docs)), pa.array(np.full(len(h) + 1, docs))]
            return pa.RecordBatch.from_arrays(columns, ["h", "n", "docs"])

        for b in slices(batches, *SLICE):
            _, s, _, size = count_shingles(*buffers(b, "text"))
            held.append(s)
            docs += int((size > 0).sum())
            total += len(s)
            if total > COUNTED:
                yield flush()
                held, docs, total = [], 0, 0
        if held:
            yield flush()

    spark = docs.sparkSession
    together = docs.select("text").coalesce(max(1, docs.count() // (8 * RARE)))
    proposed = together.mapInArrow(propose, "h long, n long, docs long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    proposed = written(proposed, "shingle-blocks")
    row = proposed.filter("h is null").first()
    total = row.n if row else 0
    may = proposed.filter("h is not null").filter(F.col("n") * (2 * RARE) >= F.col("docs") + total).select("h").toArrow()  # bounded, see above
    may = np.sort(may.column("h").to_numpy().view(np.uint64))
    if not len(may):
        return ship(spark, "idf", pack({"h": may, "w": np.zeros(0, np.float32)}))
    asked = ship(spark, "frequent", pack({"h": may, "w": np.zeros(len(may), np.float32)}))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _shipped(asked)
        n = np.zeros(len(table.h), np.int64)
        for b in slices(batches, *SLICE):
            _, s, _, _ = count_shingles(*buffers(b, "text"))
            n += np.bincount(table.find(s)[1], minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(table.h[at].view(np.int64)), pa.array(n[at])], ["h", "n"])

    counted = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") * RARE > total).toArrow()
    h, n = counted.column("h").to_numpy().view(np.uint64), counted.column("n").to_numpy()
    order = np.argsort(h)
    return ship(spark, "idf", pack({"h": h[order], "w": (np.log(total / n[order]) / np.log(RARE)).astype(np.float32)}))


def links(s: np.ndarray, weight: np.ndarray, row: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of n texts whose weighted Jaccard similarity reaches the threshold; (row, s) are occurrences, all of one hash weigh alike.

    The common weight of all pairs is a product of matrices over the occurrences that several texts have, a few columns at a time.
    """
    total = np.bincount(row, weight, n)
    order = np.argsort(s, kind="stable")
    s, weight, row = s[order], weight[order], row[order]
    start = np.append(True, s[1:] != s[:-1])[: len(s)]
    column = np.cumsum(start) - 1
    shared = np.bincount(column)[column] > 1 if len(s) else start
    weight, row, column = weight[shared], row[shared], np.cumsum(start[shared]) - 1
    common = np.zeros((n, n))
    cuts = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else -1) + 1 + COLUMNS, COLUMNS))
    for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
        m = np.zeros((n, COLUMNS))
        m[row[i:j], column[i:j] - k * COLUMNS] = np.sqrt(weight[i:j])
        common += m @ m.T
    union = total[:, None] + total[None] - common
    a, b = np.nonzero(common >= threshold * union - 1e-9)
    return a[a < b], b[a < b]


def _occurrences(data: np.ndarray, cuts: np.ndarray, idf: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of every occurrence of a shingle; the second, third ... in a text have hashes of their own."""
    text, s, tf, _ = count_shingles(data, cuts)
    w = idf_of(s, idf)
    again = np.arange(int(tf.sum())) - np.repeat(np.cumsum(tf) - tf, tf)
    return np.repeat(text, tf), np.repeat(s, tf) + again.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25), np.repeat(w, tf)


def weighted_jaccard(left: list[bytes], right: list[bytes], idf: dict[str, np.ndarray]) -> np.ndarray:
    """The weighted Jaccard similarity of the shingles of left[k] and right[k]; 0 where neither has words."""
    table, out = idf_table(idf), []
    for a, b in zip(left, right, strict=True):
        text, s, w = _occurrences(np.frombuffer(a + b, np.uint8), np.array([0, len(a), len(a) + len(b)]), table)
        common = w[text == 0][np.isin(s[text == 0], s[text == 1])].sum()
        out.append(common / (w.sum() - common) if len(w) else 0.0)
    return np.array(out)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups, one after the other, of rows sorted by group."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        group = b.column("group").to_numpy()
        cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), b.num_rows]
        if held and held[-1].column("group")[0].as_py() != group[0]:
            yield pa.concat_batches(held)
            held = []
        for i, j in zip(cuts, cuts[1:], strict=False):
            if held and i:
                yield pa.concat_batches(held)
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield pa.concat_batches(held)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each of n members' component under the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(rows: DataFrame, idf: str, threshold: float) -> DataFrame:
    """Links (a, b) that span what is alike in each group of rows (group long, node, text, own): pairs with an own member are compared."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, a_out, b_out = _shipped(idf), [], []
        for g in _groups(batches):
            parts, before = [], 0
            for b in slices([g], *SLICE):
                text, s, w = _occurrences(*buffers(b, "text"), table)
                parts.append((text + before, s, w))
                before += b.num_rows
            row, s, w = (np.concatenate(x) for x in zip(*parts, strict=True))
            own = g.column("own").to_numpy(zero_copy_only=False)
            a, b = links(s, w, row, g.num_rows, threshold)
            root = _roots(*(x[own[a] | own[b]] for x in (a, b)), g.num_rows)
            at = np.flatnonzero(root != np.arange(len(root)))
            node = g.column("node")
            a_out += node.take(pa.array(root[at])).to_pylist()
            b_out += node.take(pa.array(at)).to_pylist()
            if len(a_out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.string()), pa.array(b_out, pa.string())], ["a", "b"])
                a_out, b_out = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.string()), pa.array(b_out, pa.string())], ["a", "b"])

    dealt = rows.repartition("group").sortWithinPartitions("group")
    return dealt.mapInArrow(compare, "a string, b string").filter("a <> b")


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (a, b): smallest labels spread along edges, and labels of labels, until none changes."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("low"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("component").alias("old"), F.least("component", "low").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        step = step.join(jump, "component", "left").select("node", "old", F.least("component", "next").alias("component"))
        step = written(step, "labels")
        labels = step.select("node", "component")
        if not step.filter("component <> old").limit(1).count():
            return labels


def _buckets(sigs: DataFrame) -> DataFrame:
    """(bucket, n, blocks, node, size): members of the buckets of two nodes or more; of buckets with the same members one stays."""
    keys = F.array(*[F.xxhash64(F.lit(k), *[F.get("sig", k * ROWS + j) for j in range(ROWS)]) for k in range(BANDS)])
    banded = sigs.select("node", "size", F.explode(keys).alias("bucket"))
    of = banded.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")
    )
    of = of.filter("n > 1").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"), F.first("bytes").alias("bytes"))
    of = of.select("bucket", "n", _blocks(F.col("n"), F.col("bytes")).alias("blocks"))
    return banded.join(of, "bucket")


def _blocks(n: Column, size: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")


def _block(blocks: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(2), "node"), F.col(blocks)).cast("int")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _id and _node (the digest of the text), which are the key of a row here, and _words (whether the text has any)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"_id": F.col("doc_id").cast("long"), "_node": F.md5(text.cast("binary")), "_words": text.rlike(r"[^\x20\x09-\x0D]")})


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """The class of each document: texts linked, directly or over others, by a similarity of at least the threshold.

    Equal texts are one node. Nodes that share a band fall into a bucket, whose members are compared in blocks: first within each
    block and with a few leaders that all blocks of the bucket meet. Whoever is then not in the bucket's largest class is compared with
    the members of all its blocks. So each two nodes of a bucket are compared, on their whole texts, unless they are of one class
    already; tasks emit links that span what is alike, not pairs. Pairs at the threshold miss every band with
    probability (1 - 0.8 ** ROWS) ** BANDS = 0.005.

    Texts without words (null and empty ones too) link to nothing; texts of under five words link by equal word
    sequences; a null id is a document like others and sorts first; repeated rows give repeated rows; other columns
    are left out; an empty table gives an empty table.

    Returns doc_id, class_id (the smallest doc_id of the class; the document's own where it is alone), class_size long,
    keep boolean (one row of each class: the one with the smallest doc_id).
    """
    return _classes(docs, threshold).drop("node")


def _sign(docs: DataFrame, idf: str) -> DataFrame:
    """(doc_id, node, size in bytes, sig, words) of docs (doc_id, node, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _shipped(idf)
        for b in slices(batches, *SLICE):
            data, cuts = buffers(b, "text")
            text, s, tf, words = count_shingles(data, cuts)
            sig = signatures(text, s, tf * idf_of(s, table), b.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, BANDS * ROWS, dtype=np.int32)), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("node"), pa.array(np.diff(cuts)), lists, pa.array(words > 0)], ["doc_id", "node", "size", "sig", "words"])

    return docs.mapInArrow(sign, "doc_id long, node string, size long, sig array<int>, words boolean")


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """The rows of near_duplicates with node, the digest of the text."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("node", F.md5(F.col("text").cast("binary")))
    idf = shingle_weights(d)
    rows = written(_sign(d, idf), "signatures")
    sigs = rows.filter("words").groupBy("node").agg(F.first("sig").alias("sig"), F.first("size").alias("size"))
    members = written(_buckets(written(sigs, "nodes")), "buckets")
    texts = written(semi_join(d.select("node", "text"), written(members.select("node").distinct(), "members"), "node").groupBy("node").agg(F.first("text").alias("text")), "texts")

    leads = (F.col("blocks") > 1) & (F.pmod(F.xxhash64(F.lit(3), "node"), F.col("n")) < LEADERS)
    first = members.withColumn("block", _block("blocks"))
    first = first.withColumn("at", F.explode(F.when(leads, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    first = first.select(F.xxhash64("bucket", "at").alias("group"), "node", (F.col("at") == F.col("block")).alias("own"))
    edges = written(_compare(first.join(texts, "node").select("group", "node", "text", "own"), idf, threshold), "links")

    large = members.filter("blocks > 1")
    if large.limit(1).count():
        large = large.join(connected(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
        large = written(large.select("bucket", "blocks", "node", "size", "component"), "large-buckets")
        main = large.groupBy("bucket", "component").count().groupBy("bucket").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
        rest = large.join(main, "bucket").filter("component <> main")
        turns = rest.groupBy("bucket").agg(_blocks(F.count("*"), F.sum("size")).alias("turns"))
        rest = rest.join(turns, "bucket").select("bucket", _block("turns").alias("turn"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at"), "node", F.lit(True).alias("own"))
        every = large.join(turns, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), _block("blocks").alias("at"), "node", F.lit(False).alias("own"))
        second = rest.union(every).select(F.xxhash64("bucket", "turn", "at").alias("group"), "node", "own")
        more = written(_compare(second.join(texts, "node").select("group", "node", "text", "own"), idf, threshold), "links")
        edges = edges.union(more)
    labels = connected(edges)

    lone = F.concat_ws(":", F.lit("row"), F.monotonically_increasing_id())
    out = rows.select("doc_id", "node", "words").join(labels, "node", "left")
    out = out.withColumn("class", F.when(F.col("words"), F.coalesce("component", "node")).otherwise(lone)).select("doc_id", "node", "class", F.monotonically_increasing_id().alias("row"))
    out = written(out, "classes")
    first = out.groupBy("class").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("class_size")).filter("class_size > 1")
    first = written(first, "first")
    joined = out.join(F.broadcast(first) if small_enough(first, 200_000) else first, "class", "left")
    alone = F.col("class_size").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        (alone | F.struct("doc_id", "row").eqNullSafe(F.col("first"))).alias("keep"), "node",
    )


def drop_near_duplicates(docs: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that near_duplicates keeps.

    A row is known by its id and text, so different texts with a null or shared id are rows of their own. Of rows equal in both, which
    are of one class, the first by its columns stays; rows without words are each alone in a class, and all stay.
    """
    kept = _classes(docs, threshold).filter("keep").select("doc_id", "node").toDF("_kept", "_text").distinct()
    rows = _keyed(docs)
    worded = rows.filter("_words")
    worded = worded.join(kept, (worded["_node"] == kept["_text"]) & worded["_id"].eqNullSafe(kept["_kept"]), "left_semi")
    one = worded.groupBy("_id", "_node").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return one.unionByName(rows.filter("not _words").select(*docs.columns))
