"""An interpolated modified Kneser-Ney model of bigrams or trigrams, counted in Spark and kept in sorted arrays that workers map.

The vocabulary is a sorted array of 64-bit word hashes. The most frequent words have small ids by rank, others a number after these by their
place. N-grams lie in shards, sorted: contexts, where each context's words begin, and the words with their counts. A trigram's shard
goes by its first two words, a bigram's by its first; the bigrams of a first word with very many tokens are dealt over several
shards, and its sums are added up. Below trigrams, a bigram's count is the number of words seen before it; only bigrams at a text's
start, which nothing precedes, keep their own. Blocks are counted with numpy in tasks, and only counted, packed blocks are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import map_file, new_folder, pack, put_file, slices, texts, written

#: Tokens that a task counts before it passes a block on, tokens a shard, vocabulary entries a file, and words that have ids by rank.
BLOCK, SHARD, RANGE, RANKED = 3_000_000, 4_000_000, 1_000_000, 1 << 15
END = xxhash.xxh64_intdigest(b"")


def fold(doc_id: Column, parts: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words and the end, the place among them of each token, tokens a text); texts end with the end."""
    words: list[bytes] = []
    sizes = []
    for t in texts(batch):
        own = t.lower().split()
        words += own
        words.append(b"")
        sizes.append(len(own) + 1)
    coded = pa.array(words, pa.binary()).dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary)).view(np.int64)
    return hashes, coded.indices.to_numpy().astype(np.int64), np.array(sizes, np.int64)


def _count_words(docs: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_h, held_n, total = [], [], 0

        def flush() -> pa.RecordBatch:
            h, at = np.unique(np.concatenate(held_h), return_inverse=True)
            n = np.bincount(at, np.concatenate(held_n), minlength=len(h)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

        for b in slices(batches):
            h, code, _ = _tokens(b)
            held_h.append(h)
            held_n.append(np.bincount(code, minlength=len(h)))
            total += len(h)
            if total > BLOCK:
                yield flush()
                held_h, held_n, total = [], [], 0
        if held_h:
            yield flush()

    return docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Mapped files of (sorted hashes, counts, ranks), in order of their first hash."""

    def __init__(self, files: list[tuple[int, int, str]], ranked: int) -> None:
        self.first = np.array([f[0] for f in files], np.int64)
        self.offset = np.cumsum([ranked, *(f[1] for f in files)])
        self.uris, self.open = [f[2] for f in files], {}

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of hashes; -1 and 0 where unknown."""
        ids, n = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        order = np.argsort(hashes)
        cuts = [*np.searchsorted(hashes[order], self.first).tolist(), len(hashes)]
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if lo < hi:
                a = self.open.get(k) or self.open.setdefault(k, map_file(self.uris[k]))
                own = order[lo:hi]
                at = np.minimum(np.searchsorted(a["h"], hashes[own]), len(a["h"]) - 1)
                hit = a["h"][at] == hashes[own]
                own, at = own[hit], at[hit]
                rank = a["rank"][at].astype(np.int64)
                ids[own] = np.where(rank >= 0, rank, at + self.offset[k])
                n[own] = a["n"][at]
        return ids, n


def _write_vocabulary(counted: DataFrame, folder: str, files: int, ranked: np.ndarray) -> list[tuple[int, int, str]]:
    """Write the words in ranges of their hashes; ranked holds the hashes of the words that have ids by rank."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("h").to_numpy(), b.column("n").to_numpy()) for b in batches if b.num_rows]
        if parts:
            h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            rank, order = np.full(len(h), -1, np.int32), np.argsort(ranked)
            at = np.minimum(np.searchsorted(h, ranked[order]), len(h) - 1)
            hit = h[at] == ranked[order]
            rank[at[hit]] = order[hit]
            uri = f"{folder}/vocabulary-{int(h[0])}"
            put_file(uri, pack({"h": h, "n": n, "rank": rank}))
            yield pa.RecordBatch.from_arrays([pa.array([int(h[0])], pa.int64()), pa.array([len(h)], pa.int64()), pa.array([uri])], ["first", "size", "uri"])

    rows = counted.repartitionByRange(files, "h").sortWithinPartitions("h").mapInArrow(write, "first long, size long, uri string").collect()
    return sorted((r[0], r[1], r[2]) for r in rows)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Non-negative whole numbers for the shuffle: byte by byte of equal weight, as many as the largest needs, compressed."""
    head, body = [], []
    for a in arrays:
        width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
        head.append(len(a).to_bytes(8, "little") + bytes([width]))
        body.append(np.ascontiguousarray(np.ascontiguousarray(a, np.int64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    raw = b"".join(head + body)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unsqueeze(block: bytes, count: int) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(block[8:], int.from_bytes(block[:8], "little"), asbytes=True)
    at, out = 9 * count, []
    for k in range(count):
        n, width = int.from_bytes(raw[9 * k : 9 * k + 8], "little"), raw[9 * k + 8]
        own = np.zeros((n, 8), np.uint8)
        own[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        out.append(own.view(np.int64).ravel())
        at += n * width
    return out


def _fold(c: np.ndarray, w: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, word), sorted, and the sums of their counts (1 each where n is None)."""
    order = np.lexsort((w, c))
    c, w = c[order], w[order]
    start = np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (w[1:] != w[:-1]))[: len(c)])
    sums = np.diff(np.append(start, len(c))) if n is None else np.add.reduceat(n[order], start) if len(start) else n
    return c[start], w[start], sums


def _block(c: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """A counted block of sorted n-grams: contexts once, by steps of their first id."""
    own, size = np.unique(c, return_counts=True)
    return squeeze(np.diff(own >> 32, prepend=0), own & 0xFFFFFFFF, size, w, n)


def _unblock(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, v, size, w, n = unsqueeze(block, 5)
    return np.repeat(np.cumsum(u) << 32 | v, size), w, n


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _fold(*map(np.concatenate, zip(*(_unblock(x) for x in table.column("block").to_pylist()), strict=True)))


def _hash(x: np.ndarray) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its rows) of the shards that have rows, whatever their number."""
    order = np.argsort(shard, kind="stable")
    own = shard[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
    yield from zip(own[first].tolist(), np.split(order, first[1:]), strict=True) if len(own) else ()


class Spread:
    """The shard of each bigram: by its first word, and by its second too where the first is frequent (ids below len(ways), or the start)."""

    def __init__(self, shards: int, ways: np.ndarray, start: int, start_ways: int) -> None:
        self.shards, self.ways, self.start, self.start_ways = shards, ways, start, start_ways

    def many(self, v: np.ndarray) -> np.ndarray:
        k = np.ones(len(v), np.int64)
        few = (v >= 0) & (v < len(self.ways))
        k[few] = self.ways[v[few]]
        k[v == self.start] = self.start_ways
        return k

    def __call__(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (_hash(v) + _hash(w + 1) % self.many(v)) % self.shards


def _narrow(name: str, x: np.ndarray) -> dict[str, np.ndarray]:
    """Numbers below 2 ** 32 in two or three bytes where that is enough: their low and high parts."""
    high = x >> 16
    return {f"{name}.low": (x & 0xFFFF).astype(np.uint16), f"{name}.high": high.astype(np.uint8 if high.max(initial=0) < 256 else np.uint16)}


def _wide(a: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    return a[f"{name}.high"][at].astype(np.int64) << 16 | a[f"{name}.low"][at]


def _level(c: np.ndarray, w: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a shard: first ids, their second ids, the words of each context, counts; sums for contexts of several words."""
    own, first, size = np.unique(c, return_index=True, return_counts=True)
    u, at = np.unique(own >> 32, return_index=True)
    many, large = np.flatnonzero(size > 1), np.flatnonzero(n >= 255)
    sums = lambda x: np.add.reduceat(np.append(x, 0), first, dtype=np.int64)[many] if len(first) else many
    return {
        "u": u, "second": np.append(at, len(own)).astype(np.uint32), **_narrow("v", own & 0xFFFFFFFF), "first": np.append(first, len(c)).astype(np.uint32), **_narrow("w", w),
        "n": np.minimum(n, 255).astype(np.uint8), "large": large.astype(np.uint32), "count": n[large], "many": many.astype(np.uint32), "total": sums(n),
        **{f"n{k}": sums(n == k if k < 3 else n >= 3).astype(np.uint32) for k in (1, 2, 3)},
    }


def _search(a: dict[str, np.ndarray], name: str, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, whether found) of numbers in sorted stretches of an array."""
    end = hi
    while (lo < hi).any():
        mid = (lo + hi) >> 1
        less = (lo < hi) & (_wide(a, name, np.minimum(mid, end - 1)) < want)
        lo, hi = np.where(less, mid + 1, lo), np.where(less | (lo >= hi), hi, mid)
    place = np.minimum(lo, end - 1)
    return place, (lo < end) & (_wide(a, name, place) == want)


def _counts(a: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    n = a["n"][at].astype(np.int64)
    large = np.flatnonzero(n == 255)
    n[large] = a["count"][np.searchsorted(a["large"], at[large])]
    return n


def _read_level(a: dict[str, np.ndarray], c: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the count of each n-gram, the sum of counts of its context, the numbers of words with counts of 1, 2 and 3 or more there); 0 where unseen."""
    out = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64), np.zeros((3, len(c)), np.int64)
    at = np.minimum(np.searchsorted(a["u"], c >> 32), len(a["u"]) - 1)
    own = np.flatnonzero(a["u"][at] == c >> 32)
    context, seen = _search(a, "v", *(a["second"][at[own] + k].astype(np.int64) for k in (0, 1)), c[own] & 0xFFFFFFFF)
    own, context = own[seen], context[seen]
    if not len(own):
        return out
    lo, hi = (a["first"][context + k].astype(np.int64) for k in (0, 1))
    place, found = _search(a, "w", lo, hi, w[own])
    out[0][own[found]] = _counts(a, place[found])
    one = hi - lo == 1
    only = _counts(a, lo[one])
    out[1][own[one]] = only
    out[2][np.minimum(only, 3) - 1, own[one]] = 1
    j = np.searchsorted(a["many"], context[~one].astype(np.uint32))
    out[1][own[~one]] = a["total"][j]
    out[2][:, own[~one]] = [a[f"n{k}"][j] for k in (1, 2, 3)]
    return out


def _discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """The discounts for counts of 0, 1, 2 and 3 or more (Chen and Goodman), with fixed ones where counts are too few."""
    if min(n1, n2, n3) == 0:
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.array([0, *np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0.05, 0.1, 0.15], [0.95, 1.95, 2.95])])


class Model:
    """What workers need to score: files and constants. Built by train(), sent in a task's closure (some hundred kilobytes at most)."""

    def __init__(self, **fields) -> None:
        self.__dict__ |= fields


def train(docs: DataFrame, *, order: int = 2) -> Model:
    """Count words and n-grams up to the order (2 or 3) of all texts of docs and write the model into the shared folder."""
    if order not in (2, 3):
        raise ValueError(f"order {order}: models are of bigrams or trigrams")
    spark = docs.sparkSession
    folder = new_folder(spark, "lm")
    counted = written(_count_words(docs), "lm-words")
    size = counted.agg(F.count("*"), F.sum("n"), *[F.count_if(F.col("n") >= (1 << k)) for k in range(48)]).first()
    words, tokens = size[0], size[1] or 0
    least = next((1 << k for k in range(48) if size[2 + k] <= RANKED), 1 << 48)
    top = counted.filter(F.col("n") >= least).orderBy(F.desc("n"), "h").toArrow()  # at most RANKED rows
    ranked, often = top.column("h").to_numpy(), top.column("n").to_numpy()
    files = _write_vocabulary(counted, folder, max(1, -(-words // RANGE)), ranked)
    shards = max(1, -(-tokens // SHARD))
    start = len(ranked) + words
    ranges = -(-(start + 1) // RANGE)
    share = max(SHARD // 8, tokens // 4096)  # at most 4096 words have more tokens
    ends = int(often[ranked == np.array([END], np.uint64).view(np.int64)[0]].sum())
    spread = Spread(shards, -(-often[often > share] // share), start, max(1, -(-ends // share)))
    split = lambda v: spread.many(v) > 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, held, total = Vocabulary(files, len(ranked)), [], 0

        def flush() -> pa.RecordBatch:
            u, v, w = (np.concatenate(x) for x in zip(*held, strict=True))
            two = u < 0 if order == 3 else np.ones(len(w), bool)
            c, x, n = _fold(v[two], w[two])
            parts = [(2, k, _block(c[own], x[own], n[own])) for k, own in _by_shard(spread(c, x))]
            if order == 3:
                c, x, n = _fold(u[~two] << 32 | v[~two], w[~two])
                parts += [(3, k, _block(c[own], x[own], n[own])) for k, own in _by_shard(_hash(c) % shards)]
            level, shard, block = zip(*parts, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(level, pa.int32()), pa.array(shard, pa.int32()), pa.array(block, pa.binary())], ["level", "shard", "block"])

        for b in slices(batches):
            h, code, sizes = _tokens(b)
            ids, _ = v.find(h)
            w = ids[code]
            held.append((*_before(w, sizes, start), w))
            total += len(w)
            if total > BLOCK:
                yield flush()
                held, total = [], 0
        if held:
            yield flush()

    kinds = "level int, shard int, block binary"

    def rows(names: str, parts: list[tuple]) -> pa.Table:
        columns = zip(*parts, strict=True)
        return pa.table({name: pa.array(x, pa.binary() if name == "block" else pa.int32()) for name, x in zip(names.split(" "), columns, strict=True)})

    def statistics(n: np.ndarray) -> bytes:
        return np.array([len(n), *((n == k).sum() for k in (1, 2, 3, 4))], np.int64).tobytes()

    def lower(table: pa.Table) -> pa.Table:
        """Write a shard of trigrams; give its bigrams, counted by the words before them, and its statistics (as level -3)."""
        level, shard = table.column("level")[0].as_py(), table.column("shard")[0].as_py()
        if level != 3:
            return table.select(["level", "shard", "block"])
        c, w, n = _gathered(table)
        put_file(f"{folder}/trigrams-{shard}", pack(_level(c, w, n)))
        v, x, types = _fold(c & 0xFFFFFFFF, w)
        return rows("level shard block", [(-3, shard, statistics(n)), *((2, k, _block(v[at], x[at], types[at])) for k, at in _by_shard(spread(v, x)))])

    def merge(table: pa.Table) -> pa.Table:
        """Write a shard of bigrams; give its words' continuation counts, its statistics (part -1) and the sums of split first words (-2)."""
        if table.column("level")[0].as_py() == -3:
            return pa.table({"part": pa.array([-3], pa.int32()), "shard": table.column("shard"), "block": table.column("block")})
        v, w, n = _gathered(table)
        shard = table.column("shard")[0].as_py()
        put_file(f"{folder}/bigrams-{shard}", pack(_level(v, w, n)))
        own, first = np.unique(v, return_index=True)
        sums = [np.add.reduceat(x, first, dtype=np.int64)[split(own)] for x in (n, n == 1, n == 2, n >= 3)]
        x, types = np.unique(w, return_counts=True)
        parts = [(k, shard, squeeze(x[at], types[at])) for k, at in _by_shard(x // RANGE)]
        return rows("part shard block", [(-1, shard, statistics(n)), (-2, shard, squeeze(own[split(own)], *sums)), *parts])

    def finish(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        cont = np.zeros(min(RANGE, start + 1 - part * RANGE), np.int64)
        for x in table.column("block").to_pylist():
            w, n = unsqueeze(x, 2)
            cont[w - part * RANGE] += n
        put_file(f"{folder}/continuations-{part}", pack({"n": cont}))
        stats = np.array([(cont == c).sum() for c in (1, 2, 3, 4)] + [(cont >= 3).sum()], np.int64)
        return pa.table({"part": pa.array([part], pa.int32()), "block": pa.array([stats.tobytes()], pa.binary())})

    # shards are of constant size, so the partitions they are dealt over grow with their number: a task reads a few, at any size of input
    grouped = lambda d: d.repartition(4 * shards, "level", "shard").groupBy("level", "shard")
    blocks = docs.select("text").mapInArrow(count, kinds)
    if order == 3:
        blocks = grouped(blocks).applyInArrow(lower, kinds)
    merged = written(grouped(blocks).applyInArrow(merge, "part int, shard int, block binary"), "lm-continuations")
    of = lambda part: merged.filter(F.col("part") == part).collect()  # noqa: E731  # one row a shard
    seen, tri = of(-1), of(-3)
    own = written(merged.filter("part >= 0").groupBy("part").applyInArrow(finish, "part int, block binary"), "lm-parts").collect()
    add = lambda found: sum((np.frombuffer(r.block, np.int64) for r in found), np.zeros(5, np.int64))
    big, one, three = add(seen), add(own), add(tri)
    split_sums: dict[int, np.ndarray] = {}
    for r in of(-2):
        for v, *x in zip(*unsqueeze(r.block, 5), strict=True):
            split_sums[int(v)] = split_sums.get(int(v), np.zeros(4, np.int64)) + np.array(x)
    d1, types = _discounts(*map(int, one[:4])), int(big[0])
    paths = lambda name, found, key, n: [f"{folder}/{name}-{k}" if k in {r[key] for r in found} else "" for k in range(n)]
    return Model(
        vocabulary=files, ranked=len(ranked), words=words, tokens=tokens, start=start, types=types, spread=spread, d1=d1, d2=_discounts(*map(int, big[1:])), d3=_discounts(*map(int, three[1:])),
        free=float(d1[1] * one[0] + d1[2] * one[1] + d1[3] * one[4]) / types if types else 1.0, bigrams=paths("bigrams", seen, "shard", shards),
        trigrams=paths("trigrams", tri, "shard", shards) if order == 3 else [], continuations=paths("continuations", own, "part", ranges),
        split=np.array(sorted(split_sums), np.int64), split_sums=np.array([split_sums[v] for v in sorted(split_sums)], np.int64).reshape(-1, 4),
    )


def _before(w: np.ndarray, sizes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids two places and one place before each token; a text begins after the start symbol, before which there is none (-1)."""
    at = np.cumsum(sizes) - sizes
    v = np.concatenate([[start], w[:-1]])
    v[at] = start
    u = np.concatenate([[-1], v[:-1]])
    u[at] = -1
    return u, v


class Scorer:
    """A model's mapped arrays in one Python worker."""

    def __init__(self, model: Model) -> None:
        self.m, self.v = model, Vocabulary(model.vocabulary, model.ranked)
        self.open: dict[str, dict] = {}

    def _file(self, uri: str) -> dict[str, np.ndarray]:
        return self.open.get(uri) or self.open.setdefault(uri, map_file(uri))

    def unigram(self, ids: np.ndarray) -> np.ndarray:
        """The lower order: continuation counts, discounted, over a uniform share for all words and the unknown one."""
        m, cont = self.m, np.zeros(len(ids), np.int64)
        known = np.flatnonzero(ids >= 0)
        for k, own in _by_shard(ids[known] // RANGE):
            if m.continuations[k]:
                cont[known[own]] = self._file(m.continuations[k])["n"][ids[known[own]] - k * RANGE]
        low = np.maximum(cont - m.d1[np.minimum(cont, 3)], 0) / max(m.types, 1)
        return low + m.free / (m.words + 1)

    def _interpolated(self, files: list[str], shard: np.ndarray, c: np.ndarray, w: np.ndarray, d: np.ndarray, low: np.ndarray) -> np.ndarray:
        n, total, kinds = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64), np.zeros((3, len(c)), np.int64)
        for k, own in _by_shard(shard):
            if files[k]:
                own = own[np.argsort(c[own])]
                n[own], total[own], kinds[:, own] = _read_level(self._file(files[k]), c[own], w[own])
        if len(self.m.split) and files is self.m.bigrams:
            at = np.minimum(np.searchsorted(self.m.split, c), len(self.m.split) - 1)
            own = np.flatnonzero(self.m.split[at] == c)
            total[own], kinds[:, own] = self.m.split_sums[at[own], 0], self.m.split_sums[at[own], 1:].T
        free = d[1:] @ kinds
        return np.where(total > 0, (np.maximum(n - d[np.minimum(n, 3)], 0) + free * low) / np.maximum(total, 1), low)

    def bigram(self, v: np.ndarray, w: np.ndarray, low: np.ndarray) -> np.ndarray:
        """P(w | v), given P(w); unknown words have the id after the start symbol's, and nothing of theirs is stored."""
        return self._interpolated(self.m.bigrams, self.m.spread(v, w), v, w, self.m.d2, low)

    def trigram(self, c: np.ndarray, w: np.ndarray, low: np.ndarray) -> np.ndarray:
        """P(w | c) of words after contexts u << 32 | v, given P(w | v)."""
        return self._interpolated(self.m.trigrams, _hash(c) % max(len(self.m.trigrams), 1), c, w, self.m.d3, low)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score all whole texts: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    docs needs doc_id, text and held_out. Perplexity is 10 ** (-score / n_tokens).
    """
    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model)
        for b in slices(batches):
            h, code, sizes = _tokens(b)
            ids, n = s.v.find(h)
            text = np.repeat(np.arange(len(sizes)), sizes)
            low, w = s.unigram(ids), ids[code]
            u, v = _before(w, sizes, model.start)
            # unknown words, first ones and second ones, share the number after the start symbol's
            u, v, w = (np.where(x < 0, model.start + 1, x) for x in (u, v, w))
            _, first, at = np.unique(v << 32 | w, return_index=True, return_inverse=True)
            p = s.bigram(v[first], w[first], low[code[first]])[at]
            if model.trigrams:
                own = np.ones(len(w), bool)
                own[np.cumsum(sizes) - sizes] = False  # a first word has one symbol before it
                p[own] = s.trigram((u << 32 | v)[own], w[own], p[own])
            p = np.log10(p)
            base = np.log10((n + 1) / (model.tokens + model.words + 1))[code]
            size = len(sizes)
            columns = [
                b.column("doc_id"), b.column("held_out"), pa.array(sizes), pa.array(np.bincount(text, n[code] > 0, minlength=size).astype(np.int64)),
                pa.array(np.full(size, model.tokens)), pa.array(np.bincount(text, base, minlength=size)), pa.array(np.bincount(text, p, minlength=size)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in kinds.split(", ")])

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, kinds)


def lm_scores(docs: DataFrame, *, order: int = 2, folds: int = 7, held_out: int = 2) -> DataFrame:
    """Train a model of the order on the texts outside one fold (by crc32 of the id), score all.

    Null and empty texts are one end token; a null id is hashed as an empty text; each row is a text of its own, repeated
    rows count each time; other columns are left out; an empty table gives an empty table, and without training
    rows all words are unknown and the model is uniform.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold(F.col("doc_id"), folds) == held_out).alias("held_out"))
    return score(d, train(d.filter("not held_out"), order=order))
