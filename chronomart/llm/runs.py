"""Periodic runs of words: a harmonic grid of places, extended by longest common extensions from a difference cover."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import as_doc_text, slices, texts

#: A perfect difference cover: any two places reach sampled ones after less than CYCLE equal steps.
CYCLE, COVER = 13, (0, 1, 3, 9)
STEPS = np.array([[next(s for s in range(CYCLE) if (x + s) % CYCLE in COVER and (y + s) % CYCLE in COVER) for y in range(CYCLE)] for x in range(CYCLE)])
POINTS = 1 << 20  # places of the grid that are held at once

RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class CommonExtension:
    """Lengths of the longest common prefix of two suffixes of w (numbers above 0).

    Only the suffixes at places of the cover are sorted: first by their next CYCLE words, then by doubling over the sampled places of one
    residue. Neighbours in that order have common prefixes whose least over a stretch, from a table of powers of two, answers any two sampled
    suffixes. Any other two are compared word by word until both stand at sampled places.
    """

    def __init__(self, w: np.ndarray) -> None:
        n = len(w)
        self.w = np.concatenate([w, np.zeros(CYCLE, w.dtype)])
        place = [np.arange(r, n + 1, CYCLE) for r in COVER]
        self.begin = np.zeros(CYCLE, np.int64)
        self.begin[list(COVER)] = np.cumsum([0, *map(len, place[:-1])])
        place = np.concatenate(place)
        m, bits = len(place), max(int(w.max(initial=0)).bit_length(), 1)
        keys, fit = [], max(63 // bits, 1)
        for at in range(0, CYCLE, fit):
            key = np.zeros(m, np.int64)
            for t in range(at, min(at + fit, CYCLE)):
                key = (key << bits) | self.w[place + t]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(m, bool)
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        rank = np.empty(m, np.int64)
        rank[order] = np.cumsum(new)
        ranks, half = [rank.astype(np.int32)], 1
        while rank.max(initial=0) + 1 < m:  # the last block of each residue is like no other, so this ends
            after = np.zeros(m, np.int64)
            after[: m - half] = rank[half:] + 1
            rank = np.unique(rank * (m + 1) + after, return_inverse=True)[1]
            ranks.append(rank.astype(np.int32))
            half *= 2
        suffix = np.argsort(rank)
        a, b, on = suffix[:-1], suffix[1:], np.zeros(m - 1, np.int64)
        for level in range(len(ranks) - 2, -1, -1):
            on += (ranks[level][a + on] == ranks[level][b + on]).astype(np.int64) << level
        del ranks
        common, same = on * CYCLE, np.ones(m - 1, bool)
        a, b = place[a] + common, place[b] + common
        for t in range(CYCLE):
            same &= self.w[np.minimum(a + t, n + CYCLE - 1)] == self.w[np.minimum(b + t, n + CYCLE - 1)]
            common += same
        self.rank, self.least = rank.astype(np.int32), [common.astype(np.int32)]
        half = 1
        while 2 * half < m:
            last = self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))
            half *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        steps, out = STEPS[i % CYCLE, j % CYCLE], np.zeros(len(i), np.int64)
        left = np.arange(len(i))
        for t in range(int(steps.max(initial=0))):
            left = left[steps[left] > t]
            left = left[self.w[i[left] + t] == self.w[j[left] + t]]
            out[left] = t + 1
        met = np.flatnonzero(out == steps)
        i, j = ((x + steps)[met] for x in (i, j))
        a, b = (self.rank[self.begin[x % CYCLE] + x // CYCLE].astype(np.int64) for x in (i, j))
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        more = np.zeros(len(met), np.int64)
        for k in np.unique(level):
            own = np.flatnonzero(level == k)
            more[own] = np.minimum(self.least[k][lo[own]], self.least[k][hi[own] - (1 << k)])
        out[met] += more
        return out


def grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place, words to compare) of the harmonic grids, some at a time.

    A run of period q and at least max(6, 4 q) words agrees with itself q words on over 3 q places or more (5 for q = 1), so one place of the
    grid with step 2 q lies in that stretch with q more after it (3 for q = 1).
    """
    periods = np.where(sizes >= 6, sizes // 4, 0)
    ends = np.cumsum(periods)
    for first in range(0, int(ends[-1]) if len(ends) else 0, POINTS):
        pair = np.arange(first, min(first + POINTS, int(ends[-1])))
        text = np.searchsorted(ends, pair, "right")
        q = pair - (ends - periods)[text] + 1
        words = np.where(q == 1, 4, np.minimum(q + 1, 4))
        n = np.maximum((sizes[text] - q - words) // (2 * q) + 1, 0)
        upto = np.cumsum(n)
        cuts = np.unique(np.searchsorted(upto, np.arange(0, upto[-1] + POINTS, POINTS), "left"))
        for a, b in zip(cuts, [*cuts[1:], len(n)], strict=True):
            k = np.repeat(np.arange(a, b), n[a:b])
            at = np.arange(len(k)) - np.repeat(upto[a:b] - n[a:b] - (upto[a] - n[a]), n[a:b]) if len(k) else k
            yield text[k], q[k], at * 2 * q[k], words[k]


def candidates(w: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, place) where a few words equal those a period on."""
    for text, q, at, words in grid(sizes):
        i = starts[text] + at
        for t in range(4):
            ok = (t >= words) | (w[np.minimum(i + t, len(w) - 1)] == w[np.minimum(i + q + t, len(w) - 1)])
            text, q, at, words, i = (x[ok] for x in (text, q, at, words, i))
        if len(text):
            yield text, q, at


def find_runs(w: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs (text, start, length, period) of texts laid end to end, as numbers of words above 0; by text, start and period."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    starts = np.cumsum(sizes) - sizes
    marked = np.zeros(len(sizes), bool)
    for text, _, _ in candidates(w, starts, sizes):
        marked[text] = True
    own = np.flatnonzero(marked)
    if not len(own):
        return none
    top, parts = int(w.max()), []
    for k, x in enumerate(own):  # each text ends with a number of its own
        parts += [w[starts[x] : starts[x] + sizes[x]], np.array([top + 1 + k])]
    w, sizes = np.concatenate(parts), sizes[own]
    w = np.unique(w, return_inverse=True)[1] + 1
    starts = np.cumsum(sizes + 1) - sizes - 1
    forward, back, out = CommonExtension(w), CommonExtension(w[::-1]), [none]
    for text, q, at in candidates(w, starts, sizes):
        i = starts[text] + at
        before = back(len(w) - i, len(w) - i - q)
        length = q + before + forward(i, i + q)
        ok = length >= np.maximum(6, 4 * q)
        found = text[ok], (at - before)[ok], length[ok], q[ok]
        out.append(_distinct(*(np.concatenate(x) for x in zip(out.pop(), found, strict=True))))
    text, start, length, q = out[0]
    by = np.lexsort((q, start, text))
    return own[text[by]], start[by], length[by], q[by]


def _distinct(text: np.ndarray, start: np.ndarray, length: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each stretch once, with its smallest period."""
    by = np.lexsort((q, length, start, text))
    text, start, length, q = text[by], start[by], length[by], q[by]
    new = np.ones(len(by), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return text[new], start[new], length[new], q[new]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The periodic runs of each text, and the text without what they repeat.

    docs: doc_id, text. Words are the stretches without spaces and code points 9 to 13, numbered from 0. A run is a stretch of words with
    smallest period q, of at least max(6, 4 q) words, that no neighbouring word extends keeping that period. collapsed: the words that no run
    contains after its first q words, joined by one space. A row for each row, repeated ones too; a null text has no words; other columns are
    left out. Texts are taken whole, some MB at a time; a task's memory grows with the longest text.

    Returns doc_id, n_words, runs (start, length, period; by start, then period), collapsed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            number = defaultdict(count(1).__next__)
            words = [t.split() for t in texts(b)]  # bytes split at these very code points
            sizes = np.array([len(x) for x in words], np.int64)
            w = np.fromiter((number[x] for t in words for x in t), np.int64, int(sizes.sum()))
            text, start, length, q = find_runs(w, sizes)
            first = np.searchsorted(text, np.arange(len(sizes) + 1))
            collapsed = []
            for k, own in enumerate(words):
                mine = slice(first[k], first[k + 1])
                if mine.start < mine.stop:
                    inside = np.zeros(len(own) + 1, np.int64)
                    np.add.at(inside, (start + q)[mine], 1)
                    np.add.at(inside, (start + length)[mine], -1)
                    own = [own[i] for i in np.flatnonzero(np.cumsum(inside[:-1]) == 0)]
                collapsed.append(b" ".join(own))
            runs = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(q)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes), runs, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return as_doc_text(docs).mapInArrow(run, RUNS)


def repeated_tail(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in which one text in ten, by crc32 of its id, repeats a stretch of its words from some word on.

    With h the checksum and g = floor(h / 10), texts of n > 0 words with h % 10 = 0 become: word i from a = g % n on is word
    a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)); words are joined by one space. A null id counts as an empty text.
    """
    d = as_doc_text(docs)
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    d = d.withColumns({"_h": h, "_g": F.floor(h / 10), "_w": F.when(h % 10 == 0, words)}).withColumn("_n", F.size("_w"))
    d = d.withColumn("_a", (F.col("_g") % F.when(F.col("_n") > 0, F.col("_n"))).cast("int"))
    d = d.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    rest = F.col("_n") - F.col("_a")
    again = F.slice(F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), F.ceil(rest / F.col("_p")).cast("int"))), F.lit(1), rest)
    text = F.when((F.col("_h") % 10 == 0) & (F.col("_n") > 0), F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), again), " ")).otherwise(F.col("text"))
    return d.select("doc_id", text.alias("text"))
