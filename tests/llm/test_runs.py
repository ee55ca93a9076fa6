"""Periodic runs against plain loops: common extensions, all runs of random and of repeated texts, and the whole query."""

import hashlib
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("chronomart.llm")

from chronomart.llm import queries as q
from chronomart.llm import runs


def plain_runs(words):
    """Every run by walking each period; the smallest period of a stretch counts."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(i, text, change=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(("" if i is None else str(i)).encode())
    g = h // 10
    if change and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    found = plain_runs(words)
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    start, length, period = best or (None, None, None)
    return (i, len(found), start, length, period, best and 1000 * length // period, sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_common_extension_equals_a_loop():
    g = np.random.default_rng(2)
    for n, kinds in ((1, 1), (2, 1), (12, 2), (13, 1), (14, 3), (200, 1), (500, 2), (700, 40)):
        w = g.integers(1, kinds + 1, n)
        if n == 500:
            w = np.tile(w[:37], 14)[:500]
        common = runs.CommonExtension(w)
        i, j = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
        i, j = i[i < j], j[i < j]
        want = [next((k for k in range(n - b) if w[a + k] != w[b + k]), n - b) for a, b in zip(i, j, strict=True)]
        assert common(i, j).tolist() == want and common(j, i).tolist() == want


def test_all_runs_of_texts_laid_end_to_end(monkeypatch):
    g = np.random.default_rng(4)
    texts = [g.integers(1, k + 1, n) for k, n in ((1, 5), (1, 6), (1, 300), (2, 120), (3, 400), (2, 0), (4, 900), (500, 600))]
    for period in (1, 2, 3, 7, 20, 75):
        base = g.integers(1, 9, 400)
        at = int(g.integers(0, 60))
        base[at : at + 4 * period + 5] = np.resize(base[at : at + period], 4 * period + 5)
        texts += [base, base, np.resize(np.resize(base[:period], 4 * period + 1), 400)]
    want = [(k, *r) for k, t in enumerate(texts) for r in plain_runs(t.tolist())]
    for points in (1 << 20, 17):
        monkeypatch.setattr(runs, "POINTS", points)
        found = runs.find_runs(np.concatenate(texts), np.array([len(t) for t in texts]))
        assert list(zip(*(x.tolist() for x in found), strict=True)) == want
    assert len(want) > 100


def test_operator_on_edge_cases(spark):
    rows = [
        (None, None, "x"), (1, "", "x"), (2, " \t\n", "x"), (3, "a a a a a", "x"), (4, "a a  a\ta\na a b", "x"), (4, "a a  a\ta\na a b", "x"), (5, "é \x1c é\x0b\x1c é \x1c é \x1c", "x"),
        (6, "a b c " * 30_000 + "d", "x"), (7, "z " + "a a a a a a a b " * 9, "x"), (8, " ".join(f"w{k}" for k in range(5000)), "x"), (None, "q q q q q q q", "x"),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(d).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = plain_runs(words) if len(words) < 10_000 else [(0, 90_000, 3)]
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        want.append((i or 0, len(words), found, " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert got == sorted(want, key=repr)
    assert runs.periodic_runs(d.limit(0)).count() == 0 and runs.repeated_tail(d.limit(0)).count() == 0


def test_query_equals_a_loop(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = q.op12_periodic_runs(spark, sf)
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(tuple(r)[:8] for r in got.collect())
    assert got == sorted(plain_row(r.doc_id, r.text) for r in docs)
    assert sum(r[1] > 0 for r in got) > 15


def test_repeated_tail_keeps_null_ids(spark):
    rows = [(None, "a b c d e f g"), (None, None), (0, ""), *((k, " ".join(map(str, range(k % 9)))) for k in range(1, 400))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = runs.periodic_runs(runs.repeated_tail(d)).collect()
    want = sorted((str(r[0]), r[1]) for r in (plain_row(i, t) for i, t in rows))
    assert sorted((str(r.doc_id), len(r.runs)) for r in got) == want
