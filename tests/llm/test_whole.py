"""Cases in which an operator of the training data did less than its whole job."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("chronomart.llm")

from chronomart.llm import lm, minhash
from chronomart.llm import queries as q


def test_pairs_just_above_the_threshold_are_linked(spark):
    """Every pair that shares a band is judged by its weighted Jaccard similarity, however few of its samples agree."""
    g = np.random.default_rng(7)
    texts = []
    for k in range(4000):
        words = [f"p{k}w{i}" for i in range(90)]
        other = words[: 90 - (n := int(g.integers(8, 11)))] + [f"p{k}x{i}" for i in range(n)]
        texts += [" ".join(words), " ".join(other)]
    raw = [t.encode() for t in texts]
    idf = {"h": np.zeros(0, np.uint64), "w": np.zeros(0, np.float32)}  # all words are rare among so many texts
    like = minhash.weighted_jaccard(raw[::2], raw[1::2], idf)
    cuts = np.cumsum([0, *map(len, raw)])
    text, s, tf, _ = minhash.count_shingles(np.frombuffer(b"".join(raw), np.uint8), cuts)
    sig = minhash.signatures(text, s, tf.astype(float), len(raw))
    same = sig[::2] == sig[1::2]
    band = same.reshape(len(same), minhash.BANDS, minhash.ROWS).all(2).any(1)
    near = (like >= 0.8) & (like < 0.85)
    assert (near & band & (same.sum(1) < 24)).any() and (like < 0.8).any()
    assert (near & ~band).sum() <= 0.01 * near.sum()
    rows = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r.doc_id: r.class_id for r in rows}
    linked = np.array([found[2 * k] == found[2 * k + 1] for k in range(len(like))])
    assert (linked == ((like >= 0.8) & band)).all()


def test_each_row_marked_keep_stays(spark):
    """Null and shared ids do not make different texts one document; rows equal in id and text are one, rows without words are not."""
    import corpus_pipeline

    text = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    near = text(0) + " tail"
    rows = [
        (None, text(0), "a"), (None, text(1), "a"), (None, text(2), "a"), (5, text(3), "a"), (5, text(4), "a"), (6, near, "a"), (6, text(5), "a"),
        (7, text(6), "b"), (7, text(6), "a"), (None, text(1), "a"), (None, None, "a"), (None, "", "a"), (8, " \t", "a"), (8, " \t", "a"), (9, text(4), "a"), (10, "\x1c", "a"),
    ]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert minhash.near_duplicates(docs).filter("keep").count() == len(rows) - 4
    got = [(r.doc_id, r.text, r.source) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    want = [r for k, r in enumerate(rows) if k not in (5, 7, 9, 14)]
    order = lambda r: str(r)
    assert sorted(got, key=order) == sorted(want, key=order)


def brute_trigrams(rows):
    """Trigram modified Kneser-Ney in dictionaries; bigrams count the words before them, those at a text's start their own."""
    tok = lambda t: ["<s>", *(w.decode() for w in t.encode().lower().split()), ""]
    train = [tok(t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    uni, tri = Counter(w for t in train for w in t[1:]), Counter(x for t in train for x in zip(t, t[1:], t[2:], strict=False))
    two = Counter(x[1:] for x in tri) + Counter((t[0], t[1]) for t in train)
    cont = Counter(w for _, w in two)
    d3, d2, d1 = (lm._discounts(*(sum(x == k for x in c.values()) for k in (1, 2, 3, 4))) for c in (tri, two, cont))
    after = [defaultdict(list), defaultdict(list)]
    for c, of in ((two, after[0]), (tri, after[1])):
        for x, n in c.items():
            of[x[:-1]].append(n)
    free = sum(d1[min(c, 3)] for c in cont.values()) / max(len(two), 1) if two else 1.0

    def level(x, counts, of, d, low):
        n = of.get(x[:-1])
        return low if not n else max(counts[x] - d[min(counts[x], 3)], 0) / sum(n) + sum(d[min(c, 3)] for c in n) / sum(n) * low

    def p(x):
        low = max(cont[x[-1]] - d1[min(cont[x[-1]], 3)], 0) / max(len(two), 1) + free / (len(uni) + 1)
        low = level(x[-2:], two, after[0], d2, low)
        return level(x, tri, after[1], d3, low) if len(x) == 3 else low

    return {i: sum(math.log10(p(tuple(t[max(k - 2, 0) : k + 1]))) for k in range(1, len(t))) for i, t in ((i, tok(t)) for i, t in rows)}


def test_trigrams(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 20_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = [(None, None), (-1, ""), (-2, "a b a b a b c"), (-3, "one"), (-4, "a b a b never seen"), (-5, "a b a b d"), (-6, "zz " * 500)]
    docs = docs.union(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: r.score for r in lm.lm_scores(docs, order=3).collect()}
    want = brute_trigrams([(r.doc_id, r.text or "") for r in docs.collect()])
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), rtol=1e-6)
    assert lm.lm_scores(docs.limit(0), order=3).count() == 0


def test_query_scores_by_trigrams(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r.score for r in q.op6_lm_scores(spark, sf).collect()}
    want = brute_trigrams([(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert np.allclose([got[k] for k in want], list(want.values()), rtol=1e-6)
