"""Each training-data operator against a plain single-machine version, on the small tables and on edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("chronomart.llm")
import public_tokenizers
from tokenizers import Tokenizer

from chronomart.llm import bpe, chat, lexicon, lm, minhash, mixing, pii, quality, rollup, topk, toxicity
from chronomart.llm import queries as q

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [
    (None, None, None, "x"), (1, "", "en", "x"), (2, None, "a", "x"), (3, "one", "a", "x"), (3, "one", "a", "x"), (4, "word " * 3000, "b", "x"),
    (5, "a b\n\n  c\t<|endoftext|> é😀 \x1c z", "b", "x"), (6, "Mail x.y@z.example.com or +1 (743) 555-3824, ip 8.8.8.8 and 999.1.1.1", None, "x"),
    (7, " ".join(f"w{i}" for i in range(300)), "c", "x"), (8, " ".join(f"w{i}" for i in range(300)) + " tail", "c", "x"),
]
COLUMNS = "doc_id long, text string, source string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, COLUMNS)


def text_of(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_bpe_equals_library(spark, docs, edge):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for d in (docs.select("doc_id", "text"), edge):
        want = Counter()
        for r in d.collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids
            want[(r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))] += 1
        assert Counter(map(tuple, bpe.round_trip(d, path).collect())) == want
    enc = bpe.bpe_encode(edge, path)
    assert sorted(r.text for r in bpe.bpe_decode(enc, path).collect()) == sorted(r[1] or "" for r in EDGE)
    assert bpe.round_trip(edge.limit(0), path).count() == 0


def test_lexicon_is_minimal_and_exact():
    words = {w.encode(): [k] * (k % 3 + 1) for k, w in enumerate(["tap", "taps", "top", "tops", "a", "stop", "stops", "é"])}
    blob = lexicon.compile_lexicon(words.items())
    open("/tmp/lexicon-test", "wb").write(blob)
    from chronomart.llm._shared import unpack

    a = unpack("/tmp/lexicon-test")
    asked = [*words, b"ta", b"", b"tapss", b"zz"]
    place = lexicon.look_up(a, asked)
    got = [a["ids"][a["starts"][p] : a["starts"][p + 1]].tolist() if p >= 0 else None for p in place]
    assert got == [*words.values(), None, None, None, None]
    assert len(a["final"]) < sum(map(len, words))


def tf_idf(texts):
    """Weighted shingles of each text by dictionaries: counts times ln(N / df) over ln 1000, 1 from one in 1000 on, 0.05 at least."""
    sh = {k: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for k, t in enumerate(texts) if (w := t.encode().split())}
    df = Counter(x for c in sh.values() for x in c)
    return {k: {x: n * (0.05 + 0.95 * min(1, math.log(len(sh) / df[x]) / math.log(1000))) for x, n in c.items()} for k, c in sh.items()}


def similarity(a, b):
    common = sum(min(w, b[x]) for x, w in a.items() if x in b)
    return common / (sum(a.values()) + sum(b.values()) - common)


def brute_links(texts):
    """All pairs of texts with their similarity, where they have a shingle in common."""
    weights, having = tf_idf(texts), defaultdict(list)
    for k, c in weights.items():
        for x in c:
            having[x].append(k)
    pairs = {(i, j) for ks in having.values() for n, i in enumerate(ks) for j in ks[n + 1 :]}
    return {(i, j): similarity(weights[i], weights[j]) for i, j in pairs}


def classes_of(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(n)]


def test_near_duplicates(spark, docs, edge):
    """Against all pairs at the operator's own weighted Jaccard similarity."""
    for sf in (SF, "/root/testdata/sf0.01"):
        d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
        ids, texts = [r.doc_id for r in d], [r.text or "" for r in d]
        like = {p: s for p, s in brute_links(texts).items() if s >= 0.8}
        want = classes_of(len(texts), like)
        got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
        assert len(got) == len(texts) and len(like) > 10
        found = np.mean([got[ids[i]] == got[ids[j]] for i, j in like])
        assert found >= 0.99, found
        assert all(want[i] == want[ids.index(got[ids[i]])] for i in range(len(ids)))  # no class holds what is not linked
    rows = minhash.near_duplicates(edge).collect()
    assert len(rows) == len(EDGE)
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.class_id, r.class_size))
    assert by[7] == by[8] == {(7, 2)} and by[3] == {(3, 2)} and by[1] == {(1, 1)}
    assert minhash.near_duplicates(edge.limit(0)).count() == 0


def test_large_buckets_in_blocks(spark, monkeypatch):
    """A group whose members are near one base but often not near each other, in blocks of 16: as by all pairs within buckets."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "LEADERS", 1)
    g = np.random.default_rng(3)
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(base)]
    for k in range(400):
        w = list(base)
        for p in g.integers(0, 150, int(g.integers(1, 9))):
            w[p] = f"c{k}x{p}"
        texts.append(" ".join(w))
    texts += [" ".join(f"lone{k}w{i}" for i in range(150)) for k in range(3000)]
    raw = [t.encode() for t in texts[:401]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    name = minhash.shingle_weights(d)
    from pyspark import SparkFiles

    table = minhash.idf_table(minhash.unpack(SparkFiles.get(name)))
    cuts = np.cumsum([0, *map(len, raw)])
    text, s, tf, _ = minhash.count_shingles(np.frombuffer(b"".join(raw), np.uint8), cuts)
    sig = minhash.signatures(text, s, tf * minhash.idf_of(s, table), len(raw))
    band = (sig[:, None] == sig[None]).reshape(len(raw), len(raw), minhash.BANDS, minhash.ROWS).all(3).any(2)
    weights = tf_idf(texts)
    edges = [(i, j) for i in range(401) for j in range(i + 1, 401) if band[i, j] and similarity(weights[i], weights[j]) >= 0.8]
    want = classes_of(len(texts), edges)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(d).collect()}
    assert [got[k] for k in range(len(texts))] == want
    assert 1 < len(set(want[:401])) < 390


def test_weights_of_frequent_shingles(spark, monkeypatch):
    """Every shingle in over one text of 1000 is counted exactly, whichever blocks it stands in."""
    monkeypatch.setattr(minhash, "COUNTED", 500)
    texts = [f"a b c d e f w{k} x{k} y{k} z{k} v{k}" if k % 7 == 0 else f"p{k} q{k} r{k} s{k} t{k} " + ("m n o p q" if k % 300 == 0 else "") for k in range(3000)]
    d = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    from pyspark import SparkFiles

    idf = minhash.unpack(SparkFiles.get(minhash.shingle_weights(d)))
    table = minhash.idf_table(idf)
    _, s, _, _ = minhash.count_shingles(np.frombuffer(b"a b c d e f\nm n o p q", np.uint8), np.array([0, 12, 21]))
    assert len(idf["h"]) == 3  # a b c d e, b c d e f and m n o p q
    want = [0.05 + 0.95 * math.log(3000 / n) / math.log(1000) for n in (429, 429, 8)]  # of ten multiples of 300 two are multiples of 7
    assert np.allclose(sorted(minhash.idf_of(s, table)), sorted(want), atol=1e-6)


def test_weighted_jaccard_and_sampling():
    """The share of equal samples is an unbiased estimate of the weighted Jaccard similarity, also where weights differ."""
    idf = {"h": np.zeros(0, np.uint64), "w": np.zeros(0, np.float32)}
    base = [f"w{i}" for i in range(400)]
    changed = base[:200] + ["x"] + base[201:]
    a, b = " ".join(base).encode(), " ".join(changed).encode()
    want = 391 / 401
    assert abs(minhash.weighted_jaccard([a], [b], idf)[0] - want) < 1e-9
    g, same, expected = np.random.default_rng(1), [], []
    for k in range(400):
        s = np.sort(g.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2))
        x, y = g.choice([0.05, 0.4, 1, 2, 7], 60), g.choice([0.05, 0.4, 1, 2, 7], 60)
        y = np.where(g.random(60) < 0.6, x, y)
        sig = minhash.signatures(np.repeat([0, 1], 60), np.append(s, s), np.append(x, y), 2)
        same.append((sig[0] == sig[1]).mean())
        expected.append(np.minimum(x, y).sum() / np.maximum(x, y).sum())
    assert abs(np.mean(same) - np.mean(expected)) < 0.012
    assert np.std(np.array(same) - np.array(expected)) < 0.085  # the binomial's would be about 0.075


def targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        t = {s: 3.0 * sizes[s] if s in capped else w[s] * left / sum(w[f] for f in free) for s in order}
        over = {s for s in free if t[s] >= 3 * sizes[s]}
        if not over:
            return t
        capped |= over


def test_mixing(spark, docs, edge):
    for d in (docs, edge):
        rows = mixing.mix_sources(d).collect()
        assert len(rows) == d.count()
        sizes = defaultdict(int)
        for r in d.collect():
            sizes[r.source] += len(WORD.findall(r.text or ""))
        want = targets(sizes)
        taken = defaultdict(int)
        for r in rows:
            assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
            assert 0 <= r.taken <= 3 * r.size
            taken[r.source] += r.taken
        most = max(r.size for r in rows)
        assert sum(taken.values()) <= sum(sizes.values())
        assert all(abs(taken[s] - want[s]) <= 2 * most for s in sizes)
        assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(d).collect()))
    assert mixing.mix_sources(edge.limit(0)).count() == 0
    copies = mixing.apply_mix(docs, mixing.mix_sources(docs))
    assert copies.count() == sum(r.copies for r in mixing.mix_sources(docs).collect())


def test_rollup_is_idempotent(spark, tmp_path):
    kinds = "source string, lang string, tokenizer string, old_tokens long, new_tokens long"
    store = f"file://{tmp_path}/store"
    assert rollup.totals(spark, store).count() == 0
    one = spark.createDataFrame([("a", "en", "t", None, 5), ("a", "en", "t", None, 7), (None, None, "t", None, 1)], kinds)
    two = spark.createDataFrame([("a", "en", "t", 5, 6), ("a", "en", "t", 7, None), (None, None, "t", 1, None)], kinds)
    assert rollup.commit(spark, store, 1, one) and not rollup.commit(spark, store, 1, one)
    assert rollup.commit(spark, store, 2, two) and not rollup.commit(spark, store, 2, two)
    assert [tuple(r) for r in rollup.totals(spark, store).collect()] == [("a", "en", "t", 1, 6)]
    new = rollup.compact(spark, store, 9)
    assert [tuple(r) for r in rollup.totals(spark, new).collect()] == [("a", "en", "t", 1, 6)] and rollup.committed(spark, new) == {1, 2, 9}
    assert not rollup.commit(spark, new, 1, one) and rollup.commit(spark, new, 3, one) and rollup.totals(spark, new).agg({"docs": "sum"}).first()[0] == 4
    state = spark.createDataFrame([(1, "a", "en", "t", 5), (2, "a", "en", "t", 7), (3, None, None, "t", 2), (5, "a", "en", "t", 1)], "doc_id long, source string, lang string, tokenizer string, tokens long")
    now = spark.createDataFrame([(1, "a", "en", "t", 6), (3, "b", None, "t", 2), (None, "a", "en", "t", 4), (5, "a", "en", "t", 1)], state.schema)
    got = {tuple(r)[:3]: (r.docs, r.tokens) for r in rollup.signed(rollup.document_changes(now, state)).collect()}
    assert got == {("a", "en", "t"): (0, -2), (None, None, "t"): (-1, -2), ("b", None, "t"): (1, 2)}
    two.write.mode("overwrite").parquet(f"{store}/batch=3")
    (tmp_path / "store/batch=3/_SUCCESS").unlink()  # a commit that broke off does not count
    assert [tuple(r) for r in rollup.totals(spark, store).collect()] == [("a", "en", "t", 1, 6)]


def brute_top_k(rows, every, k):
    v = {i: [math.floor(1024 * float(x)) for x in e] for i, e in rows}
    for i in v:
        if i % every == 0:
            score = sorted((-sum(a * b for a, b in zip(v[i], v[j], strict=True)), j) for j in v if j != i)[:k]
            yield from ((i, n + 1, j, -s) for n, (s, j) in enumerate(score))


def test_top_k(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = topk.top_k(e, block=128, query_block=3)
    assert sorted(map(tuple, got.collect())) == sorted(brute_top_k([(r.vec_id, r.embedding) for r in e.collect()], 100, 10))
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [-1.0, 0.5])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, None), (0, 4, 7)]
    rows = [(100, [1.0, 2.0]), (100, [3.0]), (1, [4.0, 1.0]), (1, [0.5]), (1, []), (2, [1.0, 1.0, 9.0])]  # repeated ids, other lengths
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    own = [[int(1024 * x) for x in e] for _, e in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    want = [(100, n + 1, -v, s) for q in (0, 1) for n, (s, v) in enumerate(sorted(((dot(own[q], own[j]), -rows[j][0]) for j in range(6) if j != q), reverse=True))]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    got = topk.top_k(spark.createDataFrame([(0, []), (1, []), (None, [1.0]), (2, [2.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 0), (0, 2, 2, 0), (0, 3, None, 0)]  # no components: a score of 0; a null id comes last
    assert topk.top_k(e.limit(0)).count() == 0


def brute_lm(rows):
    """Bigram modified Kneser-Ney in dictionaries."""
    tok = lambda t: [w.decode() for w in t.encode().lower().split()] + [""]
    train = [tok(t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    uni, big = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["<s>", *t], t, strict=False))
    n, v = sum(uni.values()), len(uni)
    cont, ctx = Counter(w for _, w in big), defaultdict(list)
    for (u, _), c in big.items():
        ctx[u].append(c)
    d2, d1 = (lm._discounts(*(sum(x == k for x in c.values()) for k in (1, 2, 3, 4))) for c in (big, cont))
    free = sum(d1[min(c, 3)] for c in cont.values()) / max(len(big), 1) if big else 1.0

    def p(u, w):
        low = max(cont[w] - d1[min(cont[w], 3)], 0) / max(len(big), 1) + free / (v + 1)
        if u not in ctx:
            return low
        total = sum(ctx[u])
        c = big.get((u, w), 0)
        return max(c - d2[min(c, 3)], 0) / total + sum(d2[min(x, 3)] for x in ctx[u]) / total * low

    for i, t in rows:
        t = tok(t)
        yield i, len(t), sum(uni[w] > 0 for w in t), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(p(u, w)) for u, w in zip(["<s>", *t], t, strict=False))


def test_lm(spark, docs, edge):
    for d in (docs, edge):
        got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.lm_scores(d).collect()), key=lambda r: (r[0] is None, r[0] or 0))
        want = sorted(brute_lm([(r.doc_id, r.text or "") for r in d.collect()]), key=lambda r: (r[0] is None, r[0] or 0))
        assert [g[:4] for g in got] == [w[:4] for w in want]
        assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-6)
    assert lm.lm_scores(edge.limit(0)).count() == 0


def test_lm_probabilities_sum_to_one(spark, docs, monkeypatch):
    import xxhash

    monkeypatch.setattr(lm, "SHARD", 20_000)  # several shards, and first words that are dealt over some of them
    monkeypatch.setattr(lm, "RANKED", 256)
    m = lm.train(docs.select("text"), order=3)
    s = lm.Scorer(m)
    words = {b"", *(w for t in text_of(docs).values() for w in t.encode().lower().split())}
    ids, n = s.v.find(np.array(sorted(xxhash.xxh64_intdigest(w) for w in words), np.uint64).view(np.int64))
    assert len(set(ids)) == len(words) == m.words and n.sum() == m.tokens and len(m.split) and len(m.bigrams) > 1
    every = np.append(ids, m.start + 1)
    low = s.unigram(np.append(ids, -1))
    assert abs(low.sum() - 1) < 1e-9
    for v in (0, m.start, int(ids[17]), m.start + 1):
        two = s.bigram(np.full(len(every), v), every, low)
        assert abs(two.sum() - 1) < 1e-9
        assert abs(s.trigram(np.full(len(every), m.start << 32 | v), every, two).sum() - 1) < 1e-9


def test_lm_without_training_rows(spark):
    """All words are unknown, and the model is uniform over the unknown word alone."""
    rows = [(i, t) for i, t in ((k, f"a b {k}") for k in range(60)) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), order=3).collect()
    assert len(got) == len(rows) and all((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 4, 0, 0, 0.0, 0.0) for r in got)


def test_chat(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (-8, 0, "system", None), (-8, 1, None, "a\\b]\n"), (-8, 2, "x]\ny", "<s>["), (-8, 3, "assistant", "long " * 2000), (-8, 4, "assistant", "")]
    rows += [(-9, k, "assistant" if k % 2 else "user", f"turn {k} " * 40) for k in range(60)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int")
    windows = chat.format_chats(d)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    want = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        want[c].append((role or "user", text or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    w = [r for r in windows.collect() if r.conv_id == -9]
    assert len(w) > 3 and all(r.tokens <= 768 for r in w) and all(r.repeated > 0 for r in w if r.window)
    assert chat.read_back(chat.format_chats(d.limit(0))).count() == 0
    # counts of a column, a long system turn, null ids, and a turn that fits only without what is repeated
    rows = [(None, 0, "system", "s " * 9, 300), (None, 1, "user", "u", 300), (None, 2, "assistant", "v", 200), (None, 3, "user", "w", 460), (None, 4, "user", "x", 700), (None, 5, "user", "y", 1)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tokens long"), budget=768, history=300).orderBy("window").collect()
    assert [(r.window, r.repeated, r.turns, r.tokens) for r in got] == [(0, 0, 2, 608), (1, 1, 2, 508), (2, 1, 2, 768), (3, 1, 2, 1008), (4, 1, 2, 309)]


def test_toxicity(spark, edge):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = q.op8_toxicity(spark, sf).collect()
    pairs = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    auc = np.mean([[(a > b) + 0.5 * (a == b) for b in neg] for a in pos])
    assert auc > 0.9, auc
    assert all(0 <= r.score <= 1 for r in rows)
    w, b = toxicity.train_toxicity(edge, labels)
    got = toxicity.score_toxicity(edge, w, b).collect()
    assert len(got) == len(EDGE) and "source" in got[0]
    assert toxicity.score_toxicity(edge.limit(0), w, b).count() == 0


def test_words_without_the_expression(monkeypatch):
    """Equal to the expression; texts of ASCII never ask it."""
    texts = ["", "Plain ASCII, 2 words_and a_third's x\x00y\x1fz", "Straße\u00a0ÉTÉ·½²x\u2003y İi\u0307 中文3字", "a\ud800b", "".join(map(chr, range(1, 0x3000)))]
    want = [set(toxicity.WORD.findall(t.lower())) for t in texts]
    assert [toxicity.words_of(t) for t in texts] == want
    monkeypatch.setattr(toxicity, "WORD", None)
    assert [toxicity.words_of(t) for t in texts[:2]] == want[:2]


def brute_quality(t):
    words = WORD.findall(t)
    win = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if win[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def brute_kept(t):
    """(kept, lines, failed lines, characters lost) by a plain loop over lines."""
    size = lambda x: len(re.sub(r"[\x20\x09-\x0D]", "", x))
    lines, lost, failed = [x for x in t.split("\n") if WORD.search(x)], 0, 0
    for x in lines:
        marks, bars = sum(c in quality.SYMBOLS + "!" for c in x), sum(c in quality.BARS for c in x)
        if marks > 0.08 * size(x) or bars >= 3 and bars * 20 > size(x) or len(x) <= 200 and any(p in x.lower() for p in quality.BOILERPLATE):
            failed += 1
            lost += size(x)
    return not brute_quality(t)[-1] and lost <= 0.3 * size(t), len(lines), failed, lost


def test_quality_verdicts(spark, docs, edge):
    prose = " ".join(f"word{i}" for i in range(80)) + ".\n"
    extra = ["Tous droits réservés.\n" + prose, "Startseite · Über uns · Kontakt · Impressum\n" + prose, "Haga clic aquí para entrar\n" * 40 + prose, "### $$$ !!! ***\n" * 90 + prose, "\n\n", "Alle Rechte vorbehalten " + "lang " * 60 + "\n" + prose]
    for d in (docs, edge, spark.createDataFrame([(k, t) for k, t in enumerate(extra)], "doc_id long, text string")):
        got = Counter((r.doc_id, r.kept, r.n_lines, r.n_failed_lines, r.lost_chars) for r in quality.quality_rules(d).collect())
        assert got == Counter((r.doc_id, *brute_kept(r.text or "")) for r in d.collect())
    assert {r.n_failed_lines for r in quality.quality_rules(d).collect()} == {1, 40, 90, 0}


def test_quality(spark, docs, edge):
    for d in (docs, edge):
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality_rules(d).collect())
        assert got == Counter((r.doc_id, *brute_quality(r.text or "")) for r in d.collect())
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in q.op9_quality_rules(spark, "/root/testdata/sf0.01").collect() if r.doc_id in labels and not r.base_failed]
    good = [r.kept for r in rows if labels[r.doc_id]]
    bad = [r.kept for r in rows if not labels[r.doc_id]]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.5, (np.mean(good), np.mean(bad))
    assert quality.quality_rules(edge.limit(0)).count() == 0
    clean = quality.quality_rules(spark.createDataFrame([(1, "Home | About | Contact | Help\nA line of prose stands here.\nAll rights reserved.")], "doc_id long, text string")).first()
    assert clean.clean_text == "A line of prose stands here." and clean.n_failed_lines == 2


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
OTHERS = [re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(t):
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    for k, p in enumerate(OTHERS, 1):
        for m in p.finditer(t):
            d = re.sub("[^0-9]", "", m.group())
            ok = all(int(x) <= 255 for x in m.group().split(".")) if k == 1 else 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0 if k == 2 else 9 <= len(d) <= 15
            if ok:
                out.append((k, *m.span()))
    return out


def test_pii(spark, docs, edge):
    import random

    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab@.-+ 0123456789()") for _ in range(rnd.randint(0, 60))) for _ in range(4000)] + list(text_of(docs).values())
    texts += ["a@b.c@d.e.f", "4111 1111 1111 1111", "x@y", "+1 (743) 555-3824", "1.2.3.4.5.6.7.8", "256.1.1.1"]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t), t
    sf = "/root/testdata/sf0.01"
    rows = q.op10_pii_spans(spark, sf).collect()
    names = pii.KINDS
    for r in rows:
        assert r.n_email + r.n_ip + r.n_card + r.n_phone <= (r.spans.count(",") + 1 if r.spans else 0)
        assert r.n_spans == (r.spans.count(",") + 1 if r.spans else 0)
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.base_sha256 == sha(",".join(f"{names[k]}:{a}:{b}" for k, a, b in brute_spans(text[r.doc_id]))) for r in rows)
    assert any("secret:" in r.spans for r in rows)
    found = pii.find_candidates(edge)
    trust, w = pii.fit(found)
    assert trust.shape == (len(pii.KINDS), pii.LABELERS) and len(pii.redact(edge, w).collect()) == len(EDGE)
    mail = [r.text for r in pii.redact(edge, w).collect() if r.doc_id == 6][0]
    assert mail == "Mail [EMAIL] or [PHONE], ip [IP] and 999.1.1.1"
    assert pii.find_candidates(edge.limit(0)).count() == 0


def packed(kind, said, features=(1, 1, 1, 2, 2)):
    code = pii.KINDS.index(kind)
    for v in (*said, *features):
        code = code * 3 + v
    return code


def test_em_trusts_the_labeler_that_agrees():
    counts = {packed("ssn", [2, 2, 2, 1, 0]): 100, packed("ssn", [0, 0, 0, 1, 2]): 100, packed("iban", [2, 0, 1, 1, 2]): 50, packed("iban", [2, 2, 1, 1, 2]): 50}
    trust, soft = pii.fit_labelers(counts)
    ssn, iban = pii.KINDS.index("ssn"), pii.KINDS.index("iban")
    assert trust[ssn, 0] > 0.9 and trust[ssn, 4] < 0.6 and trust[iban, 4] > 0.9  # reliable for one kind, not for the other
    assert soft[packed("ssn", [2, 2, 2, 1, 0])] > 0.9 and soft[packed("ssn", [0, 0, 0, 1, 2])] < 0.1


def test_span_classifier_generalises_by_looks():
    """It learns from spans whose labelers agree what personal data looks like, and judges spans whose labelers say nothing by their looks."""
    long_, short = (2, 2, 1, 2, 2), (0, 0, 2, 0, 0)
    counts = {packed("secret", [2, 2, 1, 1, 2], long_): 300, packed("secret", [0, 0, 1, 1, 0], short): 300}
    _, soft = pii.fit_labelers(counts)
    w = pii.fit_classifier(counts, soft)
    asked = np.array([packed("secret", [1, 1, 1, 1, 1], long_), packed("secret", [1, 1, 1, 1, 1], short)])
    assert pii.keeps(w, asked).tolist() == [True, False]
    t = "My token: abcd1234EFGH5678 and 4111 1111 1111 1112."
    assert [pii.KINDS[k] for k, *_ in pii.candidates(t)] == ["card", "secret"]
    kind, said, features = pii.unpack_codes(np.array([c[4] for c in pii.candidates(t)]))
    for k, (c, a, b, base, _) in enumerate(pii.candidates(t)):
        assert kind[k] == c and said[k].tolist() == pii.votes(t, c, a, b, base) and features[k].tolist() == pii.span_features(t, a, b)


def test_voted_spans_are_what_the_classifier_keeps(spark):
    """The query's spans are those of a plain loop: base spans, and others that the fitted classifier takes."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {i: pii.candidates(t) for i, t in texts.items()}
    counts = Counter(c[4] for cs in found.values() for c in cs)
    _, soft = pii.fit_labelers(counts)
    w = pii.fit_classifier(counts, soft)
    for r in q.op10_pii_spans(spark, sf).collect():
        want = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b, base, code in found[r.doc_id] if base or pii.keeps(w, np.array([code]))[0]]
        assert r.spans == ",".join(want)


def test_non_negative_risk():
    """The risk by its definition, and its direction by differences: along the gradient, or against that of a negative part."""
    g = np.random.default_rng(0)
    for shift in (4.0, -6.0):
        z, positive, prior = g.normal(size=40) + np.where(np.arange(40) < 15, 4, shift), np.arange(40) < 15, 0.4
        loss = lambda x: math.log(1 + math.exp(-x))
        rest = lambda z: np.mean([loss(-x) for x in z[~positive]]) - prior * np.mean([loss(-x) for x in z[positive]])
        whole = lambda z: prior * np.mean([loss(x) for x in z[positive]]) + rest(z)
        value, step = toxicity.nn_risk(z, positive, prior)
        assert abs(value - prior * np.mean([loss(x) for x in z[positive]]) - max(0, rest(z))) < 1e-9
        of, sign = (whole, 1) if rest(z) >= 0 else (rest, -1)
        assert (rest(z) < 0) == (shift < 0)
        for k in range(0, 40, 7):
            e = np.zeros(40)
            e[k] = 1e-6
            assert abs((of(z + e) - of(z - e)) / 2e-6 * sign - step[k]) < 1e-6


def test_pipeline(spark):
    """Each stage on what the one before kept, row by row against a plain version."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(10_000_000 + k, None if k == 1 else t, "en", "x", 1) for k, t in enumerate(["", "", "the same " * 60, "the same " * 60, "Mail a.b@c.example.org now"])] + [(None, "without an id " * 30, None, None, 1), (None, "another one " * 30, None, None, 1)]
    docs = c.written(docs.select(*c.DOCUMENTS).union(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")), "stage")
    order = lambda rows: sorted(rows, key=repr)
    for k, (name, stage) in enumerate(c.STAGES):
        before = [tuple(r) for r in docs.select(*c.DOCUMENTS).collect()]
        after = c.written(stage(spark, docs, SF), "stage")
        got = order(tuple(r) for r in after.collect())
        if k + 1 < len(c.STAGES):
            assert tuple(after.columns) == c.DOCUMENTS and all(r[4] == (None if r[1] is None else len(r[1])) for r in got)
        sized = [(*r[:4], None if r[1] is None else len(r[1])) for r in before]
        if name == "toxicity":
            w, b = toxicity.train_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            p = lambda t: 1 / (1 + math.exp(-(b + sum(w[f] for x in toxicity.words_of(t) for f in toxicity.hashed(x)))))
            want = [r for r in sized if p(r[1] or "") < 0.3]
        elif name == "near_duplicates":
            rows = sorted(sized, key=lambda r: (r[0] is not None, r[0] or 0))
            of = classes_of(len(rows), [p for p, s in brute_links([r[1] or "" for r in rows]).items() if s >= 0.8])
            want = [r for i, r in enumerate(rows) if of[i] == i]
        elif name == "pii":
            found = [pii.candidates(r[1] or "") for r in sized]
            counts = Counter(x[4] for f in found for x in f)
            w = pii.fit_classifier(counts, pii.fit_labelers(counts)[1])
            want = []
            for r, f in zip(sized, found, strict=True):
                out, end = "", 0
                for x, y, kind in sorted((x, y, kind) for kind, x, y, base, code in f if base or pii.keeps(w, np.array([code]))[0]):
                    if x >= end:
                        out += (r[1] or "")[end:x] + f"[{pii.KINDS[kind].upper()}]"
                    end = max(end, y)
                text = None if r[1] is None else out + r[1][end:]
                want.append((r[0], text, *r[2:4], None if text is None else len(text)))
        elif name == "mix":
            size, key = lambda r: len(WORD.findall(r[1] or "")), lambda r: hashlib.md5((str(r[0]) if r[0] is not None else "null:" + hashlib.md5((r[1] or "").encode()).hexdigest()).encode()).hexdigest()
            total = defaultdict(int)
            for r in sized:
                total[r[3]] += size(r)
            goal, queue = targets(total), []
            for s in total:
                end = 0
                for r in sorted((r for r in sized if r[3] == s), key=lambda r: (key(r), r[0] or 0, size(r))):
                    end += size(r)
                    queue += [((end + n * total[s]) / goal[s], s is None, s or "", key(r), r[0] or 0, size(r), n, r) for n in range(3) if size(r) and goal[s] > 0]
            want, used = [], 0
            for x in sorted(queue, key=lambda x: x[:7]):
                used += x[5]
                if used > sum(total.values()):
                    break
                want.append(x[-1])
        else:
            t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            ids = [t.encode(r[1] or "", add_special_tokens=False).ids for r in before]
            want = [(r[0], len(i), sha(",".join(map(str, i))), sha(t.decode(i, skip_special_tokens=False))) for r, i in zip(before, ids, strict=True)]
        assert got == order(want), name
        docs = after


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in c.STAGES:
        docs = c.written(stage(spark, docs, SF), "stage")
        assert docs.count() == 0
