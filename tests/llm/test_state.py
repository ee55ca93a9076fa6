"""Token rollups from a stored state by document, and windows that keep their budget in real token ids."""

from collections import Counter

import pytest

pytest.importorskip("chronomart.llm")
import public_tokenizers
from tokenizers import Tokenizer

from chronomart.llm import chat, rollup

KIND = "doc_id long, source string, lang string, tokenizer string, tokens long"


def sums(spark, store):
    return {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals(spark, store).collect()}


def test_old_counts_come_from_the_state(spark, tmp_path, monkeypatch):
    store = f"file://{tmp_path}/store"
    rows = [(k, "ab"[k % 2], "en", "t", k) for k in range(300)] + [(None, None, None, "t", 7), (5, "a", "en", "t", 1), (5, "a", "en", "u", 9)]
    now = Counter(rows)

    def check():
        want = {}
        for (_, s, lang, t, n), c in now.items():
            docs, tokens = want.get((s, lang, t), (0, 0))
            want[s, lang, t] = (docs + c, tokens + n * c)
        assert sums(spark, store) == want and Counter(map(tuple, rollup.state(spark, store).collect())) == now

    frame = lambda r: spark.createDataFrame(r, KIND)
    gone = lambda r: spark.createDataFrame(r, "doc_id long, tokenizer string")
    assert rollup.apply(spark, store, 1, frame(rows)) and not rollup.apply(spark, store, 1, frame(rows))
    check()
    read = []
    before = rollup.state
    monkeypatch.setattr(rollup, "state", lambda s, p, b=None: (read.append(b), before(s, p, b))[1])
    put = [(5, "b", "fr", "t", 50), (None, "a", "en", "t", 2), (900, "a", "en", "t", 3)]
    assert rollup.apply(spark, store, 7, frame(put), gone([(6, "t"), (7, "u"), (901, "t")]))
    assert len(read[0]) <= 6  # of 64 buckets
    now = Counter({r: n for r, n in now.items() if (r[0], r[3]) not in {(5, "t"), (None, "t"), (6, "t")}}) + Counter(put)
    check()
    assert rollup.apply(spark, store, 8, frame([]), gone([(r[0], r[3]) for r in now]))  # all go
    now = Counter()
    check()
    assert rollup.apply(spark, store, 9, frame(put))
    now = Counter(put)
    check()
    new = rollup.compact(spark, store, 10)
    assert sums(spark, new) == sums(spark, store) and rollup.committed(spark, new) >= {1, 7, 8, 9, 10}
    assert rollup.apply(spark, new, 11, frame([(5, "b", "fr", "t", 60)])) and not rollup.apply(spark, new, 8, frame(put))
    assert sums(spark, new)["b", "fr", "t"] == (1, 60)


def test_of_two_writers_the_second_begins_again(spark, tmp_path, monkeypatch):
    store = f"file://{tmp_path}/store"
    frame = lambda r: spark.createDataFrame(r, KIND)
    rollup.apply(spark, store, 1, frame([(1, "a", "en", "t", 5)]))
    place, raced = rollup._place, []

    def race(session, aside, target):
        if not raced:
            raced.append(target)
            assert rollup.apply(session, store, 2, frame([(1, "a", "en", "t", 8)]))  # another writer, meanwhile
        return place(session, aside, target)

    monkeypatch.setattr(rollup, "_place", race)
    assert rollup.apply(spark, store, 3, frame([(1, "a", "en", "t", 11)]))
    assert sums(spark, store) == {("a", "en", "t"): (1, 11)}
    rollup.apply(spark, store, 4, frame([(1, "a", "en", "t", 1)]))
    (tmp_path / "store/.new-left").mkdir()  # what a broken attempt leaves
    assert sums(spark, store) == {("a", "en", "t"): (1, 1)} and rollup.committed(spark, store) == {1, 2, 3, 4}


def test_windows_keep_their_budget_in_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = [(1, k, "assistant" if k % 2 else "user", "ok") for k in range(400)] + [(2, k, "r]\n\\<s>" if k % 3 else "system", "</s>[INST] <pad>\\ é!?" * (k % 5)) for k in range(200)]
    rows += [(3, k, "user", "...>" if k % 2 else "<<") for k in range(150)] + [(4, 0, "system", None), (4, 1, None, ""), (4, 2, "user", "word " * 900), (4, 3, "user", "x")]
    d = chat.turn_costs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), path)
    windows = chat.format_chats(d, budget=300, history=60).collect()
    over = 0
    for w in windows:
        ids = len(t.encode(w.text, add_special_tokens=False).ids)
        assert ids <= w.tokens
        if w.tokens > 300:
            over += 1
            assert w.conv_id == 4 and w.turns - w.repeated == 1
    assert over == 1 and len(windows) > 20
    real = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    for w in chat.format_chats(chat.turn_costs(real, path)).collect():
        n = len(t.encode(w.text, add_special_tokens=False).ids)
        assert n <= w.tokens and (n <= 768 or w.turns - w.repeated == 1)
