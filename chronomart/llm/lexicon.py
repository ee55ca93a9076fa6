"""A minimal acyclic transducer: frequent words with shared prefixes and suffixes, mapped to token id sequences.

Each arc carries the number of accepted words that sort before those it leads to; the sum along a word's path is
the word's place in sorted order, which points at its ids. States with equal futures are stored once.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from ._shared import pack


def compile_lexicon(words: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """Compile (word, ids) pairs, built state by state from words in sorted order, into a mappable blob."""
    entries = sorted(dict(words).items())
    finished: dict[tuple, int] = {}  # a state's signature -> its number
    arcs: list[tuple[tuple[int, int], ...]] = []  # by state: (label, target)
    final: list[bool] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in finished:
            finished[key] = len(arcs)
            arcs.append(key[1])
            final.append(key[0])
        return finished[key]

    path: list[list] = [[False, []]]  # open states on the current word's path: [final, arcs]
    before = b""
    for word, _ in entries:
        same = 0
        while same < min(len(word), len(before)) and word[same] == before[same]:
            same += 1
        while len(path) > same + 1:
            done = freeze(path.pop())
            path[-1][1].append((before[len(path) - 1], done))
        path.extend([False, []] for _ in word[same:])
        path[-1][0] = True
        before = word
    while len(path) > 1:
        done = freeze(path.pop())
        path[-1][1].append((before[len(path) - 1], done))
    root = freeze(path[0])

    below = np.zeros(len(arcs), np.int64)  # accepted words from a state; targets are frozen before their sources
    keys, targets, skips = [], [], []
    for state, out in enumerate(arcs):
        passed = int(final[state])
        for label, target in out:
            keys.append(state << 8 | label)
            targets.append(target)
            skips.append(passed)
            passed += int(below[target])
        below[state] = passed
    ids = [i for _, seq in entries for i in seq]
    return pack(
        {
            "keys": np.array(keys, np.int64), "targets": np.array(targets, np.int32), "skips": np.array(skips, np.int32),
            "final": np.array(final, np.uint8), "root": np.array([root], np.int64),
            "starts": np.cumsum([0, *(len(seq) for _, seq in entries)]).astype(np.int64), "ids": np.array(ids, np.int32),
        }
    )


def look_up(arrays: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """The place of each word in the lexicon, -1 if absent: all words walk the automaton in step, a byte at a time."""
    place = np.full(len(words), -1, np.int64)
    keys = arrays["keys"]
    if not len(keys) or not words:
        return place
    size = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    start = np.cumsum(size) - size
    live = np.flatnonzero(size > 0)
    state = np.full(len(live), int(arrays["root"][0]), np.int64)
    count = np.zeros(len(live), np.int64)
    at = 0
    while len(live):
        want = state << 8 | raw[start[live] + at]
        arc = np.searchsorted(keys, want)
        arc[arc == len(keys)] = 0
        ok = keys[arc] == want
        arc, live = arc[ok], live[ok]
        state, count = arrays["targets"][arc].astype(np.int64), count[ok] + arrays["skips"][arc]
        at += 1
        over = size[live] == at
        hit = over & (arrays["final"][state] == 1)
        place[live[hit]] = count[hit]
        live, state, count = live[~over], state[~over], count[~over]
    return place
