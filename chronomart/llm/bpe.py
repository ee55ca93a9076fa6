"""Byte-level BPE encoding and decoding over a transducer of the corpus's frequent words."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ._shared import as_doc_text, ship, ship_file, slices, unpack, written
from .lexicon import compile_lexicon, look_up

#: Fixed value: how this family of tokenizers cuts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A worker forgets its remembered pieces beyond this many, which bounds its memory.
REMEMBERED = 300_000
NEVER = 1 << 40
#: Rows and bytes of text that a task works on at a time: numpy needs some 50 times as many bytes.
SLICE = (250, 1 << 20)
#: Strings that make a text's pieces depend on each other, or may: all white space but space and newline, and what some count as such.
ODD = ("  ", "\n ", " \n", *map(chr, [9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]))
ENCODED = "doc_id long, ids array<int>"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Vocabulary:
    """Merge ranks and token bytes of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        self.id = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in alphabet for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            if self.id.get(content.encode()) == i:
                del self.id[content.encode()]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        merges = [(self.id[raw(a)], self.id[raw(b)], self.id[raw(a) + raw(b)]) for a, b in pairs]
        size = max([*self.id.values(), *self.special.values()]) + 1
        left, right, made = (np.array(x, np.int64) for x in zip(*merges, strict=True))
        self.size, self.made = size, made
        pair, bits = left * size + right, int(4 * len(merges)).bit_length()
        self.shift, self.slots, self.ranks = 64 - bits, np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        todo = np.arange(len(pair))[::-1]
        slot = self._slot(pair)[::-1].copy()
        while len(todo):  # linear probing; of those that want one free slot the last stays, the others move on
            free = self.slots[slot] == -1
            self.slots[slot[free]] = pair[todo[free]]
            self.ranks[slot[free]] = todo[free]
            left_over = self.slots[slot] != pair[todo]
            todo, slot = todo[left_over], (slot[left_over] + 1) & (len(self.slots) - 1)
        self.byte_ids = np.array([self.id[bytes([b])] for b in range(256)], np.int64)
        token = [b""] * size
        for t, i in self.id.items():
            token[i] = t
        for t, i in self.special.items():
            token[i] = t.encode()
        self.bytes = ragged(token)
        self.digits = ragged([b"%d," % i for i in range(size)])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of merging each pair of ids; NEVER where no merge exists."""
        want = left * self.size + right
        slot = self._slot(want)
        there = self.slots[slot]
        out = np.where(there == want, self.ranks[slot], NEVER)
        todo = np.flatnonzero((there != want) & (there != -1))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & (len(self.slots) - 1)
            there = self.slots[slot]
            hit = there == want[todo]
            out[todo[hit]] = self.ranks[slot[hit]]
            on = ~hit & (there != -1)
            todo, slot = todo[on], slot[on]
        return out

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids a word) by the merges: in each round every word makes its lowest-ranked merge, from the left."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), n)
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(sym), NEVER)
        if len(sym) > 1:
            rank[:-1] = np.where(word[1:] == word[:-1], self.rank(sym[:-1], sym[1:]), NEVER)
        while len(sym):
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(sym))))
            over = least == NEVER
            if over.any():
                done.append((word[over], sym[over]))
                word, sym, rank, least = word[~over], sym[~over], rank[~over], least[~over]
                if not len(sym):
                    break
            hit = rank == least
            if (hit[1:] & hit[:-1]).any():  # one symbol repeated: of a run of such pairs each second one merges
                run = np.arange(len(hit)) - np.maximum.accumulate(np.where(hit, -1, np.arange(len(hit))))
                hit &= run % 2 == 1
            at = np.flatnonzero(hit)
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # where the merged symbols stand once the others are gone
            word, sym, rank = word[keep], sym[keep], rank[keep]
            for p in (at, at[at > 0] - 1):
                last = p == len(sym) - 1
                q = np.where(last, p, p + 1)
                rank[p] = np.where(last | (word[q] != word[p]), NEVER, self.rank(sym[p], sym[q]))
        if not done:
            return np.zeros(0, np.int64), n
        of, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))


def ragged(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte strings as (all bytes, starts, lengths)."""
    size = np.fromiter(map(len, items), np.int64, len(items))
    return np.frombuffer(b"".join(items) or b"\0", np.uint8), np.cumsum(size) - size, size


def gather(table: tuple[np.ndarray, np.ndarray, np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The concatenation of table[which], and where each of them ends in it."""
    data, start, size = table
    n = size[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.repeat(start[which] - (ends - n), n) + np.arange(total)], ends


def cut_piece(piece: str, find=regex.compile(PATTERN).findall) -> list[str]:
    """The words of a piece and the space before it; letters, or letters and a mark, need no pattern."""
    if piece.isalpha():
        return [" " + piece]
    if piece[-1] in ",.;:!?" and piece[:-1].isalpha():
        return [" " + piece[:-1], piece[-1]]
    return find(" " + piece)


class Encoder:
    """Encodes batches of texts. Remembers pieces between single spaces, which encode alike wherever they stand."""

    def __init__(self, vocabulary: Vocabulary, lexicon: dict[str, np.ndarray] | None = None) -> None:
        self.v, self.lexicon = vocabulary, lexicon
        self.cut = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self._forget()

    def _forget(self) -> None:
        self.pieces: dict[str, int] = {}
        self.ids, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids a word): from the transducer where it has them, else by merging."""
        raw = [w.encode() for w in words]
        size = np.zeros(len(raw), np.int64)
        place = look_up(self.lexicon, raw) if self.lexicon is not None else np.full(len(raw), -1)
        known, unseen = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        if len(known):
            begin = self.lexicon["starts"][place[known]]
            size[known] = self.lexicon["starts"][place[known] + 1] - begin
            got, _ = gather((self.lexicon["ids"], begin, size[known]), np.arange(len(known)))
            parts.append((np.repeat(known, size[known]), got.astype(np.int64)))
        if len(unseen):
            got, size[unseen] = self.v.merge([raw[k] for k in unseen])
            parts.append((np.repeat(unseen, size[unseen]), got))
        if not parts:
            return np.zeros(0, np.int64), size
        of, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        return ids[np.argsort(of, kind="stable")], size

    def cut_all(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, ids a part) of parts cut into words; each distinct word is encoded once."""
        place: dict[str, int] = {}
        code = np.fromiter((place.setdefault(w, len(place)) for c in cut for w in c), np.int64)
        ids, size = self.words(list(place))
        got, _ = gather((ids, np.cumsum(size) - size, size), code)
        per_part = np.concatenate([[0], np.cumsum(size[code])])[np.cumsum([0, *map(len, cut)])]
        return got, np.diff(per_part)

    def whole(self, text: str) -> np.ndarray:
        """The ids of a text of any form: special tokens first, then words."""
        out = [np.zeros(0, np.int64)]
        for part in self.special.split(text) if self.special else [text]:
            if part in self.v.special:
                out.append(np.array([self.v.special[part]]))
            elif part:
                out.append(self.cut_all([self.cut.findall(part)])[0])
        return np.concatenate(out)

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, the number of ids of each text)."""
        odd = {k for k, t in enumerate(texts) if not t or self._odd(t)}
        # a newline in front marks first pieces, which have no space before them; other pieces never begin so
        plain = pa.array([None if k in odd else "\n" + t for k, t in enumerate(texts)], pa.large_string())
        split = pc.split_pattern(plain, " ")
        codes = pc.dictionary_encode(split.flatten())
        names = codes.dictionary.to_pylist()
        if len(self.pieces) + len(names) > REMEMBERED:
            self._forget()
        if new := [p for p in names if p not in self.pieces]:
            got, size = self.cut_all([self.cut.findall(p[1:]) if p[0] == "\n" else cut_piece(p) for p in new])
            self.pieces.update(zip(new, range(len(self.size), len(self.size) + len(new)), strict=True))
            self.ids, self.size = np.concatenate([self.ids, got]), np.concatenate([self.size, size])
        used = np.fromiter(map(self.pieces.__getitem__, names), np.int64, len(names))
        code = used[codes.indices.to_numpy(zero_copy_only=False)]
        ids, ends = gather((self.ids, np.cumsum(self.size) - self.size, self.size), code)
        per_text = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        if not odd:
            return ids, np.diff(bounds)
        out = [self.whole(t) if k in odd else ids[bounds[k] : bounds[k + 1]] for k, t in enumerate(texts)]
        return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))

    def _odd(self, t: str) -> bool:
        """Whether pieces may depend on each other: a space beside white space or at an end, or rare or special strings."""
        return t[0] in " \n" or t[-1] == " " or any(x in t for x in ODD) or any(x in t for x in self.v.special)


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(tokenizer: str, lexicon: str | None) -> Encoder:
    """One encoder for each Python worker, reused by its later tasks."""
    key = (tokenizer, lexicon)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary(SparkFiles.get(tokenizer)), unpack(SparkFiles.get(lexicon)) if lexicon else None)
    return _ENCODERS[key]


def count_words(docs: DataFrame) -> DataFrame:
    """(word string, n long): how often each word stands in all texts, pre-summed by each task."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words: Counter = Counter()
            for piece, n in total.items():
                for w in cut_piece(piece) if piece else ():
                    words[w] += n
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])

        for b in slices(batches, *SLICE):
            # a space is put in front of each piece: right for all but the first of a text, and only frequencies are wanted
            parts = pc.split_pattern(b.column("text").cast(pa.large_string()).drop_null(), " ")
            seen = pc.value_counts(parts.flatten())
            total.update(dict(zip(seen.field("values").to_pylist(), seen.field("counts").to_pylist(), strict=True)))
            if len(total) > REMEMBERED:
                yield flush()
        if total:
            yield flush()

    return docs.select("text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer_path: str, words: int = 30_000, longest: int = 64) -> str:
    """Compile the corpus's most frequent words (at most `words`, counted over all texts: those above the lowest fitting power of two) and ship the transducer."""
    v = Vocabulary(tokenizer_path)
    counted = written(count_words(docs).filter((F.length("word") > 1) & (F.length("word") <= longest)), "word-counts")
    # one row tells how many words reach each power of two; those of the first power that at most `words` reach are taken
    reach = counted.agg(*[F.count_if(F.col("n") >= (1 << k)).alias(f"k{k}") for k in range(48)]).first()
    least = next((1 << k for k in range(48) if reach[k] <= words), 1 << 48)
    top = counted.filter(F.col("n") >= least).collect()
    raw = [r.word.encode() for r in top]
    ids, size = v.merge(raw)
    parts = [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] if raw else []
    return ship(docs.sparkSession, "lexicon", compile_lexicon(zip(raw, parts, strict=True)))


def bpe_encode(docs: DataFrame, tokenizer_path: str, lexicon: str | None = None, lexicon_words: int = 30_000) -> DataFrame:
    """Encode whole texts exactly as the tokenizer file prescribes, without adding special tokens.

    Frequent words come out of a memory-mapped transducer (built from docs unless a shipped one is named);
    all others are merged. Special token strings inside a text become their ids.

    Null and empty texts give an empty array; each row stands alone, so ties and repeated rows keep their own row;
    a null doc_id stays null; other columns are left out; an empty table gives an empty table.

    Returns doc_id long, ids array<int>.
    """
    docs = as_doc_text(docs)
    lexicon = lexicon or build_lexicon(docs, tokenizer_path, lexicon_words)
    tokenizer = ship_file(docs.sparkSession, tokenizer_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(tokenizer, lexicon)
        for b in slices(batches, *SLICE):
            ids, n = e.batch([x or "" for x in b.column("text").to_pylist()])
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return docs.mapInArrow(encode, ENCODED)


def _lists(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    col = b.column("ids")
    n = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), n


def bpe_decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Decode ids to text, special tokens included; bytes that are no UTF-8 become U+FFFD.

    A null or empty array gives an empty text; ids outside the vocabulary raise an error; other columns are kept.
    Returns encoded's columns and text string.
    """
    tokenizer = ship_file(encoded.sparkSession, tokenizer_path)
    keep = [c for c in encoded.columns if c.lower() != "text"]
    encoded = encoded.select(*keep)
    schema = StructType([*encoded.schema, StructField("text", StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _encoder(tokenizer, None).v if (tokenizer, None) in _ENCODERS else next((e.v for k, e in _ENCODERS.items() if k[0] == tokenizer), None) or _encoder(tokenizer, None).v
        for b in slices(batches, *SLICE):
            ids, n = _lists(b)
            raw, ends = gather(v.bytes, ids)
            cut = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]
            whole = raw.tobytes()
            text = [whole[i:j].decode("utf-8", "replace") for i, j in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*b.schema.names, "text"])

    return encoded.mapInArrow(decode, schema)


def id_digests(encoded: DataFrame) -> DataFrame:
    """Adds n_tokens long and ids_sha256: the hex digest of the decimal ids joined by commas."""
    text = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(text.cast("binary"), 256)})


def round_trip(docs: DataFrame, tokenizer_path: str, lexicon_words: int = 30_000) -> DataFrame:
    """Digests of each text's ids and of the text decoded from those ids, in one pass over the batches.

    Edge cases as in bpe_encode and bpe_decode. Returns doc_id, n_tokens long, ids_sha256, decoded_sha256 string.
    """
    docs = as_doc_text(docs)
    lexicon = build_lexicon(docs, tokenizer_path, lexicon_words)
    tokenizer = ship_file(docs.sparkSession, tokenizer_path)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(tokenizer, lexicon)
        for b in slices(batches, *SLICE):
            ids, n = e.batch([x or "" for x in b.column("text").to_pylist()])
            at = np.concatenate([[0], np.cumsum(n)])
            out = [b.column("doc_id"), pa.array(n)]
            for table, tail in ((e.v.digits, 1), (e.v.bytes, 0)):
                raw, ends = gather(table, ids)
                cut = np.concatenate([[0], ends])[at].tolist()
                whole = raw.tobytes()
                parts = [whole[i : max(i, j - tail)] for i, j in zip(cut, cut[1:], strict=False)]
                if not tail:  # what is no UTF-8 decodes to replacement characters
                    parts = [p.decode("utf-8", "replace").encode() for p in parts]
                out.append(pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(both, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def count_tokens(rows: DataFrame, tokenizer_path: str, column: str = "text", out: str = "tokens") -> DataFrame:
    """rows with the number of ids of a text column; null and empty texts have none. A column that out names already is replaced; an empty table stays empty."""
    tokenizer = ship_file(rows.sparkSession, tokenizer_path)
    rows = rows.select(*[c for c in rows.columns if c.lower() != out.lower()])
    at = rows.columns.index(column)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(tokenizer, None)
        for b in slices(batches, *SLICE):
            _, n = e.batch([x or "" for x in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n)], [*b.schema.names, out])

    return rows.mapInArrow(count, StructType([*rows.schema, StructField(out, LongType())]))
