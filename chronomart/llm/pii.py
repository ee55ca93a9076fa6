"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs the labelers, a span classifier decides."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import as_doc_text, slices

KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban", "person")
#: The kinds whose base spans always stay.
BASE = 4
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|pwd|api_?key|access_?key|auth_?key)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_.-]{8,})")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
PERSON = re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? ([A-Z]\w+(?: [A-Z]\w+)?)")
DIGIT = re.compile(r"[0-9]")
#: The gazetteers.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor")
FIRST_NAMES = frozenset("James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Thomas Hans Anna Peter Maria Pierre Marie Jean Jose Carmen Juan".split())
DOMAIN_ENDS = frozenset("com org net edu gov io de fr es uk eu info biz".split())
DIAL_CODES = ("1", "33", "34", "39", "44", "49", "52", "61", "81", "86", "91")
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "22", "23", "24", "25", "26", "27")
#: Words near a span that speak for a kind, and words that speak against any.
FOR = {
    "email": ("mail", "contact", "write", "send", "reach", "@"),
    "ip": ("ip", "host", "server", "address", "login", "client"),
    "card": ("card", "visa", "pay", "credit", "debit", "account", "konto"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "contact"),
    "secret": ("token", "secret", "pass", "key", "auth"),
    "ssn": ("ssn", "social", "security", "tax"),
    "iban": ("iban", "bank", "account", "konto"),
    "person": ("name", "dear", "by", "author", "contact", "signed"),
}
AGAINST = ("version", "isbn", "issue", "chapter", "figure", "section", "release", "page ", "no. ")
LABELERS, FEATURES = 5, 5


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the four base kinds: leftmost and non-overlapping within a kind, failing matches dropped."""
    out: list[tuple[int, int, int]] = []
    at, end = t.find("@"), 0
    while at >= 0:
        lo = at
        while lo > end and LOCAL.match(t[lo - 1]):
            lo -= 1
        if lo < at and (m := DOMAIN.match(t, at)):
            end = m.end()
            out.append((0, lo, end))
        at = t.find("@", max(at + 1, end))
    if DIGIT.search(t):
        if "." in t:
            out += [(1, *m.span()) for m in IP.finditer(t) if all(_at_most(p, 255) for p in m.group().split("."))]
        for m in CARD.finditer(t):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append((2, *m.span()))
        if "+" in t:
            out += [(3, *m.span()) for m in PHONE.finditer(t) if 9 <= len(_digits(m.group())) <= 15]
    return out


def _at_most(digits: str, most: int) -> bool:
    d = digits.lstrip("0")
    return len(d) <= len(str(most)) and int(d or "0") <= most


def more_spans(t: str) -> list[tuple[int, int, int]]:
    """Candidates of the kinds that have no base rule, and near misses of base kinds (a card that fails its checksum)."""
    out: list[tuple[int, int, int]] = []
    if "=" in t or ":" in t:
        out += [(4, *m.span(1)) for m in SECRET.finditer(t)]
    if DIGIT.search(t):
        if "-" in t:
            out += [(5, *m.span()) for m in SSN.finditer(t)]
        out += [(6, *m.span()) for m in IBAN.finditer(t)]
        out += [(2, *m.span()) for m in CARD.finditer(t) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and not luhn(d)]
    if any(x in t for x in TITLES):
        out += [(7, *m.span(1)) for m in PERSON.finditer(t)]
    return out


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in (s.count(c) for c in set(s)))


def votes(t: str, kind: int, start: int, end: int, base: bool) -> list[int]:
    """What five labelers say of a span: 2 for, 0 against, 1 nothing. Pattern, gazetteer, context for, context against, shape."""
    s, name = t[start:end], KINDS[kind]
    near = t[max(0, start - 48) : start].lower() + " " + t[end : end + 24].lower()
    pattern = 2 if base or kind >= BASE else 0
    if kind == 0:
        known = s.rpartition(".")[2].lower() in DOMAIN_ENDS
    elif kind == 1:
        known = not s.startswith(("0.", "255.")) and s.count(".") == 3
    elif kind == 2:
        known = s.startswith(CARD_STARTS)
    elif kind == 3:
        known = s[1:].startswith(DIAL_CODES)
    elif kind == 7:
        known = s.split(" ")[0] in FIRST_NAMES
    else:
        known = None
    gazetteer = 1 if known is None else 2 if known else 0
    context = 2 if any(x in near for x in FOR[name]) else 1
    against = 0 if any(x in near for x in AGAINST) else 1
    if kind == 4:
        shape = 2 if _entropy(s) >= 2.5 and DIGIT.search(s) else 0
    elif kind in (2, 5):
        shape = 2 if len(set(_digits(s))) > 2 else 0
    else:
        shape = 2 if len(s) >= 6 else 0
    return [pattern, gazetteer, context, against, shape]


def span_features(t: str, start: int, end: int) -> list[int]:
    """What a span looks like and stands beside, in three classes each: length, share of digits, variety of characters, the characters before and after it."""
    s = t[start:end]
    digits, variety = sum(c.isdigit() for c in s) / len(s), len(set(s)) / len(s)
    side = lambda c: 2 if not c or c.isspace() else 0 if c.isalnum() else 1
    return [
        0 if len(s) < 8 else 1 if len(s) < 16 else 2, 0 if digits == 0 else 1 if digits < 0.6 else 2, 0 if variety < 0.3 else 1 if variety < 0.6 else 2,
        side(t[start - 1 : start]), side(t[end : end + 1]),
    ]


def candidates(t: str) -> list[tuple[int, int, int, bool, int]]:
    """(kind, start, end, base, code) by kind and start; code packs the kind, all votes and the span's features. Others never overlap base spans of their kind."""
    found = [(k, a, b, True) for k, a, b in base_spans(t)]
    own = {(k, a, b) for k, a, b, _ in found}
    found += [(k, a, b, False) for k, a, b in more_spans(t) if (k, a, b) not in own]
    out = []
    for k, a, b, base in sorted(found):
        code = k
        for v in [*votes(t, k, a, b, base), *span_features(t, a, b)]:
            code = code * 3 + v
        out.append((k, a, b, base, code))
    return out


def unpack_codes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kinds, votes, features) of packed codes."""
    parts = codes[:, None] // 3 ** np.arange(LABELERS + FEATURES - 1, -1, -1)
    return codes // 3 ** (LABELERS + FEATURES), parts[:, :LABELERS] % 3, parts[:, LABELERS:] % 3


def find_candidates(docs: DataFrame) -> DataFrame:
    """Candidate spans of each whole text: doc_id, spans array<struct<kind,start,end,base,code>> (code points, end exclusive).

    Null and empty texts have none; each row stands alone; other columns are left out; an empty table gives an empty table.
    """
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("code", pa.int32())]))
    names = ("kind", "start", "end", "base", "code")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [[dict(zip(names, c, strict=True)) for c in candidates(t)] if t else [] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return as_doc_text(docs).mapInArrow(find, "doc_id long, spans array<struct<kind:int,start:int,end:int,base:boolean,code:int>>")


def fit_labelers(counts: dict[int, int], rounds: int = 30) -> tuple[np.ndarray, dict[int, float]]:
    """EM over the counts of codes: (each labeler's reliability by kind, each code's probability of personal data).

    Reliability is the chance that a vote on a kind agrees with the truth, smoothed towards the labeler's over all kinds; the share of true
    spans is one a kind. Labelers that say nothing do not count.
    """
    codes = np.array(sorted(counts), np.int64)
    if not len(codes):
        return np.full((len(KINDS), LABELERS), 0.8), {}
    kind, said, _ = unpack_codes(codes)
    n, of = np.array([counts[int(c)] for c in codes], float), np.arange(len(KINDS))[:, None] == kind[None]
    up, down = (said == 2).astype(float), (said == 0).astype(float)
    p = np.clip(0.5 + 0.2 * (up - down).sum(1), 0.05, 0.95)
    trust = np.full((len(KINDS), LABELERS), 0.8)
    for _ in range(rounds):
        right, spoke = (n * p)[:, None] * up + (n * (1 - p))[:, None] * down, n[:, None] * (up + down)
        whole = (right.sum(0) + 8) / (spoke.sum(0) + 10)
        trust = np.clip((of @ right + 10 * whole) / (of @ spoke + 10), 0.55, 0.98)
        prior = (of @ (n * p) + 2) / (of @ n + 4)
        z = np.log(prior / (1 - prior))[kind] + ((up - down) * np.log(trust / (1 - trust))[kind]).sum(1)
        p = 1 / (1 + np.exp(-z))
    return trust, dict(zip(codes.tolist(), p.tolist(), strict=True))


def _inputs(codes: np.ndarray) -> np.ndarray:
    """What the span classifier sees: the kind; within the kind each feature of the span and what stands near it (the votes of both context labelers)."""
    kind, said, features = unpack_codes(codes)
    seen = np.concatenate([features, said[:, 2:4]], axis=1)
    width = 1 + 3 * seen.shape[1]
    own = np.zeros((len(codes), width))
    own[:, 0] = 1
    for k in range(seen.shape[1]):
        own[np.arange(len(codes)), 1 + 3 * k + seen[:, k]] = 1
    x = np.zeros((len(codes), len(KINDS), width))
    x[np.arange(len(codes)), kind] = own
    return np.concatenate([own, x.reshape(len(codes), len(KINDS) * width)], axis=1)


def fit_classifier(counts: dict[int, int], soft: dict[int, float], steps: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Logistic weights over spans and their surroundings, fitted to EM's soft labels by Newton steps, each code weighted by its count."""
    codes = np.array(sorted(soft), np.int64)
    x, y = _inputs(codes), np.array([soft[int(c)] for c in codes])
    w = np.zeros(x.shape[1])
    if not len(codes):
        return w
    n = np.array([counts[int(c)] for c in codes], float)
    n /= n.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (n * (p - y)) + ridge * w)
        w -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(labeler reliabilities by kind, classifier weights) from the candidates of all documents.

    Only counts by code come to the driver: at most 3 ** 10 a kind, however many documents there are.
    """
    rows = found.select(F.explode("spans").alias("s")).groupBy("s.code").count().collect()
    counts = {r[0]: r[1] for r in rows}
    trust, soft = fit_labelers(counts)
    return trust, fit_classifier(counts, soft)


def keeps(weights: np.ndarray, codes: np.ndarray, threshold: float = 0.5) -> np.ndarray:
    """Whether the classifier takes spans of these codes for personal data."""
    own, of = np.unique(codes, return_inverse=True)
    return (1 / (1 + np.exp(-np.clip(_inputs(own) @ weights, -30, 30))) >= threshold)[of]


def classify(found: DataFrame, weights: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """found (doc_id, spans), with only the spans that are base ones or that the classifier takes for personal data."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lists = b.column("spans")
            spans = lists.flatten()
            codes = spans.field("code").to_numpy(zero_copy_only=False).astype(np.int64)
            ok = spans.field("base").to_numpy(zero_copy_only=False).astype(bool) | keeps(weights, codes, threshold)
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            kept = np.bincount(np.repeat(np.arange(len(size)), size)[ok], minlength=len(size))
            out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)), spans.filter(pa.array(ok)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), out], ["doc_id", "spans"])

    return found.select("doc_id", "spans").mapInArrow(pick, found.select("doc_id", "spans").schema)


def redact(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """docs with every kept span of text replaced by its kind in brackets; overlapping spans are replaced as one, by the first's kind.

    Null texts stay null and empty ones empty; each row stands alone, so repeated rows give equal texts; other columns pass through; an empty
    table stays empty.
    """
    at = [c.lower() for c in docs.columns].index("text")

    def clean(t: str, known: dict[int, bool]) -> str:
        found = candidates(t)
        if new := [c[4] for c in found if c[4] not in known]:
            known.update(zip(new, keeps(weights, np.array(new, np.int64), threshold).tolist(), strict=True))
        out, end = [], 0
        for a, b, k in sorted((a, b, k) for k, a, b, base, code in found if base or known[code]):
            if a >= end:
                out += [t[end:a], f"[{KINDS[k].upper()}]"]
            end = max(end, b)
        return "".join([*out, t[end:]])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, bool] = {}
        for b in slices(batches):
            new = pa.array([clean(t, known) if t else t for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(b.columns)], names=b.schema.names)

    return docs.mapInArrow(rewrite, docs.schema)
