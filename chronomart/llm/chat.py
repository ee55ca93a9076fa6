"""Chat formatting into budgeted windows of whole turns, with a loss mask on assistant text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import bpe
from ._shared import ship_file, slices
from .mixing import word_count

OPEN, MIDDLE, CLOSE = "<s>[", "]\n", "</s>"
#: Strings that control a chat model; inside texts each becomes a backslash and its letter.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<pad>", "<unk>")
CODE = {s: chr(97 + k) for k, s in enumerate(CONTROL)}
BACK = {v: k for k, v in CODE.items()} | {"\\": "\\", "]": "]\n"}
FIND = re.compile("|".join(map(re.escape, ["\\", *CONTROL])))
UNDO = re.compile(r"\\(.)", re.S)
#: What a turn's markers are taken to cost where no column has the turn's own cost.
MARKERS = 4
WINDOWS = "conv_id long, window int, repeated int, turns int, tokens long, text string, loss array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    return FIND.sub(lambda m: "\\" + CODE.get(m.group(), "\\"), text)


def escape_role(role: str) -> str:
    return escape(role).replace("]\n", "\\]")


def unescape(text: str) -> str:
    return UNDO.sub(lambda m: BACK[m.group(1)], text)


def turn_costs(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """rows (role, text, other columns) with cost: the ids of each turn as a window shows it, escaped and with its markers.

    A turn ends and begins with a mark of punctuation that the byte-level tokenizers cut off from all but the neighbouring mark, so a window has no more ids than its turns have
    together. A column named cost is replaced; null roles are users, null texts empty; an empty table stays empty.
    """
    tokenizer = ship_file(rows.sparkSession, tokenizer_path)
    rows = rows.select(*[c for c in rows.columns if c.lower() != "cost"])
    role_at, text_at = rows.columns.index("role"), rows.columns.index("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = bpe._encoder(tokenizer, None)
        for b in slices(batches, *bpe.SLICE):
            pairs = zip(b.column(role_at).to_pylist(), b.column(text_at).to_pylist(), strict=True)
            _, n = e.batch([OPEN + escape_role("user" if r is None else r) + MIDDLE + escape(t or "") + CLOSE for r, t in pairs])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n)], [*b.schema.names, "cost"])

    return rows.mapInArrow(count, StructType([*rows.schema, StructField("cost", LongType())]))


@dataclass
class _Window:
    """Turns of one window as (role, text, tokens, repeated)."""

    turns: list[tuple[str, str, int, bool]] = field(default_factory=list)
    tokens: int = 0

    def add(self, role: str, text: str, tokens: int, repeated: bool) -> None:
        self.turns.append((role, text, tokens, repeated))
        self.tokens += tokens

    def row(self, conv: int | None, number: int) -> dict:
        parts, loss, at = [], [], 0
        for role, text, _, repeated in self.turns:
            head, body = OPEN + escape_role(role) + MIDDLE, escape(text)
            start = at + len(head)
            at = start + len(body) + len(CLOSE)
            parts += [head, body, CLOSE]
            if role == "assistant" and not repeated:
                loss.append({"start": start, "end": start + len(body)})
        n = sum(r for *_, r in self.turns)
        return {"conv_id": conv, "window": number, "repeated": n, "turns": len(self.turns), "tokens": self.tokens, "text": "".join(parts), "loss": loss}


def format_chats(rows: DataFrame, *, budget: int = 768, history: int = 192) -> DataFrame:
    """Format conversations (conv_id, turn, role, text and, if given, cost or tokens) as windows of whole turns of at most `budget` tokens.

    A turn costs what the column cost says (see turn_costs: then windows hold at most `budget` ids of the tokenizer); without it its tokens (its words, where no
    column says) and an estimate of four for its markers, and the budget is one of these figures. Prefix sums of these costs, taken by Spark, tell
    where a window is full. The next one begins with the system turn (if the conversation began with one), then repeats as many of the
    last turns as fit in `history` tokens, then goes on. Repeated turns are in the text but not under the loss mask, so each
    assistant text is a target once. Only a turn that is too long for what the system turn leaves of the budget makes a window that
    exceeds it: that window holds the system turn and this turn alone, since turns are never cut.

    Rows are dealt by conversation and sorted, and then stream through a task that holds one window at a time, so a
    conversation of any length takes bounded memory.

    Null texts are empty, null roles are users, a null conv_id is one conversation and null turns come first; equal turns
    go by role and text, and repeated rows stay; other columns are left out; an empty table gives an empty table.

    Returns conv_id, window, repeated (turns shown before), turns, tokens, text and loss (code point spans of text).
    """
    if "cost" in rows.columns:
        cost = F.coalesce(F.col("cost"), F.lit(0))
    else:
        cost = (F.coalesce(F.col("tokens"), F.lit(0)) if "tokens" in rows.columns else word_count(F.col("text"))) + MARKERS
    d = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("user")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
        cost.cast("long").alias("n"),
    )
    order = ("turn", "role", "text")
    run = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.repartition("conv_id").withColumn("end", F.sum("n").over(run)).sortWithinPartitions("conv_id", *order)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, number, window, system, tail, base, out, held = none, 0, _Window(), None, [], 0, [], 0
        schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("repeated", pa.int32()), ("turns", pa.int32()), ("tokens", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        for b in slices(batches, 500):
            for c, role, text, n, end in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text", "n", "end")), strict=True):
                if conv is none or c != conv:
                    if window.turns:
                        out.append(window.row(conv, number))
                    conv, number, window, system, tail, base = c, 0, _Window(), None, [], 0
                if window.turns and end - base > budget:
                    out.append(window.row(conv, number))
                    number, window = number + 1, _Window()
                    if system:
                        window.add(*system, True)
                    room = min(history, budget - n - window.tokens)
                    again: list = []
                    for t in reversed(tail):
                        if t[2] > room:
                            break
                        room -= t[2]
                        again.append(t)
                    for t in reversed(again):
                        window.add(*t, True)
                    base = end - n - window.tokens  # from here on a prefix sum less base is what the window would hold
                if role == "system" and system is None and not tail and not window.turns:
                    system = (role, text, n)
                else:
                    tail.append((role, text, n))
                    while len(tail) > 1 and sum(t[2] for t in tail) > history:
                        tail.pop(0)
                window.add(role, text, n, False)
                held += len(text) + 64
            if held > 1 << 22:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
        if window.turns:
            out.append(window.row(conv, number))
        yield pa.RecordBatch.from_pylist(out, schema)

    return d.mapInArrow(build, WINDOWS)


TURN = re.compile(re.escape(OPEN) + r"((?:(?!\]\n).)*)" + re.escape(MIDDLE) + r"(.*?)" + re.escape(CLOSE), re.S)


def parse_window(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted window."""
    return [(unescape(r), unescape(t)) for r, t in TURN.findall(text)]


def read_back(windows: DataFrame) -> DataFrame:
    """Digest the windows of each conversation: parse turns, leave out repeated ones, and collect the text under the loss mask.

    windows must come straight from format_chats or be dealt by conv_id and sorted by conv_id, window.
    Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows, max_tokens.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long, max_tokens long"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, s, out = none, None, []

        def close() -> None:
            if conv is not none:
                out.append((conv, s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["formatted"], s["windows"], s["tokens"]))

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            kinds = [pa.string() if x.endswith("sha256") else pa.int64() for x in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for b in slices(batches, 500):
            for r in b.to_pylist():
                if conv is none or r["conv_id"] != conv:
                    close()
                    conv, s = r["conv_id"], {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0, "windows": 0, "tokens": 0}
                for role, text in parse_window(r["text"])[r["repeated"] :]:
                    s["n"] += 1
                    s["turns"].update(f"{role}\n{text}\n".encode())
                for m in r["loss"]:
                    text = unescape(r["text"][m["start"] : m["end"]])
                    s["chars"] += len(text)
                    s["loss"].update(text.encode())
                s["formatted"] += len(r["text"])
                s["windows"] += 1
                s["tokens"] = max(s["tokens"], r["tokens"])
            if len(out) > 5000:
                yield batch()
                out = []
        close()
        yield batch()

    return windows.mapInArrow(digest, schema)
