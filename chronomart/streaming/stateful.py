"""Stateful streams by symbol: continuity of a sequence, flow by the second, and rows that come too late or out of order.

State lies in RocksDB, keyed by symbol; rows of a micro-batch are taken in small pieces as they come and never gathered, so memory does not
grow with the batch. Timers on event time give what no row triggers.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import new_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PIECE = 4096  # rows that are sorted at once


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def pieces(rows: Iterator[Row], order: Callable[[Row], object], size: int = PIECE) -> Iterator[Row]:
    """Rows as they come, sorted within pieces of bounded length."""
    while piece := sorted(islice(rows, size), key=order):
        yield from piece


STATES = ("snapshot", "stale", "bridge", "valid", "gap", "invalid", "late", "lost")
NOTED = [STATES.index(x) for x in ("gap", "late", "lost")]  # states with a note
CONTINUITY = "symbol string, pos long, segment long, state string, integrity string"
PACKET = "symbol string, ts timestamp, lo long, hi long, rows binary"
JUDGED = "symbol string, lo long, segments binary, codes binary, notes array<string>"
NONE = -(1 << 63)  # a null in a packet
FIELDS = ("us", "first", "last", "previous", "snapshot_id")


def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of consecutive positions of a symbol within each batch, at most PIECE rows a packet: its last time, first and last position, and its rows as integers."""
    for b in batches:
        symbol = b.column("symbol").dictionary_encode()
        key, pos = symbol.indices.to_numpy(), b.column("pos").to_numpy()
        by = np.lexsort((pos, key))
        key, pos = key[by], pos[by]
        rows = np.stack([pc.fill_null(b.column(c), NONE).to_numpy()[by] for c in FIELDS], 1) if len(by) else np.zeros((0, len(FIELDS)), np.int64)
        cut = np.flatnonzero((key[1:] != key[:-1]) | (pos[1:] != pos[:-1] + 1)) + 1
        ends = np.concatenate([cut, [len(by)]])
        out = [(x, min(x + PIECE, hi)) for lo, hi in zip(np.concatenate([[0], cut]), ends, strict=True) for x in range(lo, hi, PIECE)]
        names = symbol.dictionary.to_pylist()
        ts = pa.array([int(rows[x:y, 0].max()) for x, y in out], pa.int64()).cast(pa.timestamp("us", tz="UTC"))
        columns = [pa.array([names[key[x]] for x, _ in out], pa.string()), ts, pa.array([int(pos[x]) for x, _ in out], pa.int64()), pa.array([int(pos[y - 1]) for _, y in out], pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([rows[x:y].tobytes() for x, y in out], pa.binary())], ["symbol", "ts", "lo", "hi", "rows"])


def judgements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each judged position."""
    names = pa.array(STATES)
    for b in batches:
        for symbol, lo, segments, codes, notes in zip(*[b.column(c).to_pylist() for c in ("symbol", "lo", "segments", "codes", "notes")], strict=True):
            code = np.frombuffer(codes, np.int8)
            integrity = np.full(len(code), None, object)
            integrity[np.isin(code, NOTED)] = notes
            pos = pa.nulls(len(code), pa.int64()) if lo is None else pa.array(np.arange(lo, lo + len(code)))
            yield pa.RecordBatch.from_arrays([pa.array([symbol] * len(code), pa.string()), pos, pa.array(np.frombuffer(segments, np.int64)), names.take(pa.array(code)), pa.array(integrity, pa.string())], ["symbol", "pos", "segment", "state", "integrity"])


class Continuity(StatefulProcessor):
    """State of a symbol: segment, id and last update of its book, whether it is fine, the next position, and packets that wait for a position before them, which never overlap."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "segment long, sid long, last long, fine boolean, next long, held long")
        self.waiting = handle.getMapState("waiting", "lo long, hi long", "rows binary")

    def load(self) -> None:
        self.now = tuple(self.seen.get()) if self.seen.exists() else (0, None, None, True, 1, 0)
        self.index = sorted((k[0], k[1]) for k in self.waiting.keys()) if self.now[5] else []  # ends of packets, not their rows

    def save(self) -> None:
        self.seen.update((*self.now[:5], len(self.index)))

    def judged(self, symbol: str, lo: int | None, segments: list[int], codes: list[int], notes: list[str]) -> Row:
        return Row(symbol=symbol, lo=lo, segments=np.array(segments, np.int64).tobytes(), codes=np.array(codes, np.int8).tobytes(), notes=notes)

    def take(self, symbol: str, lo: int, rows: np.ndarray) -> Row:
        segment, sid, end, fine, _, held = self.now
        segments, codes, notes = [], [], []
        for _, *values in rows.tolist():
            first, last, previous, snapshot_id = (None if x == NONE else x for x in values)
            if snapshot_id is not None:
                segment, sid, end, fine, what = segment + 1, snapshot_id, None, True, 0
            elif segment == 0 or not fine:
                what = 5
            elif last is None or last < sid:
                what = 1
            else:
                fine = bool((first is not None and first <= sid) if end is None else previous == end)
                what = (2 if end is None else 3) if fine else 4
                if not fine:
                    notes.append(f"after {sid if end is None else end} came {first if end is None else previous}")
                end = last
            segments.append(segment)
            codes.append(what)
        self.now = (segment, sid, end, fine, lo + len(rows), held)
        return self.judged(symbol, lo, segments, codes, notes)

    def follow(self, symbol: str) -> Iterator[Row]:
        """Packets that waited and are next."""
        done = 0
        while done < len(self.index) and self.index[done][0] == self.now[4]:
            key = self.index[done]
            rows = self.waiting.getValue(key)[0]
            self.waiting.removeKey(key)
            done += 1
            yield self.take(symbol, key[0], np.frombuffer(rows, np.int64).reshape(-1, len(FIELDS)))
        del self.index[:done]

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self.load()
        early = None
        for r in pieces(rows, lambda r: r.lo, 64):
            whole, at = np.frombuffer(r.rows, np.int64).reshape(-1, len(FIELDS)), r.lo
            while at <= r.hi:
                if at < self.now[4]:
                    n = min(r.hi + 1, self.now[4]) - at
                    yield self.judged(key[0], at, [self.now[0]] * n, [6] * n, [f"position {self.now[4]} was next"] * n)
                    at += n
                    continue
                k = bisect_right(self.index, (at, r.hi + (1 << 62)))
                if k and self.index[k - 1][1] >= at:  # waits already
                    at = self.index[k - 1][1] + 1
                    continue
                end = min(r.hi, self.index[k][0] - 1) if k < len(self.index) else r.hi
                part = whole[at - r.lo : end + 1 - r.lo]
                if at == self.now[4]:
                    yield self.take(key[0], at, part)
                    yield from self.follow(key[0])
                else:
                    self.waiting.updateValue((at, end), (part.tobytes(),))
                    self.index.insert(k, (at, end))
                    us = int(part[:, 0].min())
                    early = us if early is None else min(us, early)
                at = end + 1
        if self.index and early is not None:
            self.handle.registerTimer(early // 1000 + 1)
        self.save()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """What is still missing before rows the watermark has passed will not come: it is reported lost, and they follow."""
        self.load()
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        while self.index:
            pos = self.index[0][0]
            us = int(np.frombuffer(self.waiting.getValue(self.index[0])[0], np.int64, 1)[0])
            if us > mark:
                self.handle.registerTimer(us // 1000 + 1)
                break
            yield self.judged(key[0], None, [self.now[0]], [7], [f"positions {self.now[4]} to {pos - 1}"])
            self.now = (*self.now[:4], pos, self.now[5])
            yield from self.follow(key[0])
        self.save()


def continuity(events: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """The streaming twin of operators.audits.sequence_state, with integrity records; start it within rocks().

    events: symbol, us, pos, first, last, previous, snapshot_id; positions of a symbol count from 1. Rows are judged in the order of pos. One that
    comes before its turn waits in the state, until the missing ones come or the watermark passes its time; then these are reported as lost (a row
    without pos) and it follows. A row whose position is past is given as late, one that waits already is given once. Rows without symbol
    or pos go. integrity says at a gap what came instead.

    Consecutive rows travel and wait as packets (packets), so the state is asked once a packet. Rows behind the watermark are dropped when all of their packet is.

    Returns symbol, pos, segment, state, integrity.
    """
    d = events.filter("symbol is not null and pos is not null and us is not null").select("symbol", *[F.col(c).cast("long") for c in ("us", "pos", "first", "last", "previous", "snapshot_id")])
    d = d.mapInArrow(packets, PACKET).withWatermark("ts", lateness)
    return d.groupBy("symbol").transformWithState(Continuity(), JUDGED, "append", "eventTime").mapInArrow(judgements, CONTINUITY)


RING = 10  # seconds that a window reaches back


def second_features(ring: list[tuple]) -> tuple:
    """The features of the last second of a ring of (price, buy_qty, sell_qty, buys, sells, buy_notional, sell_notional); see grids.flow_features."""
    price = [s[0] for s in ring]
    total = lambda c, n: math.fsum(s[c] for s in ring[-n:])
    ratio = lambda a, b: (a - b) / (a + b) if a + b > 0 else 0.0
    out = [math.log(price[-1] / price[-1 - k]) * 1e4 if len(price) > k else None for k in (1, 3)]
    for n in (1, 3, 5, 10):
        out += [ratio(total(1, n), total(2, n)), ratio(total(3, n), total(4, n))]
    for n in (1, 5):
        out += [math.log1p(total(1, n) + total(2, n)), math.log1p(total(3, n) + total(4, n))]
    bq, sq, bv, sv = (total(c, 5) for c in (1, 2, 5, 6))
    out.append(((bv / bq) / (sv / sq) - 1) * 1e4 if bq > 0 and sq > 0 and sv > 0 else 0.0)
    return (*out, ring[-1][3] > 0, ring[-1][4] > 0)


FEATURES = (
    "ret1", "ret3", "qty_imbalance1", "count_imbalance1", "qty_imbalance3", "count_imbalance3", "qty_imbalance5", "count_imbalance5", "qty_imbalance10", "count_imbalance10",
    "log_qty1", "log_count1", "log_qty5", "log_count5", "vwap_gap_bps", "has_buys", "has_sells",
)
FLOW = "symbol string, t long, price double, " + ", ".join(f"{c} {'boolean' if c.startswith('has') else 'double'}" for c in FEATURES)


class SecondFlow(StatefulProcessor):
    """State of a symbol: a ring of its last closed seconds, and how many there were. Seconds come once, when they are closed; a batch's are put in order here."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.closed = handle.getValueState("closed", "t long, n long, ring array<struct<price:double,bq:double,sq:double,buys:double,sells:double,bv:double,sv:double>>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, n, ring = self.closed.get() if self.closed.exists() else (None, 0, [])
        ring = [tuple(x) for x in ring]
        for r in sorted(rows, key=lambda r: r.t):
            for second in (*(range(last + 1, r.t) if last is not None else ()), r.t):
                now = (r.price, r.buy_qty, r.sell_qty, float(r.buys), float(r.sells), r.buy_notional, r.sell_notional) if second == r.t else (ring[-1][0], *[0.0] * 6)
                ring, n = [*ring[-(RING - 1) :], now], n + 1
                if n > 3:
                    yield Row(symbol=key[0], t=second, price=now[0], **dict(zip(FEATURES, second_features(ring), strict=True)))
            last = r.t
        self.closed.update((last, n, ring))


def second_flow(ticks: DataFrame, lateness: str = "5 seconds") -> DataFrame:
    """The streaming twin of grids.flow_features without its label; start it within rocks().

    ticks: symbol, us, tick_id, price, qty, buyer_maker. A second is closed when the watermark has passed its end, the quiet ones before it with it:
    every second from a symbol's fourth on has a row. Ticks of closed seconds are dropped. Ticks are summed up to seconds by Spark, spread over tasks by symbol and
    second; only sums reach the state of a symbol, so its work does not grow with the ticks of a second. Rows with a null among these columns go.
    """
    d = ticks.select("symbol", "us", "tick_id", "price", "qty", "buyer_maker").dropna().withColumn("ts", F.timestamp_micros("us")).filter("us >= 0")
    part = lambda c, f: F.sum(F.when(f, c).otherwise(0.0))
    sell, notional = F.col("buyer_maker"), F.col("qty") * F.col("price")
    g = d.withWatermark("ts", lateness).groupBy("symbol", F.window("ts", "1 second").alias("w")).agg(
        F.max_by("price", F.struct("us", "tick_id")).cast("double").alias("price"), part(F.col("qty"), ~sell).alias("buy_qty"), part(F.col("qty"), sell).alias("sell_qty"),
        F.count_if(~sell).alias("buys"), F.count_if(sell).alias("sells"), part(notional, ~sell).alias("buy_notional"), part(notional, sell).alias("sell_notional"),
    )
    return g.withColumn("t", F.unix_seconds("w.start")).groupBy("symbol").transformWithState(SecondFlow(), FLOW, "append", "eventTime")


METRICS = (
    "bid", "ask", "bid_qty", "ask_qty", "mid", "spread_bps", "microprice", "microprice_bps", "imbalance1", "bid_depth5", "ask_depth5", "imbalance5", "bid_depth10", "ask_depth10", "imbalance10",
)
SAMPLE = "symbol string, slot long, valid boolean, " + ", ".join(f"{c} double" for c in METRICS) + ", last_id long, buy_qty double, sell_qty double, buys long, sells long, qty_imbalance double, count_imbalance double"
EVENT = "us long, seq long, snapshot boolean, side string, level double, amount double, qty double, buyer_maker boolean"


def book_figures(bids: dict[float, float], asks: dict[float, float]) -> dict[str, float]:
    """The metrics of a valid book; see books.book_metrics."""
    b, a = sorted(bids.items(), reverse=True)[:10], sorted(asks.items())[:10]
    (bp, bq), (ap, aq) = b[0], a[0]
    mid, micro = (bp + ap) / 2, (bp * aq + ap * bq) / (bq + aq)
    out = {"bid": bp, "ask": ap, "bid_qty": bq, "ask_qty": aq, "mid": mid, "spread_bps": (ap - bp) / mid * 1e4, "microprice": micro, "microprice_bps": (micro / mid - 1) * 1e4}
    for n in (1, 5, 10):
        x, y = sum(q for _, q in b[:n]), sum(q for _, q in a[:n])
        out |= ({} if n == 1 else {f"bid_depth{n}": x, f"ask_depth{n}": y}) | {f"imbalance{n}": (x - y) / (x + y)}
    return out


FOLDED = ("slot", "us", "seq", "snapshot", "ask", "buys", "sells"), ("level", "amount", "buy_qty", "sell_qty")  # ask: 0 or 1, NONE at trades
SUMS = "symbol string, whole binary, parts binary"


def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The summed events of a symbol within each batch in one row: whole numbers and doubles, columns as in FOLDED."""
    for b in batches:
        symbol = b.column("symbol").dictionary_encode()
        key = symbol.indices.to_numpy()
        whole = np.stack([pc.fill_null(b.column(c), NONE).to_numpy() for c in FOLDED[0]], 1)
        parts = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in FOLDED[1]], 1)
        of = [key == k for k in range(len(symbol.dictionary))]
        yield pa.RecordBatch.from_arrays([symbol.dictionary, *[pa.array([m[x].tobytes() for x in of], pa.binary()) for m in (whole, parts)]], ["symbol", "whole", "parts"])


class ValidBook(StatefulProcessor):
    """State of a symbol: the book as the closed slots left it. Each slot's sums come once, when it is closed; a batch's are put in order here."""

    def __init__(self, step_us: int) -> None:
        self.step = step_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.book = handle.getValueState("book", "bids array<struct<level:double,amount:double>>, asks array<struct<level:double,amount:double>>, there boolean, valid boolean, seq long, slot long")

    def row(self, symbol: str, slot: int, state: tuple, trades: tuple, figures: dict[str, float]) -> Row:
        ratio = lambda x, y: (x - y) / (x + y) if x + y > 0 else 0.0
        return Row(symbol=symbol, slot=slot * self.step, valid=True, **{c: figures[c] for c in METRICS}, last_id=state[4], buy_qty=trades[0], sell_qty=trades[1], buys=trades[2], sells=trades[3], qty_imbalance=ratio(*trades[:2]), count_imbalance=ratio(*trades[2:]))

    def change(self, state: tuple, us: np.ndarray, whole: np.ndarray, parts: np.ndarray) -> tuple[tuple, int | None]:
        """The book after the groups of a slot, and the last time at which it was not valid."""
        bids, asks, there, valid, seq = state
        cut, edges = None, np.flatnonzero(np.diff(us, prepend=-1, append=-1) != 0) if len(us) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if whole[a:b, 3].any():
                bids, asks, there, valid = {}, {}, True, True
            if not there:
                continue
            for ask, level, amount in zip(whole[a:b, 4].tolist(), *parts[a:b, :2].T.tolist(), strict=True):
                (asks if ask else bids)[level] = amount
            bids, asks = ({p: q for p, q in x.items() if q > 0} for x in (bids, asks))
            valid = valid and bool(bids and asks) and max(bids) < min(asks)
            seq = int(whole[a:b, 2].max())
            cut = cut if valid else int(us[a])
        return (bids, asks, there, valid, seq), cut

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """Slots with events in their order: the quiet ones before each show the book as it stood, then its groups change the book, and it is shown if it is valid."""
        bids, asks, *rest, last = self.book.get() if self.book.exists() else ([], [], False, False, None, None)
        state = (*({x[0]: x[1] for x in side} for side in (bids, asks)), *rest)
        raw = [(r.whole, r.parts) for r in rows]
        whole = np.frombuffer(b"".join(x for x, _ in raw), np.int64).reshape(-1, len(FOLDED[0]))
        parts = np.frombuffer(b"".join(x for _, x in raw), np.float64).reshape(-1, len(FOLDED[1]))
        by = np.lexsort((parts[:, 1], whole[:, 2], whole[:, 1], whole[:, 0]))
        whole, parts = whole[by], parts[by]
        edges = np.flatnonzero(np.diff(whole[:, 0], prepend=NONE, append=NONE))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            slot = int(whole[a, 0])
            if state[3] and last is not None and last + 1 < slot:
                figures = book_figures(*state[:2])
                yield from (self.row(key[0], quiet, state, (0.0, 0.0, 0, 0), figures) for quiet in range(last + 1, slot))
            w, p = whole[a:b], parts[a:b]
            trade = w[:, 4] == NONE
            state, cut = self.change(state, w[~trade, 1], w[~trade], p[~trade])
            if state[3]:
                counted = trade if cut is None else trade & (w[:, 1] > cut)
                totals = (*map(float, p[counted, 2:].sum(0)), *map(int, w[counted, 5:].sum(0)))
                yield self.row(key[0], slot, state, totals, book_figures(*state[:2]))
            last = slot
        bids, asks, *rest = state
        self.book.update((list(bids.items()), list(asks.items()), *rest, last))


def sampled_rows(events: DataFrame, step_us: int = 1_000_000, lateness: str = "5 seconds") -> DataFrame:
    """The streaming twin of books.sampled_rows: one operator over two kinds of events; start it within rocks().

    events: book updates (symbol, us, seq, snapshot, side, level, amount) and trades (symbol, us, qty, buyer_maker; no side) in one stream. A slot is folded when the watermark
    has passed its end; the trades of a slot up to the last time at which the book was not valid are cleared. Spark sums events up by symbol and time, updates by level too,
    of which the last amount counts, spread over tasks; only sums of closed slots reach the state of a symbol, so its work does not grow with the events of a time. Events of
    closed slots are dropped. Rows with a null among the columns of their kind go.
    """
    kinds = {x.split(" ")[0]: x.split(" ")[1] for x in EVENT.split(", ")}
    d = events.select("symbol", *[F.col(c).cast(k).alias(c) for c, k in kinds.items()]).filter("symbol is not null and us is not null")
    whole = lambda *names: F.concat(*[F.col(c).cast("string") for c in names]).isNotNull()
    d = d.filter(F.when(F.col("side").isNotNull(), whole("seq", "snapshot", "level", "amount")).otherwise(whole("qty", "buyer_maker")))
    d = d.withColumn("ask", F.when(F.col("side") == "bid", 0).when(F.col("side").isNotNull(), 1).cast("long")).withColumn("level", F.when(F.col("side").isNotNull(), F.col("level")))
    slot, trade, sell = F.ceil(F.col("us") / step_us).cast("long").alias("slot"), F.col("ask").isNull(), F.col("buyer_maker")
    part = lambda f: F.sum(F.when(trade & f, F.col("qty")).otherwise(0.0))
    slots = F.window("ts", f"{step_us} microseconds", startTime="1 microsecond").alias("w")  # right-closed
    g = d.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", lateness).groupBy("symbol", slots, slot, "us", "ask", "level").agg(
        F.max("seq").alias("seq"), F.max(F.col("snapshot").cast("long")).alias("snapshot"), F.max_by("amount", F.struct("seq", "amount")).alias("amount"),
        part(~sell).alias("buy_qty"), part(sell).alias("sell_qty"), F.count_if(trade & ~sell).alias("buys"), F.count_if(trade & sell).alias("sells"),
    )
    d = g.select("symbol", *FOLDED[0], *FOLDED[1]).mapInArrow(sums, SUMS)
    return d.groupBy("symbol").transformWithState(ValidBook(step_us), SAMPLE, "append", "none")


class Regression(Exception):
    """Arrival times that go back."""


def fan_out(arrivals: DataFrame, name: str, *, late_us: int, state: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Main and late rows of a stream of arrivals (local_us, us): rows older than late_us at their arrival go to a side table, all others to the main one.

    The arrival time is the only clock. A micro-batch that holds an arrival before the last one of an earlier batch aborts the stream, and
    writes nothing. Each batch is written into a folder of its number, which a repeated batch replaces: after a crash nothing is lost or doubled.
    state: a folder to go on from; None begins anew. Rows without times count as late. Returns both tables as they are now, each with its batch number.
    """
    spark = arrivals.sparkSession
    folder = state or new_folder(spark, name)
    schema = arrivals.schema

    def table(kind: str) -> DataFrame:
        return spark.read.schema(schema.add("batch", "long")).parquet(f"{folder}/{kind}")

    jvm = spark._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)

    def put(batch: DataFrame, number: int) -> None:
        ends = batch.agg(F.min("local_us").alias("lo"), F.max("local_us").alias("hi")).first()
        fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        earlier = spark.read.schema("batch long, hi long").parquet(f"{folder}/clock").filter(F.col("batch") < number).agg(F.max("hi")).first()[0] if fs.exists(path(f"{folder}/clock")) else None
        if earlier is not None and ends.lo is not None and ends.lo < earlier:
            raise Regression(f"arrival {ends.lo} after {earlier}")
        late = F.coalesce(F.col("local_us") - F.col("us") > late_us, F.lit(True))
        for kind, rows in (("main", batch.filter(~late)), ("late", batch.filter(late))):
            rows.write.mode("overwrite").parquet(f"{folder}/{kind}/batch={number}")
        spark.createDataFrame([(ends.hi,)], "hi long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/clock/batch={number}")

    query = arrivals.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return table("main"), table("late")
