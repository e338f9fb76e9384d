"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a stream of tokens, and the schedule of the whole corpus says how much of each stream is due when: all
sources at the pace of their target shares, until one is dry and the rest share its place. The schedule is cut into
parts of equal size, so a part holds the stretch of every stream that is due in it, and keeps the targets as one long
run over the corpus would; documents are cut where a stretch ends. Positions in the streams come from prefix sums of
token counts per task and source.

A part is packed by one task: each source has a queue, and in each round a queue earns its share of a window as deficit
and is served what it has earned. Windows of `window` tokens are cut from that stream, so deficits carry from window to
window, and a part starts with what each source is owed by the schedule at that point (stretches end at whole grains of
tokens, so that is at most a grain). The last, partly filled window of a part is laid out as sequences of powers of two,
which need no padding. A part has a fixed number of tokens at any size of the corpus, and hot sources are spread over
all parts.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, partitions, table
from .tokens import encoder, forget, vocabulary

WINDOW, END_ID, MIN_PIECE = 2048, 1, 64
#: Tokens of a part; a table with fewer than that many for each shuffle partition has a part for each.
PART = 1_000_000
#: Token counts per task and source that go to every task; beyond that they are joined by key.
BROADCAST_COUNTS = 200_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids binary"


def tokenise(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, source, chunk, off, n, ids): the ids of each whole text and the end id, as little-endian integers; off
    counts the tokens of the same source before it in its chunk, which is what one task wrote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, chunk, upto = encoder(path), TaskContext.get().partitionId(), {}
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [x + end for x in enc.encode(part.column(2).to_pylist())]
                n = [len(x) // enc.dtype.itemsize for x in ids]
                off = []
                for source, k in zip(part.column(1).to_pylist(), n):
                    off.append(upto.get(source, 0))
                    upto[source] = off[-1] + k
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array([chunk] * len(n), pa.int64()), pa.array(off, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "source", "chunk", "off", "n", "ids"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, source string, chunk long, off long, n long, ids binary")


class _Windows:
    """Lays tokens out into windows, and a last partial one into powers of two."""

    def __init__(self, first: int, window: int):
        self.next, self.window, self.fill, self.held, self.done = first, window, 0, [], []

    def add(self, doc, start: int, n: int) -> None:
        while n:
            k = min(n, self.window - self.fill)
            self.held.append((doc, start, k))
            self.fill, start, n = self.fill + k, start + k, n - k
            if self.fill == self.window:
                self._flush([self.window])

    def _flush(self, sizes: list[int]) -> None:
        at, size = 0, iter(sizes)
        room = next(size)
        for doc, start, n in self.held:
            while n:
                if not room:
                    self.next, at, room = self.next + 1, 0, next(size)
                k = min(n, room)
                self.done.append((doc, start, k, self.next, at))
                at, room, start, n = at + k, room - k, start + k, n - k
        self.next, self.fill, self.held = self.next + 1, 0, []

    def close(self) -> None:
        if self.fill:
            self._flush([1 << i for i in range(self.fill.bit_length() - 1, -1, -1) if self.fill >> i & 1])


class Schedule:
    """When each token of each source is due, as a share of all tokens.

    Pace: a weighted source has consumed weight * v tokens at pace v until it is dry; sources without a weight follow
    once all others are dry, by their sizes. Without weights at all, every source is consumed from 0 to 1.
    """

    def __init__(self, total: int, weighted: dict[str, tuple[float, int]] | None):
        self.total, self.last = total, 0.0
        if weighted is None:
            self.pace, self.due = np.array([0.0, 1.0]), np.array([0.0, float(total)])
            return
        ends = sorted({n / w for w, n in weighted.values()})
        due = [sum(min(n, w * v) for w, n in weighted.values()) for v in ends]
        self.last = ends[-1] if ends else 0.0
        self.pace, self.due = np.array([0.0, *ends, self.last + 1]), np.array([0.0, *due, float(total)])

    def part(self, pace: np.ndarray, parts: int) -> np.ndarray:
        """The part in which the token that ends at a pace is due."""
        found = np.ceil(np.interp(pace, self.pace, self.due) * (parts / self.total)).astype(np.int64) - 1
        return np.clip(found, 0, parts - 1)

    def start(self, part: int, parts: int) -> float:
        return float(np.interp(part * (self.total / parts), self.due, self.pace))


def placed_in(x: np.ndarray, size: np.ndarray, grain: int, shift: np.ndarray, late: np.ndarray, rate: np.ndarray, schedule: Schedule, parts: int) -> np.ndarray:
    """The part of each token x of streams of `size`: that in which its grain is due; see stretches."""
    grain = np.minimum(grain, size)
    shift = shift % grain
    ends = ((x + shift) // grain + 1) * grain - shift
    return schedule.part(late + np.where(ends > size, np.maximum(ends - grain, 1), ends) / rate, parts)


def stretches(x: int, n: int, size: int, grain: int, shift: int, late: float, rate: float, schedule: Schedule, parts: int) -> list[tuple[int, int, int]]:
    """(part, first, end) of the tokens x ... x + n of a source's stream of `size`, counted from x.

    Stretches end at whole grains, moved by `shift`; what is left at the end of a stream goes with the grain before it.
    """
    grain = min(grain, size)
    shift %= grain
    ends = (np.arange((x + shift) // grain, (x + n - 1 + shift) // grain + 1) + 1) * grain - shift
    part = placed_in(ends - 1, np.int64(size), grain, np.int64(shift), late, rate, schedule, parts)
    at = np.flatnonzero(part[1:] != part[:-1])
    cuts = [0, *(ends[at] - x).tolist(), n]
    return [(p, s, e) for p, s, e in zip([*part[at].tolist(), int(part[-1])], cuts[:-1], cuts[1:])]


def round_robin(queues: dict, rates: dict, owed: dict, windows: _Windows, least: int) -> None:
    """Serve all queues of (doc, tokens) until they are dry.

    In each round a queue earns its share of a window, by the rates of those that aren't dry, beside what it is owed at
    the start. A queue is served once its deficit has reached `least` tokens (or its whole rest), so that thousands of
    small sources don't fall into single tokens; what isn't served stays owed.
    """
    waiting = {s: sum(n for _, n in q) for s, q in queues.items()}
    active = sorted(s for s in queues if waiting[s])
    owed, started = {s: owed.get(s, 0.0) for s in active}, dict.fromkeys(active, 0)
    while active:
        share = sum(rates[s] for s in active)
        gains = {s: windows.window * rates[s] / share for s in active}
        # if nobody can be served for many rounds, pass them at once
        wait = min(max(0.0, min(least, waiting[s]) - owed[s]) / gains[s] for s in active)
        rounds = max(1, int(wait))
        dry = False
        for s in active:
            owed[s] += gains[s] * rounds
            if owed[s] < min(least, waiting[s]):
                continue
            take = min(int(owed[s]), waiting[s])
            owed[s] -= take
            waiting[s] -= take
            dry |= not waiting[s]
            queue = queues[s]
            while take:
                doc, n = queue[0]
                k = min(take, n - started[s])
                windows.add(doc, started[s], k)
                take -= k
                started[s] += k
                if started[s] == n:
                    queue.popleft()
                    started[s] = 0
        if dry:
            active = [s for s in active if waiting[s]]


def pack(docs: DataFrame, path: str, end_id: int = END_ID, window: int = WINDOW, weights: dict[str, float] | None = None, parts: int | None = None, with_ids: bool = True, least: int = MIN_PIECE) -> DataFrame:
    """Pieces of the packed sequences, as in PIECES; sequence ids are unique, ascending within a part, not dense.

    weights: target share of each source (default: its share of all tokens). Every token is packed once, so targets
    hold until a source is dry; the others then share its place, and sources without a weight come last. Null text
    counts as empty (its end id alone), a null source as '', and a null doc_id stays null; texts of any length are cut
    freely; repeated rows are packed as often as they occur; other columns are ignored; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    tok = cut(tokenise(docs, path, end_id), "tokens")
    counts = cut(tok.groupBy("chunk", "source").agg(F.sum("n").alias("n")), "counts")
    size = counts.agg(F.sum("n").alias("tokens"), F.count("*").alias("rows")).first()
    total = size.tokens or 0
    parts = parts or max(partitions(spark), -(-total // PART))
    positive = None if weights is None else {k: float(v) for k, v in weights.items() if v > 0}
    weighted = None
    if positive is not None:
        found = counts.where(F.col("source").isin(list(positive))).groupBy("source").agg(F.sum("n").alias("n")).collect() if positive else []  # a row per weight
        weighted = {r.source: (positive[r.source], r.n) for r in found}
    schedule = Schedule(max(total, 1), weighted)
    own = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select("chunk", "source", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("base")).join(counts.groupBy("source").agg(F.sum("n").alias("size")), "source")
    if size.rows <= BROADCAST_COUNTS:
        placed = F.broadcast(placed)
    rows = tok.join(placed, ["chunk", "source"]).select("doc_id", "source", "n", "ids", (F.col("base") + F.col("off")).alias("x"), "size", F.pmod(F.xxhash64("source"), F.lit(1 << 20)).alias("shift"))

    def pace(source: str, n: int) -> tuple[float, float]:
        """The pace at which a source begins, and its tokens for each unit of pace."""
        return (0.0, float(n)) if weighted is None else (0.0, weighted[source][0]) if source in weighted else (schedule.last, float(n))

    dealt = "part long, doc_id long, source string, n long, ids binary, x long, size long, first long"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        width, names = encoder(path).dtype.itemsize, [c.split()[0] for c in dealt.split(", ")]
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        for b in batches:
            # documents that lie in one part pass through; few are cut
            kinds = b.column(1).dictionary_encode()
            n, x, size, shift = (b.column(i).to_numpy() for i in (2, 4, 5, 6))
            whole, at = kinds.dictionary.to_pylist(), kinds.indices.to_numpy()
            sizes = np.zeros(len(whole), dtype=np.int64)
            sizes[at] = size
            paces = np.array([pace(s, int(k)) for s, k in zip(whole, sizes)]).reshape(-1, 2)
            first, last = (placed_in(y, size, least, shift, paces[at, 0], paces[at, 1], schedule, parts) for y in (x, x + n - 1))
            one = pa.array(first == last)
            kept = b.filter(one)
            yield pa.RecordBatch.from_arrays([pa.array(first[first == last]), *(kept.column(i) for i in range(6)), pa.array(np.zeros(kept.num_rows, np.int64))], names)
            cut_ = b.filter(pa.array(first != last))
            for lo in range(0, cut_.num_rows, 1000):
                out: list[list] = [[] for _ in range(8)]
                for doc, source, k, ids, y, whole_, turn in zip(*(c.to_pylist() for c in cut_.slice(lo, 1000).columns)):
                    late, rate = pace(source, whole_)
                    for part, s, e in stretches(y, k, whole_, least, turn, late, rate, schedule, parts):
                        for c, v in zip(out, (part, doc, source, k, ids[s * width : e * width], y + s, whole_, s)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    ordered = rows.mapInArrow(deal, dealt).repartition(min(parts, partitions(spark)), "part").sortWithinPartitions("part", "source", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = encoder(path).dtype
        now, held = None, []

        def packed() -> Iterator[pa.RecordBatch]:
            began = schedule.start(now, parts)
            queues, rates, owed = ({}, {}), {}, {}
            for row in held:
                source, x, size = row[1], row[4], row[5]
                if source not in rates:
                    late, rates[source] = pace(source, size)
                    owed[source] = min(max((began - late) * rates[source], 0.0), float(size)) - x
                    queues[late > 0][source] = deque()
                queues[pace(source, size)[0] > 0][source].append((row, len(row[3]) // width.itemsize))
            windows = _Windows(now << 32, window)
            for q in queues:  # weighted sources first
                round_robin(q, rates, owed, windows, least)
            windows.close()
            held.clear()
            wide: dict[int, memoryview] = {}
            for at in range(0, len(windows.done), 20_000):
                some = windows.done[at : at + 20_000]
                cols: list[list] = [[] for _ in range(9)]
                for row, start, n, seq, offset in some:
                    doc, source, doc_n, ids, _, _, first = row
                    view = wide.get(id(row))
                    if view is None:
                        view = wide[id(row)] = memoryview(np.frombuffer(ids, width).astype("<u4").tobytes())
                    crc = zlib.crc32(view[4 * start : 4 * (start + n)])
                    own = ids[start * width.itemsize : (start + n) * width.itemsize] if with_ids else None
                    for c, v in zip(cols, (doc, first + start, n, crc, doc_n, seq, offset, source, own)):
                        c.append(v)
                    if 4 * (start + n) == len(view):
                        wide.pop(id(row))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 7 + [pa.string(), pa.binary()])], [x.split()[0] for x in PIECES.split(", ")])

        for b in batches:
            for at in range(0, b.num_rows, 1000):
                for part, *row in zip(*(c.to_pylist() for c in b.slice(at, 1000).columns)):
                    if part != now and held:
                        yield from packed()
                    now = part
                    held.append(row)
        if held:
            yield from packed()

    return ordered.mapInArrow(run, PIECES)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return pack(docs, vocabulary(), with_ids=False).drop("ids")
