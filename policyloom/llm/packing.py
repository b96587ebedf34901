"""Mixture-controlled packing: every sequence is filled from all source queues in their target proportions.

Deficit round-robin gives each queue, for each sequence, its share of the sequence's tokens; what rounding withholds
from a queue, or gives it too early, is its deficit and is carried on.  With the queues' shares known, the state of the
deficits before any sequence follows from the sequence's number alone: with F(q, x) the share of queue q in the first
x tokens, and G the running sum of F over queues, q has got floor(G(q, x)) - floor(G(q - 1, x)) tokens.  So every task
places its own documents, and no state has to be passed from sequence to sequence or from task to task.

A queue without a whole token in each sequence would not come round in order; such sources wait in one common queue,
so there are at most as many queues as a sequence has tokens, however many sources there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from policyloom.llm.arrays import id_back, id_of, split_frames
from policyloom.llm.tokens import WordEncoder, crc_of
from policyloom.session import materialize


@dataclass(frozen=True)
class Phase:
    """From the ``begin``-th token on, the first q queues have got floor((p[q] + x * m[q]) / r) of x tokens."""

    begin: Fraction
    p: tuple[int, ...]
    m: tuple[int, ...]
    r: int


def phases_of(totals: list[int], weights: list[int]) -> list[Phase]:
    """Queues give by weight until they are empty; then the others share what is left by theirs."""
    got, begin, out = [Fraction(0)] * len(totals), Fraction(0), []
    open_queues = [q for q, n in enumerate(totals) if n]
    while open_queues:
        whole = sum(weights[q] for q in open_queues)
        slope = [Fraction(weights[q], whole) if q in set(open_queues) else Fraction(0) for q in range(len(totals))]
        span = min((totals[q] - got[q]) / slope[q] for q in open_queues)
        sums = [(Fraction(0), Fraction(0))]
        for g, s in zip(got, slope, strict=True):
            sums.append((sums[-1][0] + g - s * begin, sums[-1][1] + s))
        r = np.lcm.reduce([1], dtype=object)
        for a, b in sums:
            r = int(np.lcm(int(r), int(np.lcm(a.denominator, b.denominator, dtype=object)), dtype=object))
        out.append(Phase(begin, tuple(int(a * r) for a, _ in sums), tuple(int(b * r) for _, b in sums), int(r)))
        got = [g + s * span for g, s in zip(got, slope, strict=True)]
        begin += span
        open_queues = [q for q in open_queues if got[q] < totals[q]]
    return out


class Schedule:
    """Where each token of each queue goes."""

    def __init__(self, totals: list[int], weights: list[int], length: int) -> None:
        self.length, self.total = length, sum(totals)
        self.full = self.total // length
        self.phases = phases_of(totals, weights)
        # the rest fills sequences of the powers of two that make it up, so nothing is padded
        rest = self.total - self.full * length
        self.tail = [self.full * length]
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                self.tail.append(self.tail[-1] + (1 << bit))

    def sums(self, window: int, queue: int) -> tuple[int, int]:
        """What the queues before this one, and with it, have got before a window."""
        x = min(window * self.length, self.total)
        phase = self.phases[0]
        for later in self.phases[1:]:
            if later.begin > x:
                break
            phase = later
        return (phase.p[queue] + x * phase.m[queue]) // phase.r, (phase.p[queue + 1] + x * phase.m[queue + 1]) // phase.r

    def pieces(self, queue: int, first: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(token of the document, length, sequence, offset) for the queue's tokens from ``first`` on."""
        low, high = 0, self.full + 1
        while high - low > 1:
            mid = (low + high) // 2
            before, after = self.sums(mid, queue)
            low, high = (mid, high) if after - before <= first else (low, mid)
        window, at = low, first
        before, after = self.sums(window, queue)
        while at < first + n:
            next_before, next_after = self.sums(window + 1, queue)
            size = min(next_after - next_before, first + n) - at
            if size > 0:
                place = window * self.length + (next_before - before) + at - (after - before)
                yield from self._cut(at - first, size, place)
                at += size
            window, before, after = window + 1, next_before, next_after

    def _cut(self, start: int, size: int, place: int) -> Iterator[tuple[int, int, int, int]]:
        if place < self.tail[0]:
            yield start, size, place // self.length, place % self.length
            return
        for k, (a, b) in enumerate(zip(self.tail, self.tail[1:], strict=False)):
            low, high = max(a, place), min(b, place + size)
            if low < high:
                yield start + low - place, high - low, self.full + k, low - a


def _encode(tokenizer: str, end: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = WordEncoder(tokenizer)
        for frame in (p for whole in frames for p in split_frames(whole)):
            ids, n = encoder.encode(frame["text"].tolist(), end)
            cuts = np.concatenate(([0], np.cumsum(n)))
            yield frame[["doc_id", "source"]].assign(
                n=n, width=ids.dtype.itemsize, ids=[ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            )

    return run


def _place(schedule: Schedule):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for i in range(0, len(whole), 500):
                out = []
                for row in whole.iloc[i : i + 500].itertuples():
                    ids = np.frombuffer(row.ids, f"<u{row.width}")
                    for start, size, sequence, offset in schedule.pieces(row.queue, row.first, row.n):
                        crc = crc_of(ids[start : start + size])
                        out.append((row.doc_id, start, size, crc, row.n, sequence, offset, row.source))
                yield pd.DataFrame(out, columns=[
                    "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source",
                ])

    return run


def pack(
    docs: DataFrame, tokenizer: str, end: int = 2, length: int = 4096, weights: Mapping[str | None, int] | None = None
) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source)`` that fill all sequences.

    Every row is packed as its own document, a null text as the empty one (the end id alone), rows of one id one by
    one; a null source is a source, null ids come back as null.  ``weights`` are the sources' target shares; by default
    each source gives in proportion to its tokens, so that all end together.  Sequences have ``length`` ids, but for
    the last ones, which are the powers of two that make up the rest.
    """
    texts = docs.select(id_of().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").cast("string").alias("source"))
    encoded = texts.mapInPandas(_encode(tokenizer, end), "doc_id long, source string, n long, width int, ids binary")
    # the number of a row is fixed by writing it
    rows = materialize(encoded.withColumn("row", F.monotonically_increasing_id()))
    totals = rows.groupBy("source").agg(F.sum("n").alias("total"))
    if weights:
        given = F.create_map(*[F.lit(x) for k, w in weights.items() if k is not None for x in (k, int(w))]) if any(
            k is not None for k in weights
        ) else F.create_map().cast("map<string,int>")
        weight = F.coalesce(F.when(F.col("source").isNull(), F.lit(weights.get(None))).otherwise(given[F.col("source")]), F.lit(1)).cast("long")
    else:
        weight = F.col("total")
    totals = materialize(totals.withColumn("weight", weight))
    sums = totals.agg(F.sum("total"), F.sum("weight")).first()
    if sums[0] is None:
        return rows.select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n").alias("length"), F.lit(0).cast("long").alias("ids_crc32"), F.col("n").alias("doc_tokens"), F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "source")
    # at most ``length`` sources have a whole token in each sequence
    own = totals.where(F.col("weight") * length >= sums[1]).orderBy(F.col("source").asc_nulls_last()).collect()
    rest = sums[0] - sum(r.total for r in own), sums[1] - sum(r.weight for r in own)
    queues = [[r.total, r.weight] for r in own]
    if rest[0]:
        if own and rest[1] * length < sums[1]:
            queues[-1] = [queues[-1][0] + rest[0], queues[-1][1] + rest[1]]
        else:
            queues.append([rest[0], max(rest[1], 1)])
    schedule = Schedule([q[0] for q in queues], [q[1] for q in queues], length)
    names = {r.source: k for k, r in enumerate(own)}
    last = len(queues) - 1
    known = [F.lit(x) for name, k in names.items() if name is not None for x in (name, k)]
    queue = F.coalesce(F.create_map(*known)[F.col("source")], F.lit(last)) if known else F.lit(last)
    if None in names:
        queue = F.when(F.col("source").isNull(), F.lit(names[None])).otherwise(queue)
    # where a row stands in its queue: sums of the blocks before its own, then of the rows before it in the block
    narrow = rows.select("row", queue.cast("int").alias("queue"), "n", F.shiftright("row", 12).alias("block"))
    blocks = narrow.groupBy("queue", "block").agg(F.sum("n").alias("block_n"))
    ahead = Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("queue", "block", F.coalesce(F.sum("block_n").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("queue", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, ["queue", "block"]).select(
        "row", "queue", (F.col("base") + F.col("inner")).alias("first")
    )
    out = rows.join(placed, "row").select("doc_id", "source", "n", "width", "ids", "queue", "first").mapInPandas(
        _place(schedule),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string",
    )
    return out.withColumn("doc_id", id_back("doc_id"))
