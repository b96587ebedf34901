"""Conversation structure repair: the cheapest edits that make turns alternate, by a Viterbi search in parallel chunks.

Rows are kept, given another role, deleted, or joined by new empty ones, until the roles' initials read
``(s?(ua)+)?``.  The search runs over four states: nothing yet, after the system's turn, after a user's, after an
assistant's.  It goes from the last row to the first and gives every row the cost of what is still to be done from each
state; forwards, the first letter in ASCII order among the cheapest edits is taken.

A conversation of any length is spread over many tasks.  Rows are sorted over the whole table and cut into chunks.  A
chunk does not know the costs behind it, so it starts from speculative vectors, one for each state.  Costs that differ
only by a constant lead to the same edits, and after a few rows all start vectors have led to the same one up to a
constant; where they have not, fix-up passes carry the true vector from chunk to chunk until no border changes by more
than a constant.  The edits of a chunk are then traced from every state it may be entered in, and the chunks' ways are
joined by further passes in the other direction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policyloom.session import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_FAR = 1 << 40
_NORMAL, _CUT, _BLANK, _COPY = range(4)
#: The state that a user's or assistant's turn leads to from each state, or that a row with an own initial leads to.
_TURN = (2, 2, 3, 2)
_KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
_END = (0, 2 * INSERT, INSERT, 0)
_SPACE = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class RepairSettings:
    """``chunk_bits``: a chunk has two to this power rows; ``block``: chunks that one task of a fix-up pass takes."""

    chunk_bits: int = 12
    block: int = 4096


# --- costs ------------------------------------------------------------------------------------------------------


def _edits(code: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next state of each edit of a row; a code is 4 times its fault plus its initial."""
    fault, initial = divmod(code, 4)
    yield "D", DELETE, state
    if fault < _BLANK:
        more = TRUNCATED if fault == _CUT else 0
        if (state, initial) in _KEPT:
            yield "K", KEEP + more, _KEPT[state, initial]
        yield "R", REROLE + more, _TURN[state]


def _closed(costs: list[int]) -> tuple[int, ...]:
    """Costs when rows may be inserted first; more than two in one place never pay."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[_TURN[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


class Costs:
    """Vectors of costs up to a constant; there are few, so each step is worked out once."""

    def __init__(self) -> None:
        self.steps: dict[tuple[int, tuple[int, ...]], tuple[tuple[int, ...], int]] = {}

    @staticmethod
    def level(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
        least = min(costs)
        return tuple(_FAR if c >= _FAR // 2 else c - least for c in costs), least

    def before(self, code: int, behind: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
        """The vector before a row, and the constant that was taken off."""
        found = self.steps.get((code, behind))
        if found is None:
            own = [min(cost + behind[to] for _, cost, to in _edits(code, s)) for s in range(4)]
            found = self.steps[code, behind] = self.level(_closed(own))
        return found

    def back(self, codes: bytes, end: tuple[int, ...]) -> list[tuple[int, ...]]:
        """The vectors before each row and behind the last."""
        out = [end]
        for code in reversed(codes):
            out.append(self.before(code, out[-1])[0])
        return out[::-1]

    def through(self, codes: bytes, end: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
        total = 0
        for code in reversed(codes):
            end, less = self.before(code, end)
            total += less
        return end, total

    def trace(self, codes: bytes, vectors: list[tuple[int, ...]], state: int, last: bool) -> tuple[str, int, int]:
        """Letters, cost and end state of the cheapest edits, the least in ASCII order."""
        letters, total = [], 0
        for code, now, behind in zip(codes, vectors, vectors[1:], strict=False):
            _, less = self.before(code, behind)
            while True:
                # D, then I, then K, then R
                here, edits = now[state] + less, list(_edits(code, state))
                choice = edits[0] if edits[0][1] + behind[edits[0][2]] == here else None
                if choice is None and INSERT + now[_TURN[state]] == now[state]:
                    letters.append("I")
                    total, state = total + INSERT, _TURN[state]
                    continue
                choice = choice or next(e for e in edits[1:] if e[1] + behind[e[2]] == here)
                letters.append(choice[0])
                total, state = total + choice[1], choice[2]
                break
        while last and state in (1, 2):
            letters.append("I")
            total, state = total + INSERT, _TURN[state]
        return "".join(letters), total, state


# --- rows -------------------------------------------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text)`` with planted faults, by the crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes out ``[.!?]``, 3 repeats it, 4 makes its role user.  Nulls count as one
    space, in the checksum and as role or text; null turns and conversations stay null.
    """
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    found = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), kind.alias("_kind"))
    return found.where("_kind != 0").select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    ).drop("_copy")


def _key(conv: Column) -> Column:
    return F.when(conv.isNull(), "").otherwise(F.concat(F.lit("="), conv.cast("string")))


def ordered_rows(rows: DataFrame) -> DataFrame:
    """All rows in one order, written: by conversation and turn (nulls first), then role and text.

    ``place`` rises in that order.  ``conv`` is the conversation's id as a string that is never null.  The range of a
    long conversation, or of many rows of one turn, is cut like any other, as a number of the row is the last key.
    """
    plain = rows.select(
        _key(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    ).withColumn("_row", F.monotonically_increasing_id())
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, chars // (32 << 20) + 1)
    keys = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text", "_row")]
    line = plain.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    said = F.btrim("text", F.lit(_SPACE))
    initial = F.substring("role", 1, 1)
    return materialize(line.select(
        F.monotonically_increasing_id().alias("place"), "conv", "turn", "role", "text",
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"),
        F.when(said == "", _BLANK).when(~F.substring(said, -1, 1).isin(".", "!", "?"), _CUT).otherwise(_NORMAL).alias("fault"),
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("said"),
    ))


_SEGMENT = (
    "conv string, chunk long, edge boolean, codes binary, matrix array<long>, audit string, cost long, entry int, "
    "blank long, duplicate long, truncated long, illegal long, head int, tail int, first_turn long, last_turn long, turns long"
)


def _is_legal(first: np.ndarray | int, second: np.ndarray | int):
    return (first == 0) & (second == 1) | (first == 1) & (second == 2) | (first == 2) & (second == 1)


def _segments(key: tuple, rows: pd.DataFrame, firsts: pd.DataFrame) -> pd.DataFrame:
    names = [c.split()[0] for c in _SEGMENT.split(", ")]
    costs = Costs()
    if not len(rows):
        return pd.DataFrame(columns=names)
    rows = rows.sort_values("place")
    fault = rows["fault"].to_numpy().copy()
    fault[(fault != _BLANK) & ~rows["place"].isin(firsts["place"]).to_numpy()] = _COPY
    initial = rows["initial"].to_numpy()
    conv = rows["conv"].to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
    ends = np.append(starts[1:], len(rows))
    codes = (4 * fault + initial).astype(np.uint8).tobytes()
    turn, known = rows["turn"].to_numpy(), rows["known"].to_numpy()
    out = []
    for a, b in zip(starts, ends, strict=True):
        own, edge = codes[a:b], a == 0 or b == len(rows)
        numbers = turn[a:b][known[a:b]]
        matrix, audit, cost, entry = None, None, None, None
        if edge:
            # speculative ends: only one state is free of cost; rows to be deleted change no vector
            matrix = []
            for s in range(4):
                vector, total = costs.through(own, costs.level(_closed([0 if s == t else _FAR for t in range(4)]))[0])
                matrix += [min(x + total, _FAR) for x in vector]
        else:
            audit, cost, _ = costs.trace(own, costs.back(own, _END), 0, True)
            entry = 0
        kinds = np.bincount(fault[a:b], minlength=4)
        out.append((
            conv[a], key[0], edge, own, matrix, audit, cost, entry,
            kinds[_BLANK], kinds[_COPY], kinds[_CUT], int((~_is_legal(initial[a : b - 1], initial[a + 1 : b])).sum()),
            initial[a], initial[b - 1], numbers[0] if len(numbers) else None, numbers[-1] if len(numbers) else None,
            len(np.unique(numbers)),
        ))
    return pd.DataFrame(out, columns=names, dtype=object)


# --- fix-up passes ----------------------------------------------------------------------------------------------

Step = Callable[[list[int], list[int]], list[int]]


def _pass(step: Step, start: list[int], backward: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("number", ascending=not backward)
        given = rows["given"].iloc[0]
        at, seen = list(start if given is None else given), []
        for way in rows["way"]:
            seen.append(at)
            at = step(at, list(way))
        return pd.DataFrame({
            "conv": rows["conv"], "block": rows["block"], "chunk": rows["chunk"], "number": rows["number"],
            "came": seen, "left": [at] * len(rows),
        })

    return run


def _carry(ways: DataFrame, start: list[int], step: Step, backward: bool) -> DataFrame:
    """``(conv, chunk, came)``: what arrives at each chunk when every chunk's way is applied in turn.

    A task takes the chunks of one block; blocks start from ``start`` and run again while what their neighbour
    hands on is not what they started from.  One pass is enough for conversations of one block.
    """
    types = "conv string, block long, chunk long, number long, came array<long>, left array<long>"
    many = (ways.agg(F.max("block")).first()[0] or 0) > 0
    given = None
    while True:
        begun = ways.withColumn("given", F.lit(None).cast("array<long>")) if given is None else ways.join(given, ["conv", "block"], "left")
        done = begun.groupBy("conv", "block").applyInPandas(_pass(step, start, backward), types)
        if not many:
            return done.select("conv", "chunk", "came")
        done = materialize(done)
        to = F.col("block") - 1 if backward else F.col("block") + 1
        handed = materialize(done.groupBy("conv", to.alias("block")).agg(F.first("left").alias("given")))
        used = begun.groupBy("conv", "block").agg(F.coalesce(F.first("given"), F.array(*map(F.lit, start)).cast("array<long>")).alias("used"))
        if used.join(handed, ["conv", "block"]).where("given != used").isEmpty():
            return done.select("conv", "chunk", "came")
        given = handed


def _back_step(at: list[int], matrix: list[int]) -> list[int]:
    """The vector before a chunk, for the one behind it, less its minimum."""
    out = [min(matrix[4 * e + s] + at[e] for e in range(4)) for s in range(4)]
    return [x - min(out) for x in out]


def _forward_step(at: list[int], exits: list[int]) -> list[int]:
    return [exits[at[0]]]


def _traced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    costs = Costs()
    for frame in frames:
        out = []
        for row in frame.itertuples():
            vectors = costs.back(row.codes, costs.level(tuple(int(x) for x in row.came))[0])
            found = [costs.trace(row.codes, vectors, s, row.last) for s in range(4)]
            out.append((row.conv, row.chunk, row.number, row.block, [f[2] for f in found], [f[1] for f in found], [f[0] for f in found]))
        yield pd.DataFrame(out, columns=["conv", "chunk", "number", "block", "way", "costs", "audits"])


@dataclass(frozen=True)
class Repair:
    """Rows in order, and the parts of conversations within chunks with their edits."""

    rows: DataFrame
    segments: DataFrame
    bits: int
    conv_type: str

    def conv_id(self) -> Column:
        return F.when(F.col("conv") != "", F.substr("conv", F.lit(2))).cast(self.conv_type).alias("conv_id")

    def summary(self) -> DataFrame:
        """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of each conversation with rows."""
        line = Window.partitionBy("conv").orderBy("chunk")
        # a border between two parts of a conversation: is the pair legal, does a turn go on
        pair = F.concat(F.lag("tail").over(line).cast("string"), F.col("head").cast("string"))
        before = F.max("last_turn").over(line.rowsBetween(Window.unboundedPreceding, -1))
        met = self.segments.withColumn("wrong", F.when(F.lag("tail").over(line).isNotNull() & ~pair.isin("01", "12", "21"), 1).otherwise(0))
        met = met.withColumn("again", F.when(F.col("first_turn") == before, 1).otherwise(0))
        total = {c: F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "cost")}
        gaps = F.max("last_turn") - F.min("first_turn") + 1 - F.sum(F.col("turns") - F.col("again"))
        parts = F.array_sort(F.collect_list(F.struct("chunk", "audit")))
        return met.groupBy("conv").agg(
            F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), total["blank"], total["duplicate"], total["truncated"],
            F.sum(F.col("illegal") + F.col("wrong")).cast("long").alias("illegal"), total["cost"],
            F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"),
        ).select(self.conv_id(), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def repaired(self, whole: bool = False) -> DataFrame:
        """``(conv_id, chunk, step, edit, turn, role, text)``: the rows that remain, in order of chunk and step.

        Inserted rows have no turn and an empty text.  The edits of a part travel to its rows as one more row, so both
        are merged as they stream by.  ``whole`` deals whole conversations to tasks, each in order, for consumers that
        must read one from end to end; without it a long conversation is spread.
        """
        return self._stream(whole).select(self.conv_id(), "chunk", "step", "edit", F.col("turn").cast("long").alias("turn"), "role", "text")

    def _stream(self, whole: bool) -> DataFrame:
        none = F.lit(None).cast("string")
        texts = self.rows.select(
            "conv", F.shiftright("place", self.bits).alias("chunk"), "place", F.col("turn").cast("string").alias("turn"), "role",
            "text", none.alias("audit"), F.lit(-1).alias("entry"),
        )
        edits = self.segments.select(
            "conv", "chunk", F.lit(-1).cast("long").alias("place"), none.alias("turn"), none.alias("role"), none.alias("text"),
            "audit", "entry",
        )
        both = texts.unionByName(edits)
        dealt = both.repartition("conv") if whole else both.repartition("chunk", "conv")
        return dealt.sortWithinPartitions("conv", "chunk", "place").mapInPandas(
            _merged, "conv string, chunk long, step long, edit string, turn string, role string, text string"
        )

    def hashes(self) -> DataFrame:
        """``(conv_id, repaired_sha256)`` of the ``role:text`` lines of each conversation that has rows left.

        A sha256 has to read its text in order, so this is the one step that takes a conversation in one task; it
        streams, and holds one batch of rows at a time.
        """
        return self._stream(whole=True).mapInPandas(_hashed, "conv string, repaired_sha256 string").select(self.conv_id(), "repaired_sha256")


def _merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["conv", "chunk", "step", "edit", "turn", "role", "text"]
    conv, chunk, audit, at, state, out = None, 0, "", 0, 0, []

    def inserted() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = _TURN[state]
            out.append((conv, chunk, at, "I", None, "user" if state == 2 else "assistant", ""))
            at += 1

    for frame in frames:
        for row in frame.itertuples():
            if row.place == -1:
                inserted()
                conv, chunk, audit, at, state = row.conv, row.chunk, row.audit, 0, int(row.entry)
                continue
            inserted()
            edit, role = audit[at], row.role
            if edit == "R":
                state = _TURN[state]
                role = "user" if state == 2 else "assistant"
            elif edit == "K":
                state = _KEPT[state, "sua".index(role[0])]
            if edit != "D":
                out.append((conv, chunk, at, edit, row.turn, role, row.text))
            at += 1
        yield pd.DataFrame(out, columns=names, dtype=object)
        out = []
    inserted()
    yield pd.DataFrame(out, columns=names, dtype=object)


def repair_conversations(rows: DataFrame, settings: RepairSettings = RepairSettings()) -> Repair:
    """The cheapest edits of every conversation in ``(conv_id, turn, role, text)``, other columns left out.

    Rows are taken by turn, null turns first, rows of one turn by role and text.  A row's first fault counts: ``blank``
    (nothing but white space), ``duplicate`` (role and text seen earlier), ``truncated`` (does not end with ``.``,
    ``!`` or ``?``).  Keeping costs 0, another role 1, deleting 2, an empty row for user or assistant 5, a truncated row
    that stays 5 more; blank and duplicate rows have to go.  Among the cheapest the audit (K, R, D, I in order) is the
    least in ASCII order.  A null role or text counts as one space, a null conversation is one too; equal rows are
    duplicates of the first; an empty table gives no rows.
    """
    line = ordered_rows(rows)
    chunk = F.shiftright("place", settings.chunk_bits).alias("chunk")
    firsts = line.where(F.col("fault") != _BLANK).groupBy("conv", "said").agg(F.min("place").alias("place")).select(chunk, "place")
    narrow = line.select(
        chunk, "place", "conv", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("known"), "initial", "fault"
    )
    found = materialize(narrow.groupBy("chunk").cogroup(firsts.groupBy("chunk")).applyInPandas(_segments, _SEGMENT))

    order = Window.partitionBy("conv").orderBy("chunk")
    edges = found.where("edge").select("conv", "chunk", "codes", "matrix", (F.row_number().over(order).cast("long") - 1).alias("number"), F.lead("chunk").over(order).isNull().alias("last"))
    edges = materialize(edges.withColumn("block", F.floor(F.col("number") / settings.block)))
    ways = edges.select("conv", "block", "chunk", "number", F.col("matrix").alias("way"))
    came = _carry(ways, list(_END), _back_step, True)
    traced = materialize(edges.drop("matrix").join(came, ["conv", "chunk"]).mapInPandas(
        _traced, "conv string, chunk long, number long, block long, way array<long>, costs array<long>, audits array<string>"
    ))
    entered = _carry(traced.select("conv", "block", "chunk", "number", "way"), [0], _forward_step, False)
    at = F.col("came")[0].cast("int")
    chosen = traced.join(entered, ["conv", "chunk"]).select(
        "conv", "chunk", at.alias("_entry"), F.col("audits")[at].alias("_audit"), F.col("costs")[at].alias("_cost")
    )
    own = [c.split()[0] for c in _SEGMENT.split(", ")]
    kept = [c for c in own if c not in ("edge", "codes", "matrix")]
    segments = found.join(chosen, ["conv", "chunk"], "left").select(
        *(F.coalesce(c, f"_{c}").alias(c) if c in ("audit", "cost", "entry") else F.col(c) for c in kept)
    )
    return Repair(line, materialize(segments), settings.chunk_bits, dict(rows.dtypes)["conv_id"])


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, state = None, hashlib.sha256()
    for frame in frames:
        out = []
        for row in frame.itertuples():
            line = f"{row.role}:{row.text}"
            if row.conv == conv:
                state.update(f"\n{line}".encode())
                continue
            if conv is not None:
                out.append((conv, state.hexdigest()))
            conv, state = row.conv, hashlib.sha256(line.encode())
        yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
    if conv is not None:
        yield pd.DataFrame({"conv": [conv], "repaired_sha256": [state.hexdigest()]})
