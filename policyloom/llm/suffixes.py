"""Suffix-array dedup: repeated byte strings, from the common-prefix interval tree of an enhanced suffix array.

The suffixes of a corpus are too many to sort, so a sample stands for them: of each ``length`` bytes the k-gram with
the smallest hash is the anchor.  Equal strings have their anchor at the same place, so strings that repeat meet at
anchors with equal k-grams, and an anchor's context holds every string that it stands for.

Contexts that are equal as a whole need no comparison.  The others go, with all that share their k-gram, to a task
which sorts the suffixes at the anchors and scans the common-prefix lengths with a stack.  Each interval of suffixes
that share a prefix is split by what stands before the anchors: members that also share a left context form a maximal
repeat with all its occurrences.  A k-gram with very many different contexts is not sorted in one task: its strings
are counted one by one in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyloom.llm.arrays import Bytes, byte_values, covered, expand, id_back, mix, rolling, span_hash, split_frames, texts_of
from policyloom.session import materialize

_LOW = np.uint64(2**32 - 1)
#: Characters whose anchors are found at once: a byte costs some 60 bytes of arrays, or a hundred while they change.
_ANCHOR_CHARS = 256 << 10


@dataclass(frozen=True)
class SuffixSettings:
    """Strings of ``length`` bytes; ``kgram`` bytes choose anchors, the others size the tasks."""

    length: int = 200
    kgram: int = 32
    bucket_rows: int = 20_000
    group_rows: int = 8192


def lcp_intervals(lcp: list[int], floor: int = 0) -> Iterator[tuple[int, int, int]]:
    """The intervals ``(first, last, length)`` of sorted suffixes that share more than ``floor``, inner ones first.

    ``lcp[i]`` is what suffix i shares with suffix i - 1; ``lcp[0]`` is not looked at.
    """
    stack = [(floor, 0)]
    for i in range(1, len(lcp) + 1):
        shared, first = (lcp[i] if i < len(lcp) else floor), i - 1
        while stack[-1][0] > shared:
            length, first = stack.pop()
            yield first, i - 1, length
        if stack[-1][0] < shared:
            stack.append((shared, first))


def _padded(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal width: bytes plus one, and zeros after the end (UTF-8 has no byte 255)."""
    sizes = np.array([len(p) for p in parts], np.int64)
    rows = np.zeros((len(parts), max(1, int(sizes.max(initial=0)))), np.uint8)
    flat = np.frombuffer(b"".join(parts), np.uint8)
    rows[np.repeat(np.arange(len(parts)), sizes), expand(np.zeros(len(parts), np.int64), sizes)] = flat + 1
    return rows, sizes


def _shared(rows: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How long the common prefix of each pair of rows is."""
    out = np.zeros(len(a), np.int64)
    for i in range(0, len(a), 8192):
        x, y = a[i : i + 8192], b[i : i + 8192]
        differ = rows[x] != rows[y]
        out[i : i + 8192] = np.where(differ.any(axis=1), differ.argmax(axis=1), np.minimum(sizes[x], sizes[y]))
    return out


def _order(rows: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")


class EnhancedSuffixes:
    """The suffixes at the anchors of groups: sorted by group and right context, with common-prefix lengths."""

    def __init__(self, groups: np.ndarray, contexts: list[bytes], lefts: np.ndarray) -> None:
        self.right, self.right_size = _padded([c[k:] for c, k in zip(contexts, lefts, strict=True)])
        self.left, self.left_size = _padded([c[:k][::-1] for c, k in zip(contexts, lefts, strict=True)])
        order = _order(self.right)
        self.order = order[np.argsort(groups[order], kind="stable")]
        self.left_rank = np.empty(len(groups), np.int64)
        self.left_rank[_order(self.left)] = np.arange(len(groups))
        ordered = groups[self.order]
        self.lcp = np.zeros(len(groups), np.int64)
        same = np.flatnonzero(ordered[1:] == ordered[:-1]) + 1
        self.lcp[same] = _shared(self.right, self.right_size, self.order[same - 1], self.order[same])

    def repeats(self, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For each interval, its members in the order of their left contexts, what neighbours share there, and the prefix.

        Only intervals in which some neighbours reach ``least`` bytes on both sides together.
        """
        pairs = []
        for first, last, prefix in lcp_intervals(self.lcp.tolist()):
            if last == first + 1:
                pairs.append((first, last, prefix))
                continue
            members = self.order[first : last + 1]
            members = members[np.argsort(self.left_rank[members])]
            left = _shared(self.left, self.left_size, members[:-1], members[1:])
            if left.max() + prefix >= least:
                yield members, left, prefix
        if pairs:
            first, last, prefix = np.array(pairs).T
            a, b = self.order[first], self.order[last]
            left = _shared(self.left, self.left_size, a, b)
            for k in np.flatnonzero(left + prefix >= least):
                yield np.array([a[k], b[k]]), left[k : k + 1], int(prefix[k])

    def maximal_repeats(self, least: int) -> Iterator[tuple[np.ndarray, int, int]]:
        """Groups ``(members, left, prefix)``: all occurrences of a string that no side extends for all of them.

        A group is kept if its members do not all go on alike to the right (else a longer prefix has them) and the
        left contexts, by the scan, part right before it.
        """
        for members, left, prefix in self.repeats(least):
            for first, last, shared in lcp_intervals([0, *left.tolist()], max(0, least - prefix - 1)):
                group = members[first : last + 1]
                ends = self.right_size[group] <= prefix
                after = self.right[group, np.minimum(prefix, self.right.shape[1] - 1)]
                if ends.any() or len(np.unique(after)) > 1:
                    yield group, shared, prefix

    def spans(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(member, bytes before its anchor, bytes from it) of every string of ``least`` bytes that recurs."""
        who, before, after = [], [], []
        for members, left, prefix in self.repeats(least):
            longest = np.zeros(len(members), np.int64)
            longest[1:] = left
            longest[:-1] = np.maximum(longest[:-1], left)
            far = longest + prefix >= least
            who.append(members[far])
            before.append(longest[far])
            after.append(np.full(far.sum(), prefix, np.int64))
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return join(who), join(before), join(after)


def _row_key(texts: DataFrame) -> Column:
    """The id, or where rows share an id a hash of id and text: equal rows then also share their result."""
    twice = texts.groupBy("doc_id").count().where("count > 1")
    return F.col("doc_id") if twice.isEmpty() else F.xxhash64("doc_id", "text")


def anchors(texts: list[str], settings: SuffixSettings) -> tuple[pd.DataFrame, Bytes]:
    """Anchors of each text: ``row``, ``start`` of the context, ``before`` the anchor, ``strings`` that it stands for."""
    length, k = settings.length, settings.kgram
    source = Bytes.of(texts)
    prefix = rolling(byte_values(source.buffer))
    width = length - k + 1
    n = len(source.buffer)
    empty = pd.DataFrame({"row": [], "start": [], "before": [], "strings": [], "kgram": [], "context": []}, dtype=np.int64)
    if n < length:
        return empty, source
    at = np.arange(n - k + 1)
    grams = span_hash(prefix, at, at + k)
    value = (grams & ~_LOW) | at.astype(np.uint64)
    # least value of each ``width`` places: runs from the left and from the right of blocks of that width
    size = -(-len(value) // width) * width
    blocks = np.full(size, np.uint64(2**64 - 1))
    blocks[: len(value)] = value
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - length + 1)
    anchor = (np.minimum(back[starts], ahead[starts + width - 1]) & _LOW).astype(np.int64)
    row = np.searchsorted(source.first, starts, "right") - 1
    whole = starts + length < source.first[row + 1]
    starts, anchor, row = starts[whole], anchor[whole], row[whole]
    if not len(starts):
        return empty, source
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    low, high, place = starts[first], starts[last], anchor[first]
    context = mix(span_hash(prefix, low, high + length) ^ (place - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return pd.DataFrame({
        "row": row[first], "start": low - source.first[row[first]], "before": place - low, "strings": high - low + 1,
        "kgram": grams[place].view(np.int64), "context": context.view(np.int64),
    }), source


def _anchor_rows(settings: SuffixSettings):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (part for whole in frames for part in split_frames(whole, size=_ANCHOR_CHARS)):
            found, _ = anchors(frame["text"].tolist(), settings)
            found["key"] = frame["key"].to_numpy()[found["row"].to_numpy(np.int64)]
            yield found[["kgram", "context", "key", "start", "before", "strings"]]

    return run


def _cut_contexts(length: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, text, wanted in zip(frame["key"], frame["text"], frame["wanted"], strict=True):
                raw = text.encode()
                out += [(w["kgram"], key, w["start"], w["before"], raw[w["start"] : w["start"] + w["strings"] + length - 1]) for w in wanted]
            yield pd.DataFrame(out, columns=["kgram", "key", "start", "before", "bytes"])

    return run


def _merged(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """Overlapping spans of a key as one."""
    frame = pd.DataFrame({"key": key, "start": start, "end": end}).sort_values(["key", "start"])
    reach = frame.groupby("key")["end"].cummax()
    new = (frame["key"] != frame["key"].shift()) | (frame["start"] > reach.shift())
    out = frame.groupby(new.cumsum()).agg(key=("key", "first"), start=("start", "first"), end=("end", "max"))
    return out.astype(np.int64)


def _bucket_spans(length: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        suffixes = EnhancedSuffixes(frame["kgram"].to_numpy(), frame["bytes"].tolist(), frame["before"].to_numpy())
        who, before, after = suffixes.spans(length)
        at = (frame["start"] + frame["before"]).to_numpy()[who]
        return _merged(frame["key"].to_numpy()[who], at - before, at + after)

    return run


def _single_strings(length: int):
    """Every string of a context by itself, for k-grams with too many contexts for one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for i in range(0, len(whole), 2000):
                frame = whole.iloc[i : i + 2000]
                sizes = np.array([len(b) for b in frame["bytes"]])
                prefix = rolling(byte_values(np.frombuffer(b"".join(frame["bytes"]), np.uint8)))
                counts = sizes - length + 1
                at = expand(np.cumsum(sizes) - sizes, counts)
                offset = expand(np.zeros(len(frame), np.int64), counts)
                yield pd.DataFrame({
                    "string": span_hash(prefix, at, at + length).view(np.int64),
                    "key": np.repeat(frame["key"].to_numpy(), counts),
                    "start": np.repeat(frame["start"].to_numpy(), counts) + offset,
                })

    return run


def repeated_spans(texts: DataFrame, dealt: DataFrame, settings: SuffixSettings = SuffixSettings()) -> DataFrame:
    """``(key, start, end)``: byte spans of ``texts (key, text)`` that strings found elsewhere cover; spans may overlap.

    ``dealt`` holds the same rows partitioned by key.  All its columns go where contexts are cut, so that the plan
    there and the caller's share one exchange.
    """
    length = settings.length
    found = texts.select("key", "text").mapInPandas(
        _anchor_rows(settings), "kgram long, context long, key long, start int, before int, strings int"
    )
    # one row for each k-gram and task, so a hot one is small; most k-grams are seen once and end here
    several = materialize(found.groupBy("kgram").agg(
        F.count("*").alias("n"), F.min("context").alias("c0"), F.max("context").alias("c1")
    ).where("n > 1").select("kgram", (F.col("c0") != F.col("c1")).alias("mixed")))
    shared = materialize(found.join(several, "kgram"))
    span = ("key", "start", (F.col("start") + F.col("strings") + (length - 1)).alias("end"))
    mixed = shared.where("mixed")
    kinds = mixed.groupBy("kgram", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("key", "start", "before", "strings")).alias("one")
    )
    kinds = materialize(kinds)
    sizes = materialize(kinds.groupBy("kgram").agg(F.count("*").alias("size")))
    kinds = materialize(kinds.join(sizes, "kgram").withColumn("hot", F.col("size") > settings.group_rows))
    again = mixed.join(kinds.where("n > 1").select("kgram", "context"), ["kgram", "context"], "left_semi")

    def contexts(hot: bool) -> DataFrame:
        wanted = kinds.where(F.col("hot") == hot).select("kgram", "one.*").groupBy("key").agg(
            F.collect_list(F.struct("kgram", "start", "before", "strings")).alias("wanted")
        )
        return dealt.join(wanted, "key").mapInPandas(
            _cut_contexts(length), "kgram long, key long, start int, before int, bytes binary"
        )

    whole = shared.where("not mixed").select(*span).unionByName(again.select(*span))
    buckets = max(1, kinds.where("not hot").count() // settings.bucket_rows)
    spans = contexts(False).groupBy(F.pmod(F.xxhash64("kgram"), F.lit(buckets))).applyInPandas(
        _bucket_spans(length), "key long, start long, end long"
    ).unionByName(whole)
    if not kinds.where("hot").isEmpty():
        strings = contexts(True).mapInPandas(_single_strings(length), "string long, key long, start int")
        twice = strings.groupBy("string").count().where("count > 1").select("string")
        spans = spans.unionByName(
            strings.join(twice, "string").select("key", "start", (F.col("start") + length).alias("end"))
        )
    return spans


def _without(whole_characters: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes, removed, runs, kept = [], [], [], []
            for text, codes in zip(frame["text"], frame["codes"], strict=True):
                raw = text.encode()
                data = np.frombuffer(raw, np.uint8)
                gone = np.zeros(len(data) + 1, np.int64)
                if codes is not None:
                    codes = np.asarray(codes)
                    np.add.at(gone, codes >> 32, 1)
                    np.add.at(gone, codes & 0xFFFFFFFF, -1)
                gone = np.cumsum(gone)[:-1] > 0
                sizes.append(len(data))
                removed.append(gone.sum())
                runs.append(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=np.int8(0)) == 1))
                if whole_characters and removed[-1]:
                    # a character goes only with all its bytes
                    first = np.flatnonzero((data & 0xC0) != 0x80)
                    gone = np.repeat(np.logical_and.reduceat(gone, first), np.diff(np.append(first, len(data))))
                kept.append(raw if not removed[-1] else data[~gone].tobytes())
            out = frame.drop(columns=["text", "codes"])
            yield out.assign(n_bytes=sizes, n_removed=removed, n_spans=runs, kept=kept)

    return run


def dedup_suffixes(
    docs: DataFrame, settings: SuffixSettings = SuffixSettings(), whole_characters: bool = False, carry: str | None = None
) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``: each row's bytes without those that a repeated string covers.

    A byte goes if some ``settings.length`` bytes around it also start at another place of any row, its own included.
    ``kept`` is what remains, as bytes; with ``whole_characters`` a character stays unless all its bytes go, so that
    ``kept`` is text.  Empty, null and shorter texts keep all they have.  Each row is a document; rows of one id and
    one text have one result.  Null ids come back as null.  ``carry`` names a column of ``docs`` to return as well.
    """
    more = [F.col(carry).alias(carry)] if carry else []
    texts = texts_of(docs, *more)
    # one exchange by key serves the cutting of contexts and the removal
    cores = texts.sparkSession.sparkContext.defaultParallelism
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), cores)
    texts = texts.withColumn("key", _row_key(texts))
    dealt = texts.repartition(parts, "key")
    spans = repeated_spans(texts, dealt, settings)
    code = F.col("start").cast("long") * F.lit(2**32) + F.col("end").cast("long")
    codes = spans.groupBy("key").agg(F.collect_set(code).alias("codes"))
    joined = dealt.join(codes, "key", "left").select("doc_id", "text", "codes", *([carry] if carry else []))
    kind = dict(docs.dtypes)
    schema = "doc_id long, " + (f"`{carry}` {kind[carry]}, " if carry else "") + "n_bytes long, n_removed long, n_spans long, kept binary"
    return joined.mapInPandas(_without(whole_characters), schema).withColumn("doc_id", id_back("doc_id"))


def without_repeats(docs: DataFrame, settings: SuffixSettings = SuffixSettings()) -> DataFrame:
    """The documents with what remains of their texts, with the columns of ``docs``; ``n_chars`` is made to match.

    A null text stays null.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "doc_id")]
    # the input's columns in a struct of their own, so that any name may occur among them
    own = F.struct(F.col("text").isNull().alias("null"), F.col("doc_id").alias("id"))
    row = F.struct(own.alias("own"), F.struct(*others).alias("more")) if others else F.struct(own.alias("own"))
    out = dedup_suffixes(docs.select("doc_id", "text", row.alias("_row")), settings, whole_characters=True, carry="_row")
    text = F.when(~F.col("_row.own.null"), F.decode("kept", "UTF-8"))
    columns = []
    for field in docs.schema:
        if field.name == "text":
            value = text
        else:
            value = F.col("_row.own.id") if field.name == "doc_id" else F.col("_row.more").getField(field.name)
        if field.name == "n_chars":
            value = F.when(F.col("n_removed") > 0, F.length(text).cast(field.dataType)).otherwise(value)
        columns.append(value.alias(field.name))
    return out.select(*columns)
