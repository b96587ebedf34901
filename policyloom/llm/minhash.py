"""Near-duplicates: fast similarity sketches, banding, and an exact check of full shingle sets.

The sketch (Dahlgaard, Knudsen and Thorup, 2017) puts every shingle into one bin in each round and keeps the first
value that a bin gets, until no bin is empty; a coordinate of two sketches agrees with the probability of their
Jaccard similarity.  Documents that agree on all coordinates of a band are candidates.

Candidates are joined to groups, and within a group links are confirmed on the full sets.  Groups above a size are
dealt into blocks: in a few rounds the blocks join what belongs together, and then only the members outside the
group's largest component are compared with all of it.  No pair of a group is ever emitted: a task returns at most one
edge for each member and component it finds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policyloom.llm.arrays import Words, expand, id_back, mix, split_frames, texts_of, windows
from policyloom.llm.graph import components
from policyloom.session import materialize

_EMPTY = np.uint64(2**64 - 1)


@dataclass(frozen=True)
class NearSettings:
    """Shingles of ``words`` words; linked at ``percent`` per cent of the union or more.

    A pair at the limit is missed by all bands with a probability of at most ``miss``.
    """

    words: int = 5
    percent: int = 80
    miss: float = 1e-6
    coordinates: int = 288
    block: int = 512
    rounds: int = 2

    @property
    def bands(self) -> tuple[int, int]:
        """(rows, bands): the longest bands that keep the promise within the coordinates."""
        best = (1, self.coordinates)
        for rows in range(1, 17):
            need = math.ceil(math.log(self.miss) / math.log1p(-((self.percent / 100) ** rows)))
            if rows * need <= self.coordinates:
                best = (rows, need)
        return best


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts, and where each text's begin: A-Z is folded.

    A text of fewer words has its whole sequence as one; a text without words has none.
    """
    words = Words.of(texts)
    hashes, text, counts = words.hashes(fold=True), words.text, words.counts
    at = np.flatnonzero(text[width - 1 :] == text[: len(text) - width + 1]) if len(text) >= width else np.zeros(0, int)
    values, owner = windows(hashes, width)[at], text[at]
    short = np.flatnonzero((counts > 0) & (counts < width))
    for size in np.unique(counts[short]):
        some = short[counts[short] == size]
        values = np.concatenate((values, mix(windows(hashes, size)[words.first[some]] ^ np.uint64(size))))
        owner = np.concatenate((owner, some))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(texts) + 1))


def sketches(values: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """A row of t coordinates for each set; the rows of empty sets are not filled."""
    n = len(first) - 1
    bins = np.full(n * t, _EMPTY, np.uint64)
    sizes = np.diff(first)
    open_sets = np.flatnonzero(sizes > 0)
    low = np.uint64((1 << 48) - 1)
    for turn in range(2 * t):
        if not len(open_sets):
            break
        some = expand(first[open_sets], sizes[open_sets])
        owner = np.repeat(open_sets, sizes[open_sets])
        h = mix(values[some] + np.uint64(0x9E3779B97F4A7C15 * (turn + 1) % 2**64))
        # the first t rounds hash to a bin, the later ones fill one bin each
        bin_of = (h >> np.uint64(48)).astype(np.int64) * t >> 16 if turn < t else np.full(len(h), turn - t)
        np.minimum.at(bins, owner * t + bin_of, (np.uint64(turn) << np.uint64(48)) | (h & low))
        open_sets = open_sets[(bins.reshape(n, t)[open_sets] == _EMPTY).any(axis=1)]
    return bins.reshape(n, t)


def _sketch_rows(settings: NearSettings):
    rows, bands = settings.bands

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (part for whole in frames for part in split_frames(whole)):
            values, first = shingle_sets(frame["text"].tolist(), settings.words)
            table = sketches(values, first, rows * bands).reshape(len(frame), bands, rows)
            keys = np.zeros((len(frame), bands), np.uint64)
            for r in range(rows):
                keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + table[:, :, r])
            keys = mix(keys + np.arange(bands, dtype=np.uint64))
            # the set's identity: sums of two mixes of its hashes
            sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(s))))) for s in (11, 77)]
            sums = [(s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "n_shingles": np.diff(first), "set_a": sums[0], "set_b": sums[1],
                "bands": list(keys.view(np.int64)),
            })

    return run


def _set_rows(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (part for whole in frames for part in split_frames(whole)):
            values, first = shingle_sets(frame["text"].tolist(), width)
            sets = [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "family": frame["family"], "n": frame["n"], "shingles": sets})

    return run


def links_between(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set on the left, the sets on the right that it is linked with, by counting common hashes exactly."""
    sizes = np.array([len(s) for s in right], np.int64)
    hashes = np.concatenate(right) if right else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    for k, own in enumerate(left):
        low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
        common = np.bincount(owner[expand(low, high - low)], minlength=len(right))
        yield k, np.flatnonzero(100 * common >= percent * (len(own) + sizes - common))


class Forest:
    """Union-find over the members of one task."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _edges(ids: np.ndarray, pairs: list[tuple[int, int]]) -> pd.DataFrame:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pd.DataFrame({"a": ids[list(a)].astype(np.int64), "b": ids[list(b)].astype(np.int64)})


def _sets(frame: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in frame["shingles"]]


def _link_bucket(percent: int):
    """Links inside each family of a bucket of families (or blocks of them): a spanning forest of each."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["family", "doc_id"]).reset_index(drop=True)
        ids, sets, found = frame["doc_id"].to_numpy(), _sets(frame), []
        for members in frame.groupby("family", sort=False).indices.values():
            own, forest = [sets[m] for m in members], Forest(len(members))
            for k, partners in links_between(own, own, percent):
                found += [(members[k], members[p]) for p in partners if p < k and forest.join(k, int(p))]
        return _edges(ids, found)

    return run


def _link_outsiders(percent: int):
    """Links of a block of outsiders with a block of their family: one edge for each outsider and component."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, sets, labels, outside = frame["doc_id"].to_numpy(), _sets(frame), frame["label"].to_numpy(), frame["outside"]
        left, right = np.flatnonzero(outside), np.flatnonzero(~outside)
        found = []
        for k, partners in links_between([sets[i] for i in left], [sets[i] for i in right], percent):
            partners = right[partners]
            partners = partners[labels[partners] != labels[left[k]]]
            found += [(left[k], p) for p in partners[np.unique(labels[partners], return_index=True)[1]]]
        return _edges(ids, found)

    return run


def _candidate_edges(members: DataFrame) -> DataFrame:
    """Edges that join what shares a bucket of some band: from each member to the smallest id of its buckets.

    A member's other buckets are joined by edges between their smallest ids, of which all members of a group have the
    same few, so a group has about one edge for each member and not one for each member and band.
    """
    spread = members.select("doc_id", F.explode("bands").alias("key"))
    least = spread.groupBy("key").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = spread.join(least, "key").select("a", F.col("doc_id").alias("b")).distinct()
    # a member has at most as many rows here as there are bands
    met = materialize(met.withColumn("head", F.min("a").over(Window.partitionBy("b"))))
    edges = met.select(F.col("head").alias("a"), "b").unionByName(met.select(F.col("head").alias("a"), F.col("a").alias("b")))
    return edges.where("a != b").distinct()


def near_duplicates(docs: DataFrame, settings: NearSettings = NearSettings()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs``.

    ``component_id`` is the smallest id that links lead to, ``kept`` marks that document.  Null or wordless texts have
    no shingles and stand alone.  Rows of one id are one document as far as links go, and share its component; null
    ids count as one id below all others and come back as null.
    """
    texts = texts_of(docs)
    base = materialize(texts.mapInPandas(
        _sketch_rows(settings), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
    ))
    kind = ("n_shingles", "set_a", "set_b")
    # equal sets are one class; its smallest id stands for it
    classes = materialize(
        base.where("n_shingles > 0").groupBy(*kind).agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    )
    near = materialize(components(materialize(_candidate_edges(classes))))
    edges = _confirmed(texts, near.select(F.col("id").alias("doc_id"), F.col("label").alias("family")), settings)
    # rows of one id with different sets: that id joins their classes
    mixed = base.groupBy("doc_id").agg(F.min("set_a").alias("x"), F.max("set_a").alias("y")).where("x != y").select("doc_id")
    shared = base.join(mixed, "doc_id", "left_semi").join(classes.withColumnRenamed("doc_id", "a"), [*kind]).select(
        "a", F.col("doc_id").alias("b")
    )
    linked = components(materialize(edges.unionByName(shared)))
    first = classes.select(*kind, F.col("doc_id").alias("head")).join(
        linked.withColumnRenamed("id", "head"), "head", "left"
    ).select(*kind, F.coalesce("label", "head").alias("of_set"))
    out = base.drop("bands").join(first, [*kind], "left").withColumn("component_id", F.coalesce("of_set", "doc_id"))
    return out.select(
        id_back("doc_id").alias("doc_id"), "n_shingles", id_back("component_id").alias("component_id"),
        (F.col("doc_id") == F.col("component_id")).alias("kept"),
    )


def _confirmed(texts: DataFrame, families: DataFrame, settings: NearSettings) -> DataFrame:
    """Edges between members of a family that are linked, enough to join all that links join."""
    sizes = families.groupBy("family").agg(F.count("*").alias("n"))
    numbered = materialize(families.join(sizes, "family"))
    sets = materialize(texts.join(numbered, "doc_id").select("doc_id", "text", "family", "n").mapInPandas(
        _set_rows(settings.words), "doc_id long, family long, n long, shingles binary"
    ))
    edge, block = "a long, b long", settings.block
    small = sets.where(F.col("n") <= block)
    total = small.count()
    bucket = F.pmod(F.xxhash64("family"), F.lit(max(1, total // block + 1)))
    edges = materialize(
        small.withColumn("bucket", bucket).groupBy("bucket")
        .applyInPandas(_link_bucket(settings.percent), edge)
    )
    large = sets.where(F.col("n") > block)
    if large.isEmpty():
        return edges
    blocks = F.ceil(F.col("n") / block)
    for turn in range(settings.rounds):
        within = F.pmod(F.xxhash64("doc_id", F.lit(turn)), blocks)
        edges = edges.unionByName(materialize(
            large.withColumn("within", within).groupBy("family", "within").applyInPandas(_link_bucket(settings.percent), edge)
        ))
    labels = materialize(components(edges)).withColumnRenamed("id", "doc_id")
    # numbers of members are joined by family without their sets, which then follow by id
    members = numbered.where(F.col("n") > block).join(labels, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    parts = members.groupBy("family", "label").agg(F.count("*").alias("part"))
    largest = parts.groupBy("family").agg(
        F.max(F.struct("part", "label")).alias("m"), F.sum("part").alias("n")
    ).select("family", F.col("m.label").alias("main"), F.ceil((F.col("n") - F.col("m.part")) / block).alias("stray_blocks"))
    members = materialize(members.join(largest, "family").where("stray_blocks > 0"))
    members = large.select("doc_id", "shingles").join(members, "doc_id").select(
        "doc_id", "family", "shingles", "label", (F.col("label") != F.col("main")).alias("outside"), blocks.alias("blocks"), "stray_blocks"
    )
    at = F.xxhash64("doc_id", F.lit("last"))
    left = members.where("outside").select(
        "doc_id", "family", "shingles", "label", "outside", F.pmod(at, F.col("stray_blocks")).alias("stray_block"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
    )
    right = members.select(
        "doc_id", "family", "shingles", "label", F.lit(False).alias("outside"),
        F.explode(F.sequence(F.lit(0), F.col("stray_blocks") - 1)).alias("stray_block"),
        F.pmod(at, F.col("blocks")).alias("block"),
    )
    more = left.unionByName(right).groupBy("family", "stray_block", "block").applyInPandas(_link_outsiders(settings.percent), edge)
    return edges.unionByName(materialize(more))


def drop_near_duplicates(docs: DataFrame, settings: NearSettings = NearSettings(), row: Column | None = None) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id, and of those the one with the smallest number.

    Rows are linked by their texts alone, so copies under one id or without an id go like any others, and different
    texts under one id stay.  Rows without shingles stand alone and stay.  ``row`` numbers the rows, with longs that
    stay the same whenever ``docs`` is read; without it the rows are written with numbers, in the order in which they
    are read.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    if row is None:
        rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), whole))
    else:
        rows = docs.select(row.alias("row"), whole)
    numbered = rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text"))
    found = near_duplicates(numbered, settings).select(F.col("doc_id").alias("row"), "component_id")
    ids = rows.select("row", F.col("doc.doc_id").alias("id"))
    # rows of large components are combined before the shuffle
    kept = found.join(ids, "row").groupBy("component_id").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("m")
    ).select(F.col("m.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select("doc.*")
