"""Approximate nearest neighbours: Gaussian projections in a kd-tree, checked until a chi-square test says stop.

A Gaussian projection to m dimensions is stable: the squared projected length of a vector, divided by its squared
length, follows the chi-square distribution with m degrees of freedom.  A tree over the projections gives candidates in
the order of their projected distance, and each is verified on its full vector.  Once the next projected distance r
and the k-th true distance d so far make ``chi2.cdf(r**2 / d**2)`` as large as the confidence, a nearer vector would
have been projected nearer with at least that probability, and the search ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policyloom.llm.arrays import expand
from policyloom.session import materialize


@dataclass(frozen=True)
class AnnSettings:
    """``shard_rows`` and ``query_rows`` bound what one task holds."""

    neighbours: int = 5
    dimensions: int = 8
    confidence: float = 0.999
    leaf: int = 128
    shard_rows: int = 16_384
    query_rows: int = 4096
    seed: int = 5


def chi_square_cdf(x: float, m: int) -> float:
    """For an even number of degrees of freedom: one minus a Poisson tail."""
    if math.isinf(x):
        return 1.0
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, m // 2):
        term *= half / i
        total += term
    return 1.0 - math.exp(-half) * total


def chi_square_limit(confidence: float, m: int) -> float:
    """The value that the distribution function reaches at the confidence."""
    low, high = 0.0, 1.0
    while chi_square_cdf(high, m) < confidence:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, m) < confidence else (low, middle)
    return high


class KdTree:
    """Median splits down to leaves; boxes of the points bound the distance to each node."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.points = points
        self.rows: list[np.ndarray] = []
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            own = points[rows]
            low, high = own.min(axis=0), own.max(axis=0)
            axis = int(np.argmax(high - low))
            if len(rows) <= leaf or low[axis] == high[axis]:
                self.rows.append(rows)
                self.low.append(low)
                self.high.append(high)
                continue
            # by value, so that equal points stay together
            line = own[:, axis]
            middle = np.partition(line, len(rows) // 2)[len(rows) // 2]
            left = line < middle if middle > low[axis] else line <= middle
            todo += [rows[left], rows[~left]]
        self.lows, self.highs = np.array(self.low), np.array(self.high)

    def by_distance(self, point: np.ndarray, most: int = 1024, leaves: int = 16) -> Iterator[tuple[float, np.ndarray]]:
        """Points in the order of their squared distance, up to ``most`` at a time, each time with the least of theirs.

        Leaves are opened in the order of the least distance that they can have, ``leaves`` at a time; a point comes
        out once no leaf that is still closed can hold a nearer one.
        """
        gap = np.maximum(np.maximum(self.lows - point, point - self.highs), 0.0)
        bound = (gap * gap).sum(axis=1)
        order = np.argsort(bound, kind="stable")
        far, known = np.zeros(0), np.zeros(0, np.int64)
        for i in range(0, len(order), leaves):
            rows = np.concatenate([self.rows[k] for k in order[i : i + leaves]])
            apart = self.points[rows] - point
            far, known = np.concatenate((far, np.einsum("ij,ij->i", apart, apart))), np.concatenate((known, rows))
            ready = far <= bound[order[i + leaves]] if i + leaves < len(order) else np.ones(len(far), bool)
            distance, out = far[ready], known[ready]
            nearest = np.argsort(distance, kind="stable")
            for j in range(0, len(nearest), most):
                yield float(distance[nearest[j]]), out[nearest[j : j + most]]
            far, known = far[~ready], known[~ready]


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def _search(settings: AnnSettings):
    # with a margin, so that rounding does not end a search before a point as near as the last one
    limit = chi_square_limit(settings.confidence, settings.dimensions) * (1 + 1e-9)
    k = settings.neighbours

    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []}, dtype=np.int64)]
        full = np.array(vectors["v"].tolist(), np.float64)
        plane = None
        if len(vectors):
            # scaled before norms are taken, so that no square overflows
            full /= np.abs(full).max(axis=1)[:, None]
            # of equal vectors, one stands in the tree for the rows with the k + 1 smallest ids: no others can be found
            order = np.lexsort((vectors["vec_id"], *full.T[::-1]))
            full, ids, own = full[order], vectors["vec_id"].to_numpy()[order], vectors["row"].to_numpy()[order]
            first = np.flatnonzero(np.concatenate(([True], (full[1:] != full[:-1]).any(axis=1))))
            last = np.minimum(np.append(first[1:], len(full)), first + k + 1)
            different = full[first]
            norms, copies = _norms(different), last - first
            unit = different / norms[:, None]
            plane = np.random.default_rng(settings.seed).standard_normal((full.shape[1], settings.dimensions))
            tree = KdTree(unit @ plane, settings.leaf)
        for query_id, row, vector in zip(queries["vec_id"], queries["row"], queries["v"], strict=True):
            if plane is None:
                break
            asked = np.asarray(vector, np.float64) / np.abs(vector).max()
            length = math.sqrt(asked @ asked)
            direction = asked / length
            best_score, best, reach = np.zeros(0), np.zeros(0, np.int64), math.inf
            for distance, found in tree.by_distance(direction @ plane):
                if distance > limit * reach + 1e-12:
                    break
                scores = (different[found] @ asked) / (norms[found] * length)
                if len(best) == k:
                    # what is below the last of the best changes nothing
                    near = scores >= best_score[-1]
                    scores, found = scores[near], found[near]
                members, scores = expand(first[found], copies[found]), np.repeat(scores, copies[found])
                others = own[members] != row
                best_score = np.concatenate((best_score, scores[others]))
                best = np.concatenate((best, members[others]))
                keep = np.lexsort((ids[best], -best_score))[:k]
                best_score, best = best_score[keep], best[keep]
                if len(best) == k:
                    # of unit vectors, the squared distance follows from the cosine
                    reach = max(0.0, 2.0 - 2.0 * best_score[-1])
            out.append(pd.DataFrame({"query_id": query_id, "query_row": row, "vec_id": ids[best], "score": best_score}))
        return pd.concat(out)

    return run


def usable_vectors(table: DataFrame, ident: str, vector: str, *more: str) -> DataFrame:
    """``(vec_id, v, more)`` in double precision, without null, zero and not finite vectors."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad: Column = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("v", lambda x: x != 0)
    return table.select(F.col(ident).cast("long").alias("vec_id"), v.alias("v"), *more).where(
        F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & ~F.coalesce(zero, F.lit(True))
    )


def nearest_neighbours(
    table: DataFrame, asked: Column, settings: AnnSettings = AnnSettings(), ident: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row where ``asked`` holds, its nearest other rows by cosine.

    Scores are cosines of the vectors themselves; ties go to the smaller id.  Vectors that are null, zero, or hold a
    null or a value that is not finite take no part; rows with a null id neither.  Vectors of other lengths than a
    query's are not its candidates.  A repeated row is a candidate for its twin.  Without other rows a query has no
    result; an empty table has none.

    Rows are dealt into shards with a tree each, queries into blocks, and each block meets each shard once; a shard
    returns its best few for each query.
    """
    good = usable_vectors(table.withColumn("_asked", asked), ident, vector, "_asked").where("vec_id is not null").withColumn(
        "row", F.monotonically_increasing_id()
    )
    good = materialize(good.withColumn("width", F.size("v")))
    numbers = good.agg(F.count("*"), F.sum(F.col("_asked").cast("int"))).first()
    shards = (numbers[0] or 0) // settings.shard_rows + 1
    blocks = (numbers[1] or 0) // settings.query_rows + 1
    keys = ("width", "shard", "block")
    vectors = good.select(
        "width", F.pmod(F.xxhash64("row"), F.lit(shards).cast("long")).alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        "row", "vec_id", "v",
    )
    queries = good.where("_asked").select(
        "width", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("row"), F.lit(blocks).cast("long")).alias("block"),
        "row", "vec_id", "v",
    )
    types = "query_id long, query_row long, vec_id long, score double"
    found = vectors.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(_search(settings), types)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= settings.neighbours).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
