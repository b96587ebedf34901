"""Exact nearest neighbours, rank fusion and hybrid reranking.

The query side is a small table (profile texts, topic texts).  Its vectors go to
every task after their number has been checked; each Arrow batch of chunks is
scored with one matrix product and only the batch's best rows leave Python, so
no chunk-by-query table is ever built.  Past the limit the two sides are cut
into blocks and scored block against block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyloom.functions import text as tx
from policyloom.functions.numbers import settled
from policyloom.functions.vectors import BatchEmbedder, HashingEmbedder, embed_with, round_half_up, unit_rows
from policyloom.operators.ordering import top_k

# --- fixed values -----------------------------------------------------------
RRF_OFFSET = 60
VECTOR = "embedding"
DENSE_WEIGHT = 0.7
DENSE_HEADROOM = 3
ROLE_HEADROOM = 5

QUERY_BYTES_LIMIT = 64 << 20
BROADCAST_ROWS = 100_000
BLOCK_ROWS = 8192
#: What a task holds at once beside its batch: rows as a matrix, and scores of rows against queries.
TILE_ROWS = 1024
TILE_SCORES = 1 << 20


def similarities(matrix: np.ndarray, query_matrix: np.ndarray) -> np.ndarray:
    """(1 + cosine) / 2 of unit rows against unit queries, to six decimals."""
    return round_half_up(np.maximum(0.0, (1.0 + matrix @ query_matrix.T) / 2.0))


def best_rows(scores: np.ndarray, ids: np.ndarray, scope: np.ndarray | None, k: int):
    """Row and column numbers of the k best per scope and query; ties by id."""
    rows, columns = [], []
    if scope is None:
        rows, columns = _reaching(scores, k, np.full(scores.shape[1], -np.inf))
        order, columns = _first(columns, -scores[rows, columns], ids[rows], k)
        return rows[order], columns
    rows, columns = [], []
    for column in range(scores.shape[1]):
        order = np.lexsort((ids, -scores[:, column], scope))
        ordered = scope[order]
        starts = np.r_[0, np.flatnonzero(np.diff(ordered)) + 1]
        within = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        picked = order[within < k]
        rows.append(picked)
        columns.append(np.full(len(picked), column))
    return np.concatenate(rows), np.concatenate(columns)


def _reaching(scores: np.ndarray, k: int, bar: np.ndarray):
    """Cells that reach the bar of their column and are among its k best here, ties included."""
    if len(scores) > k:
        bar = np.maximum(bar, np.partition(scores, len(scores) - k, axis=0)[len(scores) - k])
    return np.nonzero(scores >= bar)


def _first(columns: np.ndarray, order: np.ndarray, ids: np.ndarray, k: int):
    """The first k of each column by ``order``, then id: their places, and the columns of these."""
    places = np.lexsort((ids, order, columns))
    columns = columns[places]
    kept = np.arange(len(columns)) - np.searchsorted(columns, columns) < k
    return places[kept], columns[kept]


def tiles(n: int, width: int) -> Iterator[slice]:
    """Slices of ``n`` rows, so short that their scores against ``width`` queries are few enough to be held."""
    step = max(1, min(TILE_ROWS, TILE_SCORES // max(1, width)))
    return (slice(at, min(n, at + step)) for at in range(0, n, step))


def arrow_rows(column: pa.Array | pa.ChunkedArray, part: slice) -> np.ndarray:
    """A slice of an Arrow column of vectors as unit rows; only these rows are copied."""
    some = column.slice(part.start, part.stop - part.start)
    chunks = some.chunks if isinstance(some, pa.ChunkedArray) else [some]
    out = []
    for c in chunks:
        if len(c):
            sizes = c.value_lengths().to_numpy(zero_copy_only=False)
            if c.null_count or sizes.min() != sizes.max():
                raise ValueError("vectors are null or of different lengths")
            out.append(c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(c), -1))
    return unit_rows(np.vstack(out)) if out else np.zeros((0, 1))


def _vectors(table, column: str, part: slice, embedder: BatchEmbedder | None) -> np.ndarray:
    if embedder is None:
        return arrow_rows(table.column(column), part)
    return embedder(table.column(column).slice(part.start, part.stop - part.start).to_pylist())


def _ids(table, column: str) -> np.ndarray:
    return table.column(column).to_pandas().to_numpy()


class _Hits:
    """Rows with the numbers of the queries that picked them; the first k of each query are kept."""

    def __init__(self, kept: Sequence[str], id_column: str, k: int, width: int):
        self.kept, self.id_column, self.k = list(kept), id_column, k
        self.bar, self.most = np.full(width, -np.inf), 2 * k * width + TILE_ROWS
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, rows, scores: np.ndarray) -> None:
        """``scores`` of all queries over the rows of one tile."""
        row, column = _reaching(scores, self.k, self.bar)
        if len(row):
            rows = pa.Table.from_batches([rows]) if isinstance(rows, pa.RecordBatch) else rows
            self.parts.append((rows.select(self.kept).take(pa.array(row)), column, scores[row, column]))
            self.held += len(row)
        if self.held > self.most:
            self.best()

    def best(self) -> tuple | None:
        """``(rows, columns, scores)``, or None if there are none."""
        if not self.parts:
            return None
        table = pa.concat_tables([p[0] for p in self.parts]).combine_chunks()
        columns, scores = (np.concatenate([p[i] for p in self.parts]) for i in (1, 2))
        order, columns = _first(columns, -scores, _ids(table, self.id_column), self.k)
        table, scores = table.take(pa.array(order)), scores[order]
        full = np.flatnonzero(np.arange(len(columns)) - np.searchsorted(columns, columns) == self.k - 1)
        self.bar[columns[full]] = scores[full]
        self.parts, self.held = [(table, columns, scores)], len(columns)
        return self.parts[0]


def _found(rows: pa.Table, labels: pa.Table, columns: np.ndarray, scores: np.ndarray) -> pa.Table:
    asked = labels.take(pa.array(columns))
    arrays = [*rows.columns, *asked.columns, pa.array(scores)]
    return pa.table(arrays, names=[*rows.column_names, *asked.column_names, "similarity"]).combine_chunks()


def nearest(
    chunks: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    query_keys: Sequence[str],
    source: str = "text",
    id_column: str = "chunk_id",
    scope: str | None = None,
    carry: Sequence[str] = (),
    attach: Sequence[str] = (),
    embedder: BatchEmbedder | None = None,
    stored_vectors: bool = False,
    bytes_limit: int = QUERY_BYTES_LIMIT,
) -> DataFrame:
    """Top ``k`` chunks per query, or per scope value and query.

    ``source`` names the column that holds the text (or, with
    ``stored_vectors``, the vector) on both sides.  Chunks that bring their
    vectors in a column ``embedding`` (``sources.vectors``) are not embedded
    again; only the queries are.  Narrow ``carry`` columns
    travel with the scores; wide ``attach`` columns (texts, vectors) are joined
    to the winners afterwards, so a text is never copied once per query.
    """
    embedder = None if stored_vectors else (embedder or HashingEmbedder())
    vector = F.col(source) if stored_vectors else embed_with(embedder)(F.col(source))
    queries = queries.select(*query_keys, vector.alias(source))
    if not stored_vectors and VECTOR in chunks.columns:
        embedder, texts = None, chunks
        chunks = chunks.select(*dict.fromkeys([*([scope] if scope else []), id_column, *carry]), F.col(VECTOR).alias(source))
    else:
        texts = chunks
    width = getattr(embedder, "dims", 1024) * 8
    limit = max(1, bytes_limit // width)
    asked = queries.limit(limit + 1).toArrow()  # vectors only, never the texts
    kept = list(dict.fromkeys([*([scope] if scope else []), id_column, *carry]))
    types = dict(chunks.dtypes) | {c: t for c, t in queries.dtypes if c in query_keys}
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*kept, *query_keys]) + ", similarity double"
    columns = list(dict.fromkeys([*kept, source]))
    order = [F.desc("similarity"), F.asc(id_column)]
    keys = [*([scope] if scope else []), *query_keys]

    if len(asked) > limit:
        partial = _blockwise(chunks.select(*columns), queries, k, query_keys, source, id_column,
                             scope, kept, embedder, schema)
        found = top_k(partial, keys, order, k, spread_by=None if scope else id_column)
        return attach_columns(found, texts, id_column, attach)

    query_matrix, labels = arrow_rows(asked.column(source), slice(0, len(asked))), asked.select(list(query_keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(query_matrix):
            return
        yield from _score(batches, query_matrix, labels, k, source, id_column, scope, kept, embedder)

    partial = chunks.select(*columns).mapInArrow(run, schema)
    found = top_k(partial, keys, order, k, spread_by=None if scope else id_column)
    return attach_columns(found, texts, id_column, attach, None if scope else len(asked) * k)


def nearest_in_groups(
    rows: DataFrame, queries: DataFrame, group: str, k: int, *, query_keys: Sequence[str], id_column: str = "chunk_id",
    carry: Sequence[str] = (), sizes: DataFrame | None = None, part_rows: int = 32_768, query_rows: int = 4096,
) -> DataFrame:
    """Best ``k`` rows of each query among the rows of the query's own group, by stored vectors.

    ``rows(group, id, embedding, carry)`` and ``queries(keys, group, embedding)`` meet by group: a query never sees
    rows of other groups, and groups without queries are not shuffled.  A group of very many rows or queries is cut
    into parts and blocks, so that what meets is bounded.  ``sizes(group, n)`` spares the count of the rows.
    Queries whose group has no rows have no result.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("n")) if sizes is None else sizes
    asks = queries.groupBy(group).agg(F.count("*").alias("asks"))
    cuts = sizes.join(asks, group).select(
        group, F.ceil(F.col("n") / part_rows).cast("long").alias("_parts"), F.ceil(F.col("asks") / query_rows).cast("long").alias("_blocks")
    )
    kept = list(dict.fromkeys([id_column, *carry]))

    def each(column: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(column) - 1))

    own = rows.select(group, *kept, VECTOR).join(cuts, group).withColumn(
        "_part", F.pmod(F.xxhash64(id_column), F.col("_parts"))).withColumn("_block", each("_blocks")).drop("_parts", "_blocks")
    asked = queries.select(*query_keys, F.col(group).alias("_group"), F.col(VECTOR).alias(VECTOR)).join(
        cuts.withColumnRenamed(group, "_group"), "_group").withColumn(
        "_block", F.pmod(F.xxhash64(*query_keys), F.col("_blocks"))).withColumn("_part", each("_parts")).drop("_parts", "_blocks")
    types = dict(asked.dtypes) | dict(own.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*kept, *query_keys]) + ", similarity double"

    def run(mine: pa.Table, others: pa.Table) -> pa.Table:
        labels, hits = others.select(list(query_keys)), []
        # the queries of a block in tiles too: a group is read once, its scores are never held as a whole
        for asks in tiles(len(others), TILE_ROWS):
            matrix, best = arrow_rows(others.column(VECTOR), asks), _Hits(kept, id_column, k, asks.stop - asks.start)
            for part in tiles(len(mine), len(matrix)):
                best.add(mine.slice(part.start, part.stop - part.start), similarities(arrow_rows(mine.column(VECTOR), part), matrix))
            done = best.best()
            if done:
                hits.append(_found(done[0], labels.slice(asks.start, len(matrix)), done[1], done[2]))
        none = _found(mine.select(kept).slice(0, 0), labels.slice(0, 0), np.zeros(0, int), np.zeros(0))
        return pa.concat_tables([none, *hits])

    met = own.groupBy(group, "_part", "_block").cogroup(asked.groupBy("_group", "_part", "_block")).applyInArrow(run, schema)
    return top_k(met, query_keys, [F.desc("similarity"), F.asc(id_column)], k)


def attach_columns(hits: DataFrame, chunks: DataFrame, id_column: str, columns: Sequence[str],
                   most: int | None = None) -> DataFrame:
    """Columns of the chunk table for the winners.

    ``most`` is the proven number of hits (queries times k).  Up to a limit they
    are sent to the chunk scan; without a bound, or past it, Spark picks the join.
    """
    if not columns:
        return hits
    small = most is not None and most <= BROADCAST_ROWS
    wide = chunks.select(id_column, *columns)
    return wide.join(F.broadcast(hits) if small else hits, id_column)


def _score(batches, query_matrix, labels, k, source, id_column, scope, kept, embedder) -> Iterator[pa.RecordBatch]:
    """The best rows of a task for each query, or those of each batch for each scope and query."""
    width = len(query_matrix)
    best = _Hits(kept, id_column, k, width)
    for batch in batches:
        parts = tiles(batch.num_rows, width)
        scored = ((p, similarities(_vectors(batch, source, p, embedder), query_matrix)) for p in parts)
        if scope is None:  # few queries, no scopes: keep the task's best and send them once
            for part, scores in scored:
                best.add(batch.slice(part.start, part.stop - part.start), scores)
            continue
        held, since = [], 0
        for part, scores in scored:
            held.append(scores)
            if part.stop == batch.num_rows or (part.stop - since) * width > 4 * TILE_SCORES:
                rows = pa.Table.from_batches([batch.slice(since, part.stop - since)]).select(kept)
                scores, codes = np.concatenate(held), pd.factorize(rows.column(scope).to_pandas())[0]
                row, column = best_rows(scores, _ids(rows, id_column), codes, k)
                yield from _found(rows.take(pa.array(row)), labels, column, scores[row, column]).to_batches()
                held, since = [], part.stop
    done = best.best()
    if done:
        yield from _found(done[0], labels, done[1], done[2]).to_batches()


def _blockwise(chunks, queries, k, query_keys, source, id_column, scope, kept, embedder, schema):
    """Many queries: blocks of chunks meet blocks of queries, each pair one bounded group."""
    chunk_blocks = max(1, -(-chunks.count() // BLOCK_ROWS))
    query_blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    left = chunks.withColumn("_cb", F.pmod(F.xxhash64(id_column), F.lit(chunk_blocks)).cast("int")).withColumn(
        "_qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    )
    right = queries.withColumn(
        "_qb", F.pmod(F.xxhash64(*query_keys), F.lit(query_blocks)).cast("int")
    ).withColumn("_cb", F.explode(F.sequence(F.lit(0), F.lit(chunk_blocks - 1))))

    def run(batch: pa.Table, asked: pa.Table) -> pa.Table:
        labels = asked.select(list(query_keys))
        out = [_found(batch.select(kept).slice(0, 0), labels.slice(0, 0), np.zeros(0, int), np.zeros(0))]
        if len(batch):
            rows = batch.combine_chunks().to_batches()
            for asks in tiles(len(asked), TILE_ROWS):
                found = _score(rows, arrow_rows(asked.column(source), asks), labels.slice(asks.start, asks.stop - asks.start), k, source, id_column, scope, kept, embedder)
                out += [pa.Table.from_batches([b]) for b in found]
        return pa.concat_tables(out)

    return left.groupBy("_cb", "_qb").cogroup(right.groupBy("_cb", "_qb")).applyInArrow(run, schema)


# -- fusion and reranking ----------------------------------------------------

def reciprocal_rank_fusion(ranked: DataFrame, keys: Sequence[str], id_column: str = "chunk_id",
                           rank: str = "rank") -> DataFrame:
    """Fuse ranked lists (ranks from 1; the best counts 1/60) and keep the best similarity."""
    gain = 1.0 / (F.lit(RRF_OFFSET) + F.col(rank) - 1)
    aggregates = [F.round(F.sum(gain), 10).alias("rrf_score")]
    if "similarity" in ranked.columns:
        aggregates.append(F.max("similarity").alias("best_similarity"))
    return ranked.groupBy(*keys, id_column).agg(*aggregates)


def hybrid_score(query: Column, text: Column, dense: Column) -> Column:
    terms = tx.query_terms(query)
    lexical = tx.count_contained(text, terms) / (F.size(tx.words(text)) + 1)
    return F.lit(DENSE_WEIGHT) * dense + (1.0 - F.lit(DENSE_WEIGHT)) * lexical


def hybrid_rerank(candidates: DataFrame, keys: Sequence[str], k: int, query: str = "query_text",
                  text: str = "text", id_column: str = "chunk_id") -> DataFrame:
    """Reorder dense candidates by 0.7 dense + 0.3 lexical and keep ``k``."""
    scored = candidates.withColumn("_combined", hybrid_score(F.col(query), F.col(text), F.col("similarity")))
    ranked = top_k(
        scored.drop("rank"), keys, [F.desc("_combined"), F.desc("similarity"), F.asc(id_column)], k
    )
    return (
        ranked.withColumn("dense_score", settled(F.col("similarity"), 4))
        .withColumn("similarity", F.round("_combined", 4))
        .drop("_combined")
    )


def retrieve(
    chunks: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    query_keys: Sequence[str],
    id_column: str = "chunk_id",
    scope: str | None = None,
    carry: Sequence[str] = (),
    roles: Sequence[str] | None = None,
    frameworks: Sequence[str] | None = None,
    workspaces: Sequence[str] | None = None,
    embedder: BatchEmbedder | None = None,
    hybrid: bool = True,
) -> DataFrame:
    """Filtered retrieval: filter, dense top ``3k`` (``5k`` under roles), hybrid rerank, cut to ``k``.

    ``queries`` has the query keys and a ``text`` column.
    """
    if frameworks:
        chunks = chunks.filter(F.col("framework").isin(*frameworks))
    if workspaces:
        chunks = chunks.filter(F.col("workspace_id").isin(*workspaces))
    if roles:
        chunks = chunks.filter(tx.has_role(F.col("roles"), roles))
    keys = [*([scope] if scope else []), *query_keys]
    if not hybrid:
        return nearest(chunks, queries, k, query_keys=query_keys, id_column=id_column, scope=scope,
                       attach=carry, embedder=embedder)
    headroom = ROLE_HEADROOM if roles else DENSE_HEADROOM
    dense = nearest(
        chunks, queries, k * headroom, query_keys=query_keys, id_column=id_column,
        scope=scope, attach=[c for c in dict.fromkeys(["text", *carry]) if c != scope], embedder=embedder,
    )
    worded = dense.join(queries.select(*query_keys, F.col("text").alias("query_text")), list(query_keys))
    return hybrid_rerank(worded, keys, k, id_column=id_column)


def rerank_pairs(candidates: DataFrame, keys: Sequence[str], k: int, scorer, threshold: float = 0.1,
                 query: str = "query_text", text: str = "text", id_column: str = "chunk_id") -> DataFrame:
    """Second-stage reranking by any pair scorer Column; scores under the threshold are dropped."""
    scored = candidates.withColumn("reranker_score", scorer(F.col(query), F.col(text)))
    ranked = top_k(scored.drop("rank"), keys, [F.desc("reranker_score"), F.asc(id_column)], k)
    return ranked.filter(F.col("reranker_score") >= threshold)
