"""An inverted file over stored vectors: rows partitioned by cell, a few cells probed, scores exact.

The centres of the cells are fitted on a bounded sample; every row goes to the cell of its nearest centre and is
written there.  A search reads the cells nearest to its queries.  In exact mode it goes on to every further cell that
could hold a nearer row: no row of a cell is further from the centre than the cell's radius, so by the triangle
inequality of angles a cell can be left out whose bound is below what has been found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policyloom.functions.vectors import unit_rows
from policyloom.operators.nearest import VECTOR, arrow_rows, nearest_in_groups, tiles
from policyloom.operators.ordering import top_k
from policyloom.session import materialize


#: Rows with vectors that a search hands on at once.
SENT_ROWS = 8192


@dataclass(frozen=True)
class IndexSettings:
    """``sample_rows`` bounds what centres are fitted on, ``most_cells`` their number (they go to every task).

    ``cells`` of None means the square root of the number of rows.  ``part_rows`` and ``query_rows`` bound what meets
    in one group, however many rows a cell has and however many queries probe it.
    """

    cells: int | None = None
    most_cells: int = 16_384
    probes: int = 8
    sample_rows: int = 50_000
    part_rows: int = 32_768
    query_rows: int = 4096
    seed: int = 11


def _angles(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ centres.T, -1.0, 1.0))


def fit_centres(rows: DataFrame, settings: IndexSettings, id_column: str = "chunk_id") -> np.ndarray:
    """Unit centres of cells, from at most ``sample_rows`` rows picked by the hash of their id."""
    some = rows.where(F.exists(VECTOR, lambda x: x != 0))
    n = some.count()
    cells = settings.cells or min(settings.most_cells, max(1, math.isqrt(n)))
    share = max(1, n // settings.sample_rows)
    sample = some.where(F.pmod(F.xxhash64(id_column), F.lit(share)) == 0).limit(settings.sample_rows)
    points = materialize(sample.select(F.transform(VECTOR, lambda x: x.cast("double")).alias(VECTOR)))
    if points.isEmpty():
        return np.zeros((0, 1))
    vectors = points.select(array_to_vector(VECTOR).alias("features"))
    model = KMeans(k=cells, distanceMeasure="cosine", maxIter=8, seed=settings.seed).fit(vectors)
    return unit_rows(np.array(model.clusterCenters()))


def _assign(centres: np.ndarray, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tiles(batch.num_rows, len(centres)):
                angles = _angles(arrow_rows(batch.column(VECTOR), part), centres)
                cell = angles.argmin(axis=1)
                rows = batch.slice(part.start, part.stop - part.start).select(columns)
                near = [pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell])]
                yield pa.RecordBatch.from_arrays([*rows.columns, *near], names=[*columns, "cell", "angle"])

    return run


def build_index(
    rows: DataFrame, path: str, settings: IndexSettings = IndexSettings(), id_column: str = "chunk_id", carry: Sequence[str] = ()
) -> None:
    """Write every row ``(id, embedding, carry)`` into its cell, and the list of cells.

    Vectors that are null take no part; all others do, a zero vector in the cell whose centre comes first.  A cell of
    very many rows is written in several parts.
    """
    columns = [id_column, *carry, VECTOR]
    given = rows.select(*columns).where(F.col(VECTOR).isNotNull())
    given.limit(0).write.parquet(f"{path}/schema")
    centres = fit_centres(given, settings, id_column)
    if not len(centres):
        centres = np.ones((1, 1)) if given.isEmpty() else unit_rows(np.ones((1, len(given.first()[VECTOR]))))
    types = dict(given.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + ", cell int, angle double"
    placed = materialize(given.mapInArrow(_assign(centres, columns), schema))
    table = rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    filled = placed.groupBy("cell").agg(F.count("*").alias("rows"), F.max("angle").alias("radius"))
    table.join(filled, "cell").coalesce(1).write.parquet(f"{path}/cells")
    # a file for each cell and share of its rows
    share = F.floor(F.rand(settings.seed) * 8)
    placed.drop("angle").repartition("cell", share).write.partitionBy("cell").parquet(f"{path}/rows")


@dataclass(frozen=True)
class VectorIndex:
    """A written index; the list of its cells is read when it is opened."""

    rows: DataFrame
    cells: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    numbers: np.ndarray
    settings: IndexSettings
    id_column: str

    def search(self, queries: DataFrame, k: int, *, query_keys: Sequence[str], source: str = VECTOR, exact: bool = False) -> DataFrame:
        """``(query_keys, rank, id, carry, similarity)``: the best ``k`` rows of each query; ties go to the smaller id.

        ``source`` holds the query's vector; similarities are (1 + cosine) / 2 to six decimals.  Otherwise only the
        ``probes`` nearest cells are read, and a row elsewhere may be missed.
        """
        asked = materialize(queries.select(*query_keys, F.col(source).alias(VECTOR)).where(F.col(VECTOR).isNotNull()))
        near = self._probe(asked, query_keys, None)
        found = self._score(near, k, query_keys)
        order = [F.desc("similarity"), F.asc(self.id_column)]
        if exact:
            found = materialize(top_k(found, query_keys, order, k).drop("rank"))
            reached = found.groupBy(*query_keys).agg(F.count("*").alias("n"), F.min("similarity").alias("least"))
            least = F.when(F.col("n") >= k, F.col("least")).otherwise(-1.0)
            bars = asked.join(reached, list(query_keys), "left").select(*query_keys, VECTOR, F.coalesce(least, F.lit(-1.0)).alias("least"))
            found = found.unionByName(self._score(self._probe(bars, query_keys, "least"), k, query_keys))
        return top_k(found, query_keys, order, k)

    def _probe(self, asked: DataFrame, keys: Sequence[str], bar: str | None) -> DataFrame:
        """Queries with the cells they look into: the nearest ones, or all others that may reach the bar."""
        centres, radii, numbers, probes = self.centres, self.radii, self.numbers, self.settings.probes
        types = dict(asked.dtypes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(numbers):
                    continue
                for part in tiles(batch.num_rows, len(numbers)):
                    angles = _angles(arrow_rows(batch.column(VECTOR), part), centres)
                    order = np.argsort(angles, axis=1, kind="stable")
                    first = np.zeros(angles.shape, bool)
                    np.put_along_axis(first, order[:, :probes], True, axis=1)
                    rows = batch.slice(part.start, part.stop - part.start)
                    if bar is not None:
                        # the rounding of a similarity is half a millionth
                        bound = (1.0 + np.cos(np.maximum(0.0, angles - radii))) / 2.0
                        first = ~first & (bound >= rows.column(bar).to_numpy()[:, None] - 1e-6)
                    row, cell = np.nonzero(first)
                    rows = rows.select([*keys, VECTOR])
                    # a query may look into every cell: its vector is copied for a bounded number of them at a time
                    for at in range(0, len(row), SENT_ROWS):
                        sent = rows.take(pa.array(row[at:at + SENT_ROWS]))
                        found = pa.array(numbers[cell[at:at + SENT_ROWS]].astype(np.int32))
                        yield pa.RecordBatch.from_arrays([*sent.columns, found], names=[*keys, VECTOR, "cell"])

        schema = ", ".join(f"`{c}` {types[c]}" for c in [*keys, VECTOR]) + ", cell int"
        return asked.mapInArrow(run, schema)

    def _score(self, probed: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
        """The best rows of each query in the cells that it probes; only their folders are read."""
        probed = materialize(probed)
        # one row for each cell, so the list is bounded
        wanted = [r.cell for r in probed.select("cell").distinct().collect()]
        kept = [c for c in self.rows.columns if c not in ("cell", VECTOR, self.id_column)]
        return nearest_in_groups(
            self.rows.where(F.col("cell").isin(wanted)), probed, "cell", k, query_keys=keys, id_column=self.id_column, carry=kept,
            sizes=self.cells.select("cell", F.col("rows").alias("n")), part_rows=self.settings.part_rows, query_rows=self.settings.query_rows,
        ).drop("rank")


def open_index(spark: SparkSession, path: str, settings: IndexSettings = IndexSettings(), id_column: str = "chunk_id") -> VectorIndex:
    cells = spark.read.parquet(f"{path}/cells")
    listed = cells.orderBy("cell").collect()  # at most ``most_cells`` rows
    schema = spark.read.parquet(f"{path}/schema").withColumn("cell", F.lit(0))
    rows = spark.read.schema(schema.schema).parquet(f"{path}/rows") if listed else schema
    return VectorIndex(
        rows, cells, np.array([r.centre for r in listed]) if listed else np.zeros((0, 1)), np.array([r.radius for r in listed]),
        np.array([r.cell for r in listed], np.int64), settings, id_column,
    )
