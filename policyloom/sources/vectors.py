"""The chunk store with its vectors: a text is embedded when it enters the store, and never again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policyloom.functions.vectors import BatchEmbedder, HashingEmbedder, batch_embed
from policyloom.session import small_batches

#: Columns that the store adds to a chunk.
HASH, VECTOR = "text_hash", "embedding"
#: Components of vectors seldom come twice, but for zeros, which compression takes away: Parquet need not look for repeats.
_PLAIN = {f"parquet.enable.dictionary#{VECTOR}.list.element": "false"}


def _hashed(chunks: DataFrame, text: str) -> DataFrame:
    return chunks.withColumn(HASH, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def with_vectors(chunks: DataFrame, text: str = "text", make_model: Callable[[], BatchEmbedder] = HashingEmbedder) -> DataFrame:
    """Chunks with the hash of their text and its vector; a null text has the vector of the empty one."""
    return _hashed(chunks, text).withColumn(VECTOR, batch_embed(make_model)(F.col(text)))


def create_store(chunks: DataFrame, path: str, text: str = "text", make_model: Callable[[], BatchEmbedder] = HashingEmbedder) -> None:
    """Write all chunks with their vectors."""
    with small_batches(chunks.sparkSession):
        with_vectors(chunks, text, make_model).write.options(**_PLAIN).parquet(path)


def add_to_store(
    chunks: DataFrame, path: str, id_column: str = "chunk_id", text: str = "text",
    make_model: Callable[[], BatchEmbedder] = HashingEmbedder,
) -> None:
    """Add the chunks that the store does not hold with this id and text; only they are embedded.

    A text that the store knows under another id is not embedded either: its vector is taken over.  Vectors are read
    for such texts alone.  Null ids are added each time, as they cannot be recognised.  Chunks whose text changed come
    in beside their old version, which ``current`` leaves out.
    """
    spark = chunks.sparkSession
    store = spark.read.parquet(path)
    fresh = _hashed(chunks, text).join(store.select(id_column, HASH), [id_column, HASH], "left_anti")
    known = store.join(fresh.select(HASH).distinct(), HASH, "left_semi").groupBy(HASH).agg(F.first(VECTOR).alias(VECTOR))
    met = fresh.join(known, HASH, "left")
    vector = F.coalesce(VECTOR, F.lit(None).cast("array<double>"))
    old = met.where(vector.isNotNull())
    new = batch_embed(make_model)(F.col(text))
    rows = met.where(vector.isNull()).drop(VECTOR).withColumn(VECTOR, new).unionByName(old)
    with small_batches(spark):
        rows.select(*store.columns).write.options(**_PLAIN).mode("append").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def current(store: DataFrame, chunks: DataFrame, id_column: str = "chunk_id", text: str = "text") -> DataFrame:
    """What the store holds of these chunks as they are now."""
    return store.join(_hashed(chunks, text).select(id_column, HASH).distinct(), [id_column, HASH], "left_semi")
