"""Framework catalog, chunk store and sync reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policyloom.operators.ordering import first_per_key

CATALOG_SCHEMA = (
    "name string, version string, website string, pdf_url string, checksum string, local_path string, "
    "roles array<string>, dimensions array<string>, regions array<string>, source_type string"
)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog from JSON lines; missing lists are empty, order is by line."""
    raw = spark.read.schema(CATALOG_SCHEMA).json(path)
    empty = F.array().cast("array<string>")
    return raw.select(
        F.monotonically_increasing_id().alias("ord"),
        *[c for c in raw.columns if c not in ("roles", "dimensions", "regions")],
        *[F.coalesce(c, empty).alias(c) for c in ("roles", "dimensions", "regions")],
    )


def library(catalog: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk count and indexed flag for every catalog entry, first of equal names."""
    counts = chunks.groupBy(F.col("framework").alias("name")).agg(F.count("*").alias("chunk_count"))
    entries = first_per_key(catalog, ["name"], ["ord"])
    return entries.join(counts, "name", "left").withColumn(
        "chunk_count", F.coalesce("chunk_count", F.lit(0))
    ).withColumn("indexed", F.col("chunk_count") > 0)


def store_health(chunks: DataFrame) -> DataFrame:
    per_framework = chunks.groupBy("framework").agg(F.count("*").alias("n"))
    return per_framework.agg(
        F.sum("n").alias("total_chunks"),
        F.count_if(F.coalesce("framework", F.lit("")) != "").alias("frameworks"),
    )


def sync_plan(catalog_files: DataFrame, stored: DataFrame, chunk_counts: DataFrame) -> DataFrame:
    """What a sync has to do per framework.

    ``catalog_files(name, checksum)`` is the present state, ``stored(name,
    checksum)`` the state of the last sync.  A framework is skipped when its
    checksum is unchanged and chunks of it exist.
    """
    old = stored.select("name", F.col("checksum").alias("old_checksum"))
    unchanged = (F.col("old_checksum") == F.col("checksum")) & (F.col("existing_chunks") > 0)
    return (
        catalog_files.join(old, "name", "left")
        .join(chunk_counts.select("name", F.col("chunk_count").alias("existing_chunks")), "name", "left")
        .withColumn("existing_chunks", F.coalesce("existing_chunks", F.lit(0)))
        .withColumn(
            "action",
            F.when(F.coalesce(unchanged, F.lit(False)), "skip")
            .when(F.col("existing_chunks") > 0, "replace")
            .otherwise("ingest"),
        )
    )


def write_chunks(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Chunk table partitioned by framework; rows of one framework go to several files."""
    chunks.write.mode(mode).partitionBy("framework").parquet(path)


def replace_frameworks(chunks: DataFrame, path: str) -> None:
    """Swap the partitions of the frameworks present in ``chunks``, leave the others.

    New files are written first and exchanged on commit, so a job that dies
    half-way leaves the old chunks in place.
    """
    (
        chunks.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("framework")
        .parquet(path)
    )


def status_report(catalog: DataFrame, files: DataFrame, chunk_counts: DataFrame) -> DataFrame:
    """Catalog, file and chunk state side by side."""
    return (
        catalog.join(files.select("name", F.lit(True).alias("_file")), "name", "left")
        .join(chunk_counts.select("name", "chunk_count"), "name", "left")
        .withColumn("downloaded", F.coalesce("_file", F.lit(False)))
        .withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
        .withColumn("indexed", F.col("chunk_count") > 0)
        .drop("_file")
    )


def lookup(ids: DataFrame, chunks: DataFrame, id_column: str = "chunk_id") -> DataFrame:
    """Batch lookup: every asked id, with the chunk's columns or nulls."""
    return ids.join(chunks.withColumn("found", F.lit(True)), id_column, "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)
