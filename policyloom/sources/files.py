"""Uploaded files: content hashes, triage and the upload log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from policyloom.functions import text as tx

# --- fixed values -----------------------------------------------------------
UPLOAD_LIMIT = 25 * 1024 * 1024
FRAMEWORK_LIMIT = 200 * 1024 * 1024
MAGIC = "%PDF-"
MIN_CHARS_PER_PAGE = 10


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files with path, time, length and content, empty ones included.

    Spark's file scan leaves out files of zero bytes, so these come from a listing
    of the same folder.
    """
    scanned = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.globStatus(jvm.org.apache.hadoop.fs.Path(folder, pattern)) if system.getFileStatus(folder).isDirectory() else []
    empty = [
        (f.getPath().toString(), f.getModificationTime() / 1000.0, 0, bytearray()) for f in found
        if f.isFile() and f.getLen() == 0 and not f.getPath().getName().startswith(("_", "."))
    ]
    listed = spark.createDataFrame(empty, "path string, seconds double, length long, content binary")
    return scanned.unionByName(listed.select("path", F.timestamp_seconds("seconds").alias("modificationTime"), "length", "content"))


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("checksum", F.sha2("content", 256))


def page_statistics(pages: DataFrame, by: str = "doc_id") -> DataFrame:
    """Pages, empty pages, characters and average characters per document."""
    size = F.length(tx.strip(F.coalesce("text", F.lit(""))))
    return pages.groupBy(by).agg(
        F.count("*").alias("total_pages"),
        F.count_if(size == 0).alias("empty_pages"),
        F.sum(size).alias("total_chars"),
        F.round(F.sum(size) / F.count("*"), 1).alias("avg_chars_per_page"),
    )


def error_type(size: Column, opening: Column, pages: Column, chars: Column, limit: Column | int,
               magic: str = MAGIC) -> Column:
    """First failing rule, or null for a good file."""
    blank = F.coalesce(chars, F.lit(0)) == 0
    return (
        F.when(size > limit, "file_too_large")
        .when(size == 0, "empty_file")
        .when(~opening.startswith(magic), "wrong_file_type")
        .when(blank & (pages > 0) & (F.coalesce(chars, F.lit(0)) < pages * MIN_CHARS_PER_PAGE), "scanned_document")
        .when(blank, "empty_document")
    )


def triage(files: DataFrame, statistics: DataFrame, key: str = "path", limit: int = UPLOAD_LIMIT,
           magic: str = MAGIC) -> DataFrame:
    """Files ``(key, length, content)`` joined to their page statistics and judged."""
    opening = F.substring(F.col("content"), 1, len(magic)).cast("string")
    joined = files.join(statistics, key, "left")
    verdict = error_type(F.col("length"), opening, F.col("total_pages"), F.col("total_chars"), F.lit(limit), magic)
    return joined.withColumn("error_type", verdict).withColumn("valid", F.col("error_type").isNull())


def upload_log(judged: DataFrame) -> DataFrame:
    """Share of uploads per outcome."""
    per_type = judged.groupBy(F.coalesce("error_type", F.lit("accepted")).alias("outcome")).agg(
        F.count("*").alias("uploads"), F.sum("length").alias("bytes")
    )
    every = F.sum("uploads").over(Window.partitionBy())  # one row per outcome
    return per_type.withColumn("share", F.round(F.col("uploads") / every, 4))
