"""Streaming document ingest on top of the batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from policyloom.operators.ordering import first_per_key
from policyloom.operators.segment import MAX_CHUNK, OVERLAP, ingest_pages
from policyloom.session import materialize
from policyloom.sources.log import LogTable

PAGES_SCHEMA = "doc_id long, page_number int, text string"


def read_pages(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Page rows from arriving Parquet files."""
    reader = spark.readStream.schema(PAGES_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def content_hash(text: Column, *order: str) -> Column:
    """One hash of a group's texts in order: an aggregate, whose list holds hashes in place of texts."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.sha2(F.coalesce(text, F.lit("")), 256).alias("h"))))
    return F.sha2(F.to_json(listed), 256)


def stored_pages(spark: SparkSession, target: str, **sizes) -> LogTable:
    return LogTable(spark, f"{target}/pages", **sizes)


def stored_chunks(spark: SparkSession, target: str, **sizes) -> LogTable:
    return LogTable(spark, f"{target}/chunks", **sizes)


def ingest_stream(pages: DataFrame, target: str, checkpoint: str, available_now: bool = True, **sizes) -> StreamingQuery:
    """Pages to chunks; a document whose pages change is cut again as a whole and replaced.

    ``target`` gets the stored pages and their chunks as log-structured tables.  A micro-batch reads the stored pages
    of its own documents, leaves out those whose content stays as it was, and adds one segment to each table: what it
    writes grows with the batch and its documents, not with the store.  A batch that is replayed is not written twice,
    and the stream itself keeps no state.  ``sizes`` are those of ``LogTable``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        page_log, chunk_log = stored_pages(spark, target, **sizes), stored_chunks(spark, target, **sizes)
        last = page_log.last_batch()
        if last is not None and last >= batch_id:
            return
        new = batch.select("doc_id", "page_number", "text", F.lit(1).alias("age"))
        old = page_log.read(materialize(new.select("doc_id").distinct())) if page_log.state()[0] else None
        both = new if old is None else new.unionByName(old.withColumn("age", F.lit(2)))
        # new pages go before stored ones; a page that comes twice in a batch counts once: the first by its text.
        # Texts are moved once, to where the table's buckets are written from.
        keys, buckets = ["doc_id", "page_number"], page_log.buckets_for(both.count())
        if buckets > 1:
            both = page_log.deal(both, buckets)
            keys += [c for c in both.columns if c not in (*new.columns,)]
        merged = page_log.stage(first_per_key(both, keys, ["age", "text"]).drop("age"), buckets)
        every = materialize(merged.rows.groupBy("doc_id").agg(
            content_hash(F.col("text"), "page_number").alias("content_hash"),
            # about one chunk for each page and each stride
            (F.count("*") + F.sum(F.length("text")) / (MAX_CHUNK - OVERLAP)).alias("chunks"),
        ))
        known, heads = page_log.heads(), every
        if known is not None:
            heads = materialize(every.join(known, ["doc_id", "content_hash"], "left_anti"))
        n, expect = heads.agg(F.count("*"), F.coalesce(F.sum("chunks"), F.lit(0)).cast("long")).first()
        whole = n == every.count()
        changed = merged.rows if whole else merged.rows.join(heads.select("doc_id"), "doc_id", "left_semi")
        # chunks first: if the batch is replayed, its pages are still new
        chunk_log.put(ingest_pages(changed), heads, batch_id, expect)
        page_log.put(merged if whole else changed, heads, batch_id, merged.n)
        if not whole:
            page_log.unstage(merged)

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
