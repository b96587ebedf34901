from conftest import DATA, rows
from pyspark.sql import functions as F

from policyloom.operators.segment import ingest_pages
from policyloom.streaming import ingest, sessions, usage
from policyloom.workload import base as b
from policyloom.workload import chat


def test_documents_grow_and_change_over_batches(spark, tmp_path):
    body = "12 word. " * 700
    schema = "doc_id long, page_number int, text string"
    source, target, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")

    def arrive(rows_):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest_stream(ingest.read_pages(spark, source, 1), target, state, small_rows=2).awaitTermination()
        return ingest.stored_chunks(spark, target).read()

    arrive([(d, 1, f"{d} {body}") for d in range(4)])
    # a second page, a changed page, the same page again, a new document
    stored = arrive([(0, 2, f"more {body}"), (1, 1, f"changed {body}"), (2, 1, f"2 {body}"), (9, 1, body)])
    final = [(0, 1, f"0 {body}"), (0, 2, f"more {body}"), (1, 1, f"changed {body}"), (2, 1, f"2 {body}"), (3, 1, f"3 {body}"), (9, 1, body)]
    expected = ingest_pages(spark.createDataFrame(final, schema))
    columns = ("doc_id", "section_no", "chunk_no", "chunk_id", "text")
    assert rows(stored, *columns) == rows(expected, *columns)


def test_buckets_hold_what_stays_and_what_changes(spark, tmp_path):
    """Many buckets; a batch that repeats most documents and changes some, with a page twice."""
    schema = "doc_id long, page_number int, text string"
    source, target, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    first = [(d, p, f"{d} {p} word. " * 90) for d in range(30) for p in (1, 2)]
    second = [(d, 1, f"new {d}" if d % 3 == 0 else f"{d} 1 word. " * 90) for d in range(30)] + [(0, 1, "later than new")]
    for wave in (first, second):
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest_stream(ingest.read_pages(spark, source), target, state, bucket_rows=4).awaitTermination()
    final = [(d, p, f"new {d}" if p == 1 and d % 3 == 0 else t) for d, p, t in first if (d, p) != (0, 1)] + [(0, 1, "later than new")]
    pages = ingest.stored_pages(spark, target)
    assert rows(pages.read(), "doc_id", "page_number", "text") == sorted(final, key=repr)
    assert [s.rows for s in pages.state()[2]] == [60, 20] and all(s.buckets > 1 for s in pages.state()[2])
    columns = ("doc_id", "section_no", "chunk_no", "chunk_id", "text")
    assert rows(ingest.stored_chunks(spark, target).read(), *columns) == rows(ingest_pages(spark.createDataFrame(final, schema)), *columns)
    # what was staged and not taken over is gone
    assert len(list((tmp_path / "out" / "pages" / "data").iterdir())) == 2


def test_rolling_counts_stream_equals_table(spark):
    streamed = chat.stream_rolling_counts(spark, str(DATA))
    table = usage.rolling_counts(b.read(spark, str(DATA), "events"), ["event_type"])
    table = table.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    columns = ("window_start", "event_type", "requests")
    assert rows(streamed, *columns) == rows(table, *columns)


def test_a_late_message_gets_the_dimension_of_its_place(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "conv_id long, turn int, text string"
    for wave in ([(1, 1, "alpha"), (1, 5, "beta")], [(1, 3, "?"), (1, 6, "?"), (2, 1, "?")]):
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(source)
        found = sessions.active_dimensions(spark.readStream.schema(schema).parquet(source), aliases={"A": ("alpha",), "B": ("beta",)})
        found.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(
            availableNow=True).start().awaitTermination()
    got = {(r.conv_id, r.turn): r.active_dimension for r in spark.read.schema(found.schema).parquet(target).collect()}
    assert got == {(1, 1): None, (1, 5): "A", (1, 3): "A", (1, 6): "B", (2, 1): None}


def test_session_stream_equals_batch(spark, tmp_path):
    from policyloom.operators.conversations import session_state

    messages = b.read(spark, str(DATA), "conversations").filter(F.col("role") == "user")
    messages.select("conv_id", "turn", "text").write.parquet(str(tmp_path / "in"))
    found = sessions.active_dimensions(spark.readStream.schema("conv_id long, turn long, text string").parquet(str(tmp_path / "in")), aliases=b.ALIASES)
    found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(
        availableNow=True).start().awaitTermination()
    streamed = spark.read.schema(found.schema).parquet(str(tmp_path / "out"))
    batch = session_state(messages, aliases=b.ALIASES)
    columns = ("conv_id", "turn", "named_dimension", "active_dimension")
    assert rows(streamed, *columns) == rows(batch, *columns)
