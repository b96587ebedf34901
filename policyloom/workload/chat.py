"""Conversation log, call log and the streaming twins of both."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from policyloom.functions import text as tx
from policyloom.operators import conversations as cv
from policyloom.operators import usage
from policyloom.session import ensure_checkpoint_dir
from policyloom.streaming import ingest as stream_ingest
from policyloom.streaming import sessions as stream_sessions
from policyloom.streaming import usage as stream_usage
from policyloom.workload import base as b


def _users(spark, sf):
    return b.read(spark, sf, "conversations").filter(F.col("role") == "user")


def session_carry(spark, sf):
    state = cv.session_state(_users(spark, sf), aliases=b.ALIASES, block=1000)
    return state.select("conv_id", "turn", "named_dimension", "active_dimension")


def intents(spark, sf):
    """Intents of the user turns; every third message is put as a question."""
    asked = _users(spark, sf).withColumn(
        "text",
        F.when(F.pmod("conv_id", F.lit(3)) == 0, F.concat(F.lit("What is "), F.col("text")))
        .when(F.pmod("conv_id", F.lit(3)) == 1, F.concat_ws(" ", F.slice(F.split("text", " "), 1, 3)))
        .otherwise(F.col("text")),
    )
    done = cv.classify_messages(cv.session_state(asked, aliases=b.ALIASES))
    return done.select("conv_id", "turn", "intent", "dimension")


def history_window(spark, sf):
    done = cv.history(b.read(spark, sf, "conversations"))
    return done.select("conv_id", "turn", "history_size", F.md5("history_text").alias("digest"))


def chat_modes(spark, sf):
    """Routing of user turns; one in four mentions the document."""
    n = F.pmod("conv_id", F.lit(4))
    message = F.when(n == 0, F.concat(F.lit("Summarise this document: "), F.col("text"))).otherwise(F.col("text"))
    requested = F.when(n == 1, "framework_qa").when(n == 2, "auditor").otherwise("other")
    mode = cv.chat_mode(message, requested, F.pmod("turn", F.lit(4)) == 0, F.pmod("turn", F.lit(6)) == 2)
    return _users(spark, sf).select("conv_id", "turn", mode.alias("mode"), tx.asks_about_document(message).alias("asks"))


def guardrails(spark, sf):
    """Strict guardrail per user turn against the documents."""
    asked = _users(spark, sf).withColumn(
        "text",
        F.when(F.pmod("conv_id", F.lit(5)) == 0, F.concat(F.lit("Hello "), F.col("text")))
        .when(F.pmod("conv_id", F.lit(5)) == 1, F.concat(F.col("text"), F.lit(" and the weather"))).otherwise(F.col("text")),
    )
    done = cv.guarded(asked, b.embedded_corpus(spark, sf))
    return done.select("conv_id", "turn", "rejected_for")


def token_estimates(spark, sf):
    return b.read(spark, sf, "conversations").groupBy("role").agg(F.sum(tx.estimated_tokens(F.col("text"))).alias("tokens"))


def rolling_rate(spark, sf):
    """Calls and tokens in the minute up to each event, per event type."""
    done = usage.rolling_usage(
        b.read(spark, sf, "events"), ["event_type"], tokens=F.length("props").cast("long") * 500, seconds=1800
    )
    return done.select("event_id", "window_requests", "window_tokens", usage.over_limit(3, 20000).alias("over_limit"))


def daily_budget(spark, sf):
    spent = usage.daily_budget(b.read(spark, sf, "events"), ["event_type"], limit=80)
    return spent.withColumn("day", F.col("day").cast("string"))


def _scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4()}"


def _event_stream(spark, sf, name):
    schema = b.read(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _run(stream, spark, mode: str = "append"):
    """Run a stream to its end into Parquet and read the result."""
    target = _scratch(spark)
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", target + "/out")
        .option("checkpointLocation", target + "/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target + "/out")


def stream_rolling_counts(spark, sf):
    """Sliding one-minute counts of an event stream: closed windows as the stream emits them, then those still open."""
    counts = stream_usage.rolling_counts(_event_stream(spark, sf, "events"), ["event_type"])
    target = _scratch(spark)

    def write(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target + "/out")

    counts.writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", target + "/state").trigger(availableNow=True).start().awaitTermination()
    # a window has a row for each batch that changed it, and the last one holds
    keys = ["window_start", "window_end", "event_type"]
    written = spark.read.parquet(target + "/out")
    closed = written.groupBy(*keys).agg(F.max_by("requests", "batch").alias("requests"))
    plain = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")]
    return closed.select(*plain, "event_type", "requests")


def stream_session_state(spark, sf):
    """Two waves of messages; those of the second are late, between turns that have been answered."""
    scratch = _scratch(spark)
    messages = _users(spark, sf).select("conv_id", "turn", "text")
    late = F.pmod("turn", F.lit(4)) == 2
    for wave in (messages.where(~late), messages.where(late)):
        wave.write.mode("append").parquet(scratch + "/in")
        arriving = spark.readStream.schema(messages.schema).parquet(scratch + "/in")
        found = stream_sessions.active_dimensions(arriving, aliases=b.ALIASES)
        found.writeStream.format("parquet").option("path", scratch + "/out").option(
            "checkpointLocation", scratch + "/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(scratch + "/out")


def stream_document_chunks(spark, sf):
    """Pages arriving in two waves: even pages and drafts of the odd ones, then the odd pages."""
    scratch = _scratch(spark)
    pages = b.pages(spark, sf).select("doc_id", "page_number", "text")
    odd = F.pmod("page_number", F.lit(2)) == 1
    waves = (pages.withColumn("text", F.when(odd, F.lit("draft")).otherwise(F.col("text"))), pages.where(odd))
    for wave in waves:
        wave.write.mode("append").parquet(scratch + "/in")
        arriving = stream_ingest.read_pages(spark, scratch + "/in")
        stream_ingest.ingest_stream(arriving, scratch + "/store", scratch + "/state", bucket_rows=2000).awaitTermination()
    stored = stream_ingest.stored_chunks(spark, scratch + "/store").read()
    return stored.select("doc_id", "section_no", "chunk_no", "chunk_id", F.md5("text").alias("digest"))


QUERIES = {f.__name__: f for f in (
    session_carry, intents, history_window, chat_modes, guardrails, token_estimates, rolling_rate, daily_budget,
    stream_rolling_counts, stream_session_state, stream_document_chunks,
)}


# -- SQL ---------------------------------------------------------------------

def _named(x: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches({b.strip_sql(f'lower({x})')}, {b.quote('|'.join(p))}) THEN {b.quote(d)}" for d, p in b.ALIASES.items()
    )
    return f"(CASE {whens} END)"


_CARRY = """last_value(named IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
_INTENTS = " ".join(f"WHEN regexp_matches(t, {b.quote(p)}) THEN '{label}'" for label, p in cv.INTENT_RULES)

from policyloom.workload import retrieval as rq  # noqa: E402
from policyloom.workload.ingestion import CHUNKS_SQL  # noqa: E402

_GUARD_SQL = f"""{b.ROLE_SQL},
asked AS (
  SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'Hello ' || text WHEN 1 THEN text || ' and the weather' ELSE text END AS text
  FROM conversations WHERE role = 'user'),
{rq.sims_sql('corpus', 'asked', 'conv_id, turn', 'q')},
{rq.hybrid_sql('q_sims', 'true', 15, 5, 'h', 'asked', 'conv_id, turn', 'conv_id, turn')},
n AS (SELECT conv_id, turn, count(*) AS k, count(*) FILTER (similarity >= 0.3) AS s FROM h GROUP BY ALL)"""

ORACLE = {
    "session_carry": f"""WITH m AS (SELECT conv_id, turn, {_named('text')} AS named FROM conversations WHERE role = 'user')
SELECT conv_id, turn, named AS named_dimension, {_CARRY} AS active_dimension FROM m""",
    "intents": f"""WITH a AS (
  SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'What is ' || text
         WHEN 1 THEN array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') ELSE text END AS text
  FROM conversations WHERE role = 'user'),
m AS (SELECT *, {_named('text')} AS named, {b.strip_sql('lower(text)')} AS t FROM a),
c AS (SELECT *, {_CARRY} AS active, len({b.tokens_sql(b.strip_sql('text'))}) < 5 AS short FROM m),
d AS (SELECT *, CASE WHEN named IS NULL AND (short OR regexp_matches(t, {b.quote(cv.FOLLOW_UP)})) THEN active ELSE named END AS dim FROM c),
i AS (SELECT *, CASE WHEN regexp_matches(t, {b.quote(cv.INTENT_GREETING)}) THEN 'greeting' {_INTENTS}
      WHEN dim IS NOT NULL THEN 'concept_explanation' ELSE 'general' END AS intent FROM d)
SELECT conv_id, turn, intent, CASE WHEN intent NOT IN ('greeting', 'general') THEN dim END AS dimension FROM i""",
    "history_window": """WITH w AS (
  SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS history_size,
         list('  ' || CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || substr(text, 1, 400))
           OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS h
  FROM conversations)
SELECT conv_id, turn, history_size, md5(coalesce(array_to_string(h, chr(10)), '')) AS digest FROM w""",
    "chat_modes": f"""WITH m AS (
  SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN 'Summarise this document: ' || text ELSE text END AS text,
         CASE conv_id % 4 WHEN 1 THEN 'framework_qa' WHEN 2 THEN 'auditor' ELSE 'advisor' END AS asked FROM conversations WHERE role = 'user'),
a AS (SELECT *, {b.any_sql('lower(text)', b.lx.DOCUMENT_QUESTION_MARKERS)} AS asks FROM m)
SELECT conv_id, turn, CASE WHEN asked <> 'framework_qa' AND turn % 4 = 0 AND turn % 6 <> 2 AND asks THEN 'document_overview' ELSE asked END AS mode,
       asks FROM a""",
    "guardrails": f"""WITH {_GUARD_SQL}
SELECT a.conv_id, a.turn, CASE WHEN regexp_matches({b.strip_sql('text')}, {b.quote(cv.GREETING)}, 'i') THEN 'greeting_detected'
  WHEN regexp_matches(text, {b.quote(cv.OFF_TOPIC)}, 'i') THEN 'off_topic_detected'
  WHEN coalesce(k, 0) = 0 THEN 'no_relevant_documents_found' WHEN s < 2 THEN 'query_not_similar_enough_to_indexed_content' END AS rejected_for
FROM asked a LEFT JOIN n USING (conv_id, turn)""",
    "token_estimates": "SELECT role, sum(length(text) // 4)::BIGINT AS tokens FROM conversations GROUP BY role",
    "rolling_rate": """WITH w AS (
  SELECT event_id, count(*) OVER z AS window_requests, (sum(length(props) * 500) OVER z)::BIGINT AS window_tokens FROM events
  WINDOW z AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '1799999999 microseconds' PRECEDING AND CURRENT ROW))
SELECT *, window_requests > 3 OR window_tokens > 20000 AS over_limit FROM w""",
    "daily_budget": """SELECT event_type, ts::DATE::VARCHAR AS day, count(*) AS requests,
       CASE WHEN count(*) >= 80 THEN 'exhausted' WHEN count(*) / 80.0 >= 0.8 THEN 'warning' ELSE 'ok' END AS budget_state
FROM events GROUP BY ALL""",
    "stream_rolling_counts": """WITH w AS (
  SELECT event_type, time_bucket(INTERVAL '10 seconds', ts) - INTERVAL '10 seconds' * k AS s FROM events, range(0, 6) r(k))
SELECT s AS window_start, s + INTERVAL '60 seconds' AS window_end, event_type, count(*) AS requests FROM w GROUP BY ALL""",
    "stream_session_state": f"""WITH m AS (
  SELECT conv_id, turn, {_named('text')} AS named, turn % 4 = 2 AS late FROM conversations WHERE role = 'user'),
e AS (SELECT *, CASE WHEN NOT late THEN named END AS early FROM m)
SELECT conv_id, turn, named AS named_dimension,
       CASE WHEN late THEN {_CARRY} ELSE {_CARRY.replace('last_value(named', 'last_value(early')} END AS active_dimension FROM e""",
    "stream_document_chunks": f"""WITH {CHUNKS_SQL}
SELECT doc_id, section_no, chunk_no::INT AS chunk_no, substr(sha256(doc_id || '|' || section_no || '|' || chunk_no), 1, 32) AS chunk_id,
       md5(text) AS digest FROM chunks""",
}
