import numpy as np
import pyarrow as pa
from conftest import rows
from pyspark.sql import functions as F

from policyloom.operators import conversations as cv
from policyloom.operators import nearest as nn
from policyloom.operators import usage
from policyloom.sources import vectors


def log(spark, texts, session=1):
    return spark.createDataFrame([(session, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)],
                                 "conv_id int, turn int, role string, text string")


def test_state_and_intent(spark):
    texts = ["What is transparency?", "why is this", "And privacy rules in general please tell me more now", "ok then", "Hello there",
             "How should we improve it", "compare bias and equity measures across many systems", "a long message about nothing in particular at all"]
    done = cv.classify_messages(cv.session_state(log(spark, texts)))
    got = [(r.intent, r.dimension) for r in done.orderBy("turn").collect()]
    assert got[0] == ("concept_explanation", "Transparency") and got[1] == ("analysis_explanation", "Transparency")
    assert got[2][1] == "Privacy" and got[3] == ("concept_explanation", "Privacy") and got[4] == ("greeting", None)
    assert got[5] == ("recommendation_explanation", None) or got[5][0] == "recommendation_explanation"
    assert got[6] == ("educational", "Inclusivity") and got[7] == ("general", None)


def test_carry_in_blocks_equals_window(spark):
    df = spark.range(400).select((F.col("id") % 2).alias("s"), F.col("id").alias("t"),
                                 F.when(F.col("id") % 37 == 0, F.concat(F.lit("v"), F.col("id"))).alias("v"))
    whole = cv.carry_forward(df, ["s"], "t", "v", "c")
    cut = cv.carry_forward(df, ["s"], "t", "v", "c", block=16)
    assert rows(whole, "t", "c") == rows(cut, "t", "c")


def test_history_over_block_borders(spark):
    texts = [f"m{i}" for i in range(30)]
    small = cv.history(log(spark, texts), block=4)
    large = cv.history(log(spark, texts))
    assert rows(small, "turn", "history_size", "history_text") == rows(large, "turn", "history_size", "history_text")
    last = large.filter("turn = 29").collect()[0]
    assert last.history_size == 6 and last.history_text.splitlines()[0] == "  Assistant: m25"
    assert large.filter("turn = 0").collect()[0].history_text == ""


def test_modes(spark):
    df = spark.createDataFrame(
        [("summarise the policy", "auditor", True, False), ("summarise the policy", "framework_qa", True, False), ("what is bias", "auditor", True, False),
         ("summarise the policy", "weird", False, False), ("the document says", "advisor", True, True), ("x", "document_overview", False, False)],
        "m string, r string, w boolean, f boolean")
    got = [r[0] for r in df.select(cv.chat_mode(*[F.col(c) for c in "mrwf"])).collect()]
    assert got == ["document_overview", "framework_qa", "auditor", "advisor", "advisor", "document_overview"]


def test_guardrails(spark):
    messages = spark.createDataFrame([(1, "Hello!"), (2, "tell me a joke"), (3, "privacy rules"), (4, "privacy law"), (5, "oversight")], "k int, text string")
    hits = spark.createDataFrame([(4, 0.5), (4, 0.2), (5, 0.5), (5, 0.3)], "k int, similarity double")
    got = dict(rows(cv.check_messages(messages, hits, ["k"]), "k", "rejected_for"))
    assert got == {1: "greeting_detected", 2: "off_topic_detected", 3: "no_relevant_documents_found",
                   4: "query_not_similar_enough_to_indexed_content", 5: None}
    loose = messages.select(cv.guardrail(F.col("text"), strict=False)).collect()
    assert [r[0] for r in loose] == ["greeting_detected", None, None, None, None]


def test_rolling_usage_in_blocks_equals_brute_force(spark):
    stamps = [i * 17 % 4000 for i in range(300)]
    df = spark.createDataFrame([(i, "hot" if i % 3 else "cold", s) for i, s in enumerate(stamps)], "id int, k string, s int")
    timed = df.withColumn("ts", F.timestamp_seconds("s"))
    got = rows(usage.rolling_usage(timed, ["k"], tokens=F.lit(2), block_seconds=100), "id", "window_requests", "window_tokens")
    key = ["hot" if i % 3 else "cold" for i in range(300)]
    want = []
    for i, s in enumerate(stamps):
        n = sum(1 for j, t in enumerate(stamps) if key[j] == key[i] and s - 60 < t <= s)
        want.append((i, n, 2 * n))
    assert got == sorted(want, key=repr)


def test_rolling_usage_with_windows_longer_than_blocks(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "k", 1800 * (i // 2)) for i in range(40)], "id int, k string, s int")
    timed = df.withColumn("ts", F.timestamp_seconds("s"))
    got = rows(usage.rolling_usage(timed, ["k"], seconds=4 * 3600), "id", "window_requests")
    assert got == sorted(((i, min(8, i // 2 + 1)) for i in range(40)), key=repr)
    assert usage.rolling_usage(timed, []).count() == 40


def test_daily_budget(spark):
    df = spark.createDataFrame([("2024-01-01",)] * 10 + [("2024-01-02",)] * 8 + [("2024-01-03",)], "ts string")
    got = [r.budget_state for r in usage.daily_budget(df, limit=10).orderBy("day").collect()]
    assert got == ["exhausted", "warning", "ok"]


def test_guardrail_searches_only_what_two_chunks_do_not_settle(spark, tmp_path):
    texts = [(k, f"word{k % 5} and rules of {k}") for k in range(30)] + [(30, None), (31, "alone"), (32, "")]
    vectors.create_store(spark.createDataFrame(texts, "chunk_id long, text string"), str(tmp_path / "s"))
    store = vectors.read_store(spark, str(tmp_path / "s"))
    asked = [(0, "rules and word3"), (1, "rules and word3"), (2, "alone"), (3, ""), (4, None), (5, "hello rules"), (6, "zebra")]
    messages = spark.createDataFrame(asked, "id long, text string")
    hits = nn.retrieve(store, cv.to_be_searched(messages).select("id", "text"), 5, query_keys=["id"])
    searched = cv.check_messages(messages, hits.select("id", "similarity"), ["id"])
    assert rows(cv.guarded(messages, store), "id", "rejected_for") == rows(searched, "id", "rejected_for")
    settled = messages.withColumn("settled", cv.similar_enough(F.col("text"), store)).where("settled")
    assert rows(settled, "id") == [(0,), (1,), (5,)]


def test_scores_are_held_in_tiles(monkeypatch):
    rng, sizes = np.random.default_rng(1), []
    similar = nn.similarities
    monkeypatch.setattr(nn, "similarities", lambda a, b: sizes.append(len(a) * len(b)) or similar(a, b))
    points = rng.normal(size=(3000, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(points.tolist())], names=["chunk_id", "v"])
    asked = nn.arrow_rows(pa.array(rng.normal(size=(5000, 4)).tolist()), slice(0, 5000))
    out = pa.Table.from_batches(nn._score([batch], asked, pa.table({"q": range(5000)}), 3, "v", "chunk_id", None, ["chunk_id"], None))
    assert max(sizes) <= nn.TILE_SCORES and len(out) == 15000
    plain = similar(points / np.linalg.norm(points, axis=1, keepdims=True), asked)
    best = np.lexsort((np.broadcast_to(np.arange(3000)[:, None], plain.shape), -plain), axis=0)[:3]
    got = out.to_pandas().groupby("q")["chunk_id"].agg(list)
    assert all(got[q] == best[:, q].tolist() for q in range(0, 5000, 97))
