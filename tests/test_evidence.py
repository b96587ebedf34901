import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from policyloom.operators import evaluate as ev
from policyloom.operators import evidence as ed

ITEM = "dimension string, ord int, chunk_id string, text string, source string, is_document boolean, vector array<double>"
T = "This passage is about oversight duties, number "


def items(spark, data):
    return spark.createDataFrame([("d", i + 1, *r) for i, r in enumerate(data)], ITEM)


def test_pair_classes(spark):
    a, near, mid, far = [1.0, 0.0], [0.9, 0.43588989], [0.6, 0.8], [0.1, 0.99498744]
    data = [("a", T + "one", "F", False, a), ("b", T + "one", "G", False, a), ("c", T + "two", "F", False, near),
            ("e", T + "six", "G", True, near), ("f", T + "without", "G", True, near), ("g", T + "five", "G", True, mid), ("h", T + "ten", "H", True, far),
            ("s", "short", "F", False, a)]
    got = {(r.item_a, r.item_b): (r.agreement, r.score) for r in ed.pair_agreement(items(spark, data), ["dimension"]).collect()}
    assert got[("a", "b")] == ("duplicate", 1.0) and got[("a", "c")] == ("duplicate", 0.9)
    assert got[("a", "e")] == ("supporting", 0.9) and got[("a", "f")] == ("conflicting", 0.9)
    assert got[("a", "g")] == ("independent", 0.6) and got[("a", "h")] == ("weak", 0.1)
    assert not any("s" in pair for pair in got)


def test_pairs_without_vectors(spark):
    data = [("a", "alpha beta gamma delta epsilon zeta eta", "F", False, []), ("b", "alpha beta gamma delta epsilon zeta theta", "G", False, [])]
    got = ed.pair_agreement(items(spark, data).drop("vector"), ["dimension"], vector=None).collect()
    assert got[0].agreement == "supporting" and got[0].score == 0.75


def test_agreement_score(spark):
    pairs = spark.createDataFrame([("d", "supporting", 0.8), ("d", "conflicting", 0.8), ("d", "duplicate", 1.0)], "dimension string, agreement string, score double")
    assert ed.agreement_score(pairs, ["dimension"]).collect()[0].agreement == round((0.5 / 3 + 1) / 2, 3)


def greedy(vectors, texts, scores, threshold):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    keep, text, score = [True] * len(texts), list(texts), list(scores)
    for i in range(len(texts)):
        if not keep[i]:
            continue
        for j in range(i + 1, len(texts)):
            if keep[j] and unit[i] @ unit[j] >= threshold:
                text[i] = text[i] if len(text[i]) >= len(texts[j]) else texts[j]
                score[i] = max(score[i], scores[j])
                keep[j] = False
    return [(i + 1, text[i], score[i]) for i in range(len(texts)) if keep[i]]


def test_near_duplicates_match_sequential_merge(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(14, 3))
    texts = ["t" * int(n) + str(i) for i, n in enumerate(rng.integers(1, 9, 14))]
    scores = [float(x) for x in rng.random(14).round(3)]
    df = spark.createDataFrame([("d", i + 1, f"c{i}", texts[i], scores[i], vectors[i].tolist()) for i in range(14)],
                               "dimension string, ord int, chunk_id string, text string, similarity double, vector array<double>")
    got = ed.merge_near_duplicates(df, ["dimension"], 0.8)
    assert rows(got, "ord", "text", "similarity") == sorted(greedy(vectors, texts, scores, 0.8), key=repr)
    assert got.agg(F.sum("merged")).collect()[0][0] == 14


def test_aspects_and_quality(spark):
    aspects = spark.createDataFrame([("d", 0, "A", [1.0, 0.0]), ("d", 1, "B", [0.0, 1.0])], "dimension string, aspect_no int, aspect string, vector array<double>")
    data = [("a", T, "F", True, [0.9, 0.1]), ("b", T, "G", False, [0.0, 2.0]), ("c", T, "G", False, [-1.0, -1.0])]
    placed = ed.best_aspect(items(spark, data), aspects)
    got = {r.chunk_id: (r.aspect, r.relevance) for r in placed.collect()}
    assert got["a"][0] == "A" and got["b"] == ("B", 1.0) and got["c"] == ("A", 0.0)
    joined = ed.best_aspect(items(spark, data), aspects, most_aspects=1)
    assert rows(joined, "chunk_id", "aspect", "relevance") == rows(placed, "chunk_id", "aspect", "relevance")
    ready = placed.withColumn("verified", F.lit(False)).withColumn("score", F.lit(0.5))
    groups = ed.group_quality(ready, ["dimension"])
    quality = dict(rows(groups, "aspect", "coverage_quality"))
    relevance = got["a"][1]
    assert quality["A"] == pytest.approx(relevance * 0.4 + 0.2 + 2 * len(T) / 5000 * 0.3, abs=1e-3)
    totals = spark.createDataFrame([("d", 4, 2)], "dimension string, before long, sources long")
    whole = ed.graph_quality(ready, groups, aspects, totals, ["dimension"]).collect()[0]
    assert whole.redundancy_ratio == 0.25 and whole.missing_aspects == "" and whole.source_diversity == 0.4


def test_requirement_matching(spark):
    held = spark.createDataFrame([("d", 1, "strong", "t1", [1.0, 0.0]), ("d", 2, "policy", "t1", [1.0, 0.0]), ("d", 3, "implicit", "t2", [0.0, 1.0])],
                                 "dimension string, ord int, kind string, text string, vector array<double>")
    unique = ed.matched_evidence(held, ["dimension"])
    assert rows(unique, "text", "is_explicit", "is_implicit") == [("t1", True, False), ("t2", False, True)]
    req = spark.createDataFrame([("d", "F", "r1", [1.0, 0.0]), ("d", "G", "r2", [-1.0, 0.0])], "dimension string, framework string, requirement string, vector array<double>")
    got = {r.requirement: r for r in ed.match_requirements(req, unique, ["dimension"], F.lit("Explicitly Addressed")).collect()}
    assert got["r1"].match_score == pytest.approx(0.35 + 0.25 + 0.25 * 0.15 + 0.09) and got["r1"].match_class == "implemented"
    assert got["r2"].match_class == "missing"


def test_items_and_context(spark):
    doc = spark.createDataFrame([(1, "a", T, 1), (1, "b", "short", 2)], "w int, chunk_id string, text string, rank int")
    fw = spark.createDataFrame([(1, "a", T, 1), (1, "c", T, 2)], "w int, chunk_id string, text string, rank int")
    assert rows(ed.evidence_items(doc, fw, ["w"]), "ord", "chunk_id", "is_document") == [(1, "a", True), (2, "c", False)]
    hits = spark.createDataFrame([(1, "F", i, f"c{i}", "x" * 700) for i in range(5)], "w int, framework string, rank int, chunk_id string, text string")
    assert ed.framework_context(hits, ["w"]).select(F.length("context")).collect()[0][0] == 1802


def ranked(spark, ids):
    return spark.createDataFrame([("q", i + 1, c) for i, c in enumerate(ids)], "q string, rank int, chunk_id string")


def test_ranking_metrics(spark):
    qrels = spark.createDataFrame([("q", "a", 3.0), ("q", "c", 2.0), ("q", "z", 1.0)], "q string, chunk_id string, gain double")
    m = ev.ranking_metrics(ranked(spark, "abcd"), qrels, ["q"]).collect()[0]
    assert (m.precision_at_1, m.precision_at_3, m.precision_at_10, m.recall_at_3, m.mrr) == (1.0, 0.666667, 0.5, 0.666667, 1.0)
    ideal = 3 + 2 / np.log2(2) + 1 / np.log2(3)
    assert m.ndcg_at_5 == pytest.approx((3 + 2 / np.log2(3)) / ideal, abs=1e-6)
    none = ev.ranking_metrics(ranked(spark, "xy"), qrels, ["q"]).collect()[0]
    assert none.mrr == 0.0 and none.ndcg_at_5 == 0.0 and none.precision_at_1 == 0.0


def stability(spark, *runs):
    data = [("q", r, i + 1, c, 1.0 / (i + 1)) for r, ids in enumerate(runs) for i, c in enumerate(ids)]
    df = spark.createDataFrame(data, "q string, run int, rank int, chunk_id string, score double")
    return ev.run_stability(df, ["q"]).collect()[0]


def test_stability(spark):
    same = stability(spark, "abc", "abc", "abc")
    assert (same.jaccard_similarity, same.kendall_tau, same.is_stable, same.num_retrievals) == (1.0, 1.0, True, 3)
    assert stability(spark, "abc", "cba").kendall_tau == -1.0
    apart = stability(spark, "ab", "cd")
    assert (apart.jaccard_similarity, apart.kendall_tau, apart.is_stable) == (0.0, 0.0, False)
    assert stability(spark, "ab", "bc").jaccard_similarity == 0.3333
    alone = stability(spark, "ab")
    assert alone.is_stable and alone.num_retrievals == 1


def test_empty_sets_agree(spark):
    df = spark.createDataFrame([([], []), (["a"], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(ev.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]


def test_config_averages(spark):
    asked = spark.createDataFrame([("q",)], "q string")
    good = lambda _: ranked(spark, "abc")
    bad = lambda _: ranked(spark, "xya")
    qrels = spark.createDataFrame([("q", "a", 2.0)], "q string, chunk_id string, gain double")
    _, means = ev.compare_configs(asked, {"good": good, "bad": bad}, qrels, ["q"])
    assert dict(rows(means, "config", "mrr")) == {"good": 1.0, "bad": 0.3333}
    _, defaults = ev.compare_configs(asked, {"good": good}, None, ["q"])
    assert rows(defaults, "precision_at_3") == [(1.0,)]
    assert ev.repeated_runs(asked, good, 3).select("run").distinct().count() == 3


def test_error_rates(spark):
    df = spark.createDataFrame([("a", 1, 3, 10, 4), ("b", 0, 0, 10, 4)], "k string, false_positives int, false_negatives int, total_retrieved int, relevant int")
    assert rows(ev.error_rates(df, ["k"])) == [("a", 0.25, 0.75), ("b", 0.0, 0.0)]


def test_groups_without_pairs_agree(spark):
    pairs = spark.createDataFrame([("a", "supporting", 0.8)], "dimension string, agreement string, score double")
    asked = spark.createDataFrame([("a",), ("b",)], "dimension string")
    assert rows(ed.agreement_score(pairs, ["dimension"], asked)) == [("a", 0.9, 1), ("b", 1.0, 0)]


def test_a_query_without_hits_has_zeros(spark):
    ranked = spark.createDataFrame([("q1", 1, "x")], "q string, rank int, chunk_id string")
    qrels = spark.createDataFrame([("q1", "x", 2.0), ("q2", "y", 1.0)], "q string, chunk_id string, gain double")
    queries = spark.createDataFrame([("q1",), ("q3",)], "q string")
    got = {r.q: r for r in ev.ranking_metrics(ranked, qrels, ["q"], queries).collect()}
    assert got["q1"].mrr == 1.0 and got["q1"].ndcg_at_5 == 1.0
    for q in ("q2", "q3"):
        assert set(tuple(got[q])[1:]) == {0.0}
