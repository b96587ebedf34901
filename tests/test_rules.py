import pytest
from conftest import rows
from pyspark.sql import functions as F

from policyloom import lexicons as lx
from policyloom.operators import analytics, consistency, rules

KEYS = ["workspace_id", "dimension"]


def verdict(spark, data):
    return spark.createDataFrame(data, "workspace_id int, dimension string, coverage string, principle_acknowledged boolean, mechanisms array<string>")


def chunk(spark, data):
    return spark.createDataFrame(data, "workspace_id int, dimension string, chunk_id string, text string")


CASES = [
    ("Missing", [], ["Risks to privacy are acknowledged."], "Missing", 0),
    ("Missing", [], ["The government plans to protect privacy."], "Partial", 1),
    ("Missing", [], ["It will not support privacy."], "Missing", 0),
    ("Missing", ["A privacy commission"], ["Any text."], "Covered", 2),
    ("Partial", [], ["A privacy board will establish rules."], "Covered", 1),
    ("Partial", [], ["A privacy programming course."], "Partial", 0),
    ("Partial", [], ["A budget for privacy.", "A mandate on consent."], "Covered", 1),
    ("Partial", [], ["A budget for privacy."], "Partial", 0),
    ("Partial", [], ["The board will launch a calendar."], "Partial", 0),
    ("Missing", ["A commission"], [], "Missing", 0),
    ("Covered", [], ["Nothing."], "Covered", 0),
]


def test_ladder(spark):
    verdicts = verdict(spark, [(i, "Privacy", c, True, m) for i, (c, m, *_ ) in enumerate(CASES)])
    passages = chunk(spark, [(i, "Privacy", f"{i}-{j}", t) for i, case in enumerate(CASES) for j, t in enumerate(case[2])])
    done = rules.validate_coverage(verdicts, rules.commitment_evidence(passages))
    got = [(r.coverage, len(r.rule_notes)) for r in done.orderBy("workspace_id").collect()]
    assert got == [(c[3], c[4]) for c in CASES]
    off = rules.validate_coverage(verdicts, rules.commitment_evidence(passages), floor_enabled=False)
    assert [r.coverage for r in off.orderBy("workspace_id").collect()][1] == "Missing"


@pytest.mark.parametrize("coverage, acknowledged, mechanisms, stage", [
    ("Missing", False, [], "Ad Hoc"), ("Missing", True, [], "Developing"), ("Partial", True, [], "Developing"),
    ("Partial", True, ["a board"], "Defined"), ("Covered", True, [], "Defined"), ("Covered", True, ["annual report"], "Managed"),
    ("Covered", True, ["a board", "redress"], "Optimized"), ("Covered", True, [" ", None], "Defined"),
])
def test_maturity(spark, coverage, acknowledged, mechanisms, stage):
    done = rules.with_maturity(verdict(spark, [(1, "Privacy", coverage, acknowledged, mechanisms)]))
    assert done.collect()[0].governance_maturity == stage


def test_risk_and_priority(spark):
    data = [(1, "Privacy", "Partial"), (1, "Safety", "Partial"), (2, "Privacy", "Missing"), (2, "Safety", "Covered"),
            (3, "Fairness", "Partial"), (3, "Inclusivity", "Covered"), (4, "Fairness", "Missing"), (4, "Inclusivity", "Insufficient Evidence"),
            (5, "Other", "Partial")]
    df = spark.createDataFrame(data, "workspace_id int, dimension string, coverage string")
    got = {(r.workspace_id, r.dimension): (r.risk_level, r.priority) for r in rules.with_risk_and_priority(df).collect()}
    assert got[(1, "Privacy")] == ("High", "High") and got[(2, "Privacy")] == ("High", "High")
    assert got[(2, "Safety")] == ("Low", None) and got[(3, "Fairness")] == ("Low", "Medium")
    assert got[(4, "Fairness")] == ("High", "Critical") and got[(4, "Inclusivity")] == ("Insufficient Evidence", None)
    assert got[(5, "Other")] == ("Low", "Medium")


def test_confidence(spark):
    ev = spark.createDataFrame(
        [(1, "P", "a", "F1", 0.8, True), (1, "P", "b", "F2", None, False), (1, "P", "c", "", 0.6, True)],
        "workspace_id int, dimension string, chunk_id string, source string, similarity double, verified boolean")
    ver = spark.createDataFrame([(1, "P", "Covered"), (2, "P", "Covered")], "workspace_id int, dimension string, coverage string")
    got = {r.workspace_id: r for r in rules.confidence(ev, ver).collect()}
    assert (got[1].quality, got[1].diversity, got[1].citation, got[1].cross_source) == (0.7, 0.8, 0.667, 0.667)
    product = 0.7 * 0.8 * 0.5 * 0.5 * 0.667 * 0.667 * 0.8
    assert got[1].confidence_score == pytest.approx(product ** (1 / 7), abs=1e-4)
    assert got[2].confidence_score == 0.0 and got[2].confidence_method == "No evidence: confidence=0"


@pytest.mark.parametrize("coverage, mechanisms, stage, grounding, steps, expected", [
    ("Missing", 0, "Ad Hoc", "none_identified", [6, 6], ["0-21 months", "21-39 months"]),
    ("Partial", 2, "Managed", "document_named", [1, 1], ["0-3 months", "3-6 months"]),
    ("Missing", 0, "Defined", "document_implied", [4], ["0-11 months"]),
    ("Partial", 0, "Defined", "", [], []),
])
def test_timelines(spark, coverage, mechanisms, stage, grounding, steps, expected):
    df = spark.createDataFrame([(coverage, mechanisms, stage, grounding, steps)], "c string, n int, m string, g string, s array<int>")
    bounds = rules.phase_bounds(*[F.col(x) for x in ("c", "n", "m", "g", "s")])
    got = df.select(F.transform(bounds, rules.timeline_text)).collect()[0][0]
    assert got == expected


def test_drift_and_shape(spark):
    df = spark.createDataFrame(
        [(1, "a", "Covered", "The policy should establish a body.", ["r"], ["o1", "o2", "o3", "o4"]),
         (2, "a", "Covered", "It lacks nothing.", ["r"], ["o"]), (3, "a", "Partial", "should establish", ["r"], [])],
        "workspace_id int, dimension string, coverage string, synthesis string, recommendations array<string>, opportunities array<string>")
    got = rules.shape_by_tier(rules.downgrade_drift(df)).orderBy("workspace_id").collect()
    assert [(g.coverage, g.drift_score, g.synthesis_drift_downgraded) for g in got] == [("Partial", 4, True), ("Covered", 1, False), ("Partial", 0, False)]
    assert got[0].recommendations == ["r"] and got[1].recommendations == [] and got[1].best_practices.future_strengthening_opportunities == ["o"]


def test_covered_synthesis_never_drifts(spark):
    df = spark.createDataFrame([("Privacy", ["F1", "F2"], "", ["m1", "m2"])], "d string, f array<string>, e string, m array<string>")
    s = df.select(rules.covered_synthesis(*[F.col(c) for c in "dfem"]).alias("s"))
    row = s.select("s.*", rules.drift_score(F.col("s.overall_assessment")).alias("score")).collect()[0]
    assert "m1; m2" in row.overall_assessment and "F1, F2" in row.consensus and row.score == 0


def test_plausibility(spark):
    columns = ("level int, coverage string, strength string, document_type string, n_explicit int, n_implicit int, n_strong int, "
               "n_weak int, n_groups int, demonstrated string")
    data = [
        (0, "Missing", "Weakly Demonstrated", "strategy", 1, 0, 0, 1, 0, "None"),
        (3, "Partial", "Explicitly Addressed", "other", 1, 0, 0, 0, 0, "None"),
        (5, "Covered", "Explicitly Addressed", "other", 1, 0, 1, 0, 0, "None"),
        (1, "Partial", "Implicitly Addressed", "strategy", 0, 1, 0, 0, 3, "None"),
        (0, "Missing", "Not Demonstrated", "other", 0, 0, 0, 0, 0, "shown"),
        (0, "Missing", "Not Demonstrated", "other", 0, 0, 0, 0, 0, "None"),
    ]
    got = [(r.validated_level, r.validated_coverage, r.checks_fired, r.confidence_in_assessment)
           for r in rules.plausibility(spark.createDataFrame(data, columns)).collect()]
    assert got[0] == (1, "Partial", ["doc_type"], "Medium")
    assert got[1][:3] == (3, "Covered", ["ladder"]) and got[2][:3] == (4, "Covered", ["level5"])
    assert got[3][:3] == (2, "Partial", ["distributed"]) and got[4][:3] == (1, "Partial", ["missing_final"])
    assert got[5] == (0, "Missing", [], "Low")


def gap_rows(spark):
    data = [
        (1, "Transparency", 0, "Covered", "Managed", None, 0.9, None, False), (1, "Accountability", 1, "Partial", "Defined", "High", 0.6, None, False),
        (1, "Privacy", 2, "Missing", "Defined", "Critical", 0.5, None, True), (1, "Safety", 3, "Insufficient Evidence", None, None, 0.0, None, False),
        (1, "Fairness", 4, "Insufficient Evidence", None, None, 0.0, "quota", False)]
    return spark.createDataFrame(
        data, "workspace_id int, dimension string, ord int, coverage string, governance_maturity string, priority string, "
        "confidence_score double, analysis_error string, synthesis_drift_downgraded boolean")


def test_decision_analytics(spark):
    r = analytics.decision_analytics(gap_rows(spark)).collect()[0]
    assert (r.covered, r.partial, r.missing, r.insufficient_evidence, r.analysis_failed) == (1, 1, 1, 1, 1)
    assert r.overall_governance_maturity == "Defined" and r.maturity_index == round(100 * 7 / 12, 1)
    assert r.highest_priority_dimensions == "Privacy, Accountability" and r.strongest_dimension == "Transparency"
    assert r.average_confidence == 0.667 and r.synthesis_drift_downgraded == "Privacy"
    empty = analytics.decision_analytics(gap_rows(spark).filter("coverage = 'Insufficient Evidence'")).collect()[0]
    assert empty.overall_governance_maturity == "Not Assessed" and empty.maturity_index == 0.0 and empty.strongest_dimension == ""


def test_weakest_and_radar(spark):
    assert rows(analytics.weakest_tier(gap_rows(spark))) == [(1, "Privacy")]
    r = analytics.radar(gap_rows(spark)).collect()[0]
    assert (r.not_assessed, r.transparency, r.accountability, r.privacy, r.safety) == (2, 100, 66, 33, 0)


def check_rows(spark, data):
    cols = ("workspace_id int, dimension string, ord int, coverage string, risk_level string, synthesis string, n_evidence int, "
            "n_named_evidence int, n_positions int, doc_chunks int, recommendation string")
    return spark.createDataFrame([(1, d, i, c, r, "", 1, 1, 0, 1, "do") for i, (d, c, r) in enumerate(data)], cols)


def found(spark, data):
    edges, subsets = consistency.edge_table(spark), consistency.subset_table(spark)
    return rows(consistency.violations(check_rows(spark, data), edges, subsets), "dimension", "violation_type", "related")


def test_graph_and_subset_violations(spark):
    got = found(spark, [("Transparency", "Partial", "Low"), ("Explainability", "Covered", "Low")])
    assert got == [("Transparency", "subset_inconsistency", "Explainability")]
    got = found(spark, [("Explainability", "Covered", "Low"), ("Transparency", "Partial", "Low")])
    assert ("Explainability", "graph_child_covered_but_parent_missing", "Transparency") in got and len(got) == 2
    got = found(spark, [("Accountability", "Covered", "Low"), ("Liability", "Missing", "High")])
    assert got == [("Accountability", "graph_child_not_covered", "Liability"), ("Accountability", "missing_sub_elements", "Liability")]
    assert found(spark, [("Transparency", "Covered", "Low"), ("Accountability", "Covered", "Low")]) == []


def test_core_partial_raised_to_high_is_reported(spark):
    got = found(spark, [("Privacy", "Partial", "High"), ("Safety", "Missing", "Low")])
    assert [g[1] for g in got] == ["risk_coverage_mismatch"] * 2


def test_penalty_stops_at_one_half(spark):
    df = spark.createDataFrame([(0.9, 0), (0.9, 1), (0.9, 3), (0.9, 9), (0.4, 2)], "s double, e long")
    got = [r[0] for r in df.select(consistency.penalized(F.col("s"), F.col("e"))).collect()]
    assert got == [0.9, 0.72, 0.461, 0.461, 0.4]


def test_report(spark):
    ws = spark.createDataFrame([(1,), (2,)], "workspace_id int")
    f = spark.createDataFrame([(1, "d", "x", "error", "")] * 8, "workspace_id int, dimension string, violation_type string, severity string, related string")
    assert rows(consistency.report(ws, f), "workspace_id", "violation_count", "consistency_score") == [(1, 8, 0.0), (2, 0, 1.0)]


def test_closure_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "parent string, child string")
    got = set(rows(consistency.closure(edges)))
    assert ("a", "d") in got and ("x", "x") in got and ("d", "a") not in got and len(got) == 6 + 4
    default = set(rows(consistency.closure(consistency.edge_table(spark))))
    assert ("Governance", "Auditability") in default and ("Ethics", "Equity") in default


def test_placeholders_and_resume(spark):
    want = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "workspace_id int, dimension string")
    have = spark.createDataFrame([(1, "a", "Covered", None, "r"), (1, "b", "Insufficient Evidence", "quota", "r")],
                                 "workspace_id int, dimension string, coverage string, analysis_error string, reason_flagged string")
    got = dict(rows(rules.complete_dimensions(want, have), "dimension", "reason_flagged"))
    assert got["b"] == "Analysis failed: quota" and got["c"].startswith("Insufficient evidence") and got["a"] == "r"
    runs = spark.createDataFrame([(1, "a", "completed"), (1, "b", "failed")], "workspace_id int, dimension string, status string")
    assert rows(rules.unfinished(want, runs), "dimension") == [("b",), ("c",)]


def test_positions(spark):
    pos = spark.createDataFrame([(1, "d", 1, "c1", "F", "p1", "s"), (1, "d", 2, "c1", "F", "p2", ""), (1, "d", 3, "zz", "G", "p3", ""), (1, "d", 4, "c2", "H", "p4", "")],
                                "workspace_id int, dimension string, position_no int, chunk_id string, framework string, position string, supporting string")
    ev = spark.createDataFrame([(1, "d", "c1"), (1, "d", "c2")], "workspace_id int, dimension string, chunk_id string")
    assert rules.framework_synthesis(pos, ev).collect()[0].synthesis == 'F: p1 ("s") | H: p4'


def test_scope(spark):
    df = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (3, "")], "workspace_id int, document_name string")
    got = dict(rows(rules.scope_disclaimer(df), "workspace_id", "disclaimer"))
    assert "the provided documents (A, B)." in got[1] and "the provided document (A)." in got[2] and "provided to the system." in got[3]


def test_summaries(spark):
    gaps = gap_rows(spark).withColumn("risk_level", F.when(F.col("coverage") == "Insufficient Evidence", "Insufficient Evidence").otherwise("High"))
    text = analytics.summaries(gaps).collect()[0].summary
    assert text.startswith("Analysis of 5 governance dimensions: 1 Fully Covered, 1 Partially Covered, 1 Missing. Risk levels: 3 high-risk")
    assert "1 dimension(s) could not be analysed (Fairness): quota." in text and text.endswith("Partial: Accountability.")


def test_end_to_end_judgement(spark):
    from policyloom.plans import analysis

    dims = list(lx.DIMENSIONS)
    verdicts = spark.createDataFrame(
        [(1, d, i, ["Missing", "Partial", "Covered"][i % 3], True, ["a board"] if i % 2 else [], ["do this"], ["later"], "fine", None)
         for i, d in enumerate(dims)],
        "workspace_id int, dimension string, ord int, coverage string, principle_acknowledged boolean, mechanisms array<string>, "
        "recommendations array<string>, opportunities array<string>, synthesis string, analysis_error string")
    passages = chunk(spark, [(1, d, f"c{i}", f"{d} text will establish a board.") for i, d in enumerate(dims)])
    ev = spark.createDataFrame([(1, d, "c", "F", 0.7, True) for d in dims],
                               "workspace_id int, dimension string, chunk_id string, source string, similarity double, verified boolean")
    judged = analysis.judge(spark, verdicts, passages, ev)
    assert judged.gaps.count() == 8 and judged.analytics.count() == 1
    assert judged.gaps.filter("confidence_score > 0").count() == 8
