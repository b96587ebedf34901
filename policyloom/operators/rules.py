"""Deterministic verdict rules: coverage ladder, maturity, risk, priority, confidence, timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policyloom import lexicons as lx
from policyloom.functions import text as tx
from policyloom.functions.numbers import settled

KEYS = ("workspace_id", "dimension")

# --- fixed values: rule notes and texts -------------------------------------
R1_NOTE = "R1 explicit-commitment floor: Missing was raised to Partial."
R2_NOTE = "R2 implementation-commitment raise: Partial was raised to Covered."
BEST_PRACTICES_OPENING = (
    "This policy already aligns strongly with international governance expectations. The following "
    "international practices may further strengthen future revisions, but no critical governance gaps "
    "were identified."
)
COMPLETENESS = {"Covered": 0.8, "Partial": 0.5, "Missing": 0.3, "Insufficient Evidence": 0.1}
FACTOR_FLOOR = 0.001


def normalize_coverage(label: Column) -> Column:
    named = F.initcap(tx.strip(F.coalesce(label, F.lit("Partial"))))
    return F.when(named.isin("Covered", "Partial", "Missing"), named).otherwise("Partial")


def normalize_labels(verdicts: DataFrame) -> DataFrame:
    """Raw coverage labels as one of the three tiers: blanks and case do not count, anything else is Partial."""
    return verdicts.withColumn("coverage", normalize_coverage(F.col("coverage")))


# -- commitment evidence and the ladder --------------------------------------

def commitment_flags(chunks: DataFrame, lexicon: lx.Lexicon = lx.DEFAULT) -> DataFrame:
    """Per chunk of ``(keys, chunk_id, text)``: topical, strong, verb, weak, body."""
    lowered = F.lower(F.coalesce("text", F.lit("")))
    return (
        chunks.withColumn("topical", tx.on_topic(F.col("text"), F.col("dimension"), lexicon.topics))
        .withColumn("strong", tx.has_commitment(lowered, lexicon.strong, lexicon.negators))
        .withColumn("verb", tx.has_commitment(lowered, lexicon.verbs, lexicon.negators))
        .withColumn("weak", tx.has_commitment(lowered, lexicon.weak, lexicon.negators))
        .withColumn("body", tx.has_keyword(F.col("text"), lexicon.named_body))
    )


def commitment_evidence(chunks: DataFrame, lexicon: lx.Lexicon = lx.DEFAULT,
                        keys: Sequence[str] = KEYS) -> DataFrame:
    """Explicit and implementation commitment per key, from its document chunks."""
    topical = F.col("topical")
    return commitment_flags(chunks, lexicon).groupBy(*keys).agg(
        F.count("*").alias("doc_chunks"),
        F.max(topical & (F.col("strong") | F.col("verb"))).alias("explicit_in_text"),
        (
            F.max(topical & F.col("body") & (F.col("strong") | F.col("weak")))
            | (F.count_if(topical & F.col("weak")) >= 2)
        ).alias("implementation_in_text"),
    )


def validate_coverage(verdicts: DataFrame, evidence: DataFrame, lexicon: lx.Lexicon = lx.DEFAULT,
                      floor_enabled: bool = True, keys: Sequence[str] = KEYS) -> DataFrame:
    """Two rungs, both needing document evidence: Missing to Partial, then Partial to Covered."""
    operational = tx.mechanism_flags(F.col("mechanisms"), lexicon)["has_operational"]
    joined = verdicts.join(evidence, list(keys), "left").withColumn("_operational", operational)
    has_evidence = F.coalesce("doc_chunks", F.lit(0)) > 0
    explicit = F.col("_operational") | F.coalesce("explicit_in_text", F.lit(False))
    implementation = F.col("_operational") | F.coalesce("implementation_in_text", F.lit(False))
    raised = F.lit(floor_enabled) & (F.col("coverage") == "Missing") & has_evidence & explicit
    after_first = F.when(raised, "Partial").otherwise(F.col("coverage"))
    lifted = (after_first == "Partial") & has_evidence & implementation
    return (
        joined.withColumn("_raised", raised).withColumn("_lifted", lifted)
        .withColumn("rule_notes", F.array_compact(F.array(
            F.when(F.col("_raised"), R1_NOTE), F.when(F.col("_lifted"), R2_NOTE))))
        .withColumn("raw_coverage", F.col("coverage"))
        .withColumn("coverage", F.when(F.col("_lifted"), "Covered").when(F.col("_raised"), "Partial")
                    .otherwise(F.col("coverage")))
        .drop("_operational", "_raised", "_lifted", *[c for c in evidence.columns if c not in keys])
    )


def maturity(coverage: Column, acknowledged: Column, flags: dict[str, Column]) -> Column:
    operational, enforcement = flags["has_operational"], flags["has_enforcement"]
    return (
        F.when((coverage == "Missing") & ~acknowledged, "Ad Hoc")
        .when(coverage == "Missing", "Developing")
        .when((coverage == "Partial") & operational, "Defined")
        .when(coverage == "Partial", "Developing")
        .when(~operational, "Defined")
        .when(enforcement, "Optimized")
        .otherwise("Managed")
    )


def with_maturity(verdicts: DataFrame, lexicon: lx.Lexicon = lx.DEFAULT) -> DataFrame:
    flags = tx.mechanism_flags(F.col("mechanisms"), lexicon)
    return verdicts.withColumn(
        "governance_maturity", maturity(F.col("coverage"), F.col("principle_acknowledged"), flags)
    )


# -- shaping by tier, drift, fallback synthesis ------------------------------

def drift_score(synthesis: Column, lexicon: lx.Lexicon = lx.DEFAULT) -> Column:
    """3 per strong phrase present, 1 per soft word occurrence, 1 per soft phrase present."""
    lowered = F.lower(F.coalesce(synthesis, F.lit("")))
    score = F.regexp_count(lowered, F.lit(r"\b(?:" + tx.alternation(lexicon.drift_soft_words) + r")\b"))
    for phrase in lexicon.drift_strong:
        score = score + F.when(lowered.contains(phrase), 3).otherwise(0)
    for phrase in lexicon.drift_soft_phrases:
        score = score + F.when(lowered.contains(phrase), 1).otherwise(0)
    return score


def downgrade_drift(verdicts: DataFrame, lexicon: lx.Lexicon = lx.DEFAULT) -> DataFrame:
    """Covered verdicts whose own synthesis argues for change become Partial."""
    score = F.when(F.col("coverage") == "Covered", drift_score(F.col("synthesis"), lexicon)).otherwise(0)
    drifted = F.col("drift_score") >= lx.DRIFT_DOWNGRADE_AT
    return (
        verdicts.withColumn("drift_score", score)
        .withColumn("synthesis_drift_downgraded", drifted)
        .withColumn("coverage", F.when(drifted, "Partial").otherwise(F.col("coverage")))
    )


def shape_by_tier(verdicts: DataFrame) -> DataFrame:
    """Covered: no recommendations, a best-practice block; otherwise the reverse.

    Labels are taken as ``normalize_labels`` leaves them; "Insufficient Evidence" is no answer of the model's.
    """
    covered = F.col("coverage") == "Covered"
    none = F.array().cast("array<string>")
    return (
        verdicts.withColumn("best_practices", F.when(covered, F.struct(
            F.lit(BEST_PRACTICES_OPENING).alias("opening"),
            F.slice("opportunities", 1, 3).alias("future_strengthening_opportunities"))))
        .withColumn("recommendations", F.when(covered, none).otherwise(F.col("recommendations")))
    )


def covered_synthesis(dimension: Column, frameworks: Column, example: Column, mechanisms: Column) -> Column:
    """Three-part synthesis for a Covered verdict that came without one."""
    named = F.when(F.size(frameworks) > 0, F.array_join(frameworks, ", ")).otherwise(
        "the international frameworks assessed"
    )
    provisions = F.coalesce(
        F.nullif(tx.strip(F.coalesce(example, F.lit(""))), F.lit("")),
        F.nullif(tx.strip(F.array_join(F.slice(mechanisms, 1, 3), "; ")), F.lit("")),
        F.lit("the document's stated commitments"),
    )
    return F.struct(
        F.concat(
            F.lit("The frameworks assessed for this dimension ("), named, F.lit(") collectively require "),
            dimension,
            F.lit(" to be governed in AI systems — clear allocation of responsibility, oversight of AI "
                  "outcomes, and accountability for harms."),
        ).alias("consensus"),
        F.lit(
            "They differ in emphasis: normative instruments frame this as a principle or rights obligation, "
            "while practical toolkits specify the concrete mechanisms (reporting, audits, redress) that give "
            "it effect."
        ).alias("differences"),
        F.concat(
            F.lit("The uploaded policy already satisfies this expectation: the "), dimension,
            F.lit(" principle is given operational effect in the document — "), provisions,
            F.lit(" — so the policy substantively meets the international requirement."),
        ).alias("overall_assessment"),
    )


def ordered_framework_names(retrieved: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct source names per key, in order of first appearance."""
    first = retrieved.filter(tx.strip(F.coalesce("framework", F.lit(""))) != "").groupBy(*keys, "framework").agg(
        F.min("slot").alias("_at")
    )
    return first.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "framework"))), lambda s: s["framework"]).alias(
            "framework_names"
        )
    )


def joined_synthesis(synthesis: Column) -> Column:
    def part(label: str, name: str) -> Column:
        value = F.coalesce(synthesis[name], F.lit(""))
        return F.when(value != "", F.concat(F.lit(label + ": "), value))

    return F.concat_ws(
        "\n\n", part("Consensus", "consensus"), part("Differences", "differences"),
        part("Overall assessment", "overall_assessment"),
    )


def framework_synthesis(positions: DataFrame, evidence: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Positions whose chunk is in evidence, first per framework, as one line."""
    from policyloom.operators.ordering import first_per_key

    backed = positions.join(evidence.select(*keys, "chunk_id").distinct(), [*keys, "chunk_id"], "left_semi")
    first = first_per_key(backed, [*keys, "framework"], ["position_no"])
    quoted = F.when(
        F.coalesce("supporting", F.lit("")) != "", F.concat(F.lit(' ("'), F.col("supporting"), F.lit('")'))
    ).otherwise("")
    line = F.concat("framework", F.lit(": "), "position", quoted)
    return first.withColumn("_line", line).groupBy(*keys).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("position_no", "_line"))), lambda s: s["_line"]), " | "
        ).alias("synthesis")
    )


# -- risk and priority -------------------------------------------------------

def cluster_of(dimension: Column, clusters: dict | None = None) -> Column:
    clusters = lx.CLUSTERS if clusters is None else clusters
    return F.create_map(*[F.lit(v) for pair in clusters.items() for v in pair])[dimension]


def with_cluster_gap(gaps: DataFrame, workspace: str = "workspace_id") -> DataFrame:
    """Does another dimension of the same cluster fall short of Covered?

    A cluster has a handful of dimensions, so the window groups stay tiny.
    """
    short = (F.col("coverage") != "Covered").cast("int")
    same = Window.partitionBy(workspace, "_cluster")
    return (
        gaps.withColumn("_cluster", cluster_of(F.col("dimension")))
        .withColumn(
            "cluster_gap",
            F.col("_cluster").isNotNull() & ((F.sum(short).over(same) - short) > 0),
        )
        .drop("_cluster")
    )


def risk_level(coverage: Column, core: Column, cluster_gap: Column) -> Column:
    base = (
        F.when(coverage == "Covered", 0)
        .when(coverage == "Partial", F.when(core, 1).otherwise(0))
        .otherwise(F.when(core, 2).otherwise(1))
    )
    level = F.least(F.lit(2), base + F.when((coverage != "Covered") & cluster_gap, 1).otherwise(0))
    return F.when(coverage == "Insufficient Evidence", "Insufficient Evidence").otherwise(
        F.element_at(F.array(F.lit("Low"), F.lit("Medium"), F.lit("High")), level + 1)
    )


def risk_reason(coverage: Column, dimension: Column, core: Column, cluster_gap: Column) -> Column:
    kind = F.when(core, "Core").otherwise("Supporting")
    state = (
        F.when((coverage == "Partial") & core, "is only partially addressed.")
        .when(coverage == "Partial", "is partially addressed.")
        .otherwise("is not addressed.")
    )
    sentence = F.concat(kind, F.lit(" dimension '"), dimension, F.lit("' "), state)
    compounded = F.when(cluster_gap, " Risk compounded by related dimension gaps.").otherwise("")
    return (
        F.when(coverage == "Insufficient Evidence", "Insufficient evidence from reference frameworks.")
        .when(coverage == "Covered", "Policy adequately addresses this dimension.")
        .otherwise(F.concat(sentence, compounded))
    )


def priority(coverage: Column, cluster_gap: Column) -> Column:
    return (
        F.when(coverage == "Partial", F.when(cluster_gap, "High").otherwise("Medium"))
        .when(coverage == "Missing", F.when(cluster_gap, "Critical").otherwise("High"))
    )


def with_risk_and_priority(gaps: DataFrame, core: Sequence[str] = lx.CORE_DIMENSIONS) -> DataFrame:
    judged = with_cluster_gap(gaps)
    is_core = F.col("dimension").isin(*core)
    args = F.col("coverage"), is_core, F.col("cluster_gap")
    return (
        judged.withColumn("risk_level", risk_level(*args))
        .withColumn("risk_reason", risk_reason(args[0], F.col("dimension"), is_core, args[2]))
        .withColumn("priority", priority(args[0], args[2]))
    )


# -- confidence --------------------------------------------------------------

def confidence(evidence: DataFrame, verdicts: DataFrame, keys: Sequence[str] = KEYS,
               agreement: DataFrame | None = None, stability: DataFrame | None = None) -> DataFrame:
    """Geometric mean of seven factors per key.

    ``evidence(keys, chunk_id, source, similarity, verified)``; ``verdicts`` has
    the coverage.  Agreement and stability join in where known, else 0.5.
    """
    usable = F.when(F.col("similarity").between(0, 1), F.col("similarity"))
    per_source = evidence.groupBy(*keys, F.nullif("source", F.lit("")).alias("source")).agg(
        F.count("*").alias("_n"), F.sum(usable).alias("_sum"), F.count(usable).alias("_scored"),
        F.count_if("verified").alias("_verified"),
    )
    totals = per_source.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.sum("_sum").alias("_sum"), F.sum("_scored").alias("_scored"),
        F.sum("_verified").alias("_verified"), F.count("source").alias("_sources"),
    )
    joined = verdicts.select(*keys, "coverage").join(totals, list(keys), "left")
    half = F.lit(0.5)
    joined = joined.join(agreement, list(keys), "left") if agreement is not None else joined.withColumn("agreement", half)
    joined = joined.join(stability, list(keys), "left") if stability is not None else joined.withColumn("stability", half)
    completeness = F.create_map(*[F.lit(v) for pair in COMPLETENESS.items() for v in pair])[F.col("coverage")]
    factors = {
        "quality": F.when(F.col("_scored") > 0, settled(F.col("_sum") / F.col("_scored"), 3)).otherwise(0.3),
        "diversity": F.round(F.least(F.lit(1.0), F.col("_sources") / F.greatest(F.lit(5), F.col("n")) * 2), 3),
        "agreement": F.coalesce("agreement", half),
        "stability": F.coalesce("stability", half),
        "citation": F.round(F.col("_verified") / F.col("n"), 3),
        "cross_source": F.round(F.col("_sources") / F.col("n"), 3),
        "completeness": F.coalesce(completeness, F.lit(0.3)),
    }
    scored = joined
    for name, value in factors.items():
        scored = scored.withColumn(name, value)
    product = F.lit(1.0)
    for name in factors:
        product = product * F.greatest(F.coalesce(name, F.lit(0.0)), F.lit(FACTOR_FLOOR))
    names = list(factors)
    method = F.format_string(
        "GeoMean(quality=%.3f, diversity=%.3f, agreement=%.3f, stability=%.3f, citation=%.3f, "
        "cross_source=%.3f, coverage=%.3f)", *names,
    )
    none = F.col("n").isNull()
    return scored.withColumn(
        "confidence_score", F.when(none, 0.0).otherwise(F.round(F.pow(product, F.lit(1.0 / 7)), 4))
    ).withColumn("confidence_method", F.when(none, "No evidence: confidence=0").otherwise(method)).select(
        *keys, *names, "confidence_score", "confidence_method"
    )


def stability_factor(semantic_stability: Column, is_stable: Column) -> Column:
    return F.when(is_stable, semantic_stability).otherwise(F.greatest(F.lit(0.1), semantic_stability * 0.5))


# -- timelines ---------------------------------------------------------------

def phase_bounds(coverage: Column, n_mechanisms: Column, maturity_stage: Column, grounding: Column,
                 steps: Column) -> Column:
    """``array<struct<lo, hi>>`` in months for up to two phases, the second after the first."""
    base = F.when(coverage == "Missing", 12).otherwise(6)
    pace = (
        F.when(maturity_stage.isin("Ad Hoc", "Developing"), 3)
        .when(maturity_stage.isin("Managed", "Optimized"), -2)
        .otherwise(0)
    )
    eased = F.when(n_mechanisms > 0, -2).otherwise(0)
    owner = (
        F.when(grounding == "none_identified", 3).when(grounding == "document_named", -2)
        .when(grounding == "document_implied", -1).otherwise(0)
    )

    def scope(count: Column) -> Column:
        return F.when(count >= 6, 3).when(count <= 2, -1).otherwise(0)

    first = F.greatest(F.lit(3), base + pace + eased + owner + scope(F.get(steps, F.lit(0))))
    second = F.greatest(first + 3, first + base + pace + eased + scope(F.get(steps, F.lit(1))))
    one = F.struct(F.lit(0).alias("lo"), first.cast("int").alias("hi"))
    two = F.struct(first.cast("int").alias("lo"), second.cast("int").alias("hi"))
    return F.when(F.size(steps) >= 2, F.array(one, two)).when(F.size(steps) == 1, F.array(one)).otherwise(
        F.slice(F.array(one), 1, 0)
    )


def timeline_text(bounds: Column) -> Column:
    return F.concat(bounds["lo"].cast("string"), F.lit("-"), bounds["hi"].cast("string"), F.lit(" months"))


# -- plausibility ------------------------------------------------------------

# --- fixed values: level tables ---------------------------------------------
LEVEL_COVERAGE = ("Missing", "Partial", "Partial", "Covered", "Covered", "Covered")
STRENGTH_SCORE = {
    "Strongly Operationalised": 0.9,
    "Explicitly Addressed": 0.75,
    "Implicitly Addressed": 0.55,
    "Weakly Demonstrated": 0.35,
    "Not Demonstrated": 0.2,
}


def plausibility(cases: DataFrame) -> DataFrame:
    """Seven ordered checks over ``(level, coverage, strength, document_type, n_explicit,
    n_implicit, n_strong, n_weak, n_groups, demonstrated)``.

    Each check sees the level and coverage the one before it left.
    """
    any_evidence = (F.col("n_explicit") + F.col("n_implicit") + F.col("n_strong")) > 0
    level, coverage = F.col("_level"), F.col("_coverage")
    strategy = F.col("document_type") == "strategy"
    expected = F.element_at(F.array(*[F.lit(c) for c in LEVEL_COVERAGE]), level + 1)
    at_least_one = F.greatest(level, F.lit(1))
    too_weak = (F.col("strength") != "Strongly Operationalised") | (F.col("n_strong") == 0)
    demonstrated = F.coalesce("demonstrated", F.lit("None"))
    shown = (demonstrated != "") & (demonstrated != "None")
    checks = (
        ("doc_type", strategy & (coverage == "Missing") & any_evidence, at_least_one, F.lit("Partial")),
        ("ladder", coverage != expected, level, expected),
        ("functional_equiv", (level == 0) & any_evidence, F.lit(1), F.lit("Partial")),
        ("level0", (coverage == "Missing") & any_evidence, at_least_one, F.lit("Partial")),
        ("level5", (level == 5) & too_weak, F.lit(4), F.lit("Covered")),
        ("distributed", strategy & (level < 2) & (F.col("n_groups") > 2), F.greatest(level, F.lit(2)), F.lit("Partial")),
        ("missing_final", (coverage == "Missing") & shown, at_least_one, F.lit("Partial")),
        ("missing_implicit", (coverage == "Missing") & (F.col("n_implicit") > 0), at_least_one, F.lit("Partial")),
    )
    state = cases.withColumn("_level", F.col("level")).withColumn("_coverage", F.col("coverage"))
    for name, fires, new_level, new_coverage in checks:
        state = (
            state.withColumn(f"_{name}", fires)
            .withColumn("_next_level", F.when(F.col(f"_{name}"), new_level).otherwise(level))
            .withColumn("_coverage", F.when(F.col(f"_{name}"), new_coverage).otherwise(coverage))
            .withColumn("_level", F.col("_next_level"))
            .drop("_next_level")
        )
    names = [name for name, *_ in checks]
    fired = F.array_compact(F.array(*[F.when(F.col(f"_{n}"), n) for n in names]))
    n_fired = F.size(fired)
    base = F.coalesce(
        F.create_map(*[F.lit(v) for pair in STRENGTH_SCORE.items() for v in pair])[F.col("strength")], F.lit(0.5)
    )
    explicit = F.col("n_explicit") > 0
    score = F.when(explicit, F.least(F.lit(1.0), base + 0.1)).otherwise(base)
    score = F.when((F.col("n_weak") > 0) & ~explicit, F.greatest(F.lit(0.1), score - 0.1)).otherwise(score)
    score = F.when(n_fired > 1, F.greatest(F.lit(0.1), score - n_fired * 0.05)).otherwise(score)
    score = F.round(score, 6)
    return (
        state.withColumn("checks_fired", fired)
        .withColumn("validated_level", level)
        .withColumn("validated_coverage", coverage)
        .withColumn(
            "confidence_in_assessment",
            F.when(score >= 0.7, "High").when(score >= 0.4, "Medium").otherwise("Low"),
        )
        .drop("_level", "_coverage", *[f"_{n}" for n in names])
    )


# -- rows for dimensions without a verdict -----------------------------------

def complete_dimensions(expected: DataFrame, gaps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every expected dimension, with an honest placeholder where none was judged."""
    joined = expected.join(gaps.withColumn("_judged", F.lit(True)), list(keys), "left")
    absent = F.col("_judged").isNull()
    return (
        joined.withColumn("coverage", F.coalesce("coverage", F.lit("Insufficient Evidence")))
        .withColumn(
            "reason_flagged",
            F.when(F.col("analysis_error").isNotNull(), F.concat(F.lit("Analysis failed: "), F.col("analysis_error")))
            .when(absent, "Insufficient evidence retrieved from reference frameworks.")
            .otherwise(F.col("reason_flagged")),
        )
        .drop("_judged")
    )


def unfinished(dimensions: DataFrame, results: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """What a resumed run still has to analyse; failed results do not count as done."""
    done = results.filter(F.col("status") == "completed").select(*keys).distinct()
    return dimensions.join(done, list(keys), "left_anti")


def scope_disclaimer(chunks: DataFrame, workspace: str = "workspace_id") -> DataFrame:
    names = chunks.select(workspace, F.trim(F.coalesce("document_name", F.lit(""))).alias("name")).distinct()
    listed = names.groupBy(workspace).agg(
        F.array_sort(F.collect_list(F.when(F.col("name") != "", F.col("name")))).alias("documents")
    )
    joined = F.array_join("documents", ", ")
    clause = (
        F.when(F.size("documents") == 1, F.concat(F.lit("the provided document ("), joined, F.lit(")")))
        .when(F.size("documents") > 1, F.concat(F.lit("the provided documents ("), joined, F.lit(")")))
        .otherwise("the document(s) provided to the system")
    )
    return listed.withColumn(
        "disclaimer",
        F.concat(
            F.lit("Scope: this assessment evaluates "), clause,
            F.lit(". It is not an assessment of the country's complete AI governance apparatus — governance "
                  "instruments not provided to the system are outside this evaluation, and coverage verdicts "
                  "should be read as relative to the evidence supplied."),
        ),
    )
