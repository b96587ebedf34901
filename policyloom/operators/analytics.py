"""Roll-ups over judged dimensions: decision analytics, tiers, summaries, briefs, telemetry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policyloom import lexicons as lx
from policyloom.functions.numbers import settled

RADAR = {"Covered": 100, "Partial": 66, "Missing": 33}


def rank_of(values: Sequence[str], column: Column) -> Column:
    return F.create_map(*[F.lit(v) for pair in zip(values, range(len(values))) for v in pair])[column]


def _assessed() -> Column:
    return F.col("coverage").isin("Covered", "Partial", "Missing")


def _names(condition: Column, order: Column) -> Column:
    """Dimensions that meet a condition, in order; a workspace has a handful."""
    picked = F.collect_list(F.when(condition, F.struct(order.alias("o"), F.col("ord").alias("n"), F.col("dimension").alias("d"))))
    return F.array_join(F.transform(F.array_sort(picked), lambda s: s["d"]), ", ")


def decision_analytics(gaps: DataFrame, workspace: str = "workspace_id") -> DataFrame:
    """One row per workspace.

    ``gaps(workspace, dimension, ord, coverage, governance_maturity, priority,
    confidence_score, analysis_error, synthesis_drift_downgraded)``.  The
    overall stage is that of the weakest assessed dimension.
    """
    stage = F.coalesce(rank_of(lx.MATURITY_STAGES, F.col("governance_maturity")), F.lit(0))
    assessed = _assessed()
    failed = F.col("analysis_error").isNotNull()
    rank = F.when(assessed, stage)
    strongest = F.max_by("dimension", F.when(assessed, F.struct(stage, F.col("confidence_score"), -F.col("ord"))))
    urgency = rank_of(lx.PRIORITIES, F.col("priority"))
    n = F.count(F.when(assessed, 1))
    stages = F.array(*[F.lit(s) for s in lx.MATURITY_STAGES])
    return gaps.groupBy(workspace).agg(
        F.count_if(F.col("coverage") == "Covered").alias("covered"),
        F.count_if(F.col("coverage") == "Partial").alias("partial"),
        F.count_if(F.col("coverage") == "Missing").alias("missing"),
        F.count_if((F.col("coverage") == "Insufficient Evidence") & ~failed).alias("insufficient_evidence"),
        F.count_if(failed).alias("analysis_failed"),
        n.alias("assessed_dimensions"),
        F.coalesce(F.get(stages, F.min(rank)), F.lit("Not Assessed")).alias("overall_governance_maturity"),
        F.coalesce(F.round(100.0 * F.sum(rank) / (4 * n), 1), F.lit(0.0)).alias("maturity_index"),
        *[
            F.count_if(assessed & (stage == i)).alias("stage_" + name.lower().replace(" ", "_"))
            for i, name in enumerate(lx.MATURITY_STAGES)
        ],
        F.coalesce(settled(F.sum(F.when(assessed, F.col("confidence_score"))) / n, 3), F.lit(0.0)).alias("average_confidence"),
        _names(F.col("priority").isin("Critical", "High"), urgency).alias("highest_priority_dimensions"),
        F.coalesce(strongest, F.lit("")).alias("strongest_dimension"),
        _names(F.col("synthesis_drift_downgraded"), F.lit(0)).alias("synthesis_drift_downgraded"),
        F.count_if("synthesis_drift_downgraded").alias("synthesis_drift_downgraded_count"),
    )


def weakest_tier(gaps: DataFrame, workspace: str = "workspace_id") -> DataFrame:
    """Weakest dimensions; only the Critical and High ones where there are any."""
    assessed = gaps.filter(_assessed() & F.col("analysis_error").isNull())
    tier = F.create_map(F.lit("Missing"), F.lit(0), F.lit("Partial"), F.lit(1), F.lit("Covered"), F.lit(2))[F.col("coverage")]
    lowest = assessed.withColumn("_tier", tier).groupBy(workspace).agg(F.min("_tier").alias("_weakest"))
    urgent = F.col("priority").isin("Critical", "High")
    weak = assessed.withColumn("_tier", tier).join(lowest, workspace).filter(
        (F.col("_tier") == F.col("_weakest")) & (F.col("_weakest") < 2)
    )
    order = F.coalesce(rank_of(lx.PRIORITIES, F.col("priority")), F.lit(9))
    return weak.groupBy(workspace).agg(
        F.max(F.coalesce(urgent, F.lit(False))).alias("_any"),
        _names(F.coalesce(urgent, F.lit(False)), order).alias("_urgent"),
        _names(F.lit(True), order).alias("_all"),
    ).select(workspace, F.when(F.col("_any"), F.col("_urgent")).otherwise(F.col("_all")).alias("weakest_dimensions"))


def radar(gaps: DataFrame, workspace: str = "workspace_id", dimensions: Sequence[str] = lx.DIMENSIONS) -> DataFrame:
    """One column per dimension with its ring value, and the number not assessed."""
    assessed = (F.col("coverage") != "Insufficient Evidence") & F.col("analysis_error").isNull()
    ring = F.coalesce(F.create_map(*[F.lit(v) for pair in RADAR.items() for v in pair])[F.col("coverage")], F.lit(0))
    value = F.when(assessed, ring).otherwise(0)
    return gaps.groupBy(workspace).agg(
        F.count_if(~assessed).alias("not_assessed"),
        *[F.max(F.when(F.col("dimension") == d, value)).alias(d.lower().replace(" ", "_")) for d in dimensions],
    )


def tier_statistics(gaps: DataFrame, payload: Column) -> DataFrame:
    """Rows and serialized size per coverage tier."""
    return gaps.groupBy("coverage").agg(
        F.count("*").alias("count"),
        F.coalesce(F.sum(F.length(payload)), F.lit(0)).alias("payload_chars"),
        F.round(F.coalesce(F.sum(F.length(payload)), F.lit(0)) / F.count("*"), 1).alias("payload_avg_chars"),
    )


def summaries(gaps: DataFrame, workspace: str = "workspace_id") -> DataFrame:
    """A paragraph per workspace."""
    failed = F.col("analysis_error").isNotNull()
    order = F.lit(0)
    first_error = F.min_by("analysis_error", F.when(failed, F.col("ord")))
    g = gaps.groupBy(workspace).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("coverage") == "Covered").alias("covered"),
        F.count_if(F.col("coverage") == "Partial").alias("partial"),
        F.count_if(F.col("coverage") == "Missing").alias("missing"),
        F.count_if((F.col("risk_level") == "Insufficient Evidence") & ~failed).alias("insufficient"),
        F.count_if(F.col("risk_level") == "High").alias("high"),
        F.count_if(F.col("risk_level") == "Medium").alias("medium"),
        F.count_if(failed).alias("errored"),
        F.substring(first_error, 1, 120).alias("first_error"),
        _names(failed, order).alias("errored_names"),
        _names(F.col("coverage") == "Missing", order).alias("missing_names"),
        _names(F.col("coverage") == "Partial", order).alias("partial_names"),
    )

    def text(column: str) -> Column:
        return F.col(column).cast("string")

    return g.select(
        workspace,
        F.concat_ws(
            " ",
            F.concat(F.lit("Analysis of "), text("total"), F.lit(" governance dimensions:")),
            F.concat(text("covered"), F.lit(" Fully Covered, "), text("partial"), F.lit(" Partially Covered, "),
                     text("missing"), F.lit(" Missing.")),
            F.when((F.col("high") > 0) | (F.col("medium") > 0),
                   F.concat(F.lit("Risk levels: "), text("high"), F.lit(" high-risk, "), text("medium"),
                            F.lit(" medium-risk."))),
            F.when(F.col("errored") > 0,
                   F.concat(text("errored"), F.lit(" dimension(s) could not be analysed ("), F.col("errored_names"),
                            F.lit("): "), F.col("first_error"), F.lit("."))),
            F.when(F.col("insufficient") > 0, F.concat(text("insufficient"), F.lit(" dimensions had insufficient evidence."))),
            F.when(F.col("missing") > 0, F.concat(F.lit("Missing: "), F.col("missing_names"), F.lit("."))),
            F.when(F.col("partial") > 0, F.concat(F.lit("Partial: "), F.col("partial_names"), F.lit("."))),
        ).alias("summary"),
    )


def risk_overview(gaps: DataFrame, workspace: str = "workspace_id") -> DataFrame:
    urgent = F.col("priority").isin("Critical", "High")
    g = gaps.groupBy(workspace).agg(
        F.count("*").alias("assessed"),
        F.count_if(F.col("risk_level") == "High").alias("high"),
        F.count_if(F.col("risk_level") == "Medium").alias("medium"),
        F.count_if(F.col("risk_level") == "Low").alias("low"),
        F.count_if(F.coalesce("risk_level", F.lit("Insufficient Evidence")) == "Insufficient Evidence").alias("insufficient"),
        F.count_if(urgent).alias("urgent"),
        _names(urgent, rank_of(lx.PRIORITIES, F.col("priority"))).alias("high_priority_dimensions"),
    )

    def text(column: str) -> Column:
        return F.col(column).cast("string")

    tail = F.when(
        F.col("urgent") >= 2,
        " Multiple dimensions share the highest priority — compounding risk across these dimensions raises the "
        "urgency of coordinated, sequenced implementation.",
    ).when(
        F.col("urgent") == 1,
        " Single highest-priority dimension — sequencing should begin there before related clusters are addressed.",
    ).otherwise("")
    named = F.when(
        F.col("urgent") > 0, F.concat(F.lit(" High-priority dimensions: "), F.col("high_priority_dimensions"), F.lit("."))
    ).otherwise("")
    return g.withColumn(
        "paragraph",
        F.concat(
            F.lit("The analysis assessed "), text("assessed"), F.lit(" dimension(s). Risk distribution: "), text("high"),
            F.lit(" High, "), text("medium"), F.lit(" Medium, "), text("low"), F.lit(" Low, "), text("insufficient"),
            F.lit(" Insufficient Evidence."), named, tail,
        ),
    )


def precedents(incidents: DataFrame, workspace: str = "workspace_id") -> DataFrame:
    """Sentence on matched incidents: distinct names in order of first mention."""
    name = F.trim(F.coalesce("incident_name", F.lit("")))
    first = incidents.withColumn("_name", name).filter(F.col("_name") != "").groupBy(workspace, "_name").agg(
        F.min("ord").alias("_at")
    )
    listed = first.groupBy(workspace).agg(
        F.count("*").alias("_n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_name"))), lambda s: s["_name"]), ", ").alias(
            "_names"
        ),
    )
    tail = F.lit("); the full report carries the case-study detail.")
    return listed.select(
        workspace,
        F.when(
            F.col("_n") == 1,
            F.concat(F.lit("The analysis matched one real-world incident as illustrative context ("), F.col("_names"), tail),
        ).otherwise(
            F.concat(F.lit("The analysis matched "), F.col("_n").cast("string"),
                     F.lit(" real-world incidents as illustrative context ("), F.col("_names"), tail)
        ).alias("precedent"),
    )


def methodology(disclaimer: Column, frameworks: Column, documents: Column, n_dimensions: Column) -> Column:
    listed = F.when(F.size(frameworks) > 0, F.array_join(frameworks, ", ")).otherwise("the configured core frameworks")
    return F.concat_ws(
        "\n\n",
        disclaimer,
        F.concat(
            F.lit("This brief synthesizes the already-computed analysis of "), n_dimensions.cast("string"),
            F.lit(" governance dimensions evaluated against "), F.size(frameworks).cast("string"),
            F.lit(" reference framework(s): "), listed, F.lit("."),
        ),
        F.when(F.size(documents) > 0, F.concat(F.lit("Source input(s): "), F.array_join(documents, ", "), F.lit("."))),
    )


def run_telemetry(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scores.groupBy(*by).agg(
        F.count("*").alias("retrieval_count"),
        settled(F.avg("similarity"), 6).alias("avg_similarity"),
        F.min("similarity").alias("min_similarity"),
        F.max("similarity").alias("max_similarity"),
    )


def visible_citations(citations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shown, real and verified citations per key; unnamed sources are not shown."""
    declined = F.col("state") == "no_citation"
    shown = declined | ~F.coalesce("source", F.lit("")).isin("", "Unknown")
    real = shown & (F.coalesce("chunk_id", F.lit("")) != "")
    return citations.groupBy(*keys).agg(
        F.count_if(shown).alias("visible"),
        F.count_if(real).alias("sources"),
        F.count_if(real & (F.col("state") == "verified")).alias("verified"),
    )


def finding_rows(analyses: DataFrame) -> DataFrame:
    """Flatten nested results: the module's value before the top-level one."""
    return analyses.select(
        "workspace_id", F.explode("gaps").alias("g")
    ).select(
        "workspace_id", F.col("g.dimension").alias("dimension"), F.col("g.coverage").alias("coverage"),
        F.coalesce("g.module_1.coverage_reasoning", "g.coverage_reasoning").alias("coverage_reasoning"),
        F.coalesce("g.module_1.governance_maturity", "g.governance_maturity").alias("governance_maturity"),
        F.col("g.risk_level").alias("risk_level"), F.col("g.module_2.priority").alias("priority"),
        F.coalesce("g.module_2.recommendations", F.array().cast("array<string>")).alias("recommendations"),
    )


def nested_analyses(gaps: DataFrame, workspace: str = "workspace_id") -> DataFrame:
    """One analysis row per workspace with its dimensions nested, in dimension order."""
    gap = F.struct(
        "ord", "dimension", "coverage", "coverage_reasoning", "governance_maturity", "risk_level", "risk_reason",
        "confidence_score", "analysis_error",
        F.struct("coverage_reasoning", "governance_maturity", "mechanisms").alias("module_1"),
        F.struct("priority", "recommendations").alias("module_2"),
    )
    return gaps.groupBy(workspace).agg(F.array_sort(F.collect_list(gap)).alias("gaps"))
