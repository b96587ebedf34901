"""The decision brief of a workspace: a model's narrative joined to what the rules computed, and its markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policyloom.functions import text as tx
from policyloom.operators import analytics

COVERAGES = ("Covered", "Partial", "Missing", "Insufficient Evidence")


def coverage_summary(gaps: DataFrame, workspace: str = "workspace_id") -> DataFrame:
    """How many dimensions have each verdict, and how many could not be analysed."""
    return gaps.groupBy(workspace).agg(
        *(F.count_if(F.col("coverage") == c).alias(c.lower().replace(" ", "_")) for c in COVERAGES),
        F.count_if(F.coalesce("analysis_error", F.lit("")) != "").alias("analysis_failed"), F.count("*").alias("num_dimensions"),
    )


def assemble_briefs(headers: DataFrame, gaps: DataFrame, narrative: DataFrame, incidents: DataFrame, workspace: str = "workspace_id") -> DataFrame:
    """One structured brief per header.

    ``headers(workspace, country, policy_title, documents[], frameworks_used[], disclaimer, generated_at)``;
    ``narrative(workspace, executive_summary, strengths[], attention[], recommendations[struct<recommendation,
    rationale>])`` is the model's part: blank entries are left out, all are trimmed; a workspace without one gets an
    empty summary and empty lists.  ``incidents(workspace, incident_name, ord)`` gives the precedent, if any.
    """
    def clean(name: str):
        listed = F.transform(F.coalesce(name, F.array().cast("array<string>")), tx.strip)
        return F.filter(listed, lambda s: s != "").alias(name)

    trimmed = F.transform("recommendations", lambda r: F.struct(
        tx.strip(r["recommendation"]).alias("recommendation"), tx.strip(F.coalesce(r["rationale"], F.lit(""))).alias("rationale")))
    kept = F.filter(trimmed, lambda r: r["recommendation"] != "")
    told = narrative.select(
        workspace, tx.strip(F.coalesce("executive_summary", F.lit(""))).alias("executive_summary"), clean("strengths"), clean("attention"),
        kept.alias("recommendations"),
    )
    counted = coverage_summary(gaps, workspace)
    risks = analytics.risk_overview(gaps, workspace).select(
        workspace, F.col("paragraph").alias("risk_paragraph"), "high", "medium", "low", "insufficient", "high_priority_dimensions")
    joined = headers.join(counted, workspace).join(risks, workspace).join(told, workspace, "left").join(
        analytics.precedents(incidents, workspace), workspace, "left")
    none = F.array().cast("array<string>")
    no_advice = F.array().cast("array<struct<recommendation:string,rationale:string>>")
    method = analytics.methodology(F.col("disclaimer"), F.col("frameworks_used"), F.col("documents"), F.col("num_dimensions"))
    return joined.withColumns({
        "executive_summary": F.coalesce("executive_summary", F.lit("")), "strengths": F.coalesce("strengths", none),
        "attention": F.coalesce("attention", none), "recommendations": F.coalesce("recommendations", no_advice), "methodology": method,
    })
