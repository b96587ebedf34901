"""Reports and prompt contexts as ordered string aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyloom import lexicons as lx
from policyloom.operators.verify import prompt_label

RULE = "-" * 72
DOUBLE_RULE = "=" * 72


def lines_in_order(order: Column, line: Column) -> Column:
    """Lines of a small group joined in order."""
    packed = F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l"))))
    return F.array_join(F.transform(packed, lambda s: s["l"]), "\n")


def passage(bucket: Column, slot: Column, chunk_id: Column, page: Column, framework: Column,
            document: Column, text: Column) -> Column:
    """One labelled passage; the framework's name goes before the document's."""
    source = F.coalesce(F.nullif(framework, F.lit("")), F.nullif(document, F.lit("")), F.lit("Uploaded Document"))
    at = F.when(page.isNotNull(), F.concat(F.lit(" (p."), page.cast("string"), F.lit(")"))).otherwise("")
    cid = F.coalesce(chunk_id, F.lit(""))
    with_id = F.when(cid != "", F.concat(F.lit(" chunk_id="), cid)).otherwise("")
    return F.concat(F.lit("["), prompt_label(bucket, slot), F.lit("]"), with_id, at, F.lit(" Source: "), source,
                    F.lit("\n"), F.coalesce(text, F.lit("")))


def prompt_context(filled: DataFrame, keys: Sequence[str] = ("workspace_id", "dimension")) -> DataFrame:
    """First-pass context per key: document, normative and practical blocks.

    Input is the budgeted retrieval (about eleven rows per key).
    """
    return _context(filled, keys, (
        ("document", "═══ [UPLOADED DOCUMENT] — primary evidence ═══", "(no document chunks retrieved for this dimension)"),
        (lx.NORMATIVE, "═══ [MODULE 1 — NORMATIVE REQUIREMENTS] ═══", "(no Module 1 normative chunks retrieved)"),
        (lx.PRACTICAL, "═══ [MODULE 2 — PRACTICAL TOOLKITS & MECHANISMS] ═══", "(no Module 2 practical chunks retrieved)"),
    ))


def second_pass_context(filled: DataFrame, keys: Sequence[str] = ("workspace_id", "dimension")) -> DataFrame:
    return _context(filled, keys, (
        (lx.IMPLEMENTATION, "═══ [MODULE 3 — IMPLEMENTATION SOURCES] ═══", "(no Module 3 implementation chunks retrieved)"),
        (lx.INCIDENT, "═══ [MODULE 4 — INCIDENT RECORDS] ═══", "(no curated incident records retrieved)"),
        ("document", "═══ [UPLOADED DOCUMENT — for responsible-agency grounding] ═══", "(no document chunks retrieved)"),
    ))


def _context(filled: DataFrame, keys: Sequence[str], blocks) -> DataFrame:
    page = F.col("page_number") if "page_number" in filled.columns else F.lit(None)
    document = F.col("document_name") if "document_name" in filled.columns else F.lit(None).cast("string")
    line = passage(F.col("bucket"), F.col("slot"), F.col("chunk_id").cast("string"), page, F.col("framework"), document,
                   F.col("text"))
    grouped = filled.withColumn("_line", line).groupBy(*keys).agg(*[
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
            F.col("bucket") == bucket, F.struct("slot", "_line")))), lambda s: s["_line"]), "\n").alias(f"_b{i}")
        for i, (bucket, _, _) in enumerate(blocks)
    ])
    parts = [F.concat(F.lit("Dimension: "), F.col("dimension")), F.lit("")]
    for i, (_, title, empty) in enumerate(blocks):
        if i:
            parts.append(F.lit(""))
        parts += [F.lit(title), F.coalesce(F.nullif(F.col(f"_b{i}"), F.lit("")), F.lit(empty))]
    return grouped.select(*keys, F.concat_ws("\n", *parts).alias("context"))


def chat_context(hits: DataFrame, keys: Sequence[str], k: int = 8) -> DataFrame:
    """Numbered sources with their text for a chat turn."""
    source = F.concat(
        F.coalesce("framework", F.lit("Uploaded Document")),
        F.when(F.coalesce("section_title", F.lit("")) != "", F.concat(F.lit(", "), F.col("section_title"))).otherwise(""),
        F.when(F.col("page_number").isNotNull(), F.concat(F.lit(" (p. "), F.col("page_number").cast("string"), F.lit(")"))
               ).otherwise(""),
    )
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] Source: "), source, F.lit("\n"), F.col("text"), F.lit("\n"))
    return hits.filter(F.col("rank") <= k).groupBy(*keys).agg(lines_in_order(F.col("rank"), line).alias("context"))


def overview_context(chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DOC-numbered passages of one document."""
    label = F.concat(
        F.lit("[DOC-"), F.col("rank").cast("string"), F.lit("] ("),
        F.coalesce(F.nullif("document_name", F.lit("")), F.lit("Uploaded Document")),
        F.when(F.coalesce("section_title", F.lit("")) != "", F.concat(F.lit(", "), F.col("section_title"))).otherwise(""),
        F.when(F.col("page_number") > 0, F.concat(F.lit(", p. "), F.col("page_number").cast("string"))).otherwise(""),
        F.lit(")\n"), F.col("text"), F.lit("\n"),
    )
    return chosen.groupBy(*keys).agg(lines_in_order(F.col("rank"), label).alias("context"))


def verdict_text(gaps: DataFrame) -> DataFrame:
    """Verdict carried into the second pass as compact text."""
    def line(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))

    recommendations = F.slice(F.coalesce("recommendations", F.array().cast("array<string>")), 1, 5)
    return gaps.select(
        "workspace_id", "dimension",
        F.concat_ws(
            "\n",
            line("Dimension: ", F.col("dimension")), line("Coverage: ", F.col("coverage")),
            line("Coverage reasoning: ", F.col("coverage_reasoning")),
            line("Existing operational mechanisms in document: ", F.array_join(F.slice("mechanisms", 1, 6), "; ")),
            line("Governance maturity: ", F.col("governance_maturity")),
            F.when(F.size(recommendations) > 0, F.concat(
                F.lit("Module 2 recommendations (the gap this roadmap must address):\n"),
                F.array_join(F.transform(recommendations, lambda r: F.concat(F.lit("  - "), r)), "\n"))),
        ).alias("verdict_text"),
    )


def drill_down(gaps: DataFrame, evidence: DataFrame | None = None, keys: Sequence[str] = ("workspace_id", "dimension")) -> DataFrame:
    """Reasoning trail of one finding for a follow-up question.

    ``evidence(keys, ord, framework, page_number, similarity, text)`` is listed below it, 300 characters of each text.
    """
    def line(label: str, name: str) -> Column:
        value = F.col(name).cast("string")
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))

    found = F.when(F.col("gap_found"), "True").when(~F.col("gap_found"), "False") if "gap_found" in gaps.columns else F.lit(None).cast("string")
    trail = gaps.select(
        *keys,
        F.concat_ws(
            "\n", line("Dimension: ", "dimension"), line("Coverage: ", "coverage"),
            line("Coverage reasoning (deterministic ladder rules): ", "coverage_reasoning"), F.concat(F.lit("Gap detected: "), found),
            line("Governance maturity: ", "governance_maturity"), line("Risk Level: ", "risk_level"),
            line("  Risk reason: ", "risk_reason"), line("Confidence method: ", "confidence_method"),
            F.when(F.size("recommendations") > 0,
                   F.concat(F.lit("Recommendation: "), F.array_join("recommendations", "; "))),
        ).alias("trail"),
    )
    if evidence is None:
        return trail
    page = F.when(F.col("page_number") > 0, F.concat(F.lit(" (p. "), F.col("page_number").cast("string"), F.lit(")"))).otherwise("")
    score = F.when(F.col("similarity").isNotNull(), F.concat(F.lit(" [similarity: "), F.col("similarity").cast("string"), F.lit("]"))).otherwise("")
    item = F.concat(
        F.lit("  • ["), F.coalesce(F.nullif("framework", F.lit("")), F.lit("Uploaded Document")), page, F.lit("]"), score,
        F.lit("\n    "), F.substring(F.coalesce("text", F.lit("")), 1, 300),
    )
    listed = evidence.groupBy(*keys).agg(lines_in_order(F.col("ord"), item).alias("_items"))
    return trail.join(listed, list(keys), "left").select(*keys, F.concat_ws(
        "\n", "trail", F.lit(""), F.lit("Evidence used for this finding:"), F.coalesce("_items", F.lit("  (no retrieved evidence items)"))
    ).alias("trail"))


def executive_brief(gaps: DataFrame, headers: DataFrame, workspace: str = "workspace_id") -> DataFrame:
    """Plain-text brief per workspace.

    ``gaps(workspace, ord, dimension, coverage, risk_level, risk_reason,
    reason_flagged, recommendation, gap_found)``; ``headers(workspace,
    document_name, analysis_id, generated_at, frameworks_used, summary,
    total_retrieved)``.
    """
    level = F.coalesce("risk_level", F.lit("Insufficient Evidence"))
    finding = F.concat_ws(
        "\n",
        F.concat(F.lit("  ["), level, F.lit("] "), F.col("dimension")),
        F.lit("  " + "─" * 40),
        F.concat(F.lit("  Coverage: "), F.col("coverage")),
        F.concat(F.lit("  Gap identified: "), F.when(F.col("gap_found"), "Yes").otherwise("No")),
        F.when(F.coalesce("reason_flagged", F.lit("")) != "", F.concat(F.lit("  Assessment: "), F.col("reason_flagged"))),
        F.when(level != "Insufficient Evidence", F.concat(F.lit("  Risk: "), F.col("risk_reason"))),
        F.when(F.coalesce("recommendation", F.lit("")) != "", F.concat(F.lit("  Recommendation: "), F.col("recommendation"))),
        F.lit(""),
    )
    numbered = F.concat(F.lit("  "), (F.col("ord") + 1).cast("string"), F.lit(". "), F.col("dimension"), F.lit(": "),
                        F.col("recommendation"))

    def risk_line(label: str, value: str) -> Column:
        names = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
            level == value, F.struct("ord", "dimension")))), lambda s: s["dimension"]), ", ")
        return F.concat(F.lit(f"  {label}: "), F.count_if(level == value).cast("string"), F.lit(" — "),
                        F.coalesce(F.nullif(names, F.lit("")), F.lit("None")))

    body = gaps.groupBy(workspace).agg(
        lines_in_order(F.col("ord"), finding).alias("_findings"),
        risk_line("High Risk", "High").alias("_high"), risk_line("Medium Risk", "Medium").alias("_medium"),
        risk_line("Low Risk", "Low").alias("_low"),
        risk_line("Insufficient Evidence", "Insufficient Evidence").alias("_none"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
            F.col("gap_found"), F.struct("ord", numbered.alias("l"))))), lambda s: s["l"]), "\n").alias("_recs"),
    )

    def title(text: str) -> Column:
        return F.lit(f"{RULE}\n{text}\n{RULE}")

    return headers.join(body, workspace).select(
        workspace,
        F.concat_ws(
            "\n",
            F.lit(f"{DOUBLE_RULE}\nEXECUTIVE BRIEF — AI Policy Gap Analysis\n{DOUBLE_RULE}\n"),
            F.concat(F.lit("Document analyzed: "), F.col("document_name")),
            F.concat(F.lit("Analysis ID: "), F.col("analysis_id")),
            F.concat(F.lit("Date: "), F.col("generated_at")),
            F.concat(F.lit("Frameworks used: "), F.array_join("frameworks_used", ", ")),
            F.lit(""), title("1. EXECUTIVE SUMMARY"), F.col("summary"), F.lit(""),
            title("2. KEY FINDINGS BY GOVERNANCE DIMENSION"), F.lit(""), F.col("_findings"),
            title("3. RISK SUMMARY"), F.col("_high"), F.col("_medium"), F.col("_low"), F.col("_none"), F.lit(""),
            title("4. RECOMMENDATIONS"), F.lit(""), F.col("_recs"), F.lit(""),
            title("5. REFERENCES"), F.lit(""), F.lit("  Reference frameworks consulted:"),
            F.array_join(F.transform("frameworks_used", lambda f: F.concat(F.lit("    - "), f)), "\n"), F.lit(""),
            F.concat(F.lit("  Retrieved evidence chunks: "), F.col("total_retrieved").cast("string")),
            F.lit(DOUBLE_RULE),
        ).alias("brief"),
    )


def brief_markdown(briefs: DataFrame) -> DataFrame:
    """Markdown rendering of structured briefs.

    ``briefs(workspace_id, country, policy_title, generated_at, num_dimensions,
    executive_summary, strengths[], attention[], risk_paragraph,
    recommendations[struct<recommendation, rationale>], precedent, methodology)``.
    """
    def bullets(name: str) -> Column:
        listed = F.array_join(F.transform(name, lambda b: F.concat(F.lit("- "), b)), "\n")
        return F.when(F.size(name) > 0, listed).otherwise("- None identified.")

    numbered = F.array_join(F.transform(
        "recommendations", lambda r, i: F.concat((i + 1).cast("string"), F.lit(". **"), r["recommendation"],
                                                 F.lit("** — "), r["rationale"])), "\n")
    return briefs.select(
        "workspace_id",
        F.concat_ws(
            "\n",
            F.concat(F.lit("# "), F.col("country"), F.lit(" — "), F.col("policy_title")),
            F.lit("AI Governance Assessment Brief"),
            F.concat(F.lit("Generated "), F.col("generated_at"), F.lit(" · Based on analysis of "),
                     F.col("num_dimensions").cast("string"), F.lit(" governance dimensions")),
            F.lit("\n## EXECUTIVE SUMMARY"), F.col("executive_summary"),
            F.lit("\n## KEY FINDINGS\n### Areas of Strength"), bullets("strengths"),
            F.lit("### Areas Requiring Attention"), bullets("attention"),
            F.lit("\n## RISK OVERVIEW"), F.col("risk_paragraph"),
            F.lit("\n## PRIORITY RECOMMENDATIONS"),
            F.when(F.size("recommendations") > 0, numbered).otherwise(
                "No critical gaps identified — no priority actions required."),
            F.when(F.coalesce("precedent", F.lit("")) != "",
                   F.concat(F.lit("\n## RELEVANT PRECEDENT\n"), F.col("precedent"))),
            F.lit("\n## SCOPE & METHODOLOGY"), F.col("methodology"), F.lit(""),
        ).alias("markdown"),
    )


def dimension_digest(gaps: DataFrame, workspace: str = "workspace_id") -> DataFrame:
    """A few lines per dimension: the only facts a brief may use."""
    recommendations = F.slice(F.coalesce("recommendations", F.array().cast("array<string>")), 1, 3)
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("- "), F.col("dimension"), F.lit(": Coverage "), F.col("coverage")),
        F.concat(F.lit("  Maturity: "), F.col("governance_maturity")),
        F.when(F.col("priority").isNotNull(), F.concat(F.lit("  Priority: "), F.col("priority"))),
        F.when(F.size(recommendations) > 0, F.concat(
            F.lit("  Recommendations (from the analysis):\n"),
            F.array_join(F.transform(recommendations, lambda r: F.concat(F.lit("    - "), r)), "\n"))),
        F.when(F.col("analysis_error").isNotNull(),
               F.concat(F.lit("  [Not analysed — "), F.substring("analysis_error", 1, 100), F.lit("]"))),
    )
    return gaps.groupBy(workspace).agg(lines_in_order(F.col("ord"), block).alias("digest"))
