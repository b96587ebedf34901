"""Verdict rules, consistency and roll-ups over verdicts derived from documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from policyloom import lexicons as lx
from policyloom.functions import text as tx
from policyloom.operators import analytics, consistency, rules
from policyloom.plans import brief, render
from policyloom.workload import base as b

KEYS = ["workspace_id", "dimension"]


def commitment_flags(spark, sf):
    """Topical, commitment and body flags per passage."""
    flagged = rules.commitment_flags(b.passages(spark, sf), b.LEXICON)
    return flagged.select("chunk_id", "topical", "strong", "verb", "weak", "body")


def _evidence(spark, sf):
    return rules.commitment_evidence(b.passages(spark, sf), b.LEXICON)


def commitment_evidence(spark, sf):
    return _evidence(spark, sf)


def ladder(spark, sf, floor=True):
    """Coverage after the two rungs; mechanisms count only where the document is not English."""
    own = b.verdicts(spark, sf).withColumn(
        "mechanisms", F.when(F.col("lang") == "en", F.array().cast("array<string>")).otherwise(F.col("mechanisms"))
    )
    return rules.validate_coverage(own, _evidence(spark, sf), b.LEXICON, floor)


def coverage_ladder(spark, sf):
    return ladder(spark, sf).select(*KEYS, "raw_coverage", "coverage", F.size("rule_notes").alias("notes"))


def coverage_ladder_no_floor(spark, sf):
    return ladder(spark, sf, False).select(*KEYS, "raw_coverage", "coverage")


def mechanism_classes(spark, sf):
    flags = tx.mechanism_flags(F.col("mechanisms"), b.LEXICON)
    return b.verdicts(spark, sf).select(*KEYS, *[f.alias(n) for n, f in flags.items()])


def maturity(spark, sf):
    return rules.with_maturity(b.verdicts(spark, sf), b.LEXICON).select(*KEYS, "coverage", "governance_maturity")


def risk_priority(spark, sf):
    judged = rules.with_risk_and_priority(b.verdicts(spark, sf))
    return judged.select(*KEYS, "cluster_gap", "risk_level", "risk_reason", "priority")


def confidence(spark, sf):
    scored = rules.confidence(b.line_evidence(spark, sf), b.verdicts(spark, sf))
    return scored.select(*KEYS, "quality", "diversity", "citation", "cross_source", "completeness", "confidence_score")


def synthesis_drift(spark, sf):
    judged = rules.downgrade_drift(b.verdicts(spark, sf), b.LEXICON)
    return judged.select(*KEYS, "drift_score", "synthesis_drift_downgraded", "coverage")


def covered_synthesis(spark, sf):
    """Fallback synthesis for Covered verdicts, naming the sources in order of appearance."""
    names = rules.ordered_framework_names(
        b.line_evidence(spark, sf).withColumn("framework", F.when(F.col("source") == "s0", "").otherwise(F.col("source")))
        .withColumn("slot", F.split_part("chunk_id", F.lit("-"), F.lit(2)).cast("int"))
    )
    covered = b.verdicts(spark, sf).filter(F.col("coverage") == "Covered").join(names, KEYS, "left")
    listed = F.coalesce("framework_names", F.array().cast("array<string>"))
    parts = rules.covered_synthesis(F.col("dimension"), listed, F.lit(" "), F.col("mechanisms"))
    joined = covered.withColumn("_s", parts)
    return joined.select(
        *KEYS, F.md5("_s.consensus").alias("consensus"), F.md5("_s.overall_assessment").alias("overall"),
        F.md5(rules.joined_synthesis(F.col("_s"))).alias("synthesis"),
    )


def tier_shapes(spark, sf):
    shaped = rules.shape_by_tier(b.verdicts(spark, sf))
    return shaped.select(
        *KEYS, "coverage", F.size("recommendations").alias("recommendations"),
        F.coalesce(F.size("best_practices.future_strengthening_opportunities"), F.lit(-1)).alias("opportunities"),
    )


def timelines(spark, sf):
    """Ranges of two phases; their numbers of steps are the text's words and its lines, modulo 9."""
    judged = rules.with_maturity(b.verdicts(spark, sf), b.LEXICON).filter(F.col("coverage").isin("Partial", "Missing"))
    counted = F.array(F.pmod(F.size(tx.words(F.col("synthesis"))), F.lit(9)), F.pmod(F.size("mechanisms"), F.lit(9)))
    grounding = F.when(F.col("lang") == "en", "document_named").when(F.col("lang") == "fr", "document_implied").otherwise(
        "none_identified"
    )
    n = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.size("mechanisms")).otherwise(0)
    bounds = rules.phase_bounds(F.col("coverage"), n, F.col("governance_maturity"), grounding, counted)
    return judged.select(*KEYS, F.posexplode(bounds).alias("_i", "b")).select(
        *KEYS, (F.col("_i") + 1).alias("phase"), F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"),
        rules.timeline_text(F.col("b")).alias("timeline"),
    )


def plausibility(spark, sf):
    """Seven ordered checks on cases counted from the documents."""
    strengths = F.array(*[F.lit(s) for s in rules.STRENGTH_SCORE])
    kinds = F.array(*[F.lit(k) for k in ("strategy", "legislation", "standard", "other")])
    cases = b.verdicts(spark, sf).select(
        *KEYS, F.pmod("doc_id", F.lit(6)).cast("int").alias("level"),
        F.when(F.col("coverage") == "Insufficient Evidence", "Missing").otherwise(F.col("coverage")).alias("coverage"),
        F.element_at(strengths, F.pmod(F.length("synthesis"), F.lit(5)) + 1).alias("strength"),
        F.element_at(kinds, F.pmod(F.size("mechanisms"), F.lit(4)) + 1).alias("document_type"),
        F.pmod(F.length("synthesis"), F.lit(2)).alias("n_explicit"), F.pmod(F.length("synthesis"), F.lit(3)).alias("n_implicit"),
        F.pmod(F.length("synthesis"), F.lit(4)).alias("n_strong"), F.pmod(F.length("synthesis"), F.lit(7)).alias("n_weak"),
        F.pmod(F.size("mechanisms"), F.lit(6)).alias("n_groups"),
        F.when(F.col("lang") == "en", "shown").otherwise("None").alias("demonstrated"),
    )
    done = rules.plausibility(cases)
    return done.select(
        *KEYS, F.array_join("checks_fired", ",").alias("checks"), "validated_level", "validated_coverage",
        "confidence_in_assessment",
    )


def framework_synthesis(spark, sf):
    """Positions backed by evidence, one per framework, as a line."""
    lines = b.passages(spark, sf)
    positions = lines.select(
        *KEYS, "chunk_id", F.col("line_no").alias("position_no"),
        F.concat(F.lit("f"), F.pmod("line_no", F.lit(3)).cast("string")).alias("framework"),
        F.col("text").alias("position"), F.when(F.pmod("line_no", F.lit(2)) == 0, F.col("text")).otherwise("").alias("supporting"),
    )
    evidence = lines.select(*KEYS, "chunk_id")
    return rules.framework_synthesis(positions, evidence)


def unfinished_dimensions(spark, sf):
    """Workspace dimensions without a completed result."""
    results = b.verdicts(spark, sf).filter(F.col("lang") != "de").select(
        *KEYS, F.when(F.col("analysis_error").isNotNull(), "failed").otherwise("completed").alias("status")
    )
    return rules.unfinished(b.verdicts(spark, sf).select(*KEYS), results)


def missing_dimensions(spark, sf):
    """Every dimension of every workspace, judged or not."""
    expected = b.keyed_documents(spark, sf).select("workspace_id").distinct().withColumn(
        "dimension", F.explode(F.array(*[F.lit(d) for d in b.DIMS]))
    )
    gaps = b.verdicts(spark, sf).filter(F.col("lang") != "de").select(
        *KEYS, "coverage", "analysis_error", F.lit("judged").alias("reason_flagged")
    )
    return rules.complete_dimensions(expected, gaps).select(*KEYS, "coverage", "reason_flagged")


def scope_texts(spark, sf):
    named = b.keyed_documents(spark, sf).select(
        "workspace_id", F.when(F.col("lang") == "en", F.col("source")).otherwise("").alias("document_name")
    )
    return rules.scope_disclaimer(named).select("workspace_id", "disclaimer")


def gaps(spark, sf):
    """Verdicts after risk, maturity, drift and confidence, as the roll-ups read them."""
    base = rules.with_maturity(rules.downgrade_drift(b.verdicts(spark, sf), b.LEXICON), b.LEXICON)
    judged = rules.with_risk_and_priority(base)
    scores = rules.confidence(b.line_evidence(spark, sf), b.verdicts(spark, sf)).select(*KEYS, "confidence_score", "confidence_method")
    return judged.join(scores, KEYS).withColumn("reason_flagged", F.concat(F.lit("coverage "), F.col("coverage"))).withColumn(
        "recommendation", F.get("recommendations", F.lit(0))
    ).withColumn("gap_found", F.col("coverage").isin("Partial", "Missing"))


def _checkable(spark, sf):
    """Verdicts on a wider set of dimensions, so that graph edges have both ends."""
    wide = {
        "Fairness": "Explainability", "Human Autonomy": "Human Oversight", "Inclusivity": "Data Protection",
        "Environmental Sustainability": "Liability",
    }
    renamed = F.coalesce(
        F.create_map(*[F.lit(v) for pair in wide.items() for v in pair])[F.col("dimension")], F.col("dimension")
    )
    even = F.pmod("workspace_id", F.lit(2)) == 0
    size = F.size("mechanisms")
    judged = rules.with_risk_and_priority(b.verdicts(spark, sf)).withColumn("dimension", F.when(even, renamed).otherwise(F.col("dimension")))
    return judged.select(
        "workspace_id", "dimension", "ord", "coverage", "risk_level", "synthesis",
        (size - 1).alias("n_evidence"), F.pmod(size, F.lit(3)).alias("n_named_evidence"),
        F.pmod(size, F.lit(2)).alias("n_positions"), F.pmod("doc_id", F.lit(7)).alias("doc_chunks"),
        F.when(F.col("lang") == "en", "").otherwise(F.get("recommendations", F.lit(0))).alias("recommendation"),
    )


def _violations(spark, sf):
    return consistency.violations(
        _checkable(spark, sf), consistency.edge_table(spark), consistency.subset_table(spark), b.LEXICON
    )


def consistency_violations(spark, sf):
    return _violations(spark, sf)


def consistency_report(spark, sf):
    workspaces = b.keyed_documents(spark, sf).select("workspace_id").distinct()
    return consistency.report(workspaces, _violations(spark, sf))


def confidence_penalty(spark, sf):
    scored = _checkable(spark, sf).select(*KEYS, (F.round(F.lit(0.55) + F.col("doc_chunks") / 20, 3)).alias("confidence_score"))
    return consistency.apply_penalty(scored, _violations(spark, sf))


def graph_closure(spark, sf):
    """Ancestor pairs of a graph over document numbers, cycles included."""
    docs = b.documents(spark, sf)
    step = lambda c: F.concat(F.lit("n"), F.pmod(c, F.lit(97)).cast("string"))
    edges = docs.select(step(F.col("doc_id")).alias("parent"), step(F.col("doc_id") * 5 + F.lit(1)).alias("child")).distinct()
    return consistency.closure(edges)


def graph_neighbours(spark, sf):
    docs = b.documents(spark, sf)
    edges = docs.select(
        F.col("source").alias("parent"), F.col("lang").alias("child"),
        F.when(F.col("lang") == "en", "requires").otherwise("subsumes").alias("rel"),
    ).distinct()
    return consistency.relationships(edges)


def decision_analytics(spark, sf):
    return analytics.decision_analytics(gaps(spark, sf))


def weakest_tier(spark, sf):
    return analytics.weakest_tier(gaps(spark, sf))


def radar(spark, sf):
    return analytics.radar(gaps(spark, sf))


def tier_statistics(spark, sf):
    return analytics.tier_statistics(gaps(spark, sf), F.array_join("recommendations", "|"))


def summaries(spark, sf):
    return analytics.summaries(gaps(spark, sf))


def risk_overview(spark, sf):
    return analytics.risk_overview(gaps(spark, sf)).select("workspace_id", "high", "medium", "low", "insufficient", "paragraph")


def precedents(spark, sf):
    """Incident names per workspace, distinct and in order of mention."""
    named = b.passages(spark, sf).select(
        "workspace_id", F.col("text").alias("incident_name"),
        (F.col("doc_id") * 10000 + F.col("line_no")).alias("ord"),
    )
    return analytics.precedents(named)


def methodology(spark, sf):
    """Scope and method paragraph per workspace."""
    named = b.keyed_documents(spark, sf).select(
        "workspace_id", F.when(F.col("lang") == "en", F.col("source")).otherwise("").alias("document_name")
    )
    scoped = rules.scope_disclaimer(named)
    used = b.keyed_documents(spark, sf).groupBy("workspace_id").agg(
        F.array_sort(F.collect_set("lang")).alias("frameworks"), F.count("*").alias("n")
    )
    text = analytics.methodology(F.col("disclaimer"), F.col("frameworks"), F.col("documents"), F.col("n"))
    return scoped.join(used, "workspace_id").select("workspace_id", F.md5(text).alias("digest"))


def run_telemetry(spark, sf):
    return analytics.run_telemetry(b.line_evidence(spark, sf), ["workspace_id"])


def flat_findings(spark, sf):
    """Nested analyses written as rows again, the module's value first."""
    nested = analytics.nested_analyses(gaps(spark, sf))
    flat = analytics.finding_rows(nested)
    return flat.select(*KEYS, "coverage", "governance_maturity", "risk_level", "priority", F.size("recommendations").alias("recommendations"))


def executive_briefs(spark, sf):
    rows = gaps(spark, sf)
    used = b.keyed_documents(spark, sf).groupBy("workspace_id").agg(
        F.array_sort(F.collect_set("source")).alias("frameworks_used"), F.sum(F.length("text")).alias("total_retrieved"),
        F.concat(F.lit("doc "), F.min("doc_id").cast("string")).alias("document_name"),
    )
    headers = used.join(analytics.summaries(rows), "workspace_id").withColumn(
        "analysis_id", F.col("workspace_id").cast("string")).withColumn("generated_at", F.lit("2024-01-01 00:00 UTC"))
    return render.executive_brief(rows, headers).select("workspace_id", F.length("brief").alias("chars"), F.md5("brief").alias("digest"))


def dimension_digest(spark, sf):
    return render.dimension_digest(gaps(spark, sf)).select("workspace_id", F.md5("digest").alias("digest"))


def coverage_labels(spark, sf):
    """Raw labels in odd spelling, normalised and shaped by tier."""
    n = F.pmod("doc_id", F.lit(5))
    raw = F.when(n == 0, F.upper("coverage")).when(n == 1, F.concat(F.lit("  "), F.lower("coverage"), F.lit("\n"))).when(
        n == 2, F.lit(None).cast("string")).when(n == 3, F.concat("coverage", F.lit("!"))).otherwise(F.col("coverage"))
    shaped = rules.shape_by_tier(rules.normalize_labels(b.verdicts(spark, sf).withColumn("coverage", raw)))
    return shaped.select(*KEYS, "coverage", F.size("recommendations").alias("recommendations"), F.col("best_practices").isNotNull().alias("has_practices"))


def drill_downs(spark, sf):
    """The reasoning trail of every finding with the lines that are its evidence."""
    lines = b.passages(spark, sf).where("line_no <= 3").select(
        *KEYS, (F.col("doc_id") * 10000 + F.col("line_no")).alias("ord"), F.when(F.pmod("line_no", F.lit(2)) == 0, "src").alias("framework"),
        F.col("line_no").cast("int").alias("page_number"), F.when(F.col("line_no") == 1, F.lit(None).cast("int")).otherwise(F.length("text")).alias("similarity"), "text",
    )
    # the confidence method is a string of rounded numbers with a query of its own
    found = gaps(spark, sf).withColumn("confidence_method", F.lit(None).cast("string"))
    return render.drill_down(found, lines).select(*KEYS, F.length("trail").alias("chars"), F.md5("trail").alias("digest"))


def assembled_briefs(spark, sf):
    """Structured briefs with their markdown; the dimensions stand for the model's narrative."""
    rows = gaps(spark, sf)
    names = lambda kept: F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("ord", "dimension")))), lambda x: x["dimension"])
    urgent = F.col("priority").isin("Critical", "High")
    advice = F.struct("ord", F.concat(F.lit(" "), F.coalesce("recommendation", F.lit(""))).alias("recommendation"), F.col("risk_reason").alias("rationale"))
    narrative = rows.groupBy("workspace_id").agg(
        F.concat(F.lit(" "), F.count("*").cast("string"), F.lit(" dimensions\n")).alias("executive_summary"),
        F.concat(names(F.col("coverage") == "Covered"), F.array(F.lit("  "))).alias("strengths"), names(F.col("coverage") != "Covered").alias("attention"),
        F.transform(F.array_sort(F.collect_list(F.when(urgent, advice))), lambda x: F.struct(x["recommendation"].alias("recommendation"), x["rationale"].alias("rationale"))).alias("recommendations"),
    ).where(F.pmod("workspace_id", F.lit(5)) != 4)
    docs = b.keyed_documents(spark, sf)
    scoped = rules.scope_disclaimer(docs.select("workspace_id", F.when(F.col("lang") == "en", F.col("source")).otherwise("").alias("document_name")))
    used = docs.groupBy("workspace_id").agg(F.array_sort(F.collect_set("lang")).alias("frameworks_used"))
    headers = scoped.join(used, "workspace_id").select(
        "workspace_id", F.lit("Utopia").alias("country"), F.concat(F.lit("Policy "), F.col("workspace_id").cast("string")).alias("policy_title"),
        "documents", "frameworks_used", "disclaimer", F.lit("2024-01-01 00:00 UTC").alias("generated_at"),
    )
    incidents = b.passages(spark, sf).where("line_no = 1 and doc_id % 3 = 0").select("workspace_id", F.col("text").alias("incident_name"), F.col("doc_id").alias("ord"))
    built = brief.assemble_briefs(headers, rows, narrative, incidents)
    counts = ("covered", "partial", "missing", "insufficient_evidence", "analysis_failed", "num_dimensions")
    return built.select("workspace_id", *counts).join(render.brief_markdown(built), "workspace_id").select(
        "workspace_id", *counts, F.length("markdown").alias("chars"), F.md5("markdown").alias("digest"))


def verdict_texts(spark, sf):
    return render.verdict_text(gaps(spark, sf)).select(*KEYS, F.md5("verdict_text").alias("digest"))


QUERIES = {f.__name__: f for f in (
    commitment_flags, commitment_evidence, coverage_ladder, coverage_ladder_no_floor, mechanism_classes, maturity,
    risk_priority, confidence, synthesis_drift, covered_synthesis, tier_shapes, timelines, plausibility,
    framework_synthesis, unfinished_dimensions, missing_dimensions, scope_texts, consistency_violations,
    consistency_report, confidence_penalty, graph_closure, graph_neighbours, decision_analytics, weakest_tier, radar,
    tier_statistics, summaries, risk_overview, precedents, methodology, run_telemetry, flat_findings, executive_briefs,
    dimension_digest, verdict_texts, coverage_labels, drill_downs, assembled_briefs,
)}


# -- SQL ---------------------------------------------------------------------

_LX = b.LEXICON
_PASS = b.PASSAGES_SQL[len(b.KEYED_SQL) + 2:]


def _commit_sql(name: str, phrases) -> str:
    """CTE of chunk ids with a phrase that no negator in the 16 characters before it denies."""
    alts = "|".join(phrases)
    neg = "|".join(_LX.negators)
    return rf"""{name} AS (
  SELECT DISTINCT chunk_id FROM (
    SELECT chunk_id, t, unnest(range(1, length(t) + 1)) AS i FROM low WHERE regexp_matches(t, '({alts})'))
  WHERE regexp_matches(substr(t, i, 40), '^({alts})s?($|[^\pL\pN_])')
    AND (i = 1 OR NOT regexp_matches(substr(t, i - 1, 1), '[\pL\pN_]'))
    AND NOT regexp_matches(substr(t, greatest(1, i - 16), i - greatest(1, i - 16)), '(^|\s)({neg})(\s+\S+)?\s*$'))"""


_FLAGS_SQL = f"""{b.PASSAGES_SQL},
low AS (SELECT chunk_id, lower(text) AS t FROM passages),
{_commit_sql('c_strong', _LX.strong)}, {_commit_sql('c_verb', _LX.verbs)}, {_commit_sql('c_weak', _LX.weak)},
flags AS (
  SELECT p.workspace_id, p.dimension, p.chunk_id, {b.topic_sql('p.text', 'p.dimension', _LX.topics)} AS topical,
         s.chunk_id IS NOT NULL AS strong, v.chunk_id IS NOT NULL AS verb, w.chunk_id IS NOT NULL AS weak,
         {b.word_sql('p.text', _LX.named_body)} AS body
  FROM passages p LEFT JOIN c_strong s USING (chunk_id) LEFT JOIN c_verb v USING (chunk_id) LEFT JOIN c_weak w USING (chunk_id))"""

_EVIDENCE_SQL = f"""{_FLAGS_SQL},
evid AS (
  SELECT workspace_id, dimension, count(*) AS doc_chunks, bool_or(topical AND (strong OR verb)) AS explicit_in_text,
         bool_or(topical AND body AND (strong OR weak)) OR count(*) FILTER (topical AND weak) >= 2 AS implementation_in_text
  FROM flags GROUP BY ALL)"""

_VERD = b.VERDICTS_SQL[len(b.KEYED_SQL) + 2:]
_OPER = "(" + " OR ".join(b.word_sql("v.text", w) for w in (_LX.named_body, _LX.reporting, _LX.enforcement)) + ")"


def _ladder_sql(floor: str) -> str:
    return f"""{_EVIDENCE_SQL}, {_VERD},
lad AS (
  SELECT v.*, coalesce(doc_chunks, 0) > 0 AS has, (lang <> 'en' AND {_OPER}) AS oper,
         coalesce(explicit_in_text, false) AS ex, coalesce(implementation_in_text, false) AS im
  FROM verdicts v LEFT JOIN evid USING (workspace_id, dimension)),
r1 AS (SELECT *, {floor} AND coverage = 'Missing' AND has AND (oper OR ex) AS raised FROM lad),
r2 AS (SELECT *, (coverage = 'Partial' OR raised) AND has AND (oper OR im) AS lifted FROM r1)"""


_MATURITY_SQL = f"""{b.VERDICTS_SQL},
mech AS (
  SELECT v.*, {b.word_sql('v.text', _LX.named_body)} AS nb, {b.word_sql('v.text', _LX.reporting)} AS rp,
         {b.word_sql('v.text', _LX.enforcement)} AS en FROM verdicts v)"""


def _stage(coverage: str) -> str:
    return (
        f"CASE WHEN {coverage} = 'Missing' AND NOT principle_acknowledged THEN 'Ad Hoc' WHEN {coverage} = 'Missing' THEN 'Developing' "
        f"WHEN {coverage} = 'Partial' AND (nb OR rp OR en) THEN 'Defined' WHEN {coverage} = 'Partial' THEN 'Developing' "
        "WHEN NOT (nb OR rp OR en) THEN 'Defined' WHEN en THEN 'Optimized' ELSE 'Managed' END"
    )


_CLUSTER = "CASE dimension " + " ".join(f"WHEN {b.quote(d)} THEN {c}" for d, c in lx.CLUSTERS.items()) + " END"
_CORE = "dimension IN (" + ", ".join(b.quote(d) for d in lx.CORE_DIMENSIONS) + ")"


def _risk_sql(source: str, name: str) -> str:
    return f"""{name}_c AS (
  SELECT *, sum((coverage <> 'Covered')::INT) OVER (PARTITION BY workspace_id, {_CLUSTER}) - (coverage <> 'Covered')::INT > 0 AS cluster_gap
  FROM {source}),
{name}_l AS (
  SELECT *, least(2, CASE coverage WHEN 'Covered' THEN 0 WHEN 'Partial' THEN CASE WHEN {_CORE} THEN 1 ELSE 0 END
            ELSE CASE WHEN {_CORE} THEN 2 ELSE 1 END END + CASE WHEN coverage <> 'Covered' AND cluster_gap THEN 1 ELSE 0 END) AS lv
  FROM {name}_c),
{name} AS (
  SELECT *, CASE WHEN coverage = 'Insufficient Evidence' THEN coverage ELSE (['Low', 'Medium', 'High'])[lv + 1] END AS risk_level,
    CASE WHEN coverage = 'Insufficient Evidence' THEN 'Insufficient evidence from reference frameworks.'
         WHEN coverage = 'Covered' THEN 'Policy adequately addresses this dimension.'
         ELSE CASE WHEN {_CORE} THEN 'Core' ELSE 'Supporting' END || ' dimension ''' || dimension || ''' ' ||
           CASE WHEN coverage = 'Partial' AND {_CORE} THEN 'is only partially addressed.' WHEN coverage = 'Partial' THEN 'is partially addressed.'
           ELSE 'is not addressed.' END || CASE WHEN cluster_gap THEN ' Risk compounded by related dimension gaps.' ELSE '' END END AS risk_reason,
    CASE WHEN coverage = 'Partial' THEN CASE WHEN cluster_gap THEN 'High' ELSE 'Medium' END
         WHEN coverage = 'Missing' THEN CASE WHEN cluster_gap THEN 'Critical' ELSE 'High' END END AS priority
  FROM {name}_l)"""


_CONF_SQL = """lev AS (
  SELECT workspace_id, dimension, 's' || (line_no % 7) AS source, round(length(text) / 400.0::DOUBLE, 6) AS similarity,
         length(text) % 2 = 0 AS verified, chunk_id FROM passages),
tot AS (
  SELECT workspace_id, dimension, count(*) AS n, avg(similarity) FILTER (similarity BETWEEN 0 AND 1) AS q,
         count(*) FILTER (verified) AS ok, count(DISTINCT source) AS src FROM lev GROUP BY ALL),
fac AS (
  SELECT v.workspace_id, v.dimension, n, coalesce(round(round(q, 9), 3), 0.3::DOUBLE) AS quality,
         round(least(1.0::DOUBLE, src::DOUBLE / greatest(5, n) * 2), 3) AS diversity, round(ok::DOUBLE / n, 3) AS citation,
         round(src::DOUBLE / n, 3) AS cross_source,
         CASE v.coverage WHEN 'Covered' THEN 0.8::DOUBLE WHEN 'Partial' THEN 0.5 WHEN 'Missing' THEN 0.3 ELSE 0.1 END AS completeness
  FROM verdicts v LEFT JOIN tot USING (workspace_id, dimension)),
conf AS (
  SELECT *, CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE round(pow(
    greatest(quality, 0.001) * greatest(diversity, 0.001) * 0.5 * 0.5 * greatest(citation, 0.001) * greatest(cross_source, 0.001)
    * greatest(completeness, 0.001), 1.0::DOUBLE / 7), 4) END AS confidence_score FROM fac)"""

_DRIFT_SCORE = (
    " + ".join(f"CASE WHEN contains(lower(text), {b.quote(p)}) THEN 3 ELSE 0 END" for p in _LX.drift_strong) + " + "
    + " + ".join(f"CASE WHEN contains(lower(text), {b.quote(p)}) THEN 1 ELSE 0 END" for p in _LX.drift_soft_phrases)
    + " + len(list_filter(regexp_extract_all(lower(text), '[\\pL\\pN_]+'), lambda w: w IN ("
    + ", ".join(b.quote(w) for w in _LX.drift_soft_words) + ")))"
)

_GAPS_SQL = f"""{b.PASSAGES_SQL}, {_VERD},
dr AS (SELECT *, CASE WHEN coverage = 'Covered' THEN {_DRIFT_SCORE} ELSE 0 END AS drift_score FROM verdicts),
dg AS (SELECT * REPLACE (CASE WHEN drift_score >= 3 THEN 'Partial' ELSE coverage END AS coverage), drift_score >= 3 AS drifted FROM dr),
mt AS (
  SELECT v.*, {b.word_sql('v.text', _LX.named_body)} AS nb, {b.word_sql('v.text', _LX.reporting)} AS rp,
         {b.word_sql('v.text', _LX.enforcement)} AS en FROM dg v),
ms AS (SELECT *, {_stage('coverage')} AS stage FROM mt),
{_risk_sql('ms', 'rk')}, {_CONF_SQL},
g AS (SELECT rk.*, confidence_score FROM rk JOIN conf USING (workspace_id, dimension)),
ga AS (
  SELECT *, coverage IN ('Covered', 'Partial', 'Missing') AS assessed,
    list_position({b.sql_list(lx.MATURITY_STAGES)}, stage) - 1 AS sr,
    CASE priority WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 END AS pr FROM g)"""


def _names(condition: str, order: str) -> str:
    return f"coalesce(string_agg(dimension, ', ' ORDER BY {order}) FILTER ({condition}), '')"


_WIDE = "CASE WHEN workspace_id % 2 = 0 THEN CASE dimension WHEN 'Fairness' THEN 'Explainability' WHEN 'Human Autonomy' THEN " \
        "'Human Oversight' WHEN 'Inclusivity' THEN 'Data Protection' WHEN 'Environmental Sustainability' THEN 'Liability' " \
        "ELSE dimension END ELSE dimension END"
_VIOLATIONS_SQL = f"""{b.VERDICTS_SQL}, {_risk_sql('verdicts', 'rk')},
cg AS (
  SELECT workspace_id, {_WIDE} AS dimension, ord, coverage, risk_level, text, doc_id % 7 AS doc_chunks,
         len(string_split(text, chr(10))) - 1 AS ne, len(string_split(text, chr(10))) % 3 AS nn,
         len(string_split(text, chr(10))) % 2 AS np,
         CASE WHEN lang = 'en' THEN '' ELSE string_split(text, chr(10))[1] END AS rec FROM rk),
edges(parent, child) AS (VALUES {b.values((p, c) for p, c, _ in lx.GRAPH_EDGES)}),
subs(parent, child) AS (VALUES {b.values(lx.SUBSET_EDGES)}),
ends AS (
  SELECT p.workspace_id, e.parent, e.child, p.coverage AS pc, c.coverage AS cc, p.ord AS po, c.ord AS co
  FROM edges e JOIN cg p ON p.dimension = e.parent JOIN cg c ON c.dimension = e.child AND c.workspace_id = p.workspace_id),
sends AS (
  SELECT p.workspace_id, e.parent, e.child, p.coverage AS pc, c.coverage AS cc
  FROM subs e JOIN cg p ON p.dimension = e.parent JOIN cg c ON c.dimension = e.child AND c.workspace_id = p.workspace_id),
vio AS (
  SELECT workspace_id, dimension, 'risk_coverage_mismatch' AS violation_type, 'error' AS severity, risk_level AS related FROM cg
  WHERE (coverage = 'Partial' AND risk_level NOT IN ('Low', 'Medium')) OR (coverage = 'Missing' AND risk_level NOT IN ('Medium', 'High'))
  UNION ALL SELECT workspace_id, dimension, 'missing_evidence', 'error', '' FROM cg WHERE coverage <> 'Insufficient Evidence' AND ne = 0
  UNION ALL SELECT workspace_id, dimension, 'missing_framework_evidence', 'warning', '' FROM cg
  WHERE coverage IN ('Missing', 'Partial') AND ne > 0 AND nn = 0
  UNION ALL SELECT workspace_id, dimension, 'recommendation_missing', 'warning', '' FROM cg
  WHERE coverage <> 'Insufficient Evidence' AND ne > 0 AND np > 0 AND rec = ''
  UNION ALL SELECT workspace_id, dimension, 'zero_doc_retrieval', 'warning', '' FROM cg
  WHERE coverage <> 'Insufficient Evidence' AND doc_chunks = 0
  UNION ALL SELECT workspace_id, dimension, 'synthesis_recommendation_collision', 'warning', '' FROM cg WHERE text <> '' AND text = rec
  UNION ALL SELECT workspace_id, dimension, 'covered_synthesis_drift', 'warning', '' FROM cg WHERE coverage = 'Covered' AND {_DRIFT_SCORE} > 0
  UNION ALL SELECT workspace_id, parent, 'graph_child_not_covered', 'warning', child FROM ends WHERE po < co AND pc = 'Covered' AND cc <> 'Covered'
  UNION ALL SELECT workspace_id, child, 'graph_child_covered_but_parent_missing', 'error', parent FROM ends
  WHERE po >= co AND cc = 'Covered' AND pc IN ('Missing', 'Partial')
  UNION ALL SELECT workspace_id, parent, 'subset_inconsistency', 'error', child FROM sends WHERE cc = 'Covered' AND pc IN ('Missing', 'Partial')
  UNION ALL SELECT workspace_id, parent, 'missing_sub_elements', 'warning', string_agg(child, ', ' ORDER BY child) FROM sends
  WHERE pc = 'Covered' AND cc <> 'Covered' GROUP BY workspace_id, parent)"""

_SCOPE_SQL = f"""{b.KEYED_SQL},
nm AS (SELECT workspace_id, list_sort(list(DISTINCT source) FILTER (lang = 'en')) AS docs FROM keyed GROUP BY 1),
sc AS (
  SELECT workspace_id, coalesce(docs, []) AS docs, 'Scope: this assessment evaluates ' ||
    CASE WHEN len(coalesce(docs, [])) = 1 THEN 'the provided document (' || array_to_string(docs, ', ') || ')'
         WHEN len(docs) > 1 THEN 'the provided documents (' || array_to_string(docs, ', ') || ')'
         ELSE 'the document(s) provided to the system' END ||
    '. It is not an assessment of the country''s complete AI governance apparatus — governance instruments not provided to the system are outside this evaluation, and coverage verdicts should be read as relative to the evidence supplied.' AS disclaimer
  FROM nm)"""

_SUMMARY = f"""concat_ws(' ', 'Analysis of ' || count(*) || ' governance dimensions:',
  count(*) FILTER (coverage = 'Covered') || ' Fully Covered, ' || count(*) FILTER (coverage = 'Partial') || ' Partially Covered, ' ||
    count(*) FILTER (coverage = 'Missing') || ' Missing.',
  CASE WHEN count(*) FILTER (risk_level IN ('High', 'Medium')) > 0 THEN 'Risk levels: ' || count(*) FILTER (risk_level = 'High') ||
    ' high-risk, ' || count(*) FILTER (risk_level = 'Medium') || ' medium-risk.' END,
  CASE WHEN count(analysis_error) > 0 THEN count(analysis_error) || ' dimension(s) could not be analysed (' ||
    {_names('analysis_error IS NOT NULL', 'ord')} || '): provider quota exhausted.' END,
  CASE WHEN count(*) FILTER (risk_level = 'Insufficient Evidence' AND analysis_error IS NULL) > 0 THEN
    count(*) FILTER (risk_level = 'Insufficient Evidence' AND analysis_error IS NULL) || ' dimensions had insufficient evidence.' END,
  CASE WHEN count(*) FILTER (coverage = 'Missing') > 0 THEN 'Missing: ' || {_names("coverage = 'Missing'", 'ord')} || '.' END,
  CASE WHEN count(*) FILTER (coverage = 'Partial') > 0 THEN 'Partial: ' || {_names("coverage = 'Partial'", 'ord')} || '.' END)"""

_n10 = "chr(10)"
_URGENT = "priority IN ('Critical', 'High')"

ORACLE = {
    "commitment_flags": f"WITH {_FLAGS_SQL} SELECT chunk_id, topical, strong, verb, weak, body FROM flags",
    "commitment_evidence": f"WITH {_EVIDENCE_SQL} SELECT * FROM evid",
    "coverage_ladder": f"""WITH {_ladder_sql('true')}
SELECT workspace_id, dimension, coverage AS raw_coverage, CASE WHEN lifted THEN 'Covered' WHEN raised THEN 'Partial' ELSE coverage END AS coverage,
       raised::INT + lifted::INT AS notes FROM r2""",
    "coverage_ladder_no_floor": f"""WITH {_ladder_sql('false')}
SELECT workspace_id, dimension, coverage AS raw_coverage, CASE WHEN lifted THEN 'Covered' ELSE coverage END AS coverage FROM r2""",
    "mechanism_classes": f"""WITH {_MATURITY_SQL}
SELECT workspace_id, dimension, nb AS has_named_body, rp AS has_reporting, en AS has_enforcement, nb OR rp OR en AS has_operational FROM mech""",
    "maturity": f"WITH {_MATURITY_SQL} SELECT workspace_id, dimension, coverage, {_stage('coverage')} AS governance_maturity FROM mech",
    "risk_priority": f"""WITH {b.VERDICTS_SQL}, {_risk_sql('verdicts', 'rk')}
SELECT workspace_id, dimension, cluster_gap, risk_level, risk_reason, priority FROM rk""",
    "confidence": f"""WITH {b.PASSAGES_SQL}, {_VERD}, {_CONF_SQL}
SELECT workspace_id, dimension, quality, diversity, citation, cross_source, completeness, confidence_score FROM conf""",
    "synthesis_drift": f"""WITH {b.VERDICTS_SQL},
d AS (SELECT *, CASE WHEN coverage = 'Covered' THEN {_DRIFT_SCORE} ELSE 0 END AS s FROM verdicts)
SELECT workspace_id, dimension, s AS drift_score, s >= 3 AS synthesis_drift_downgraded,
       CASE WHEN s >= 3 THEN 'Partial' ELSE coverage END AS coverage FROM d""",
    "covered_synthesis": f"""WITH {b.PASSAGES_SQL}, {_VERD},
fs AS (SELECT workspace_id, dimension, 's' || (line_no % 7) AS s, min(line_no) AS l FROM passages WHERE line_no % 7 <> 0 GROUP BY ALL),
nm AS (SELECT workspace_id, dimension, string_agg(s, ', ' ORDER BY l) AS names FROM fs GROUP BY ALL),
t AS (
  SELECT v.workspace_id, v.dimension, 'The frameworks assessed for this dimension (' || coalesce(names, 'the international frameworks assessed') ||
    ') collectively require ' || v.dimension || ' to be governed in AI systems — clear allocation of responsibility, oversight of AI outcomes, and accountability for harms.' AS c,
    'They differ in emphasis: normative instruments frame this as a principle or rights obligation, while practical toolkits specify the concrete mechanisms (reporting, audits, redress) that give it effect.' AS d,
    'The uploaded policy already satisfies this expectation: the ' || v.dimension || ' principle is given operational effect in the document — ' ||
    coalesce(nullif({b.strip_sql("array_to_string(list_slice(string_split(v.text, chr(10)), 1, 3), '; ')")}, ''), 'the document''s stated commitments') ||
    ' — so the policy substantively meets the international requirement.' AS o
  FROM verdicts v LEFT JOIN nm USING (workspace_id, dimension) WHERE coverage = 'Covered')
SELECT workspace_id, dimension, md5(c) AS consensus, md5(o) AS overall,
       md5('Consensus: ' || c || chr(10) || chr(10) || 'Differences: ' || d || chr(10) || chr(10) || 'Overall assessment: ' || o) AS synthesis FROM t""",
    "tier_shapes": f"""WITH {b.VERDICTS_SQL}
SELECT workspace_id, dimension, coverage, CASE WHEN coverage = 'Covered' THEN 0 ELSE len(string_split(text, chr(10))) END AS recommendations,
       CASE WHEN coverage = 'Covered' THEN least(3, len(string_split(text, chr(10)))) ELSE -1 END AS opportunities FROM verdicts""",
    "timelines": f"""WITH {_MATURITY_SQL},
p AS (
  SELECT *, {_stage('coverage')} AS stage, string_split(text, chr(10)) AS ls,
    CASE WHEN coverage = 'Missing' THEN 12 ELSE 6 END AS base,
    CASE WHEN doc_id % 2 = 0 THEN -2 ELSE 0 END AS eased,
    CASE lang WHEN 'en' THEN -2 WHEN 'fr' THEN -1 ELSE 3 END AS own
  FROM mech WHERE coverage IN ('Partial', 'Missing')),
s AS (SELECT *, CASE WHEN stage IN ('Ad Hoc', 'Developing') THEN 3 WHEN stage IN ('Managed', 'Optimized') THEN -2 ELSE 0 END AS pace,
        len({b.tokens_sql(b.strip_sql('text'))}) % 9 AS n1, len(ls) % 9 AS n2 FROM p),
a AS (SELECT *, greatest(3, base + pace + eased + own + CASE WHEN n1 >= 6 THEN 3 WHEN n1 <= 2 THEN -1 ELSE 0 END) AS h1 FROM s),
bb AS (SELECT *, greatest(h1 + 3, h1 + base + pace + eased + CASE WHEN n2 >= 6 THEN 3 WHEN n2 <= 2 THEN -1 ELSE 0 END) AS h2 FROM a)
SELECT workspace_id, dimension, 1 AS phase, 0 AS lo, h1 AS hi, '0-' || h1 || ' months' AS timeline FROM bb
UNION ALL SELECT workspace_id, dimension, 2, h1, h2, h1 || '-' || h2 || ' months' FROM bb""",
    "plausibility": f"""WITH {b.VERDICTS_SQL},
c0 AS (
  SELECT workspace_id, dimension, (doc_id % 6)::INT AS l0, CASE WHEN coverage = 'Insufficient Evidence' THEN 'Missing' ELSE coverage END AS v0,
    ({b.sql_list(rules.STRENGTH_SCORE)})[length(text) % 5 + 1] AS strength,
    (['strategy', 'legislation', 'standard', 'other'])[len(string_split(text, chr(10))) % 4 + 1] AS dt,
    length(text) % 2 AS ne, length(text) % 3 AS ni, length(text) % 4 AS ns, length(text) % 7 AS nw,
    len(string_split(text, chr(10))) % 6 AS ng, lang = 'en' AS shown FROM verdicts),
c1 AS (SELECT *, ne + ni + ns > 0 AS ev, dt = 'strategy' AND v0 = 'Missing' AND ne + ni + ns > 0 AS f1 FROM c0),
c2 AS (SELECT *, CASE WHEN f1 THEN greatest(l0, 1) ELSE l0 END AS l1, CASE WHEN f1 THEN 'Partial' ELSE v0 END AS v1 FROM c1),
c3 AS (SELECT *, (['Missing', 'Partial', 'Partial', 'Covered', 'Covered', 'Covered'])[l1 + 1] AS x, v1 <> (['Missing', 'Partial', 'Partial', 'Covered', 'Covered', 'Covered'])[l1 + 1] AS f2 FROM c2),
c4 AS (SELECT *, x AS v2, l1 = 0 AND ev AS f3 FROM c3),
c5 AS (SELECT *, CASE WHEN f3 THEN 1 ELSE l1 END AS l3, CASE WHEN f3 THEN 'Partial' ELSE v2 END AS v3 FROM c4),
c6 AS (SELECT *, v3 = 'Missing' AND ev AS f4 FROM c5),
c7 AS (SELECT *, CASE WHEN f4 THEN greatest(l3, 1) ELSE l3 END AS l4, CASE WHEN f4 THEN 'Partial' ELSE v3 END AS v4 FROM c6),
c8 AS (SELECT *, l4 = 5 AND (strength <> 'Strongly Operationalised' OR ns = 0) AS f5 FROM c7),
c9 AS (SELECT *, CASE WHEN f5 THEN 4 ELSE l4 END AS l5, CASE WHEN f5 THEN 'Covered' ELSE v4 END AS v5 FROM c8),
c10 AS (SELECT *, dt = 'strategy' AND l5 < 2 AND ng > 2 AS f6 FROM c9),
c11 AS (SELECT *, CASE WHEN f6 THEN 2 ELSE l5 END AS l6, CASE WHEN f6 THEN 'Partial' ELSE v5 END AS v6 FROM c10),
c12 AS (SELECT *, v6 = 'Missing' AND shown AS f7, v6 = 'Missing' AND NOT shown AND ni > 0 AS f8 FROM c11),
c13 AS (SELECT *, CASE WHEN f7 OR f8 THEN greatest(l6, 1) ELSE l6 END AS l7, CASE WHEN f7 OR f8 THEN 'Partial' ELSE v6 END AS v7,
  f1::INT + f2::INT + f3::INT + f4::INT + f5::INT + f6::INT + f7::INT + f8::INT AS nf,
  CASE strength {' '.join(f"WHEN {b.quote(k)} THEN {v}::DOUBLE" for k, v in rules.STRENGTH_SCORE.items())} END AS b0 FROM c12),
c14 AS (SELECT *, CASE WHEN ne > 0 THEN least(1.0, b0 + 0.1) ELSE b0 END AS b1 FROM c13),
c15 AS (SELECT *, CASE WHEN nw > 0 AND ne = 0 THEN greatest(0.1, b1 - 0.1) ELSE b1 END AS b2 FROM c14),
c16 AS (SELECT *, round(CASE WHEN nf > 1 THEN greatest(0.1, b2 - nf * 0.05::DOUBLE) ELSE b2 END, 6) AS b3 FROM c15)
SELECT workspace_id, dimension, concat_ws(',', CASE WHEN f1 THEN 'doc_type' END, CASE WHEN f2 THEN 'ladder' END, CASE WHEN f3 THEN 'functional_equiv' END,
  CASE WHEN f4 THEN 'level0' END, CASE WHEN f5 THEN 'level5' END, CASE WHEN f6 THEN 'distributed' END, CASE WHEN f7 THEN 'missing_final' END,
  CASE WHEN f8 THEN 'missing_implicit' END) AS checks, l7 AS validated_level, v7 AS validated_coverage,
  CASE WHEN b3 >= 0.7 THEN 'High' WHEN b3 >= 0.4 THEN 'Medium' ELSE 'Low' END AS confidence_in_assessment FROM c16""",
    "framework_synthesis": f"""WITH {b.PASSAGES_SQL},
f AS (
  SELECT workspace_id, dimension, 'f' || (line_no % 3) AS fw, min(line_no) AS l, arg_min(text, line_no) AS t FROM passages GROUP BY ALL)
SELECT workspace_id, dimension, string_agg(fw || ': ' || t ||
  CASE WHEN l % 2 = 0 THEN ' ("' || t || '")' ELSE '' END, ' | ' ORDER BY l) AS synthesis FROM f GROUP BY ALL""",
    "unfinished_dimensions": f"""WITH {b.VERDICTS_SQL}
SELECT workspace_id, dimension FROM verdicts WHERE lang = 'de' OR analysis_error IS NOT NULL""",
    "missing_dimensions": f"""WITH {b.VERDICTS_SQL},
e AS (SELECT DISTINCT workspace_id, unnest({b.sql_list(b.DIMS)}) AS dimension FROM keyed)
SELECT e.workspace_id, e.dimension, coalesce(coverage, 'Insufficient Evidence') AS coverage,
  CASE WHEN analysis_error IS NOT NULL THEN 'Analysis failed: ' || analysis_error
       WHEN coverage IS NULL THEN 'Insufficient evidence retrieved from reference frameworks.' ELSE 'judged' END AS reason_flagged
FROM e LEFT JOIN (SELECT * FROM verdicts WHERE lang <> 'de') v USING (workspace_id, dimension)""",
    "scope_texts": f"WITH {_SCOPE_SQL} SELECT workspace_id, disclaimer FROM sc",
    "consistency_violations": f"WITH {_VIOLATIONS_SQL} SELECT * FROM vio",
    "consistency_report": f"""WITH {_VIOLATIONS_SQL},
n AS (SELECT workspace_id, count(*) AS k, count(*) FILTER (severity = 'error') AS e FROM vio GROUP BY 1)
SELECT workspace_id, coalesce(k, 0) AS violation_count, coalesce(e, 0) AS error_count,
       round(greatest(0.0::DOUBLE, 1.0 - coalesce(k, 0) * 0.15::DOUBLE), 2) AS consistency_score, k IS NULL AS consistency_passed
FROM (SELECT DISTINCT workspace_id FROM keyed) LEFT JOIN n USING (workspace_id)""",
    "confidence_penalty": f"""WITH {_VIOLATIONS_SQL},
n AS (SELECT workspace_id, dimension, count(*) AS e FROM vio WHERE severity = 'error' GROUP BY ALL),
s0 AS (SELECT cg.workspace_id, cg.dimension, coalesce(e, 0) AS e, round(0.55::DOUBLE + doc_chunks / 20, 3) AS s FROM cg LEFT JOIN n USING (workspace_id, dimension)),
s1 AS (SELECT *, CASE WHEN e >= 1 AND s > 0.5 THEN round(s * 0.8::DOUBLE, 3) ELSE s END AS a FROM s0),
s2 AS (SELECT *, CASE WHEN e >= 2 AND a > 0.5 THEN round(a * 0.8::DOUBLE, 3) ELSE a END AS b2 FROM s1),
s3 AS (SELECT *, CASE WHEN e >= 3 AND b2 > 0.5 THEN round(b2 * 0.8::DOUBLE, 3) ELSE b2 END AS c FROM s2)
SELECT workspace_id, dimension, CASE WHEN e >= 4 AND c > 0.5 THEN round(c * 0.8::DOUBLE, 3) ELSE c END AS confidence_score FROM s3""",
    "graph_closure": """WITH RECURSIVE e AS (
  SELECT 'n' || (doc_id % 97) AS parent, 'n' || ((doc_id * 5 + 1) % 97) AS child FROM documents GROUP BY ALL),
c AS (SELECT parent AS ancestor, child AS descendant FROM e
      UNION SELECT c.ancestor, e.child FROM c JOIN e ON e.parent = c.descendant)
SELECT * FROM c""",
    "graph_neighbours": """WITH e AS (SELECT DISTINCT source AS p, lang AS c FROM documents)
SELECT p AS node, 'children' AS relation, c AS other FROM e UNION ALL SELECT c, 'parents', p FROM e
UNION ALL SELECT p, 'requires', c FROM e WHERE c = 'en' UNION ALL SELECT c, 'required_by', p FROM e WHERE c = 'en'""",
    "decision_analytics": f"""WITH {_GAPS_SQL}
SELECT workspace_id, count(*) FILTER (coverage = 'Covered') AS covered, count(*) FILTER (coverage = 'Partial') AS partial,
  count(*) FILTER (coverage = 'Missing') AS missing,
  count(*) FILTER (coverage = 'Insufficient Evidence' AND analysis_error IS NULL) AS insufficient_evidence,
  count(analysis_error) AS analysis_failed, count(*) FILTER (assessed) AS assessed_dimensions,
  coalesce(({b.sql_list(lx.MATURITY_STAGES)})[min(sr) FILTER (assessed) + 1], 'Not Assessed') AS overall_governance_maturity,
  coalesce(round(100.0::DOUBLE * sum(sr) FILTER (assessed) / (4 * count(*) FILTER (assessed)), 1), 0) AS maturity_index,
  count(*) FILTER (assessed AND sr = 0) AS stage_ad_hoc, count(*) FILTER (assessed AND sr = 1) AS stage_developing,
  count(*) FILTER (assessed AND sr = 2) AS stage_defined, count(*) FILTER (assessed AND sr = 3) AS stage_managed,
  count(*) FILTER (assessed AND sr = 4) AS stage_optimized,
  coalesce(round(round(sum(confidence_score) FILTER (assessed) / count(*) FILTER (assessed), 9), 3), 0) AS average_confidence,
  {_names(_URGENT, 'pr, ord')} AS highest_priority_dimensions,
  coalesce(arg_max(dimension, sr * 1000000.0 + confidence_score * 10000 - ord / 10.0) FILTER (assessed), '') AS strongest_dimension,
  {_names('drifted', 'ord')} AS synthesis_drift_downgraded, count(*) FILTER (drifted) AS synthesis_drift_downgraded_count
FROM ga GROUP BY workspace_id""",
    "weakest_tier": f"""WITH {_GAPS_SQL},
a AS (SELECT *, CASE coverage WHEN 'Missing' THEN 0 WHEN 'Partial' THEN 1 ELSE 2 END AS t FROM ga WHERE assessed AND analysis_error IS NULL),
w AS (SELECT * FROM a QUALIFY t = min(t) OVER (PARTITION BY workspace_id))
SELECT workspace_id, CASE WHEN bool_or(coalesce({_URGENT}, false)) THEN {_names(_URGENT, 'coalesce(pr, 9), ord')}
       ELSE {_names('true', 'coalesce(pr, 9), ord')} END AS weakest_dimensions
FROM w WHERE t < 2 GROUP BY workspace_id""",
    "radar": f"""WITH {_GAPS_SQL},
v AS (SELECT *, CASE WHEN coverage = 'Insufficient Evidence' OR analysis_error IS NOT NULL THEN 0 WHEN coverage = 'Covered' THEN 100
      WHEN coverage = 'Partial' THEN 66 ELSE 33 END AS r FROM ga)
SELECT workspace_id, count(*) FILTER (coverage = 'Insufficient Evidence' OR analysis_error IS NOT NULL) AS not_assessed,
{', '.join(f"max(r) FILTER (dimension = {b.quote(d)}) AS {d.lower().replace(' ', '_')}" for d in b.DIMS)} FROM v GROUP BY workspace_id""",
    "tier_statistics": f"""WITH {_GAPS_SQL}
SELECT coverage, count(*) AS count, sum(length(text))::BIGINT AS payload_chars, round(sum(length(text))::DOUBLE / count(*), 1) AS payload_avg_chars
FROM g GROUP BY coverage""",
    "summaries": f"WITH {_GAPS_SQL} SELECT workspace_id, {_SUMMARY} AS summary FROM ga GROUP BY workspace_id",
    "risk_overview": f"""WITH {_GAPS_SQL},
r AS (SELECT workspace_id, count(*) AS n, count(*) FILTER (risk_level = 'High') AS high, count(*) FILTER (risk_level = 'Medium') AS medium,
  count(*) FILTER (risk_level = 'Low') AS low, count(*) FILTER (risk_level = 'Insufficient Evidence') AS insufficient,
  count(*) FILTER ({_URGENT}) AS u, {_names(_URGENT, 'pr, ord')} AS names FROM ga GROUP BY 1)
SELECT workspace_id, high, medium, low, insufficient, 'The analysis assessed ' || n || ' dimension(s). Risk distribution: ' || high || ' High, ' ||
  medium || ' Medium, ' || low || ' Low, ' || insufficient || ' Insufficient Evidence.' ||
  CASE WHEN u > 0 THEN ' High-priority dimensions: ' || names || '.' ELSE '' END ||
  CASE WHEN u >= 2 THEN ' Multiple dimensions share the highest priority — compounding risk across these dimensions raises the urgency of coordinated, sequenced implementation.'
       WHEN u = 1 THEN ' Single highest-priority dimension — sequencing should begin there before related clusters are addressed.' ELSE '' END AS paragraph
FROM r""",
    "precedents": f"""WITH {b.PASSAGES_SQL},
f AS (SELECT workspace_id, trim(text) AS name, min(doc_id * 10000 + line_no) AS at_ FROM passages GROUP BY ALL),
n AS (SELECT workspace_id, count(*) AS k, string_agg(trim(name), ', ' ORDER BY at_) AS names FROM f WHERE trim(name) <> '' GROUP BY 1)
SELECT workspace_id, CASE WHEN k = 1 THEN 'The analysis matched one real-world incident as illustrative context (' || names
  ELSE 'The analysis matched ' || k || ' real-world incidents as illustrative context (' || names END ||
  '); the full report carries the case-study detail.' AS precedent FROM n""",
    "methodology": f"""WITH {_SCOPE_SQL},
u AS (SELECT workspace_id, list_sort(list(DISTINCT lang)) AS f, count(*) AS n FROM keyed GROUP BY 1)
SELECT workspace_id, md5(concat_ws(chr(10) || chr(10), disclaimer, 'This brief synthesizes the already-computed analysis of ' || n ||
  ' governance dimensions evaluated against ' || len(f) || ' reference framework(s): ' || array_to_string(f, ', ') || '.',
  CASE WHEN len(docs) > 0 THEN 'Source input(s): ' || array_to_string(docs, ', ') || '.' END)) AS digest FROM sc JOIN u USING (workspace_id)""",
    "run_telemetry": f"""WITH {b.PASSAGES_SQL},
l AS (SELECT workspace_id, round(length(text) / 400.0::DOUBLE, 6) AS s FROM passages)
SELECT workspace_id, count(*) AS retrieval_count, round(round(avg(s), 9), 6) AS avg_similarity, min(s) AS min_similarity, max(s) AS max_similarity
FROM l GROUP BY 1""",
    "flat_findings": f"""WITH {_GAPS_SQL}
SELECT workspace_id, dimension, coverage, stage AS governance_maturity, risk_level, priority, len(string_split(text, chr(10))) AS recommendations FROM g""",
    "executive_briefs": f"""WITH {_GAPS_SQL},
sm AS (SELECT workspace_id, {_SUMMARY} AS summary FROM ga GROUP BY 1),
u AS (SELECT workspace_id, list_sort(list(DISTINCT source)) AS f, sum(length(text))::BIGINT AS t, min(doc_id) AS d FROM keyed GROUP BY 1),
ln AS (
  SELECT *, coverage IN ('Partial', 'Missing') AS gf, string_split(text, chr(10))[1] AS rec,
    '  [' || risk_level || '] ' || dimension || chr(10) || '  ' || repeat('─', 40) || chr(10) || '  Coverage: ' || coverage || chr(10) ||
    '  Gap identified: ' || CASE WHEN coverage IN ('Partial', 'Missing') THEN 'Yes' ELSE 'No' END || chr(10) ||
    '  Assessment: coverage ' || coverage || CASE WHEN risk_level <> 'Insufficient Evidence' THEN chr(10) || '  Risk: ' || risk_reason ELSE '' END ||
    CASE WHEN string_split(text, chr(10))[1] <> '' THEN chr(10) || '  Recommendation: ' || string_split(text, chr(10))[1] ELSE '' END || chr(10) AS finding
  FROM ga),
bd AS (
  SELECT workspace_id, string_agg(finding, chr(10) ORDER BY ord) AS findings,
    {', '.join(f"'  {label}: ' || count(*) FILTER (risk_level = '{v}') || ' — ' || coalesce(string_agg(dimension, ', ' ORDER BY ord) FILTER (risk_level = '{v}'), 'None') AS r{i}" for i, (label, v) in enumerate((('High Risk', 'High'), ('Medium Risk', 'Medium'), ('Low Risk', 'Low'), ('Insufficient Evidence', 'Insufficient Evidence'))))},
    coalesce(string_agg('  ' || (ord + 1) || '. ' || dimension || ': ' || rec, chr(10) ORDER BY ord) FILTER (gf), '') AS recs
  FROM ln GROUP BY 1),
br AS (
  SELECT workspace_id, concat_ws(chr(10), repeat('=', 72) || chr(10) || 'EXECUTIVE BRIEF — AI Policy Gap Analysis' || chr(10) || repeat('=', 72) || chr(10),
    'Document analyzed: doc ' || d, 'Analysis ID: ' || workspace_id, 'Date: 2024-01-01 00:00 UTC', 'Frameworks used: ' || array_to_string(f, ', '), '',
    repeat('-', 72) || chr(10) || '1. EXECUTIVE SUMMARY' || chr(10) || repeat('-', 72), summary, '',
    repeat('-', 72) || chr(10) || '2. KEY FINDINGS BY GOVERNANCE DIMENSION' || chr(10) || repeat('-', 72), '', findings,
    repeat('-', 72) || chr(10) || '3. RISK SUMMARY' || chr(10) || repeat('-', 72), r0, r1, r2, r3, '',
    repeat('-', 72) || chr(10) || '4. RECOMMENDATIONS' || chr(10) || repeat('-', 72), '', recs, '',
    repeat('-', 72) || chr(10) || '5. REFERENCES' || chr(10) || repeat('-', 72), '', '  Reference frameworks consulted:',
    array_to_string(list_transform(f, lambda x: '    - ' || x), chr(10)), '', '  Retrieved evidence chunks: ' || t, repeat('=', 72)) AS brief
  FROM bd JOIN sm USING (workspace_id) JOIN u USING (workspace_id))
SELECT workspace_id, length(brief) AS chars, md5(brief) AS digest FROM br""",
    "dimension_digest": f"""WITH {_GAPS_SQL},
ln AS (
  SELECT workspace_id, ord, concat_ws(chr(10), '- ' || dimension || ': Coverage ' || coverage, '  Maturity: ' || stage, '  Priority: ' || priority,
    '  Recommendations (from the analysis):' || chr(10) || array_to_string(list_transform(list_slice(string_split(text, chr(10)), 1, 3), lambda x: '    - ' || x), chr(10)),
    CASE WHEN analysis_error IS NOT NULL THEN '  [Not analysed — ' || substr(analysis_error, 1, 100) || ']' END) AS l FROM ga)
SELECT workspace_id, md5(string_agg(l, chr(10) ORDER BY ord)) AS digest FROM ln GROUP BY 1""",
    "coverage_labels": f"""WITH {b.VERDICTS_SQL},
raw AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN coverage WHEN 1 THEN coverage WHEN 4 THEN coverage ELSE 'Partial' END AS c FROM verdicts),
n AS (SELECT *, CASE WHEN c IN ('Covered', 'Partial', 'Missing') THEN c ELSE 'Partial' END AS tier FROM raw)
SELECT workspace_id, dimension, tier AS coverage, CASE WHEN tier = 'Covered' THEN 0 ELSE len(string_split(text, chr(10))) END::INT AS recommendations,
       tier = 'Covered' AS has_practices FROM n""",
    "drill_downs": f"""WITH {_GAPS_SQL},
ev AS (
  SELECT workspace_id, dimension, string_agg('  • [' || CASE WHEN line_no % 2 = 0 THEN 'src' ELSE 'Uploaded Document' END || ' (p. ' || line_no || ')]' ||
    CASE WHEN line_no = 1 THEN '' ELSE ' [similarity: ' || length(text) || ']' END || chr(10) || '    ' || substr(text, 1, 300), chr(10) ORDER BY doc_id, line_no) AS items
  FROM passages WHERE line_no <= 3 GROUP BY ALL),
t AS (
  SELECT g.workspace_id, g.dimension, concat_ws(chr(10), 'Dimension: ' || g.dimension, 'Coverage: ' || coverage,
    'Gap detected: ' || CASE WHEN coverage IN ('Partial', 'Missing') THEN 'True' ELSE 'False' END, 'Governance maturity: ' || stage,
    'Risk Level: ' || risk_level, CASE WHEN risk_reason <> '' THEN '  Risk reason: ' || risk_reason END,
    'Recommendation: ' || array_to_string(string_split(text, chr(10)), '; '), '', 'Evidence used for this finding:',
    coalesce(items, '  (no retrieved evidence items)')) AS trail
  FROM ga g LEFT JOIN ev USING (workspace_id, dimension))
SELECT workspace_id, dimension, length(trail)::INT AS chars, md5(trail) AS digest FROM t""",
    "assembled_briefs": f"""WITH {_GAPS_SQL}, {_SCOPE_SQL[len(b.KEYED_SQL) + 2:]},
c AS (
  SELECT workspace_id, count(*) FILTER (coverage = 'Covered') AS covered, count(*) FILTER (coverage = 'Partial') AS partial,
    count(*) FILTER (coverage = 'Missing') AS missing, count(*) FILTER (coverage = 'Insufficient Evidence') AS insufficient_evidence,
    count(analysis_error) AS analysis_failed, count(*) AS n, count(*) FILTER (risk_level = 'High') AS high, count(*) FILTER (risk_level = 'Medium') AS medium,
    count(*) FILTER (risk_level = 'Low') AS low, count(*) FILTER (risk_level = 'Insufficient Evidence') AS insufficient,
    count(*) FILTER ({_URGENT}) AS u, {_names(_URGENT, 'pr, ord')} AS names,
    coalesce(string_agg('- ' || dimension, chr(10) ORDER BY ord) FILTER (coverage = 'Covered'), '- None identified.') AS strengths,
    coalesce(string_agg('- ' || dimension, chr(10) ORDER BY ord) FILTER (coverage <> 'Covered'), '- None identified.') AS attention
  FROM ga GROUP BY 1),
urgent AS (
  SELECT workspace_id, row_number() OVER (PARTITION BY workspace_id ORDER BY ord) AS k, {b.strip_sql("string_split(text, chr(10))[1]")} AS r, {b.strip_sql("risk_reason")} AS why
  FROM ga WHERE {_URGENT} AND {b.strip_sql("string_split(text, chr(10))[1]")} <> ''),
adv AS (SELECT workspace_id, string_agg(k || '. **' || r || '** — ' || why, chr(10) ORDER BY k) AS recs FROM urgent GROUP BY 1),
inc AS (SELECT workspace_id, trim(text) AS name, min(doc_id) AS at_ FROM passages WHERE line_no = 1 AND doc_id % 3 = 0 GROUP BY ALL),
pre AS (SELECT workspace_id, 'The analysis matched ' || CASE WHEN count(*) = 1 THEN 'one real-world incident' ELSE count(*) || ' real-world incidents' END ||
  ' as illustrative context (' || string_agg(name, ', ' ORDER BY at_) || '); the full report carries the case-study detail.' AS precedent FROM inc WHERE name <> '' GROUP BY 1),
fr AS (SELECT workspace_id, list_sort(list(DISTINCT lang)) AS f FROM keyed GROUP BY 1),
md AS (
  SELECT c.*, concat_ws(chr(10), '# Utopia — Policy ' || c.workspace_id, 'AI Governance Assessment Brief',
    'Generated 2024-01-01 00:00 UTC · Based on analysis of ' || n || ' governance dimensions', chr(10) || '## EXECUTIVE SUMMARY',
    CASE WHEN c.workspace_id % 5 <> 4 THEN n || ' dimensions' ELSE '' END, chr(10) || '## KEY FINDINGS' || chr(10) || '### Areas of Strength',
    CASE WHEN c.workspace_id % 5 <> 4 THEN strengths ELSE '- None identified.' END, '### Areas Requiring Attention',
    CASE WHEN c.workspace_id % 5 <> 4 THEN attention ELSE '- None identified.' END, chr(10) || '## RISK OVERVIEW',
    'The analysis assessed ' || n || ' dimension(s). Risk distribution: ' || high || ' High, ' || medium || ' Medium, ' || low || ' Low, ' || insufficient || ' Insufficient Evidence.' ||
      CASE WHEN u > 0 THEN ' High-priority dimensions: ' || names || '.' ELSE '' END ||
      CASE WHEN u >= 2 THEN ' Multiple dimensions share the highest priority — compounding risk across these dimensions raises the urgency of coordinated, sequenced implementation.'
           WHEN u = 1 THEN ' Single highest-priority dimension — sequencing should begin there before related clusters are addressed.' ELSE '' END,
    chr(10) || '## PRIORITY RECOMMENDATIONS',
    CASE WHEN c.workspace_id % 5 <> 4 AND recs IS NOT NULL THEN recs ELSE 'No critical gaps identified — no priority actions required.' END,
    chr(10) || '## RELEVANT PRECEDENT' || chr(10) || precedent, chr(10) || '## SCOPE & METHODOLOGY',
    concat_ws(chr(10) || chr(10), disclaimer, 'This brief synthesizes the already-computed analysis of ' || n || ' governance dimensions evaluated against ' || len(f) ||
      ' reference framework(s): ' || array_to_string(f, ', ') || '.', CASE WHEN len(docs) > 0 THEN 'Source input(s): ' || array_to_string(docs, ', ') || '.' END), '') AS markdown
  FROM c JOIN sc ON sc.workspace_id = c.workspace_id JOIN fr ON fr.workspace_id = c.workspace_id
  LEFT JOIN adv ON adv.workspace_id = c.workspace_id LEFT JOIN pre ON pre.workspace_id = c.workspace_id)
SELECT workspace_id, covered, partial, missing, insufficient_evidence, analysis_failed, n AS num_dimensions, length(markdown)::INT AS chars, md5(markdown) AS digest FROM md""",
    "verdict_texts": f"""WITH {_GAPS_SQL},
t AS (
  SELECT workspace_id, dimension, array_to_string(list_slice(string_split(text, chr(10)), 1, 6), '; ') AS m, coverage, stage,
    array_to_string(list_transform(list_slice(string_split(text, chr(10)), 1, 5), lambda x: '  - ' || x), chr(10)) AS r FROM ga)
SELECT workspace_id, dimension, md5(concat_ws(chr(10), 'Dimension: ' || dimension, 'Coverage: ' || coverage,
  CASE WHEN m <> '' THEN 'Existing operational mechanisms in document: ' || m END, 'Governance maturity: ' || stage,
  'Module 2 recommendations (the gap this roadmap must address):' || chr(10) || r)) AS digest FROM t""",
}
