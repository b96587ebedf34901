"""Evidence per dimension: pairs, aspects, near-duplicates, graph quality, requirement matching.

The inputs are retrieved evidence, so each (workspace, dimension) group is
bounded by the retrieval budgets (about a dozen rows); group-wise work relies
on that.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policyloom.functions import text as tx
from policyloom.functions.numbers import settled
from policyloom.functions.vectors import cosine, dot, l2_normalize, round_half_up, unit_rows
from policyloom.operators.ordering import first_per_key, top_k

# --- fixed values: thresholds -----------------------------------------------
SAME_EVIDENCE = 0.88
MIN_TEXT = 30
AGREE_AT = 0.75
INDEPENDENT_AT = 0.4
ASPECT_AT = 0.35
CORROBORATES_ABOVE = 0.35
STRENGTH_MULTIPLIER = {
    "Strongly Operationalised": 1.3,
    "Explicitly Addressed": 1.1,
    "Implicitly Addressed": 1.0,
    "Weakly Demonstrated": 0.7,
    "Not Demonstrated": 0.4,
}


def evidence_items(documents: DataFrame, frameworks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Passages of at least 30 characters, once per id, document passages first."""
    both = documents.withColumn("is_document", F.lit(True)).unionByName(
        frameworks.withColumn("is_document", F.lit(False))
    )
    sized = both.withColumn("text", tx.strip(F.coalesce("text", F.lit("")))).filter(F.length("text") >= MIN_TEXT)
    unique = first_per_key(
        sized.withColumn("_order", (~F.col("is_document")).cast("int")), [*keys, "chunk_id"], ["_order", "rank"]
    )
    order = Window.partitionBy(*keys).orderBy("_order", "rank", "chunk_id")
    return unique.withColumn("ord", F.row_number().over(order)).drop("_order")


def pair_agreement(items: DataFrame, keys: Sequence[str], vector: str | None = "vector") -> DataFrame:
    """Classify the pairs of one dimension's evidence.

    ``items(keys, ord, chunk_id, text, source, is_document[, vector])``.  Without
    vectors the word sets are compared.  The rows of a group are its retrieval
    budget; they travel as one array and pairs are formed inside the row.
    """
    fields = ["ord", "chunk_id", "text", "source", "is_document", *([vector] if vector else [])]
    grouped = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_items"))
    firsts = grouped.select(*keys, "_items", F.posexplode("_items").alias("_i", "a"))
    pairs = firsts.select(
        *keys, "a", F.explode(F.slice("_items", F.col("_i") + 2, F.size("_items"))).alias("b")
    )
    a_text, b_text = F.lower("a.text"), F.lower("b.text")
    if vector:
        products = F.zip_with(F.col(f"a.{vector}"), F.col(f"b.{vector}"), lambda x, y: x * y)
        similarity = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    else:
        left, right = F.array_distinct(tx.words(a_text)), F.array_distinct(tx.words(b_text))
        union = F.size(F.array_union(left, right))
        similarity = F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(0.0)
    measured = (
        pairs.withColumn("_same", a_text == b_text)
        .withColumn("_sim", F.round(similarity, 6))
        .withColumn("_conflict", tx.contradicts(a_text, b_text))
        .withColumn("_short", F.least(F.length("a.text"), F.length("b.text")) < MIN_TEXT)
    ).filter(F.col("_same") | ~F.col("_short"))
    one_source = (F.col("a.is_document") == F.col("b.is_document")) & F.col("a.source").eqNullSafe(F.col("b.source"))
    close = F.col("_sim") >= AGREE_AT
    agreement = (
        F.when(F.col("_same"), "duplicate")
        .when(close & F.col("_conflict"), "conflicting")
        .when(close & one_source, "duplicate")
        .when(close, "supporting")
        .when(F.col("_sim") >= INDEPENDENT_AT, "independent")
        .otherwise("weak")
    )
    return measured.select(
        *keys, F.col("a.chunk_id").alias("item_a"), F.col("b.chunk_id").alias("item_b"),
        agreement.alias("agreement"), F.when(F.col("_same"), 1.0).otherwise(settled(F.col("_sim"), 3)).alias("score"),
    )


def agreement_score(pairs: DataFrame, keys: Sequence[str], groups: DataFrame | None = None) -> DataFrame:
    """Agreement of each group from 0 to 1; a group of ``groups`` without a pair of items agrees fully."""
    value = (
        F.when(F.col("agreement") == "supporting", F.col("score"))
        .when(F.col("agreement") == "conflicting", -F.col("score"))
        .when(F.col("agreement") == "duplicate", 0.5)
        .when(F.col("agreement") == "independent", 0.3)
        .otherwise(0.1)
    )
    clamp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.avg(value) + 1) / 2))
    scored = pairs.groupBy(*keys).agg(settled(clamp, 3).alias("agreement"), F.count("*").alias("pairs"))
    if groups is None:
        return scored
    return groups.select(*keys).distinct().join(scored, list(keys), "left").select(
        *keys, F.coalesce("agreement", F.lit(1.0)).alias("agreement"), F.coalesce("pairs", F.lit(0)).alias("pairs")
    )


def merge_near_duplicates(items: DataFrame, keys: Sequence[str], threshold: float = SAME_EVIDENCE) -> DataFrame:
    """Greedy merge in evidence order; the longer text and the higher score survive.

    Input ``items(keys, ord, chunk_id, text, similarity, vector, ...)``; the
    survivor keeps the place and vector of the first.  An item goes to the first
    earlier one that leads a group and is close enough, or else leads one: a
    fold over the evidence of a key, which the retrieval budgets bound.  Only
    places and vectors are folded; sums over the groups do the rest.
    """
    item = F.struct("ord", F.col("vector").cast("array<double>").alias("vector"))
    listed = items.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    place = dict(items.dtypes)["ord"]
    start = F.struct(
        F.array().cast(f"array<struct<ord:{place},vector:array<double>>>").alias("leads"),
        F.array().cast(f"array<struct<ord:{place},lead:{place}>>").alias("placed"),
    )

    def step(acc: Column, x: Column) -> Column:
        near = F.filter(acc["leads"], lambda lead: F.floor(cosine(lead["vector"], x["vector"]) * 10**6 + 0.5) / 10**6 >= threshold)
        lead = F.coalesce(F.get(near, F.lit(0))["ord"], x["ord"])
        return F.struct(
            F.when(F.size(near) > 0, acc["leads"]).otherwise(F.array_append(acc["leads"], x)).alias("leads"),
            F.array_append(acc["placed"], F.struct(x["ord"].alias("ord"), lead.alias("lead"))).alias("placed"),
        )

    placed = listed.select(*keys, F.explode(F.aggregate("_items", start, step)["placed"]).alias("_p")).select(
        *keys, F.col("_p.ord").alias("ord"), F.col("_p.lead").alias("_lead")
    )
    rest = [c for c in items.columns if c not in ("vector", "ord", "similarity", *keys)]
    best = F.max_by(F.struct(*rest), F.struct(F.length("text"), -F.col("ord"))).alias("_best")
    merged = items.join(placed, [*keys, "ord"]).groupBy(*keys, "_lead").agg(
        best, F.max("similarity").alias("similarity"), F.count("*").cast("int").alias("merged")
    ).withColumnRenamed("_lead", "ord").select(*keys, "ord", "similarity", "merged", "_best.*")
    return merged.select(*(c for c in items.columns if c != "vector"), "merged")


def best_aspect(items: DataFrame, aspects: DataFrame, dimension: str = "dimension",
                most_aspects: int = 10_000) -> DataFrame:
    """Closest aspect of the item's dimension at 0.35 or more, else the first aspect.

    ``aspects(dimension, aspect_no, aspect, vector)`` is the profile table.  Up
    to ``most_aspects`` its rows go to every task and each batch is one matrix
    product per dimension; past that each item is joined to its dimension's list.
    """
    listed = aspects.limit(most_aspects + 1).collect()
    if len(listed) > most_aspects:
        return _best_aspect_joined(items, aspects, dimension)
    table: dict = {}
    for row in sorted(listed, key=lambda r: (r[dimension], r["aspect_no"])):
        table.setdefault(row[dimension], []).append((row["aspect"], list(row["vector"])))
    names = {d: [a for a, _ in rows] for d, rows in table.items()}
    matrices = {d: unit_rows(np.array([v for _, v in rows], dtype=float)) for d, rows in table.items()}
    columns = items.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.reset_index(drop=True)
            aspect = np.full(len(batch), None, dtype=object)
            relevance = np.zeros(len(batch))
            for dim, rows in batch.groupby(dimension).groups.items():
                if dim not in matrices:
                    continue
                vectors = unit_rows(np.vstack(batch.loc[rows, "vector"].to_numpy()).astype(float))
                scores = round_half_up(vectors @ matrices[dim].T)
                best = scores.argmax(axis=1)
                top = scores[np.arange(len(best)), best]
                near = top >= ASPECT_AT
                aspect[rows] = np.array(names[dim], dtype=object)[np.where(near, best, 0)]
                relevance[rows] = np.where(near, top, 0.0)
            batch["aspect"], batch["relevance"] = aspect, relevance
            yield batch[[*columns, "aspect", "relevance"]]

    return items.mapInPandas(run, schema + ", aspect string, relevance double")


def _best_aspect_joined(items: DataFrame, aspects: DataFrame, dimension: str) -> DataFrame:
    unit = aspects.withColumn("vector", l2_normalize(F.transform("vector", lambda x: x.cast("double"))))
    packed = unit.groupBy(dimension).agg(
        F.array_sort(F.collect_list(F.struct("aspect_no", "aspect", "vector"))).alias("_aspects")
    )
    own = l2_normalize(F.transform("vector", lambda x: x.cast("double")))
    scored = items.join(packed, dimension, "left").withColumn(
        "_scored",
        F.transform("_aspects", lambda a: F.struct(
            F.round(dot(own, a["vector"]), 6).alias("s"), (-a["aspect_no"]).alias("o"), a["aspect"].alias("aspect"))),
    )
    best = F.array_max("_scored")
    near = best["s"] >= ASPECT_AT
    return scored.withColumn("aspect", F.when(near, best["aspect"]).otherwise(F.col("_aspects")[0]["aspect"])).withColumn(
        "relevance", F.when(near, best["s"]).otherwise(0.0)
    ).drop("_aspects", "_scored")


def group_quality(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Quality and coverage estimate of each aspect group.

    ``items(keys, aspect, relevance, source, text, verified, score)``.
    """
    relevant = F.when(F.col("relevance") > 0, F.col("relevance"))
    reranked = F.coalesce(F.max(F.col("score") > 1.0), F.lit(False))
    density = F.least(F.lit(1.0), F.sum(F.length("text")) / 5000)
    quality = (
        F.coalesce(F.avg(relevant), F.lit(0.0)) * 0.4
        + F.when(F.count_distinct("source") > 1, 0.2).otherwise(0.0)
        + F.when(F.max("verified"), 0.1).otherwise(0.0)
        + F.when(reranked, 0.15).otherwise(0.0)
        + density * F.when(reranked, 0.15).otherwise(0.3)
    )
    return items.groupBy(*keys, "aspect").agg(
        F.round(F.least(F.lit(1.0), F.round(quality, 9)), 3).alias("coverage_quality"),
        F.count("*").alias("evidence_count"),
    ).withColumn(
        "coverage_estimate",
        F.when(F.col("coverage_quality") >= 0.7, "covered")
        .when(F.col("coverage_quality") >= 0.35, "partial")
        .otherwise("weak"),
    )


def graph_quality(items: DataFrame, groups: DataFrame, aspects: DataFrame, totals: DataFrame,
                  keys: Sequence[str], asked: DataFrame | None = None) -> DataFrame:
    """Roll aspect groups up to the dimension's evidence graph.

    ``asked(keys)`` lists the graphs to report; by default those of all
    dimensions with aspects, where the keys are the dimension alone.
    ``aspects(dimension, aspect)`` lists what could be covered; ``totals(keys,
    before, sources)`` describes the evidence before near-duplicates merged.
    """
    per_dimension = groups.groupBy(*keys).agg(
        F.avg("coverage_quality").alias("_avg"), F.count("*").alias("_groups"),
        F.count_if(F.col("coverage_quality") >= 0.35).alias("_covered"),
        F.array_sort(F.collect_set("aspect")).alias("_aspects"),
    )
    listed = aspects.groupBy("dimension").agg(F.array_sort(F.collect_set("aspect")).alias("_all"))
    sources = items.groupBy(*keys).agg(
        F.count_distinct(F.when(F.col("is_document"), F.coalesce("source", F.lit("")))).alias("_doc"),
        F.count_distinct(F.when(~F.col("is_document"), F.coalesce("source", F.lit("")))).alias("_fw"),
        F.count_distinct(F.coalesce("source", F.lit(""))).alias("_any"),
        F.coalesce(F.max(F.col("score") > 1.0), F.lit(False)).alias("_reranked"),
        F.count("*").alias("after"),
    )
    missing = F.array_except("_all", F.coalesce("_aspects", F.array().cast("array<string>")))
    ratio = F.col("_groups") / (F.col("_groups") + F.size(missing))
    quality = (
        F.col("_avg") * 0.5 + ratio * 0.25
        + F.least(F.lit(0.15), (F.col("_doc") + F.col("_fw")) * 0.03) * 0.1
        + F.least(F.lit(0.1), F.col("_any") * 0.02) * 0.1
        + F.when(F.col("_reranked"), 0.05).otherwise(0.0) * 0.05
    )
    # a dimension without evidence has a graph as well: nothing covered, every aspect missing
    graphs = per_dimension.join(sources, list(keys)).join(totals, list(keys))
    if asked is None:
        asked = listed.select("dimension") if list(keys) == ["dimension"] else graphs.select(*keys)
    measured = lambda value: F.when(F.col("_groups").isNotNull(), value).otherwise(0.0)
    return asked.join(listed, "dimension", "left").join(graphs, list(keys), "left").select(
        *keys,
        measured(F.round(F.least(F.lit(1.0), F.round(quality, 9)), 3)).alias("evidence_quality_score"),
        measured(F.round(F.least(F.lit(1.0), F.col("sources") / 5.0), 3)).alias("source_diversity"),
        measured(F.round(1 - F.col("after") / F.col("before"), 3)).alias("redundancy_ratio"),
        measured(F.round(F.col("_covered") / F.size("_all"), 3)).alias("coverage_completeness"),
        F.array_join(missing, "; ").alias("missing_aspects"),
    )


# -- requirements against evidence -------------------------------------------

def matched_evidence(evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First of equal texts by kind: strong, explicit, implicit, weak, policy."""
    order = F.create_map(*[F.lit(v) for pair in zip(("strong", "explicit", "implicit", "weak", "policy"), range(5))
                           for v in pair])
    unique = first_per_key(evidence.withColumn("_kind", order[F.col("kind")]), [*keys, "text"], ["_kind", "ord"])
    return unique.withColumn("is_explicit", F.col("_kind") <= 1).withColumn("is_implicit", F.col("_kind") == 2).drop("_kind")


def match_requirements(requirements: DataFrame, evidence: DataFrame, keys: Sequence[str],
                       strength: Column) -> DataFrame:
    """Score each requirement against all evidence of its key and classify it.

    Evidence travels as one array per key (a retrieval budget), so scoring is a
    fold inside the requirement's row and no requirement-by-evidence table forms.
    """
    packed = evidence.groupBy(*keys).agg(
        F.collect_list(F.struct("vector", "is_explicit", "is_implicit")).alias("_evidence")
    )
    joined = requirements.join(packed, list(keys))
    scored = F.transform(
        "_evidence",
        lambda e: F.struct(
            F.round(F.aggregate(F.zip_with(F.col("vector"), e["vector"], lambda x, y: x * y), F.lit(0.0),
                                lambda s, x: s + x), 6).alias("sim"),
            e["is_explicit"].alias("is_explicit"), e["is_implicit"].alias("is_implicit"),
        ),
    )

    def best(kept) -> Column:
        return F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.transform(kept, lambda e: e["sim"])), F.lit(0.0)))

    multiplier = F.coalesce(
        F.create_map(*[F.lit(v) for pair in STRENGTH_MULTIPLIER.items() for v in pair])[strength], F.lit(1.0)
    )
    measured = (
        joined.withColumn("_scored", scored)
        .withColumn("max_sim", best(F.col("_scored")))
        .withColumn("explicit_sim", best(F.filter("_scored", lambda e: e["is_explicit"])))
        .withColumn("implicit_sim", best(F.filter("_scored", lambda e: e["is_implicit"])))
        .withColumn("corroboration", F.size(F.filter("_scored", lambda e: e["sim"] > CORROBORATES_ABOVE)))
    )
    raw = (
        F.col("max_sim") * 0.35 + F.col("explicit_sim") * 0.25 + F.col("implicit_sim") * 0.10
        + F.least(F.col("corroboration") / 4.0, F.lit(1.0)) * 0.15 + (multiplier - 0.5) * 0.15
    )
    return (
        measured.withColumn("match_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 6))
        .withColumn(
            "match_class",
            F.when(F.col("match_score") >= 0.6, "implemented")
            .when(F.col("match_score") >= 0.35, "partial")
            .otherwise("missing"),
        )
        .drop("_evidence", "_scored", "vector")
    )


def requirement_rollup(matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per class and, per framework, what it shares with the policy."""
    return matched.groupBy(*keys).agg(
        F.count_if(F.col("match_class") == "implemented").alias("implemented"),
        F.count_if(F.col("match_class") == "partial").alias("partial"),
        F.count_if(F.col("match_class") == "missing").alias("missing"),
        F.count_distinct("framework").alias("frameworks"),
    )


def framework_differences(matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Met requirements that some frameworks name and others do not."""
    item = F.trim(F.substring("requirement", 1, 120))
    met = matched.filter(F.col("match_class") != "missing").select(*keys, item.alias("item"), "framework").distinct()
    per_item = met.groupBy(*keys, "item").agg(
        F.count("*").alias("_n"), F.array_join(F.array_sort(F.collect_list("framework")), ", ").alias("frameworks")
    )
    totals = matched.groupBy(*keys).agg(F.count_distinct("framework").alias("_all"))
    return per_item.join(totals, list(keys)).filter((F.col("_all") > 1) & (F.col("_n") < F.col("_all"))).drop("_n", "_all")


def framework_context(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Up to three passages of 600 characters per framework, 2000 in all."""
    top = top_k(hits, [*keys, "framework"], [F.asc("rank"), F.asc("chunk_id")], 3, "_at")
    parts = F.array_sort(F.collect_list(F.struct("_at", F.substring("text", 1, 600).alias("t"))))
    return top.groupBy(*keys, "framework").agg(
        F.substring(F.array_join(F.transform(parts, lambda p: p["t"]), "\n"), 1, 2000).alias("context")
    )


NO_FRAMEWORKS = "No framework requirements retrieved for this dimension."


def framework_summary(hits: DataFrame, keys: Sequence[str], asked: DataFrame | None = None) -> DataFrame:
    """The context of every framework under its header, frameworks in the order of their first hit.

    ``asked(keys)`` lists the keys to report, those without hits as well; by default those of the hits.
    """
    first = hits.groupBy(*keys, "framework").agg(F.min("rank").alias("_first"))
    blocks = framework_context(hits, keys).join(first, [*keys, "framework"])
    block = F.concat(F.lit("[Framework: "), "framework", F.lit("]\n"), "context")
    listed = F.array_sort(F.collect_list(F.struct("_first", "framework", block.alias("b"))))
    joined = blocks.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["b"]), "\n\n---\n\n").alias("summary"))
    every = hits.select(*keys).distinct() if asked is None else asked.select(*keys).distinct()
    return every.join(joined, list(keys), "left").withColumn("summary", F.coalesce("summary", F.lit(NO_FRAMEWORKS)))


def requirement_report(matched: DataFrame, strong: DataFrame, keys: Sequence[str], strength: Column, dimension: str = "dimension") -> DataFrame:
    """Requirement texts by class in the order of frameworks and requirements, and what is said about them.

    ``matched(keys, framework, ord, requirement, match_class)``; ``strong(keys, strong_count)`` counts the strong
    evidence, more of which than there are implemented requirements goes beyond the frameworks.  The lists of a key
    hold its requirements, which the frameworks bound.
    """
    text = F.trim(F.substring("requirement", 1, 120))
    item = F.struct("framework", "ord", text.alias("text"))

    def named(which: str) -> Column:
        listed = F.array_sort(F.collect_list(F.when(F.col("match_class") == which, item)))
        return F.transform(listed, lambda x: x["text"]).alias(which)

    met = F.struct("framework", F.when(F.col("match_class") == "implemented", 0).otherwise(1).alias("c"), "ord", text.alias("text"))
    per_framework = matched.groupBy(*keys, "framework").agg(F.transform(
        F.array_sort(F.collect_list(F.when(F.col("match_class") != "missing", met))), lambda x: x["text"]).alias("items"))
    specific = per_framework.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("framework", "items")))).alias("framework_specific"))
    lists = matched.groupBy(*keys).agg(*map(named, ("implemented", "partial", "missing")), F.array_sort(F.collect_set(text)).alias("universal"))
    differing = framework_differences(matched, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.concat(F.lit("'"), "item", F.lit("' mentioned in "), "frameworks", F.lit(" but not others")))).alias("differences"))
    none = F.array().cast("array<string>")
    beyond_count = F.coalesce("strong_count", F.lit(0)) - F.size("implemented")
    exceeds = (strength == "Strongly Operationalised") & (F.col("strong_count") > 1) & (beyond_count > 0)
    line = F.concat(F.lit("Policy exceeds framework expectations on "), beyond_count.cast("string"), F.lit(" mechanism(s)"))

    def part(label: str, name: str) -> Column:
        shown = F.array_join(F.slice(name, 1, 5), "; ")
        return F.when(F.size(name) > 0, F.concat(F.lit(f"{label} ("), F.size(name).cast("string"), F.lit("): "), shown))

    joined = lists.join(specific, list(keys)).join(strong, list(keys), "left").join(differing, list(keys), "left")
    return (
        joined.withColumn("differences", F.coalesce("differences", none))
        .withColumn("beyond", F.when(exceeds, F.array(line)).otherwise(none))
        .withColumn("existing_mechanisms", F.concat("implemented", "beyond"))
        .withColumn("synthesis", F.concat_ws(
            " | ", F.concat(F.lit("Framework comparison for "), F.col(dimension), F.lit(":")), part("Already implemented", "implemented"),
            part("Partially implemented", "partial"), part("Missing", "missing"),
            F.when(F.size("beyond") > 0, F.concat(F.lit("Beyond framework expectations: "), F.array_join("beyond", "; ")))))
        .drop("strong_count")
    )


def quality_factors(items: DataFrame, groups: DataFrame, aspects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The parts of an evidence graph's quality, each to three places: groups, aspects covered, sources, diversity, reranker."""
    per_key = groups.groupBy(*keys).agg(F.avg("coverage_quality").alias("_avg"), F.count("*").alias("_groups"), F.collect_set("aspect").alias("_have"))
    listed = aspects.groupBy("dimension").agg(F.collect_set("aspect").alias("_all"))
    name = F.coalesce("source", F.lit(""))
    sources = items.groupBy(*keys).agg(
        (F.count_distinct(F.when(F.col("is_document"), name)) + F.count_distinct(F.when(~F.col("is_document"), name))).alias("_sources"),
        F.count_distinct(name).alias("_any"), F.coalesce(F.max(F.col("score") > 1.0), F.lit(False)).alias("_reranked"),
    )
    joined = per_key.join(sources, list(keys)).join(listed, "dimension")
    ratio = F.col("_groups") / (F.col("_groups") + F.size(F.array_except("_all", "_have")))
    return joined.select(
        *keys, settled(F.col("_avg"), 3).alias("avg_group_quality"), settled(ratio, 3).alias("coverage_ratio"),
        settled(F.least(F.lit(0.15), F.col("_sources") * 0.03), 3).alias("source_bonus"),
        settled(F.least(F.lit(0.1), F.col("_any") * 0.02), 3).alias("diversity_bonus"),
        F.when(F.col("_reranked"), 0.05).otherwise(0.0).alias("reranker_bonus"),
    )


CLAIM_CHARS = 800


def group_claims(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first three texts of each group as one claim, cut past 800 characters."""
    first = top_k(items, keys, [F.asc("ord"), F.asc("chunk_id")], 3, "_at", spread_by="chunk_id")
    texts = F.array_sort(F.collect_list(F.struct("_at", F.coalesce("text", F.lit("")).alias("t"))))
    whole = F.array_join(F.transform(texts, lambda x: x["t"]), " ")
    said = first.groupBy(*keys).agg(whole.alias("_claim"))
    cut = F.concat(F.substring("_claim", 1, CLAIM_CHARS), F.lit("..."))
    return said.select(*keys, F.when(F.length("_claim") > CLAIM_CHARS, cut).otherwise(F.col("_claim")).alias("claim"))


def document_types(chunks: DataFrame, by: str = "doc_id", first: int = 10, rules=None) -> DataFrame:
    """Document type from the keywords of the first ten chunks."""
    from policyloom import lexicons as lx

    lead = top_k(chunks, [by], [F.asc("position")], first, "_at", spread_by="chunk_id")
    joined = lead.groupBy(by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "text"))), lambda p: p["text"]), " ").alias(
            "_text"
        )
    )
    return joined.select(by, tx.document_type(F.col("_text"), rules or lx.DOCUMENT_TYPE_RULES).alias("document_type"))
