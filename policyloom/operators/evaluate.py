"""Retrieval quality against relevance labels, and stability over repeated runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyloom.functions.numbers import settled

CUTOFFS = (1, 3, 5, 10)
STABLE_AT = 0.5


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def kendall_tau(a: Column, b: Column) -> Column:
    """Order agreement of two ranked id lists on their common ids (lists are top-k cuts)."""
    common = F.filter(a, lambda x: F.array_contains(b, x))
    places = F.transform(common, lambda x: F.array_position(b, x))
    n = F.size(common)
    indexed = F.transform(places, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    concordant = F.aggregate(
        indexed, F.lit(0).cast("long"),
        lambda total, x: total + F.size(F.filter(indexed, lambda y: (y["i"] > x["i"]) & (y["p"] > x["p"]))),
    )
    pairs = n * (n - 1) / 2
    return F.when(n < 2, 0.0).otherwise((concordant * 2 - pairs) / pairs)


def qrels_by_first(ranked: DataFrame, keys: Sequence[str], n: int = 3) -> DataFrame:
    """Default relevance: the first three results of each query."""
    return ranked.filter(F.col("rank") <= n).select(*keys, "chunk_id", F.lit(2.0).alias("gain"))


def ranking_metrics(ranked: DataFrame, qrels: DataFrame, keys: Sequence[str], queries: DataFrame | None = None) -> DataFrame:
    """Precision, recall, reciprocal rank and nDCG per query.

    Every query of ``queries``, of the results or of the labels has a row; one
    that found nothing has zeros.
    ``ranked(keys, rank, chunk_id)``, ranks from 1; ``qrels(keys, chunk_id, gain)``.
    Precision divides by the rows returned, and the gain at rank r > 1 is
    divided by log2(r).
    """
    judged = ranked.join(qrels, [*keys, "chunk_id"], "left").withColumn("_rel", F.col("gain").isNotNull())
    discount = F.when(F.col("rank") == 1, 1.0).otherwise(F.log2(F.col("rank").cast("double")))
    aggregates = []
    for k in CUTOFFS:
        within = F.col("rank") <= k
        aggregates.append(F.count_if(within & F.col("_rel")).alias(f"_hits_{k}"))
        aggregates.append(F.count_if(within).alias(f"_rows_{k}"))
    for k in (5, 10):
        part = F.when((F.col("rank") <= k) & F.col("_rel"), F.col("gain") / discount).otherwise(0.0)
        aggregates.append(F.sum(part).alias(f"_dcg_{k}"))
    aggregates.append(F.min(F.when(F.col("_rel"), F.col("rank"))).alias("_first"))
    found = judged.groupBy(*keys).agg(*aggregates)
    ideal = _ideal_gain(qrels, keys)
    asked = ranked.select(*keys).unionByName(qrels.select(*keys))
    if queries is not None:
        asked = asked.unionByName(queries.select(*keys))
    joined = asked.distinct().join(found, list(keys), "left").join(ideal, list(keys), "left")
    relevant = F.coalesce("_relevant", F.lit(0))

    def share(top: Column, bottom: Column) -> Column:
        return F.coalesce(F.when(bottom > 0, F.round(top / bottom, 6)), F.lit(0.0))

    return joined.select(
        *keys,
        *[share(F.col(f"_hits_{k}"), F.col(f"_rows_{k}")).alias(f"precision_at_{k}") for k in CUTOFFS],
        *[share(F.col(f"_hits_{k}"), relevant).alias(f"recall_at_{k}") for k in CUTOFFS if k > 1],
        F.coalesce(F.round(1.0 / F.col("_first"), 6), F.lit(0.0)).alias("mrr"),
        *[share(F.col(f"_dcg_{k}"), F.coalesce(f"_ideal_{k}", F.lit(0.0))).alias(f"ndcg_at_{k}") for k in (5, 10)],
    )


def _ideal_gain(qrels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ideal gain from counts per gain value, so a query with very many relevant rows stays small."""
    counts = qrels.groupBy(*keys, "gain").agg(F.count("*").alias("_n"))
    per_query = counts.groupBy(*keys).agg(
        F.sum("_n").alias("_relevant"),
        F.sort_array(F.collect_list(F.struct("gain", "_n")), asc=False).alias("_gains"),
    )
    best = F.slice(
        F.flatten(F.transform("_gains", lambda g: F.array_repeat(g["gain"], F.least(g["_n"], F.lit(10)).cast("int")))),
        1, 10,
    )
    for k in (5, 10):
        discounted = F.transform(
            F.slice(best, 1, k),
            lambda g, i: F.when(i == 0, g).otherwise(g / F.log2((i + 1).cast("double"))),
        )
        per_query = per_query.withColumn(f"_ideal_{k}", F.aggregate(discounted, F.lit(0.0), lambda s, x: s + x))
    return per_query.drop("_gains")


def result_quality(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source diversity, repeated texts, mean similarity of each result list."""
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("returned"),
        F.round(F.count_distinct(F.nullif("framework", F.lit(""))) / F.count("*"), 6).alias("evidence_diversity"),
        F.round((F.count("*") - F.count_distinct(F.md5("text"))) / F.count("*"), 6).alias("duplicate_rate"),
        settled(F.avg("similarity"), 6).alias("avg_retrieval_similarity"),
    )


def source_accuracy(ranked: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many hits come from expected sources, for frameworks and for uploaded documents.

    ``ranked(keys, framework, document_name)``: a hit without a framework is a document's; ``expected(keys, kind,
    name)`` lists the sources that were meant, of kind ``framework`` or ``policy``.  No hits of a kind give 0.
    """
    kind = F.when(F.coalesce("framework", F.lit("")) != "", "framework").otherwise("policy")
    name = F.when(F.coalesce("framework", F.lit("")) != "", F.col("framework")).otherwise(F.coalesce("document_name", F.lit("")))
    meant = expected.select(*keys, "kind", "name").distinct().withColumn("_meant", F.lit(True))
    met = ranked.select(*keys, kind.alias("kind"), name.alias("name")).join(meant, [*keys, "kind", "name"], "left")

    def share(which: str) -> Column:
        total = F.count_if(F.col("kind") == which)
        right = F.count_if((F.col("kind") == which) & F.coalesce("_meant", F.lit(False)))
        return F.when(total > 0, F.round(right / total, 6)).otherwise(0.0)

    return met.groupBy(*keys).agg(
        share("framework").alias("framework_retrieval_accuracy"), share("policy").alias("policy_retrieval_accuracy")
    )


def coverage_recall(relevant: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Passages known to be relevant, as a share of all that the corpus holds.

    ``relevant(keys, chunk_id)``; ``totals(keys, total)``.  An id counts once; without a total the share is 0.
    """
    known = relevant.groupBy(*keys).agg(F.count_distinct("chunk_id").alias("_n"))
    return totals.join(known, list(keys), "left").select(
        *keys, F.when(F.col("total") > 0, F.round(F.coalesce("_n", F.lit(0)) / F.col("total"), 6)).otherwise(0.0).alias("coverage_recall")
    )


def error_rates(outcomes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """False positive and negative shares.

    ``outcomes(keys, false_positives, false_negatives, total_retrieved, relevant)``.
    """
    classified = F.col("false_positives") + F.col("false_negatives")
    negatives = F.greatest(F.col("total_retrieved") - F.col("relevant"), F.lit(1))
    positives = F.greatest(F.col("relevant"), F.lit(1))

    def rate(count: Column, base: Column) -> Column:
        return F.round(
            F.when(classified > 0, count / classified).when(F.col("total_retrieved") > 0, count / base).otherwise(0.0), 6
        )

    return outcomes.select(
        *keys, rate(F.col("false_positives"), negatives).alias("false_positive_rate"),
        rate(F.col("false_negatives"), positives).alias("false_negative_rate"),
    )


def run_stability(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean pairwise Jaccard and tau over runs.

    ``runs(keys, run, rank, chunk_id, score)``: a run is a top-k list, and there
    are few runs per key.
    """
    lists = runs.groupBy(*keys, "run").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda r: r["chunk_id"]).alias("ids")
    )
    packed = lists.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("run", "ids"))).alias("_runs"))
    firsts = packed.select(*keys, "_runs", F.posexplode("_runs").alias("_i", "a"))
    pairs = firsts.select(*keys, "a", F.explode(F.slice("_runs", F.col("_i") + 2, F.size("_runs"))).alias("b"))
    scored = pairs.select(
        *keys, jaccard(F.col("a.ids"), F.col("b.ids")).alias("j"), kendall_tau(F.col("a.ids"), F.col("b.ids")).alias("t")
    )
    agreement = scored.groupBy(*keys).agg(F.avg("j").alias("_j"), F.avg("t").alias("_t"))
    variance = runs.groupBy(*keys).agg(
        F.round(F.coalesce(F.var_pop("score"), F.lit(0.0)), 4).alias("score_variance"),
        F.count_distinct("run").alias("num_retrievals"),
    )
    return variance.join(agreement, list(keys), "left").select(
        *keys, "num_retrievals",
        F.round(F.coalesce("_j", F.lit(0.0)), 4).alias("jaccard_similarity"),
        F.round(F.coalesce("_t", F.lit(0.0)), 4).alias("kendall_tau"),
        F.round((F.coalesce("_j", F.lit(0.0)) + F.coalesce("_t", F.lit(0.0))) / 2, 4).alias("semantic_stability"),
        "score_variance",
        (F.col("_j").isNull() | (F.col("_j") >= STABLE_AT)).alias("is_stable"),
    )


Retriever = Callable[[DataFrame], DataFrame]


def repeated_runs(queries: DataFrame, retriever: Retriever, n: int = 3) -> DataFrame:
    """Run any retriever ``n`` times and label the runs."""
    runs = None
    for i in range(n):
        run = retriever(queries).withColumn("run", F.lit(i))
        runs = run if runs is None else runs.unionByName(run)
    return runs


def compare_configs(queries: DataFrame, retrievers: dict[str, Retriever], qrels: DataFrame | None,
                    keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Metrics per (config, query) and their macro averages per config."""
    per_query = None
    for name, retriever in retrievers.items():
        ranked = retriever(queries)
        judged = qrels if qrels is not None else qrels_by_first(ranked, keys)
        metrics = ranking_metrics(ranked, judged, keys, queries).withColumn("config", F.lit(name))
        per_query = metrics if per_query is None else per_query.unionByName(metrics)
    measures = [c for c in per_query.columns if c not in (*keys, "config")]
    return per_query, per_query.groupBy("config").agg(*[settled(F.avg(m), 4).alias(m) for m in measures])
