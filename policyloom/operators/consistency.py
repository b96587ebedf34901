"""Cross-dimension consistency: six checks, a score, and the confidence penalty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from policyloom import lexicons as lx
from policyloom.operators.rules import drift_score
from policyloom.session import cut_lineage

# --- fixed values -----------------------------------------------------------
SCORE_STEP = 0.15
PENALTY = 0.8
PENALTY_ABOVE = 0.5

def edge_table(spark: SparkSession, edges=lx.GRAPH_EDGES) -> DataFrame:
    return spark.createDataFrame(list(dict.fromkeys(edges)), "parent string, child string, rel string")


def subset_table(spark: SparkSession, edges=lx.SUBSET_EDGES) -> DataFrame:
    return spark.createDataFrame(list(edges), "parent string, child string")


def _violation(kind: str, severity: str, related: Column | None = None, dimension: Column | None = None) -> Column:
    return F.struct(
        (F.col("dimension") if dimension is None else dimension).alias("dimension"),
        F.lit(kind).alias("violation_type"), F.lit(severity).alias("severity"),
        (F.lit("") if related is None else related).alias("related"),
    )


def _own_checks(lexicon: lx.Lexicon) -> list[Column]:
    """Checks that read one dimension's row; null where it passes."""
    coverage, risk = F.col("coverage"), F.col("risk_level")
    incoherent = ((coverage == "Partial") & ~risk.isin("Low", "Medium")) | (
        (coverage == "Missing") & ~risk.isin("Medium", "High")
    )
    judged = coverage != "Insufficient Evidence"
    none = judged & (F.col("n_evidence") == 0)
    some = judged & (F.col("n_evidence") > 0)
    unnamed = some & coverage.isin("Missing", "Partial") & (F.col("n_named_evidence") == 0)
    silent = some & (F.col("n_positions") > 0) & F.coalesce("recommendation", F.lit("")).isin(
        "", "No recommendation provided."
    )
    collision = (F.coalesce("synthesis", F.lit("")) != "") & (F.col("synthesis") == F.col("recommendation"))
    drifted = (coverage == "Covered") & (drift_score(F.col("synthesis"), lexicon) > 0)
    return [
        F.when(incoherent, _violation("risk_coverage_mismatch", "error", risk)),
        F.when(none, _violation("missing_evidence", "error")),
        F.when(unnamed, _violation("missing_framework_evidence", "warning")),
        F.when(silent, _violation("recommendation_missing", "warning")),
        F.when(judged & (F.col("doc_chunks") == 0), _violation("zero_doc_retrieval", "warning")),
        F.when(collision, _violation("synthesis_recommendation_collision", "warning")),
        F.when(drifted, _violation("covered_synthesis_drift", "warning")),
    ]


def _edge_checks() -> tuple[Column, Column]:
    """Checks of a dimension against its children, as arrays of violations.

    ``_others`` maps the workspace's dimensions to (coverage, ord).  A graph
    pair is judged once, from whichever end comes first in the analysis.
    """
    def other(child: Column) -> Column:
        return F.element_at("_others", child)

    coverage = F.col("coverage")
    below = coverage.isin("Missing", "Partial")

    def graph(child: Column) -> Column:
        first = F.col("ord") < other(child)["ord"]
        short = first & (coverage == "Covered") & (other(child)["coverage"] != "Covered")
        orphan = ~first & (other(child)["coverage"] == "Covered") & below
        return F.when(short, _violation("graph_child_not_covered", "warning", child)).when(
            orphan, _violation("graph_child_covered_but_parent_missing", "error", F.col("dimension"), child)
        )

    def subset(child: Column) -> Column:
        return F.when(
            (other(child)["coverage"] == "Covered") & below, _violation("subset_inconsistency", "error", child)
        )

    uncovered = F.array_sort(F.filter("_subsets", lambda c: other(c)["coverage"] != "Covered"))
    overestimated = F.when(
        (coverage == "Covered") & (F.size(uncovered) > 0),
        _violation("missing_sub_elements", "warning", F.array_join(uncovered, ", ")),
    )
    return (
        F.transform("_children", graph),
        F.concat(F.transform("_subsets", subset), F.array(overestimated)),
    )


def violations(gaps: DataFrame, edges: DataFrame, subsets: DataFrame, lexicon: lx.Lexicon = lx.DEFAULT) -> DataFrame:
    """All violations in one pass over ``gaps``.

    Needs ``workspace_id, dimension, ord, coverage, risk_level, n_evidence,
    n_named_evidence, n_positions, recommendation, doc_chunks, synthesis``.
    Each row gets its workspace's coverages by a window (a workspace has a
    handful of dimensions) and its children by a join with the edge tables.
    """
    def children(table: DataFrame, name: str) -> DataFrame:
        return table.groupBy(F.col("parent").alias("dimension")).agg(F.collect_set("child").alias(name))

    same = Window.partitionBy("workspace_id")
    entry = F.struct("dimension", F.struct("coverage", "ord").alias("state"))
    none = F.array().cast("array<string>")
    seen = (
        gaps.withColumn("_others", F.map_from_entries(F.collect_list(entry).over(same)))
        .join(children(edges, "_children"), "dimension", "left")
        .join(children(subsets, "_subsets"), "dimension", "left")
    )
    for name in ("_children", "_subsets"):
        known = F.filter(F.coalesce(name, none), lambda c: F.map_contains_key("_others", c))
        seen = seen.withColumn(name, known)
    graph, subset = _edge_checks()
    found = F.array_compact(F.concat(F.array(*_own_checks(lexicon)), graph, subset))
    return seen.select("workspace_id", F.explode(found).alias("_v")).select("workspace_id", "_v.*")


def report(workspaces: DataFrame, found: DataFrame) -> DataFrame:
    counts = found.groupBy("workspace_id").agg(
        F.count("*").alias("violation_count"), F.count_if(F.col("severity") == "error").alias("error_count")
    )
    n = F.coalesce("violation_count", F.lit(0))
    return (
        workspaces.join(counts, "workspace_id", "left")
        .withColumn("violation_count", n)
        .withColumn("error_count", F.coalesce("error_count", F.lit(0)))
        .withColumn("consistency_score", F.round(F.greatest(F.lit(0.0), 1.0 - F.col("violation_count") * SCORE_STEP), 2))
        .withColumn("consistency_passed", F.col("violation_count") == 0)
    )


def penalized(score: Column, errors: Column) -> Column:
    """Each error multiplies by 0.8 while the score is still above 0.5."""
    steps = F.sequence(F.lit(1), errors.cast("int"))
    after = F.aggregate(
        F.when(errors > 0, steps).otherwise(F.array().cast("array<int>")), score.cast("double"),
        lambda s, _: F.when(s > PENALTY_ABOVE, F.round(s * PENALTY, 3)).otherwise(s),
    )
    return after


def apply_penalty(gaps: DataFrame, found: DataFrame) -> DataFrame:
    errors = found.filter(F.col("severity") == "error").groupBy("workspace_id", "dimension").agg(
        F.count("*").alias("_errors")
    )
    return (
        gaps.join(errors, ["workspace_id", "dimension"], "left")
        .withColumn("_errors", F.coalesce("_errors", F.lit(0)))
        .withColumn("confidence_score", penalized(F.col("confidence_score"), F.col("_errors")))
        .drop("_errors")
    )


# -- closure -----------------------------------------------------------------

def closure(edges: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """All ancestor-descendant pairs of a directed graph, cycles allowed.

    Path lengths double each round: pairs known so far are joined with
    themselves, so a chain of length n takes log2(n) rounds.  Rounds end when
    no pair is new; lineage is cut by a checkpoint in every round.
    """
    pairs = edges.select(F.col(parent).alias("ancestor"), F.col(child).alias("descendant")).distinct()
    pairs = cut_lineage(pairs)
    size = pairs.count()
    while True:
        longer = pairs.alias("a").join(
            pairs.alias("b"), F.col("a.descendant") == F.col("b.ancestor")
        ).select(F.col("a.ancestor"), F.col("b.descendant"))
        grown = cut_lineage(pairs.unionByName(longer).distinct())
        new_size = grown.count()
        if new_size == size:
            return grown
        pairs, size = grown, new_size


def relationships(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once: neighbour lists per node."""
    down = edges.select(F.col("parent").alias("node"), F.lit("children").alias("relation"), F.col("child").alias("other"))
    up = edges.select(F.col("child").alias("node"), F.lit("parents").alias("relation"), F.col("parent").alias("other"))
    needs = edges.filter(F.col("rel") == "requires")
    requires = needs.select(F.col("parent").alias("node"), F.lit("requires").alias("relation"), F.col("child").alias("other"))
    required = needs.select(F.col("child").alias("node"), F.lit("required_by").alias("relation"), F.col("parent").alias("other"))
    return down.unionByName(up).unionByName(requires).unionByName(required).distinct()
