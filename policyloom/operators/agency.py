"""Responsible agencies: found in the document, implied by it, or honestly absent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyloom import lexicons as lx
from policyloom.functions import text as tx
from policyloom.operators.ordering import first_per_key, top_k

_PHRASE = r"(?U)\b[A-Z][a-zA-Z&.'\-]+(?:\s+(?:of\s+)?[A-Z][a-zA-Z&.'\-]+){1,3}\b"
_ACRONYM = r"(?U)\b[A-Z]{2,}[A-Za-z]*\b|\b[A-Z][a-z]+[A-Z][a-zA-Z]*\b"


def institution_candidates(recommendations: DataFrame, keys: Sequence[str],
                           designators: Sequence[str] = lx.AGENCY_DESIGNATORS) -> DataFrame:
    """Named bodies in ``recommendations(keys, rec_no, text)``: phrases first, then acronyms."""
    phrases = F.regexp_extract_all("text", F.lit(_PHRASE), F.lit(0))
    acronyms = F.regexp_extract_all("text", F.lit(_ACRONYM), F.lit(0))
    first_word = F.lower(F.substring_index(tx.normalized(F.col("name")), " ", 1))
    designated = F.exists(tx.words(F.lower("name")), lambda w: w.isin(*designators))
    by_phrase = (
        recommendations.select(*keys, "rec_no", F.posexplode(phrases).alias("at", "name"))
        .filter(~first_word.isin(*lx.AGENCY_SKIP_WORDS) & designated)
        .withColumn("kind", F.lit(0))
    )
    by_acronym = (
        recommendations.select(*keys, "rec_no", F.posexplode(acronyms).alias("at", "name"))
        .filter(~F.lower("name").isin(*lx.AGENCY_SKIP_WORDS) & (F.length("name") > 1))
        .withColumn("kind", F.lit(1))
    )
    return first_per_key(by_phrase.unionByName(by_acronym), [*keys, "name"], ["kind", "rec_no", "at"])


def grounded_institutions(recommendations: DataFrame, passages: DataFrame, keys: Sequence[str],
                          scope: str, limit: int = 2,
                          designators: Sequence[str] = lx.AGENCY_DESIGNATORS) -> DataFrame:
    """At most two candidates per key whose name stands verbatim in the scope's text.

    ``passages(scope, text)`` stays in its pieces: names are tested passage by
    passage, so the whole document is never put together.
    """
    candidates = institution_candidates(recommendations, keys, designators)
    names = candidates.groupBy(scope).agg(F.collect_set("name").alias("_names"))
    lowered = F.lower("text")
    present = (
        passages.select(scope, "text")
        .join(names, scope)
        .select(scope, F.explode(F.filter("_names", lambda n: F.contains(lowered, F.lower(n)))).alias("name"))
        .distinct()
    )
    found = candidates.join(present, [scope, "name"])
    return top_k(found, list(keys), [F.asc("kind"), F.asc("rec_no"), F.asc("at")], limit, "place")


def grounding(claims: DataFrame, passages: DataFrame, keys: Sequence[str], lexicon: lx.Lexicon = lx.DEFAULT) -> DataFrame:
    """Re-ground ``claims(keys, dimension, agency, grounding)`` in the dimension's passages."""
    name = tx.strip(F.coalesce("agency", F.lit("")))
    stated = F.lower(tx.strip(F.coalesce("grounding", F.lit(""))))
    topical = passages.filter(tx.on_topic(F.col("text"), F.col("dimension"), lexicon.topics)).select(
        *keys, F.lower("text").alias("_text"), tx.has_keyword(F.col("text"), lexicon.named_body).alias("_body")
    )
    evidence = (
        claims.select(*keys, F.lower(name).alias("_name"))
        .join(topical, list(keys))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("_topical"),
            F.max(F.contains(F.col("_text"), F.col("_name")) & F.col("_body")).alias("_found"),
        )
    )
    judged = claims.join(evidence, list(keys), "left").withColumn("_name", name).withColumn("_stated", stated)
    claimed = F.col("_stated").isin("document_named", "document_implied")
    possible = claimed & (F.col("_name") != "") & (F.coalesce("_topical", F.lit(0)) > 0)
    found = possible & F.coalesce("_found", F.lit(False))
    implied = possible & (F.col("_stated") == "document_implied") & tx.has_keyword(F.col("_name"), lexicon.named_body)
    honest = ~claimed & F.contains(F.lower("_name"), F.lit("not specified by policy"))
    return (
        judged.withColumn(
            "grounding",
            F.when(found, F.col("_stated")).when(implied, "document_implied").otherwise("none_identified"),
        )
        .withColumn("agency", F.when(found | implied | honest, F.col("_name")).otherwise(lx.NO_AGENCY_TEXT))
        .drop("_name", "_stated", "_topical", "_found")
    )


def reconcile(agencies: DataFrame, institutions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where no agency is assigned, note the bodies the recommendations name."""
    names = institutions.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda s: s["name"]).alias("_names")
    )
    return agencies.join(names, list(keys), "left").withColumn(
        "agency",
        F.when(
            (F.col("grounding") == "none_identified") & F.col("_names").isNotNull(),
            agency_note(F.col("agency"), F.col("_names")),
        ).otherwise(F.col("agency")),
    ).drop("_names")


def agency_note(agency: Column, names: Column) -> Column:
    many = F.size(names) > 1
    return F.concat(
        agency, F.lit(" Module 2 recommends tasking "), F.array_join(names, " and "),
        F.lit("; the policy names "), F.when(many, "these bodies").otherwise("this body"),
        F.lit(" but does not assign it this responsibility."),
    )
