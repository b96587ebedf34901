"""Filter interaction audit: what each filter removes, in every order, out of the potential of a removal game.

Filters are the players.  A coalition removes the documents that fail at least one of its filters, and what it removes
is its worth.  The Hart-Mas-Colell potential of a coalition S is ``P(S) = (worth(S) + sum of P(S without i)) / |S|``,
``P`` of none is 0; a filter's Shapley value is the potential of all less the potential of all but it.  Times the
factorial of the number of filters, every potential is a whole number, so nothing is rounded.  What a filter removes
after others have been applied is the difference of two coalitions' worths.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SPACE = " \t\n\x0b\f\r"
_RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


@dataclass(frozen=True)
class FilterRules:
    """Limits of the five filters; percentages are of words (distinct) and of code points (upper case)."""

    least_words: int = 200
    distinct_percent: int = 50
    upper_percent: int = 2
    symbols: str = "[#$%&*|]"


def text_failures(text: Column, rules: FilterRules = FilterRules()) -> Column:
    """Bits 1, 2, 4, 8 for the filters A to D that a text fails; a null text counts as empty.

    A: too few words; B: too few distinct words; C: too many of A-Z; D: holds a symbol.  Words are case-sensitive.
    """
    whole = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(whole, F.lit(_SPACE))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    n = F.when(trimmed == "", F.lit(0)).otherwise(F.size(words))
    distinct = F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.array_distinct(words)))
    upper = F.length(whole) - F.length(F.regexp_replace(whole, "[A-Z]+", ""))
    fails = (
        n < rules.least_words,
        100 * distinct.cast("long") < rules.distinct_percent * n.cast("long"),
        100 * upper.cast("long") > rules.upper_percent * F.length(whole).cast("long"),
        whole.rlike(rules.symbols),
    )
    return sum((F.when(fail, 1 << k).otherwise(0) for k, fail in enumerate(fails)), F.lit(0))


def document_failures(docs: DataFrame, labels: DataFrame, rules: FilterRules = FilterRules()) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of each source by the filters A to E that they fail.

    E fails a document whose text a smaller ``doc_id`` has too, anywhere in the table; rows of one id are no smaller
    than each other.  A null id is not smaller than any and fails no E.  A null text counts as empty, a null source as
    the empty string.  A document is good (toxic) if a label row of its id says quality (toxic) 1; null ids have no
    label.  An empty table gives no rows; other columns are left out.

    Texts are read once and become hashes.  Rows of one text are combined by id, then by source and label, before the
    rows of a text meet: at most four for each source.
    """
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("key"), text_failures(F.col("text"), rules).alias("mask"),
    )
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none "), F.hex("key")))
    rows = base.groupBy("key", "mask", "doc_id", "part").agg(F.count("*").alias("n")).withColumn("name", named)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("name")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    marked = rows.join(marks, "name", "left").select(
        "key", "mask", "doc_id", "part", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))
    )
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    some = marked.groupBy("key", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)).alias("known"), first.alias("first")
    )
    least = F.min("first.doc_id").over(Window.partitionBy("key"))
    copies = F.col("known") - F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = some.withColumn("least", least).withColumn("copies", copies).select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct((F.col("mask") + 16).alias("mask"), F.col("copies").alias("n")),
            F.struct(F.col("mask"), (F.col("n") - F.col("copies")).alias("n")),
        )).alias("of"),
    )
    return split.where("of.n > 0").groupBy("part", F.col("of.mask").alias("mask")).agg(
        F.sum("of.n").alias("n"), *(F.sum(F.when(F.col(c), F.col("of.n")).otherwise(0)).alias(c) for c in ("good", "toxic"))
    )


def potentials(worth: np.ndarray, filters: int) -> np.ndarray:
    """The potential of every coalition, times the factorial of the number of filters."""
    whole = math.factorial(filters)
    found = [0] * (1 << filters)
    for s in range(1, 1 << filters):
        members = [1 << i for i in range(filters) if s >> i & 1]
        found[s] = (whole * int(worth[s]) + sum(found[s ^ i] for i in members)) // len(members)
    return np.array(found, dtype=object)


def _audit(names: str):
    k = len(names)
    full = (1 << k) - 1
    masks = np.arange(1 << k)
    meets = (masks[:, None] & masks[None, :]) != 0
    orders = list(itertools.permutations(range(k)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, groups in zip(frame["part"], frame["groups"], strict=True):
                counts = np.zeros((1 << k, 3), np.int64)
                for g in groups:
                    counts[g["mask"]] += (g["n"], g["good"], g["toxic"])
                worth = meets @ counts
                total, removed = int(counts[:, 0].sum()), worth[:, 0]
                potential = potentials(removed, k)
                out = []
                for order in orders:
                    before, name = 0, "".join(names[i] for i in order)
                    for step, i in enumerate(order):
                        now = before | 1 << i
                        here = worth[now] - worth[before]
                        out.append((
                            part, name, step + 1, total - int(removed[now]), int(here[0]), int(removed[1 << i] - here[0]),
                            int(removed[full] - removed[full ^ 1 << i]), int(here[1]), int(here[2]),
                            int(potential[full] - potential[full ^ 1 << i]),
                        ))
                        before = now
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _RESULT.split(", ")])

    return run


def audit_filters(failures: DataFrame, names: str = "ABCDE") -> DataFrame:
    """For each part, every order of the filters and each step: what the filter removes, and its Shapley value.

    ``failures`` has rows ``(part, mask, n, good, toxic)``; bit i of the mask is the filter ``names[i]``.  Columns:
    ``kept`` after the step, ``removed`` by it, ``redundant`` (fail it, removed before), ``unique_fails`` (fail nothing
    else), ``good_lost``, ``toxic_lost`` (of those removed here), ``shapley`` (the sum of what the filter removes over
    all orders).  A part's rows are combined to one for each mask, so one part is one small row for a task.
    """
    sums = failures.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    parts = sums.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("groups"))
    return parts.mapInPandas(_audit(names), _RESULT)
