"""Ranking and running-sum building blocks that stay spread out under skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
    spread_by: str | None = None,
) -> DataFrame:
    """Best ``k`` rows per key, ranked from 1.

    With ``spread_by`` the rows of one key are first ranked in salted parts, so
    a key with very many rows is never sorted by a single task.
    """
    if spread_by is not None:
        part = F.pmod(F.xxhash64(spread_by), F.lit(SALTS))
        first = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = (
            df.withColumn("_part", part)
            .withColumn("_first", F.row_number().over(first))
            .filter(F.col("_first") <= k)
            .drop("_part", "_first")
        )
    window = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``; partial minima are taken before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*order, *rest)
    return (
        df.groupBy(*keys)
        .agg(F.min(packed).alias("_row") if _orderable(df, rest) else
             F.min_by(packed, F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def _orderable(df: DataFrame, columns: Sequence[str]) -> bool:
    return not any("map<" in dict(df.dtypes)[c] for c in columns)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: Column,
    name: str,
    block: int | None = None,
) -> DataFrame:
    """Sum of ``value`` over rows of the same key up to and including this one.

    Without ``block`` this is one window, right for keys of bounded size (the
    pages of a document).  With ``block``, integer positions are cut into blocks
    of that many: block sums are aggregated first and added to a running sum
    inside the block, so one key holding much of the data spreads over tasks.
    """
    if block is None:
        whole = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(value.cast("long")).over(whole))
    valued = df.withColumn("_value", value.cast("long")).withColumn(
        "_block", F.floor(F.col(position) / block).cast("long")
    )
    by_block = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        valued.groupBy(*keys, "_block")
        .agg(F.sum("_value").alias("_sum"))
        .select(*keys, "_block", F.coalesce(F.sum("_sum").over(by_block), F.lit(0)).alias("_before"))
    )
    inside = (
        Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        valued.join(before, [*keys, "_block"])
        .withColumn(name, F.col("_before") + F.sum("_value").over(inside))
        .drop("_value", "_block", "_before")
    )
