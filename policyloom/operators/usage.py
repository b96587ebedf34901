"""Usage analytics over a call log: rolling windows and daily budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
WINDOW_SECONDS = 60
REQUESTS_PER_WINDOW = 10
TOKENS_PER_WINDOW = 12_000
REQUESTS_PER_DAY = 1_000
WARNING_SHARE = 0.8

BLOCK_SECONDS = 3600


def rolling_usage(calls: DataFrame, keys: Sequence[str], ts: str = "ts", tokens: Column | None = None,
                  seconds: int = WINDOW_SECONDS, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Requests and tokens in the ``seconds`` up to and including each call (half-open).

    A window's value is the running sum at the call less the running sum at the
    window's start, so the cost does not depend on how many calls a window holds
    or on how the window relates to the block.  Running sums are taken inside
    blocks of time and shifted by the sums of the earlier blocks: a key with very
    many calls is spread over tasks.  A call without a time is in no window: it
    is returned with null sums.
    """
    untimed, calls = calls.where(F.col(ts).isNull()), calls.where(F.col(ts).isNotNull())
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    span, block = seconds * 1_000_000, block_seconds * 1_000_000
    counted = tokens if tokens is not None else F.lit(0)
    ends = F.array(
        F.struct(F.lit(1).alias("sign"), F.col("_us").alias("at")), F.struct(F.lit(-1).alias("sign"), (F.col("_us") - span).alias("at"))
    )
    both = (
        calls.select(F.struct("*").alias("_call"), *keys, micros.alias("_us"), counted.alias("_tokens"))
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_end", F.explode(ends))
        .withColumn("_block", F.floor(F.col("_end.at") / block))
        # a call counts at its own end only; the other end reads the sum there
        .withColumn("_n", (F.col("_end.sign") > 0).cast("long"))
        .withColumn("_tokens", F.col("_tokens") * F.col("_n"))
    )
    upto = Window.partitionBy(*keys, "_block").orderBy("_end.at").rangeBetween(Window.unboundedPreceding, 0)
    blocks = both.groupBy(*keys, "_block").agg(F.sum("_n").alias("_block_n"), F.sum("_tokens").alias("_block_tokens"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    known = [F.col(k).alias(f"_{k}") for k in keys]
    before = blocks.select(
        *known, F.col("_block").alias("_of"), F.coalesce(F.sum("_block_n").over(earlier), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_block_tokens").over(earlier), F.lit(0)).alias("_tokens0"),
    )
    matched = F.col("_block") == F.col("_of")
    for k in keys:
        matched = matched & F.col(k).eqNullSafe(F.col(f"_{k}"))
    sums = both.withColumn("_n", F.sum("_n").over(upto)).withColumn("_tokens", F.sum("_tokens").over(upto)).join(before, matched)
    sign = F.col("_end.sign")
    found = (
        sums.groupBy("_id").agg(
            F.max(F.when(sign > 0, F.col("_call"))).alias("_call"),
            F.sum(sign * (F.col("_n") + F.col("_n0"))).alias("window_requests"),
            F.sum(sign * (F.col("_tokens") + F.col("_tokens0"))).alias("window_tokens"),
        ).select("_call.*", "window_requests", "window_tokens")
    )
    types = dict(found.dtypes)
    return found.unionByName(untimed.select("*", *(F.lit(None).cast(types[c]).alias(c) for c in ("window_requests", "window_tokens"))))


def over_limit(requests: int = REQUESTS_PER_WINDOW, tokens: int = TOKENS_PER_WINDOW) -> Column:
    return (F.col("window_requests") > requests) | (F.col("window_tokens") > tokens)


def daily_budget(calls: DataFrame, keys: Sequence[str] = (), ts: str = "ts", limit: int = REQUESTS_PER_DAY,
                 warn_at: float = WARNING_SHARE) -> DataFrame:
    """Calls per day against the daily limit."""
    day = F.to_date(F.col(ts)).alias("day")
    return calls.groupBy(*keys, day).agg(F.count("*").alias("requests")).withColumn(
        "budget_state",
        F.when(F.col("requests") >= limit, "exhausted")
        .when(F.col("requests") / limit >= warn_at, "warning")
        .otherwise("ok"),
    )
