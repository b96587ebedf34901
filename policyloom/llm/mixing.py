"""Mixing sources to target weights, with DataFrame functions only.

Targets are filled like water by weight, up to a number of epochs of each source.  A schedule of equal slots follows a
low-discrepancy sequence: point i is the fractional part of i times the golden ratio, and the source whose stretch of
the cumulative targets holds it gets the slot.  The k-th slot of a source takes the k-th block of words of its
documents in shuffled order, over and over.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policyloom.session import materialize

#: A prime, and a multiplier near its golden section: i * step mod prime stays within a long.
_PRIME = 2**31 - 1
_STEP = 1327217885
_CELLS = 4096
_WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixSettings:
    """Weights by the sources' order, repeating; a source gives at most ``epochs`` times its words."""

    weights: Sequence[int] = (5, 2, 1)
    epochs: int = 3
    block_words: int = 1024
    seed: int = 17
    bucket_rows: int = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, settings: MixSettings) -> DataFrame:
    """``(source, source_size, weight, target)`` of ``sized (source, size)``.

    In the order of what a source can give for its weight, a source is full if its limit is below its part of what
    the fuller ones before it leave over.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # windows over one row for each source
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(int(w)) for w in settings.weights])
    table = totals.withColumn("turn", turn).withColumn("weight", F.get(cycle, F.col("turn") % len(settings.weights)).cast("double"))
    table = table.withColumn("limit", (F.col("source_size") * settings.epochs).cast("double"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "turn")
    everything = Window.partitionBy()
    table = table.withColumns({
        "before": F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "behind": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        "all": F.sum("source_size").over(everything).cast("double"),
    })
    table = table.withColumn("full", F.col("limit") * F.col("behind") <= F.col("weight") * (F.col("all") - F.col("before")))
    free = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    left = F.col("all") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(everything), F.lit(0.0))
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * (left / free))
    return table.select("source", "turn", "source_size", "weight", target.alias("target"))


def _streams(sized: DataFrame, targets: DataFrame, settings: MixSettings) -> DataFrame:
    """Each row with its place ``[first, first + size)`` in the shuffled words of its source.

    Rows fall into buckets by hash; sums of buckets and of rows inside a bucket give the place, so a source that holds
    most rows is spread over all buckets.
    """
    rows = sized.where("size > 0").withColumn("hash", F.xxhash64("doc_id", "source", F.lit(settings.seed)))
    buckets = max(1, rows.count() // settings.bucket_rows)
    rows = rows.withColumn("bucket", F.pmod("hash", F.lit(buckets))).join(
        targets.select(F.col("source").alias("_source"), "turn", "source_size", "taken_words"),
        F.col("source").eqNullSafe(F.col("_source")),
    ).drop("_source")
    sums = rows.groupBy("turn", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("turn").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("turn", "bucket", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("turn", "bucket").orderBy("hash", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["turn", "bucket"]).withColumn(
        "first", F.col("base") + F.col("inner")
    )


def _slots(targets: DataFrame, settings: MixSettings) -> DataFrame:
    """``(turn, block, slot)``: the slots of each source in their order, as many as it has blocks."""
    spark = targets.sparkSession
    blocks = F.ceil(F.col("taken_words") / settings.block_words)
    table = targets.where("taken_words > 0").withColumn("blocks", blocks.cast("long"))
    total = table.agg(F.sum("blocks")).first()[0] or 0
    # stretches of the points' range, cut at the edges of cells so that points meet them by an equal key
    whole = F.sum("target").over(Window.partitionBy())
    upto = F.sum("target").over(Window.orderBy("turn"))
    edge = lambda share: F.round(share * _PRIME).cast("long")
    stretches = table.select("turn", edge((upto - F.col("target")) / whole).alias("low"), edge(upto / whole).alias("high")).where("low < high")
    size = -(-_PRIME // _CELLS)
    stretches = stretches.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / size), F.floor((F.col("high") - 1) / size))))
    points = spark.range(total).select(
        F.col("id").alias("slot"), ((F.col("id") + 1) % _PRIME * _STEP % _PRIME).alias("point")
    ).withColumn("cell", F.floor(F.col("point") / size))
    dealt = points.join(stretches, "cell").where("point >= low and point < high").select("slot", "turn", F.shiftright("slot", 14).alias("part"))
    counts = dealt.groupBy("turn", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("turn").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0))))
    inside = Window.partitionBy("turn", "part").orderBy("slot")
    ranked = dealt.withColumn("k", F.row_number().over(inside) - 1).join(counts.select("turn", "part", "base"), ["turn", "part"])
    ranked = ranked.withColumn("block", F.col("base") + F.col("k")).join(table.select("turn", "blocks"), "turn").where("block < blocks")
    # the sequence deals a few slots more or fewer than a source has blocks: the missing ones follow at the end
    short = table.join(counts.groupBy("turn").agg(F.sum("n").alias("dealt")), "turn", "left").withColumn(
        "dealt", F.coalesce("dealt", F.lit(0))
    ).where("dealt < blocks")
    more = short.select("turn", F.explode(F.sequence(F.col("dealt"), F.col("blocks") - 1)).alias("block")).withColumn(
        "slot", F.col("block") + total
    )
    return ranked.select("turn", "block", "slot").unionByName(more.select("turn", "block", "slot"))


@dataclass
class Mix:
    """``rows``: every row with its source's numbers; ``plan``: which words of which row fill which slot."""

    rows: DataFrame
    plan: DataFrame


def mix_sources(sized: DataFrame, settings: MixSettings = MixSettings()) -> Mix:
    """The mix of ``sized (row, doc_id, source, size)``, where ``row`` numbers the rows.

    ``rows`` adds ``source_size`` and ``target``.  ``plan`` has ``(slot, row, epoch, from_word, n_words)``: each source
    gives the whole number of words below its target.  A null source is a source of its own, the last one; rows
    without words are never taken; repeated rows are rows of their own.  An empty table gives an empty mix.
    """
    targets = source_targets(sized, settings)
    # a target that is a whole number but for rounding counts as that number
    targets = materialize(targets.withColumn("taken_words", F.floor(F.col("target") + 1e-6).cast("long")))
    streams = _streams(sized, targets, settings)
    epochs = F.sequence(F.lit(0), F.lit(settings.epochs - 1))
    block = settings.block_words
    pieces = streams.withColumn("epoch", F.explode(epochs)).withColumn(
        "low", F.col("epoch") * F.col("source_size") + F.col("first")
    ).withColumn("high", F.least(F.col("low") + F.col("size"), F.col("taken_words"))).where("low < high")
    pieces = pieces.withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block)))
    ).select(
        "turn", "block", "row", "epoch",
        (F.greatest(F.col("low"), F.col("block") * block) - F.col("low")).alias("from_word"),
        (F.least(F.col("high"), (F.col("block") + 1) * block) - F.greatest(F.col("low"), F.col("block") * block)).alias("n_words"),
    )
    plan = pieces.join(_slots(targets, settings), ["turn", "block"]).select("slot", "row", "epoch", "from_word", "n_words")
    rows = sized.join(
        targets.select(F.col("source").alias("_source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    return Mix(rows, plan)


def sized_rows(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, source, size)`` of documents, written once so that row numbers hold."""
    return materialize(docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
    ))


def words_taken(mix: Mix) -> DataFrame:
    """``mix.rows`` with ``taken`` and ``first_slot``: how many words of each row the mix takes, repeats counted, and the
    first slot that takes some, null if none does."""
    taken = mix.plan.groupBy("row").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"))
    return mix.rows.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))


def mixed_documents(docs: DataFrame, settings: MixSettings = MixSettings(), row: Column | None = None) -> DataFrame:
    """The documents as the mix takes them, with the columns of ``docs``.

    A document comes once for each epoch that takes words of it: unchanged if the epoch takes them all, else cut to
    the first words that it takes, joined by one space, with ``n_chars`` to match.  Partitions are ranges of slots, and
    the rows in each are in the order of their first slots.  ``row`` numbers the rows, with longs that stay the same
    whenever ``docs`` is read; without it the rows are written with numbers.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    if row is None:
        numbered = materialize(docs.select(F.monotonically_increasing_id().alias("row"), whole))
    else:
        numbered = docs.select(row.alias("row"), whole)
    sized = materialize(numbered.select(
        "row", "doc.doc_id", F.col("doc.source").cast("string").alias("source"), word_count(F.col("doc.text")).alias("size")
    ))
    mix = mix_sources(sized, settings)
    taken = mix.plan.groupBy("row", "epoch").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("slot"))
    joined = numbered.join(taken, "row").join(sized.select("row", "size"), "row")
    words = F.slice(F.regexp_extract_all("doc.text", F.lit(_WORD), F.lit(0)), 1, F.col("taken").cast("int"))
    cut = F.col("taken") < F.col("size")
    text = F.when(cut, F.array_join(words, " ")).otherwise(F.col("doc.text"))
    columns = []
    for field in docs.schema:
        value = text if field.name == "text" else F.col("doc").getField(field.name)
        if field.name == "n_chars":
            value = F.when(cut, F.length(text).cast(field.dataType)).otherwise(value)
        columns.append(value.alias(field.name))
    # texts are cut behind the exchange, so that sampling its ranges cuts none
    return joined.repartitionByRange("slot", "epoch", "row").sortWithinPartitions("slot", "epoch", "row").select(*columns)
