"""Budgeted retrieval per dimension: buckets, caps, reserves, samples, merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from policyloom import lexicons as lx
from policyloom.functions import text as tx
from policyloom.operators.nearest import attach_columns, nearest, reciprocal_rank_fusion, retrieve
from policyloom.operators.ordering import first_per_key, top_k
from policyloom.session import materialize

# --- fixed values: budgets --------------------------------------------------
FIRST_PASS_CAPS = {lx.NORMATIVE: 4, lx.PRACTICAL: 3, "document": 4}
SECOND_PASS_CAPS = {lx.IMPLEMENTATION: 3, lx.INCIDENT: 3, "document": 2}
PROMPT_CHARS = 800
OVERVIEW_CHARS = 900
BUCKET_HEADROOM = 3
SECOND_PASS_HEADROOM = 2
DOCUMENT_HEADROOM = 5
DEFINITION_K = 10
ASPECT_K = 5
OVERVIEW_K = 10
SECTION_SAMPLE = 2
SWEEP_HEADROOM = 3


def profile_queries(spark: SparkSession, profiles: dict | None = None) -> DataFrame:
    """``(dimension, query_no, text)``: definition as query 0, then the aspects."""
    profiles = lx.PROFILES if profiles is None else profiles
    rows = [(d, i, t) for d, texts in profiles.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "dimension string, query_no int, text string")


def document_candidates(
    chunks: DataFrame, queries: DataFrame, candidates: int, scope: str = "workspace_id",
    carry: Sequence[str] = ("text",), id_column: str = "chunk_id", texts: DataFrame | None = None,
) -> DataFrame:
    """Multi-query retrieval inside each workspace: one ranked list per profile text, fused.

    Keeps the fused best ``candidates`` per workspace and dimension, each with
    its best similarity over the queries.  They are written first, so that
    ``carry`` is read for them alone, from ``texts`` (one row for each id) or else ``chunks``.
    """
    ranked = nearest(chunks, queries, candidates, query_keys=["dimension", "query_no"], scope=scope, id_column=id_column)
    keys = [scope, "dimension"]
    fused = reciprocal_rank_fusion(ranked, keys, id_column).withColumnRenamed("best_similarity", "similarity")
    best = top_k(fused, keys, [F.desc("rrf_score"), F.asc(id_column)], candidates)
    return attach_columns(materialize(best) if carry else best, chunks if texts is None else texts, id_column, carry)


def full_profile(chunks: DataFrame, queries: DataFrame, id_column: str = "chunk_id") -> DataFrame:
    """Corpus-wide multi-query fusion; the definition brings 10, each aspect 5."""
    ranked = nearest(
        chunks, queries, DEFINITION_K, query_keys=["dimension", "query_no"], carry=["framework"],
        id_column=id_column,
    ).filter((F.col("query_no") == 0) | (F.col("rank") <= ASPECT_K))
    fused = reciprocal_rank_fusion(ranked, ["dimension", "framework"], id_column)
    return fused.withColumn("is_document", F.coalesce("framework", F.lit("")) == "")


def substantive_first(df: DataFrame, rank: str = "rank") -> DataFrame:
    """Real passages before fragments; the given order is kept inside each class."""
    return df.withColumn("_fragment", tx.is_fragment(F.col("text")))


def bucket_order(caps: dict[str, int]):
    return F.create_map(*[F.lit(v) for pair in zip(caps, range(len(caps))) for v in pair])


def fill_buckets(candidates: DataFrame, caps: dict[str, int] | None = None,
                 keys: Sequence[str] = ("workspace_id", "dimension"), chars: int | None = PROMPT_CHARS) -> DataFrame:
    """First-pass budgets.

    Whole texts decide what is a repeat or a fragment; the text that is returned
    is cut to ``chars``.

    ``candidates``: keys, bucket, rank, chunk_id, text, ... .  A chunk id counts
    once over all buckets (in bucket order), a text once inside a bucket, and
    each bucket is cut to its cap with substantive passages first.  Candidates
    may bring ``text_key`` and ``is_fragment`` in place of the text.
    """
    caps = FIRST_PASS_CAPS if caps is None else caps
    known = "text_key" in candidates.columns
    prepared = (
        candidates.withColumn("_bucket", bucket_order(caps)[F.col("bucket")])
        .withColumn("_fragment", F.col("is_fragment") if known else tx.is_fragment(F.col("text")))
        .withColumn("_text", F.col("text_key") if known else tx.text_key(F.col("text")))
    )
    order = ["_bucket", "_fragment", "rank", "chunk_id"]
    by_id = first_per_key(prepared, [*keys, "chunk_id"], order[:-1])
    by_text = first_per_key(by_id, [*keys, "bucket", "_text"], order)
    slot = Window.partitionBy(*keys, "bucket").orderBy("_fragment", "rank", "chunk_id")
    cap = F.create_map(*[F.lit(v) for pair in caps.items() for v in pair])[F.col("bucket")]
    filled = by_text.withColumn("slot", F.row_number().over(slot)).filter(F.col("slot") <= cap)
    if chars and "text" in candidates.columns:
        filled = filled.withColumn("text", F.substring("text", 1, chars))
    return filled.drop("_bucket", "_fragment", "_text")


def fill_buckets_in_turn(candidates: DataFrame, caps: dict[str, int] | None = None,
                         text_unique: Sequence[str] = (lx.IMPLEMENTATION,),
                         keys: Sequence[str] = ("workspace_id", "dimension")) -> DataFrame:
    """Second-pass budgets: buckets are filled one after the other.

    Ids looked at while filling a bucket are closed to later buckets; ids past
    a bucket's cap are not.  Only the listed buckets drop repeated texts.  A
    key's candidates are its retrieval cuts, some twenty rows: their ids and the
    hashes of their texts are folded in order, and the texts join the winners.
    """
    caps = SECOND_PASS_CAPS if caps is None else caps
    number = F.create_map(*[F.lit(v) for pair in zip(caps, range(len(caps))) for v in pair])[F.col("bucket")]
    cap = F.create_map(*[F.lit(v) for pair in caps.items() for v in pair])[F.col("bucket")]
    once = F.col("bucket").isin(*text_unique) if text_unique else F.lit(False)
    row = F.struct(
        number.alias("b"), tx.is_fragment(F.col("text")).alias("f"), "rank", "chunk_id", F.md5(tx.text_key(F.col("text"))).alias("t"),
        cap.alias("cap"), once.alias("once"),
    )
    id_type = dict(candidates.dtypes)["chunk_id"]
    listed = candidates.filter(number.isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    start = F.struct(
        F.array().cast(f"array<{id_type}>").alias("seen"), F.array().cast("array<string>").alias("texts"), F.lit(0).alias("taken"),
        F.lit(-1).alias("b"), F.array().cast(f"array<struct<b:int,chunk_id:{id_type},slot:int>>").alias("picks"),
    )

    def step(acc: Column, x: Column) -> Column:
        fresh = acc["b"] != x["b"]
        taken = F.when(fresh, F.lit(0)).otherwise(acc["taken"])
        texts = F.when(fresh, F.array().cast("array<string>")).otherwise(acc["texts"])
        looks = (taken < x["cap"]) & ~F.array_contains(acc["seen"], x["chunk_id"])
        picks = looks & ~(x["once"] & F.array_contains(texts, x["t"]))
        return F.struct(
            F.when(looks, F.array_append(acc["seen"], x["chunk_id"])).otherwise(acc["seen"]).alias("seen"),
            F.when(picks, F.array_append(texts, x["t"])).otherwise(texts).alias("texts"),
            F.when(picks, taken + 1).otherwise(taken).alias("taken"), x["b"].alias("b"),
            F.when(picks, F.array_append(acc["picks"], F.struct(x["b"].alias("b"), x["chunk_id"].alias("chunk_id"), (taken + 1).alias("slot"))))
            .otherwise(acc["picks"]).alias("picks"),
        )

    found = listed.select(*keys, F.explode(F.aggregate("_rows", start, step)["picks"]).alias("_pick"))
    names = F.element_at(F.array(*map(F.lit, caps)), F.col("_pick.b") + 1)
    chosen = found.select(*keys, names.alias("bucket"), F.col("_pick.chunk_id").alias("chunk_id"), F.col("_pick.slot").alias("slot"))
    rows = first_per_key(candidates, [*keys, "bucket", "chunk_id"], ["rank"])
    return rows.join(chosen, [*keys, "bucket", "chunk_id"]).select(
        *(F.substring("text", 1, PROMPT_CHARS).alias("text") if c == "text" else F.col(c) for c in candidates.columns), "slot"
    )


def enforce_reserve(filled: DataFrame, reserved: DataFrame, budget: int, reserve: int = 1,
                    keys: Sequence[str] = ("workspace_id", "dimension")) -> DataFrame:
    """Guarantee ``reserve`` rows of one bucket to reserved sources.

    ``filled`` is the budgeted bucket (with ``slot``), ``reserved`` the routed
    sources' candidates (with ``rank``); both carry ``is_reserved``.  A
    candidate whose text is not in the bucket yet takes the place of the last
    row that is not reserved, or a free slot.  Texts are compared by a column
    ``text_key``, or else by ``text``.

    Candidates are ranked from the head and rows that may go from the tail; the
    n-th of the ones meets the n-th of the others, all in windows over the key.
    """
    columns = filled.columns
    text = F.col("text_key") if "text_key" in columns else tx.text_key(F.col("text"))
    both = filled.withColumn("_place", F.col("slot")).withColumn("_new", F.lit(False)).unionByName(
        reserved.withColumn("_place", F.col("rank")).withColumn("_new", F.lit(True)).select(
            *columns, "_place", "_new")
    ).withColumn("_text", text)
    every = Window.partitionBy(*keys)
    same_text = Window.partitionBy(*keys, "_text")
    first = F.row_number().over(Window.partitionBy(*keys, "_text", "_new").orderBy("_place", "chunk_id")) == 1
    there = F.max((~F.col("_new")).cast("int")).over(same_text) == 1
    marked = both.withColumn("_fresh", F.col("_new") & first & ~there).filter("_fresh or not _new")
    kind = F.when(F.col("_fresh"), 0).when(~F.col("is_reserved"), 1).otherwise(2)
    place = F.when(F.col("_fresh"), F.col("_place")).otherwise(-F.col("_place"))
    marked = marked.withColumn("_kind", kind).withColumn(
        "_nth", F.row_number().over(Window.partitionBy(*keys, "_kind").orderBy(place, "chunk_id"))
    )

    def count(kind: int) -> Column:
        return F.count(F.when(F.col("_kind") == kind, 1)).over(every)

    room = count(1) + F.greatest(F.lit(0), budget - count(1) - count(2))
    swaps = F.least(reserve - count(2), count(0), room)
    marked = marked.withColumn("_swaps", F.greatest(F.lit(0), swaps)).withColumn("_open", count(1)).withColumn("_size", count(1) + count(2))
    pair = F.when(F.col("_kind") < 2, F.col("_nth"))
    freed = F.max(F.when(F.col("_kind") == 1, F.col("slot"))).over(Window.partitionBy(*keys, pair))
    slot = F.when(F.col("_kind") > 0, F.col("slot")).otherwise(
        F.when(F.col("_nth") <= F.col("_open"), freed).otherwise(F.col("_size") + F.col("_nth") - F.col("_open")))
    stays = ((F.col("_kind") == 0) & (F.col("_nth") <= F.col("_swaps"))) | (F.col("_kind") == 2) | (
        (F.col("_kind") == 1) & (F.col("_nth") > F.col("_swaps")))
    out = marked.withColumn("_slot", slot).filter(stays).withColumn("is_reserved", F.col("is_reserved") | F.col("_fresh"))
    renumbered = F.row_number().over(Window.partitionBy(*keys).orderBy("_slot"))
    return out.withColumn("slot", renumbered.cast(dict(filled.dtypes)["slot"])).select(*columns)


# -- whole-document overview -------------------------------------------------

def section_sample(chunks: DataFrame, per_section: int = SECTION_SAMPLE,
                   scope: str = "workspace_id") -> DataFrame:
    """First non-boilerplate chunks of every section, in document order."""
    usable = chunks.filter(~tx.is_preamble(F.col("text"), F.col("page_number"))).withColumn(
        "section_title",
        F.coalesce(F.nullif(tx.strip(F.coalesce("section_title", F.lit(""))), F.lit("")), F.lit("(unsectioned)")),
    )
    return top_k(usable, [scope, "section_title"], [F.asc("position")], per_section, "pick", spread_by="chunk_id")


def topic_sweep(chunks: DataFrame, topics: DataFrame, top: int = OVERVIEW_K,
                scope: str = "workspace_id", carry: Sequence[str] = ()) -> DataFrame:
    """Hits of every topic query inside each workspace, in query order."""
    per_query = max(2, top // 2) * SWEEP_HEADROOM
    hits = retrieve(chunks, topics, per_query, query_keys=["query_no"], scope=scope,
                    carry=list(dict.fromkeys(["text", "page_number", *carry])))
    return hits.filter(~tx.is_preamble(F.col("text"), F.col("page_number")))


def interleave(picks: DataFrame, sweep: DataFrame, top: int = OVERVIEW_K,
               scope: str = "workspace_id") -> DataFrame:
    """Alternate section picks and sweep hits; ids and texts, but for case and outer blanks, count once.

    Inputs: scope, position, chunk_id, text (an id always has the same text).
    Repeats inside one list are dropped first; then at most two rows of a list can be blocked by each row
    accepted from the other, so ``3 * top`` rows of each list are enough.
    """
    def lead(df: DataFrame, side: int) -> DataFrame:
        keyed = df.select(scope, "position", "chunk_id", "text").withColumn(
            "opening", F.md5(F.lower(tx.strip(F.col("text"))))
        )
        by_id = first_per_key(keyed, [scope, "chunk_id"], ["position"])
        by_text = first_per_key(by_id, [scope, "opening"], ["position", "chunk_id"])
        return top_k(by_text, [scope], [F.asc("position"), F.asc("chunk_id")], 3 * top,
                     spread_by="chunk_id").withColumn("side", F.lit(side))

    both = lead(picks, 0).unionByName(lead(sweep, 1))
    id_type = dict(picks.dtypes)["chunk_id"]
    entry = f"struct<rank:int,chunk_id:{id_type},opening:string>"
    row = F.struct(F.col("rank").cast("int").alias("rank"), "chunk_id", "opening")
    lists = both.groupBy(scope).agg(*(
        F.array_sort(F.collect_list(F.when(F.col("side") == side, row))).cast(f"array<{entry}>").alias(name) for side, name in enumerate("ab")
    ))
    start = F.struct(F.lit(1).alias("i"), F.lit(1).alias("j"), F.array().cast(f"array<{entry}>").alias("taken"))

    def step(acc: Column, _: Column) -> Column:
        """Look at the next row of the list whose turn it is, or of the other if that is used up."""
        more_a, more_b = acc["i"] <= F.size("a"), acc["j"] <= F.size("b")
        from_a = F.when(F.size(acc["taken"]) % 2 == 0, more_a).otherwise(~more_b)
        x = F.when(from_a, F.get("a", acc["i"] - 1)).otherwise(F.get("b", acc["j"] - 1))
        known = F.exists(acc["taken"], lambda t: (t["chunk_id"] == x["chunk_id"]) | (t["opening"] == x["opening"]))
        picks = (F.size(acc["taken"]) < top) & ~known
        return F.struct(
            F.when(from_a, acc["i"] + 1).otherwise(acc["i"]).alias("i"), F.when(from_a, acc["j"]).otherwise(acc["j"] + 1).alias("j"),
            F.when(picks, F.array_append(acc["taken"], x)).otherwise(acc["taken"]).alias("taken"),
        )

    steps = F.when(F.size("a") + F.size("b") > 0, F.sequence(F.lit(1), F.size("a") + F.size("b"))).otherwise(F.array().cast("array<int>"))
    taken = F.aggregate(steps, start, step)["taken"]
    mixed = lists.select(scope, F.posexplode(taken).alias("_no", "_row")).select(
        scope, (F.col("_no") + 1).alias("rank"), F.col("_row.chunk_id").alias("chunk_id")
    )
    texts = first_per_key(picks.select(scope, "chunk_id", "text").unionByName(sweep.select(scope, "chunk_id", "text")), [scope, "chunk_id"], ["text"])
    return mixed.join(texts, [scope, "chunk_id"]).select(scope, "rank", "chunk_id", F.substring("text", 1, OVERVIEW_CHARS).alias("text"))


def merge_hits(framework_hits: DataFrame, document_hits: DataFrame, keys: Sequence[str], k: int = 10) -> DataFrame:
    """Framework hits before document hits, first id wins, best ``k`` by similarity."""
    both = framework_hits.withColumn("_source", F.lit(0)).unionByName(
        document_hits.withColumn("_source", F.lit(1))
    )
    unique = first_per_key(both, [*keys, "chunk_id"], ["_source", "rank"])
    order = [F.desc("similarity"), F.asc("_source"), F.asc("rank")]
    return top_k(unique.withColumnRenamed("rank", "_rank").withColumn("rank", F.col("_rank")), keys, order, k,
                 "merged_rank").drop("_source", "_rank")


# -- small rankings ----------------------------------------------------------

def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key; the newest is found before the shuffle on each side."""
    packed = F.struct(*[c for c in df.columns if c not in keys])
    return (
        df.groupBy(*keys)
        .agg(F.max_by(packed, F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def ordered_names(df: DataFrame, name: str) -> DataFrame:
    """Distinct non-blank names in order."""
    cleaned = F.trim(F.coalesce(F.col(name), F.lit("")))
    return df.select(cleaned.alias(name)).filter(F.col(name) != "").distinct().orderBy(name)
