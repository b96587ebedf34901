"""Citation verification: does the chunk exist, is the page right, does the text support the claim."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyloom import lexicons as lx
from policyloom.functions import text as tx
from policyloom.functions.numbers import settled
from policyloom.functions.vectors import HashingEmbedder, batch_embed, dot, round_half_up
from policyloom.operators.nearest import DENSE_HEADROOM, VECTOR, attach_columns, hybrid_rerank, nearest_in_groups, retrieve
from policyloom.operators.ordering import first_per_key, top_k
from policyloom.session import materialize

# --- fixed values: thresholds -----------------------------------------------
SEMANTIC_MIN = 0.65
PARTIAL_MIN = 0.45
KEYWORD_MIN = 0.30
CHAT_OVERLAP_MIN = 0.25
QUOTE_CHARS = 300
FALLBACK_CITATIONS = 2
NO_CHUNK = "Cited chunk_id does not exist in the vector store."


def text_similarity(embedder=None):
    """Column function: cosine of two texts' embeddings, to six decimals."""
    model = embedder or HashingEmbedder()

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            scores = (model(left.tolist()) * model(right.tolist())).sum(axis=1)
            yield pd.Series(round_half_up(scores))

    return lambda a, b: run(a, b)


def resolve_labels(citations: DataFrame, retrieved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Prompt labels (``DOC-1``, ``NORM-2`` ...) become the chunk ids they stood for."""
    labels = retrieved.select(*keys, prompt_label(F.col("bucket"), F.col("slot")).alias("_label"),
                              F.col("chunk_id").alias("_real"))
    return (
        citations.join(labels, [*[citations[k] == labels[k] for k in keys], citations["chunk_id"] == labels["_label"]],
                       "left")
        .select(*[citations[c] for c in citations.columns if c != "chunk_id"],
                F.coalesce(labels["_real"], citations["chunk_id"]).alias("chunk_id"))
    )


def prompt_label(bucket: Column, slot: Column) -> Column:
    prefix = (
        F.when(bucket == lx.NORMATIVE, "NORM")
        .when(bucket == lx.PRACTICAL, "PRAC")
        .when(bucket == lx.IMPLEMENTATION, "IMPL")
        .when(bucket == lx.INCIDENT, "INC")
        .otherwise("DOC")
    )
    return F.concat(prefix, F.lit("-"), slot.cast("string"))


def verify_citations(
    citations: DataFrame, chunks: DataFrame, similarity=None, semantic: bool = True,
) -> DataFrame:
    """Check ``citations(chunk_id, claim, page_number, total_pages)`` against the chunk store.

    Adds the three checks, the method that decided, its confidence, the joined
    failure reasons and ``passed``.  Chunks with stored vectors are not embedded
    again: a claim's vector meets that of its chunk.  Chunks that many claims cite may bring ``lowered_words`` of their
    texts, and claims a ``claim_vector``.
    """
    known = similarity is None and VECTOR in chunks.columns
    read = "lowered_words" in chunks.columns
    similarity = similarity or text_similarity()
    stored = chunks.select(
        "chunk_id", F.col("text").alias("_text"), F.col("page_number").alias("_page"), F.lit(True).alias("_exists"),
        *([F.col(VECTOR).alias("_vector")] if known and semantic else []),
        *([F.col("lowered_words").alias("_words")] if read else []),
    )
    found = citations.join(stored, "chunk_id", "left")
    exists = F.coalesce("_exists", F.lit(False))
    page, limit = F.col("page_number"), F.col("total_pages")
    wrong_page = F.coalesce(page != F.col("_page"), F.lit(False))
    past_end = F.coalesce((limit > 0) & (page > 0) & (page > limit), F.lit(False))
    checked = (
        found.withColumn("chunk_exists", exists)
        .withColumn("page_exists", exists & ~wrong_page & ~past_end)
        .withColumn("keyword_overlap", F.when(exists, tx.keyword_overlap(F.col("claim"), F.col("_text"), F.col("_words") if read else None)))
    )
    if semantic:
        if known:
            claimed = F.col("claim_vector") if "claim_vector" in citations.columns else batch_embed()(F.col("claim"))
            met = F.floor(dot(claimed, F.col("_vector")) * 10**6 + 0.5) / 10**6
        else:
            met = similarity(F.coalesce("claim", F.lit("")), F.coalesce("_text", F.lit("")))
        checked = checked.withColumn("semantic_similarity", F.when(exists, met))
        by_meaning = F.col("semantic_similarity") >= SEMANTIC_MIN
        by_words = F.col("keyword_overlap") >= KEYWORD_MIN
        supports = by_meaning | by_words
        method = F.when(~by_meaning & by_words, "hybrid_keyword_fallback").otherwise("semantic")
        confidence = F.when(~by_meaning & by_words, F.col("keyword_overlap")).otherwise(F.col("semantic_similarity"))
        weak = F.format_string(
            "Semantic similarity %.3f below threshold 0.65 (keyword overlap: %.2f).",
            "semantic_similarity", "keyword_overlap",
        )
    else:
        terms = F.size(tx.key_terms(F.col("claim")))
        hits = F.round(F.col("keyword_overlap") * terms)
        supports = hits >= F.greatest(F.lit(3.0), terms * KEYWORD_MIN)
        method = F.lit("keyword_only")
        confidence = F.col("keyword_overlap")
        checked = checked.withColumn("semantic_similarity", F.lit(None).cast("double"))
        weak = F.lit(
            "The retrieved chunk's text does not contain sufficient evidence to support the claimed "
            "statement (insufficient term overlap)."
        )
    supports = exists & F.coalesce(supports, F.lit(False))
    reasons = F.concat_ws(
        "; ",
        F.when(~exists, NO_CHUNK),
        F.when(exists & wrong_page,
               F.concat(F.lit("Claimed page "), page.cast("string"), F.lit(" does not match stored page "),
                        F.col("_page").cast("string"), F.lit("."))),
        F.when(exists & past_end,
               F.concat(F.lit("Page "), page.cast("string"), F.lit(" exceeds document length ("),
                        limit.cast("string"), F.lit(" pages)."))),
        F.when(exists & ~supports, weak),
    )
    return (
        checked.withColumn("text_supports_claim", supports)
        .withColumn("passed", supports & F.col("page_exists"))
        .withColumn("verification_method", F.when(~exists, "identity_check").otherwise(method))
        .withColumn("verification_confidence", settled(F.when(exists, confidence).otherwise(0.0), 4))
        .withColumn("failure_reason", F.nullif(reasons, F.lit("")))
        .drop("_text", "_page", "_exists", "_vector", "_words", "claim_vector")
    )


def support_status(claim: Column, text: Column, entailment: Column | None = None,
                   neutral: Column | None = None, contradiction: Column | None = None,
                   similarity: Column | None = None) -> Column:
    """Struct (status, confidence, method) from the best scorer at hand.

    Entailment scores if given, else embedding similarity, else keywords.
    """
    empty = (F.coalesce(claim, F.lit("")) == "") | (F.coalesce(text, F.lit("")) == "")

    def verdict(status: str, confidence: Column, method: str) -> Column:
        return F.struct(
            F.lit(status).alias("status"), settled(confidence, 4).alias("confidence"), F.lit(method).alias("method")
        )

    nothing = verdict("irrelevant", F.lit(0.0), "none")
    if entailment is not None:
        model = "nli_cross_encoder"
        rest = (
            F.when(entailment >= 0.6, verdict("supports", entailment, model))
            .when(contradiction >= 0.4, verdict("contradicts", contradiction, model))
            .when(entailment >= 0.3, verdict("partially_supports", entailment, model))
            .otherwise(verdict("irrelevant", F.greatest(entailment, neutral), model))
        )
    elif similarity is not None:
        model = "embedding_similarity"
        by_words = tx.bind(tx.keyword_overlap(claim, text), lambda overlap: (
            F.when(overlap >= KEYWORD_MIN, verdict("partially_supports", overlap, model))
            .otherwise(verdict("irrelevant", F.greatest(similarity, overlap), model))
        ))
        rest = (
            F.when(similarity >= SEMANTIC_MIN, verdict("supports", similarity, model))
            .when(similarity >= PARTIAL_MIN, verdict("partially_supports", similarity, model))
            .otherwise(by_words)
        )
    else:
        model = "keyword_only"
        rest = tx.bind(tx.keyword_overlap(claim, text), lambda overlap: (
            F.when(overlap >= 0.5, verdict("supports", overlap, model))
            .when(overlap >= 0.2, verdict("partially_supports", overlap, model))
            .otherwise(verdict("irrelevant", overlap, model))
        ))
    return F.when(empty, nothing).otherwise(rest)


def citation_states(citations: DataFrame, chunks: DataFrame, default_source: str = "",
                    source_type: str = "framework", similarity=None) -> DataFrame:
    """Verify a citation list and name each entry's state and source.

    States: ``no_citation`` (an honest decline), ``no_chunk_id``,
    ``missing_chunk``, ``verified``, ``unverified``.
    """
    declined = tx.is_no_citation(F.col("chunk_id"), F.col("claim"))
    verified = verify_citations(citations.withColumn("declined", declined), chunks, similarity)
    names = chunks.select("chunk_id", F.col("framework").alias("_framework"), F.col("document_name").alias("_document"))
    source = F.coalesce(F.nullif(F.lit(default_source), F.lit("")), F.col("_framework"), F.lit(""))
    if source_type == "document":
        source = F.coalesce(F.nullif(F.col("_document"), F.lit("")), source)
    return (
        verified.join(names, "chunk_id", "left")
        .withColumn(
            "state",
            F.when(F.col("declined"), "no_citation")
            .when(F.coalesce("chunk_id", F.lit("")) == "", "no_chunk_id")
            .when(~F.col("chunk_exists"), "missing_chunk")
            .when(F.col("passed"), "verified")
            .otherwise("unverified"),
        )
        .withColumn("source", F.when(F.col("chunk_exists") & ~F.col("declined"), source).otherwise(default_source))
        .withColumn("source_type", F.lit(source_type))
        .drop("_framework", "_document", "declined")
    )


def tally(verified: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return verified.groupBy(*by).agg(
        F.count("*").alias("citations_total"),
        F.count_if("passed").alias("citations_passed"),
        F.count_if(~F.col("passed")).alias("citations_failed"),
        F.coalesce(F.max("page_number"), F.lit(0)).alias("max_page"),
    )


def _lists(df: DataFrame, keys: Sequence[str], name: str, order: Sequence[str], fields: Sequence) -> DataFrame:
    """Rows of a key as one ordered array (a verdict's citations, a retrieval's passages: a handful)."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("row")))).alias(name))


def _rows(column: Column) -> Column:
    return F.transform(F.coalesce(column, F.array()), lambda x: x["row"])


def minimum_citations(citations: DataFrame, fallback: DataFrame, keys: Sequence[str],
                      topics: dict | None = None) -> DataFrame:
    """Where every citation of a dimension is a decline, attach requirement passages.

    ``fallback(keys, rank, chunk_id, text, framework)``: its first two rows are
    looked at; a row needs a named source, substance and the topic.
    """
    fields = ["chunk_id", "source", "quote", "state"]
    passage = F.substring("text", 1, QUOTE_CHARS)
    attached = (
        fallback.filter(F.col("rank") <= FALLBACK_CITATIONS)
        .withColumn("quote", passage)
        .filter(F.coalesce("framework", F.lit("")) != "")
        .filter(~tx.is_fragment(F.col("quote")))
        .filter(tx.on_topic(F.col("quote"), F.col("dimension"), topics))
        .withColumn("source", F.col("framework"))
        .withColumn("state", F.lit("deterministic_fallback"))
    )
    given = citations.withColumn("quote", F.col("claim"))
    both = _lists(given, keys, "_given", ["chunk_id"], fields).join(
        _lists(attached, keys, "_attached", ["rank"], fields), list(keys), "full"
    )
    rows, extra = _rows(F.col("_given")), _rows(F.col("_attached"))
    has_real = F.exists(rows, lambda r: r["state"] != "no_citation")
    chosen = F.when(has_real | (F.size(extra) == 0), rows).otherwise(extra)
    return both.select(*keys, F.explode(chosen).alias("_r")).select(*keys, "_r.*")


def implementation_citations(citations: DataFrame, pool: DataFrame, phases: DataFrame, chunks: DataFrame,
                             keys: Sequence[str], topics: dict | None = None) -> DataFrame:
    """Keep on-topic implementation citations and fill up to ``min(2, max(1, phases))``.

    ``pool(keys, pool_rank, chunk_id, text)`` is in preference order.
    """
    fields = ["chunk_id", "source", "quote", "state"]
    stored = chunks.select("chunk_id", F.col("text").alias("_text"), F.col("framework").alias("_framework"),
                           F.col("document_name").alias("_document"))
    off_topic = (
        F.coalesce(F.col("_text") != "", F.lit(False))
        & ~tx.on_topic(F.col("_text"), F.col("dimension"), topics)
        & (F.col("state") != "no_citation")
    )
    named = F.coalesce(F.nullif("source", F.lit("")), F.nullif("_document", F.lit("")), F.col("_framework"))
    kept = (
        citations.join(stored, "chunk_id", "left").filter(~off_topic)
        .withColumn("source", named).withColumn("quote", F.col("claim"))
    )
    head = F.ltrim(F.lower(F.substring("text", 1, 200)))
    fill = (
        pool.join(stored, "chunk_id")
        .withColumn("quote", F.substring("text", 1, QUOTE_CHARS))
        .filter(~tx.is_fragment(F.col("quote")))
        .filter(~F.contains(head, F.lit("table of contents")) & ~head.startswith("title page"))
        .filter(tx.on_topic(F.col("text"), F.col("dimension"), topics))
        .withColumn("source", F.coalesce(F.nullif("_framework", F.lit("")), F.nullif("_document", F.lit(""))))
        .filter(F.col("source").isNotNull())
        .withColumn("state", F.lit("deterministic_fallback"))
    )
    fill = first_per_key(fill.select(*keys, "pool_rank", *fields), [*keys, "chunk_id"], ["pool_rank"])
    both = (
        _lists(kept, keys, "_kept", ["chunk_id"], fields)
        .join(_lists(fill, keys, "_fill", ["pool_rank"], fields), list(keys), "full")
        .join(phases, list(keys), "left")
    )
    rows = _rows(F.col("_kept"))
    split = both.withColumn("_real", F.filter(rows, lambda r: r["state"] != "no_citation")).withColumn(
        "_declined", F.filter(rows, lambda r: r["state"] == "no_citation")
    )
    used = F.transform("_real", lambda r: r["chunk_id"])
    target = F.least(F.lit(2), F.greatest(F.lit(1), F.coalesce("phases", F.lit(0))))
    fresh = F.filter(_rows(F.col("_fill")), lambda r: ~F.array_contains(used, r["chunk_id"]))
    wanted = F.greatest(F.lit(0), target - F.size("_real")).cast("int")
    found = F.concat("_real", F.slice(fresh, F.lit(1), wanted))
    chosen = F.when(F.size(found) > 0, found).otherwise(F.col("_declined"))
    return split.select(*keys, F.explode(chosen).alias("_r")).select(*keys, "_r.*")


def existing_examples(examples: DataFrame, chunks: DataFrame) -> DataFrame:
    """International examples whose chunk exists; declines and blanks are dropped."""
    usable = examples.filter(tx.strip(F.coalesce("practice", F.lit(""))) != "").filter(
        ~tx.is_no_citation(F.col("chunk_id"), F.col("claim"))
    )
    return usable.join(chunks.select("chunk_id", F.col("framework").alias("reference")), "chunk_id")


def match_incidents(incidents: DataFrame, chunks: DataFrame, topics: dict | None = None) -> DataFrame:
    """Incident citations on an existing incident chunk that is about the dimension."""
    usable = incidents.filter(~tx.is_no_citation(F.col("chunk_id"), F.col("claim")))
    records = chunks.filter(tx.has_role(F.col("roles"), [lx.INCIDENT])).select(
        "chunk_id", F.col("text").alias("_text"), F.col("framework").alias("_framework")
    )
    return (
        usable.join(records, "chunk_id")
        .filter(tx.on_topic(F.col("_text"), F.col("dimension"), topics))
        .withColumn("source", F.coalesce(F.nullif("source", F.lit("")), F.col("_framework")))
        .drop("_text", "_framework")
    )


def evidence_list(citations: DataFrame, similarities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One evidence row per cited chunk, the first citation winning, with its similarity."""
    cited = citations.filter(F.coalesce("chunk_id", F.lit("")) != "").withColumn(
        "quote", F.substring("claim", 1, 500)
    )
    return first_per_key(cited, [*keys, "chunk_id"], ["citation_no"]).join(
        similarities.select(*keys, "chunk_id", "similarity"), [*keys, "chunk_id"], "left"
    )


# -- citations in replies ----------------------------------------------------

# --- fixed values: filler before a source name, longest first at match time
_SOURCE_FILLER = (
    "as noted in guidance from the", "as highlighted in the", "as stated in the",
    "as described in the", "as noted in the", "as defined in the", "as set out in the",
    "as outlined in the", "guidance from the", "as noted in", "as highlighted in", "as stated in",
    "as described in", "as defined in", "as set out in", "as outlined in", "highlighted in the",
    "stated in the", "noted in the", "described in the", "defined in the", "according to the",
    "per the", "under the", "in the", "the",
)
_PROSE_CITATION = (
    r"(?:the\s+|of\s+the\s+|in\s+the\s+)?([A-Z][A-Za-z0-9 &.,()'-]{3,}?)\s*:\s*\*?\*?\"?"
    r"([^\"\n]{15,}?)\"?\*?\*?$"
)


def clean_source(raw: Column) -> Column:
    """Source name without leading filler words and lower-case words."""
    filler = "|".join(sorted(_SOURCE_FILLER, key=len, reverse=True))
    name = F.regexp_replace(tx.strip(raw), rf"(?i)^(?:(?:{filler})\s*)+", "")
    return F.regexp_replace(name, r"^(?:[\p{Ll}\d]\S*(?:\s+|$))+", "")


def reply_citations(replies: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """``[source]: quote`` lines and, failing that, ``Source: "quote"`` prose lines."""
    lines = replies.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "_line"))
    line = F.col("_line")
    bracket = r"^[^\[]*\[([^\]]*)\](.*)$"
    has_bracket = line.contains("[") & line.contains("]") & line.contains(":")
    rest = tx.strip(F.regexp_extract(line, bracket, 2))
    quote = F.regexp_replace(tx.strip(F.regexp_replace(rest, r"^[:,]", "")), r"^[\"]+|[\"]+$", "")
    quote = tx.strip(F.regexp_replace(quote, r"^'+|'+$", ""))
    is_prose = ~has_bracket & line.contains(":") & line.contains('"')
    prose_quote = tx.strip(F.regexp_replace(tx.strip(F.regexp_extract(line, _PROSE_CITATION, 2)), r"\"+$", ""))
    parsed = lines.withColumn(
        "source",
        F.when(has_bracket, F.regexp_extract(line, bracket, 1))
        .when(is_prose, clean_source(F.regexp_extract(line, _PROSE_CITATION, 1))),
    ).withColumn("quote", F.when(has_bracket, quote).when(is_prose, prose_quote))
    long_enough = (has_bracket & line.rlike(bracket) & (F.length("quote") > 10)) | (
        is_prose & (F.length("quote") > 15) & (F.col("source") != "")
    )
    return parsed.filter(long_enough).select(
        *keys, "line_no", "source", F.substring("quote", 1, QUOTE_CHARS).alias("quote")
    )


def _letters(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), "[^a-z0-9]", "")


def _containing(shorter: DataFrame, text: str, longer: DataFrame, whole: str, most: int = 12, cut: int = 16) -> DataFrame:
    """Pairs in which the text of ``shorter`` is a part of the one of ``longer``, or equal to it."""
    found = [r[0] for r in shorter.select(F.length(text)).distinct().limit(most + 1).collect()]
    if len(found) > most:
        size = F.least(F.length(text), F.lit(cut))
        found = [r[0] for r in shorter.select(size).distinct().collect()]  # at most ``cut``
    else:
        size = F.length(text)
    if not found:
        found = [cut]

    def runs(width: int) -> Column:
        last = F.length(whole) - width + 1
        starts = F.when(last > 0, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.substring(F.col(whole), i, F.lit(width))))

    parts = longer.withColumn("_run", F.explode(F.array_distinct(F.concat(*map(runs, sorted(found))))))
    sought = shorter.withColumn("_run", F.xxhash64(F.substring(F.col(text), F.lit(1), size)))
    return parts.join(sought, "_run").filter(F.contains(F.col(whole), F.col(text)))


def known_source(claims: DataFrame, known: DataFrame, keys: Sequence[str], source: str = "source") -> DataFrame:
    """Gate claimed sources to ``known(name, ord)``: either contains the other, letters only.

    A text that contains another contains it whole, so both directions are
    equi-joins on runs of just the lengths that occur on the shorter side.  If
    there are more than a dozen lengths, the first 16 letters of a longer text
    stand for it, and only runs of the lengths that are left are made.  Runs
    meet by hash; the exact test follows.
    """
    names = known.select("name", "ord", _letters(F.col("name")).alias("_known")).filter(F.length("_known") >= 4)
    names = materialize(names.groupBy("_known").agg(F.min(F.struct("ord", "name")).alias("_best")))
    asked = materialize(claims.select(_letters(F.col(source)).alias("_claimed")).filter(F.length("_claimed") >= 8).distinct())
    columns = ["_claimed", "_best"]
    inside_claim = _containing(names, "_known", asked, "_claimed").select(*columns)
    inside_name = _containing(asked, "_claimed", names, "_known").select(*columns)
    best = inside_claim.unionByName(inside_name).groupBy("_claimed").agg(F.min("_best").alias("_best")).select(
        F.col("_claimed").alias("_name_key"), F.col("_best")["name"].alias("_known"))
    # names that are too short for any match are spread: a very common one is not one task's
    spread = F.concat(F.lit("\u0000"), F.xxhash64(*(keys or claims.columns)).cast("string"))
    letters = _letters(F.col(source))
    name = F.when(F.length(letters) >= 8, letters).otherwise(spread)
    joined = claims.withColumn("_name_key", name).join(best, "_name_key", "left")
    return joined.select(*claims.columns, F.col("_known").alias("known_source"))


def overview_labels(replies: DataFrame, keys: Sequence[str], text: str = "text", compound: bool = True) -> DataFrame:
    """``[DOC-n]`` markers with the sentence around each as the claim.

    ``compound`` also reads ``[DOC-1, DOC-4]``; without it such markers give nothing.
    """
    marker = r"\[DOC-\d+(?:\s*,\s*DOC-\d+)*\]"
    pieces = F.split(F.col(text), f"(?={marker})")
    found = (
        replies.filter(F.col(text).rlike(marker))
        .select(*keys, pieces.alias("_pieces"), F.posexplode(pieces).alias("_no", "_piece"))
        .filter(F.col("_piece").rlike("^" + marker))
        .withColumn("_group", F.regexp_extract("_piece", "^" + marker, 0))
    )
    size = F.size("_pieces")
    before = F.array_join(F.slice("_pieces", F.lit(1), F.col("_no")), "")
    from_marker = F.array_join(F.slice("_pieces", F.col("_no") + 1, size - F.col("_no")), "")
    after = F.substring(from_marker, F.length("_group") + 1, F.length(from_marker))
    sentence = F.concat(F.substring_index(before, ".", -1), "_group", F.substring_index(after, ".", 1))
    claim = tx.strip(F.regexp_replace(tx.strip(sentence), r"^[\[\]]+|[\[\]]+$", ""))
    if not compound:
        found = found.filter(~F.col("_group").contains(","))
    labels = F.regexp_extract_all("_group", F.lit(r"DOC-(\d+)"), F.lit(1))
    return found.select(
        *keys, F.col("_no").alias("marker_no"), F.explode(labels).alias("doc_no"),
        F.substring(claim, F.lit(1), F.lit(QUOTE_CHARS)).alias("claim"),
    ).withColumn("doc_no", F.col("doc_no").try_cast("int")).withColumn("usable", F.length("claim") >= 8)


def verify_overview(labels: DataFrame, contexts: DataFrame, store: DataFrame, keys: Sequence[str], similarity=None) -> DataFrame:
    """Check the claims of ``overview_labels`` against the passages that their labels stood for.

    ``contexts(keys, doc_no, chunk_id, page_number, document_name)`` is what a reply was given; ``store`` is the chunk
    store of ``verify_citations``.  A label without a passage, or with a claim that is too short, fails unchecked.

    Many labels stand for few passages: only passages that are cited are taken from the store, and read once for all
    their claims; labels that are not checked meet none.
    """
    given = contexts.select(
        *keys, "doc_no", F.col("chunk_id").alias("_chunk"), F.col("page_number").alias("_page_given"),
        F.coalesce(F.nullif("document_name", F.lit("")), F.lit("Uploaded Document")).alias("source"),
    )
    met = labels.join(given, [*keys, "doc_no"], "left").withColumn("_checked", F.coalesce("usable", F.lit(False)) & F.col("_chunk").isNotNull())
    asked = materialize(met.select(
        *labels.columns, "source", "_checked", F.when(F.col("_checked"), F.col("_chunk")).alias("chunk_id"),
        F.col("_page_given").cast("int").alias("page_number"), F.lit(None).cast("int").alias("total_pages"),
    ))
    checked = asked.filter("_checked")
    cited = materialize(checked.select("chunk_id").distinct())
    own = [c for c in ("chunk_id", "text", "page_number", VECTOR) if c in store.columns]
    passages = materialize(store.select(*own).join(cited, "chunk_id", "left_semi").withColumn("lowered_words", tx.lowered_words(F.col("text"))))
    if similarity is None and VECTOR in own:
        checked = checked.withColumn("claim_vector", batch_embed()(F.col("claim")))
    done = verify_citations(checked, passages, similarity).drop("_checked", "page_number", "total_pages")
    failed = {
        "chunk_exists": F.lit(False), "page_exists": F.lit(False), "keyword_overlap": F.lit(None).cast("double"),
        "semantic_similarity": F.lit(None).cast("double"), "text_supports_claim": F.lit(False), "passed": F.lit(False),
        "verification_method": F.lit("unresolved"), "verification_confidence": F.lit(0.0), "failure_reason": F.lit(NO_CHUNK),
    }
    return done.unionByName(asked.filter("not _checked").withColumns(failed).select(*done.columns))


def overview_tally(verified: DataFrame, replies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per reply the citations that may be shown, in order, and how many passed and failed; replies without any too."""
    shown = F.struct("marker_no", "doc_no", "source", F.col("claim").alias("quote"), "verification_method", "verification_confidence")
    counted = verified.groupBy(*keys).agg(
        F.count_if("passed").alias("pass_count"), F.count_if(~F.col("passed")).alias("fail_count"),
        F.array_sort(F.collect_list(F.when(F.col("passed"), shown))).alias("citations"),
    )
    none = F.array().cast(counted.schema["citations"].dataType)
    return replies.select(*keys).distinct().join(counted, list(keys), "left").select(
        *keys, F.coalesce("citations", none).alias("citations"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("pass_count", "fail_count"))
    )


def scoped_hits(quotes: DataFrame, chunks: DataFrame, keys: Sequence[str], k: int = 5, make_model=HashingEmbedder) -> DataFrame:
    """``(keys, rank, chunk_id, text, framework)``: each quote's best chunks inside its claimed source.

    ``quotes(keys, source, quote)``; ``chunks(chunk_id, framework, text, embedding)``.  Quotes meet only the chunks of
    the framework that they name; a quote whose source has none is searched for everywhere.
    """
    columns = [*keys, "rank", "chunk_id", "text", "framework"]
    asked = quotes.select(*keys, F.col("source").alias("framework"), F.col("quote").alias("text"))
    asked = materialize(asked.withColumn(VECTOR, batch_embed(make_model)(F.col("text"))))
    dense = nearest_in_groups(chunks, asked, "framework", DENSE_HEADROOM * k, query_keys=keys, carry=["framework"])
    worded = attach_columns(dense, chunks, "chunk_id", ["text"]).join(asked.select(*keys, F.col("text").alias("query_text")), list(keys))
    own = materialize(hybrid_rerank(worded, keys, k).select(*columns))
    rest = asked.join(own.select(*keys).distinct(), list(keys), "left_anti")
    broad = retrieve(chunks, rest.select(*keys, "text"), k, query_keys=keys, carry=["framework"])
    return own.unionByName(broad.select(*columns))


def match_quotes(quotes: DataFrame, hits: DataFrame, keys: Sequence[str], similarity: bool = True) -> DataFrame:
    """Resolve quotes to their best retrieved chunk by term overlap and judge the match.

    ``quotes(keys, source, quote)``; ``hits(keys, rank, chunk_id, text, framework)``
    are the quote's top chunks (already restricted to the claimed source where
    that gave any).
    """
    joined = quotes.join(hits, list(keys), "left")
    terms = F.array_distinct(tx.words(F.lower(tx.strip(F.col("quote")))))
    long_terms = F.filter(terms, lambda t: F.length(t) > 3)
    used = F.when(F.size(long_terms) > 0, long_terms).otherwise(terms)
    overlap = F.when(F.size(used) > 0, tx.count_contained(F.col("text"), used) / F.size(used))
    scored = joined.withColumn("overlap", F.round(F.coalesce(overlap, F.lit(0.0)), 6)).withColumn(
        "_order", -F.col("overlap")
    )
    best = first_per_key(scored, list(keys), ["_order", "rank", "chunk_id"]).drop("_order")
    if similarity:
        best = best.withColumn("semantic", text_similarity()(F.col("quote"), F.coalesce("text", F.lit(""))))
    else:
        best = best.withColumn("semantic", F.lit(None).cast("double"))
    words = F.round(tx.keyword_overlap(F.col("quote"), F.coalesce("text", F.lit(""))), 6)
    enough = F.col("overlap") >= CHAT_OVERLAP_MIN
    claimed = F.lower(F.coalesce("source", F.lit("")))
    actual = F.lower(F.coalesce("framework", F.lit("")))
    named = ~claimed.isin("", "uploaded document")
    aligned = ~named | F.contains(actual, claimed) | F.contains(claimed, actual)
    by_meaning = F.coalesce(F.col("semantic") >= SEMANTIC_MIN, F.lit(False))
    by_words = words >= KEYWORD_MIN
    return (
        best.withColumn("keyword_overlap", words)
        .withColumn(
            "verification_method",
            F.when(~enough | ~aligned, "chat_lookup")
            .when(by_meaning, "chat_semantic")
            .when(by_words, "chat_keyword")
            .otherwise("chat_lookup"),
        )
        .withColumn("passed", enough & aligned & (by_meaning | by_words))
        .withColumn("chunk_id", F.when(enough, F.col("chunk_id")))
    )
