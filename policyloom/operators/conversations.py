"""Chat-log analytics: session state, intent, routing and guardrails over message tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policyloom.functions import text as tx
from policyloom.functions.vectors import BatchEmbedder, HashingEmbedder
from policyloom.operators import nearest as nn
from policyloom.session import materialize

# --- fixed values: message patterns -----------------------------------------
GREETING = (
    r"^(hello|hi|hey|good morning|good afternoon|good evening|thanks|thank you|how are you|what'?s up|yo|sup|greetings)"
)
OFF_TOPIC = (
    r"(what'?s your name|who are you|what can you do|tell me a joke|weather|recipe|cook|cooking|sports|game|movie|"
    r"music|play)"
)
INTENT_GREETING = (
    r"^(hello|hi|hey|good morning|good afternoon|good evening|thanks|thank you|how are you|what'?s up)"
)
FOLLOW_UP = (
    r"^(why\s+is\s+this|how\s+(can|does)|explain\s+(this|that|it)|show\s+(me|the)|give\s+(an|me)|what\s+about|and\s+)"
)
INTENT_RULES = (
    ("concept_explanation",
     r"^(what\s+is|what's|what does|explain|define|describe|what (do|does) you mean by|tell me about|what are|"
     r"what's the)"),
    ("educational",
     r"(difference\s+between|compare|versus|vs\.?|how does|what is the (relationship|link|connection)|"
     r"explain the (difference|relationship|concept))"),
    ("analysis_explanation",
     r"(why\s+is|why\s+was|why\s+did|how\s+is|how\s+was|what does.*mean|"
     r"what (is|was) the (reason|rationale|evidence)|explain the (coverage|risk|maturity|finding|result)|"
     r"why (is|was) it (covered|partial|missing|high|medium|low))"),
    ("recommendation_explanation",
     r"(how\s+(to|can|should|would|do|does)|what (would|should|steps|actions|measures|practices)|implement|"
     r"implementation|recommend|improve|strengthen|best practice|timeline|challenge)"),
)
DIMENSION_ALIASES = {
    "Transparency": ("transparency", "explainability", "explainable", "openness", "disclosure", "audit", "reporting"),
    "Accountability": (
        "accountability", "responsible", "liability", "oversight", "redress", "grievance", "responsibility"),
    "Privacy": ("privacy", "data protection", "personal data", "consent", "anonymization", "confidentiality"),
    "Safety": ("safety", "robustness", "reliability", "security", "fail.?safe", "incident", "risk assessment"),
    "Human Autonomy": (
        "autonomy", "human control", "human.?in.?the.?loop", "human oversight", "opt.?out", "self.?determination"),
    "Inclusivity": (
        "inclusivity", "inclusion", "accessibility", "equity", "participation", "digital divide",
        "multi.?stakeholder"),
    "Fairness": ("fairness", "bias", "discrimination", "non.?discrimination", "equality", "equitable"),
    "Environmental Sustainability": (
        "environmental", "sustainability", "sustainable", "energy", "carbon", "ecological", "climate"),
}
MIN_SIMILARITY = 0.3
MIN_SIMILAR_CHUNKS = 2
TOP_CHUNKS = 5
WITNESSES = 2048
KEPT_MESSAGES = 6
RENDERED_MESSAGES = 4
RENDERED_CHARS = 400


def named_dimension(message: Column, aliases: dict | None = None) -> Column:
    """First dimension, in order, one of whose aliases occurs in the message."""
    aliases = DIMENSION_ALIASES if aliases is None else aliases
    lowered = F.lower(tx.strip(F.coalesce(message, F.lit(""))))
    result = None
    for dimension, patterns in aliases.items():
        test = lowered.rlike("|".join(patterns))
        result = F.when(test, dimension) if result is None else result.when(test, dimension)
    return result


def carry_forward(df: DataFrame, keys: Sequence[str], position: str, value: str, name: str,
                  block: int | None = None) -> DataFrame:
    """Last non-null ``value`` before the row, within its key.

    With ``block``, integer positions are cut into blocks: the last value of
    each block is carried over the blocks first, so one very long session is
    spread over many tasks.
    """
    if block is None:
        before = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(before))
    cut = df.withColumn("_block", F.floor(F.col(position) / block).cast("long"))
    newest = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(position)))
    blocks = cut.groupBy(*keys, "_block").agg(newest.alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    inside = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.join(carried, [*keys, "_block"])
        .withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carried")))
        .drop("_block", "_carried")
    )


def session_state(messages: DataFrame, session: str = "conv_id", turn: str = "turn", text: str = "text",
                  aliases: dict | None = None, block: int | None = 4096) -> DataFrame:
    """Dimension a message names, and the one active when it arrives."""
    named = messages.withColumn("named_dimension", named_dimension(F.col(text), aliases))
    return carry_forward(named, [session], turn, "named_dimension", "active_dimension", block)


def classify_messages(stateful: DataFrame, text: str = "text") -> DataFrame:
    """Intent and resolved dimension of each message, after ``session_state``.

    Follow-ups and short messages take over the active dimension.
    """
    lowered = F.lower(tx.strip(F.coalesce(text, F.lit(""))))
    greeting = lowered.rlike(INTENT_GREETING)
    short = F.size(tx.words(F.coalesce(text, F.lit("")))) < 5
    inherits = F.col("named_dimension").isNull() & (lowered.rlike(FOLLOW_UP) | short)
    dimension = F.when(inherits, F.col("active_dimension")).otherwise(F.col("named_dimension"))
    intent = F.when(greeting, "greeting")
    for label, pattern in INTENT_RULES:
        intent = intent.when(lowered.rlike(pattern), label)
    intent = intent.when(dimension.isNotNull(), "concept_explanation").otherwise("general")
    return stateful.withColumn("intent", intent).withColumn(
        "dimension", F.when(~greeting & (F.col("intent") != "general"), dimension)
    )


def history(messages: DataFrame, session: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text", block: int = 4096) -> DataFrame:
    """Kept history size and the rendered last four messages before each message.

    Turns are cut into blocks.  A block receives the tail of the (non-empty)
    blocks before it, so a window never spans a whole session.
    """
    speaker = F.when(F.col(role) == "user", "User").otherwise("Assistant")
    line = F.concat(F.lit("  "), speaker, F.lit(": "), F.substring(text, 1, RENDERED_CHARS))
    entry = F.struct(F.col(turn).alias("t"), line.alias("l"))
    cut = messages.withColumn("_block", F.floor(F.col(turn) / block).cast("long")).withColumn("_entry", entry)
    newest = F.slice(F.sort_array(F.collect_list("_entry"), asc=False), 1, KEPT_MESSAGES)
    tails = cut.groupBy(session, "_block").agg(newest.alias("_tail"))
    earlier = Window.partitionBy(session).orderBy("_block").rowsBetween(-KEPT_MESSAGES, -1)
    lead = tails.select(session, "_block", F.flatten(F.collect_list("_tail").over(earlier)).alias("_lead"))
    inside = Window.partitionBy(session, "_block").orderBy(turn).rowsBetween(-KEPT_MESSAGES, -1)
    recent = F.slice(
        F.sort_array(F.concat("_lead", F.collect_list("_entry").over(inside)), asc=False), 1, KEPT_MESSAGES
    )
    rendered = F.array_sort(F.slice("_recent", 1, RENDERED_MESSAGES))
    return (
        cut.join(lead, [session, "_block"])
        .withColumn("_recent", recent)
        .withColumn("history_size", F.size("_recent"))
        .withColumn("history_text", F.array_join(F.transform(rendered, lambda e: e["l"]), "\n"))
        .drop("_block", "_entry", "_lead", "_recent")
    )


def chat_mode(message: Column, requested: Column, has_workspace: Column, has_finding: Column) -> Column:
    known = F.when(requested.isin("advisor", "framework_qa", "document_overview", "auditor"), requested).otherwise("advisor")
    routed = (
        ~known.isin("framework_qa", "document_overview") & ~has_finding & has_workspace & tx.asks_about_document(message)
    )
    return F.when(routed, "document_overview").otherwise(known)


def guardrail(message: Column, hits: Column | None = None, similar: Column | None = None, strict: bool = True) -> Column:
    """Reason for rejecting a message, or null.

    ``hits`` and ``similar`` count the message's top chunks, all and those at
    similarity 0.3 or more.
    """
    text = tx.strip(F.coalesce(message, F.lit("")))
    reason = F.when(text.rlike("(?i)" + GREETING), "greeting_detected")
    if not strict:
        return reason
    return (
        reason.when(text.rlike("(?i)" + OFF_TOPIC), "off_topic_detected")
        .when(F.coalesce(hits, F.lit(0)) == 0, "no_relevant_documents_found")
        .when(F.coalesce(similar, F.lit(0)) < MIN_SIMILAR_CHUNKS, "query_not_similar_enough_to_indexed_content")
    )


def to_be_searched(messages: DataFrame, text: str = "text") -> DataFrame:
    """The messages that the patterns let pass: only they need to be compared with the chunks."""
    return messages.filter(guardrail(F.col(text), F.lit(1), F.lit(MIN_SIMILAR_CHUNKS)).isNull())


def similar_enough(texts: Column, chunks: DataFrame, make_model: Callable[[], BatchEmbedder] = HashingEmbedder, witnesses: int = WITNESSES) -> Column:
    """True where some chunks prove that a search would find enough similar ones; elsewhere only the search can tell.

    A chunk's score is at least the dense share of its similarity.  If ``MIN_SIMILAR_CHUNKS`` chunks lie above the
    bar by that share alone, then so do the text's nearest ones, whichever they are.  Chunks without a text have no
    score; they are as near as the empty text, so that a witness has to be nearer than that one.
    """
    rows = chunks.where(F.col("text").isNotNull()).select(nn.VECTOR).limit(witnesses).toArrow()
    held = nn.arrow_rows(rows.column(nn.VECTOR), slice(0, len(rows)))
    bar = MIN_SIMILARITY / nn.DENSE_WEIGHT + 1e-3

    def prove(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        empty = model([""])
        for batch in batches:
            out = np.zeros(len(batch), bool)
            for part in nn.tiles(len(batch), max(1, len(held))) if len(held) else ():
                vectors = model(batch.iloc[part].tolist())
                needed = np.maximum(bar, nn.similarities(vectors, empty))
                out[part] = (nn.similarities(vectors, held) > needed).sum(axis=1) >= MIN_SIMILAR_CHUNKS
            yield pd.Series(out)

    prove.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(prove, "boolean")(F.coalesce(texts, F.lit("")))


def guarded(messages: DataFrame, chunks: DataFrame, text: str = "text") -> DataFrame:
    """The strict guardrail of each message against the chunk store, as ``rejected_for``.

    Equal texts are searched for once, and only those that the patterns let pass and that ``similar_enough`` does not
    settle: the guardrail asks whether there are enough similar chunks, which two of them can show.
    """
    key = F.coalesce(F.sha2(text, 256), F.lit(""))
    asked = to_be_searched(messages, text).select(key.alias("_text"), F.col(text).alias("text")).distinct()
    asked = materialize(asked.withColumn("_settled", F.col("text").isNotNull() & similar_enough(F.col("text"), chunks)))
    rest = asked.where(~F.col("_settled")).select("_text", "text")
    searched = nn.retrieve(chunks, rest, TOP_CHUNKS, query_keys=["_text"]).select("_text", "similarity")
    proven = asked.where("_settled").select("_text", F.explode(F.array_repeat(F.lit(MIN_SIMILARITY), MIN_SIMILAR_CHUNKS)).alias("similarity"))
    return check_messages(messages.withColumn("_text", key), proven.unionByName(searched), ["_text"], text).drop("_text")


def check_messages(messages: DataFrame, hits: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Strict guardrail over a message table; ``hits(keys, similarity)`` are its top five chunks.

    Messages that ``to_be_searched`` leaves out need no hits: their reason comes first.
    """
    counts = hits.groupBy(*keys).agg(
        F.count("*").alias("_hits"), F.count_if(F.col("similarity") >= MIN_SIMILARITY).alias("_similar")
    )
    return messages.join(counts, list(keys), "left").withColumn(
        "rejected_for", guardrail(F.col(text), F.col("_hits"), F.col("_similar"))
    ).drop("_hits", "_similar")
