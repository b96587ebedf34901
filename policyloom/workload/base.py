"""Shared inputs of the registered queries, in Spark and in SQL.

The test prose is invented, so the rules get a lexicon of words that occur in
it.  How the tables stand for the domain:

* a document belongs to the framework named by its ``source``; its lines, 40 to
  a page, are its pages;
* document ``d`` is also the raw verdict of workspace ``d div 8`` on dimension
  ``d mod 8``, its label (or, without one, its language) giving the coverage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policyloom import lexicons as lx
from policyloom.operators.segment import ingest_pages, pages_from_lines
from policyloom.session import ensure_checkpoint_dir
from policyloom.sources import vectors
from policyloom.sources.tables import spread

DIMS = lx.DIMENSIONS

LEXICON = lx.Lexicon(
    topics={
        "Transparency": ("thatin", "eauxment", "keitpf", "menteci"),
        "Accountability": ("hehely", "quevi", "schung", "ciónta"),
        "Privacy": ("inoran", "leaux", "heitst", "arll"),
        "Safety": ("ononst", "anoi", "bege", "boque"),
        "Human Autonomy": ("orantion", "menti", "ungver", "adoes"),
        "Inclusivity": ("rewh", "aiou", "lichen", "osci"),
        "Fairness": ("anedble", "enele", "auber", "ueca"),
        "Environmental Sustainability": ("ertion", "oich", "zuein", "raja"),
    },
    named_body=("thon", "thre", "eran", "ier", "ungen", "ado"),
    reporting=("erin", "oner", "pa", "lich"),
    enforcement=("inble", "anth", "tre", "keit"),
    strong=("of the", "to be", "de la", "in der", "that is"),
    weak=("with the", "on the", "by the", "con el"),
    verbs=("is in", "was of", "it to"),
    negators=("of", "not", "no", "and"),
    drift_strong=("the the", "is the", "of of"),
    drift_soft_words=("this", "from"),
    drift_soft_phrases=("in the", "to the"),
    document_types=(
        ("strategy", ("thatin", "quevi")),
        ("legislation", ("hehely", "schung", "arll")),
        ("code_of_conduct", ("inoran",)),
        ("standard", ("ertion",)),
    ),
)
ALIASES = {
    "Transparency": ("thatin", "keitpf"),
    "Accountability": ("hehely", "quevi"),
    "Privacy": ("inoran", "leaux"),
    "Safety": ("ertion", "anoi"),
}
ROLES = (lx.NORMATIVE, lx.PRACTICAL, lx.IMPLEMENTATION, lx.INCIDENT)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    return spread(read(spark, sf_dir, "documents"))


def pages(spark, sf_dir):
    return pages_from_lines(documents(spark, sf_dir))


def lines(spark, sf_dir):
    """``(doc_id, line_no, line)``, line numbers from 1."""
    return documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("_i", "line")).select(
        "doc_id", (F.col("_i") + 1).alias("line_no"), "line"
    )


def source_number() -> object:
    return F.substring("source", 4, 10).cast("int")


def roles_of(number):
    """One role per source by its number, every fifth source a second one."""
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.pmod(number, F.lit(4)) + 1)
    second = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.pmod(number + 1, F.lit(4)) + 1)
    return F.when(F.pmod(number, F.lit(5)) == 0, F.array(role, second)).otherwise(F.array(role))


def corpus(spark, sf_dir) -> DataFrame:
    """Documents as chunks of the framework their source names."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("framework"),
        roles_of(source_number()).alias("roles"), "lang",
    )


_stores: dict[tuple, str] = {}


def _stored(spark, sf_dir, name: str, make) -> DataFrame:
    """A table with its vectors, written once for each state of the documents and read by all queries after that."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/documents.parquet")
    state = files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")), F.count("*")).first()
    key = (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None), sf_dir, name, *state)
    if key not in _stores:
        path = f"{ensure_checkpoint_dir(spark)}/store/{uuid.uuid4()}"
        vectors.create_store(make(), path)
        _stores[key] = path
    return vectors.read_store(spark, _stores[key])


def embedded_corpus(spark, sf_dir) -> DataFrame:
    """``corpus`` out of the chunk store, with vectors."""
    return _stored(spark, sf_dir, "corpus", lambda: corpus(spark, sf_dir))


def embedded_chunks(spark, sf_dir) -> DataFrame:
    """The chunks of all pages out of the chunk store, with vectors."""
    return _stored(spark, sf_dir, "chunks", lambda: chunks(spark, sf_dir))


def catalog(spark, sf_dir) -> DataFrame:
    """Framework catalog derived from the sources of the documents."""
    sources = documents(spark, sf_dir).select("source").distinct()
    number = source_number()
    dims = F.array(*[F.lit(d) for d in DIMS])
    regions = F.array(*[F.lit(f"REGION_{i}") for i in range(5)])
    return sources.select(
        F.col("source").alias("name"), number.alias("ord"), roles_of(number).alias("roles"),
        F.array(F.element_at(dims, F.pmod(number, F.lit(8)) + 1)).alias("dimensions"),
        F.when(F.pmod(number, F.lit(3)) == 0, F.array(F.element_at(regions, F.pmod(number, F.lit(5)) + 1)))
        .otherwise(F.array(F.lit("Global"))).alias("regions"),
    )


def keyed_documents(spark, sf_dir) -> DataFrame:
    dims = F.array(*[F.lit(d) for d in DIMS])
    ord_ = F.pmod("doc_id", F.lit(8)).cast("int")
    return documents(spark, sf_dir).withColumn("workspace_id", F.floor(F.col("doc_id") / 8)).withColumn(
        "ord", ord_
    ).withColumn("dimension", F.element_at(dims, ord_ + 1))


def verdicts(spark, sf_dir) -> DataFrame:
    """Raw verdict per workspace and dimension."""
    docs = keyed_documents(spark, sf_dir)
    labels = read(spark, sf_dir, "labels")
    labelled = F.col("quality").isNotNull()
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    coverage = (
        F.when(labelled & good & ~toxic, "Covered")
        .when(labelled & (good | ~toxic), "Partial")
        .when(labelled, "Missing")
        .when(F.col("lang") == "en", "Partial")
        .when(F.col("lang") == "fr", "Missing")
        .otherwise("Insufficient Evidence")
    )
    text_lines = F.split("text", "\n")
    return docs.join(labels, "doc_id", "left").select(
        "workspace_id", "dimension", "ord", "doc_id", "lang",
        coverage.alias("coverage"),
        (F.coalesce("toxic", F.lit(1)) == 0).alias("principle_acknowledged"),
        text_lines.alias("mechanisms"), text_lines.alias("recommendations"), text_lines.alias("opportunities"),
        F.col("text").alias("synthesis"),
        F.when(~labelled & (F.col("lang") == "es"), "provider quota exhausted").alias("analysis_error"),
        F.lit(None).cast("string").alias("coverage_reasoning"),
    )


def passages(spark, sf_dir) -> DataFrame:
    """Non-blank lines as document chunks of their workspace and dimension."""
    docs = keyed_documents(spark, sf_dir)
    return (
        docs.select("workspace_id", "dimension", "doc_id", F.posexplode(F.split("text", "\n")).alias("_i", "text"))
        .filter(F.trim("text") != "")
        .select(
            "workspace_id", "dimension", "doc_id", (F.col("_i") + 1).alias("line_no"),
            F.concat_ws("-", "doc_id", F.col("_i") + 1).alias("chunk_id"), "text",
        )
    )


def line_evidence(spark, sf_dir) -> DataFrame:
    """Evidence rows per workspace and dimension, one per line."""
    return passages(spark, sf_dir).select(
        "workspace_id", "dimension", "chunk_id",
        F.concat(F.lit("s"), F.pmod("line_no", F.lit(7)).cast("string")).alias("source"),
        F.round(F.length("text") / 400, 6).alias("similarity"),
        (F.pmod(F.length("text"), F.lit(2)) == 0).alias("verified"),
    )


def chunks(spark, sf_dir) -> DataFrame:
    return ingest_pages(pages(spark, sf_dir))


def mini_profiles(spark) -> DataFrame:
    rows = [(d, i, t) for d, texts in lx.PROFILES.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "dimension string, query_no int, text string")


def definitions(spark) -> DataFrame:
    return spark.createDataFrame([(d, t[0]) for d, t in lx.PROFILES.items()], "dimension string, text string")


# -- the same in SQL ---------------------------------------------------------

def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join(
        "(" + ", ".join(quote(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows
    )


def sql_list(items) -> str:
    return "[" + ", ".join(quote(i) for i in items) + "]"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def flat_sql(x: str) -> str:
    return strip_sql(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def tokens_sql(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def any_sql(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, {quote(p)})" for p in phrases) + ")"


def word_sql(x: str, keywords) -> str:
    alts = "|".join(keywords)
    return f"regexp_matches({x}, {quote(rf'(^|[^\pL\pN_])(?:{alts})s?($|[^\pL\pN_])')}, 'i')"


def topic_sql(text: str, dimension: str, topics: dict) -> str:
    whens = " ".join(f"WHEN {dimension} = {quote(d)} THEN {any_sql(f'lower({text})', s)}" for d, s in topics.items())
    return f"(CASE {whens} ELSE true END)"


def fragment_sql(x: str) -> str:
    flat = flat_sql(f"coalesce({x}, '')")
    return (
        f"({flat} = '' OR regexp_matches({flat}, "
        r"'^[A-Z][A-Za-z&''\- ]{1,80}?\s*\d{1,3}(\s*,\s*\d{1,3})*\s*\.?\s*$')"
        f" OR (length({flat}) <= 50 AND NOT regexp_matches({flat}, '[.!?;:]') "
        rf"AND NOT regexp_matches({flat}, '(^|\s)\p{{Ll}}\S{{3,}}')))"
    )


def preamble_sql(text: str, page: str) -> str:
    t = strip_sql(f"lower(coalesce({text}, ''))")
    return (
        f"(length({t}) < 150 OR (coalesce({page}, 0) <= 1 AND length({t}) < 400) "
        f"OR (length({t}) < 400 AND {any_sql(t, lx.PREAMBLE_MARKERS)}))"
    )


def overlap_sql(claim: str, text: str) -> str:
    words = tokens_sql(f"lower({claim})")
    long_terms = f"list_filter({words}, lambda w: length(w) > 3)"
    terms = f"(CASE WHEN len({long_terms}) <= 3 THEN {words} ELSE {long_terms} END)"
    return (
        f"(CASE WHEN len({terms}) = 0 THEN 0.0::DOUBLE ELSE "
        f"len(list_filter({terms}, lambda w: contains(lower({text}), w)))::DOUBLE / len({terms}) END)"
    )


def embed_sql(name: str, source: str, key: str, text: str = "text", dims: int = 384) -> str:
    """CTEs ``name`` (key, b, n) and ``name_norm`` (key, norm) of hashed word counts."""
    return f"""
{name} AS (
  SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % {dims} AS b, count(*)::DOUBLE AS n
  FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9ß-ÿ]+')) AS w FROM {source})
  GROUP BY ALL),
{name}_norm AS (SELECT {key}, sqrt(sum(n * n)) AS norm FROM {name} GROUP BY {key})"""


KEYED_SQL = f"""keyed AS (
  SELECT d.*, doc_id // 8 AS workspace_id, (doc_id % 8)::INT AS ord,
         ({sql_list(DIMS)})[(doc_id % 8) + 1] AS dimension
  FROM documents d)"""

VERDICTS_SQL = KEYED_SQL + """,
verdicts AS (
  SELECT k.workspace_id, k.dimension, k.ord, k.doc_id, k.lang, k.text,
    CASE WHEN quality = 1 AND toxic = 0 THEN 'Covered'
         WHEN quality IS NOT NULL AND (quality = 1 OR toxic = 0) THEN 'Partial'
         WHEN quality IS NOT NULL THEN 'Missing'
         WHEN lang = 'en' THEN 'Partial'
         WHEN lang = 'fr' THEN 'Missing'
         ELSE 'Insufficient Evidence' END AS coverage,
    coalesce(toxic, 1) = 0 AS principle_acknowledged,
    CASE WHEN quality IS NULL AND lang = 'es' THEN 'provider quota exhausted' END AS analysis_error
  FROM keyed k LEFT JOIN labels l USING (doc_id))"""

LINES_SQL = """lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM documents)"""

PASSAGES_SQL = KEYED_SQL + """,
raw_passages AS (
  SELECT workspace_id, dimension, doc_id, unnest(string_split(text, chr(10))) AS text,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_no
  FROM keyed),
passages AS (
  SELECT *, doc_id || '-' || line_no AS chunk_id FROM raw_passages WHERE trim(text) <> '')"""

ROLE_SQL = f"""corpus AS (
  SELECT *, ({sql_list(ROLES)})[(n % 4) + 1] AS role1,
         CASE WHEN n % 5 = 0 THEN ({sql_list(ROLES)})[((n + 1) % 4) + 1] END AS role2
  FROM (SELECT doc_id AS chunk_id, text, source AS framework, lang, substr(source, 4)::INT AS n FROM documents))"""

PROFILE_SQL = "profiles(dimension, query_no, text) AS (VALUES " + values(
    (d, i, t) for d, texts in lx.PROFILES.items() for i, t in enumerate(texts)
) + ")"
