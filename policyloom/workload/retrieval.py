"""Nearest neighbours, fusion, budgets, samples and merges."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from policyloom import lexicons as lx
from policyloom.functions.vectors import l2_norm, l2_normalize, score_pairs_with
from policyloom.operators import index
from policyloom.operators import nearest as nn
from policyloom.operators import retrieve as rt
from policyloom.operators import route as routing
from policyloom.plans import analysis, render
from policyloom.session import ensure_checkpoint_dir
from policyloom.sources import vectors
from policyloom.workload import base as b

CAPS = rt.FIRST_PASS_CAPS
CORE = ("src0", "src4", "src8")


def label_centroids(spark, sf):
    """One query vector per label: the mean of its vectors."""
    return mean_vectors(b.read(spark, sf, "embeddings"), ["label"], "embedding")


def mean_vectors(df, keys, column):
    """Mean vector per key, combined before the shuffle and without exploding the vectors."""
    vector = array_to_vector(F.transform(column, lambda x: x.cast("double")))
    means = df.select(*keys, vector.alias("_v")).groupBy(*keys).agg(Summarizer.mean(F.col("_v")).alias("_m"))
    return means.select(*keys, vector_to_array("_m").alias(column))


def knn_hits(spark, sf, k=10, carry=()):
    vectors = b.read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").alias("own_label"),
    )
    return nn.nearest(
        vectors, label_centroids(spark, sf), k, query_keys=["label"], source="embedding", stored_vectors=True, carry=carry,
    )


def knn_topk(spark, sf):
    return knn_hits(spark, sf)


def store_search(spark, sf):
    """The chunk store written in two steps, read back and searched: each text is embedded when it comes in first."""
    path = f"{ensure_checkpoint_dir(spark)}/store/{uuid.uuid4()}"
    corpus = b.corpus(spark, sf)
    vectors.create_store(corpus.where(F.pmod("chunk_id", F.lit(2)) == 0), path)
    vectors.add_to_store(corpus, path)
    hits = nn.nearest(vectors.read_store(spark, path), b.definitions(spark), 10, query_keys=["dimension"], carry=["framework"])
    return hits.select("dimension", "rank", "chunk_id", "framework", "similarity")


def index_search(spark, sf):
    """Every twentieth vector against the inverted file of all vectors, in exact mode."""
    path = f"{ensure_checkpoint_dir(spark)}/index/{uuid.uuid4()}"
    rows = b.read(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    index.build_index(rows, path, carry=["label"])
    asked = rows.where(F.pmod("chunk_id", F.lit(20)) == 0).select(F.col("chunk_id").alias("query_id"), "embedding")
    return index.open_index(spark, path).search(asked, 10, query_keys=["query_id"], exact=True)


def vector_norms(spark, sf):
    wide = b.read(spark, sf, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double") * 3))
    return wide.select(
        "vec_id", F.round(l2_norm(F.col("v")), 6).alias("norm"),
        F.round(l2_norm(l2_normalize(F.col("v"))), 6).alias("unit_norm"),
    )


def uploaded_corpus(spark, sf):
    """Documents as stored chunks; every fifth source is an uploaded document with no framework."""
    number = F.substring("framework", 4, 10).cast("int")
    uploaded = F.pmod(number, F.lit(5)) == 4
    return b.embedded_corpus(spark, sf).withColumn("workspace_id", F.when(uploaded, F.col("framework"))).withColumn(
        "document_name", F.when(uploaded, F.col("framework"))
    ).withColumn("framework", F.when(uploaded, "").otherwise(F.col("framework"))).withColumn(
        "roles", F.when(uploaded, F.array().cast("array<string>")).otherwise(F.col("roles"))
    )


def rrf_fused(spark, sf):
    fused = rt.full_profile(uploaded_corpus(spark, sf), b.mini_profiles(spark))
    return fused.select("dimension", "framework", "chunk_id", "rrf_score", "best_similarity", "is_document")


def document_bucket(spark, sf):
    """Multi-query retrieval inside every source."""
    found = rt.document_candidates(b.embedded_corpus(spark, sf), b.mini_profiles(spark), 20, scope="framework", carry=())
    return found.select("framework", "dimension", "rank", "chunk_id", "rrf_score", "similarity")


def hybrid_hits(spark, sf, k=5):
    return nn.retrieve(
        b.embedded_corpus(spark, sf), b.definitions(spark), k, query_keys=["dimension"], roles=[lx.PRACTICAL], carry=["framework"],
    )


def hybrid_reranked(spark, sf):
    return hybrid_hits(spark, sf).select("dimension", "rank", "chunk_id", "framework", "dense_score", "similarity")


def shared_words(left, right):
    def score(a, c):
        x, y = set((a or "").lower().split()), set((c or "").lower().split())
        return len(x & y) / max(1, len(x | y))

    return np.array([score(a, c) for a, c in zip(left, right)])


def pair_rerank(spark, sf):
    """Second-stage reranking with a word-set scorer in place of a cross-encoder."""
    found = hybrid_hits(spark, sf, 25)
    ranked = nn.rerank_pairs(found, ["dimension"], 10, score_pairs_with(shared_words), threshold=0.01)
    return ranked.select("dimension", "rank", "chunk_id", F.round("reranker_score", 6).alias("reranker_score"))


def routed(spark, sf):
    """Dimension i may use the sources whose number plus i is no multiple of 3."""
    indexed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(b.DIMS)])
    spread = b.catalog(spark, sf).select("name", "ord", F.explode(indexed).alias("x"))
    return spread.filter(F.pmod(F.col("ord") + F.col("x.i"), F.lit(3)) != 0).select(F.col("x.d").alias("dimension"), "name")


def requests(spark, sf):
    """Every uploaded source asks about every dimension; its number gives its region."""
    workspaces = uploaded_corpus(spark, sf).filter(F.col("workspace_id").isNotNull()).select("workspace_id").distinct()
    number = F.substring("workspace_id", 4, 10).cast("int")
    region = F.concat(F.lit("REGION_"), F.pmod(F.floor(number / 5), F.lit(5)).cast("string"))
    return workspaces.withColumn("region", region).withColumn("dimension", F.explode(F.array(*[F.lit(d) for d in b.DIMS])))


def first_pass(spark, sf):
    """Budgeted buckets for every uploaded source and dimension, with a regional and a tagged slot."""
    corpus = uploaded_corpus(spark, sf)
    catalog = b.catalog(spark, sf)
    return analysis.first_pass(
        corpus.filter("workspace_id IS NULL"), corpus.filter("workspace_id IS NOT NULL"), b.definitions(spark), b.mini_profiles(spark),
        requests(spark, sf), routed(spark, sf), routing.regional_frameworks(catalog), routing.dimension_frameworks(catalog), CAPS,
    )


def bucket_budget(spark, sf):
    columns = ("workspace_id", "dimension", "bucket", "slot", "chunk_id", "similarity", "is_reserved")
    return first_pass(spark, sf).select(*columns)


def prompt_context(spark, sf):
    contexts = render.prompt_context(first_pass(spark, sf))
    return contexts.select("workspace_id", "dimension", F.length("context").alias("chars"), F.md5("context").alias("digest"))


def _tagged():
    number = F.substring("framework", 4, 10).cast("int")
    dims = F.array(*[F.lit(d) for d in b.DIMS])
    return (F.element_at(dims, F.pmod(number, F.lit(8)) + 1) == F.col("dimension")) & (F.col("framework") != "")


def bucket_reserve(spark, sf):
    """One practical slot per dimension is kept for a source tagged with it."""
    corpus = b.embedded_corpus(spark, sf)
    caps = {lx.PRACTICAL: CAPS[lx.PRACTICAL]}
    hits = analysis.bucket_candidates(corpus, b.definitions(spark), None, caps)
    filled = rt.fill_buckets(hits, caps, keys=("dimension",), chars=None).withColumn("is_reserved", _tagged())
    pool = analysis.role_hits(corpus, b.definitions(spark), caps).filter(_tagged()).withColumn("pool", F.lit("tag")).withColumn("kind", F.lit("reserve"))
    reserved = analysis.reranked_pools(pool, corpus, b.definitions(spark), {"reserve": 3}).withColumn("bucket", F.lit(lx.PRACTICAL)).withColumn(
        "slot", F.lit(0)).withColumn("is_reserved", F.lit(True))
    reserved = rt.substantive_first(reserved).withColumn(
        "rank", F.col("rank") + F.when(F.col("_fragment"), 1000).otherwise(0)
    )
    done = rt.enforce_reserve(filled, reserved, caps[lx.PRACTICAL], keys=("dimension",))
    return done.select("dimension", "slot", "chunk_id", "framework", "is_reserved")


def second_queries(spark):
    rows = [(d, " | ".join(t[:4])) for d, t in lx.PROFILES.items()]
    return spark.createDataFrame(rows, "dimension string, text string")


def second_pass_budget(spark, sf):
    return _second_pass(spark, sf).select("dimension", "bucket", "slot", "chunk_id")


def _second_pass(spark, sf):
    caps = {k: v for k, v in rt.SECOND_PASS_CAPS.items() if k != "document"}
    hits = analysis.bucket_candidates(
        b.embedded_corpus(spark, sf), second_queries(spark), None, caps, rt.SECOND_PASS_HEADROOM
    )
    return rt.fill_buckets_in_turn(hits, caps, keys=("dimension",))


def sectioned(spark, sf):
    """Documents as the stored chunks of one source, their language as section."""
    return b.embedded_corpus(spark, sf).select(
        "chunk_id", "text", "embedding", F.col("framework").alias("workspace_id"),
        F.when(F.col("lang") == "es", " ").otherwise(F.col("lang")).alias("section_title"),
        F.pmod("chunk_id", F.lit(3)).cast("int").alias("page_number"), F.col("chunk_id").alias("position"),
        F.lit("").alias("framework"), F.array().cast("array<string>").alias("roles"),
    )


def section_sample(spark, sf):
    picks = rt.section_sample(sectioned(spark, sf))
    return picks.select("workspace_id", "section_title", "pick", "chunk_id")


def topics(spark):
    return spark.createDataFrame(list(enumerate(lx.OVERVIEW_TOPICS)), "query_no int, text string")


def topic_sweep(spark, sf):
    hits = rt.topic_sweep(sectioned(spark, sf), topics(spark))
    return hits.select("workspace_id", "query_no", "rank", "chunk_id", "similarity")


def overview_mix(spark, sf):
    """Alternating mix of section sample and topic sweep per source."""
    return _overview(spark, sf).select("workspace_id", "rank", "chunk_id", F.length("text").alias("chars"))


def _overview(spark, sf):
    chunks = sectioned(spark, sf)
    picks = rt.section_sample(chunks)
    first = picks.groupBy("workspace_id", "section_title").agg(F.min("position").alias("_first"))
    ordered = picks.join(first, ["workspace_id", "section_title"]).withColumn(
        "position", F.col("_first") * rt.SECTION_SAMPLE + F.col("pick")
    )
    sweep = rt.topic_sweep(chunks, topics(spark)).withColumn("position", F.col("query_no") * 1000 + F.col("rank"))
    return rt.interleave(ordered, sweep)


def chat_contexts(spark, sf):
    """Numbered sources of the best eight documents for each definition."""
    number = F.pmod("chunk_id", F.lit(4)).cast("int")
    corpus = b.embedded_corpus(spark, sf).withColumn("section_title", F.when(F.col("lang") != "fr", F.col("lang"))).withColumn(
        "page_number", F.when(number > 0, number)).withColumn("framework", F.when(F.col("framework") != "src3", F.col("framework")))
    hits = nn.retrieve(corpus, b.definitions(spark), 8, query_keys=["dimension"], carry=["framework", "section_title", "page_number"])
    found = render.chat_context(hits, ["dimension"])
    return found.select("dimension", F.length("context").alias("chars"), F.md5("context").alias("digest"))


def overview_contexts(spark, sf):
    """The alternating mix of each source as numbered passages."""
    named = b.documents(spark, sf).select(
        F.col("doc_id").alias("chunk_id"), F.when(F.pmod("doc_id", F.lit(2)) == 0, F.col("source")).alias("document_name"),
        F.when(F.col("lang") != "es", F.col("lang")).alias("section_title"), F.pmod("doc_id", F.lit(3)).cast("int").alias("page_number"),
    )
    found = render.overview_context(_overview(spark, sf).join(named, "chunk_id"), ["workspace_id"])
    return found.select("workspace_id", F.length("context").alias("chars"), F.md5("context").alias("digest"))


def second_contexts(spark, sf):
    """Prompt of the second pass for each dimension."""
    found = render.second_pass_context(_second_pass(spark, sf), ["dimension"])
    return found.select("dimension", F.length("context").alias("chars"), F.md5("context").alias("digest"))


def chat_merge(spark, sf):
    everything = b.embedded_corpus(spark, sf)
    asked = b.definitions(spark)
    broad = nn.retrieve(everything, asked, 8, query_keys=["dimension"])
    narrow = nn.retrieve(everything.filter(F.col("framework") == "src9"), asked, 4, query_keys=["dimension"])
    columns = ["dimension", "rank", "chunk_id", "similarity"]
    merged = rt.merge_hits(broad.select(*columns), narrow.select(*columns), ["dimension"])
    return merged.select("dimension", "merged_rank", "chunk_id", "similarity")


def latest_per_key(spark, sf):
    orders = b.read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return rt.latest_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


def name_list(spark, sf):
    named = b.documents(spark, sf).select(F.when(F.col("lang") == "fr", " ").otherwise(F.col("source")).alias("name"))
    return rt.ordered_names(named, "name")


def workspace_children(spark, sf):
    """Parent rows with counts and totals of their children, childless parents kept."""
    orders = b.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.max("o_orderdate").alias("latest"),
    )
    customers = b.read(spark, sf, "customer").select("c_custkey", "c_name")
    return customers.join(orders, "c_custkey", "left").withColumn("orders", F.coalesce("orders", F.lit(0)))


def status_filter(spark, sf):
    """Finished orders only, as the listing of completed work."""
    return b.read(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").groupBy("o_orderpriority").agg(
        F.count("*").alias("finished")
    )


def region_routing(spark, sf):
    """Framework list per customer: core, dimension-tagged, regional."""
    nations = b.read(spark, sf, "nation").join(
        b.read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    regions = nations.select(
        F.concat(F.lit("REGION_"), F.col("n_regionkey").cast("string")).alias("region"),
        routing.normalize_country(F.col("n_name")).alias("country_key"),
    )
    dims = F.array(*[F.lit(d) for d in b.DIMS])
    asked = b.read(spark, sf, "customer").join(
        b.read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", F.element_at(dims, F.pmod("c_custkey", F.lit(8)).cast("int") + 1).alias("dimension"),
             F.col("n_name").alias("country"))
    return routing.route(asked, b.catalog(spark, sf), regions, CORE).select("c_custkey", "name", "tier", "ord")


def regional_sources(spark, sf):
    """The regional frameworks alone that apply to each customer's country."""
    nations = b.read(spark, sf, "nation")
    regions = nations.select(
        F.concat(F.lit("REGION_"), F.col("n_regionkey").cast("string")).alias("region"), routing.normalize_country(F.col("n_name")).alias("country_key"),
    )
    asked = b.read(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))).alias("country"))
    return routing.regional_subset(asked, b.catalog(spark, sf), regions, [lx.NORMATIVE]).select("c_custkey", "region", "name", "ord")


def dimension_sources(spark, sf):
    """Sources tagged with a dimension, by role."""
    return routing.dimension_frameworks(b.catalog(spark, sf), [lx.PRACTICAL, lx.IMPLEMENTATION])


def best_passages(spark, sf):
    """Pages to sections, chunks, fused retrieval and the best four passages per source and dimension."""
    owners = b.documents(spark, sf).select("doc_id", F.col("source").alias("workspace_id"))
    stored = b.embedded_chunks(spark, sf)
    found = analysis.best_passages(stored.join(owners, "doc_id"), b.mini_profiles(spark), texts=stored)
    return found.select("workspace_id", "dimension", "slot", "chunk_id", "page_number", "rrf_score", "similarity")


QUERIES = {f.__name__: f for f in (
    knn_topk, store_search, index_search, vector_norms, rrf_fused, document_bucket, hybrid_reranked, pair_rerank, bucket_budget, prompt_context,
    bucket_reserve, second_pass_budget, section_sample, topic_sweep, overview_mix, chat_contexts, overview_contexts, second_contexts, chat_merge, latest_per_key,
    name_list, workspace_children, status_filter, region_routing, regional_sources, dimension_sources, best_passages,
)}


# -- SQL ---------------------------------------------------------------------

_KNN_SQL = """v AS (
  SELECT vec_id, label AS own_label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
  FROM embeddings),
centroid AS (SELECT own_label AS label, i, avg(x) AS m FROM v GROUP BY ALL),
cn AS (SELECT label, sqrt(sum(m * m)) AS norm FROM centroid GROUP BY label),
vn AS (SELECT vec_id, any_value(own_label) AS own_label, sqrt(sum(x * x)) AS norm FROM v GROUP BY vec_id),
sims AS (
  SELECT label, vec_id, any_value(vn.own_label) AS own_label,
         round(greatest(0, (1 + sum(x * m) / (any_value(vn.norm) * any_value(cn.norm))) / 2), 6) AS similarity
  FROM v JOIN centroid USING (i) JOIN vn USING (vec_id) JOIN cn USING (label) GROUP BY label, vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank FROM sims)"""

_UPLOADED_SQL = b.ROLE_SQL + """,
up AS (
  SELECT chunk_id, text, lang, n, CASE WHEN n % 5 = 4 THEN framework END AS workspace_id,
         CASE WHEN n % 5 = 4 THEN '' ELSE framework END AS framework,
         CASE WHEN n % 5 <> 4 THEN role1 END AS role1, CASE WHEN n % 5 <> 4 THEN role2 END AS role2
  FROM corpus)"""


def sims_sql(chunks: str, queries: str, query_key: str, prefix: str = "s") -> str:
    """CTE ``{prefix}_sims`` with the similarity of every chunk and query."""
    using = ", ".join(f"d.{k} = q.{k}" for k in query_key.split(", ")).replace(", ", " AND ")
    return f"""{b.embed_sql(prefix + '_tok', chunks, 'chunk_id')},
{b.embed_sql(prefix + '_q', queries, query_key)},
{prefix}_dots AS (
  SELECT t.chunk_id, {', '.join('q.' + k for k in query_key.split(', '))}, sum(t.n * q.n) AS d
  FROM {prefix}_tok t JOIN {prefix}_q q USING (b) GROUP BY ALL),
{prefix}_sims AS (
  SELECT c.*, {', '.join('q.' + k for k in query_key.split(', '))},
         round((1 + coalesce(d.d / (n1.norm * q.norm), 0)) / 2, 6) AS similarity
  FROM {chunks} c CROSS JOIN {prefix}_q_norm q
  LEFT JOIN {prefix}_tok_norm n1 ON n1.chunk_id = c.chunk_id
  LEFT JOIN {prefix}_dots d ON d.chunk_id = c.chunk_id AND {using})"""


_DEFINITIONS_SQL = "defs AS (SELECT dimension, text FROM profiles WHERE query_no = 0)"
_STOP = b.sql_list(lx.QUERY_STOP_WORDS)


def hybrid_sql(sims: str, where: str, dense_k: int, k: int, name: str, queries: str = "defs",
               keys: str = "dimension", query_key: str = "dimension") -> str:
    """CTE ``name``: dense cut, hybrid score, cut to k."""
    terms = (
        "list_distinct(list_filter(" + b.tokens_sql("lower(q.text)")
        + f", lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w)))"
    )
    using = " AND ".join(f"q.{c} = d.{c}" for c in query_key.split(", "))
    return f"""{name}_dense AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY similarity DESC, chunk_id) AS dr FROM {sims} WHERE {where}),
{name}_scored AS (
  SELECT d.*, 0.7::DOUBLE * similarity + (1.0::DOUBLE - 0.7::DOUBLE) *
         (len(list_filter({terms}, lambda w: contains(lower(d.text), w)))::DOUBLE
          / (len({b.tokens_sql(b.strip_sql('d.text'))}) + 1)) AS combined
  FROM {name}_dense d JOIN {queries} q ON {using} WHERE dr <= {dense_k}),
{name} AS (
  SELECT * EXCLUDE (similarity, dr), similarity AS dense, round(combined, 4) AS similarity, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY combined DESC, similarity DESC, chunk_id) AS rank
    FROM {name}_scored) WHERE rank <= {k})"""


def fused_sql(sims: str, keys: str, k: int, cut: int, name: str) -> str:
    """CTE ``name``: rank lists per query, fused per key, cut."""
    return f"""{name}_lists AS (
  SELECT *, row_number() OVER (PARTITION BY {keys}, query_no ORDER BY similarity DESC, chunk_id) AS lr FROM {sims}),
{name}_fused AS (
  SELECT {keys}, chunk_id, any_value(text) AS text, round(sum(1.0::DOUBLE / (60 + lr - 1)), 10) AS rrf_score,
         max(similarity) AS similarity
  FROM {name}_lists WHERE lr <= {k} GROUP BY {keys}, chunk_id),
{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY rrf_score DESC, chunk_id) AS rank FROM {name}_fused)
  WHERE rank <= {cut})"""


_KEY = b.flat_sql("lower(coalesce(text, ''))")
_ROLES = "(role1 = '{0}' OR role2 = '{0}')"


def filled_sql(candidates: str, keys: str, caps: dict, name: str) -> str:
    order = "CASE bucket " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(caps)) + " END"
    cap = "CASE bucket " + " ".join(f"WHEN '{x}' THEN {c}" for x, c in caps.items()) + " END"
    return f"""{name}_p AS (
  SELECT *, {order} AS bo FROM {candidates}),
{name}_f AS (SELECT *, {b.fragment_sql('text')} AS frag, {_KEY} AS tk FROM {name}_p),
{name}_i AS (SELECT * FROM {name}_f QUALIFY row_number() OVER (PARTITION BY {keys}, chunk_id ORDER BY bo, frag, rank) = 1),
{name}_t AS (SELECT * FROM {name}_i QUALIFY row_number() OVER (PARTITION BY {keys}, bucket, tk ORDER BY frag, rank, chunk_id) = 1),
{name} AS (SELECT * REPLACE (substr(text, 1, 800) AS text) FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys}, bucket ORDER BY frag, rank, chunk_id) AS slot FROM {name}_t)
  WHERE slot <= {cap})"""


_FIRST_PASS_SQL = f"""{b.PROFILE_SQL}, {_DEFINITIONS_SQL}, {_UPLOADED_SQL},
fw AS (SELECT * FROM up WHERE workspace_id IS NULL), own AS (SELECT * FROM up WHERE workspace_id IS NOT NULL),
{sims_sql('fw', 'defs', 'dimension', 'f')},
dims(dimension, i) AS (VALUES {b.values((d, i) for i, d in enumerate(b.DIMS))}),
allowed AS (SELECT s.* FROM f_sims s JOIN dims USING (dimension)
            WHERE {_ROLES.format(lx.NORMATIVE)} AND (n + i) % 3 <> 0),
{hybrid_sql('allowed', 'true', 60, 12, 'norm')},
{hybrid_sql('f_sims', _ROLES.format(lx.PRACTICAL), 45, 9, 'prac')},
{sims_sql('own', 'profiles', 'dimension, query_no', 'o')},
{fused_sql('o_sims', 'workspace_id, dimension', 20, 20, 'docs')},
requests AS (SELECT DISTINCT own.workspace_id, dimension FROM own, dims),
cand AS (
  SELECT r.workspace_id, r.dimension, '{lx.NORMATIVE}' AS bucket, rank, chunk_id, text, framework, similarity
  FROM norm JOIN requests r USING (dimension)
  UNION ALL
  SELECT r.workspace_id, r.dimension, '{lx.PRACTICAL}', rank, chunk_id, text, framework, similarity
  FROM prac JOIN requests r USING (dimension)
  UNION ALL
  SELECT workspace_id, dimension, 'document', rank, chunk_id, text, '', similarity FROM docs),
{filled_sql('cand', 'workspace_id, dimension', CAPS, 'gen')},
regions AS (SELECT DISTINCT workspace_id, 'REGION_' || ((substr(workspace_id, 4)::INT // 5) % 5) AS region FROM own),
near AS (SELECT *, 'REGION_' || (n % 5) AS region FROM f_sims WHERE n % 3 = 0 AND {_ROLES.format(lx.NORMATIVE)}),
{hybrid_sql('near', 'true', 15, 3, 'rreg', 'defs', 'region, dimension', 'dimension')},
topical AS (SELECT * FROM f_sims WHERE {_ROLES.format(lx.PRACTICAL)} AND ({b.sql_list(b.DIMS)})[(n % 8) + 1] = dimension),
{hybrid_sql('topical', 'true', 15, 3, 'rtag')},
kept AS (
  SELECT g.*, CASE bucket WHEN '{lx.NORMATIVE}' THEN substr(framework, 4)::INT % 3 = 0 AND 'REGION_' || (substr(framework, 4)::INT % 5) = region
    WHEN '{lx.PRACTICAL}' THEN ({b.sql_list(b.DIMS)})[(substr(framework, 4)::INT % 8) + 1] = dimension ELSE false END AS is_reserved
  FROM gen g JOIN regions USING (workspace_id)),
pool AS (
  SELECT regions.workspace_id, dimension, '{lx.NORMATIVE}' AS bucket, rank, chunk_id, text, framework, similarity FROM rreg JOIN regions USING (region)
  UNION ALL SELECT requests.workspace_id, dimension, '{lx.PRACTICAL}', rank, chunk_id, text, framework, similarity FROM rtag JOIN requests USING (dimension)),
state AS (
  SELECT workspace_id, dimension, bucket, count(*) FILTER (is_reserved) AS have, count(*) AS size, max(slot) FILTER (NOT is_reserved) AS freed
  FROM kept GROUP BY ALL),
ranked_pool AS (SELECT *, {_KEY} AS tk, {b.fragment_sql('text')} AS frag FROM pool),
fresh AS (
  SELECT p.*, coalesce(have, 0) AS have, coalesce(size, 0) AS size, freed FROM ranked_pool p LEFT JOIN state USING (workspace_id, dimension, bucket)
  WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.workspace_id = p.workspace_id AND k.dimension = p.dimension AND k.bucket = p.bucket AND k.tk = p.tk)),
placed AS (
  SELECT *, coalesce(freed, size + 1) AS slot FROM fresh
  QUALIFY row_number() OVER (PARTITION BY workspace_id, dimension, bucket ORDER BY frag, rank, chunk_id) = 1 AND have = 0
    AND (freed IS NOT NULL OR size < CASE bucket WHEN '{lx.NORMATIVE}' THEN {CAPS[lx.NORMATIVE]} ELSE {CAPS[lx.PRACTICAL]} END)),
filled AS (
  SELECT workspace_id, dimension, bucket, slot, chunk_id, similarity, is_reserved, framework, text FROM kept k
  WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.workspace_id = k.workspace_id AND p.dimension = k.dimension AND p.bucket = k.bucket AND p.slot = k.slot)
  UNION ALL SELECT workspace_id, dimension, bucket, slot, chunk_id, similarity, true, framework, substr(text, 1, 800) FROM placed)"""


def _block_sql(bucket: str, prefix: str, empty: str) -> str:
    return f"""coalesce(string_agg('[{prefix}-' || slot || '] chunk_id=' || chunk_id || ' Source: ' ||
      coalesce(nullif(framework, ''), 'Uploaded Document') || chr(10) || text, chr(10) ORDER BY slot)
      FILTER (bucket = '{bucket}'), '{empty}')"""


_RESERVE_SQL = f"""{b.PROFILE_SQL}, {_DEFINITIONS_SQL}, {b.ROLE_SQL},
{sims_sql('corpus', 'defs', 'dimension', 'f')},
tagged AS (SELECT *, ({b.sql_list(b.DIMS)})[(n % 8) + 1] = dimension AS is_reserved FROM f_sims),
{hybrid_sql('tagged', _ROLES.format(lx.PRACTICAL), 45, 9, 'prac')},
cand AS (SELECT *, '{lx.PRACTICAL}' AS bucket FROM prac),
{filled_sql('cand', 'dimension', {lx.PRACTICAL: 3}, 'filled')},
{hybrid_sql('tagged', _ROLES.format(lx.PRACTICAL) + ' AND is_reserved', 15, 3, 'rsv')},
state AS (SELECT dimension, count(*) FILTER (is_reserved) AS have, count(*) AS size FROM filled GROUP BY 1),
rk AS (SELECT *, {_KEY} AS tk, {b.fragment_sql('text')} AS frag
       FROM rsv),
fresh AS (
  SELECT rk.*, coalesce(have, 0) AS have, coalesce(size, 0) AS size FROM rk LEFT JOIN state USING (dimension)
  WHERE NOT EXISTS (SELECT 1 FROM filled f WHERE f.dimension = rk.dimension AND f.tk = rk.tk)
  QUALIFY row_number() OVER (PARTITION BY dimension, tk ORDER BY frag, rank, chunk_id) = 1),
wanted AS (
  SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY frag, rank, chunk_id) <= 1 - have),
evict AS (
  SELECT dimension, max(slot) FILTER (NOT is_reserved) AS freed FROM filled GROUP BY dimension),
placed AS (
  SELECT w.dimension, coalesce(freed, size + 1) AS slot, chunk_id, framework, freed, size
  FROM wanted w LEFT JOIN evict USING (dimension) WHERE freed IS NOT NULL OR size < 3)"""

_SECOND_SQL = f"""{b.PROFILE_SQL}, {b.ROLE_SQL},
defs AS (SELECT dimension, string_agg(text, ' | ' ORDER BY query_no) AS text FROM profiles
         WHERE query_no <= 3 GROUP BY dimension),
{sims_sql('corpus', 'defs', 'dimension', 'f')},
{hybrid_sql('f_sims', _ROLES.format(lx.IMPLEMENTATION), 30, 6, 'im')},
{hybrid_sql('f_sims', _ROLES.format(lx.INCIDENT), 30, 6, 'inc')},
im2 AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY frag, rank, chunk_id) AS pos FROM (
  SELECT *, {b.fragment_sql('text')} AS frag, {_KEY} AS tk
  FROM im)),
im3 AS (SELECT * FROM im2 QUALIFY row_number() OVER (PARTITION BY dimension, tk ORDER BY pos) = 1),
im4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY pos) AS slot FROM im3) WHERE slot <= 3),
closed AS (SELECT dimension, CASE WHEN count(*) >= 3 THEN max(pos) END AS closed_at FROM im4 GROUP BY 1),
looked AS (SELECT im2.dimension, chunk_id FROM im2 JOIN closed USING (dimension) WHERE closed_at IS NULL OR pos <= closed_at),
inc2 AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY frag, rank, chunk_id) AS slot FROM (
  SELECT *, {b.fragment_sql('text')} AS frag FROM inc ANTI JOIN looked USING (dimension, chunk_id)))"""

_SECTIONED_SQL = """sectioned AS (
  SELECT doc_id AS chunk_id, text, source AS workspace_id, CASE WHEN lang = 'es' THEN '(unsectioned)' ELSE lang END AS section_title,
         doc_id % 3 AS page_number FROM documents)"""

_TOPICS_SQL = "topics(query_no, text) AS (VALUES " + b.values(enumerate(lx.OVERVIEW_TOPICS)) + ")"

_OVERVIEW_MIX_SQL = f"""WITH RECURSIVE {_TOPICS_SQL}, {_SECTIONED_SQL}, {sims_sql('sectioned', 'topics', 'query_no', 'f')},
{hybrid_sql('f_sims', 'true', 45, 15, 'h', 'topics', 'workspace_id, query_no', 'query_no')},
sp AS (
  SELECT *, row_number() OVER (PARTITION BY workspace_id, section_title ORDER BY chunk_id) AS pick FROM sectioned
  WHERE NOT {b.preamble_sql('text', 'page_number')} QUALIFY pick <= 2),
picks AS (
  SELECT workspace_id, chunk_id, text, 0 AS side, min(chunk_id) OVER (PARTITION BY workspace_id, section_title) * 2 + pick AS position FROM sp),
sweep AS (SELECT workspace_id, chunk_id, text, 1 AS side, query_no * 1000 + rank AS position FROM h WHERE NOT {b.preamble_sql('text', 'page_number')}),
keyed AS (SELECT *, md5({b.strip_sql('lower(text)')}) AS o FROM (FROM picks UNION ALL FROM sweep)),
by_id AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY workspace_id, side, chunk_id ORDER BY position) = 1),
by_text AS (SELECT * FROM by_id QUALIFY row_number() OVER (PARTITION BY workspace_id, side, o ORDER BY position, chunk_id) = 1),
lists AS (
  SELECT workspace_id, coalesce(list({{'c': chunk_id, 'o': o}} ORDER BY position, chunk_id) FILTER (side = 0), []) AS a,
         coalesce(list({{'c': chunk_id, 'o': o}} ORDER BY position, chunk_id) FILTER (side = 1), []) AS b FROM by_text GROUP BY workspace_id),
f AS (
  SELECT workspace_id, a, b, 1 AS i, 1 AS j, []::BIGINT[] AS ids, []::VARCHAR[] AS texts FROM lists
  UNION ALL
  SELECT workspace_id, a, b, CASE WHEN l THEN i + 1 ELSE i END, CASE WHEN l THEN j ELSE j + 1 END,
    CASE WHEN known THEN ids ELSE list_append(ids, x.c) END, CASE WHEN known THEN texts ELSE list_append(texts, x.o) END
  FROM (
    SELECT *, list_contains(ids, x.c) OR list_contains(texts, x.o) AS known FROM (
      SELECT *, CASE WHEN l THEN a[i] ELSE b[j] END AS x FROM (
        SELECT *, CASE WHEN len(ids) % 2 = 0 THEN i <= len(a) ELSE j > len(b) END AS l FROM f
        WHERE len(ids) < 10 AND (i <= len(a) OR j <= len(b)))))),
final AS (SELECT workspace_id, ids FROM f QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY i + j DESC) = 1),
out AS (SELECT workspace_id, unnest(ids) AS chunk_id, generate_subscripts(ids, 1)::INT AS rank FROM final)"""

_CORPUS_DEFS = f"""{b.PROFILE_SQL}, {_DEFINITIONS_SQL}, {b.ROLE_SQL}, {sims_sql('corpus', 'defs', 'dimension', 'f')}"""

from policyloom.workload.ingestion import CHUNKS_SQL  # noqa: E402

ORACLE = {
    "knn_topk": f"""WITH {_KNN_SQL}
SELECT label, vec_id AS chunk_id, similarity, rank FROM ranked WHERE rank <= 10""",
    "store_search": f"""WITH {_CORPUS_DEFS},
r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY similarity DESC, chunk_id) AS rank FROM f_sims)
SELECT dimension, rank, chunk_id, framework, similarity FROM r WHERE rank <= 10""",
    "index_search": """WITH v AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
n AS (SELECT vec_id, any_value(label) AS label, sqrt(sum(x * x)) AS norm FROM v GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, any_value(cn.label) AS label,
         round(greatest(0, (1 + sum(c.x * q.x) / (any_value(cn.norm) * any_value(qn.norm))) / 2), 6) AS similarity
  FROM v q JOIN v c USING (i) JOIN n cn ON cn.vec_id = c.vec_id JOIN n qn ON qn.vec_id = q.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM s)
SELECT query_id, rank, chunk_id, label, similarity FROM r WHERE rank <= 10""",
    "vector_norms": """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE * 3 AS x FROM embeddings)
SELECT vec_id, round(sqrt(sum(x * x)), 6) AS norm, 1.0::DOUBLE AS unit_norm FROM v GROUP BY vec_id""",
    "rrf_fused": f"""WITH {b.PROFILE_SQL}, {_UPLOADED_SQL}, {sims_sql('up', 'profiles', 'dimension, query_no', 's')},
lists AS (SELECT *, row_number() OVER (PARTITION BY dimension, query_no ORDER BY similarity DESC, chunk_id) AS lr
          FROM s_sims)
SELECT dimension, framework, chunk_id, round(sum(1.0::DOUBLE / (60 + lr - 1)), 10) AS rrf_score,
       max(similarity) AS best_similarity, framework = '' AS is_document
FROM lists WHERE lr <= CASE WHEN query_no = 0 THEN 10 ELSE 5 END GROUP BY dimension, framework, chunk_id""",
    "document_bucket": f"""WITH {b.PROFILE_SQL}, {b.ROLE_SQL}, {sims_sql('corpus', 'profiles', 'dimension, query_no', 's')},
{fused_sql('s_sims', 'framework, dimension', 20, 20, 'docs')}
SELECT framework, dimension, rank, chunk_id, rrf_score, similarity FROM docs""",
    "hybrid_reranked": f"""WITH {_CORPUS_DEFS}, {hybrid_sql('f_sims', _ROLES.format(lx.PRACTICAL), 25, 5, 'h')}
SELECT dimension, rank, chunk_id, framework, round(dense, 4) AS dense_score, similarity FROM h""",
    "pair_rerank": f"""WITH {_CORPUS_DEFS}, {hybrid_sql('f_sims', _ROLES.format(lx.PRACTICAL), 125, 25, 'h')},
sets AS (
  SELECT h.dimension, chunk_id, list_distinct({b.tokens_sql(b.strip_sql('lower(q.text)'))}) AS a,
         list_distinct({b.tokens_sql(b.strip_sql('lower(h.text)'))}) AS c
  FROM h JOIN defs q USING (dimension)),
scored AS (
  SELECT *, len(list_intersect(a, c))::DOUBLE / greatest(1, len(list_distinct(list_concat(a, c)))) AS s FROM sets)
SELECT dimension, rank, chunk_id, round(s, 6) AS reranker_score FROM (
  SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY s DESC, chunk_id) AS rank FROM scored)
WHERE rank <= 10 AND s >= 0.01""",
    "bucket_budget": f"""WITH {_FIRST_PASS_SQL}
SELECT workspace_id, dimension, bucket, slot, chunk_id, similarity, is_reserved FROM filled""",
    "prompt_context": f"""WITH {_FIRST_PASS_SQL},
c AS (SELECT workspace_id, dimension,
  'Dimension: ' || dimension || chr(10) || chr(10) || '═══ [UPLOADED DOCUMENT] — primary evidence ═══' || chr(10) ||
  {_block_sql('document', 'DOC', '(no document chunks retrieved for this dimension)')} || chr(10) || chr(10) ||
  '═══ [MODULE 1 — NORMATIVE REQUIREMENTS] ═══' || chr(10) ||
  {_block_sql(lx.NORMATIVE, 'NORM', '(no Module 1 normative chunks retrieved)')} || chr(10) || chr(10) ||
  '═══ [MODULE 2 — PRACTICAL TOOLKITS & MECHANISMS] ═══' || chr(10) ||
  {_block_sql(lx.PRACTICAL, 'PRAC', '(no Module 2 practical chunks retrieved)')} AS context
  FROM filled GROUP BY workspace_id, dimension)
SELECT workspace_id, dimension, length(context) AS chars, md5(context) AS digest FROM c""",
    "bucket_reserve": f"""WITH {_RESERVE_SQL}
SELECT dimension, slot, chunk_id, framework, is_reserved FROM filled f
WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.dimension = f.dimension AND p.freed = f.slot)
UNION ALL SELECT dimension, slot, chunk_id, framework, true FROM placed""",
    "second_pass_budget": f"""WITH {_SECOND_SQL}
SELECT dimension, '{lx.IMPLEMENTATION}' AS bucket, slot, chunk_id FROM im4
UNION ALL SELECT dimension, '{lx.INCIDENT}', slot, chunk_id FROM inc2 WHERE slot <= 3""",
    "section_sample": f"""WITH {_SECTIONED_SQL}
SELECT workspace_id, section_title, pick, chunk_id FROM (
  SELECT *, row_number() OVER (PARTITION BY workspace_id, section_title ORDER BY chunk_id) AS pick FROM sectioned
  WHERE NOT {b.preamble_sql('text', 'page_number')}) WHERE pick <= 2""",
    "topic_sweep": f"""WITH {_TOPICS_SQL}, {_SECTIONED_SQL}, {sims_sql('sectioned', 'topics', 'query_no', 'f')},
{hybrid_sql('f_sims', 'true', 45, 15, 'h', 'topics', 'workspace_id, query_no', 'query_no')}
SELECT workspace_id, query_no, rank, chunk_id, similarity FROM h WHERE NOT {b.preamble_sql('text', 'page_number')}""",
    "overview_mix": f"""{_OVERVIEW_MIX_SQL}
SELECT out.workspace_id, rank, out.chunk_id, least(length(text), 900)::INT AS chars FROM out JOIN sectioned s ON s.chunk_id = out.chunk_id""",
    "chat_contexts": f"""WITH {_CORPUS_DEFS}, {hybrid_sql('f_sims', 'true', 24, 8, 'h')}
SELECT dimension, length(c)::INT AS chars, md5(c) AS digest FROM (
  SELECT dimension, string_agg('[' || rank || '] Source: ' || CASE WHEN framework = 'src3' THEN 'Uploaded Document' ELSE framework END ||
    CASE WHEN lang <> 'fr' THEN ', ' || lang ELSE '' END || CASE WHEN chunk_id % 4 > 0 THEN ' (p. ' || (chunk_id % 4) || ')' ELSE '' END ||
    chr(10) || text || chr(10), chr(10) ORDER BY rank) AS c FROM h GROUP BY dimension)""",
    "overview_contexts": f"""{_OVERVIEW_MIX_SQL}
SELECT workspace_id, length(c)::INT AS chars, md5(c) AS digest FROM (
  SELECT out.workspace_id, string_agg('[DOC-' || rank || '] (' || CASE WHEN doc_id % 2 = 0 THEN source ELSE 'Uploaded Document' END ||
    CASE WHEN lang <> 'es' THEN ', ' || lang ELSE '' END || CASE WHEN doc_id % 3 > 0 THEN ', p. ' || (doc_id % 3) ELSE '' END || ')' ||
    chr(10) || substr(text, 1, 900) || chr(10), chr(10) ORDER BY rank) AS c
  FROM out JOIN documents d ON d.doc_id = out.chunk_id GROUP BY out.workspace_id)""",
    "second_contexts": f"""WITH {_SECOND_SQL},
rows2 AS (
  SELECT dimension, '{lx.IMPLEMENTATION}' AS bucket, slot, chunk_id, framework, substr(text, 1, 800) AS text FROM im4
  UNION ALL SELECT dimension, '{lx.INCIDENT}', slot, chunk_id, framework, substr(text, 1, 800) FROM inc2 WHERE slot <= 3)
SELECT dimension, length(context)::INT AS chars, md5(context) AS digest FROM (SELECT dimension,
  'Dimension: ' || dimension || chr(10) || chr(10) || '═══ [MODULE 3 — IMPLEMENTATION SOURCES] ═══' || chr(10) ||
  {_block_sql(lx.IMPLEMENTATION, 'IMPL', '(no Module 3 implementation chunks retrieved)')} || chr(10) || chr(10) ||
  '═══ [MODULE 4 — INCIDENT RECORDS] ═══' || chr(10) || {_block_sql(lx.INCIDENT, 'INC', '(no curated incident records retrieved)')} || chr(10) || chr(10) ||
  '═══ [UPLOADED DOCUMENT — for responsible-agency grounding] ═══' || chr(10) || '(no document chunks retrieved)' AS context FROM rows2 GROUP BY dimension)""",
    "chat_merge": f"""WITH {_CORPUS_DEFS}, {hybrid_sql('f_sims', 'true', 24, 8, 'broad')},
{hybrid_sql('f_sims', "framework = 'src9'", 12, 4, 'narrow')},
both_hits AS (SELECT dimension, chunk_id, rank, similarity, 0 AS src FROM broad
         UNION ALL SELECT dimension, chunk_id, rank, similarity, 1 FROM narrow),
once AS (SELECT * FROM both_hits QUALIFY row_number() OVER (PARTITION BY dimension, chunk_id ORDER BY src, rank) = 1)
SELECT dimension, merged_rank, chunk_id, similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY similarity DESC, src, rank) AS merged_rank FROM once)
WHERE merged_rank <= 10""",
    "latest_per_key": """SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "name_list": "SELECT DISTINCT source AS name FROM documents WHERE lang <> 'fr'",
    "workspace_children": """SELECT c_custkey, c_name, count(o_orderkey) AS orders, round(sum(o_totalprice), 2) AS total,
       max(o_orderdate) AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""",
    "status_filter": "SELECT o_orderpriority, count(*) AS finished FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
    "regional_sources": f"""WITH cat AS (
  SELECT DISTINCT source AS name, substr(source, 4)::INT AS ord FROM documents)
SELECT c_custkey, 'REGION_' || n_regionkey AS region, name, ord FROM customer JOIN nation ON n_nationkey = c_nationkey
JOIN cat ON ord % 3 = 0 AND ord % 5 = n_regionkey
WHERE ({b.sql_list(b.ROLES)})[(ord % 4) + 1] = '{lx.NORMATIVE}' OR (ord % 5 = 0 AND ({b.sql_list(b.ROLES)})[((ord + 1) % 4) + 1] = '{lx.NORMATIVE}')""",
    "region_routing": f"""WITH cat AS (
  SELECT *, ({b.sql_list(b.ROLES)})[(ord % 4) + 1] = '{lx.NORMATIVE}'
            OR (ord % 5 = 0 AND ({b.sql_list(b.ROLES)})[((ord + 1) % 4) + 1] = '{lx.NORMATIVE}') AS normative
  FROM (SELECT DISTINCT source AS name, substr(source, 4)::INT AS ord FROM documents)),
asked AS (SELECT c_custkey, c_custkey % 8 AS d, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
all_rows AS (
  SELECT c_custkey, t.name, 0 AS tier, t.ord FROM asked,
         (VALUES {b.values((n, i) for i, n in enumerate(CORE))}) t(name, ord)
  UNION ALL
  SELECT c_custkey, name, 1, ord FROM asked JOIN cat ON ord % 8 = d AND normative
  UNION ALL
  SELECT c_custkey, name, 2, ord FROM asked JOIN cat ON ord % 3 = 0 AND ord % 5 = n_regionkey)
SELECT c_custkey, name, tier, ord FROM all_rows
QUALIFY row_number() OVER (PARTITION BY c_custkey, name ORDER BY tier, ord) = 1""",
    "dimension_sources": f"""WITH cat AS (SELECT DISTINCT framework AS name, n, role1, role2 FROM ({b.ROLE_SQL.split('AS (', 1)[1].rsplit(')', 1)[0]}))
SELECT ({b.sql_list(b.DIMS)})[(n % 8) + 1] AS dimension, name, n AS ord FROM cat
WHERE role1 IN ('{lx.PRACTICAL}', '{lx.IMPLEMENTATION}') OR role2 IN ('{lx.PRACTICAL}', '{lx.IMPLEMENTATION}')""",
    "best_passages": f"""WITH {b.PROFILE_SQL}, {CHUNKS_SQL},
owned AS (
  SELECT substr(sha256(c.doc_id || '|' || section_no || '|' || chunk_no), 1, 32) AS chunk_id, c.text,
         floor(page)::INT AS page_number, source AS workspace_id
  FROM chunks c JOIN documents d USING (doc_id)
  WHERE NOT {b.preamble_sql('c.text', 'floor(page)')}),
{sims_sql('owned', 'profiles', 'dimension, query_no', 's')},
{fused_sql('s_sims', 'workspace_id, dimension', 20, 20, 'docs')},
cand AS (SELECT docs.*, 'document' AS bucket FROM docs),
{filled_sql('cand', 'workspace_id, dimension', {'document': 4}, 'filled')}
SELECT workspace_id, dimension, slot, chunk_id, page_number, rrf_score, filled.similarity
FROM filled JOIN owned USING (chunk_id, workspace_id)""",
}
