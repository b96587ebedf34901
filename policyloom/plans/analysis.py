"""End-to-end jobs over all workspaces and dimensions at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policyloom import lexicons as lx
from policyloom.functions import text as tx
from policyloom.operators import analytics, consistency, retrieve, rules
from policyloom.operators.nearest import ROLE_HEADROOM, attach_columns, hybrid_rerank, nearest
from policyloom.operators.ordering import first_per_key, top_k
from policyloom.operators.segment import MAX_CHUNK, OVERLAP, expand_roles, ingest_pages
from policyloom.session import cut_lineage, materialize
from policyloom.sources import catalog
from policyloom.sources.log import LogTable


def passages_per_dimension(pages: DataFrame, workspaces: DataFrame, queries: DataFrame) -> DataFrame:
    """Pages to the best four distinct, substantive passages per workspace and dimension.

    ``workspaces(doc_id, workspace_id)`` says whose document a page belongs to.
    """
    chunks = materialize(ingest_pages(pages).join(workspaces, "doc_id"))
    return best_passages(chunks, queries)


def best_passages(
    chunks: DataFrame, queries: DataFrame, cap: int = 4, scope: str = "workspace_id", texts: DataFrame | None = None,
) -> DataFrame:
    """``texts`` is the chunk store, if ``chunks`` are rows of it to which their scope was joined: ids are unique there."""
    usable = chunks.filter(~tx.is_preamble(F.col("text"), F.col("page_number")))
    candidates = retrieve.document_candidates(
        usable, queries, cap * retrieve.DOCUMENT_HEADROOM, scope=scope, carry=("text", "page_number"),
        texts=chunks if texts is None else texts,
    )
    return retrieve.fill_buckets(
        candidates.withColumn("bucket", F.lit("document")), {"document": cap}, keys=(scope, "dimension")
    )


def role_hits(chunks: DataFrame, requests: DataFrame, caps: dict[str, int], headroom: int = retrieve.BUCKET_HEADROOM) -> DataFrame:
    """``(dimension, bucket, framework, chunk_id, similarity)``: what any framework bucket may take, in one scan.

    Chunks are ranked inside their framework and set of roles, so that every later restriction to roles or frameworks
    finds its best among them.
    """
    buckets = [b for b in caps if b != "document"]
    k = max(caps[b] for b in buckets) * headroom * ROLE_HEADROOM
    roles = F.array_intersect(F.coalesce("roles", F.array().cast("array<string>")), F.array(*map(F.lit, buckets)))
    scoped = chunks.withColumn("_roles", F.array_join(F.array_sort(roles), ",")).filter("_roles <> ''").withColumn(
        "_scope", F.concat_ws("|", F.coalesce("framework", F.lit("")), "_roles")
    )
    dense = nearest(scoped, requests.select("dimension", "text"), k, query_keys=["dimension"], scope="_scope", carry=["framework", "_roles"])
    return materialize(dense.withColumn("bucket", F.explode(F.split("_roles", ","))).select("dimension", "bucket", "framework", "chunk_id", "similarity"))


def reranked_pools(pools: DataFrame, chunks: DataFrame, requests: DataFrame, k: dict[str, int]) -> DataFrame:
    """The best ``k[pool]`` of each ``(pool, dimension)`` by the hybrid score; texts are joined once for all pools."""
    at_most = F.create_map(*[F.lit(v) for pair in k.items() for v in pair])[F.col("kind")]
    keys = ["pool", "dimension"]
    cut = top_k(pools, keys, [F.desc("similarity"), F.asc("chunk_id")], max(k.values()) * ROLE_HEADROOM, spread_by="chunk_id")
    cut = cut.filter(F.col("rank") <= at_most * ROLE_HEADROOM)
    worded = attach_columns(cut, chunks, "chunk_id", ["text"]).join(requests.select("dimension", F.col("text").alias("query_text")), "dimension")
    return hybrid_rerank(worded, keys, max(k.values())).filter(F.col("rank") <= at_most).drop("query_text")


def bucket_candidates(chunks: DataFrame, requests: DataFrame, routed: DataFrame | None, caps: dict[str, int],
                      headroom: int = retrieve.BUCKET_HEADROOM) -> DataFrame:
    """Role-scoped hits per dimension for the framework buckets.

    ``requests(dimension, text)`` are the query texts; ``routed(dimension,
    name)`` restricts the normative bucket to the routed frameworks.
    """
    hits = _allowed(role_hits(chunks, requests, caps, headroom), routed)
    pools = hits.withColumn("pool", F.col("bucket")).withColumn("kind", F.col("bucket"))
    done = reranked_pools(pools, chunks, requests, {b: c * headroom for b, c in caps.items() if b != "document"})
    return done.drop("pool", "kind")


def _allowed(hits: DataFrame, routed: DataFrame | None) -> DataFrame:
    if routed is None:
        return hits
    names = routed.select("dimension", F.col("name").alias("framework"), F.lit(lx.NORMATIVE).alias("bucket")).distinct()
    free = hits.filter(F.col("bucket") != lx.NORMATIVE)
    return hits.join(names, ["dimension", "framework", "bucket"], "left_semi").select(*hits.columns).unionByName(free)


RESERVES = {lx.NORMATIVE: 1, lx.PRACTICAL: 1}
RESERVE_POOL = 3


def first_pass(
    chunks: DataFrame, doc_chunks: DataFrame, requests: DataFrame, profiles: DataFrame, workspaces: DataFrame,
    routed: DataFrame | None, regional: DataFrame, tagged: DataFrame, caps: dict[str, int] | None = None,
) -> DataFrame:
    """The budgeted passages of every workspace and dimension, with the slots kept for routed sources.

    ``chunks`` are the frameworks' and ``doc_chunks`` the uploaded documents' stored chunks; ``requests(dimension,
    text)``, ``profiles(dimension, query_no, text)``; ``workspaces(workspace_id, dimension, region)``; ``routed``,
    ``tagged`` are ``(dimension, name)`` and ``regional`` is ``(region, name)``.  One normative slot goes to a
    framework of the workspace's region and one practical slot to a framework tagged with the dimension, where the
    general ranking has not given them any.

    The vectors of frameworks and documents are scanned once each.  Framework pools are ranked once for each dimension
    and region; only ids, text keys and scores are copied to the workspaces, and texts join the winners.
    """
    caps = retrieve.FIRST_PASS_CAPS if caps is None else caps
    hits = role_hits(chunks, requests, caps)
    general = _allowed(hits, routed).select("*", F.col("bucket").alias("pool"), F.col("bucket").alias("kind"))
    by_region = hits.filter(F.col("bucket") == lx.NORMATIVE).join(regional.select(F.col("name").alias("framework"), "region").distinct(), "framework")
    by_region = by_region.withColumn("pool", F.concat(F.lit("region "), "region")).withColumn("kind", F.lit("reserve")).drop("region")
    by_tag = hits.filter(F.col("bucket") == lx.PRACTICAL).join(
        tagged.select("dimension", F.col("name").alias("framework")).distinct(), ["dimension", "framework"], "left_semi"
    ).withColumn("pool", F.lit("tag")).withColumn("kind", F.lit("reserve"))
    sizes = {b: c * retrieve.BUCKET_HEADROOM for b, c in caps.items() if b != "document"} | {"reserve": RESERVE_POOL}
    pools = reranked_pools(general.unionByName(by_region).unionByName(by_tag), chunks, requests, sizes)
    pools = materialize(_keyed(pools))
    own = document_pool(doc_chunks, profiles, caps)

    narrow = ["bucket", "rank", "chunk_id", "framework", "similarity", "is_fragment", "text_key"]
    asked = workspaces.select("workspace_id", "dimension", "region").distinct()
    shared = asked.select("workspace_id", "dimension").join(pools.filter(F.col("kind") != "reserve").select("dimension", *narrow), "dimension")
    filled = retrieve.fill_buckets(shared.unionByName(own.select("workspace_id", "dimension", *narrow)), caps, chars=None)

    near = asked.join(regional.select("region", F.col("name").alias("framework")).distinct(), "region").select(
        "workspace_id", "dimension", F.lit(lx.NORMATIVE).alias("bucket"), "framework")
    for_topic = asked.join(tagged.select("dimension", F.col("name").alias("framework")).distinct(), "dimension").select(
        "workspace_id", "dimension", F.lit(lx.PRACTICAL).alias("bucket"), "framework")
    keys = ["workspace_id", "dimension", "bucket"]
    kept = near.unionByName(for_topic).distinct().withColumn("is_reserved", F.lit(True))
    filled = filled.join(kept, [*keys, "framework"], "left").withColumn("is_reserved", F.coalesce("is_reserved", F.lit(False)))
    pooled = asked.withColumn("pool", F.explode(F.array(F.concat(F.lit("region "), "region"), F.lit("tag")))).join(
        pools.filter(F.col("kind") == "reserve"), ["pool", "dimension"])
    weak = F.when(F.col("is_fragment"), 1000).otherwise(0)
    reserved = pooled.select("workspace_id", "dimension", *narrow).withColumn("rank", F.col("rank") + weak).withColumn(
        "slot", F.lit(0)).withColumn("is_reserved", F.lit(True))
    cap = F.create_map(*[F.lit(v) for pair in caps.items() for v in pair])[F.col("bucket")]
    done = retrieve.enforce_reserve(filled.select("workspace_id", "dimension", *narrow, "slot", "is_reserved"), reserved, cap, keys=keys)

    texts = first_per_key(pools.select("chunk_id", "text").unionByName(own.select("chunk_id", "text")), ["chunk_id"], ["text"])
    cut = F.substring("text", 1, retrieve.PROMPT_CHARS)
    return done.join(texts, "chunk_id").withColumn("text", cut).drop("is_fragment", "text_key")


def document_pool(doc_chunks: DataFrame, profiles: DataFrame, caps: dict[str, int]) -> DataFrame:
    found = retrieve.document_candidates(doc_chunks, profiles, caps["document"] * retrieve.DOCUMENT_HEADROOM, carry=("text", "framework"))
    return materialize(_keyed(found.withColumn("bucket", F.lit("document"))))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("is_fragment", tx.is_fragment(F.col("text"))).withColumn("text_key", F.md5(tx.text_key(F.col("text"))))


@dataclass
class Judged:
    gaps: DataFrame
    violations: DataFrame
    analytics: DataFrame
    summaries: DataFrame


def judge(spark: SparkSession, verdicts: DataFrame, doc_chunks: DataFrame, evidence: DataFrame,
          lexicon: lx.Lexicon = lx.DEFAULT) -> Judged:
    """Raw verdicts to final gaps and roll-ups.

    ``verdicts(workspace_id, dimension, ord, coverage, principle_acknowledged,
    mechanisms, recommendations, opportunities, synthesis, analysis_error)``;
    ``doc_chunks(workspace_id, dimension, chunk_id, text)``; ``evidence`` as
    ``rules.confidence`` reads it.
    """
    commitment = rules.commitment_evidence(doc_chunks, lexicon)
    counts = doc_chunks.groupBy("workspace_id", "dimension").agg(F.count("*").alias("doc_chunks"))
    laddered = rules.validate_coverage(verdicts, commitment, lexicon)
    shaped = rules.with_maturity(rules.shape_by_tier(rules.downgrade_drift(laddered, lexicon)), lexicon)
    risked = rules.with_risk_and_priority(shaped)
    scores = rules.confidence(evidence, risked).select("workspace_id", "dimension", "confidence_score", "confidence_method")
    sources = evidence.groupBy("workspace_id", "dimension").agg(
        F.count("*").alias("n_evidence"),
        F.count_if(F.coalesce("source", F.lit("unknown")) != "unknown").alias("n_named_evidence"),
    )
    keys = ["workspace_id", "dimension"]
    gaps = risked.join(scores, keys).join(sources, keys, "left").join(counts, keys, "left")
    for name in ("n_evidence", "n_named_evidence", "doc_chunks"):
        gaps = gaps.withColumn(name, F.coalesce(name, F.lit(0)))
    gaps = gaps.withColumn("n_positions", F.lit(0)).withColumn("recommendation", F.get("recommendations", F.lit(0)))
    gaps = cut_lineage(gaps)  # read by the checks, the penalty and the roll-ups
    found = consistency.violations(gaps, consistency.edge_table(spark), consistency.subset_table(spark), lexicon)
    final = consistency.apply_penalty(gaps, found)
    return Judged(final, found, analytics.decision_analytics(final), analytics.summaries(final))


def sync_store(log: LogTable, pages: DataFrame, catalog_files: DataFrame, roles: DataFrame) -> DataFrame:
    """Bring a store keyed by framework up to date and return the plan that was followed.

    ``catalog_files(name, checksum)`` says what there is now; ``pages`` and ``roles`` are those of
    ``sync_framework_chunks``.  Frameworks whose checksum stayed and that have chunks are not read; others are cut
    again, with one copy of each chunk for each role; frameworks that the catalog lost are removed.  All of it is one
    write of the log, which is seen as a whole or not at all.
    """
    heads, stored = log.heads(), log.read()
    if heads is None:
        heads = catalog_files.select(F.col("name").alias("framework"), F.col("checksum").alias("content_hash")).limit(0)
        counts = heads.select(F.col("framework").alias("name"), F.lit(0).cast("long").alias("chunk_count"))
    else:
        counts = stored.groupBy(F.col("framework").alias("name")).agg(F.count("*").alias("chunk_count"))
    before = heads.select(F.col("framework").alias("name"), F.col("content_hash").alias("checksum"))
    plan = materialize(catalog.sync_plan(catalog_files, before, counts))
    due = plan.filter(F.col("action") != "skip").select(F.col("name").alias("framework"), F.col("checksum").alias("content_hash"))
    lost = before.join(plan, "name", "left_anti").select(F.col("name").alias("framework"), F.lit(None).cast("string").alias("content_hash"))
    fresh = expand_roles(sync_framework_chunks(pages, plan, roles))
    # about one chunk for each page and each stride, one copy for each role: cheap to know, unlike the chunks themselves
    sizes = pages.groupBy("framework").agg(F.sum(1 + F.coalesce(F.length("text"), F.lit(0)) / (MAX_CHUNK - OVERLAP)).alias("n"))
    copies = sizes.join(due, "framework", "left_semi").join(roles, "framework")
    expect = copies.agg(F.coalesce(F.sum(F.size("roles") * F.col("n")), F.lit(0)).cast("long")).first()[0]
    log.put(fresh, due.unionByName(lost), expect=expect)
    return plan


def sync_framework_chunks(pages: DataFrame, plan: DataFrame, roles: DataFrame) -> DataFrame:
    """Re-chunk only the frameworks the sync plan does not skip.

    ``pages(doc_id, framework, page_number, text)``; ``roles(framework, roles)``.
    """
    due = plan.filter(F.col("action") != "skip").select(F.col("name").alias("framework"))
    wanted = pages.join(due, "framework", "left_semi")
    owners = first_per_key(wanted.select("doc_id", "framework"), ["doc_id"], ["framework"])
    chunks = ingest_pages(wanted.select("doc_id", "page_number", "text"), drop_foreign=True)
    return chunks.join(owners, "doc_id").join(roles, "framework", "left")
