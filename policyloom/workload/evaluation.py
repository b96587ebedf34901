"""Evidence graphs, requirement matching, retrieval quality and stability on the vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from policyloom.functions import text as tx
from policyloom.operators import evaluate as ev
from policyloom.operators import evidence as ed
from policyloom.operators import nearest as nn
from policyloom.workload import base as b
from policyloom.workload import retrieval as rq

BUDGET = 11


def _vectors(spark, sf):
    return b.read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
        F.col("label").alias("own_label"),
    )


def _evidence(spark, sf, k=BUDGET):
    """Retrieved evidence per label: the nearest vectors, with the text of the document of the same number."""
    texts = b.documents(spark, sf).select(
        F.col("doc_id").alias("chunk_id"), "text", "source"
    )
    hits = nn.nearest(_vectors(spark, sf), rq.label_centroids(spark, sf), k, query_keys=["label"], source="embedding",
                      stored_vectors=True, attach=["own_label", "embedding"])
    return hits.join(texts, "chunk_id", "left").select(
        F.col("label").cast("string").alias("dimension"), F.col("rank").alias("ord"), "rank", "chunk_id",
        F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source"),
        (F.col("own_label") == F.col("label")).alias("is_document"), F.col("embedding").alias("vector"),
        "similarity",
    )


def evidence_pairs(spark, sf):
    return ed.pair_agreement(_evidence(spark, sf), ["dimension"])


def evidence_pairs_by_words(spark, sf):
    return ed.pair_agreement(_evidence(spark, sf).drop("vector"), ["dimension"], vector=None)


def agreement_scores(spark, sf):
    """Agreement per label; sources stand for groups without evidence."""
    asked = b.read(spark, sf, "embeddings").select(F.col("label").cast("string").alias("dimension")).unionByName(
        b.documents(spark, sf).select(F.col("source").alias("dimension"))
    )
    return ed.agreement_score(evidence_pairs(spark, sf), ["dimension"], asked)


def evidence_items(spark, sf):
    """Documents first, short passages dropped, an id once."""
    lines = b.passages(spark, sf)
    given = lines.select("workspace_id", F.concat(F.lit("c"), F.pmod("line_no", F.lit(9)).cast("string")).alias("chunk_id"),
                         "text", F.col("line_no").alias("rank"), "doc_id")
    odd = F.pmod("doc_id", F.lit(2)) == 1
    flat = given.withColumn("rank", F.col("doc_id") * 10000 + F.col("rank"))
    items = ed.evidence_items(flat.filter(odd), flat.filter(~odd), ["workspace_id"])
    return items.select("workspace_id", "ord", "chunk_id", "is_document", F.length("text").alias("chars"))


def aspects(spark, sf):
    """Five aspects per label: the mean of the vectors of each fifth of its ids."""
    fifths = b.read(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("dimension"), F.pmod("vec_id", F.lit(5)).cast("int").alias("aspect_no"),
        F.col("embedding").alias("vector"),
    )
    return rq.mean_vectors(fifths, ["dimension", "aspect_no"], "vector").withColumn(
        "aspect", F.concat(F.lit("aspect "), F.col("aspect_no").cast("string"))
    )


def _labelled(spark, sf):
    return _vectors(spark, sf).select(
        "chunk_id", F.col("own_label").cast("string").alias("dimension"), F.col("embedding").alias("vector")
    )


def aspect_argmax(spark, sf):
    """Closest aspect of every vector of a label."""
    return ed.best_aspect(_labelled(spark, sf), aspects(spark, sf)).select("chunk_id", "dimension", "aspect", "relevance")


def near_duplicates(spark, sf):
    """Evidence merged greedily where vectors nearly agree."""
    merged = ed.merge_near_duplicates(_evidence(spark, sf).drop("rank"), ["dimension"], threshold=0.25)
    return merged.select("dimension", "ord", "chunk_id", "similarity", "merged")


def _grouped_items(spark, sf):
    texts = b.documents(spark, sf).select(F.col("doc_id").alias("chunk_id"), "text", "source", "lang")
    placed = ed.best_aspect(_labelled(spark, sf), aspects(spark, sf)).drop("vector")
    return placed.join(texts, "chunk_id").select(
        "dimension", "aspect", "relevance", "source", "text", "chunk_id",
        (F.col("lang") == "en").alias("verified"), (F.col("lang") != "fr").alias("is_document"),
        F.when(F.col("lang") == "es", 1.5).otherwise(0.5).alias("score"),
    )


def aspect_quality(spark, sf):
    return ed.group_quality(_grouped_items(spark, sf), ["dimension"])


def evidence_graph(spark, sf):
    """Quality of each label's evidence graph."""
    items = _grouped_items(spark, sf)
    groups = ed.group_quality(items, ["dimension"])
    totals = _vectors(spark, sf).groupBy(F.col("own_label").cast("string").alias("dimension")).agg(
        F.count("*").alias("before"), F.count_distinct(F.pmod("chunk_id", F.lit(4))).alias("sources")
    )
    # the languages are dimensions with aspects and without evidence
    others = b.documents(spark, sf).select(F.col("lang").alias("dimension"), F.col("source").alias("aspect")).distinct()
    listed = aspects(spark, sf).select("dimension", "aspect").unionByName(others)
    return ed.graph_quality(items, groups, listed, totals, ["dimension"])


def _requirements(spark, sf):
    """Farther half of the retrieved vectors as requirements, nearer half as evidence, some of it with equal texts."""
    found = _evidence(spark, sf, 20)
    required = found.filter(F.col("rank") > 10).select(
        "dimension", F.concat(F.lit("fw"), F.pmod("rank", F.lit(3)).cast("string")).alias("framework"),
        F.col("chunk_id").cast("string").alias("requirement"), "vector",
    )
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("strong", "explicit", "implicit", "weak", "policy")]),
                         F.pmod("rank", F.lit(5)) + 1)
    held = found.filter(F.col("rank") <= 10).select(
        "dimension", "ord", kinds.alias("kind"), F.concat(F.lit("t"), F.pmod("rank", F.lit(7)).cast("string")).alias("text"), "vector"
    )
    return required, ed.matched_evidence(held, ["dimension"])


def _matched(spark, sf):
    required, held = _requirements(spark, sf)
    return ed.match_requirements(required, held, ["dimension"], F.lit("Explicitly Addressed"))


def requirement_match(spark, sf):
    return _matched(spark, sf)


def requirement_rollup(spark, sf):
    return ed.requirement_rollup(_matched(spark, sf), ["dimension"])


def framework_differences(spark, sf):
    """Items met in some frameworks only; an item is the requirement's last digit."""
    digits = _matched(spark, sf).withColumn("requirement", F.right("requirement", F.lit(1)))
    return ed.framework_differences(digits, ["dimension"])


def framework_context(spark, sf):
    """Up to three passages per source and workspace."""
    hits = b.passages(spark, sf).select(
        "workspace_id", F.concat(F.lit("f"), F.pmod("line_no", F.lit(2)).cast("string")).alias("framework"),
        (F.col("doc_id") * 10000 + F.col("line_no")).alias("rank"), "chunk_id", "text",
    )
    done = ed.framework_context(hits, ["workspace_id"])
    return done.select("workspace_id", "framework", F.length("context").alias("chars"), F.md5("context").alias("digest"))


def framework_summary(spark, sf):
    """The passages of all frameworks of a workspace under their headers; workspaces without any are told so."""
    hits = b.passages(spark, sf).where("doc_id % 3 <> 0").select(
        "workspace_id", F.concat(F.lit("f"), F.pmod("line_no", F.lit(2)).cast("string")).alias("framework"),
        (F.col("doc_id") * 10000 + F.col("line_no")).alias("rank"), "chunk_id", "text",
    )
    asked = b.keyed_documents(spark, sf).select((F.col("doc_id") * 3).alias("workspace_id"))
    summary = ed.framework_summary(hits, ["workspace_id"], asked)
    return summary.select("workspace_id", F.length("summary").alias("chars"), F.md5("summary").alias("digest"))


def requirement_report(spark, sf):
    """Requirement lists by class, what goes beyond the frameworks, differences and the synthesis line of each label."""
    matched = _matched(spark, sf).withColumn("ord", F.col("requirement").cast("int"))
    strong = _evidence(spark, sf, 20).groupBy("dimension").agg(F.count_if(F.col("rank") > 12).alias("strong_count"))
    done = ed.requirement_report(matched, strong, ["dimension"], F.lit("Strongly Operationalised"))
    joined = lambda c: F.array_join(c, "|").alias(c)
    return done.select(
        "dimension", *map(joined, ("implemented", "partial", "missing", "beyond", "existing_mechanisms", "universal", "differences")), "synthesis",
        F.to_json("framework_specific").alias("framework_specific"),
    )


def graph_factors(spark, sf):
    """The parts that an evidence graph's quality is made of."""
    items = _grouped_items(spark, sf)
    return ed.quality_factors(items, ed.group_quality(items, ["dimension"]), aspects(spark, sf), ["dimension"])


def group_claims(spark, sf):
    """What the first three texts of each aspect say together."""
    items = _grouped_items(spark, sf).withColumn("ord", F.col("chunk_id"))
    return ed.group_claims(items, ["dimension", "aspect"]).select("dimension", "aspect", F.length("claim").alias("chars"), F.md5("claim").alias("digest"))


def _ranked(spark, sf, k=10):
    return rq.knn_hits(spark, sf, k, carry=["own_label"]).withColumn("label", F.col("label").cast("string"))


def _qrels(spark, sf):
    """Vectors of the label are relevant; their gain is 1 to 3 by id."""
    return b.read(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("label"), F.col("vec_id").alias("chunk_id"),
        (F.pmod("vec_id", F.lit(3)) + 1).cast("double").alias("gain"),
    )


def retrieval_metrics(spark, sf):
    """Metrics per label; the sources are queries that found nothing."""
    silent = b.documents(spark, sf).select(F.col("source").alias("label")).distinct()
    return ev.ranking_metrics(_ranked(spark, sf), _qrels(spark, sf), ["label"], silent)


def result_quality(spark, sf):
    hits = rq.hybrid_hits(spark, sf, 10)
    return ev.result_quality(hits, ["dimension"])


def retrieval_report(spark, sf):
    """Accuracy by kind of source over uploaded documents and frameworks together, and recall over labelled documents."""
    corpus = rq.uploaded_corpus(spark, sf)
    hits = nn.retrieve(corpus, b.definitions(spark), 20, query_keys=["dimension"], carry=["framework", "document_name"])
    dims = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(b.DIMS)])
    number = F.substring("name", 4, 10).cast("int")
    named = b.documents(spark, sf).select(F.col("source").alias("name")).distinct().withColumn("x", F.explode(dims))
    expected = named.where(F.pmod(number + F.col("x.i"), F.lit(2)) == 0).select(
        F.col("x.d").alias("dimension"), F.when(F.pmod(number, F.lit(5)) == 4, "policy").otherwise("framework").alias("kind"), "name")
    keyed = b.keyed_documents(spark, sf).select("dimension", F.col("doc_id").alias("chunk_id"))
    labels = b.read(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("chunk_id"))
    recall = ev.coverage_recall(keyed.join(labels, "chunk_id"), keyed.groupBy("dimension").agg(F.count("*").alias("total")), ["dimension"])
    return ev.source_accuracy(hits, expected, ["dimension"]).join(recall, "dimension")


def error_rates(spark, sf):
    """False positives and negatives of each label's first ten, and of a label with none."""
    ranked = _ranked(spark, sf)
    wrong = ranked.groupBy("label").agg(
        F.count("*").alias("total_retrieved"), F.count_if(F.col("own_label").cast("string") != F.col("label")).alias("false_positives")
    )
    relevant = _qrels(spark, sf).groupBy("label").agg(F.count("*").alias("relevant"))
    joined = wrong.join(relevant, "label").withColumn(
        "false_negatives", F.col("relevant") - F.col("total_retrieved") + F.col("false_positives")
    )
    return ev.error_rates(joined, ["label"])


def _runs(spark, sf):
    """Three runs: the nearest ten, the nearest ten of even ids, and of odd ids first."""
    runs = None
    for i, keep in enumerate((F.lit(True), F.pmod("chunk_id", F.lit(2)) == 0, F.pmod("chunk_id", F.lit(3)) != 0)):
        vectors = _vectors(spark, sf).filter(keep)
        hits = nn.nearest(vectors, rq.label_centroids(spark, sf), 10, query_keys=["label"], source="embedding", stored_vectors=True)
        run = hits.select("label", F.lit(i).alias("run"), "rank", "chunk_id", F.col("similarity").alias("score"))
        runs = run if runs is None else runs.unionByName(run)
    return runs


def rank_stability(spark, sf):
    return ev.run_stability(_runs(spark, sf), ["label"])


def config_comparison(spark, sf):
    """Macro averages of dense and hybrid retrieval; the first three dense hits are relevant."""
    corpus = b.embedded_corpus(spark, sf)

    def dense(asked):
        return nn.retrieve(corpus, asked, 10, query_keys=["dimension"], hybrid=False).select("dimension", "rank", "chunk_id")

    def hybrid(asked):
        return nn.retrieve(corpus, asked, 10, query_keys=["dimension"]).select("dimension", "rank", "chunk_id")

    asked = b.definitions(spark)
    qrels = ev.qrels_by_first(dense(asked), ["dimension"])
    _, averages = ev.compare_configs(asked, {"dense": dense, "hybrid": hybrid}, qrels, ["dimension"])
    return averages


QUERIES = {f.__name__: f for f in (
    evidence_pairs, evidence_pairs_by_words, agreement_scores, evidence_items, aspect_argmax, near_duplicates, aspect_quality,
    evidence_graph, requirement_match, requirement_rollup, framework_differences, framework_context, retrieval_metrics,
    result_quality, retrieval_report, framework_summary, requirement_report, graph_factors, group_claims, error_rates, rank_stability, config_comparison,
)}


# -- SQL ---------------------------------------------------------------------

_EV_SQL = f"""{rq._KNN_SQL},
ev AS (
  SELECT r.label::VARCHAR AS dimension, rank, r.vec_id AS chunk_id, coalesce(text, '') AS text,
         coalesce(source, '') AS source, own_label = label AS is_document, similarity, e.embedding::DOUBLE[] AS vec
  FROM ranked r JOIN (SELECT vec_id, embedding FROM embeddings) e USING (vec_id) LEFT JOIN documents d ON d.doc_id = r.vec_id)"""

_NEG_A, _NEG_B = (b.any_sql(t, b.lx.PAIR_NEGATIONS) for t in ("ta", "tb"))


def _pairs_sql(similarity: str) -> str:
    return f"""{_EV_SQL},
pr AS (
  SELECT a.dimension, a.chunk_id AS item_a, b.chunk_id AS item_b, lower(a.text) AS ta, lower(b.text) AS tb,
         a.is_document AS da, b.is_document AS db, a.source AS sa, b.source AS sb, a.vec AS va, b.vec AS vb
  FROM ev a JOIN ev b ON a.dimension = b.dimension AND a.rank < b.rank WHERE a.rank <= {BUDGET} AND b.rank <= {BUDGET}),
ps AS (SELECT *, round({similarity}, 6) AS s FROM pr),
pj AS (
  SELECT *, CASE WHEN ta = tb THEN 'duplicate' WHEN s >= 0.75 AND {_NEG_A} <> {_NEG_B} THEN 'conflicting'
    WHEN s >= 0.75 AND da = db AND sa = sb THEN 'duplicate' WHEN s >= 0.75 THEN 'supporting'
    WHEN s >= 0.4 THEN 'independent' ELSE 'weak' END AS agreement, CASE WHEN ta = tb THEN 1.0::DOUBLE ELSE round(s, 3) END AS score
  FROM ps WHERE ta = tb OR least(length(ta), length(tb)) >= 30)"""


_DOT = "list_dot_product(va, vb)"
_WORDS = (
    "coalesce(len(list_intersect({a}, {c}))::DOUBLE / nullif(len(list_distinct(list_concat({a}, {c}))), 0), 0)".format(
        a="list_distinct(" + b.tokens_sql(b.strip_sql("ta")) + ")", c="list_distinct(" + b.tokens_sql(b.strip_sql("tb")) + ")")
)

_ASPECT_SQL = """e AS (
  SELECT vec_id, label, vec_id % 5 AS ano, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
am AS (SELECT label, ano, i, avg(x) AS m FROM e GROUP BY ALL),
an AS (SELECT label, ano, sqrt(sum(m * m)) AS norm FROM am GROUP BY ALL),
en AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM e GROUP BY 1),
sc AS (
  SELECT e.vec_id, e.label, am.ano, round(sum(x * m) / (any_value(en.norm) * any_value(an.norm)), 6) AS s
  FROM e JOIN am ON am.label = e.label AND am.i = e.i JOIN en ON en.vec_id = e.vec_id JOIN an ON an.label = am.label AND an.ano = am.ano
  GROUP BY ALL),
ba AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, ano) = 1),
placed AS (
  SELECT vec_id AS chunk_id, label::VARCHAR AS dimension, 'aspect ' || CASE WHEN s >= 0.35 THEN ano ELSE
    (SELECT min(ano) FROM an WHERE an.label = ba.label) END AS aspect, CASE WHEN s >= 0.35 THEN s ELSE 0 END AS relevance FROM ba)"""

_QUALITY_SQL = _ASPECT_SQL + """,
it AS (
  SELECT p.*, d.text, d.source, lang = 'en' AS verified, lang <> 'fr' AS is_document, CASE WHEN lang = 'es' THEN 1.5 ELSE 0.5 END AS score
  FROM placed p JOIN documents d ON d.doc_id = p.chunk_id),
gq AS (
  SELECT dimension, aspect, count(*) AS evidence_count, round(least(1.0::DOUBLE, round(
    coalesce(avg(CASE WHEN relevance > 0 THEN relevance END), 0.0) * 0.4::DOUBLE + CASE WHEN count(DISTINCT source) > 1 THEN 0.2::DOUBLE ELSE 0 END
    + CASE WHEN bool_or(verified) THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN max(score) > 1 THEN 0.15::DOUBLE ELSE 0 END
    + least(1.0::DOUBLE, sum(length(text))::DOUBLE / 5000) * CASE WHEN max(score) > 1 THEN 0.15::DOUBLE ELSE 0.3::DOUBLE END, 9)), 3) AS coverage_quality
  FROM it GROUP BY ALL)"""

_MATCH_SQL = f"""{_EV_SQL},
rq AS (SELECT dimension, 'fw' || (rank % 3) AS framework, chunk_id::VARCHAR AS requirement, vec FROM ev WHERE rank > 10 AND rank <= 20),
hd AS (SELECT dimension, rank % 5 AS k, vec FROM ev WHERE rank <= 10
  QUALIFY row_number() OVER (PARTITION BY dimension, rank % 7 ORDER BY rank % 5, rank) = 1),
cr AS (SELECT rq.dimension, framework, requirement, k, round(list_dot_product(rq.vec, hd.vec), 6) AS s FROM rq JOIN hd USING (dimension)),
ag AS (
  SELECT dimension, framework, requirement, greatest(0.0::DOUBLE, max(s)) AS max_sim,
         greatest(0.0::DOUBLE, coalesce(max(s) FILTER (k <= 1), 0)) AS explicit_sim,
         greatest(0.0::DOUBLE, coalesce(max(s) FILTER (k = 2), 0)) AS implicit_sim,
         count(*) FILTER (s > 0.35) AS corroboration FROM cr GROUP BY ALL),
ma AS (
  SELECT *, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, max_sim * 0.35::DOUBLE + explicit_sim * 0.25::DOUBLE + implicit_sim * 0.10::DOUBLE
    + least(corroboration / 4.0::DOUBLE, 1.0) * 0.15::DOUBLE + (1.1::DOUBLE - 0.5) * 0.15::DOUBLE)), 6) AS match_score FROM ag),
mc AS (SELECT *, CASE WHEN match_score >= 0.6 THEN 'implemented' WHEN match_score >= 0.35 THEN 'partial' ELSE 'missing' END AS match_class FROM ma)"""

_QRELS_SQL = "qr AS (SELECT label, vec_id, (vec_id % 3 + 1)::DOUBLE AS gain FROM embeddings)"


def _metrics_sql(ranked: str, qrels: str, key: str, chunk: str) -> str:
    """Metric columns from ``ranked(key, rank, chunk)`` and ``qrels(key, chunk, gain)``."""
    hit = f"{qrels}.gain IS NOT NULL"
    disc = "CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE log2(rank::DOUBLE) END"
    cols = [f"count(*) FILTER (rank <= {k} AND {hit}) AS h{k}, count(*) FILTER (rank <= {k}) AS n{k}" for k in (1, 3, 5, 10)]
    cols += [f"sum(CASE WHEN rank <= {k} AND {hit} THEN {qrels}.gain / ({disc}) ELSE 0.0 END) AS d{k}" for k in (5, 10)]
    return f"""mj AS (
  SELECT r.{key}, {', '.join(cols)}, min(CASE WHEN {hit} THEN rank END) AS first
  FROM {ranked} r LEFT JOIN {qrels} ON {qrels}.{key} = r.{key} AND {qrels}.{chunk} = r.{chunk} GROUP BY r.{key}),
ig AS (
  SELECT {key}, gain, row_number() OVER (PARTITION BY {key} ORDER BY gain DESC) AS p, count(*) OVER (PARTITION BY {key}) AS rel FROM {qrels}),
idl AS (
  SELECT {key}, any_value(rel) AS rel, {', '.join(f"sum(CASE WHEN p <= {k} THEN gain / (CASE WHEN p = 1 THEN 1.0::DOUBLE ELSE log2(p::DOUBLE) END) ELSE 0.0 END) AS i{k}" for k in (5, 10))}
  FROM ig GROUP BY {key}),
met AS (
  SELECT {key}, {', '.join(f"CASE WHEN n{k} > 0 THEN round(h{k}::DOUBLE / n{k}, 6) ELSE 0 END AS precision_at_{k}" for k in (1, 3, 5, 10))},
         {', '.join(f"CASE WHEN coalesce(rel, 0) > 0 THEN round(h{k}::DOUBLE / rel, 6) ELSE 0 END AS recall_at_{k}" for k in (3, 5, 10))},
         coalesce(round(1.0::DOUBLE / first, 6), 0) AS mrr,
         {', '.join(f"CASE WHEN coalesce(i{k}, 0) > 0 THEN round(d{k} / i{k}, 6) ELSE 0 END AS ndcg_at_{k}" for k in (5, 10))}
  FROM mj LEFT JOIN idl USING ({key}))"""


def _config_part(name: str, source: str) -> str:
    body = _metrics_sql(source, "cq", "dimension", "chunk_id")
    for cte in ("mj", "ig", "idl", "met"):
        body = body.replace(f"{cte} AS (", f"{cte}_{name} AS (")
    return body.replace("FROM ig ", f"FROM ig_{name} ").replace("FROM mj LEFT JOIN idl", f"FROM mj_{name} LEFT JOIN idl_{name}")


_MEASURES = [f"precision_at_{k}" for k in (1, 3, 5, 10)] + [f"recall_at_{k}" for k in (3, 5, 10)] + ["mrr", "ndcg_at_5", "ndcg_at_10"]

ORACLE = {
    "evidence_pairs": f"WITH {_pairs_sql(_DOT)} SELECT dimension, item_a, item_b, agreement, score FROM pj",
    "evidence_pairs_by_words": f"WITH {_pairs_sql(_WORDS)} SELECT dimension, item_a, item_b, agreement, score FROM pj",
    "agreement_scores": f"""WITH {_pairs_sql(_DOT)},
sc AS (SELECT dimension, round(round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (avg(CASE agreement WHEN 'supporting' THEN score WHEN 'conflicting' THEN -score
  WHEN 'duplicate' THEN 0.5::DOUBLE WHEN 'independent' THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END) + 1) / 2)), 9), 3) AS agreement, count(*) AS pairs
FROM pj GROUP BY dimension),
asked AS (SELECT label::VARCHAR AS dimension FROM embeddings UNION SELECT source FROM documents)
SELECT dimension, coalesce(agreement, 1.0::DOUBLE) AS agreement, coalesce(pairs, 0) AS pairs FROM asked LEFT JOIN sc USING (dimension)""",
    "near_duplicates": f"""WITH RECURSIVE {_EV_SQL},
items AS (SELECT dimension, rank AS ord, chunk_id, text, similarity, vec FROM ev WHERE rank <= {BUDGET}),
lists AS (SELECT dimension, list({{'ord': ord, 'vec': vec}} ORDER BY ord) AS xs FROM items GROUP BY dimension),
f AS (
  SELECT dimension, xs, 1 AS i, []::BIGINT[] AS leads, []::BIGINT[] AS own FROM lists
  UNION ALL
  SELECT dimension, xs, i + 1, CASE WHEN lead IS NULL THEN list_append(leads, i) ELSE leads END, list_append(own, coalesce(lead, i))
  FROM (
    SELECT *, list_filter(leads, lambda k: round(list_cosine_similarity(xs[k].vec, xs[i].vec), 6) >= 0.25)[1] AS lead FROM f WHERE i <= len(xs))),
done AS (SELECT dimension, xs, own FROM f WHERE i > len(xs)),
placed AS (SELECT dimension, unnest(range(1, len(own) + 1)) AS k, unnest(own) AS lead, xs FROM done),
named AS (SELECT dimension, xs[k].ord AS ord, xs[lead].ord AS lead FROM placed)
SELECT n.dimension, lead AS ord, arg_max(chunk_id, [length(text), -i.ord]) AS chunk_id, max(similarity) AS similarity, count(*)::INT AS merged
FROM named n JOIN items i ON i.dimension = n.dimension AND i.ord = n.ord GROUP BY n.dimension, lead""",
    "evidence_items": f"""WITH {b.PASSAGES_SQL},
i AS (
  SELECT workspace_id, 'c' || (line_no % 9) AS chunk_id, {b.strip_sql('text')} AS text, doc_id % 2 = 1 AS is_document,
         doc_id * 10000 + line_no AS rank FROM passages),
u AS (SELECT * FROM i WHERE length(text) >= 30 QUALIFY row_number() OVER (PARTITION BY workspace_id, chunk_id ORDER BY NOT is_document, rank) = 1)
SELECT workspace_id, row_number() OVER (PARTITION BY workspace_id ORDER BY NOT is_document, rank) AS ord, chunk_id, is_document,
       length(text) AS chars FROM u""",
    "aspect_argmax": f"WITH {_ASPECT_SQL} SELECT chunk_id, dimension, aspect, relevance FROM placed",
    "aspect_quality": f"""WITH {_QUALITY_SQL}
SELECT dimension, aspect, coverage_quality, evidence_count, CASE WHEN coverage_quality >= 0.7 THEN 'covered' WHEN coverage_quality >= 0.35 THEN 'partial'
       ELSE 'weak' END AS coverage_estimate FROM gq""",
    "evidence_graph": f"""WITH {_QUALITY_SQL},
al AS (SELECT label::VARCHAR AS dimension, list('aspect ' || ano) AS every, count(*) AS n FROM an GROUP BY 1),
g AS (SELECT dimension, avg(coverage_quality) AS q, count(*) AS k, count(*) FILTER (coverage_quality >= 0.35) AS c, list(aspect) AS have FROM gq GROUP BY 1),
s AS (SELECT dimension, count(DISTINCT CASE WHEN is_document THEN source END) AS sd, count(DISTINCT CASE WHEN NOT is_document THEN source END) AS sf,
  count(DISTINCT source) AS sa, max(score) > 1 AS rr, count(*) AS aft FROM it GROUP BY 1),
t AS (SELECT label::VARCHAR AS dimension, count(*) AS bef, count(DISTINCT vec_id % 4) AS src FROM embeddings GROUP BY 1)
SELECT dimension, round(least(1.0::DOUBLE, round(q * 0.5::DOUBLE + k::DOUBLE / n * 0.25::DOUBLE + least(0.15::DOUBLE, (sd + sf) * 0.03::DOUBLE) * 0.1::DOUBLE
  + least(0.1::DOUBLE, sa * 0.02::DOUBLE) * 0.1::DOUBLE + CASE WHEN rr THEN 0.05::DOUBLE ELSE 0 END * 0.05::DOUBLE, 9)), 3) AS evidence_quality_score,
  round(least(1.0::DOUBLE, src / 5.0::DOUBLE), 3) AS source_diversity, round(1 - aft::DOUBLE / bef, 3) AS redundancy_ratio,
  round(c::DOUBLE / n, 3) AS coverage_completeness,
  coalesce(array_to_string(list_sort(list_filter(every, lambda x: NOT list_contains(have, x))), '; '), '') AS missing_aspects
FROM g JOIN s USING (dimension) JOIN t USING (dimension) JOIN al USING (dimension)
UNION ALL SELECT lang, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, array_to_string(list_sort(list(DISTINCT source)), '; ') FROM documents GROUP BY lang""",
    "requirement_match": f"""WITH {_MATCH_SQL}
SELECT dimension, framework, requirement, max_sim, explicit_sim, implicit_sim, corroboration, match_score, match_class FROM mc""",
    "requirement_rollup": f"""WITH {_MATCH_SQL}
SELECT dimension, count(*) FILTER (match_class = 'implemented') AS implemented, count(*) FILTER (match_class = 'partial') AS partial,
       count(*) FILTER (match_class = 'missing') AS missing, count(DISTINCT framework) AS frameworks FROM mc GROUP BY 1""",
    "framework_differences": f"""WITH {_MATCH_SQL},
d AS (SELECT DISTINCT dimension, right(requirement, 1) AS item, framework FROM mc WHERE match_class <> 'missing'),
n AS (SELECT dimension, count(DISTINCT framework) AS n FROM mc GROUP BY 1)
SELECT dimension, item, string_agg(framework, ', ' ORDER BY framework) AS frameworks FROM d JOIN n USING (dimension)
GROUP BY dimension, item HAVING max(n) > 1 AND count(*) < max(n)""",
    "framework_context": f"""WITH {b.PASSAGES_SQL},
t AS (SELECT workspace_id, 'f' || (line_no % 2) AS framework, doc_id * 10000 + line_no AS r, text FROM passages),
k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY workspace_id, framework ORDER BY r) <= 3),
c AS (SELECT workspace_id, framework, substr(string_agg(substr(text, 1, 600), chr(10) ORDER BY r), 1, 2000) AS ctx FROM k GROUP BY ALL)
SELECT workspace_id, framework, length(ctx) AS chars, md5(ctx) AS digest FROM c""",
    "framework_summary": f"""WITH {b.PASSAGES_SQL},
t AS (SELECT workspace_id, 'f' || (line_no % 2) AS framework, doc_id * 10000 + line_no AS r, text FROM passages WHERE doc_id % 3 <> 0),
k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY workspace_id, framework ORDER BY r) <= 3),
c AS (
  SELECT workspace_id, framework, min(r) AS f, '[Framework: ' || framework || ']' || chr(10) || substr(string_agg(substr(text, 1, 600), chr(10) ORDER BY r), 1, 2000) AS block
  FROM k GROUP BY workspace_id, framework),
s AS (SELECT workspace_id, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY f) AS summary FROM c GROUP BY 1),
a AS (SELECT DISTINCT doc_id * 3 AS workspace_id FROM documents),
o AS (SELECT workspace_id, coalesce(summary, '{ed.NO_FRAMEWORKS}') AS summary FROM a LEFT JOIN s USING (workspace_id))
SELECT workspace_id, length(summary)::INT AS chars, md5(summary) AS digest FROM o""",
    "requirement_report": f"""WITH {_MATCH_SQL},
m AS (SELECT *, requirement::INT AS o FROM mc),
strong AS (SELECT dimension, count(*) FILTER (rank > 12 AND rank <= 20) AS k FROM ev GROUP BY 1),
l AS (
  SELECT dimension, coalesce(list(requirement ORDER BY framework, o) FILTER (match_class = 'implemented'), []) AS imp,
         coalesce(list(requirement ORDER BY framework, o) FILTER (match_class = 'partial'), []) AS par,
         coalesce(list(requirement ORDER BY framework, o) FILTER (match_class = 'missing'), []) AS mis, list_sort(list(DISTINCT requirement)) AS uni
  FROM m GROUP BY 1),
pf AS (
  SELECT dimension, framework, coalesce(list('"' || requirement || '"' ORDER BY match_class <> 'implemented', o) FILTER (match_class <> 'missing'), []) AS items
  FROM m GROUP BY ALL),
fs AS (SELECT dimension, '{{' || string_agg('"' || framework || '":[' || array_to_string(items, ',') || ']', ',' ORDER BY framework) || '}}' AS spec, count(*) AS nf FROM pf GROUP BY 1),
met AS (SELECT DISTINCT dimension, requirement AS item, framework FROM m WHERE match_class <> 'missing'),
di AS (SELECT dimension, item, string_agg(framework, ', ' ORDER BY framework) AS fw, count(*) AS n FROM met GROUP BY ALL),
df AS (SELECT dimension, string_agg(chr(39) || item || chr(39) || ' mentioned in ' || fw || ' but not others', '|' ORDER BY item) AS diffs FROM di JOIN fs USING (dimension) WHERE nf > 1 AND n < nf GROUP BY 1),
x AS (
  SELECT l.*, spec, coalesce(diffs, '') AS diffs,
    CASE WHEN k > 1 AND k > len(imp) THEN ['Policy exceeds framework expectations on ' || (k - len(imp)) || ' mechanism(s)'] ELSE [] END AS beyond
  FROM l JOIN fs USING (dimension) JOIN strong USING (dimension) LEFT JOIN df USING (dimension))
SELECT dimension, array_to_string(imp, '|') AS implemented, array_to_string(par, '|') AS partial, array_to_string(mis, '|') AS missing, array_to_string(beyond, '|') AS beyond,
  array_to_string(list_concat(imp, beyond), '|') AS existing_mechanisms, array_to_string(uni, '|') AS universal, diffs AS differences,
  concat_ws(' | ', 'Framework comparison for ' || dimension || ':',
    CASE WHEN len(imp) > 0 THEN 'Already implemented (' || len(imp) || '): ' || array_to_string(imp[1:5], '; ') END,
    CASE WHEN len(par) > 0 THEN 'Partially implemented (' || len(par) || '): ' || array_to_string(par[1:5], '; ') END,
    CASE WHEN len(mis) > 0 THEN 'Missing (' || len(mis) || '): ' || array_to_string(mis[1:5], '; ') END,
    CASE WHEN len(beyond) > 0 THEN 'Beyond framework expectations: ' || array_to_string(beyond, '; ') END) AS synthesis, spec AS framework_specific
FROM x""",
    "graph_factors": f"""WITH {_QUALITY_SQL},
g AS (SELECT dimension, round(round(avg(coverage_quality), 9), 3) AS avg_group_quality, count(*) AS k FROM gq GROUP BY 1),
al AS (SELECT label::VARCHAR AS dimension, count(DISTINCT vec_id % 5) AS n FROM embeddings GROUP BY 1),
s AS (
  SELECT dimension, count(DISTINCT source) FILTER (is_document) + count(DISTINCT source) FILTER (NOT is_document) AS t, count(DISTINCT source) AS d, max(score) > 1 AS r FROM it GROUP BY 1)
SELECT dimension, avg_group_quality, round(round(k::DOUBLE / n, 9), 3) AS coverage_ratio, round(least(0.15::DOUBLE, t * 0.03::DOUBLE), 3) AS source_bonus,
       round(least(0.1::DOUBLE, d * 0.02::DOUBLE), 3) AS diversity_bonus, CASE WHEN r THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS reranker_bonus
FROM g JOIN al USING (dimension) JOIN s USING (dimension)""",
    "group_claims": f"""WITH {_QUALITY_SQL},
k AS (SELECT * FROM it QUALIFY row_number() OVER (PARTITION BY dimension, aspect ORDER BY chunk_id) <= 3),
c AS (SELECT dimension, aspect, string_agg(text, ' ' ORDER BY chunk_id) AS w FROM k GROUP BY ALL),
o AS (SELECT dimension, aspect, CASE WHEN length(w) > 800 THEN substr(w, 1, 800) || '...' ELSE w END AS claim FROM c)
SELECT dimension, aspect, length(claim)::INT AS chars, md5(claim) AS digest FROM o""",
    "retrieval_metrics": f"""WITH {rq._KNN_SQL}, {_QRELS_SQL}, top AS (SELECT * FROM ranked WHERE rank <= 10),
{_metrics_sql('top', 'qr', 'label', 'vec_id')} SELECT * REPLACE (label::VARCHAR AS label) FROM met
UNION ALL SELECT DISTINCT source, {', '.join(['0'] * len(_MEASURES))} FROM documents""",
    "result_quality": f"""WITH {rq._CORPUS_DEFS}, {rq.hybrid_sql('f_sims', rq._ROLES.format(b.lx.PRACTICAL), 50, 10, 'h')}
SELECT dimension, count(*) AS returned, round(count(DISTINCT framework)::DOUBLE / count(*), 6) AS evidence_diversity,
       round((count(*) - count(DISTINCT text))::DOUBLE / count(*), 6) AS duplicate_rate,
       round(round(avg(similarity), 9), 6) AS avg_retrieval_similarity FROM h GROUP BY dimension""",
    "retrieval_report": f"""WITH {b.PROFILE_SQL}, {rq._DEFINITIONS_SQL}, {rq._UPLOADED_SQL}, {rq.sims_sql('up', 'defs', 'dimension', 'f')},
{rq.hybrid_sql('f_sims', 'true', 60, 20, 'h')},
dims(dimension, i) AS (VALUES {b.values((d, i) for i, d in enumerate(b.DIMS))}),
m AS (SELECT h.dimension, framework <> '' AS fw, (n + i) % 2 = 0 AS meant FROM h JOIN dims USING (dimension)),
acc AS (
  SELECT dimension, coalesce(round(count(*) FILTER (fw AND meant)::DOUBLE / nullif(count(*) FILTER (fw), 0), 6), 0.0) AS framework_retrieval_accuracy,
         coalesce(round(count(*) FILTER (NOT fw AND meant)::DOUBLE / nullif(count(*) FILTER (NOT fw), 0), 6), 0.0) AS policy_retrieval_accuracy FROM m GROUP BY 1),
{b.KEYED_SQL},
rec AS (
  SELECT dimension, round(count(DISTINCT CASE WHEN quality = 1 THEN k.doc_id END)::DOUBLE / count(DISTINCT k.doc_id), 6) AS coverage_recall
  FROM keyed k LEFT JOIN labels l ON l.doc_id = k.doc_id GROUP BY 1)
SELECT dimension, framework_retrieval_accuracy, policy_retrieval_accuracy, coverage_recall FROM acc JOIN rec USING (dimension)""",
    "error_rates": f"""WITH {rq._KNN_SQL},
w AS (SELECT label, count(*) AS t, count(*) FILTER (own_label <> label) AS fp FROM ranked WHERE rank <= 10 GROUP BY 1),
r AS (SELECT label, count(*) AS rel FROM embeddings GROUP BY 1),
x AS (SELECT label, t, fp, rel, rel - t + fp AS fn FROM w JOIN r USING (label))
SELECT label::VARCHAR AS label, round(CASE WHEN fp + fn > 0 THEN fp::DOUBLE / (fp + fn) WHEN t > 0 THEN fp::DOUBLE / greatest(t - rel, 1) ELSE 0 END, 6) AS false_positive_rate,
       round(CASE WHEN fp + fn > 0 THEN fn::DOUBLE / (fp + fn) WHEN t > 0 THEN fn::DOUBLE / greatest(rel, 1) ELSE 0 END, 6) AS false_negative_rate FROM x""",
    "rank_stability": f"""WITH {rq._KNN_SQL},
runs AS (
  SELECT label, 0 AS run, vec_id, similarity, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank FROM sims
  UNION ALL SELECT label, 1, vec_id, similarity, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) FROM sims WHERE vec_id % 2 = 0
  UNION ALL SELECT label, 2, vec_id, similarity, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) FROM sims WHERE vec_id % 3 <> 0),
t AS (SELECT * FROM runs WHERE rank <= 10),
pairs AS (SELECT DISTINCT a.label, a.run AS r1, c.run AS r2 FROM t a JOIN t c ON a.label = c.label AND a.run < c.run),
com AS (SELECT p.label, r1, r2, a.vec_id, a.rank AS ra, c.rank AS rc FROM pairs p JOIN t a ON a.label = p.label AND a.run = r1
        JOIN t c ON c.label = p.label AND c.run = r2 AND c.vec_id = a.vec_id),
cnt AS (SELECT label, r1, r2, count(*) AS n FROM com GROUP BY ALL),
tau AS (SELECT x.label, x.r1, x.r2, avg(sign((x.ra - y.ra) * (x.rc - y.rc))) AS tau FROM com x JOIN com y
        ON x.label = y.label AND x.r1 = y.r1 AND x.r2 = y.r2 AND x.vec_id < y.vec_id GROUP BY ALL),
sz AS (SELECT label, run, count(*) AS n FROM t GROUP BY ALL),
jac AS (SELECT p.label, p.r1, p.r2, coalesce(c.n, 0)::DOUBLE / (s1.n + s2.n - coalesce(c.n, 0)) AS j, coalesce(tau, 0) AS tau
        FROM pairs p JOIN sz s1 ON s1.label = p.label AND s1.run = p.r1 JOIN sz s2 ON s2.label = p.label AND s2.run = p.r2
        LEFT JOIN cnt c ON c.label = p.label AND c.r1 = p.r1 AND c.r2 = p.r2 LEFT JOIN tau u ON u.label = p.label AND u.r1 = p.r1 AND u.r2 = p.r2),
m AS (SELECT label, avg(j) AS j, avg(tau) AS tau FROM jac GROUP BY 1)
SELECT label, count(DISTINCT run) AS num_retrievals, round(any_value(j), 4) AS jaccard_similarity, round(any_value(tau), 4) AS kendall_tau,
       round((any_value(j) + any_value(tau)) / 2, 4) AS semantic_stability, round(var_pop(similarity), 4) AS score_variance,
       any_value(j) >= 0.5 AS is_stable FROM t JOIN m USING (label) GROUP BY label""",
    "config_comparison": f"""WITH {rq._CORPUS_DEFS},
dn AS (SELECT * FROM (SELECT dimension, chunk_id, row_number() OVER (PARTITION BY dimension ORDER BY similarity DESC, chunk_id) AS rank FROM f_sims) WHERE rank <= 10),
{rq.hybrid_sql('f_sims', 'true', 30, 10, 'hy')},
cq AS (SELECT dimension, chunk_id, 2.0::DOUBLE AS gain FROM dn WHERE rank <= 3),
{_config_part('d', 'dn')}, {_config_part('h', 'hy')}
SELECT 'dense' AS config, {', '.join(f'round(round(avg({m}), 9), 4) AS {m}' for m in _MEASURES)} FROM met_d
UNION ALL SELECT 'hybrid', {', '.join(f'round(round(avg({m}), 9), 4)' for m in _MEASURES)} FROM met_h""",
}
