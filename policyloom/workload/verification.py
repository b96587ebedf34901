"""Citations, agencies and replies checked against the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from policyloom import lexicons as lx
from policyloom.functions import text as tx
from policyloom.operators import agency, analytics, conversations
from policyloom.operators import nearest as nn
from policyloom.operators import verify as vf
from policyloom.workload import base as b
from policyloom.workload import retrieval as rq

KEYS = ["workspace_id", "dimension"]
AGENCY_WORDS = ("license", "apache")


def store(spark, sf):
    """Documents as stored chunks with string ids and vectors."""
    return b.embedded_corpus(spark, sf).select(
        F.col("chunk_id").cast("string").alias("chunk_id"), "text", "embedding",
        F.pmod(F.length("text"), F.lit(5)).cast("int").alias("page_number"),
        F.when(F.col("lang") == "en", F.col("framework")).otherwise("").alias("framework"),
        F.concat(F.lit("doc "), F.col("framework")).alias("document_name"), "roles",
    )


def citations(spark, sf):
    """One citation per document: its own text, or a benchmark claim; some ids are unknown."""
    items = b.read(spark, sf, "benchmark")
    n = items.agg(F.count("*").alias("n")).scalar()
    claims = items.select(F.col("item_id").alias("_item"), F.col("text").alias("_claim"))
    docs = b.keyed_documents(spark, sf).withColumn("_item", F.pmod("doc_id", n))
    even = F.pmod("doc_id", F.lit(2)) == 0
    ident = F.col("doc_id").cast("string")
    return docs.join(claims, "_item").select(
        "doc_id", "workspace_id", "dimension", "lang", "source",
        F.when(F.col("lang") == "de", F.concat(F.lit("x"), ident)).otherwise(ident).alias("chunk_id"),
        F.when(even, F.col("text")).otherwise(F.col("_claim")).alias("claim"),
        F.pmod("doc_id", F.lit(5)).cast("int").alias("page_number"), F.lit(3).alias("total_pages"),
    )


def citation_check(spark, sf):
    checked = vf.verify_citations(citations(spark, sf), store(spark, sf))
    return checked.select(
        "doc_id", "chunk_exists", "page_exists", "semantic_similarity",
        F.round("keyword_overlap", 6).alias("keyword_overlap"), "verification_method", "verification_confidence",
        "text_supports_claim", "passed",
    )


def citation_keyword_only(spark, sf):
    checked = vf.verify_citations(citations(spark, sf), store(spark, sf), semantic=False)
    return checked.select("doc_id", "verification_method", "page_exists", "passed", "failure_reason")


def citation_tally(spark, sf):
    checked = vf.verify_citations(citations(spark, sf), store(spark, sf), semantic=False)
    return vf.tally(checked, ["source"])


def mixed_citations(spark, sf):
    """Declines, blanks, unknown and known ids, by language."""
    ident = F.col("doc_id").cast("string")
    return citations(spark, sf).withColumn(
        "chunk_id",
        F.when(F.col("lang") == "de", F.concat(F.lit(' "Insufficient evidence ('), ident, F.lit(").")))
        .when(F.col("lang") == "es", "").when(F.col("lang") == "fr", F.concat(F.lit("x"), ident)).otherwise(ident),
    )


def stated_citations(spark, sf):
    return vf.citation_states(mixed_citations(spark, sf), store(spark, sf))


def citation_states(spark, sf):
    return stated_citations(spark, sf).select("doc_id", "state", "source", "source_type")


def document_citation_states(spark, sf):
    stated = vf.citation_states(
        mixed_citations(spark, sf), store(spark, sf), default_source="Uploaded Document", source_type="document"
    )
    return stated.select("doc_id", "state", "source", "source_type")


def visible_citations(spark, sf):
    return analytics.visible_citations(stated_citations(spark, sf), KEYS)


def support_tiers(spark, sf):
    """Support status from entailment scores, from similarity, and from words alone."""
    joined = citations(spark, sf).join(
        store(spark, sf).select(F.col("chunk_id").cast("long").alias("doc_id"), "text"), "doc_id"
    )
    share = lambda factor: (F.pmod(F.col("doc_id") * factor, F.lit(100)) / 100)
    claim, text = F.col("claim"), F.col("text")
    return joined.select(
        "doc_id",
        vf.support_status(claim, text, share(1), share(3), share(7)).alias("nli"),
        vf.support_status(claim, text, similarity=share(1)).alias("emb"),
        vf.support_status(claim, text).alias("key"),
    ).select(
        "doc_id", F.col("nli.status").alias("nli_status"), F.col("nli.confidence").alias("nli_confidence"),
        F.col("emb.status").alias("embedding_status"), F.col("key.status").alias("keyword_status"),
        F.col("key.confidence").alias("keyword_confidence"), F.col("key.method").alias("keyword_method"),
    )


def quote_match(spark, sf):
    """Benchmark quotes resolved inside their claimed source, or anywhere if it has nothing."""
    item = F.col("item_id")
    claimed = (
        F.when(F.pmod(item, F.lit(3)) == 0, "srcX").when(F.pmod(item, F.lit(3)) == 1, "Uploaded Document")
        .otherwise(F.concat(F.lit("src"), F.pmod(item, F.lit(20)).cast("string")))
    )
    quotes = b.read(spark, sf, "benchmark").select("item_id", claimed.alias("source"), F.col("text").alias("quote"))
    hits = vf.scoped_hits(quotes, b.embedded_corpus(spark, sf), ["item_id"])
    return vf.match_quotes(quotes, hits, ["item_id"]).select(
        "item_id", "chunk_id", "overlap", "semantic", "keyword_overlap", "verification_method", "passed"
    )


def _fallback(spark, sf):
    return b.passages(spark, sf).select(
        *KEYS, F.col("line_no").alias("rank"), "chunk_id", "text",
        F.when(F.pmod("line_no", F.lit(4)) == 0, "").otherwise(F.concat(F.lit("s"), F.pmod("line_no", F.lit(7)).cast("string"))).alias("framework"),
    )


def minimum_citations(spark, sf):
    done = vf.minimum_citations(stated_citations(spark, sf), _fallback(spark, sf), KEYS, b.LEXICON.topics)
    return done.select(*KEYS, "chunk_id", "source", "state", F.length("quote").alias("chars"))


def implementation_citations(spark, sf):
    lines = _fallback(spark, sf)
    stored = lines.select(
        "chunk_id", "text", "framework", F.concat(F.lit("doc "), F.col("workspace_id").cast("string")).alias("document_name")
    )
    ident = F.col("doc_id").cast("string")
    given = b.keyed_documents(spark, sf).select(
        *KEYS, "doc_id", F.when(F.col("lang") == "fr", "").otherwise(F.concat(ident, F.lit("-1"))).alias("chunk_id"),
        F.lit("").alias("source"), F.col("text").alias("claim"),
        F.when(F.col("lang") == "fr", "no_citation").otherwise("verified").alias("state"),
    )
    phases = given.select(*KEYS, F.pmod("doc_id", F.lit(3)).alias("phases"))
    pool = lines.withColumnRenamed("rank", "pool_rank").drop("framework")
    done = vf.implementation_citations(given.drop("doc_id"), pool, phases, stored, KEYS, b.LEXICON.topics)
    return done.select(*KEYS, "chunk_id", "source", "state", F.length("quote").alias("chars"))


def international_examples(spark, sf):
    """Examples cite documents by id; some ids are unknown or declines."""
    cited = b.read(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", "None.").otherwise(F.col("o_custkey").cast("string")).alias("chunk_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", " ").otherwise(F.col("o_orderpriority")).alias("practice"),
        F.lit("a quote").alias("claim"),
    )
    return vf.existing_examples(cited, store(spark, sf)).select("o_orderkey", "chunk_id", "practice", "reference")


def incident_matches(spark, sf):
    given = b.keyed_documents(spark, sf).select(
        "doc_id", "workspace_id", "dimension", F.col("doc_id").cast("string").alias("chunk_id"),
        F.col("text").alias("claim"), F.when(F.col("lang") == "fr", "named").otherwise("").alias("source"),
    )
    return vf.match_incidents(given, store(spark, sf), b.LEXICON.topics).select("doc_id", "dimension", "source")


def label_resolution(spark, sf):
    """Prompt labels per dimension resolved to the chunks they stood for."""
    hits = rq.hybrid_hits(spark, sf).select(
        "dimension", F.lit(lx.PRACTICAL).alias("bucket"), F.col("rank").alias("slot"), F.col("chunk_id").cast("string").alias("chunk_id")
    )
    dims = F.array(*[F.lit(d) for d in b.DIMS])
    given = b.read(spark, sf, "orders").select(
        "o_orderkey", F.element_at(dims, F.pmod("o_orderkey", F.lit(8)).cast("int") + 1).alias("dimension"),
        F.concat(F.lit("PRAC-"), F.pmod("o_custkey", F.lit(9)).cast("string")).alias("chunk_id"),
    )
    return vf.resolve_labels(given, hits, ["dimension"]).select("o_orderkey", "dimension", "chunk_id")


def evidence_projection(spark, sf):
    """First citation per chunk with a shortened quote and the chunk's similarity."""
    cited = b.passages(spark, sf).select(
        *KEYS, F.concat(F.lit("c"), F.pmod("line_no", F.lit(3)).cast("string")).alias("chunk_id"),
        F.col("line_no").alias("citation_no"), F.col("text").alias("claim"),
    )
    scores = cited.groupBy(*KEYS, "chunk_id").agg(F.round(F.max(F.length("claim")) / 1000, 6).alias("similarity"))
    done = vf.evidence_list(cited, scores, KEYS)
    return done.select(*KEYS, "chunk_id", "citation_no", F.md5("quote").alias("digest"), "similarity")


def replies(spark, sf):
    """Assistant turns, their lines given a bracketed or a prose source."""
    turn = F.col("turn").cast("string")
    bracket = F.concat(F.lit("\n[Src "), turn, F.lit("]: \""))
    prose = F.concat(F.lit('\nAs stated in the Model Source: "'))
    return b.read(spark, sf, "conversations").filter(F.col("role") == "assistant").select(
        "conv_id", "turn", "text",
        F.when(F.pmod("conv_id", F.lit(2)) == 0, F.replace(F.col("text"), F.lit("\n"), bracket))
        .otherwise(F.replace(F.col("text"), F.lit("\n"), prose)).alias("reply"),
    )


def reply_citations(spark, sf):
    found = vf.reply_citations(replies(spark, sf), ["conv_id", "turn"], "reply")
    return found.select("conv_id", "turn", (F.col("line_no") + 1).alias("line_no"), "source", "quote")


def overview_citations(spark, sf):
    """Markers in replies with the sentence around them."""
    return _overview_labels(spark, sf).select("conv_id", "turn", "marker_no", "doc_no", "claim", "usable")


def _overview_labels(spark, sf):
    marker = F.concat(F.lit(" [DOC-"), (F.pmod("turn", F.lit(3)) + 1).cast("string"), F.lit(", DOC-7], "))
    marked = b.read(spark, sf, "conversations").filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.replace(F.col("text"), F.lit(", "), marker).alias("text")
    )
    return vf.overview_labels(marked, ["conv_id", "turn"])


def overview_audit(spark, sf):
    """The markers' claims against the passages that each reply was given: three documents, labels past them stand for nothing."""
    found = _overview_labels(spark, sf)
    replies = b.read(spark, sf, "conversations").filter(F.col("role") == "assistant").select("conv_id", "turn").distinct()
    number = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    contexts = replies.withColumn("doc_no", number).select(
        "conv_id", "turn", "doc_no", F.pmod(F.col("conv_id") * 3 + F.col("doc_no"), F.lit(50)).cast("string").alias("chunk_id"),
        F.lit(None).cast("int").alias("page_number"), F.lit("").alias("document_name"),
    )
    verified = vf.verify_overview(found, contexts, store(spark, sf), ["conv_id", "turn"])
    return vf.overview_tally(verified, replies, ["conv_id", "turn"]).select(
        "conv_id", "turn", "pass_count", "fail_count", F.size("citations").alias("shown"),
        F.md5(F.array_join(F.transform("citations", lambda c: F.concat_ws("|", c["doc_no"].cast("string"), c["quote"], c["verification_method"])), "\n")).alias("digest"),
    )


def known_sources(spark, sf):
    """Names claimed in order comments matched to customer names, either way round."""
    named = b.read(spark, sf, "customer").select(
        F.col("c_name").alias("name"), F.col("c_custkey").alias("ord")
    )
    key = F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    claimed = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("as told by customer "), key, F.lit(" in a letter")))
        .when(F.col("o_orderstatus") == "P", F.concat(F.lit("omer#"), key))
        .otherwise("Risk")
    )
    given = b.read(spark, sf, "orders").select("o_orderkey", claimed.alias("source"))
    return vf.known_source(given, named, ["o_orderkey"]).select("o_orderkey", "known_source")


def _recommendations(spark, sf):
    return b.passages(spark, sf).select(*KEYS, F.col("line_no").alias("rec_no"), "text")


def _institutions(spark, sf):
    return agency.grounded_institutions(
        _recommendations(spark, sf), b.passages(spark, sf), KEYS, "workspace_id", designators=AGENCY_WORDS
    )


def institutions(spark, sf):
    return _institutions(spark, sf).select(*KEYS, "name", "place")


def _agency_claims(spark, sf):
    ident = F.pmod("doc_id", F.lit(4))
    return b.keyed_documents(spark, sf).select(
        *KEYS,
        F.when(ident == 3, "Not specified by policy here").otherwise(F.get(F.split("text", r"\s+"), F.lit(1))).alias("agency"),
        F.when(ident == 0, "document_named").when(ident == 1, "document_implied").otherwise("none_identified").alias("grounding"),
    )


def agency_grounding(spark, sf):
    """Claimed agencies re-grounded, then reconciled with the bodies recommendations name."""
    grounded = agency.grounding(_agency_claims(spark, sf), b.passages(spark, sf), KEYS, b.LEXICON)
    return agency.reconcile(grounded, _institutions(spark, sf), KEYS).select(*KEYS, "agency", "grounding")


def reply_audit(spark, sf):
    """Per conversation: assistant claims found in the replies and how many are long enough to check."""
    found = vf.reply_citations(replies(spark, sf), ["conv_id", "turn"], "reply")
    return found.groupBy("conv_id").agg(
        F.count("*").alias("citations"), F.count_distinct("source").alias("sources"),
        F.max(F.length("quote")).alias("longest"),
    )


QUERIES = {f.__name__: f for f in (
    citation_check, citation_keyword_only, citation_tally, citation_states, document_citation_states, visible_citations,
    support_tiers, quote_match, minimum_citations, implementation_citations, international_examples, incident_matches,
    label_resolution, evidence_projection, reply_citations, overview_citations, overview_audit, known_sources, institutions,
    agency_grounding, reply_audit,
)}


# -- SQL ---------------------------------------------------------------------

_CITATIONS_SQL = f"""{b.KEYED_SQL},
cit AS (
  SELECT doc_id, workspace_id, dimension, lang, source, k.text AS own_text,
         CASE WHEN lang = 'de' THEN 'x' || doc_id ELSE doc_id::VARCHAR END AS chunk_id,
         CASE WHEN doc_id % 2 = 0 THEN k.text ELSE bm.text END AS claim,
         (doc_id % 5)::INT AS page_number, 3 AS total_pages
  FROM keyed k JOIN benchmark bm ON bm.item_id = doc_id % (SELECT count(*) FROM benchmark)),
chk AS (
  SELECT c.*, d.doc_id IS NOT NULL AS chunk_exists, d.text AS chunk_text, (length(d.text) % 5)::INT AS stored_page
  FROM cit c LEFT JOIN documents d ON d.doc_id::VARCHAR = c.chunk_id),
paged AS (
  SELECT *, chunk_exists AND NOT coalesce(page_number <> stored_page, false) AND NOT (page_number > 0 AND page_number > 3)
         AS page_exists,
         CASE WHEN chunk_exists THEN {b.overlap_sql('claim', 'chunk_text')} END AS ko,
         len({b.tokens_sql('lower(claim)')}) AS nt
  FROM chk)"""

_PAIR_SQL = f"""{b.embed_sql('ct', 'paged', 'doc_id', 'claim')},
{b.embed_sql('dt', 'documents', 'doc_id', 'text')},
pd AS (SELECT ct.doc_id, sum(ct.n * dt.n) AS d FROM ct JOIN dt USING (doc_id, b) GROUP BY 1),
sem AS (
  SELECT p.*, CASE WHEN chunk_exists THEN round(coalesce(pd.d / (cn.norm * dn.norm), 0), 6) END AS sim
  FROM paged p LEFT JOIN pd USING (doc_id) LEFT JOIN ct_norm cn USING (doc_id) LEFT JOIN dt_norm dn USING (doc_id)),
judged AS (
  SELECT *, coalesce(chunk_exists AND (sim >= 0.65 OR ko >= 0.30), false) AS supports,
         CASE WHEN NOT chunk_exists THEN 'identity_check'
              WHEN sim < 0.65 AND ko >= 0.30 THEN 'hybrid_keyword_fallback' ELSE 'semantic' END AS method,
         CASE WHEN NOT chunk_exists THEN 0.0::DOUBLE WHEN sim < 0.65 AND ko >= 0.30 THEN ko ELSE sim END AS conf
  FROM sem)"""

_TERMS = b.tokens_sql("lower(claim)")
_LONG = f"list_filter({_TERMS}, lambda w: length(w) > 3)"
_KEYWORD_SQL = f"""{_CITATIONS_SQL},
kw AS (
  SELECT *, CASE WHEN len({_LONG}) <= 3 THEN len({_TERMS}) ELSE len({_LONG}) END AS terms FROM paged),
kj AS (
  SELECT *, coalesce(chunk_exists AND round(ko * terms) >= greatest(3.0, terms * 0.30::DOUBLE), false) AS supports FROM kw)"""

_STATES_SQL = f"""{_CITATIONS_SQL},
mixed AS (
  SELECT * REPLACE (CASE lang WHEN 'de' THEN ' "Insufficient evidence (' || doc_id || ').' WHEN 'es' THEN ''
                    WHEN 'fr' THEN 'x' || doc_id ELSE doc_id::VARCHAR END AS chunk_id) FROM paged),
{_PAIR_SQL.replace("'paged'", "'mixed'")},
st AS (
  SELECT m.doc_id, m.workspace_id, m.dimension, m.claim, m.chunk_id, m.source AS own_source,
         CASE m.lang WHEN 'de' THEN 'no_citation' WHEN 'es' THEN 'no_chunk_id' WHEN 'fr' THEN 'missing_chunk'
              ELSE CASE WHEN j.page_ok AND j.supports THEN 'verified' ELSE 'unverified' END END AS state
  FROM mixed m JOIN (SELECT *, page_exists AS page_ok FROM judged) j USING (doc_id)),
stated AS (
  SELECT *, CASE WHEN state IN ('verified', 'unverified') THEN own_source ELSE '' END AS source FROM st)"""

_FALLBACK_SQL = """fb AS (
  SELECT *, line_no AS rank, CASE WHEN line_no % 4 = 0 THEN '' ELSE 's' || (line_no % 7) END AS framework FROM passages)"""
_PASSAGES_ONLY = b.PASSAGES_SQL[len(b.KEYED_SQL) + 2:]
_TOPIC = b.topic_sql("text", "dimension", b.LEXICON.topics)


def _topic(text: str) -> str:
    return b.topic_sql(text, "dimension", b.LEXICON.topics)


def _status(sim: str | None) -> str:
    ko = b.overlap_sql("claim", "text")
    empty = "coalesce(claim, '') = '' OR coalesce(text, '') = ''"
    if sim:
        return (f"CASE WHEN {empty} THEN 'irrelevant' WHEN {sim} >= 0.65 THEN 'supports' WHEN {sim} >= 0.45 THEN "
                f"'partially_supports' WHEN {ko} >= 0.3 THEN 'partially_supports' ELSE 'irrelevant' END")
    return (f"CASE WHEN {empty} THEN 'irrelevant' WHEN {ko} >= 0.5 THEN 'supports' WHEN {ko} >= 0.2 THEN "
            "'partially_supports' ELSE 'irrelevant' END")


_QUOTE_SQL = f"""{b.ROLE_SQL},
items AS (
  SELECT item_id, text, CASE item_id % 3 WHEN 0 THEN 'srcX' WHEN 1 THEN 'Uploaded Document'
         ELSE 'src' || (item_id % 20) END AS claimed FROM benchmark),
{rq.sims_sql('corpus', 'items', 'item_id', 'q')},
q_own AS (SELECT s.* FROM q_sims s JOIN items ON items.item_id = s.item_id AND items.claimed = s.framework),
{rq.hybrid_sql('q_own', 'true', 15, 5, 'own', 'items', 'item_id', 'item_id')},
q_rest AS (SELECT * FROM q_sims ANTI JOIN q_own USING (item_id)),
{rq.hybrid_sql('q_rest', 'true', 15, 5, 'broad', 'items', 'item_id', 'item_id')},
hits AS (
  SELECT item_id, rank, chunk_id, text, framework FROM own
  UNION ALL SELECT item_id, rank, chunk_id, text, framework FROM broad ANTI JOIN own USING (item_id)),
ov AS (
  SELECT h.*, i.text AS quote, i.claimed, list_distinct({b.tokens_sql(b.strip_sql('lower(i.text)'))}) AS w
  FROM hits h JOIN items i USING (item_id)),
ov2 AS (
  SELECT *, CASE WHEN len(list_filter(w, lambda x: length(x) > 3)) > 0 THEN list_filter(w, lambda x: length(x) > 3)
            ELSE w END AS used FROM ov),
scored AS (
  SELECT *, round(len(list_filter(used, lambda x: contains(lower(text), x)))::DOUBLE / len(used), 6) AS overlap FROM ov2),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, rank, chunk_id) = 1),
sm AS (
  SELECT b.*, round(s.similarity * 2 - 1, 6) AS approx,
         round(coalesce(d.d / (n1.norm * n2.norm), 0), 6) AS semantic,
         round({b.overlap_sql('b.quote', 'b.text')}, 6) AS ko
  FROM best b JOIN q_sims s USING (item_id, chunk_id)
  LEFT JOIN q_dots d USING (item_id, chunk_id) JOIN q_tok_norm n1 USING (chunk_id) JOIN q_q_norm n2 USING (item_id)),
al AS (
  SELECT *, overlap >= 0.25 AND (lower(claimed) = 'uploaded document' OR contains(lower(framework), lower(claimed))
         OR contains(lower(claimed), lower(framework))) AS fits FROM sm)"""

_FILLER = "|".join(sorted(vf._SOURCE_FILLER, key=len, reverse=True))
_PROSE = vf._PROSE_CITATION.replace("'", "''")
_REPLY_SQL = rf"""reps AS (
  SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN replace(text, chr(10), chr(10) || '[Src ' || turn || ']: "')
         ELSE replace(text, chr(10), chr(10) || 'As stated in the Model Source: "') END AS reply
  FROM conversations WHERE role = 'assistant'),
ll AS (
  SELECT conv_id, turn, unnest(string_split(reply, chr(10))) AS line,
         generate_subscripts(string_split(reply, chr(10)), 1) AS line_no FROM reps),
parsed AS (
  SELECT *, contains(line, '[') AND contains(line, ']') AND contains(line, ':') AS br,
         {b.strip_sql(r"regexp_extract(line, '^[^\[]*\[([^\]]*)\](.*)$', 2)")} AS rest FROM ll),
quoted AS (
  SELECT conv_id, turn, line_no,
    CASE WHEN br THEN regexp_extract(line, '^[^\[]*\[([^\]]*)\](.*)$', 1)
         WHEN contains(line, ':') AND contains(line, '"') THEN
           regexp_replace(regexp_replace({b.strip_sql(f"regexp_extract(line, '{_PROSE}', 1)")},
             '^(?:(?:{_FILLER})\s*)+', '', 'i'), '^(?:[\p{{Ll}}\d]\S*(?:\s+|$))+', '') END AS source,
    CASE WHEN br THEN {b.strip_sql("regexp_replace(" + b.strip_sql("regexp_replace(regexp_replace(rest, '^[:,]', ''), '^\\s+', '')") + ", '^\"+|\"+$', '', 'g')")}
         WHEN contains(line, ':') AND contains(line, '"') THEN
           {b.strip_sql("regexp_replace(" + b.strip_sql(f"regexp_extract(line, '{_PROSE}', 2)") + ", '\"+$', '')")} END AS quote,
    br
  FROM parsed),
rc AS (
  SELECT conv_id, turn, line_no, source, substr(quote, 1, 300) AS quote FROM quoted
  WHERE (br AND length(quote) > 10) OR (NOT br AND length(quote) > 15 AND source <> ''))"""

_MARKER = r"\[DOC-\d+(?:\s*,\s*DOC-\d+)*\]"
_OVERVIEW_SQL = rf"""marked AS (
  SELECT conv_id, turn, replace(text, ', ', ' [DOC-' || (turn % 3 + 1) || ', DOC-7], ') AS text
  FROM conversations WHERE role = 'assistant'),
pieces AS (
  SELECT conv_id, turn, regexp_split_to_array(text, '{_MARKER}') AS p, regexp_extract_all(text, '{_MARKER}') AS m FROM marked),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM pieces WHERE len(m) > 0),
sent AS (
  SELECT conv_id, turn, k, m[k] AS grp,
    string_split(list_aggregate(list_transform(range(1, k + 1), lambda i: p[i] || CASE WHEN i < k THEN m[i] ELSE '' END),
      'string_agg', ''), '.')[-1] AS lft,
    string_split(list_aggregate(list_transform(range(k + 1, len(p) + 1), lambda i: p[i] || CASE WHEN i < len(p) THEN m[i] ELSE '' END),
      'string_agg', ''), '.')[1] AS rgt FROM each),
cl AS (
  SELECT conv_id, turn, k, grp,
    substr({b.strip_sql(r"regexp_replace(" + b.strip_sql("lft || grp || rgt") + r", '^[\[\]]+|[\[\]]+$', '', 'g')")}, 1, 300) AS claim FROM sent)"""

_phrase = r"\b[A-Z][a-zA-Z&.''\-]+(?:\s+(?:of\s+)?[A-Z][a-zA-Z&.''\-]+){1,3}\b"
_acronym = r"^([A-Z]{2,}[A-Za-z]*|[A-Z][a-z]+[A-Z][a-zA-Z]*)$"
_SKIP = b.sql_list(lx.AGENCY_SKIP_WORDS)


def _found_sql(expression: str, kind: int) -> str:
    return (
        f"SELECT workspace_id, dimension, line_no, unnest({expression}) AS name, "
        f"generate_subscripts({expression}, 1) AS pos, {kind} AS kind FROM passages"
    )


_WORDS = rf"list_filter(regexp_extract_all(text, '[\pL\pN_]+'), lambda w: regexp_matches(w, '{_acronym}'))"
_INSTITUTION_SQL = rf"""pc AS (
  {_found_sql(f"regexp_extract_all(text, '{_phrase}')", 0)}
  UNION ALL
  {_found_sql(_WORDS, 1)}),
ok AS (
  SELECT * FROM pc
  WHERE (kind = 0 AND NOT list_contains({_SKIP}, lower(regexp_extract(name, '^\S+')))
         AND len(list_filter(regexp_split_to_array(lower(name), '\s+'), lambda w: w IN ('license', 'apache'))) > 0)
     OR (kind = 1 AND NOT list_contains({_SKIP}, lower(name)) AND length(name) > 1)),
one AS (SELECT workspace_id, dimension, name, min(kind * 100000000 + line_no * 1000 + pos) AS first_at FROM ok GROUP BY ALL),
held AS (SELECT * FROM one o WHERE EXISTS (
  SELECT 1 FROM passages p WHERE p.workspace_id = o.workspace_id AND contains(lower(p.text), lower(o.name)))),
inst AS (
  SELECT workspace_id, dimension, name, row_number() OVER (PARTITION BY workspace_id, dimension ORDER BY first_at) AS place
  FROM held QUALIFY place <= 2)"""

ORACLE = {
    "citation_check": f"""WITH {_CITATIONS_SQL}, {_PAIR_SQL}
SELECT doc_id, chunk_exists, page_exists, sim AS semantic_similarity, round(ko, 6) AS keyword_overlap,
       method AS verification_method, round(conf, 4) AS verification_confidence, supports AS text_supports_claim,
       supports AND page_exists AS passed FROM judged""",
    "citation_keyword_only": f"""WITH {_KEYWORD_SQL}
SELECT doc_id, CASE WHEN chunk_exists THEN 'keyword_only' ELSE 'identity_check' END AS verification_method,
       page_exists, supports AND page_exists AS passed,
       nullif(concat_ws('; ',
         CASE WHEN NOT chunk_exists THEN 'Cited chunk_id does not exist in the vector store.' END,
         CASE WHEN chunk_exists AND page_number <> stored_page THEN 'Claimed page ' || page_number ||
           ' does not match stored page ' || stored_page || '.' END,
         CASE WHEN chunk_exists AND page_number > 3 THEN 'Page ' || page_number || ' exceeds document length (3 pages).' END,
         CASE WHEN chunk_exists AND NOT supports THEN 'The retrieved chunk''s text does not contain sufficient evidence to support the claimed statement (insufficient term overlap).' END), '') AS failure_reason
FROM kj""",
    "citation_tally": f"""WITH {_KEYWORD_SQL}
SELECT source, count(*) AS citations_total, count(*) FILTER (supports AND page_exists) AS citations_passed,
       count(*) FILTER (NOT (supports AND page_exists)) AS citations_failed, max(page_number) AS max_page
FROM kj GROUP BY source""",
    "citation_states": f"""WITH {_STATES_SQL}
SELECT doc_id, state, source, 'framework' AS source_type FROM stated""",
    "document_citation_states": f"""WITH {_STATES_SQL}
SELECT doc_id, state, CASE WHEN state IN ('verified', 'unverified') THEN 'doc ' || own_source ELSE 'Uploaded Document' END
       AS source, 'document' AS source_type FROM stated""",
    "visible_citations": f"""WITH {_STATES_SQL}
SELECT workspace_id, dimension, count(*) FILTER (state = 'no_citation' OR source <> '') AS visible,
       count(*) FILTER (state = 'no_citation' OR source <> '') AS sources,
       count(*) FILTER (state = 'verified') AS verified FROM stated GROUP BY ALL""",
    "support_tiers": f"""WITH {_CITATIONS_SQL},
s AS (SELECT c.doc_id, claim, d.text, (c.doc_id % 100) / 100.0::DOUBLE AS e, (c.doc_id * 3 % 100) / 100.0::DOUBLE AS ne,
             (c.doc_id * 7 % 100) / 100.0::DOUBLE AS co FROM cit c JOIN documents d USING (doc_id)),
t AS (SELECT *, coalesce(claim, '') = '' OR coalesce(text, '') = '' AS nothing FROM s)
SELECT doc_id,
  CASE WHEN nothing THEN 'irrelevant' WHEN e >= 0.6 THEN 'supports' WHEN co >= 0.4 THEN 'contradicts'
       WHEN e >= 0.3 THEN 'partially_supports' ELSE 'irrelevant' END AS nli_status,
  round(CASE WHEN nothing THEN 0 WHEN e >= 0.6 THEN e WHEN co >= 0.4 THEN co WHEN e >= 0.3 THEN e
        ELSE greatest(e, ne) END, 4) AS nli_confidence,
  {_status('e')} AS embedding_status, {_status(None)} AS keyword_status,
  CASE WHEN nothing THEN 0 ELSE round({b.overlap_sql('claim', 'text')}, 4) END AS keyword_confidence,
  CASE WHEN nothing THEN 'none' ELSE 'keyword_only' END AS keyword_method FROM t""",
    "quote_match": f"""WITH {_QUOTE_SQL}
SELECT item_id, CASE WHEN overlap >= 0.25 THEN chunk_id END AS chunk_id, overlap, semantic, ko AS keyword_overlap,
       CASE WHEN NOT fits THEN 'chat_lookup' WHEN semantic >= 0.65 THEN 'chat_semantic'
            WHEN ko >= 0.30 THEN 'chat_keyword' ELSE 'chat_lookup' END AS verification_method,
       fits AND (semantic >= 0.65 OR ko >= 0.30) AS passed FROM al""",
    "minimum_citations": f"""WITH {_STATES_SQL}, {_PASSAGES_ONLY}, {_FALLBACK_SQL},
att AS (
  SELECT workspace_id, dimension, chunk_id, framework AS source, 'deterministic_fallback' AS state, substr(text, 1, 300) AS q
  FROM fb WHERE rank <= 2 AND framework <> ''
    AND NOT EXISTS (SELECT 1 FROM stated s WHERE s.workspace_id = fb.workspace_id AND s.dimension = fb.dimension AND state <> 'no_citation')
    AND NOT {b.fragment_sql('substr(text, 1, 300)')} AND {_topic('substr(text, 1, 300)')})
SELECT workspace_id, dimension, chunk_id, source, state, length(q) AS chars FROM att
UNION ALL
SELECT workspace_id, dimension, chunk_id, source, state, length(claim) FROM stated s
WHERE NOT EXISTS (SELECT 1 FROM att WHERE att.workspace_id = s.workspace_id AND att.dimension = s.dimension)""",
    "implementation_citations": f"""WITH {b.PASSAGES_SQL}, {_FALLBACK_SQL},
given AS (
  SELECT workspace_id, dimension, doc_id % 3 AS phases, CASE WHEN lang = 'fr' THEN '' ELSE doc_id || '-1' END AS chunk_id,
         text AS claim, CASE WHEN lang = 'fr' THEN 'no_citation' ELSE 'verified' END AS state FROM keyed),
jn AS (
  SELECT g.*, f.text AS ct, CASE WHEN f.text IS NOT NULL THEN 'doc ' || g.workspace_id END AS source
  FROM given g LEFT JOIN fb f USING (chunk_id)),
kept AS (SELECT * FROM jn WHERE state = 'no_citation' OR coalesce(ct, '') = '' OR {_topic('ct')}),
have AS (SELECT workspace_id, dimension, count(*) FILTER (state <> 'no_citation') AS n FROM kept GROUP BY ALL),
fill AS (
  SELECT f.*, coalesce(nullif(f.framework, ''), 'doc ' || f.workspace_id) AS src,
         row_number() OVER (PARTITION BY workspace_id, dimension ORDER BY rank, chunk_id) AS turn
  FROM fb f
  WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.state <> 'no_citation' AND k.chunk_id = f.chunk_id)
    AND NOT {b.fragment_sql('substr(text, 1, 300)')} AND NOT contains(lower(substr(text, 1, 200)), 'table of contents')
    AND {_topic('text')}),
added AS (
  SELECT f.workspace_id, f.dimension, f.chunk_id, src AS source, length(substr(f.text, 1, 300)) AS chars
  FROM fill f LEFT JOIN have h USING (workspace_id, dimension)
  JOIN given g ON g.workspace_id = f.workspace_id AND g.dimension = f.dimension
  WHERE turn + coalesce(h.n, 0) <= least(2, greatest(1, g.phases)))
SELECT workspace_id, dimension, chunk_id, source, state, length(claim) AS chars FROM kept WHERE state <> 'no_citation'
UNION ALL
SELECT workspace_id, dimension, chunk_id, source, state, length(claim) FROM kept k WHERE state = 'no_citation'
  AND NOT EXISTS (SELECT 1 FROM added a WHERE a.workspace_id = k.workspace_id AND a.dimension = k.dimension)
UNION ALL SELECT workspace_id, dimension, chunk_id, source, 'deterministic_fallback', chars FROM added""",
    "international_examples": """SELECT o_orderkey, o_custkey::VARCHAR AS chunk_id, o_orderpriority AS practice,
       CASE WHEN lang = 'en' THEN source ELSE '' END AS reference
FROM orders JOIN documents ON doc_id = o_custkey WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'""",
    "incident_matches": f"""WITH {b.KEYED_SQL},
r AS (SELECT *, substr(source, 4)::INT AS n FROM keyed)
SELECT doc_id, dimension, CASE WHEN lang = 'fr' THEN 'named' WHEN lang = 'en' THEN source ELSE '' END AS source
FROM r WHERE (n % 4 = 3 OR (n % 5 = 0 AND (n + 1) % 4 = 3)) AND {_TOPIC}""",
    "label_resolution": f"""WITH {rq._CORPUS_DEFS}, {rq.hybrid_sql('f_sims', rq._ROLES.format(lx.PRACTICAL), 25, 5, 'h')},
g AS (SELECT o_orderkey, ({b.sql_list(b.DIMS)})[(o_orderkey % 8) + 1] AS dimension, o_custkey % 9 AS k FROM orders)
SELECT o_orderkey, g.dimension, coalesce(h.chunk_id::VARCHAR, 'PRAC-' || k) AS chunk_id
FROM g LEFT JOIN h ON h.dimension = g.dimension AND h.rank = k""",
    "evidence_projection": f"""WITH {b.PASSAGES_SQL},
c AS (SELECT workspace_id, dimension, 'c' || (line_no % 3) AS chunk_id, line_no, text FROM passages)
SELECT workspace_id, dimension, chunk_id, min(line_no)::INT AS citation_no,
       md5(substr(arg_min(text, line_no), 1, 500)) AS digest, round(max(length(text)) / 1000.0::DOUBLE, 6) AS similarity
FROM c GROUP BY ALL""",
    "reply_citations": f"""WITH {_REPLY_SQL}
SELECT conv_id, turn, line_no::INT AS line_no, source, quote FROM rc""",
    "overview_citations": rf"""WITH {_OVERVIEW_SQL}
SELECT conv_id, turn, marker_no, doc_no, claim, length(claim) >= 8 AS usable FROM (
  SELECT conv_id, turn, k AS marker_no, claim,
         unnest(regexp_extract_all(grp, 'DOC-(\d+)', 1))::INT AS doc_no FROM cl)""",
    "overview_audit": rf"""WITH {_OVERVIEW_SQL},
ex AS (SELECT conv_id, turn, k AS marker_no, claim, unnest(regexp_extract_all(grp, 'DOC-(\d+)', 1))::INT AS doc_no FROM cl),
claims AS (
  SELECT row_number() OVER () AS id, e.*, d.doc_id, d.text AS chunk_text FROM ex e
  LEFT JOIN documents d ON doc_no <= 3 AND length(claim) >= 8 AND d.doc_id = (conv_id * 3 + doc_no) % 50),
asked AS (SELECT * FROM claims WHERE doc_id IS NOT NULL),
{b.embed_sql('qt', 'asked', 'id', 'claim')},
{b.embed_sql('dt', 'documents', 'doc_id', 'text')},
dots AS (SELECT a.id, sum(qt.n * dt.n) AS d FROM asked a JOIN qt ON qt.id = a.id JOIN dt ON dt.doc_id = a.doc_id AND dt.b = qt.b GROUP BY 1),
sims AS (
  SELECT a.*, round(coalesce(d / (q.norm * n.norm), 0), 6) AS sim, {b.overlap_sql('claim', 'chunk_text')} AS ko
  FROM asked a LEFT JOIN dots ON dots.id = a.id LEFT JOIN qt_norm q ON q.id = a.id LEFT JOIN dt_norm n ON n.doc_id = a.doc_id),
ok AS (SELECT *, CASE WHEN sim < 0.65 AND ko >= 0.30 THEN 'hybrid_keyword_fallback' ELSE 'semantic' END AS method FROM sims WHERE sim >= 0.65 OR ko >= 0.30),
kept AS (
  SELECT conv_id, turn, count(*) AS n, string_agg(doc_no || '|' || claim || '|' || method, chr(10) ORDER BY marker_no, doc_no, claim) AS body FROM ok GROUP BY ALL),
every AS (SELECT conv_id, turn, count(*) AS n FROM claims GROUP BY ALL)
SELECT DISTINCT c.conv_id, c.turn, coalesce(k.n, 0) AS pass_count, coalesce(e.n, 0) - coalesce(k.n, 0) AS fail_count, coalesce(k.n, 0)::INT AS shown,
       md5(coalesce(body, '')) AS digest
FROM conversations c LEFT JOIN every e USING (conv_id, turn) LEFT JOIN kept k USING (conv_id, turn) WHERE role = 'assistant'""",
    "known_sources": """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') THEN c_name END AS known_source
FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
    "institutions": f"""WITH {b.PASSAGES_SQL}, {_INSTITUTION_SQL} SELECT workspace_id, dimension, name, place FROM inst""",
    "agency_grounding": rf"""WITH {b.PASSAGES_SQL}, {_INSTITUTION_SQL},
cl AS (SELECT workspace_id, dimension, doc_id % 4 AS g,
         CASE WHEN doc_id % 4 = 3 THEN 'Not specified by policy here'
              ELSE coalesce({b.strip_sql("regexp_split_to_array(text, '\\s+')[2]")}, '') END AS name FROM keyed),
tp AS (SELECT workspace_id, dimension, lower(text) AS t, {b.word_sql('text', b.LEXICON.named_body)} AS body
       FROM passages WHERE {_TOPIC}),
ev AS (SELECT c.workspace_id, c.dimension, count(*) AS n, bool_or(contains(t, lower(name)) AND body) AS found
       FROM cl c JOIN tp USING (workspace_id, dimension) GROUP BY ALL),
j AS (SELECT c.*, g <= 1 AND name <> '' AND coalesce(n, 0) > 0 AS possible, coalesce(found, false) AS found,
             {b.word_sql('name', b.LEXICON.named_body)} AS named FROM cl c LEFT JOIN ev USING (workspace_id, dimension)),
d AS (SELECT *, CASE WHEN possible AND found THEN CASE g WHEN 0 THEN 'document_named' ELSE 'document_implied' END
               WHEN possible AND g = 1 AND named THEN 'document_implied' ELSE 'none_identified' END AS grounding FROM j),
a AS (SELECT *, CASE WHEN grounding <> 'none_identified' OR (g > 1 AND contains(lower(name), 'not specified by policy')) THEN name
               ELSE {b.quote(lx.NO_AGENCY_TEXT)} END AS agency FROM d),
nm AS (SELECT workspace_id, dimension, string_agg(name, ' and ' ORDER BY place) AS names, count(*) AS k FROM inst GROUP BY ALL)
SELECT a.workspace_id, a.dimension, grounding,
       CASE WHEN grounding = 'none_identified' AND names IS NOT NULL THEN agency || ' Module 2 recommends tasking ' || names ||
         '; the policy names ' || CASE WHEN k > 1 THEN 'these bodies' ELSE 'this body' END ||
         ' but does not assign it this responsibility.' ELSE agency END AS agency
FROM a LEFT JOIN nm USING (workspace_id, dimension)""",
    "reply_audit": f"""WITH {_REPLY_SQL}
SELECT conv_id, count(*) AS citations, count(DISTINCT source) AS sources, max(length(quote)) AS longest FROM rc GROUP BY 1""",
}
