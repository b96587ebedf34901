import random

from conftest import rows
from pyspark.sql import functions as F

from policyloom import lexicons as lx
from policyloom.functions import text as tx
from policyloom.functions.vectors import batch_embed
from policyloom.operators import agency
from policyloom.operators import verify as vf

K = ["w", "dimension"]


def store(spark):
    return spark.createDataFrame(
        [("c1", "Human oversight of automated systems is required in every ministry.", 3, "F1", "Doc", [lx.NORMATIVE]),
         ("c2", "Incidents of unfair bias were recorded.", 7, "F2", "", [lx.INCIDENT])],
        "chunk_id string, text string, page_number int, framework string, document_name string, roles array<string>",
    )


def cites(spark, data):
    return spark.createDataFrame(data, "i int, chunk_id string, claim string, page_number int, total_pages int")


def test_verification_paths(spark):
    given = cites(spark, [
        (1, "c1", "Human oversight of automated systems is required in every ministry.", 3, 10),
        (2, "c1", "oversight of human committees everywhere", 3, 10),
        (3, "c1", "completely unrelated words here", 3, 10),
        (4, "zz", "x", 1, 10),
        (5, "c1", "Human oversight of automated systems is required in every ministry.", 12, 10),
    ])
    got = {r.i: r for r in vf.verify_citations(given, store(spark)).collect()}
    assert got[1].passed and got[1].verification_method == "semantic"
    assert got[2].passed and got[2].verification_method == "hybrid_keyword_fallback"
    assert not got[3].passed and "below threshold" in got[3].failure_reason
    assert got[4].verification_method == "identity_check" and not got[4].chunk_exists
    assert got[5].text_supports_claim and not got[5].passed
    assert got[5].failure_reason == "Claimed page 12 does not match stored page 3.; Page 12 exceeds document length (10 pages)."


def test_keyword_only(spark):
    given = cites(spark, [(1, "c1", "human oversight automated systems", None, None), (2, "c1", "ministry banana", None, None)])
    got = {r.i: r for r in vf.verify_citations(given, store(spark), semantic=False).collect()}
    assert got[1].passed and not got[2].passed and got[1].verification_method == "keyword_only"


def test_states_and_tally(spark):
    given = cites(spark, [(1, "Insufficient evidence", "", None, None), (2, "", "q", None, None), (3, "nope", "q", None, None),
                          (4, "c1", "Human oversight of automated systems", None, None)])
    stated = vf.citation_states(given, store(spark))
    assert rows(stated, "i", "state", "source") == [(1, "no_citation", ""), (2, "no_chunk_id", ""), (3, "missing_chunk", ""), (4, "verified", "F1")]
    assert rows(vf.tally(stated), "citations_total", "citations_passed") == [(4, 1)]


def test_support_tiers(spark):
    df = spark.createDataFrame([("a b c", "a b c", 0.7, 0.2, 0.1), ("a b", "x", 0.1, 0.2, 0.5), ("", "x", 0.9, 0.0, 0.0)],
                               "c string, t string, e double, n double, k double")
    got = df.select(vf.support_status(F.col("c"), F.col("t"), F.col("e"), F.col("n"), F.col("k")).alias("s")).select("s.status").collect()
    assert [g[0] for g in got] == ["supports", "contradicts", "irrelevant"]
    sim = df.select(vf.support_status(F.col("c"), F.col("t"), similarity=F.lit(0.5)).alias("s")).select("s.status").collect()
    assert [s[0] for s in sim] == ["partially_supports", "partially_supports", "irrelevant"]


def test_labels(spark):
    got = spark.createDataFrame([("w", "d", "DOC-1"), ("w", "d", "NORM-2"), ("w", "d", "raw")], "w string, dimension string, chunk_id string")
    filled = spark.createDataFrame([("w", "d", "document", 1, "x"), ("w", "d", lx.NORMATIVE, 2, "y")],
                                   "w string, dimension string, bucket string, slot int, chunk_id string")
    assert rows(vf.resolve_labels(got, filled, K), "chunk_id") == [("raw",), ("x",), ("y",)]


def given_citations(spark, data):
    return spark.createDataFrame(data, "w string, dimension string, chunk_id string, source string, claim string, state string")


def test_minimum_citations(spark):
    given = given_citations(spark, [("w", "Privacy", "", "", "", "no_citation"), ("w", "Safety", "c1", "F", "q", "verified")])
    fall = spark.createDataFrame(
        [("w", "Privacy", 1, "p1", "Privacy and consent rules apply, always.", "F1"), ("w", "Privacy", 2, "p2", "Privacy2", "F1"),
         ("w", "Privacy", 3, "p3", "Privacy and consent again, too late.", "F1"), ("w", "Safety", 1, "s1", "Safety testing, too.", "F1")],
        "w string, dimension string, rank int, chunk_id string, text string, framework string",
    )
    got = rows(vf.minimum_citations(given, fall, K), "dimension", "chunk_id", "state")
    assert got == [("Privacy", "p1", "deterministic_fallback"), ("Safety", "c1", "verified")]
    nothing = vf.minimum_citations(given, fall.filter("rank = 2"), K)
    assert rows(nothing, "dimension", "state") == [("Privacy", "no_citation"), ("Safety", "verified")]


def test_implementation_citations(spark):
    chunks = spark.createDataFrame(
        [("a", "Safety testing is done, always.", "F", ""), ("b", "An events calendar, in full.", "F", ""),
         ("c", "Robust monitoring, in the text.", "", "Doc"), ("t", "Table of contents, safety.", "F", "")],
        "chunk_id string, text string, framework string, document_name string")
    pool = chunks.select(F.lit("w").alias("w"), F.lit("Safety").alias("dimension"),
                         F.ascii("chunk_id").alias("pool_rank"), "chunk_id", "text")
    phases = spark.createDataFrame([("w", "Safety", 2)], "w string, dimension string, phases int")
    given = given_citations(spark, [("w", "Safety", "b", "", "off", "verified"), ("w", "Safety", "", "", "", "no_citation")])
    got = rows(vf.implementation_citations(given, pool, phases, chunks, K), "chunk_id", "source", "state")
    assert got == [("a", "F", "deterministic_fallback"), ("c", "Doc", "deterministic_fallback")]
    keep = given_citations(spark, [("w", "Safety", "a", "", "on", "verified")])
    got = rows(vf.implementation_citations(keep, pool, phases, chunks, K), "chunk_id", "state")
    assert got == [("a", "verified"), ("c", "deterministic_fallback")]


def test_reply_citations(spark):
    text = ('[UNESCO, p. 3]: "states must act on this"\n[short]: tiny\nAs highlighted in the OECD AI Principles: "systems should be robust and safe"\n'
            "no citation here")
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = rows(vf.reply_citations(df, ["id"]), "source", "quote")
    assert got == [("OECD AI Principles", "systems should be robust and safe"), ("UNESCO, p. 3", "states must act on this")]


def test_overview_markers(spark):
    text = "First claim holds [DOC-1]. Second one, too [DOC-1, DOC-3] here. X [DOC-2]."
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = rows(vf.overview_labels(df, ["id"]), "doc_no", "claim")
    assert got == [(1, "First claim holds [DOC-1"), (1, "Second one, too [DOC-1, DOC-3] here"), (2, "X [DOC-2"), (3, "Second one, too [DOC-1, DOC-3] here")]
    assert vf.overview_labels(df, ["id"], compound=False).count() == 2


def overview_parts(spark):
    """Two replies: cited and unknown passages, a label past those given, a claim too short; many passages that none cites."""
    labels = spark.createDataFrame([
        (1, 1, 1, "States must act on model risk now", True), (1, 1, 7, "States must act on model risk now", True),
        (1, 3, 2, "Nothing like the passage here", True), (1, 5, 1, "short", False),
        (2, 1, 3, "An unknown passage is meant by this", True), (2, 3, 1, " ".join(f"word{k}" for k in range(40)), True),
    ], "id int, marker_no int, doc_no int, claim string, usable boolean")
    contexts = spark.createDataFrame([(i, n, {3: "none"}.get(n, f"c{n + i}"), None, "") for i in (1, 2) for n in (1, 2, 3)],
                                     "id int, doc_no int, chunk_id string, page_number int, document_name string")
    texts = [("c2", "All STATES must act on model risk now, it says"), ("c3", " ".join(f"word{k}x" for k in range(25)) + " word30 prefixword39"), ("c4", None)]
    store = spark.createDataFrame([(c, t, 1) for c, t in texts + [(f"d{k}", "other text") for k in range(50)]], "chunk_id string, text string, page_number int")
    return labels, contexts, store.withColumn("embedding", batch_embed()(F.col("text")))


def test_overview_is_checked_as_citations_are(spark):
    labels, contexts, store = overview_parts(spark)
    got = vf.verify_overview(labels, contexts, store, ["id"])
    columns = ["id", "marker_no", "doc_no", "chunk_exists", "passed", "keyword_overlap", "semantic_similarity", "verification_method", "verification_confidence", "failure_reason"]
    given = contexts.select("id", "doc_no", "chunk_id", "page_number").withColumn("total_pages", F.lit(None).cast("int"))
    plain = vf.verify_citations(labels.filter("usable").join(given, ["id", "doc_no"]), store)
    failed = [(1, 1, 7), (1, 5, 1)]
    found = {r[:3]: r[3:] for r in rows(got, *columns)}
    assert len(found) == got.count() == 6
    assert {k: v for k, v in found.items() if k not in failed} == {r[:3]: r[3:] for r in rows(plain, *columns)}
    assert all(found[k] == (False, False, None, None, "unresolved", 0.0, vf.NO_CHUNK) for k in failed)
    assert found[2, 1, 3][4] == "identity_check" and found[1, 1, 1][1]


def test_overview_reads_only_cited_passages(spark, monkeypatch):
    labels, contexts, store = overview_parts(spark)
    kept, met = [], []
    write, verify = vf.materialize, vf.verify_citations
    monkeypatch.setattr(vf, "materialize", lambda df: kept.append(write(df)) or kept[-1])
    monkeypatch.setattr(vf, "verify_citations", lambda c, s, *a: met.append((c.count(), s.count())) or verify(c, s, *a))
    assert vf.verify_overview(labels, contexts, store, ["id"]).count() == 6
    assert met == [(4, 2)]


def test_known_words_give_the_same_overlap(spark):
    long = " ".join(f"Term{k}" for k in range(40))
    pairs = [(c, t) for c in ("a Few words here", long, "", None) for t in ("Here: few words", "xterm1 " + long[:150], "", None)]
    df = spark.createDataFrame(pairs, "c string, t string").withColumn("w", tx.lowered_words(F.col("t")))
    got = df.select(tx.keyword_overlap(F.col("c"), F.col("t")).alias("x"), tx.keyword_overlap(F.col("c"), F.col("t"), F.col("w")).alias("y")).collect()
    assert [r.x for r in got] == [r.y for r in got] and len({r.x for r in got}) > 3


def test_known_sources(spark):
    known = spark.createDataFrame([("Model-AI-Governance-Framework-for-Agentic-AI.pdf", 0), ("UNESCO Recommendation on the Ethics of AI", 1)], "name string, ord int")
    claims = spark.createDataFrame([("Model AI Governance Framework for Agentic AI",), ("For instance, the UNESCO Recommendation on the Ethics of AI",),
                                    ("Risk",), ("Accountability requires evaluating",)], "source string")
    got = dict(rows(vf.known_source(claims, known, []), "source", "known_source"))
    assert got["Risk"] is None and got["Accountability requires evaluating"] is None
    assert got["Model AI Governance Framework for Agentic AI"].endswith(".pdf")
    assert got["For instance, the UNESCO Recommendation on the Ethics of AI"] == "UNESCO Recommendation on the Ethics of AI"


def test_known_sources_make_only_runs_of_lengths_that_occur(spark):
    known = spark.createDataFrame([(f"Customer#{k:09d}", k) for k in range(40)] + [("customer 000000007", 3)], "name string, ord int")
    given = [(k, f"as told by customer {k:09d} in a letter") for k in range(60)] + [(100 + k, f"omer#{k:09d}") for k in range(60)] + [(200, "Risk"), (201, None)]
    claims = spark.createDataFrame(given, "id int, source string")
    got = dict(rows(vf.known_source(claims, known, ["id"]), "id", "known_source"))
    named = lambda k: None if k >= 40 else "customer 000000007" if k == 7 else f"Customer#{k:09d}"
    assert got == {k: named(k) for k in range(60)} | {100 + k: named(k) for k in range(60)} | {200: None, 201: None}


def test_containment_with_many_lengths(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    frame = spark.createDataFrame([(t,) for t in sorted(set(texts))], "t string")
    got = rows(vf._containing(frame.select(F.col("t").alias("a")), "a", frame.select(F.col("t").alias("b")), "b"), "a", "b")
    assert got == sorted(((a, b) for a in set(texts) for b in set(texts) if a in b), key=repr)


def test_quote_matching(spark):
    quotes = spark.createDataFrame([(1, "F1", "human oversight of automated systems"), (2, "Other", "human oversight of automated systems"),
                                    (3, "", "zebra giraffe elephant")], "i int, source string, quote string")
    hits = spark.createDataFrame([(i, 1, "c1", "Human oversight of automated systems is required.", "F1") for i in (1, 2, 3)],
                                 "i int, rank int, chunk_id string, text string, framework string")
    got = {r.i: (r.passed, r.verification_method, r.chunk_id) for r in vf.match_quotes(quotes, hits, ["i"]).collect()}
    assert got[1][0] and got[2] == (False, "chat_lookup", "c1") and got[3] == (False, "chat_lookup", None)


def test_incidents_and_examples(spark):
    given = spark.createDataFrame([("Fairness", "c2", "q", ""), ("Privacy", "c2", "q", ""), ("Fairness", "c1", "q", ""), ("Fairness", "none", "", "")],
                                  "dimension string, chunk_id string, claim string, source string")
    assert rows(vf.match_incidents(given, store(spark)), "dimension", "source") == [("Fairness", "F2")]
    ex = spark.createDataFrame([("p", "c1", "q"), ("p", "zz", "q"), (" ", "c1", "q"), ("p", "N/A", "q")], "practice string, chunk_id string, claim string")
    assert rows(vf.existing_examples(ex, store(spark)), "chunk_id", "reference") == [("c1", "F1")]


def test_institutions_and_note(spark):
    recs = spark.createDataFrame([("w", "d", 1, "The Ministry of Electronics should task MeitY and Digital Public Infrastructure with BIS.")],
                                 "w string, dimension string, rec_no int, text string")
    passages = spark.createDataFrame([("w", "the ministry of electronics and meity act"), ("w", "bis standards")], "w string, text string")
    found = agency.grounded_institutions(recs, passages, K, "w")
    assert rows(found, "place", "name") == [(1, "MeitY"), (2, "BIS")] or rows(found, "place", "name")[0][1] in ("Ministry of Electronics", "The Ministry of Electronics", "MeitY")
    agencies = spark.createDataFrame([("w", "d", lx.NO_AGENCY_TEXT, "none_identified"), ("v", "d", "Ministry", "document_named")],
                                     "w string, dimension string, agency string, grounding string")
    notes = {r.w: r.agency for r in agency.reconcile(agencies, found, K).collect()}
    assert "does not assign" in notes["w"] and notes["v"] == "Ministry"


def test_agency_grounding(spark):
    passages = spark.createDataFrame([("w", "Safety", "The Ministry of Health runs safety testing."), ("v", "Safety", "An events calendar.")],
                                     "w string, dimension string, text string")
    claims = spark.createDataFrame(
        [("w", "Safety", "Ministry of Health", "document_named"), ("v", "Safety", "Ministry of Health", "document_named"),
         ("u", "Safety", "Not specified by policy.", "none_identified"), ("t", "Safety", "Bureau X", "none_identified")],
        "w string, dimension string, agency string, grounding string")
    got = {r.w: (r.agency, r.grounding) for r in agency.grounding(claims, passages, K).collect()}
    assert got["w"] == ("Ministry of Health", "document_named")
    assert got["v"] == (lx.NO_AGENCY_TEXT, "none_identified")
    assert got["u"] == ("Not specified by policy.", "none_identified") and got["t"][0] == lx.NO_AGENCY_TEXT
