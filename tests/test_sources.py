import json

from conftest import rows
from pyspark.sql import functions as F

from policyloom.operators import analytics
from policyloom.plans import analysis, render
from policyloom.sources import catalog, files


def test_file_triage(spark, tmp_path):
    for name, body in {"ok.pdf": b"%PDF-1.4 x", "text.pdf": b"hello", "big.pdf": b"%PDF-" + b"x" * 99, "scan.pdf": b"%PDF-2", "void.pdf": b"%PDF-3"}.items():
        (tmp_path / name).write_bytes(body)
    found = files.read_files(spark, str(tmp_path), "*.pdf").withColumn("name", F.element_at(F.split("path", "/"), -1))
    none = spark.createDataFrame([("none.pdf", 0, bytearray())], "name string, length long, content binary")
    found = found.select("name", "length", "content").unionByName(none)
    pages = spark.createDataFrame([("ok.pdf", "text"), ("scan.pdf", " "), ("scan.pdf", "")], "name string, text string")
    judged = files.triage(found, files.page_statistics(pages, "name"), key="name", limit=50)
    got = dict(rows(judged, "name", "error_type"))
    assert got == {"ok.pdf": None, "none.pdf": "empty_file", "text.pdf": "wrong_file_type", "big.pdf": "file_too_large",
                   "scan.pdf": "scanned_document", "void.pdf": "empty_document"}
    log = {r.outcome: r.share for r in files.upload_log(judged).collect()}
    assert log["accepted"] == round(1 / 6, 4)
    import hashlib

    hashes = dict(rows(files.with_hash(found), "name", "checksum"))
    assert hashes["ok.pdf"] == hashlib.sha256(b"%PDF-1.4 x").hexdigest()


def test_catalog_file(spark, tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text("\n".join(json.dumps(x) for x in [{"name": "A", "roles": ["r"]}, {"name": "B", "regions": ["X"]}]))
    got = catalog.read_catalog(spark, str(path)).orderBy("ord").collect()
    assert [(g.name, g.roles, g.regions) for g in got] == [("A", ["r"], []), ("B", [], ["X"])]


def test_library_and_status(spark):
    entries = spark.createDataFrame([(0, "A"), (1, "B"), (2, "A")], "ord int, name string")
    chunks = spark.createDataFrame([("A",), ("A",)], "framework string")
    assert rows(catalog.library(entries, chunks), "name", "chunk_count", "indexed") == [("A", 2, True), ("B", 0, False)]
    counts = spark.createDataFrame([("A", 2)], "name string, chunk_count long")
    listed = spark.createDataFrame([("B",)], "name string")
    assert rows(catalog.status_report(entries.filter("ord < 2"), listed, counts), "name", "downloaded", "indexed") == [("A", False, True), ("B", True, False)]
    assert catalog.store_health(chunks).collect()[0].total_chunks == 2


def test_sync_rewrites_only_what_changed(spark, tmp_path):
    store = str(tmp_path / "chunks")
    old = spark.createDataFrame([("A", "a1", "old"), ("B", "b1", "old")], "framework string, chunk_id string, text string")
    catalog.write_chunks(old, store)
    now = spark.createDataFrame([("A", "h2"), ("B", "h1"), ("C", "h1")], "name string, checksum string")
    before = spark.createDataFrame([("A", "h1"), ("B", "h1")], "name string, checksum string")
    counts = spark.createDataFrame([("A", 1), ("B", 1)], "name string, chunk_count long")
    plan = catalog.sync_plan(now, before, counts)
    assert rows(plan, "name", "action") == [("A", "replace"), ("B", "skip"), ("C", "ingest")]
    body = "12 word. " * 60
    pages = spark.createDataFrame([(1, "A", 1, body), (2, "B", 1, body), (3, "C", 1, body)], "doc_id long, framework string, page_number int, text string")
    roles = spark.createDataFrame([("A", ["r"])], "framework string, roles array<string>")
    fresh = analysis.sync_framework_chunks(pages, plan, roles)
    assert rows(fresh.select("framework").distinct()) == [("A",), ("C",)]
    catalog.replace_frameworks(fresh.select("framework", "chunk_id", "text"), store)
    stored = spark.read.parquet(store)
    assert rows(stored.filter("text = 'old'"), "framework") == [("B",)]
    assert rows(stored.select("framework").distinct()) == [("A",), ("B",), ("C",)]


def test_lookup(spark):
    ids = spark.createDataFrame([("a",), ("x",)], "chunk_id string")
    chunks = spark.createDataFrame([("a", "t")], "chunk_id string, text string")
    assert rows(catalog.lookup(ids, chunks), "chunk_id", "text", "found") == [("a", "t", True), ("x", None, False)]


def test_nested_results_survive_parquet(spark, tmp_path):
    gaps = spark.createDataFrame(
        [(1, 1, "B", "Partial", "why", "Defined", "Low", "r", 0.5, None, ["m"], "High", ["do"]), (1, 0, "A", "Covered", None, "Managed", "Low", "r", 0.9, None, [], None, [])],
        "workspace_id int, ord int, dimension string, coverage string, coverage_reasoning string, governance_maturity string, risk_level string, "
        "risk_reason string, confidence_score double, analysis_error string, mechanisms array<string>, priority string, recommendations array<string>")
    path = str(tmp_path / "analyses")
    analytics.nested_analyses(gaps).write.parquet(path)
    back = analytics.finding_rows(spark.read.parquet(path))
    assert rows(back, "dimension", "coverage_reasoning", "priority") == [("A", None, None), ("B", "why", "High")]


def test_renderings(spark):
    filled = spark.createDataFrame(
        [("w", "Privacy", "document", 1, "c1", "text", "", 4, "Policy"), ("w", "Privacy", "module_1_normative", 1, "c2", "norm", "OECD", None, "file.pdf")],
        "workspace_id string, dimension string, bucket string, slot int, chunk_id string, text string, framework string, page_number int, document_name string")
    context = render.prompt_context(filled).collect()[0].context
    assert "[DOC-1] chunk_id=c1 (p.4) Source: Policy\ntext" in context and "[NORM-1] chunk_id=c2 Source: OECD\nnorm" in context
    assert context.endswith("(no Module 2 practical chunks retrieved)")
    second = render.second_pass_context(filled).collect()[0].context
    assert "(no curated incident records retrieved)" in second and second.startswith("Dimension: Privacy")
    hits = spark.createDataFrame([("q", 1, "F", "S", 2, "body")], "k string, rank int, framework string, section_title string, page_number int, text string")
    assert render.chat_context(hits, ["k"]).collect()[0].context == "[1] Source: F, S (p. 2)\nbody\n"
    picks = spark.createDataFrame([("w", 1, "Doc", "Sec", 3, "body")], "w string, rank int, document_name string, section_title string, page_number int, text string")
    assert render.overview_context(picks, ["w"]).collect()[0].context == "[DOC-1] (Doc, Sec, p. 3)\nbody\n"
    brief = spark.createDataFrame(
        [("w", "Utopia", "Policy", "now", 8, "sum", ["s"], [], "risk", [("r", "why")], None, "method")],
        "workspace_id string, country string, policy_title string, generated_at string, num_dimensions int, executive_summary string, strengths array<string>, "
        "attention array<string>, risk_paragraph string, recommendations array<struct<recommendation: string, rationale: string>>, precedent string, methodology string")
    text = render.brief_markdown(brief).collect()[0].markdown
    assert text.startswith("# Utopia — Policy") and "1. **r** — why" in text and "- None identified." in text and "PRECEDENT" not in text
    gap = spark.createDataFrame([("w", "Privacy", "Partial", "why", "Defined", "Low", "r", "GeoMean", ["do"])],
                                "workspace_id string, dimension string, coverage string, coverage_reasoning string, governance_maturity string, risk_level string, "
                                "risk_reason string, confidence_method string, recommendations array<string>")
    assert render.drill_down(gap).collect()[0].trail.endswith("Recommendation: do")


def test_empty_files_are_read(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "b.pdf").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"")
    found = files.read_files(spark, str(tmp_path), "*.pdf")
    assert sorted((r.path.rpartition("/")[2], r.length) for r in found.collect()) == [("a.pdf", 6), ("b.pdf", 0)]
    statistics = spark.createDataFrame([], "path string, total_pages long, total_chars long")
    judged = {r.path.rpartition("/")[2]: r.error_type for r in files.triage(found, statistics).collect()}
    assert judged["b.pdf"] == "empty_file"
