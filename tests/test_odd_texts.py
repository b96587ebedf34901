"""Queries that cut documents, against their SQL, on texts that the test tables do not have."""

import duckdb
import pytest
from test_registry import canon

import __spark_entry__ as driver
from policyloom.operators import segment as sg

LINE = "12 lorem ipsum dolor sit amet. " * 12
LONG = "12 lorem ipsum dolor sit amet " * 150
TEXTS = (
    None, "", " ", "\n \t\n", "\r\n" * 90,
    # a newline alone ends a line
    *(f"12 a{end}HEAD of a part {LINE}\n12 b{end}# Title{end}{LINE}\nIntroduction{end}12 {LINE}" for end in ("\r", "\r\n", "\x85", "\u2028", "\u2029", "\x0b")),
    # what is white space and what is not
    *(f"{blank}# Title{blank}\n{blank}{LINE}{blank}\nSECOND part\n{LINE}.{blank}{LONG}!{blank}{blank}{LONG}{blank}" for blank in ("\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", "\u2003", "\u3000")),
    # letters beside A-Z that count as such
    f"12 a\n\u017fection 1 {LINE}\n\u212aelvin {LINE}\n\u0130stanbul {LINE}\nBac\u212aground:\n{LINE}",
    "le les des une " + "\u0130s " * 4 + "12 " + "lorem " * 60,
    f"{LINE}\nPlain Part\n{LONG}",
)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    docs = [(i, t, "en", f"src{i % 5}", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, len(docs), 3)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["page_stats", "header_lines", "sections_merged", "chunks_boundary", "chunks_by_function", "foreign_documents", "framework_resync", "dup_chunk_rate", "stream_document_chunks"])
def test_odd_texts_are_cut_as_in_sql(spark, odd, name):
    folder, sql = odd
    df = driver.queries()[name](spark, folder)
    result = sql.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(result.fetchall(), columns)


def test_a_chunk_that_starts_with_a_page_lies_on_it(spark):
    """The second chunk starts at 1/49 of the section, where the second of 50 pages starts."""
    text = "x" * 798 + ". " + "y" * 4100
    found = spark.createDataFrame([(1, 0, None, text, list(range(1, 51)))], "doc_id long, section_no long, section_title string, text string, pages array<int>")
    second = sg.split_sections(found).where("chunk_no = 2").first()
    assert (second.chunk_start, second.page_number) == (100, 2)


def test_blank_documents_have_no_chunk_unless_asked_for(spark):
    pages = spark.createDataFrame([(1, 1, " "), (2, 1, "12 words")], "doc_id long, page_number int, text string")
    assert [r.doc_id for r in sg.ingest_pages(pages).collect()] == [2]
    assert sorted(r.doc_id for r in sg.ingest_pages(pages, blank_documents=True).collect()) == [1, 2]
