import numpy as np
import pytest
from plain import empty_documents, near_components, odd_documents, pairs, substring_result, suffix_masks, suffix_result
from pyspark.sql import functions as F

from policyloom.llm.minhash import NearSettings, drop_near_duplicates, near_duplicates, sketches
from policyloom.llm.queries import QUERIES
from policyloom.llm.substrings import SubstringSettings, dedup_substrings
from policyloom.llm.suffixes import EnhancedSuffixes, SuffixSettings, dedup_suffixes, lcp_intervals, without_repeats

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def same(found, expected):
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, expected), key=repr)


# --- near-duplicates


def test_sketch_agreement_follows_similarity():
    values = np.random.default_rng(0).integers(1, 2**63, 300, dtype=np.uint64)
    table = sketches(np.concatenate((values[:200], values[50:250], values[:3])), np.array([0, 200, 400, 403]), 256)
    assert (table != np.uint64(2**64 - 1)).all()
    assert abs((table[0] == table[1]).mean() - 150 / 250) < 0.12


def test_bands_keep_their_promise():
    for percent in (50, 80, 85, 95):
        settings = NearSettings(percent=percent)
        rows, bands = settings.bands
        assert rows * bands <= settings.coordinates
        assert (1 - (percent / 100) ** rows) ** bands <= settings.miss


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 85, 512), (5, 80, 512), (3, 85, 4)])
def test_components_match_all_pairs(documents, words, percent, block):
    found = near_duplicates(documents, NearSettings(words=words, percent=percent, block=block)).collect()
    expected = near_components(pairs(documents), words, percent)
    same([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found], [(*e, e[0] == e[2]) for e in expected])


@pytest.mark.parametrize("block", [512, 2])
def test_components_of_odd_documents(spark, block):
    docs = odd_documents(spark)
    found = near_duplicates(docs, NearSettings(words=3, percent=85, block=block)).collect()
    expected = near_components(pairs(docs), 3, 85)
    same([(r.doc_id, r.n_shingles, r.component_id) for r in found], expected)
    # numbers are compared with nulls safely
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_rows_of_one_id_share_a_component(spark):
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    docs = spark.createDataFrame([(5, a), (5, b), (3, b), (9, a)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(docs).collect()} == {(5, 3), (3, 3), (9, 3)}


def test_one_document_of_each_component_stays(documents, spark):
    kept = drop_near_duplicates(documents)
    assert kept.columns == documents.columns
    expected = {i for i, _, root in near_components(pairs(documents), 5, 80) if i == root}
    assert {r.doc_id for r in kept.collect()} == expected
    assert near_duplicates(empty_documents(spark)).count() == 0
    assert drop_near_duplicates(empty_documents(spark)).count() == 0


def test_rows_are_dropped_by_text_and_not_by_id(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(50)) for x in "abc")
    rows = [(5, a), (5, b), (3, b), (9, a), (7, c), (7, c), (None, c), (None, "d " * 9), (None, "d " * 9), (None, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in drop_near_duplicates(docs).collect()]
    assert sorted(found, key=repr) == sorted([(5, a), (3, b), (7, c), (None, "d " * 9), (None, None), (8, "")], key=repr)


# --- substrings


def digest(found):
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()


@pytest.mark.parametrize("chunk_chars", [8 << 20, 50_000])
def test_substrings_match_a_set_of_windows(documents, chunk_chars):
    found = dedup_substrings(documents, SubstringSettings(chunk_chars=chunk_chars, slice_windows=20_000))
    same(digest(found), substring_result(pairs(documents)))


@pytest.mark.parametrize(("chunk_chars", "bits"), [(8 << 20, 23), (20_000, 4)])
def test_substrings_of_odd_documents(spark, chunk_chars, bits):
    docs = odd_documents(spark)
    found = dedup_substrings(docs, SubstringSettings(chunk_chars=chunk_chars, slice_windows=500, sketch_bits=bits))
    same(digest(found), substring_result(pairs(docs)))


def test_no_documents_no_substrings(spark):
    assert dedup_substrings(empty_documents(spark)).count() == 0


# --- suffixes


def test_intervals_of_a_suffix_array():
    text = "banana$"
    order = sorted(range(len(text)), key=lambda k: text[k:])
    lcp = [0]
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while a + k < len(text) and b + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        lcp.append(k)
    strings = {(text[order[first]:][:length], last - first + 1) for first, last, length in lcp_intervals(lcp)}
    assert strings == {("a", 3), ("ana", 2), ("na", 2)}


def test_maximal_repeats_have_all_occurrences():
    # contexts around the anchor "|": three share "bc|de", two of them "abc|def"
    contexts = [b"abc|def", b"abc|def", b"xbc|dez", b"q|q"]
    lefts = np.array([c.index(b"|") for c in contexts])
    suffixes = EnhancedSuffixes(np.zeros(4, np.int64), contexts, lefts)
    groups = {(tuple(sorted(members.tolist())), left, prefix) for members, left, prefix in suffixes.maximal_repeats(2)}
    assert ((0, 1, 2), 2, 3) in groups
    assert ((0, 1), 3, 4) in groups


def suffix_digest(found):
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()


@pytest.mark.parametrize("settings", [
    SuffixSettings(), SuffixSettings(bucket_rows=50), SuffixSettings(group_rows=2), SuffixSettings(length=60, kgram=16),
])
def test_suffixes_match_counted_strings(documents, settings):
    same(suffix_digest(dedup_suffixes(documents, settings)), suffix_result(pairs(documents), settings.length))


@pytest.mark.parametrize("group_rows", [8192, 1])
def test_suffixes_of_odd_documents(spark, group_rows):
    docs = odd_documents(spark)
    same(suffix_digest(dedup_suffixes(docs, SuffixSettings(group_rows=group_rows))), suffix_result(pairs(docs)))


def test_documents_without_repeats(spark):
    docs = odd_documents(spark)
    out = without_repeats(docs)
    assert out.dtypes == docs.dtypes
    expected = []
    for row, raw, gone in zip(docs.collect(), *suffix_masks(pairs(docs)), strict=True):
        text = row.text
        if text is not None:
            place, kept = 0, []
            for c in text:
                size = len(c.encode())
                if not gone[place : place + size].all():
                    kept.append(c)
                place += size
            assert place == len(raw)
            text = "".join(kept)
        n = len(text) if gone.any() else row.n_chars
        expected.append((row.doc_id, text, row.lang, row.source, n, row.row, row.key, row.label, row["from"]))
    same(out.collect(), expected)
    assert without_repeats(empty_documents(spark)).count() == 0


def test_any_column_may_come_along(spark):
    row = ("the same passage " * 30, 5, "a", 1.5, "n", "i")
    docs = spark.createDataFrame([(k, *row) for k in range(3)], "doc_id long, text string, n_chars int, own string, more double, _null string, _id string")
    docs = docs.withColumn("_row", F.struct("own", "_id")).withColumn("kept", F.lit("k")).withColumn("n_removed", F.lit(7))
    out = without_repeats(docs)
    assert out.dtypes == docs.dtypes
    assert out.drop("text", "n_chars", "doc_id").distinct().collect() == docs.drop("text", "n_chars", "doc_id").distinct().collect()
    bare = docs.select("doc_id", "text")
    assert without_repeats(bare).columns == ["doc_id", "text"]


@pytest.mark.parametrize(("name", "plain"), [("op4_substring_dedup", substring_result), ("op6_suffix_dedup", suffix_result)])
def test_queries(spark, documents, name, plain):
    same(QUERIES[name](spark, DATA).collect(), plain(pairs(documents)))


def test_near_duplicate_query(spark, documents):
    found = QUERIES["op2_near_duplicates"](spark, DATA).collect()
    same([(r.doc_id, r.n_shingles, r.component_id) for r in found], near_components(pairs(documents), 3, 85))
