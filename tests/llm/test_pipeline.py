"""The pipeline against plain versions of its stages, each on the rows that the one before it kept."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from plain import WORD, crc, encoded, near_components, odd_documents, pairs, quality_base, suffix_masks, targets
from tokenizers import Tokenizer

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, DATA).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def test_columns(stages):
    for name in list(stages)[1:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_quality(stages):
    kept = {r.doc_id for r in stages["quality_rules"].collect()}
    passed = {i for i, t in pairs(stages["documents"]) if not quality_base(t)[5]}
    assert kept <= passed
    assert len(kept) > 0.97 * len(passed)


def test_near_duplicates(stages):
    before = near_components(pairs(stages["quality_rules"]), 5, 80)
    assert {r.doc_id for r in stages["near_duplicates"].collect()} == {i for i, _, root in before if i == root}


def test_suffixes(stages):
    documents = pairs(stages["near_duplicates"])
    found = dict(pairs(stages["suffix_dedup"]))
    for (i, text), raw, gone in zip(documents, *suffix_masks(documents), strict=True):
        assert raw == text.encode()
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
        # bytes of characters that are not removed whole stay
        assert len(found[i].encode()) - len(kept.encode()) in range(0, 8 * int((gone[1:] != gone[:-1]).sum()) + 1)
    assert len(found) == len(documents)


def test_mix(stages):
    sizes = Counter()
    for r in stages["suffix_dedup"].collect():
        sizes[r.source] += len(WORD.findall(r.text))
    taken = Counter()
    for r in stages["source_mix"].collect():
        taken[r.source] += len(WORD.findall(r.text))
    for source, n in targets(dict(sizes)).items():
        assert abs(taken[source] - n) <= 1


def test_packing(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = sum(len(encoded(tokenizer, t)) for _, t in pairs(stages["source_mix"]))
    found = stages["packing"].collect()
    assert sum(r.length for r in found) == expected
    whole = Counter((r.doc_id, r.ids_crc32) for r in found if r.length == r.doc_tokens)
    texts = Counter((i, crc(encoded(tokenizer, t))) for i, t in pairs(stages["source_mix"]))
    assert all(texts[k] >= n for k, n in whole.items())
    sizes = Counter()
    for r in found:
        sizes[r.sequence_id] += r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in sizes.values())


def test_run_applies_all_stages(spark, stages):
    found = corpus_pipeline.run(spark, DATA)
    keys = [(r.doc_id, r.start, r.length, r.ids_crc32) for r in found.collect()]
    assert sum(k[2] for k in keys) == sum(r.length for r in stages["packing"].collect())
    assert {k[0] for k in keys} == {r.doc_id for r in stages["packing"].collect()}


@pytest.mark.parametrize("stage", ["near_duplicates", "source_mix"])
def test_texts_of_files_are_not_written_again(spark, tmp_path, monkeypatch, stage):
    from policyloom.llm import minhash, mixing
    from policyloom.session import materialize

    written = []
    for module in (minhash, mixing):
        monkeypatch.setattr(module, "materialize", lambda df: written.append(df.columns) or materialize(df))
    plain = odd_documents(spark)
    plain.write.parquet(str(tmp_path / "odd"))
    stored = spark.read.parquet(str(tmp_path / "odd"))
    run = dict(corpus_pipeline.STAGES)[stage]

    def result(docs):
        written.clear()
        return Counter((r.doc_id, r.source, len(r.text or "")) for r in run(spark, docs, DATA).collect())

    found = result(stored)
    assert not any("doc" in columns for columns in written)
    # rows that files do not tell apart are written with numbers
    if stage == "near_duplicates":
        assert found == result(plain) and any("doc" in columns for columns in written)
    twice = spark.read.parquet(str(tmp_path / "odd"), str(tmp_path / "odd"))
    assert sum(result(twice).values()) >= sum(found.values()) and any("doc" in columns for columns in written)


def test_odd_documents_pass_through(spark, tmp_path):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0
