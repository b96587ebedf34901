"""Stored vectors, the inverted file, search inside groups, and budgets with reserves."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from policyloom.functions import vectors as embedding
from policyloom.functions.vectors import HashingEmbedder, batch_embed, embed
from policyloom.operators import index
from policyloom.operators import nearest as nn
from policyloom.operators import retrieve as rt
from policyloom.session import BATCH_SETTING, small_batches
from policyloom.sources import vectors

CHUNKS = "chunk_id long, text string, framework string, roles array<string>"


def counting(path):
    """A model that writes a line for every text that it embeds; kept local, so that it travels to the workers."""

    def make():
        model = HashingEmbedder()

        def run(texts):
            with open(path, "a") as log:
                log.writelines(f"{t}\n" for t in texts)
            return model(texts)

        return run

    return make


def chunk_rows(n=60):
    return [(k, f"word{k % 11} and word{k % 7} of {k}", f"f{k % 3}", ["r"]) for k in range(n)] + [(n, None, None, None), (n + 1, "", "f0", [])]


def test_batch_and_plain_embedding_agree(spark):
    texts = spark.createDataFrame([("a b a",), ("",), (None,), ("ÀB c1",)], "t string")
    for r in texts.select(batch_embed()(F.col("t")).alias("x"), embed(F.col("t")).alias("y")).collect():
        assert np.array_equal(r.x, r.y)


def test_a_text_is_embedded_once(spark, tmp_path):
    log, path = str(tmp_path / "log"), str(tmp_path / "store")
    chunks = spark.createDataFrame(chunk_rows(), CHUNKS)
    vectors.create_store(chunks.where("chunk_id < 20"), path, make_model=counting(log))
    vectors.add_to_store(chunks, path, make_model=counting(log))
    vectors.add_to_store(chunks, path, make_model=counting(log))
    with open(log) as f:
        seen = [x for x in f.read().split("\n") if x]
    assert sorted(seen) == sorted(t for _, t, _, _ in chunk_rows() if t)
    store = vectors.read_store(spark, path)
    assert store.count() == chunks.count()
    changed = chunks.withColumn("text", F.when(F.col("chunk_id") == 5, "new words").when(F.col("chunk_id") == 6, "word0 and word0 of 0").otherwise(F.col("text")))
    vectors.add_to_store(changed, path, make_model=counting(log))
    with open(log) as f:
        assert [x for x in f.read().split("\n") if x][len(seen):] == ["new words"]
    now = vectors.current(vectors.read_store(spark, path), changed)
    assert rows(now, "chunk_id", "text") == rows(changed, "chunk_id", "text")
    known = {r.text: r.embedding for r in now.collect()}
    assert all(np.allclose(v, HashingEmbedder()([t])[0]) for t, v in known.items())


def test_stored_vectors_give_the_same_hits(spark, tmp_path):
    chunks = spark.createDataFrame(chunk_rows(), CHUNKS).withColumn("text", F.coalesce("text", F.lit("")))
    asked = spark.createDataFrame([(1, "word3 and word5"), (2, "of 7")], "q int, text string")
    vectors.create_store(chunks, str(tmp_path / "s"))
    stored = vectors.read_store(spark, str(tmp_path / "s"))
    for scope in (None, "framework"):
        found = [rows(nn.nearest(t, asked, 4, query_keys=["q"], scope=scope, attach=["text"]), "q", "rank", "chunk_id", "similarity", "text") for t in (chunks, stored)]
        assert found[0] == found[1]


def table(spark, n=700, dims=12, seed=3):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, dims)) + 4 * rng.normal(size=(9, dims))[rng.integers(0, 9, n)]
    points[50:90] = points[50]
    data = [(k, p.tolist(), f"g{k % 4 if k % 2 else 0}") for k, p in enumerate(points)] + [(n, [0.0] * dims, "g0"), (n + 1, None, "g1")]
    return spark.createDataFrame(data, "chunk_id long, embedding array<double>, grp string"), points


def brute(points, asked, k, allowed=lambda q, c: True):
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    out = {}
    for q in asked:
        scores = np.floor((1 + unit @ unit[q]) / 2 * 1e6 + 0.5) / 1e6
        order = sorted((c for c in range(len(points)) if allowed(q, c)), key=lambda c: (-scores[c], c))
        out[q] = order[:k]
    return out


@pytest.mark.parametrize("settings", [index.IndexSettings(), index.IndexSettings(cells=9, probes=2, part_rows=40, query_rows=5)])
def test_index_is_exact_or_has_the_recall(spark, tmp_path, settings):
    data, points = table(spark)
    index.build_index(data, str(tmp_path / "i"), settings, carry=["grp"])
    opened = index.open_index(spark, str(tmp_path / "i"), settings)
    assert opened.rows.count() == 701
    queries = [q for q in range(700) if q % 20 == 0]
    asked = data.where("chunk_id % 20 = 0 and chunk_id < 700").select(F.col("chunk_id").alias("q"), "embedding")
    expected = brute(points, queries, 6)

    def found(exact):
        out = {}
        for r in sorted(opened.search(asked, 6, query_keys=["q"], exact=exact).collect(), key=lambda r: (r.q, r["rank"])):
            out.setdefault(r.q, []).append(r.chunk_id)
        return out

    assert found(True) == expected
    near = found(False)
    assert sum(len(set(near[q]) & set(expected[q])) for q in queries) >= 0.9 * 6 * len(queries)


def test_index_reads_only_probed_cells(spark, tmp_path):
    data, _ = table(spark)
    settings = index.IndexSettings(cells=9, probes=1)
    index.build_index(data, str(tmp_path / "i"), settings)
    opened = index.open_index(spark, str(tmp_path / "i"), settings)
    one = data.where("chunk_id = 3").select(F.col("chunk_id").alias("q"), "embedding")
    plan = opened.search(one, 3, query_keys=["q"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "[cell") or "cell#" in plan.split("PartitionFilters: [", 1)[1][:80]


def test_index_of_nothing(spark, tmp_path):
    data, _ = table(spark)
    index.build_index(data.limit(0), str(tmp_path / "i"))
    asked = data.where("chunk_id < 3").select(F.col("chunk_id").alias("q"), "embedding")
    assert index.open_index(spark, str(tmp_path / "i")).search(asked, 3, query_keys=["q"], exact=True).count() == 0


@pytest.mark.parametrize("cuts", [{}, {"part_rows": 30, "query_rows": 4}])
def test_search_inside_groups(spark, cuts):
    data, points = table(spark)
    group = lambda k: f"g{k % 4 if k % 2 else 0}"
    queries = [q for q in range(700) if q % 35 == 0]
    asked = data.where("chunk_id % 35 = 0 and chunk_id < 700").select(
        F.col("chunk_id").alias("q"), "embedding", F.when(F.col("chunk_id") % 70 == 0, "none").otherwise(F.concat(F.lit("g"), F.lit("1"))).alias("grp"))
    found = {}
    for r in nn.nearest_in_groups(data.where("chunk_id < 700"), asked, "grp", 5, query_keys=["q"], **cuts).collect():
        found.setdefault(r.q, []).append((r["rank"], r.chunk_id))
    expected = brute(points, [q for q in queries if q % 70], 5, lambda q, c: group(c) == "g1")
    assert {q: [c for _, c in sorted(v)] for q, v in found.items()} == expected


def test_reserves_take_the_last_open_places(spark):
    columns = "k string, slot int, rank int, chunk_id string, text string, is_reserved boolean"
    filled = spark.createDataFrame([
        ("full", 1, 1, "a", "A", False), ("full", 2, 2, "b", "B", True), ("full", 3, 3, "c", "C", False),
        ("short", 1, 1, "a", "A", True), ("none", 1, 1, "a", "A", False), ("all", 1, 1, "a", "A", True), ("all", 2, 2, "b", "B", True),
    ], columns)
    pool = spark.createDataFrame([
        ("full", 0, 1, "x", " a ", True), ("full", 0, 2, "y", "Y", True), ("full", 0, 3, "z", "y", True), ("full", 0, 4, "w", "W", True),
        ("short", 0, 1, "x", "X", True), ("short", 0, 2, "y", "Y", True), ("all", 0, 1, "x", "X", True), ("fresh", 0, 1, "x", "X", True),
    ], columns)
    got = rows(rt.enforce_reserve(filled, pool, 3, reserve=3, keys=("k",)), "k", "slot", "chunk_id", "is_reserved")
    assert got == sorted([
        ("full", 1, "w", True), ("full", 2, "b", True), ("full", 3, "y", True), ("short", 1, "a", True), ("short", 2, "x", True), ("short", 3, "y", True),
        ("none", 1, "a", False), ("all", 1, "a", True), ("all", 2, "b", True), ("all", 3, "x", True), ("fresh", 1, "x", True),
    ], key=repr)


def test_angles_are_held_in_tiles(monkeypatch):
    rng, sizes = np.random.default_rng(2), []
    angles = index._angles
    monkeypatch.setattr(index, "_angles", lambda v, c: sizes.append(len(v) * len(c)) or angles(v, c))
    points, centres = rng.normal(size=(3000, 4)), rng.normal(size=(2000, 4))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(points.tolist())], names=["chunk_id", "embedding"])
    out = pa.Table.from_batches(index._assign(centres, ["chunk_id", "embedding"])([batch]))
    assert max(sizes) <= nn.TILE_SCORES and out.column("chunk_id").to_pylist() == list(range(3000))
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    assert out.column("cell").to_pylist() == angles(unit, centres).argmin(axis=1).tolist()


def test_embedders_share_the_words_they_know():
    texts = ["one two two", None, "", "three"]
    first, second = HashingEmbedder(16), HashingEmbedder(16, limit=2)
    assert np.array_equal(first(texts), second(texts))
    assert first._known[16].keys() >= {"one", "two", "three"} and first._known is second._known
    second(["four"])
    assert set(first._known[16]) == {"four"}


def test_a_store_is_written_in_small_batches(spark, tmp_path):
    log, before = str(tmp_path / "sizes"), spark.conf.get(BATCH_SETTING)

    def make():
        model = HashingEmbedder()

        def run(texts):
            with open(log, "a") as f:
                f.write(f"{len(texts)}\n")
            return model(texts)

        return run

    spark.conf.set(BATCH_SETTING, "10000")
    try:
        with small_batches(spark, 100):
            spark.range(1000).coalesce(1).select("id", batch_embed(make)(F.col("id").cast("string")).alias("v")).write.parquet(str(tmp_path / "t"))
        assert spark.conf.get(BATCH_SETTING) == "10000"
    finally:
        spark.conf.set(BATCH_SETTING, before)
    with open(log) as f:
        assert [int(x) for x in f] == [100] * 10


def test_words_are_found_in_batches_of_texts(monkeypatch):
    texts = ["One two TWO", None, "", "naïve ÀÉ×÷ÿ_x9 µ", "Œuvre one Kelvin 漢字", "three, one"] * 3
    plain = np.zeros((len(texts), 16))
    for k, text in enumerate(texts):
        for word in embedding._WORDS.findall((text or "").lower()):
            plain[k, embedding._Slots(16)[word]] += 1
    looked = []

    class Slots(embedding._Slots):
        def __getitem__(self, word):
            looked.append(word)
            return super().__getitem__(word) if word in self else self.__missing__(word)

    assert np.array_equal(embedding.token_counts(texts, 16, Slots(16)), plain)
    # a word of a batch is looked up once, but for those of texts beyond Latin-1
    assert looked.count("two") == 1 and looked.count("kelvin") == 3
    monkeypatch.setattr(embedding, "GROUP_CHARS", 12)
    assert np.array_equal(embedding.token_counts(texts, 16), plain)


def test_texts_are_read_for_the_winners_alone(spark, monkeypatch):
    chunks = spark.createDataFrame(chunk_rows(), CHUNKS).filter("framework is not null").withColumn("embedding", batch_embed()(F.col("text")))
    asked = spark.createDataFrame([("d", 0, "word3 and word5"), ("d", 1, "of 7")], "dimension string, query_no int, text string")
    scoped = chunks.join(spark.createDataFrame([("f0", "w0"), ("f1", "w1"), ("f2", "w2")], "framework string, workspace_id string"), "framework")
    plain = rows(rt.document_candidates(scoped, asked, 4), "workspace_id", "dimension", "chunk_id", "text", "rank")
    held = []
    attach = rt.attach_columns
    monkeypatch.setattr(rt, "attach_columns", lambda hits, *a: held.append(hits) or attach(hits, *a))
    found = rt.document_candidates(scoped, asked, 4, texts=chunks.select("chunk_id", "text"))
    assert rows(found, "workspace_id", "dimension", "chunk_id", "text", "rank") == plain and len(plain) == 12
    # the winners are a written table, whose size Spark knows, so texts need not be shuffled to them
    assert len(held[0].inputFiles()) > 0 and "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()


def test_components_of_vectors_have_no_dictionary(spark, tmp_path):
    import pyarrow.parquet as pq

    vectors.create_store(spark.createDataFrame(chunk_rows(), CHUNKS).coalesce(1), str(tmp_path / "s"))
    files = list((tmp_path / "s").glob("*.parquet"))
    group = pq.ParquetFile(files[0]).metadata.row_group(0)
    encodings = {group.column(i).path_in_schema: group.column(i).encodings for i in range(group.num_columns)}
    assert all("DICTIONARY" not in e for p, es in encodings.items() if p.startswith("embedding") for e in es)
