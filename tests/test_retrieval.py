import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from policyloom import lexicons as lx
from policyloom.functions import vectors as vc
from policyloom.operators import nearest as nn
from policyloom.operators import ordering
from policyloom.operators import retrieve as rt
from policyloom.operators import route


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, -3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 2.0], [2.0, 4.0])],
                               "a array<double>, b array<double>")
    got = df.select(vc.l2_normalize(F.col("a")), F.round(vc.cosine(F.col("a"), F.col("b")), 6)).collect()
    assert got[0][0] == [0.6, 0.8] and got[1][0] == [0.0, 0.0]
    assert [g[1] for g in got] == [0.0, 0.0, 1.0]
    d = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (2.5,)], "d double")
    assert [r[0] for r in d.select(vc.similarity_from_distance(F.col("d"))).collect()] == [1.0, 0.5, 0.0, 0.0]


def test_embedding_column(spark):
    df = spark.createDataFrame([("the cat",), ("",), ("the cat",)], "t string")
    got = [r[0] for r in df.select(vc.embed(F.col("t"), 16)).collect()]
    assert got[0] == got[2] and got[1] == [0.0] * 16 and abs(sum(x * x for x in got[0]) - 1) < 1e-12


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 8))
    base[100:200] = base[7]  # a third of the rows are copies of one
    rows_ = [(i, [float(x) for x in v], f"w{i % 3}") for i, v in enumerate(base)]
    chunks = spark.createDataFrame(rows_, "chunk_id long, v array<double>, scope string").repartition(5)
    asked = [(q, [float(x) for x in v]) for q, v in enumerate([base[7], base[250], rng.normal(size=8)])]
    return base, asked, chunks, spark.createDataFrame(asked, "q int, v array<double>")


def brute(base, asked, k, keep=lambda i: True):
    out = []
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    for q, v in asked:
        v = np.array(v) / np.linalg.norm(v)
        scored = sorted((-np.floor((1 + unit[i] @ v) / 2 * 1e6 + 0.5) / 1e6, i) for i in range(len(base)) if keep(i))[:k]
        out += [(q, i, r + 1) for r, (_, i) in enumerate(scored)]
    return sorted(out, key=repr)


def test_nearest_is_exact_with_copies(vectors):
    base, asked, chunks, queries = vectors
    got = nn.nearest(chunks, queries, 12, query_keys=["q"], source="v", stored_vectors=True)
    assert rows(got, "q", "chunk_id", "rank") == brute(base, asked, 12)


def test_blocks_equal_broadcast(vectors, monkeypatch):
    base, asked, chunks, queries = vectors
    monkeypatch.setattr(nn, "BLOCK_ROWS", 40)
    got = nn.nearest(chunks, queries, 9, query_keys=["q"], source="v", stored_vectors=True, bytes_limit=1)
    assert rows(got, "q", "chunk_id", "rank") == brute(base, asked, 9)


def test_nearest_inside_scope(vectors):
    base, asked, chunks, queries = vectors
    got = nn.nearest(chunks, queries, 4, query_keys=["q"], source="v", stored_vectors=True, scope="scope")
    for s in range(3):
        assert rows(got.filter(F.col("scope") == f"w{s}"), "q", "chunk_id", "rank") == brute(base, asked, 4, lambda i: i % 3 == s)


def test_salted_top_k_equals_plain(spark):
    df = spark.range(2000).select(F.lit("hot").alias("k"), "id", (F.col("id") * 7919 % 1000).alias("v"))
    order = [F.desc("v"), F.asc("id")]
    assert rows(ordering.top_k(df, ["k"], order, 20)) == rows(ordering.top_k(df, ["k"], order, 20, spread_by="id"))


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    assert rows(ordering.first_per_key(df, ["k"], ["o"])) == [("a", 1, "y"), ("b", 5, "z")]


def test_rrf_ranks_from_zero(spark):
    lists = spark.createDataFrame([(1, "c1", 1), (1, "c2", 2), (2, "c2", 1), (2, "c1", 2), (2, "c3", 3)], "l int, chunk_id string, rank int")
    got = dict(rows(nn.reciprocal_rank_fusion(lists, []), "chunk_id", "rrf_score"))
    assert got["c1"] == got["c2"] == round(1 / 60 + 1 / 61, 10) and got["c3"] == round(1 / 62, 10)


def test_hybrid_prefers_term_hits(spark):
    cand = spark.createDataFrame(
        [("q", "data protection", "a", "nothing here at all", 0.5), ("q", "data protection", "b", "data protection rules", 0.5)],
        "k string, query_text string, chunk_id string, text string, similarity double",
    )
    got = nn.hybrid_rerank(cand, ["k"], 2).orderBy("rank").collect()
    assert [g.chunk_id for g in got] == ["b", "a"] and got[0].similarity == round(0.35 + 0.3 * 2 / 4, 4)


def test_reranker_threshold(spark):
    cand = spark.createDataFrame([("q", "x y", "a", "x y"), ("q", "x y", "b", "z")], "k string, query_text string, chunk_id string, text string")
    score = vc.score_pairs_with(lambda l, r: [float(len(set(a.split()) & set(b.split()))) for a, b in zip(l, r)])
    assert rows(nn.rerank_pairs(cand, ["k"], 5, score), "chunk_id", "rank") == [("a", 1)]


def bucket_rows(spark, data):
    return spark.createDataFrame(
        [("w", "d", *r) for r in data],
        "workspace_id string, dimension string, bucket string, rank int, chunk_id string, text string, framework string",
    )


def test_first_pass_budgets(spark):
    s = "A full sentence, and it is number "
    data = [(lx.NORMATIVE, i, f"n{i}", s + str(i // 2) + ".", "F") for i in range(12)]
    data += [(lx.PRACTICAL, 0, "n0", s + "0.", "F"), (lx.PRACTICAL, 1, "p1", s + "0.", "F"), (lx.PRACTICAL, 2, "p2", "Glossary12", "F"),
             (lx.PRACTICAL, 3, "p3", s + "9.", "F")]
    data += [("document", 1, "d1", s + "x.", ""), ("document", 2, "d2", "  " + s.upper() + "X.", "")]
    got = rt.fill_buckets(bucket_rows(spark, data))
    by = {}
    for b, slot, c in rows(got, "bucket", "slot", "chunk_id"):
        by.setdefault(b, []).append(c)
    assert by[lx.NORMATIVE] == ["n0", "n2", "n4", "n6"]
    assert by[lx.PRACTICAL] == ["p1", "p3", "p2"]
    assert by["document"] == ["d1"]


def test_second_pass_in_turn(spark):
    t = "A sentence, about the matter "
    data = [(lx.IMPLEMENTATION, i, f"i{i}", t + ("same." if i < 2 else f"{i}."), "F") for i in range(5)]
    data += [(lx.INCIDENT, 0, "i1", t + "same.", "F"), (lx.INCIDENT, 1, "i4", t + "4.", "F"), (lx.INCIDENT, 2, "c1", t + "same.", "F"),
             (lx.INCIDENT, 3, "c2", t + "same.", "F"), (lx.INCIDENT, 4, "c3", t + "c.", "F")]
    got = rows(rt.fill_buckets_in_turn(bucket_rows(spark, data)), "bucket", "slot", "chunk_id")
    assert [c for b, _, c in got if b == lx.IMPLEMENTATION] == ["i0", "i2", "i3"]
    assert [c for b, _, c in got if b == lx.INCIDENT] == ["i4", "c1", "c2"]


@pytest.mark.parametrize("have, expected", [(["o", "o", "o"], "x2"), (["r", "o", "o"], None), (["o"], "x2")])
def test_reserve(spark, have, expected):
    filled = spark.createDataFrame(
        [("d", i + 1, f"f{i}", f"text {i}", k == "r") for i, k in enumerate(have)],
        "dimension string, slot int, chunk_id string, text string, is_reserved boolean",
    )
    pool = spark.createDataFrame(
        [("d", 1, "x1", "Text  0", True), ("d", 2, "x2", "new text", True)],
        "dimension string, rank int, chunk_id string, text string, is_reserved boolean",
    ).withColumn("slot", F.lit(0))
    got = rows(rt.enforce_reserve(filled, pool, 3, keys=("dimension",)), "slot", "chunk_id")
    assert len(got) == len(have)
    assert (expected in [c for _, c in got]) == bool(expected)
    if expected:
        assert got[-1][1] == expected


def simulate(picks, sweep, top):
    merged, ids, texts = [], set(), set()
    a, b = list(picks), list(sweep)
    while len(merged) < top and (a or b):
        source = (a or b) if len(merged) % 2 == 0 else (b or a)
        cid, text = source.pop(0)
        if cid in ids or text.strip().lower() in texts:
            continue
        ids.add(cid)
        texts.add(text.strip().lower())
        merged.append(cid)
    return merged


def test_interleave_matches_simulation(spark):
    random.seed(11)
    for trial in range(4):
        ids = [[random.randint(0, 40) for _ in range(60)] for _ in range(2)]
        lists = [[(f"c{i}", f"Text {i % 17}") for i in side] for side in ids]
        frames = [
            spark.createDataFrame([("w", i, c, t) for i, (c, t) in enumerate(l)], "workspace_id string, position int, chunk_id string, text string")
            for l in lists
        ]
        got = [r.chunk_id for r in rt.interleave(*frames).orderBy("rank").collect()]
        assert got == simulate(*lists, 10)


def test_merge_hits_and_latest(spark):
    fw = spark.createDataFrame([("q", 1, "a", 0.9), ("q", 2, "b", 0.4)], "k string, rank int, chunk_id string, similarity double")
    doc = spark.createDataFrame([("q", 1, "b", 0.8), ("q", 2, "c", 0.5)], "k string, rank int, chunk_id string, similarity double")
    assert [r[0] for r in rt.merge_hits(fw, doc, ["k"]).orderBy("merged_rank").select("chunk_id").collect()] == ["a", "c", "b"]
    runs = spark.createDataFrame([("w", 1, "old"), ("w", 2, "new"), (None, 3, "free")], "w string, t int, v string")
    assert rows(rt.latest_per_key(runs, ["w"], ["t"]), "w", "v") == [("w", "new"), (None, "free")]
    names = spark.createDataFrame([(" b ",), ("",), (None,), ("a",), ("b",)], "n string")
    assert [r[0] for r in rt.ordered_names(names, "n").collect()] == ["a", "b"]


def test_routing_tiers(spark, tmp_path):
    import json

    from policyloom.sources.catalog import read_catalog

    def line(name, roles, dimensions=(), regions=()):
        return json.dumps({"name": name, "roles": [*roles], "dimensions": [*dimensions], "regions": [*regions]})

    (tmp_path / "catalog.json").write_text("\n".join([
        line("World", [lx.NORMATIVE]), line("Asia guide", [lx.PRACTICAL], regions=["ASEAN"]),
        line("Fair practice", [lx.PRACTICAL], ["Fairness"]), line("Other role", [lx.INCIDENT], ["Fairness"]),
    ]))
    catalog = read_catalog(spark, str(tmp_path / "catalog.json"))
    practical = route.dimension_frameworks(catalog, [lx.PRACTICAL]).filter("dimension = 'Fairness'")
    assert practical.count() == 1
    asked = spark.createDataFrame([("Safety", "Viet_Nam"), ("Privacy", None)], "dimension string, country string")
    got = route.route(asked, catalog, route.region_table(spark))
    regional = got.filter((F.col("country") == "Viet_Nam") & (F.col("tier") == 2)).select("name").collect()
    assert [r.name for r in regional] == ["Asia guide"]


def test_text_queries_in_blocks_equal_broadcast(spark, monkeypatch):
    texts = [f"{'alpha ' * (i % 5)}beta gamma{i % 7} delta{i}" for i in range(60)]
    chunks = spark.createDataFrame([(f"c{i:02d}", t, f"f{i % 2}") for i, t in enumerate(texts)], "chunk_id string, text string, framework string")
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha beta", "gamma3", "delta7 beta", ""])], "q int, text string")
    monkeypatch.setattr(nn, "BLOCK_ROWS", 16)
    one = nn.nearest(chunks, asked, 7, query_keys=["q"], attach=["text"])
    cut = nn.nearest(chunks, asked, 7, query_keys=["q"], attach=["text"], bytes_limit=1)
    assert rows(one, "q", "rank", "chunk_id", "similarity", "text") == rows(cut, "q", "rank", "chunk_id", "similarity", "text")
    assert nn.retrieve(chunks, asked, 3, query_keys=["q"], frameworks=["f1"], carry=["framework"]).filter("framework <> 'f1'").count() == 0


def test_texts_equal_in_their_first_characters_both_stay(spark):
    head = "A passage of some length. " * 40
    found = [("w", "d", lx.PRACTICAL, i, f"c{i}", head + tail) for i, tail in enumerate(["one", "two", "two"])]
    candidates = spark.createDataFrame(found, "workspace_id string, dimension string, bucket string, rank int, chunk_id string, text string")
    filled = rt.fill_buckets(candidates, {lx.PRACTICAL: 5})
    assert sorted(r.chunk_id for r in filled.collect()) == ["c0", "c1"]
    assert {len(r.text) for r in filled.collect()} == {800}
