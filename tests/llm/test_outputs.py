from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import WORD, crc, empty_documents, encoded, odd_documents, order, pairs, targets
from pyarrow import fs as pa_fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from policyloom.llm import tokens
from policyloom.llm.ann import AnnSettings, KdTree, chi_square_cdf, chi_square_limit, nearest_neighbours
from policyloom.llm.mixing import MixSettings, mix_sources, mixed_documents, sized_rows, source_targets, words_taken
from policyloom.llm.packing import Schedule, pack
from policyloom.llm.queries import QUERIES
from policyloom.llm.tokens import EliasFano, Shard, WordEncoder, parse_shard, read_token_shards, shard_bytes, write_token_shards

DATA = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


# --- ids and files


def check_encoder(encoder, tokenizer, texts):
    ids, n = encoder.encode(texts, 2)
    expected = [encoded(tokenizer, t) for t in texts]
    assert n.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e.tolist()]


ENCODERS = {}


@settings(deadline=None)
@given(st.lists(st.text(st.sampled_from("abZ'sté ÀÿßŒœİſΣς́  \n\t\x0b\x1c<|>!.,0159٣漢字ｶﾞ🙂éÉ×÷"), max_size=40), max_size=4))
def test_words_encode_as_whole_texts_do(texts):
    tokenizer = Tokenizer.from_file(VOCABULARY) if not ENCODERS else ENCODERS["t"]
    encoder = ENCODERS.setdefault("e", WordEncoder(VOCABULARY))
    ENCODERS["t"] = tokenizer
    check_encoder(encoder, tokenizer, texts)


def test_plain_pieces_do_not_pass_the_normalizer(documents, tokenizer):
    encoder = WordEncoder(VOCABULARY)
    asked = []
    ask = encoder._ask
    encoder._ask = lambda strings: asked.append(strings) or ask(strings)
    check_encoder(encoder, tokenizer, ["It's Déjà-vu: ÀÉÎÕÜ ß×÷ÿ, 12 % of #1!", "ǅ word ｶﾞ"])
    assert sorted(asked[0]) == ["ǅ", "ｶﾞ"] and len(asked) == 1
    # where a model wants other strings, pieces go to the tokenizer
    encoder = WordEncoder(VOCABULARY)
    assert encoder.direct
    encoder.direct = False
    check_encoder(encoder, tokenizer, ["It's Déjà-vu: ÀÉÎÕÜ ß×÷ÿ, 12 % of #1!"])


@settings(deadline=None)
@given(st.lists(st.text(st.sampled_from("abstmdrevl'  \n\t,.01×÷ÀßÿœK<|\x1c\x85\xa0"), max_size=16), max_size=4))
def test_pieces_cut_in_arrays_are_those_of_the_rule(texts):
    for text in texts:
        found = tokens.cut([text, text], tokens._is_plain(text))
        assert [found.distinct[c] for c in found.codes] == 2 * tokens.pieces_of(text) and found.counts.tolist() == 2 * [len(found.codes) // 2]


def test_plain_texts_are_not_cut_one_by_one(documents, tokenizer, monkeypatch):
    encoder, asked = WordEncoder(VOCABULARY), []
    pieces_of = tokens.pieces_of
    monkeypatch.setattr(tokens, "pieces_of", lambda text: asked.append(text) or pieces_of(text))
    texts = [t for _, t in pairs(documents)][:40] + ["It's 'scool, we'll'll see: ÀÉ×÷ß 12%", "", "'re'd'", "ſ œ"]
    check_encoder(encoder, tokenizer, texts)
    assert set(asked) == {t for t in texts if any(ord(c) > 255 for c in t)} and "ſ œ" in asked


def test_encoder_keeps_what_it_reads_twice():
    encoder = WordEncoder(VOCABULARY, limit=8)
    encoder.encode(["often seen words here", "often seen"], 2)
    encoder.encode(["a b c d e f"], 2)
    encoder.encode(["some more"], 2)
    assert {"often", "seen"} <= set(encoder.pieces.place) and "b" not in encoder.pieces.place


def test_encoder_forgets_without_changing_ids(documents, tokenizer):
    texts = [t for _, t in pairs(documents)]
    small = WordEncoder(VOCABULARY, limit=50)
    for k in range(0, 60, 3):
        check_encoder(small, tokenizer, texts[k : k + 3])
    check_encoder(small, tokenizer, ["<|endoftext|> a<|startoftext|>b", "", "  ", "y" * 3000])


@settings(deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=300), st.integers(0, 60))
def test_elias_fano_round_trip(values, shift):
    values = np.array(sorted(v >> shift for v in values), np.int64)
    found = EliasFano.from_bytes(EliasFano.of(values).to_bytes())
    assert found.all().tolist() == values.tolist()
    assert [found[k] for k in range(len(values))] == values.tolist()


def test_elias_fano_is_small():
    bounds = np.cumsum(np.random.default_rng(1).integers(1, 3000, 100_000))
    assert len(EliasFano.of(bounds).to_bytes()) < 100_000 * (np.log2(1500) + 3) / 8


def test_shard_round_trip():
    ids = np.arange(10, dtype=np.uint16)
    names, bounds, back = parse_shard(shard_bytes(np.array([-5, 7, 7]), np.array([3, 0, 7]), ids))
    assert (names.all().tolist(), bounds.all().tolist(), back.tolist()) == ([-5, 7, 7], [0, 3, 3, 10], ids.tolist())
    with pytest.raises(ValueError):
        parse_shard(b"x" * 64)


def test_shard_reads_single_documents(tmp_path):
    rng = np.random.default_rng(2)
    lengths = rng.integers(0, 40, 700)
    ids, names = rng.integers(0, 60_000, int(lengths.sum())).astype(np.uint16), np.sort(rng.integers(-(2**63), 2**62, 700))
    (tmp_path / "s.tok").write_bytes(shard_bytes(names, lengths, ids))
    cuts = np.concatenate(([0], np.cumsum(lengths)))
    with pa_fs.LocalFileSystem().open_input_file(str(tmp_path / "s.tok")) as source:
        shard = Shard.open(source)
        for k in (0, 1, 63, 64, 65, 500, 699):
            name, own = shard.document(k)
            assert (name, own.tolist()) == (names[k], ids[cuts[k] : cuts[k + 1]].tolist())
        found = list(shard.runs(most=100))
    assert np.concatenate([d for d, _, _ in found]).tolist() == names.tolist()
    assert np.concatenate([i for _, _, i in found]).tolist() == ids.tolist()
    assert [c for _, cs, _ in found for c in cs[:-1]] == cuts[:-1].tolist()


@pytest.mark.parametrize("odd", [False, True])
def test_files_hold_every_document_in_order(spark, documents, tokenizer, tmp_path, odd):
    docs = odd_documents(spark) if odd else documents
    shards = write_token_shards(docs, str(tmp_path), VOCABULARY, shard_ids=3000, task_chars=50_000)
    found = [tuple(r) for r in read_token_shards(shards).collect()]
    assert len(list(tmp_path.glob("shard-*.tok"))) == shards.count() > 1
    expected, at = [], 0
    lists = defaultdict(list)
    for i, text in pairs(docs):
        lists[i].append(encoded(tokenizer, text))
    for i in sorted(lists, key=order):
        assert len({len(x) for x in lists[i]}) == 1
        for ids in lists[i]:
            expected.append((i, at, len(ids), crc(ids)))
            at += len(ids)
    assert sorted(found, key=lambda r: r[1]) == expected


def test_no_documents_no_files(spark, tmp_path):
    shards = write_token_shards(empty_documents(spark), str(tmp_path / "none"), VOCABULARY)
    assert read_token_shards(shards).count() == 0


def test_token_query(spark, documents, tokenizer):
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op3_token_files"](spark, DATA).collect()}
    at = 0
    for i, text in sorted(pairs(documents)):
        ids = encoded(tokenizer, text)
        assert found[i] == (at, len(ids), crc(ids))
        at += len(ids)


# --- packing


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(1, 400), st.integers(1, 9)), min_size=1, max_size=6), st.sampled_from([16, 32]))
def test_schedule_fills_every_place_once(queues, length):
    totals = [n for n, _ in queues]
    weights = [w for _, w in queues]
    schedule = Schedule(totals, weights, length)
    places = Counter()
    for q, n in enumerate(totals):
        at = 0
        while at < n:
            size = min(n - at, 7)
            covered = sorted(schedule.pieces(q, at, size))
            assert sum(p[1] for p in covered) == size
            for start, part, sequence, offset in covered:
                places.update((sequence, offset + k) for k in range(part))
            at += size
    assert set(places.values()) == {1}
    sizes = Counter(s for s, _ in places)
    for s, n in sizes.items():
        assert {o for t, o in places if t == s} == set(range(n))
        assert n == length or n & (n - 1) == 0


def check_pieces(found, docs, tokenizer, length=4096):
    own = Counter()
    expected = Counter((i, crc(encoded(tokenizer, t))) for i, t in pairs(docs))
    lists = defaultdict(list)
    for r in found:
        lists[r.doc_id].append(r)
    texts = defaultdict(list)
    for i, t in pairs(docs):
        texts[i].append(encoded(tokenizer, t))
    for i, pieces in lists.items():
        for ids in texts[i]:
            own[i, crc(ids)] += 1
        total = sum(p.length for p in pieces)
        assert total == sum(map(len, texts[i]))
        for p in pieces:
            assert any(len(x) == p.doc_tokens and crc(x[p.start : p.start + p.length]) == p.ids_crc32 for x in texts[i])
    assert own == expected
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length and (at == length or at & (at - 1) == 0)
    return sequences


def test_packing_query_keeps_proportions(spark, documents, tokenizer):
    found = QUERIES["op5_packing"](spark, DATA).collect()
    sequences = check_pieces(found, documents, tokenizer)
    totals = Counter()
    for r in found:
        totals[r.source] += r.length
    whole = sum(totals.values())
    for pieces in sequences.values():
        if sum(p.length for p in pieces) == 4096:
            own = Counter()
            for p in pieces:
                own[p.source] += p.length
            assert all(abs(own[s] - 4096 * n / whole) < 2 for s, n in totals.items())


def test_packing_by_weights(spark, documents, tokenizer):
    docs = documents.where("source in ('src0', 'src1', 'src2')")
    found = pack(docs, VOCABULARY, length=256, weights={"src0": 2, "src1": 1, "src2": 1}).collect()
    sequences = check_pieces(found, docs, tokenizer, 256)
    own = Counter()
    for p in sequences[0]:
        own[p.source] += p.length
    assert own == {"src0": 128, "src1": 64, "src2": 64}


@pytest.mark.parametrize("length", [4096, 4])
def test_packing_of_odd_documents(spark, tokenizer, length):
    docs = odd_documents(spark)
    check_pieces(pack(docs, VOCABULARY, length=length).collect(), docs, tokenizer, length)
    assert pack(empty_documents(spark), VOCABULARY).count() == 0


# --- mixing


def sizes(docs):
    return [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()]


@pytest.mark.parametrize(("odd", "block"), [(False, 1024), (False, 64), (True, 16)])
def test_mix_reaches_its_targets(spark, documents, odd, block):
    docs = odd_documents(spark) if odd else documents
    small = MixSettings(block_words=block, bucket_rows=20)
    found = words_taken(mix_sources(sized_rows(docs), small)).collect()
    rows = sizes(docs)
    assert Counter((r.doc_id, r.source, r["size"]) for r in found) == Counter(rows)
    totals = Counter()
    for _, source, n in rows:
        totals[source] += n
    expected = targets(dict(totals))
    taken = Counter()
    for r in found:
        assert r.source_size == totals[r.source]
        assert r.target == pytest.approx(expected[r.source])
        assert r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s, n in expected.items():
        assert abs(taken[s] - n) <= 1
    again = words_taken(mix_sources(sized_rows(docs), small)).collect()
    assert Counter((r.doc_id, r.taken) for r in found) == Counter((r.doc_id, r.taken) for r in again)


def test_limits_are_reshared(spark):
    rows = [(k, k, s, n) for k, (s, n) in enumerate([("a", 10), ("b", 100), ("c", 1000), (None, 0), ("d", 30)])]
    table = source_targets(spark.createDataFrame(rows, "row long, doc_id long, source string, size long"), MixSettings())
    found = {r.source: r.target for r in table.collect()}
    assert found == pytest.approx(targets({"a": 10, "b": 100, "c": 1000, None: 0, "d": 30}))
    assert found["a"] == 30 and found[None] == 0


def test_slots_are_spread(spark, documents):
    mix = mix_sources(sized_rows(documents), MixSettings(block_words=32))
    plan = mix.plan.join(mix.rows.select("row", "source", "target"), "row")
    slots = plan.select("slot", "source", "target").distinct().orderBy("slot").collect()
    share = {r.source: r.target for r in slots}
    whole = sum(share.values())
    half = Counter(r.source for r in slots[: len(slots) // 2])
    assert all(abs(half[s] - len(slots) / 2 * n / whole) < 6 for s, n in share.items())


def test_mixed_documents(spark, documents):
    for docs in (documents, odd_documents(spark)):
        out = mixed_documents(docs)
        assert out.dtypes == docs.dtypes
        expected = Counter()
        for r in words_taken(mix_sources(sized_rows(docs))).collect():
            expected[r.doc_id] += r.taken
        own = Counter()
        for i, text in pairs(out):
            own[i] += len(WORD.findall(text))
        assert +own == +expected
    assert mixed_documents(empty_documents(spark)).count() == 0


def test_mixed_documents_follow_the_schedule(spark, documents):
    small = MixSettings(block_words=32)
    mix = mix_sources(sized_rows(documents), small)
    first = mix.plan.groupBy("row", "epoch").agg(F.min("slot").alias("slot")).join(mix.rows.select("row", "doc_id", "source"), "row").collect()
    expected = sorted(first, key=lambda r: (r.slot, r.epoch, r.row))
    assert [r.doc_id for r in mixed_documents(documents, small).collect()] == [r.doc_id for r in expected]
    least = {}
    for r in expected:
        least.setdefault(r.doc_id, r.slot)
    found = words_taken(mix).collect()
    assert {r.doc_id: r.first_slot for r in found if r.taken} == least
    assert all((r.first_slot is None) == (r.taken == 0) for r in found)
    assert "first_slot" in QUERIES["op9_source_mix"](spark, DATA).columns


def test_mix_runs_without_python(spark):
    plan = QUERIES["op9_source_mix"](spark, DATA)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# --- neighbours


def brute_neighbours(rows, asked, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for n, (i, v) in enumerate(good):
        if asked(i):
            scores = [
                (-float(v @ w) / float(np.linalg.norm(v) * np.linalg.norm(w)), j) for m, (j, w) in enumerate(good) if m != n and len(w) == len(v)
            ]
            out.setdefault(i, []).append(sorted(scores)[:k])
    return out


def test_chi_square():
    assert chi_square_cdf(chi_square_limit(0.95, 8), 8) == pytest.approx(0.95)
    assert chi_square_limit(0.95, 8) == pytest.approx(15.507, abs=1e-3)


def test_tree_gives_points_by_distance():
    points = np.random.default_rng(0).standard_normal((500, 4))
    points[100:300] = points[100]
    tree, at = KdTree(points, 16), np.zeros(4)
    seen = []
    for bound, rows in tree.by_distance(at):
        assert len(rows) <= 1024
        assert ((points[rows] ** 2).sum(axis=1) >= bound - 1e-12).all()
        seen += rows.tolist()
    far = (points[seen] ** 2).sum(axis=1)
    assert (np.diff(far) >= -1e-12).all()
    assert sorted(seen) == list(range(500))
    assert sum(len(np.intersect1d(rows, np.arange(100, 300))) > 0 for rows in tree.rows) == 1


@pytest.mark.parametrize("limits", [AnnSettings(), AnnSettings(shard_rows=100, query_rows=3, leaf=8)])
def test_neighbours_have_the_recall(spark, limits):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    found = nearest_neighbours(table, F.col("vec_id") % 50 == 0, limits).collect()
    expected = brute_neighbours([(r.vec_id, r.embedding) for r in table.collect()], lambda i: i % 50 == 0)
    hits = 0
    for i, (best,) in expected.items():
        own = sorted((r for r in found if r.query_id == i), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(best) + 1))
        hits += len({r.vec_id for r in own} & {j for _, j in best})
        scores = {j: -s for s, j in brute_neighbours([(r.vec_id, r.embedding) for r in table.collect()], lambda x, i=i: x == i, 10**6)[i][0]}
        for r in own:
            assert r.score == pytest.approx(scores[r.vec_id], abs=1e-12)
    assert hits >= 0.9 * 5 * len(expected)


@pytest.mark.parametrize("limits", [AnnSettings(), AnnSettings(shard_rows=150, query_rows=7, leaf=8)])
def test_ties_go_to_the_smaller_id(spark, limits):
    """Half of the rows hold one vector, others lie in pairs of opposite offsets that tie."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(1200):
        if k % 2:
            rows.append((k, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0]))
        elif k % 4 == 0:
            rows.append((k, [1.0, 1.0, 4.0 if k % 8 else -4.0, 0.0, 0.0, 0.0]))
        else:
            rows.append((k, rng.standard_normal(6).tolist()))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found = defaultdict(list)
    for r in nearest_neighbours(table, F.col("vec_id") % 25 == 0, limits).collect():
        found[r.query_id].append((r["rank"], r.vec_id))
    expected = brute_neighbours(rows, lambda i: i % 25 == 0)
    for i in range(0, 1200, 25):
        own = [j for _, j in sorted(found[i])]
        if i % 2 or i % 4 == 0:
            assert own == [j for _, j in expected[i][0]]
        else:
            assert len(own) == 5
    assert sorted(found[25]) == [(1, 1), (2, 3), (3, 5), (4, 7), (5, 9)]


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]),
        (8, [1.0, 1.0]), (9, [1.0, 0.0]), (None, [1.0, 0.0]), (50, [3e200, 3e200]), (50, [1.0, 1.0]), (100, [1.0, 2.0, 3.0]), (11, []),
    ]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, shard int")
    found = defaultdict(list)
    for r in nearest_neighbours(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, round(r.score, 9)))
    half = round(0.5**0.5, 9)
    assert found[0] == [(1, 1.0), (9, 1.0), (8, half), (50, half), (50, half)]
    assert sorted(found[50]) == sorted(2 * [(8, 1.0), (50, 1.0), (0, half), (1, half), (2, half)])
    assert set(found) == {0, 50}
    assert nearest_neighbours(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
