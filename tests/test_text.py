import random
import time

from conftest import rows
from pyspark.sql import functions as F

from policyloom import lexicons as lx
from policyloom.functions import text as tx


def flags(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_header_lines(spark):
    lines = ["# Title", "1.2. Scope", "Article 5 Duties", "INTRODUCTION", "annex 3", "ab", "12 monkeys", "#nothash", "Plain prose here"]
    loose = flags(spark, lines, tx.is_header_line(F.col("t")))
    strict = flags(spark, lines, tx.is_header_line(F.col("t"), strict_caps=True))
    assert loose == [True, True, True, True, True, False, False, False, True]
    assert strict == [True, True, True, True, True, False, False, False, False]


def test_fragments(spark):
    fragments = ["Explainability15", "Accountability 6, 12", "Data Governance", "", None, "  "]
    sentences = [
        "The policy establishes an ethics board.", "Ministries publish yearly reports in 2024 and later",
        "It covers: scope", "This text was published in 2024 by the national council for everyone to read",
    ]
    assert flags(spark, fragments, tx.is_fragment(F.col("t"))) == [True] * 6
    assert flags(spark, sentences, tx.is_fragment(F.col("t"))) == [False] * 4


def test_preamble(spark):
    df = spark.createDataFrame(
        [("x" * 280, 85), ("x" * 280, 1), ("x" * 450, 1), ("x" * 160 + " table of contents", 9), ("short", 50), ("y" * 200, None)],
        "t string, p int",
    )
    assert [r[0] for r in df.select(tx.is_preamble(F.col("t"), F.col("p"))).collect()] == [False, True, False, True, True, True]


def test_keywords_are_whole_words_with_plural(spark):
    got = flags(spark, ["the boards met", "a keyboard", "task force", "taskforce", "Agencies"], tx.has_keyword(F.col("t"), lx.NAMED_BODY))
    assert got == [True, False, True, False, True]


def test_commitment_negation(spark):
    texts = [
        "the government will establish a council", "it will not support this", "no dedicated programme exists",
        "lacks a dedicated programme", "programming and roadmapping", "not committed to reform",
        "we never pledge but later pledge again fully", "cannot launch a mission",
    ]
    phrases = (*lx.STRONG_COMMITMENT, *lx.COMMITMENT_VERBS)
    got = flags(spark, texts, tx.has_commitment(F.col("t"), phrases))
    assert got == [True, False, False, True, False, False, True, True]


def brute_commitment(text, phrases):
    import re

    for phrase in phrases:
        for m in re.finditer(r"\b" + re.escape(phrase) + r"s?\b", text):
            before = text[max(0, m.start() - 16):m.start()].split()[-2:]
            if not any(w in lx.NEGATORS for w in before):
                return True
    return False


def test_commitment_matches_brute_force(spark):
    import itertools
    import random

    random.seed(3)
    words = ["not", "no", "cannot", "to", "establish", "a", "will", "create", "plan", "the", "program", "programs", "x"]
    texts = [" ".join(random.choices(words, k=random.randint(1, 9))) for _ in range(300)]
    texts += ["annot establish a", "  not   to establish a", "no\nplan to establish the"]
    got = flags(spark, texts, tx.has_commitment(F.col("t"), lx.STRONG_COMMITMENT))
    assert got == [brute_commitment(t, lx.STRONG_COMMITMENT) for t in texts]
    assert len(set(got)) == 2 and list(itertools.chain(got))


def test_topics(spark):
    df = spark.createDataFrame(
        [("Redress and liability", "Accountability"), ("an events calendar", "Accountability"), ("anything", "Unknown")],
        "t string, d string",
    )
    assert [r[0] for r in df.select(tx.on_topic(F.col("t"), F.col("d"))).collect()] == [True, False, True]


def test_foreign(spark):
    french = "le rapport et la loi des pays dans le cadre de la politique pour les citoyens avec une vision"
    english = "the report and the law of the land in a frame for the people with a vision of the future le la"
    assert flags(spark, [french, english, "le la les"], tx.is_foreign(F.col("t"))) == [True, False, False]


def test_sentinels(spark):
    df = spark.createDataFrame(
        [("Insufficient evidence for citation.", ""), ('"N/A"', "q"), ("abc-1", "insufficient evidence of X was found"),
         ("abc-1", "None."), ("abc-1", "real")], "c string, q string",
    )
    assert [r[0] for r in df.select(tx.is_no_citation(F.col("c"), F.col("q"))).collect()] == [True, True, False, True, False]


def test_roles_and_overlap(spark):
    df = spark.createDataFrame([("a, b",), ("",), ("b",), (None,)], "r string")
    assert [r[0] for r in df.select(tx.has_role(tx.parse_roles(F.col("r")), ["a"])).collect()] == [True, False, False, False]
    pair = spark.createDataFrame([("Human oversight of systems", "oversight of human beings"), ("a b", "b"), ("", "x")], "c string, t string")
    assert [round(r[0], 3) for r in pair.select(tx.keyword_overlap(F.col("c"), F.col("t"))).collect()] == [0.75, 0.5, 0.0]


def test_negation_is_substring_unless_whole_word(spark):
    texts = ["innovation", "do not", "clear"]
    assert flags(spark, texts, tx.has_negation(F.col("t"))) == [True, True, False]
    assert flags(spark, texts, tx.has_negation(F.col("t"), whole_word=True)) == [False, True, False]


def test_document_types(spark):
    assert flags(spark, ["A national roadmap", "The regulation", "Ethics code", "guideline", "Framework X", "poem"],
                 tx.document_type(F.col("t"))) == ["strategy", "legislation", "code_of_conduct", "standard", "standard", "other"]


def test_many_terms_are_found_like_few(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abÀ") for _ in range(rng.randint(1, n)))
    cases = [(" ".join(word(5) for _ in range(rng.randint(33, 90))), " ".join(word(7) for _ in range(rng.randint(0, 60)))) for _ in range(60)]
    cases += [(cases[0][0], cases[0][0]), (cases[0][0], None), (cases[0][0], "")]
    df = spark.createDataFrame(cases, "claim string, text string")
    terms = tx.words(F.lower("claim"))
    got = df.select(tx._count_many(F.col("text"), terms), tx.count_contained(F.col("text"), terms)).collect()
    assert all(a == b for a, b in got) and len({a for a, _ in got}) > 9


def test_own_text_takes_no_quadratic_time(spark):
    text = " ".join(f"word{k}" for k in range(60_000))
    started = time.monotonic()
    assert spark.createDataFrame([(text,)], "t string").select(tx.keyword_overlap(F.col("t"), F.col("t"))).first()[0] == 1.0
    assert time.monotonic() - started < 6
