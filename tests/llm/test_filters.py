import random
import re
import string

import numpy as np
import pytest
from plain import empty_documents, odd_documents, pairs, quality_base
from pyspark.sql import functions as F

from policyloom.llm.licenses import TEMPLATES, LicenseSettings, Shingles, _window_minima, scan_licenses, word_hashes
from policyloom.llm.quality import BANDS, good_documents, quality
from policyloom.llm.queries import QUERIES, URL_RULES
from policyloom.llm.urls import Rule, Vocabulary, url_verdict

DATA = "/root/testdata/sf0.001"


# --- quality


def judged(docs, **settings):
    return docs.select("doc_id", "text", quality(F.col("text"), **settings).alias("q")).select("doc_id", "text", "q.*").collect()


@pytest.mark.parametrize("odd", [False, True])
def test_counts_match_the_rules(spark, odd):
    docs = odd_documents(spark) if odd else spark.read.parquet(f"{DATA}/documents.parquet")
    for r in judged(docs):
        base = quality_base(r.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base
        assert not (r.kept and r.base_failed)


def test_bands_reject_filler_and_noise_and_keep_prose(spark):
    prose = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) > 2000").orderBy("doc_id").first().text
    noise = "".join(chr(33 + (k * k * 7919 + k * 104729) % 90) + (" " if k % 9 == 8 else "") for k in range(6000))
    filler = " ".join(f"item {k % 40} of the list {k % 37}" for k in range(1500))
    half = prose[:2000] + " " + "na" * 60_000
    docs = spark.createDataFrame([(1, prose), (2, noise), (3, filler), (4, half), (5, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in judged(docs)}
    assert found[1].kept
    assert found[3].ratio > 5 and not found[3].kept
    assert found[4].n_chunks_outside > found[4].n_chunks / 2 and not found[4].kept
    assert (found[5].n_words, found[5].ratio, found[5].kept) == (0, 1.0, False)
    assert found[2].n_chunks == len(noise.encode()) // 4096


def test_noise_of_any_length_is_rejected(spark):
    draw = random.Random(5)

    def noise(letters, n, width=8):
        return " ".join("".join(draw.choices(letters, k=width)) for _ in range(n // (width + 1)))

    longest = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy(F.length("text"), "doc_id").collect():
        if r.text and not quality_base(r.text)[5]:
            longest[r.lang] = r.text
    prose = sorted((longest[x] for x in ("en", "de", "fr", "es")), key=len, reverse=True)
    assert len(prose[0]) > 16_000 and len(prose[-1]) > 4_000
    sixty_four = string.ascii_letters + string.digits + "+/"
    line = "Read more of our offers on the next page of this site today\n"
    first = prose[0].encode()[: 3 * 4096].decode("utf-8", "ignore")
    bad = [
        noise("0123456789abcdef", 20_000), noise("0123456789abcdef", 7_000, 32), noise(sixty_four, 539), noise(sixty_four, 900),
        noise(sixty_four, 20_000), noise(string.ascii_lowercase, 5_000), first + "\n" + line * 120, first + " " + noise(sixty_four, 3_500),
        first + "\n" + line * 50, " ".join(prose) + " " + noise(sixty_four, 12_000),
    ]
    good = [*prose, *(p[:n] for p in prose for n in (700, 1_200, 2_000, 4_000, 5_000, 9_000)), prose[0][:16_000] + "\n" + line * 5]
    docs = spark.createDataFrame(list(enumerate(bad + good)), "doc_id long, text string")
    found = {r.doc_id: r for r in judged(docs)}
    assert not any(r.base_failed for r in found.values())
    assert [k for k in range(len(bad)) if found[k].kept] == []
    assert [k for k in range(len(bad), len(found)) if not found[k].kept] == []
    assert found[7].n_chunks_outside == 0 and 3_000 < found[7].n_bytes_outside < 4_096


def test_other_scripts_have_their_own_bands(spark):
    draw = random.Random(6)
    words = ["".join(draw.choices("अआइउकखगचजटडतदनपबमयरलवसह", k=draw.randint(2, 7))) for _ in range(300)]
    docs = spark.createDataFrame([(1, " ".join(draw.choices(words, k=1500)))], "doc_id long, text string")
    assert judged(docs)[0].kept


def test_good_documents_keep_columns(spark):
    docs = odd_documents(spark)
    out = good_documents(docs)
    assert out.dtypes == docs.dtypes
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in judged(docs) if r.kept}
    assert good_documents(empty_documents(spark)).count() == 0
    assert [b.least for b in BANDS] == sorted(b.least for b in BANDS)


# --- addresses


def verdicts(spark, urls, rules=URL_RULES, vocabulary=Vocabulary()):
    docs = spark.createDataFrame([(u,) for u in urls], "url string")
    return [tuple(r.v) for r in docs.select(url_verdict(F.col("url"), rules, vocabulary).alias("v")).collect()]


def test_hosts_paths_and_longest_rule(spark):
    found = verdicts(spark, [
        "http://A.example.COM/en/x?q#f", "https://www.example.com/en/", "https://example.com/EN/", "https://notexample.com/en/a",
        "http://x.net/es", "http://x.net/es/", "no address", None, "", "a://b://c/d", "http://h?x://y/z", "https://com/",
    ])
    assert [f[:4] for f in found] == [
        ("a.example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("example.com", "/EN/", "com/", "allow"), ("notexample.com", "/en/a", "com/", "allow"),
        ("x.net", "/es", None, "allow"), ("x.net", "/es/", "net/es/", "block"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("h", "", None, "allow"), ("com", "/", "com/", "allow"),
    ]


def test_vocabulary_counts_terms_at_boundaries(spark):
    words = Vocabulary(strict=("casino",), soft=("bet", "win", "free"), soft_hits=2)
    found = verdicts(spark, [
        "http://x.org/casino", "http://x.org/casinos", "http://x.org/Bet/bet", "http://x.org/bet-WIN", "http://x.org/alphabet_win",
        "casino.org",
    ], (), words)
    assert [(f[3], f[4], f[5]) for f in found] == [
        ("block", 1, 0), ("allow", 0, 0), ("allow", 0, 1), ("block", 0, 2), ("allow", 0, 1), ("block", 1, 0),
    ]
    assert verdicts(spark, ["http://casino.org/"], (Rule("org/", "allow"),), words)[0][2:4] == ("org/", "allow")
    assert verdicts(spark, ["http://casino.org/"], (), Vocabulary((), ()))[0][3] == "allow"


def test_url_query_matches_plain_rules(spark):
    words = Vocabulary()

    def plain(url):
        parts = re.match(r"(?s)^(?:(?!://).)*://([^/?#]*)([^?#]*)", url or "")
        host, path = (parts[1].lower(), parts[2]) if parts else ("", "")
        fits = [r for r in URL_RULES for h, _, p in [r.rule.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        best = max(fits, key=lambda r: len(r.rule), default=None)
        hits = [
            sum(bool(re.search(rf"(?<![0-9a-z]){re.escape(t)}(?![0-9a-z])", (url or "").lower())) for t in terms)
            for terms in (words.strict, words.soft)
        ]
        verdict = best.verdict if best else "block" if hits[0] or hits[1] >= words.soft_hits else "allow"
        return host, path, best.rule if best else None, verdict

    pages = {r.page_id: r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    found = QUERIES["op7_url_filters"](spark, DATA).collect()
    assert len(found) == len(pages)
    for r in found:
        assert (r.host, r.path, r.rule, r.verdict) == plain(pages[r.page_id])


# --- licenses

_ALNUM = re.compile(rb"[0-9a-z\x80-\xff]+")


def contained(text, percent=80):
    def parts(t):
        words = _ALNUM.findall(t.encode().lower())
        return [tuple(words[k : k + 5]) for k in range(len(words) - 4)]

    own, out = parts(text), []
    for name, texts in TEMPLATES.items():
        for k, template in enumerate(texts):
            wanted = set(parts(template))
            common = wanted & set(own)
            if wanted and 100 * len(common) >= percent * len(wanted):
                out.append((name, k, len(common), len(wanted), min(own.index(c) for c in common)))
    return out


def test_licenses_match_containment(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    expected = [(i, *m) for i, t in pairs(docs) for m in contained(t)]
    found = [tuple(r) for r in QUERIES["op1_license_scans"](spark, DATA).collect()]
    assert sorted(found) == sorted(expected)
    assert found


def test_licenses_in_odd_documents(spark):
    notices = [t for texts in TEMPLATES.values() for t in texts]
    extra = [(100 + k, f"Before it. {t.upper()} After it {'word ' * (k * 3)}", None, None, None, None, None, None, None) for k, t in enumerate(notices)]
    extra.append((200, "x " * 50_000 + notices[-1] + " y" * 50_000, None, None, None, None, None, None, None))
    odd = odd_documents(spark)
    docs = odd.unionByName(spark.createDataFrame(extra, odd.schema))
    expected = [(i, *m) for i, t in pairs(docs) for m in contained(t)]
    found = [tuple(r) for r in scan_licenses(docs).collect()]
    assert sorted(found) == sorted(expected)
    assert {r[0] for r in found} >= {100 + k for k in range(len(notices))} | {200}
    assert scan_licenses(empty_documents(spark)).count() == 0


def test_short_notices_are_found(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([
        (1, "ALL RIGHTS  reserved"), (2, "a b c d e f g. All rights reserved. h"), (3, "all rights are reserved"), (4, "rights reserved all"),
        (5, "all rights"), (6, "x " * 40_000 + "All rights, reserved."), (7, None), (8, "Copyleft"), (9, TEMPLATES["mit"][0] + " All rights reserved."),
    ], schema)
    found = sorted(tuple(r) for r in scan_licenses(docs).collect())
    assert found == [
        (1, "all-rights-reserved", 0, 1, 1, 0), (2, "all-rights-reserved", 0, 1, 1, 7), (6, "all-rights-reserved", 0, 1, 1, 40_000),
        (9, "all-rights-reserved", 0, 1, 1, 5), (9, "mit", 0, 1, 1, 0),
    ]
    own = {"a": ("Copyleft", "rights reserved", "..."), "b": ("all rights are reserved",)}
    found = sorted(tuple(r)[:3] for r in scan_licenses(docs, own).collect())
    assert found == [(1, "a", 1), (2, "a", 1), (3, "b", 0), (4, "a", 1), (6, "a", 1), (8, "a", 0), (9, "a", 1)]
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    reserved = {i for i, t in pairs(documents) if re.search(r"(?i)\ball rights reserved\b", t)}
    assert reserved and reserved == {r.doc_id for r in scan_licenses(documents).where("license = 'all-rights-reserved'").collect()}


def test_windows_meet_as_often_as_promised():
    limits = LicenseSettings()
    assert (7 / 8) ** limits.coordinates <= limits.miss < (7 / 8) ** (limits.coordinates - 1)
    # notices of one shingle, each followed by another one, and texts that begin with them
    notices = [f"work{k} under the MIT License" for k in range(2000)]
    texts = [f"{notice} " + " ".join(f"w{k}x{j}" for j in range(40)) for k, notice in enumerate(notices)]
    own, found = (Shingles(*word_hashes(t), 5, 4) for t in (notices, texts))
    at, first = own.first[:-1] // 4, found.first[:-1] // 4
    met = np.array([_window_minima(found, row, 4)[first] == _window_minima(own, row, 4)[at] for row in range(limits.coordinates)])
    each = met.sum(axis=0)
    assert abs(met.mean() - 1 / 8) < 0.004
    assert each.min() > 0
    assert abs(each.var() / (limits.coordinates * 7 / 64) - 1) < 0.25
