"""Plain versions of the operators, for small tables, and a table of odd documents."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, label int, `from` string"


def rng_words(seed, n, vocabulary=4000):
    numbers = np.random.default_rng(seed).integers(0, vocabulary, n)
    return [f"w{x}é" if x % 7 == 0 else f"Word{x}" for x in numbers]


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and columns of clashing names."""
    base = rng_words(1, 120)
    near = list(base)
    near[60] = "changed"
    passage = " ".join(rng_words(2, 60))
    long_text = " ".join(rng_words(3, 30_000, 50_000))
    texts = [
        (7, " ".join(base), "a"), (3, " ".join(near), "a"), (9, " ".join(base), "b"), (9, " ".join(base), "b"),
        (1, None, "b"), (2, "", None), (4, " \n\t ", "a"), (None, passage + "\nown tail of a row without an id", "c"),
        (5, "start here " + passage + " end here", "c"), (6, "other start " + passage, None), (8, long_text, "b"),
        (10, "one", "c"), (11, "two words", "c"), (12, "la " * 400, "a"), (13, "x" * 5000, "a"), (14, "ünï€ " * 100, "a"),
        (15, "same line of text\n" * 30, "b"), (16, "nul\x00byte \x1f and <|endoftext|> 's don't ÀÉ ß", "b"), (17, "two words", "c"),
    ]
    rows = [(i, t, None if k % 3 else "en", s, None if t is None else len(t), k, None, None, "x") for k, (i, t, s) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def order(doc_id):
    return (doc_id is not None, doc_id or 0)


def shingles(text, width):
    words = WORD.findall(text.translate(FOLD))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def near_components(documents, width, percent):
    """(doc_id, shingles, component) of each row; rows of one id are one node."""
    sets = [(i, shingles(t, width)) for i, t in documents]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    by_shingle = defaultdict(list)
    for k, (i, own) in enumerate(sets):
        common = Counter(j for s in own for j in by_shingle[s])
        for s in own:
            by_shingle[s].append(k)
        for j, c in common.items():
            if 100 * c >= percent * (len(own) + len(sets[j][1]) - c):
                a, b = sorted((root(i), root(sets[j][0])), key=order)
                up[b] = a
    return [(i, len(own), root(i)) for i, own in sets]


def substring_result(documents, width=20):
    seen, out = set(), []
    for i, text in sorted(documents, key=lambda x: (order(x[0]), x[1])):
        words, gone = WORD.findall(text), set()
        for k in range(len(words) - width + 1):
            window = tuple(words[k : k + width])
            if window in seen:
                gone |= set(range(k, k + width))
            seen.add(window)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def suffix_masks(documents, length=200):
    raw = [t.encode() for _, t in documents]
    counts = Counter(r[k : k + length] for r in raw for k in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, int)
        for k in range(len(r) - length + 1):
            if counts[r[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        out.append(np.cumsum(gone)[:-1] > 0)
    return raw, out


def suffix_result(documents, length=200):
    out = []
    for (i, _), r, gone in zip(documents, *suffix_masks(documents, length), strict=True):
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(r), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def quality_base(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    repeated = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    failed = n < 50 or 100 * len(repeated) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


def encoded(tokenizer, text, end=2):
    return np.array([*tokenizer.encode(text, add_special_tokens=False).ids, end], "<u4")


def crc(ids):
    return zlib.crc32(ids.astype("<u4").tobytes())


def targets(sizes, weights=(5, 2, 1), epochs=3):
    """Reshare what is above a limit until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        left, whole = total - sum(full.values()), sum(weight[s] for s in free)
        found = {s: left * weight[s] / whole for s in free}
        above = {s: float(epochs * sizes[s]) for s in free if found[s] > epochs * sizes[s]}
        if not above:
            return full | found
        full |= above
