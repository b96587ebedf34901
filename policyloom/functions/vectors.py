"""Vector columns: norms, cosine, and the pluggable embedding function."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from policyloom.functions import runs

DIMENSIONS = 384
_WORDS = re.compile(r"[a-z0-9ß-ÿ]+")
_WORD_CHARS = runs.table([*"abcdefghijklmnopqrstuvwxyz0123456789", *map(chr, range(0xDF, 0x100))])
#: Characters of texts whose words are held at once.
GROUP_CHARS = 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit vector; the zero vector stays as it is."""
    norm = l2_norm(v)
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def cosine(a: Column, b: Column) -> Column:
    norm = l2_norm(a) * l2_norm(b)
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def similarity_from_distance(distance: Column) -> Column:
    """Cosine distance 0..2 to similarity 1..0."""
    return F.greatest(F.lit(0.0), 1 - distance / 2)


def round_half_up(values: np.ndarray, digits: int = 6) -> np.ndarray:
    scale = 10.0**digits
    return np.floor(values * scale + 0.5) / scale


class _Slots(dict):
    """The slot of each word, worked out when it is first asked for."""

    def __init__(self, dims: int):
        super().__init__()
        self.dims = dims

    def __missing__(self, token: str) -> int:
        slot = self[token] = int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % self.dims
        return slot


def token_counts(texts, dims: int, slots: _Slots | None = None) -> np.ndarray:
    """Bag of hashed words: one row of counts per text."""
    slots = _Slots(dims) if slots is None else slots
    counts = np.zeros((len(texts), dims))
    rows, raws, held = [], [], 0
    for row, text in enumerate(texts):
        raw = runs.latin(text or "")
        if raw is None:  # the words of one text at a time, however long texts are
            words = _WORDS.findall(text.lower())
            counts[row] = np.bincount(np.fromiter(map(slots.__getitem__, words), np.int64, len(words)), minlength=dims)
            continue
        if raws and held + len(raw) > GROUP_CHARS:
            counts[rows] = _group_counts(raws, dims, slots)
            rows, raws, held = [], [], 0
        rows.append(row)
        raws.append(raw)
        held += len(raw)
    if raws:
        counts[rows] = _group_counts(raws, dims, slots)
    return counts


def _group_counts(raws: list[bytes], dims: int, slots: _Slots) -> np.ndarray:
    """``token_counts`` of texts of Latin-1: each distinct word of theirs is looked up once."""
    found = runs.words(raws, _WORD_CHARS)
    picked = np.fromiter(map(slots.__getitem__, found.distinct), np.int64, len(found.distinct))[found.codes]
    places = np.repeat(np.arange(len(raws)) * dims, found.counts) + picked
    return np.bincount(places, minlength=len(raws) * dims).reshape(len(raws), dims)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


BatchEmbedder = Callable[[list], np.ndarray]


class HashingEmbedder:
    """Default embedder: deterministic, no model needed, unit length.

    Words that have been met stay known between batches, up to ``limit`` of them; all embedders of a process share them,
    as a worker meets a new one in each query and keeps the last few.
    """

    _known: dict[int, _Slots] = {}

    def __init__(self, dims: int = DIMENSIONS, limit: int = 500_000):
        self.dims, self.limit = dims, limit

    def __getstate__(self) -> dict:
        return {"dims": self.dims, "limit": self.limit}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def __call__(self, texts) -> np.ndarray:
        slots = self._known.setdefault(self.dims, _Slots(self.dims))
        if len(slots) > self.limit:
            slots.clear()
        return unit_rows(token_counts(texts, self.dims, slots))


def embed_with(embedder: BatchEmbedder) -> Callable[[Column], Column]:
    """Wrap any batch embedder (a model, say) as a Column function."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(embedder(batch.tolist())))

    return lambda text: run(text)


def batch_embed(make_model: Callable[[], BatchEmbedder] = HashingEmbedder, batch_size: int = 256) -> Callable[[Column], Column]:
    """A model as a Column function for batch inference: a worker builds it once and keeps it for all its tasks.

    A null text counts as the empty one.
    """

    def make() -> Callable[[np.ndarray], np.ndarray]:
        model = make_model()
        return lambda texts: np.asarray(model(list(texts)), dtype=np.float64)

    run = predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=batch_size)
    return lambda text: run(F.coalesce(text, F.lit("")))


def embed(text: Column, dims: int = DIMENSIONS) -> Column:
    """Hashed bag-of-words embedding of a text column."""
    return embed_with(HashingEmbedder(dims))(text)


def score_pairs_with(scorer: Callable[[list, list], np.ndarray]) -> Callable[[Column, Column], Column]:
    """Wrap a pair scorer (cross-encoder, entailment model) as a Column function."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series(np.asarray(scorer(left.tolist(), right.tolist()), dtype=float))

    return lambda a, b: run(a, b)
