"""Quality rules: how far a text can be compressed, beside its counts of words, symbols and repeats."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policyloom.llm.arrays import Words, covered, mix, split_frames, windows

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Band:
    """Texts of ``least`` bytes or more pass with a ratio (bytes to compressed bytes) from ``low`` to ``high``."""

    least: int
    low: float
    high: float


#: Just outside what clean prose of each length gives, in four languages and in dense technical English: random letters,
#: encoded bytes and, from 6,000 bytes on, random hex stay below; repeated lines and filler are above.
BANDS = (
    Band(0, 0.0, 2.5), Band(200, 1.05, 2.6), Band(400, 1.15, 2.7), Band(500, 1.23, 2.7), Band(600, 1.3, 2.8), Band(1000, 1.4, 2.8),
    Band(1500, 1.52, 2.8), Band(2500, 1.66, 2.9), Band(4000, 1.78, 3.0), Band(6000, 1.92, 3.1), Band(10000, 2.0, 3.2),
    Band(16000, 2.1, 3.5), Band(40000, 2.2, 4.0),
)
#: For what is mostly bytes above 127: letters of two and three bytes compress otherwise, and by how much they write.
WIDE_BANDS = (
    Band(0, 0.0, 4.0), Band(200, 1.05, 3.0), Band(600, 1.35, 3.5), Band(1500, 1.5, 4.0), Band(4000, 1.6, 4.5),
    Band(16000, 1.7, 5.0),
)
FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "ratio double, n_chunks long, n_chunks_outside long, n_bytes_outside long, kept boolean"
)


def _outside(sizes: np.ndarray, ratios: np.ndarray, bands: Sequence[Band]) -> np.ndarray:
    of = np.searchsorted([b.least for b in bands], sizes, "right") - 1
    low, high = np.array([b.low for b in bands])[of], np.array([b.high for b in bands])[of]
    return (ratios < low) | (ratios > high)


@dataclass(frozen=True)
class Limits:
    """Bands for texts and their parts, and the share of a text's bytes that may lie in parts outside theirs."""

    bands: Sequence[Band] = BANDS
    wide_bands: Sequence[Band] = WIDE_BANDS
    chunk_bytes: int = 4096
    outside_share: float = 0.1
    level: int = 3

    def outside(self, sizes: np.ndarray, wide_bytes: np.ndarray, ratios: np.ndarray) -> np.ndarray:
        wide = 2 * wide_bytes > sizes
        return np.where(wide, _outside(sizes, ratios, self.wide_bands), _outside(sizes, ratios, self.bands))


def _repeat_words(words: Words) -> np.ndarray:
    """For each text, its words that lie in a 3-word window which the text holds twice or more."""
    hashes, text = words.hashes(), words.text
    found = np.zeros(len(hashes), bool)
    if len(hashes) >= 3:
        at = np.flatnonzero(text[2:] == text[:-2])
        keys = mix(windows(hashes, 3)[at] ^ mix(text[at].astype(np.uint64)))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        found = covered(at[twice], 3, len(hashes))
    total = np.concatenate(([0], np.cumsum(found)))
    return np.diff(total[words.first])


def measure(texts: list[str], limits: Limits) -> pd.DataFrame:
    """The columns of ``FIELDS`` for each text."""
    words = Words.of(texts)
    source = words.source
    compressor = zstandard.ZstdCompressor(level=limits.level)
    sizes = np.diff(source.first) - 1
    wide = np.concatenate(([0], np.cumsum(source.buffer >= 128)))
    ratio, repeated_lines = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    owner, start, end, ratios = [], [], [], []
    for k, text in enumerate(texts):
        lines = [line for line in text.split("\n") if line.strip(_BLANK)]
        repeated_lines[k] = len(lines) - len(set(lines))
        raw = text.encode()
        ratio[k] = len(raw) / len(compressor.compress(raw)) if raw else 1.0
        # the last part is what is left; a text shorter than a chunk is judged as a whole only
        for i in range(0, len(raw) if len(raw) >= limits.chunk_bytes else 0, limits.chunk_bytes):
            part = raw[i : i + limits.chunk_bytes]
            owner.append(k)
            start.append(source.first[k] + i)
            end.append(source.first[k] + i + len(part))
            ratios.append(len(part) / len(compressor.compress(part)))
    owner, start, end = np.array(owner, np.int64), np.array(start, np.int64), np.array(end, np.int64)
    out = limits.outside(end - start, wide[end] - wide[start], np.array(ratios))
    full = end - start == limits.chunk_bytes
    chunks, chunks_outside = np.bincount(owner[full], minlength=len(texts)), np.bincount(owner[full & out], minlength=len(texts))
    bytes_outside = np.bincount(owner[out], (end - start)[out], len(texts)).astype(np.int64)
    n_words, n_repeat = words.counts, _repeat_words(words)
    base_failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    wide_bytes = wide[source.first[1:]] - wide[source.first[:-1]]
    bad = limits.outside(sizes, wide_bytes, ratio) | (bytes_outside > limits.outside_share * sizes)
    return pd.DataFrame({
        "n_words": n_words,
        "word_chars": source.count(words.inside & ((source.buffer & 0xC0) != 0x80)),
        "n_symbols": source.count(_SYMBOL[source.buffer]),
        "n_dup_lines": repeated_lines,
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "ratio": ratio,
        "n_chunks": chunks,
        "n_chunks_outside": chunks_outside,
        "n_bytes_outside": bytes_outside,
        "kept": ~base_failed & ~bad,
    })


def quality(text: Column, limits: Limits = Limits()) -> Column:
    """A struct of ``FIELDS`` for each text; rows stay where they are, so nothing is shuffled.

    ``kept`` is false with fewer than 50 words, with more than half of the words in repeated 3-word windows, with a
    ratio of the whole text outside its band, or with more than ``outside_share`` of its bytes in chunks outside
    theirs.  The last chunk is judged by the band of its own length; ``n_chunks`` and ``n_chunks_outside`` count the
    full ones.  A text shorter than a chunk has no chunks.  A null text counts as the empty one: no words, ratio 1,
    not kept.
    """

    @F.pandas_udf(FIELDS)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frame = pd.DataFrame({"text": batch})
            parts = [measure(p["text"].tolist(), limits) for p in split_frames(frame)]
            yield pd.concat(parts) if parts else measure([], limits)

    return judge(F.coalesce(text, F.lit("")))


def good_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows that pass, with all their columns; repeated rows are judged alike, an empty table stays empty."""
    judged = docs.select(F.struct("*").alias("_row"), quality(F.col("text"), limits).alias("_quality"))
    return judged.where("_quality.kept").select("_row.*")
