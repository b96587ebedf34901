"""Words, hashes and windows of a batch of texts as numpy arrays.

Everything here works on one Arrow batch inside a task.  A word is a run of bytes
other than space and 0x09-0x0D; UTF-8 keeps those bytes for themselves, so words
of bytes are words of characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a null id inside the operators: below every real id, and null again in results.
NO_ID = -(2**63)
#: Bytes of text that are worked on at once, which bounds a task's arrays.
BATCH_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_RANDOM = np.random.default_rng(20240)
_BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_FOLDED_VALUES = _BYTE_VALUES.copy()
_FOLDED_VALUES[65:91] = _BYTE_VALUES[97:123]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def id_of(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def id_back(column: str) -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def file_row() -> Column:
    """A number for each row of a table that is read from Parquet files as it is, the same whenever it is read.

    Two of a hundred million rows get the same number with a probability of about one in four thousand;
    ``numbers_rows`` finds out.
    """
    return F.xxhash64("_metadata.file_path", "_metadata.row_index")


def numbers_rows(docs: DataFrame, row: Column) -> bool:
    """Has each row a number of its own?  One pass over the numbers; False for a table that is not read from files."""
    try:
        numbered = docs.select(row.alias("row"))
    except AnalysisException:
        return False
    found = numbered.agg(F.count("*"), F.count_distinct("row")).first()
    return found[0] == found[1]


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """``(doc_id, text, more)``: ids without nulls, a null text as the empty one, other columns left out."""
    return docs.select(id_of().alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    if which not in _powers or len(_powers[which][0]) < n:
        base = _BASES[which]
        pair = []
        for b in (base, pow(base, -1, 2**64)):
            steps = np.full(max(n, 4096), b, np.uint64)
            steps[0] = 1
            pair.append(np.multiply.accumulate(steps))
        _powers[which] = tuple(pair)
    up, down = _powers[which]
    return up[:n], down[:n]


def rolling(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums from which ``span_hash`` reads the hash of any span."""
    up, _ = powers(len(values) + 1, which)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    _, down = powers(len(prefix), which)
    return mix((prefix[end] - prefix[start]) * down[start])


def split_frames(frame: pd.DataFrame, text: str = "text", size: int = BATCH_BYTES) -> Iterator[pd.DataFrame]:
    """Parts of a frame with at most ``size`` characters of text each, or one row."""
    if not len(frame):
        return
    lengths = np.cumsum([len(t) for t in frame[text]])
    start = 0
    while start < len(frame):
        base = lengths[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(lengths, base + size, "right")))
        yield frame.iloc[start:end].reset_index(drop=True)
        start = end


@dataclass
class Bytes:
    """The UTF-8 bytes of a batch; a newline follows each text."""

    buffer: np.ndarray
    first: np.ndarray  # of each text, and the end of the buffer

    @classmethod
    def of(cls, texts: list[str]) -> Bytes:
        raw = [t.encode() for t in texts]
        first = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) + 1 for r in raw], out=first[1:])
        return cls(np.frombuffer(b"\n".join([*raw, b""]), np.uint8), first)

    def count(self, flags: np.ndarray) -> np.ndarray:
        """How many flags are set in each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.first])


@dataclass
class Words:
    """The words of a batch: spans in its bytes, and a hash for each."""

    source: Bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # number of each text's first word, and of all words
    inside: np.ndarray  # is a byte part of a word

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        source = Bytes.of(texts)
        inside = ~_SPACE[source.buffer]
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        return cls(source, start, end, np.searchsorted(start, source.first), inside)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, fold: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``fold`` takes A-Z as a-z."""
        prefix = rolling((_FOLDED_VALUES if fold else _BYTE_VALUES)[self.source.buffer])
        return span_hash(prefix, self.start, self.end)


def windows(hashes: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A hash of each ``width`` consecutive values, across texts as well."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    prefix = rolling(hashes, which)
    at = np.arange(len(hashes) - width + 1)
    return span_hash(prefix, at, at + width, which)


def byte_values(buffer: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[buffer]


def expand(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after the other."""
    total = int(length.sum())
    shift = np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])) if len(length) else start, length)
    return shift + np.arange(total)


def covered(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Which of ``size`` places lie in a window of ``width`` that begins at a start."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, size), -1)
    return np.cumsum(change[:-1]) > 0
