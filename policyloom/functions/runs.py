"""Runs of characters in batches of texts, found in arrays: which distinct ones there are, and where each stands.

Texts of Latin-1 have one byte a character, so a table of 256 entries says what each character is; the distinct runs
are told apart by Arrow, and only they become strings.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Lower case of each Latin-1 character; all of them are of Latin-1 again, but for no capital of it.
LOWER = bytes(ord(chr(c).lower()) for c in range(256))


@dataclass
class Runs:
    """``distinct`` strings, the number of the one at each place, and how many places each text has."""

    distinct: list[str]
    codes: np.ndarray
    counts: np.ndarray


def latin(text: str) -> bytes | None:
    """A text of Latin-1 characters as bytes; None for others."""
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return None


def table(*kinds: Iterable[str]) -> np.ndarray:
    """The kind of each byte: 1 for the characters given first, 2 for the next ones, 0 for all others."""
    out = np.zeros(256, np.uint8)
    for kind, characters in enumerate(kinds, 1):
        out[np.frombuffer("".join(characters).encode("latin-1"), np.uint8)] = kind
    return out


def joined(raws: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts one after the other, a newline after each, and where each ends."""
    data = np.frombuffer(b"".join([b for raw in raws for b in (raw, b"\n")]).translate(LOWER), np.uint8)
    return data, np.cumsum([len(raw) + 1 for raw in raws], dtype=np.int64)


def told_apart(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray, borders: np.ndarray) -> Runs:
    """The runs between starts and ends, which are the bytes ``inside``, in texts that end at the borders."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    kept = data[inside]
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
    codes = found.indices.to_numpy()
    names = found.dictionary
    size = len(names)
    cuts = np.frombuffer(names.buffers()[1], np.int64, size + 1) if size else np.zeros(1, np.int64)
    text = names.buffers()[2].to_pybytes().decode("latin-1") if size else ""
    places = cuts.tolist()
    return Runs([text[a:b] for a, b in zip(places[:-1], places[1:], strict=True)], codes, np.diff(np.searchsorted(starts, borders), prepend=0))


def words(raws: Sequence[bytes], kinds: np.ndarray) -> Runs:
    """The longest runs of characters whose kind is not 0, lower-cased."""
    data, borders = joined(raws)
    inside = kinds[data] != 0
    edges = np.flatnonzero(np.diff(inside, prepend=False))  # a text ends with a newline, so each run has its end
    return told_apart(data, inside, edges[::2], edges[1::2], borders)
