"""Substring dedup: later copies of word windows, found by a count-min sketch and then exactly.

Documents are dealt into chunks by id.  Each chunk's sketch goes out in slices of the hash space; a slice of all chunks
is merged in one task, whose counters overestimate how often each window occurs, and every chunk gets back one bit for
each of its windows.  Only windows estimated to be repeated go out a second time, with a 92-bit identity and the place
where the chunk has them first, and come back with the bit that says whether another place is earlier.

Chunks and slices have a set size and their number grows with the corpus, so no task grows with it.  A window that
occurs everywhere costs one entry for each chunk.  The three passes over the texts read one exchange.
"""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policyloom.llm.arrays import Words, covered, id_back, split_frames, texts_of, windows

_KEY_BITS = 28
_MESSAGE = "slice int, chunk long, entries binary"
_REPLY = "chunk long, stage int, slice int, flags binary"


@dataclass(frozen=True)
class SubstringSettings:
    """Windows of ``words`` words; the other values size the tasks and do not change results."""

    words: int = 20
    chunk_chars: int = 8 << 20
    slice_windows: int = 1 << 21
    sketch_rows: int = 4
    sketch_bits: int = 23


def _pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes of their differences."""
    deltas = np.diff(values.astype(np.int64), prepend=np.int64(0))
    return zlib.compress(deltas.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())


def _ends(first: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.append(first[1:], len(of))[: len(first)]


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


class _Chunk:
    """The windows of a chunk's documents, in the order of ids (rows of one id by text)."""

    def __init__(self, frame: pd.DataFrame, settings: SubstringSettings, slices: int) -> None:
        self.frame = frame.sort_values(["doc_id", "text"]).reset_index(drop=True)
        a, b, at, counts, base = [], [], [], [], 0
        for part in split_frames(self.frame):
            words = Words.of(part["text"].tolist())
            hashes, text, width = words.hashes(), words.text, settings.words
            if len(hashes) >= width:
                whole = np.flatnonzero(text[width - 1 :] == text[: len(text) - width + 1])
                a.append(windows(hashes, width)[whole])
                b.append(windows(hashes, width, 1)[whole])
                at.append(base + whole)
            counts.append(words.counts)
            base += len(hashes)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.first_word = np.concatenate(([0], np.cumsum(join(counts, np.int64))))
        self.exact, self.at = join(b, np.uint64), join(at, np.int64)
        a = join(a, np.uint64)
        self.place = ((a >> np.uint64(32)) % np.uint64(slices)).astype(np.int64)
        self.key = (a & np.uint64((1 << _KEY_BITS) - 1)).astype(np.int64)
        # distinct cells of the sketch, in the order of slices and keys
        self.cells, self.cell_of, self.times = np.unique(
            self.place << _KEY_BITS | self.key, return_inverse=True, return_counts=True
        )

    def sketch(self) -> pd.DataFrame:
        """Each slice's cells; the lowest bit says that the chunk alone has one twice."""
        of = self.cells >> _KEY_BITS
        values = (self.cells & ((1 << _KEY_BITS) - 1)) << 1 | (self.times > 1)
        return self._sent(of, lambda s: _pack(values[s]))

    def _sent(self, of: np.ndarray, entries) -> pd.DataFrame:
        places, first = np.unique(of, return_index=True)
        cuts = [slice(x, y) for x, y in zip(first, _ends(first, of), strict=True)]
        return pd.DataFrame({"slice": places.astype(np.int32), "chunk": self.chunk, "entries": [entries(s) for s in cuts]})

    @property
    def chunk(self) -> int:
        return int(self.frame["chunk"].iloc[0]) if len(self.frame) else 0

    def suspects(self, replies: pd.DataFrame) -> None:
        """Keep the windows whose cell came back as repeated, and the first of each in this chunk."""
        flags = _flags(replies, 0, self.cells >> _KEY_BITS)
        some = np.flatnonzero(flags[self.cell_of]) if len(flags) else np.zeros(0, np.int64)
        order = some[np.lexsort((self.at[some], self.exact[some], self.key[some], self.place[some]))]
        new = np.ones(len(order), bool)
        for values in (self.exact, self.key, self.place):
            new[1:] &= values[order][1:] == values[order][:-1]
        new[1:] = ~new[1:]
        self.windows, self.is_first = order, new
        heads = order[new]
        # out they go by slice and place, which packs well
        self.head_order = np.lexsort((self.at[heads], self.place[heads]))
        self.heads, self.head_of = heads[self.head_order], np.cumsum(new) - 1

    def messages(self) -> pd.DataFrame:
        h = self.heads
        row = np.searchsorted(self.first_word, self.at[h], "right") - 1
        ids, start = self.frame["doc_id"].to_numpy()[row], self.at[h] - self.first_word[row]
        exact, key = self.exact[h], self.key[h].astype(np.uint32)

        def entries(s: slice) -> bytes:
            order = _pack(ids[s]), _pack(start[s])
            sizes = np.array([s.stop - s.start, len(order[0])], np.int64).tobytes()
            return b"".join([sizes, exact[s].tobytes(), key[s].tobytes(), *order])

        return self._sent(self.place[h], entries)

    def removed(self, replies: pd.DataFrame) -> np.ndarray:
        """Which words a window covers that also starts earlier."""
        later = np.zeros(len(self.heads), bool)
        later[self.head_order] = _flags(replies, 1, self.place[self.heads])
        gone = ~self.is_first | later[self.head_of] if len(self.windows) else np.zeros(0, bool)
        return gone


def _flags(replies: pd.DataFrame, stage: int, of: np.ndarray) -> np.ndarray:
    """The bits of all slices, in the order in which the entries went out."""
    out = np.zeros(len(of), bool)
    by_slice = {r.slice: r.flags for r in replies[replies["stage"] == stage].itertuples()}
    places, first = np.unique(of, return_index=True)
    for place, x, y in zip(places, first, _ends(first, of), strict=True):
        out[x:y] = np.unpackbits(np.frombuffer(by_slice[place], np.uint8), count=y - x)
    return out


def _merge_sketches(settings: SubstringSettings):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        entries = [_unpack(e) for e in frame["entries"]]
        values = np.concatenate(entries)
        keys, twice = (values >> 1).astype(np.uint32), (values & 1).astype(bool)
        repeated = np.ones(len(keys), bool)
        for row in range(settings.sketch_rows):
            factor = np.uint32((0x9E3779B1 + 0x3C6EF372 * row) % 2**32 | 1)
            mixed = (keys ^ (keys >> np.uint32(13 + row))) * factor
            cells = (mixed >> np.uint32(32 - settings.sketch_bits)).astype(np.int64)
            counters = np.bincount(cells) + np.bincount(cells[twice], minlength=int(cells.max(initial=0)) + 1)
            repeated &= counters[cells] > 1
        ends = np.cumsum([len(e) for e in entries])
        flags = [_bits(repeated[y - len(e) : y]) for e, y in zip(entries, ends, strict=True)]
        return pd.DataFrame({"chunk": frame["chunk"], "stage": 0, "slice": frame["slice"], "flags": flags})

    return run


def _merge_exact(frame: pd.DataFrame) -> pd.DataFrame:
    parts = []
    for data in frame["entries"]:
        n, ids = np.frombuffer(data, np.int64, 2)
        exact, key = np.frombuffer(data, np.uint64, n, 16), np.frombuffer(data, np.uint32, n, 16 + 8 * n)
        rest = 16 + 12 * n
        parts.append((exact, key, _unpack(data[rest : rest + ids]), _unpack(data[rest + ids :])))
    exact, key, doc, start = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((start, doc, key, exact))
    same = np.zeros(len(order), bool)
    same[1:] = (exact[order][1:] == exact[order][:-1]) & (key[order][1:] == key[order][:-1])
    later = np.zeros(len(order), bool)
    later[order] = same
    ends = np.cumsum([len(p[0]) for p in parts])
    flags = [_bits(later[y - len(p[0]) : y]) for p, y in zip(parts, ends, strict=True)]
    return pd.DataFrame({"chunk": frame["chunk"], "stage": 1, "slice": frame["slice"], "flags": flags})


def dedup_substrings(docs: DataFrame, settings: SubstringSettings = SubstringSettings()) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text)``: each document without words that a window seen earlier covers.

    A window is ``settings.words`` consecutive words of one row; earlier means a smaller id, or the same row and an
    earlier start.  Rows that share an id count in the order of their texts; null ids come first and stay null.  Kept
    words are joined by one space.  A text with fewer words than a window, an empty or a null one loses nothing.
    """
    texts = texts_of(docs)
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = chars // settings.chunk_chars + 1
    slices = chars // 5 // settings.slice_windows + 1
    dealt = texts.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks))).repartition(chunks, "chunk")

    def emit(frame: pd.DataFrame) -> pd.DataFrame:
        return _Chunk(frame, settings, slices).sketch()

    def ask(frame: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        chunk = _Chunk(frame, settings, slices)
        chunk.suspects(replies)
        return chunk.messages()

    def finish(frame: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        chunk = _Chunk(frame, settings, slices)
        chunk.suspects(replies)
        starts = chunk.at[chunk.windows][chunk.removed(replies)]
        gone = covered(starts, settings.words, int(chunk.first_word[-1]))
        n_words, texts = np.diff(chunk.first_word), []
        total = np.concatenate(([0], np.cumsum(gone)))
        n_removed = np.diff(total[chunk.first_word])
        for text, x, y in zip(chunk.frame["text"], chunk.first_word[:-1], chunk.first_word[1:], strict=True):
            # bytes are split at exactly the blanks that part words
            kept = itertools.compress(text.encode().split(), (~gone[x:y]).tolist())
            texts.append(b" ".join(kept).decode())
        return pd.DataFrame({
            "doc_id": chunk.frame["doc_id"], "n_words": n_words, "n_removed": n_removed, "kept_text": texts,
        })

    sketches = dealt.groupBy("chunk").applyInPandas(emit, _MESSAGE)
    repeated = sketches.groupBy("slice").applyInPandas(_merge_sketches(settings), _REPLY)
    asked = dealt.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInPandas(ask, _MESSAGE)
    replies = repeated.unionByName(asked.groupBy("slice").applyInPandas(_merge_exact, _REPLY))
    out = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(
        finish, "doc_id long, n_words long, n_removed long, kept_text string"
    )
    return out.withColumn("doc_id", id_back("doc_id"))
