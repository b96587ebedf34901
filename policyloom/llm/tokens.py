"""Token ids of texts, and their binary files with Elias-Fano coded boundaries.

A shard holds the ids of consecutive documents one after the other, and two Elias-Fano lists: the document ids and the
places where documents begin.  Such a list keeps the low bits of each number as they are and the high bits as a bit
vector of unary gaps: about two bits more than the low part for each number, and samples of 32 bits from which a
number is found without reading the others.
"""

from __future__ import annotations

import itertools
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import NativeFile
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from policyloom.functions import runs
from policyloom.llm.arrays import expand, id_back, split_frames, texts_of
from policyloom.session import ensure_checkpoint_dir, materialize

#: Texts of these characters are cut by the rule below exactly as the tokenizer's own normalizer and splitter do.
_PLAIN = re.compile(r"[\x09-\x0d\x20-\x7eÀ-ÿ]*")
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\s0-9a-zß-öø-ÿ]+"
_PIECES = re.compile(_CUT)
_PLAIN_BYTES = "".join(map(chr, [*range(9, 14), *range(0x20, 0x7F), *range(0xC0, 0x100)])).encode("latin-1")
_DIGIT, _MARK = 2, 3
#: Kinds of the characters of plain texts, lower-cased: letters, digits, the apostrophe, others; 0 for white space.
_KINDS = runs.table(
    [*map(chr, [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)])], "0123456789", "'",
    [*(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27), "×", "÷"],
)
#: Kinds that make one piece together.
_ALIKE = np.array([0, 1, 2, 3, 3], np.uint8)
_AFTER_MARK = tuple(b"stmd"), tuple((a << 8) + b for a, b in (b"re", b"ve", b"ll"))


def _byte_names() -> dict[int, str]:
    """Latin-1 letters as a byte-level vocabulary writes the bytes of their UTF-8."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in kept} | {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)).difference(kept)))}
    return {c: "".join(names[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


_BYTES = _byte_names()


class Memory:
    """Strings and the ids of each, one after the other; ``used`` counts how often each was read."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.ids, self.sizes, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.used, self.filled = np.zeros(0, np.int32), 0

    def _room(self, strings: int, ids: int) -> None:
        """Arrays at least double when they grow."""
        if strings > len(self.sizes):
            more = max(strings, 2 * len(self.sizes)) - len(self.sizes)
            self.sizes, self.starts, self.used = (np.concatenate((x, np.zeros(more, x.dtype))) for x in (self.sizes, self.starts, self.used))
        if ids > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(ids, 2 * len(self.ids)) - len(self.ids), np.int32)))

    def add(self, strings: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, last = len(self.place), len(self.place) + len(strings)
        self._room(last, self.filled + len(ids))
        self.place.update(zip(strings, range(first, last), strict=True))
        self.chars += sum(map(len, strings))
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.sizes[first:last] = sizes
        self.starts[first:last] = self.filled + np.cumsum(sizes) - sizes
        self.filled += len(ids)

    def read(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings at the places, and how many each has."""
        if len(places):
            counts = np.bincount(places)
            self.used[: len(counts)] += counts.astype(np.int32)
        sizes = self.sizes[places].astype(np.int64)
        return self.ids[expand(self.starts[places], sizes)], sizes

    def often(self, least: int = 2) -> Memory:
        """What was read at least so many times."""
        out, strings = Memory(), list(self.place)
        kept = np.flatnonzero(self.used[: len(strings)] >= least)
        sizes = self.sizes[kept].astype(np.int64)
        out.add([strings[k] for k in kept.tolist()], self.ids[expand(self.starts[kept], sizes)], sizes)
        return out


class WordEncoder:
    """Ids of texts by the tokenizers library, which is asked once for each piece of text that a task remembers.

    The vocabulary lower-cases, drops white space and never joins what a space parts, so the ids of a text are those
    of its words.  Words of ASCII and Latin-1 are cut further into the pieces that the tokenizer would make; others go
    to it whole.  A full memory keeps what was read twice, and is emptied if that is more than half of it.
    """

    def __init__(self, path: str, limit: int = 400_000) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        vocabulary = self.tokenizer.get_vocab()
        self.size = 1 + max(vocabulary.values())
        self.pieces = Memory()
        probe = pieces_of("it's a word: " + " ".join(map(chr, range(0xDF, 0x100))) + " 1st, " + "".join(map(chr, range(0xE0, 0xF7))) + " #$%&|*")
        self.direct = np.array_equal(self._of_model(probe)[0], self._ask(probe)[0])

    @property
    def kind(self) -> type:
        return np.uint16 if self.size <= 1 << 16 else np.uint32

    def _ask(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        sizes = np.array([len(ids) for ids in found], np.int64)
        return np.fromiter(itertools.chain.from_iterable(found), np.int64, int(sizes.sum())), sizes

    def _of_model(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize = self.tokenizer.model.tokenize
        found = [[t.id for t in tokenize(s if s.isascii() else s.translate(_BYTES))] for s in strings]
        return np.array(list(itertools.chain.from_iterable(found)), np.int64), np.array(list(map(len, found)), np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Plain pieces, which the normalizer and the splitter leave as they are, go to the model; others to the tokenizer."""
        if not self.direct:
            plain = []
        elif _is_plain(" ".join(pieces)):  # as in most batches: one look at them all
            plain = pieces
        else:
            plain = [p for p in pieces if _is_plain(p)]
        if plain:
            self.pieces.add(plain, *self._of_model(plain))
        whole = list(set(pieces).difference(plain)) if len(plain) < len(pieces) else []
        if whole:
            self.pieces.add(whole, *self._ask(whole))

    def _full(self) -> bool:
        return len(self.pieces.place) > self.limit or self.pieces.chars > 16 * self.limit

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, ``end`` after each, and how many each has."""
        found = [cut(list(some), plain) for plain, some in itertools.groupby(texts, key=_is_plain)]
        used = found[0].distinct if len(found) == 1 else list(dict.fromkeys(itertools.chain.from_iterable(r.distinct for r in found)))
        fresh = [p for p in used if p not in self.pieces.place]
        if fresh and self._full():
            self.pieces = self.pieces.often()
            if 2 * len(self.pieces.place) > self.limit or 2 * self.pieces.chars > 16 * self.limit:
                self.pieces = Memory()
            fresh = [p for p in used if p not in self.pieces.place]
        if fresh:
            self._learn(fresh)
        known = self.pieces.place.__getitem__
        places = [np.fromiter(map(known, r.distinct), np.int64, len(r.distinct))[r.codes] for r in found]
        counts = np.concatenate([np.zeros(0, np.int64), *(r.counts for r in found)])
        ids, sizes = self.pieces.read(np.concatenate([np.zeros(0, np.int64), *places]))
        total = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))]
        n = np.diff(total)
        out = np.full(len(ids) + len(texts), end, self.kind)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), n)] = ids
        return out, n + 1


def _is_plain(text: str) -> bool:
    raw = runs.latin(text)
    return raw is not None and not raw.translate(None, _PLAIN_BYTES) and b"<|" not in raw


def cut(texts: list[str], plain: bool) -> runs.Runs:
    """The pieces of texts, as ``pieces_of`` makes them; those of plain texts are found in arrays."""
    if not plain:
        split = [pieces_of(t) for t in texts]
        number = {p: k for k, p in enumerate(dict.fromkeys(itertools.chain.from_iterable(split)))}
        counts = np.array([len(s) for s in split], np.int64)
        codes = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(counts.sum()))
        return runs.Runs(list(number), codes, counts)
    data, borders = runs.joined([t.encode("latin-1") for t in texts])
    kinds = _KINDS[data]
    alike = _ALIKE[kinds]
    begins = np.empty(len(data), bool)
    begins[0] = alike[0] != 0
    np.not_equal(alike[1:], alike[:-1], out=begins[1:])
    begins |= alike == _DIGIT
    begins &= alike != 0
    # an apostrophe that begins a piece takes s, t, m, d, re, ve or ll with it; what follows begins a piece of its own
    marks = np.flatnonzero(begins & (kinds == _MARK))
    one = data[marks + 1]  # a text ends with a newline
    two = (one.astype(np.int64) << 8) + data[np.minimum(marks + 2, len(data) - 1)]
    short, long = np.isin(one, _AFTER_MARK[0]), np.isin(two, _AFTER_MARK[1])
    begins[marks[short | long] + 1] = False
    after = np.concatenate((marks[short] + 2, marks[long] + 3))
    begins[after[alike[after] != 0]] = True
    starts = np.flatnonzero(begins)
    inside = alike != 0
    # a piece ends where the next begins or white space comes
    begins |= ~inside
    begins[1:] &= inside[:-1]
    ends = np.flatnonzero(begins[1:]) + 1
    return runs.told_apart(data, inside, starts, ends, borders)


def pieces_of(text: str) -> list[str]:
    """The parts of a text that have ids of their own."""
    if _PLAIN.fullmatch(text) and "<|" not in text:
        return _PIECES.findall(text.lower())
    out = []
    for word in text.replace("\n", " ").split(" "):
        if _PLAIN.fullmatch(word) and "<|" not in word:
            out += _PIECES.findall(word.lower())
        else:
            out.append(word)
    return out


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


# --- Elias-Fano lists -------------------------------------------------------------------------------------------

_SAMPLE = 64


@dataclass
class EliasFano:
    """Numbers that never fall, with a random access that reads a few bytes."""

    count: int
    base: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.int64)
        base = int(values[0]) if len(values) else 0
        rest = (values.view(np.uint64) - np.uint64(base % 2**64)) if len(values) else np.zeros(0, np.uint64)
        top = int(rest[-1]) if len(rest) else 0
        low_bits = max(0, (top // max(1, len(rest))).bit_length() - 1)
        bits = (rest[:, None] >> np.arange(low_bits, dtype=np.uint64)[None, :] & np.uint64(1)).astype(np.uint8)
        places = (rest >> np.uint64(low_bits)).astype(np.int64) + np.arange(len(rest))
        unary = np.zeros(int(places[-1]) + 1 if len(places) else 0, np.uint8)
        unary[places] = 1
        return cls(
            len(rest), base, low_bits, np.packbits(bits, bitorder="little"), np.packbits(unary, bitorder="little"),
            places[::_SAMPLE].astype(np.uint32),
        )

    def to_bytes(self) -> bytes:
        head = struct.pack("<qqqqqq", self.count, self.base, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return b"".join([head, self.samples.tobytes(), self.low.tobytes(), self.high.tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        count, base, low_bits, low, high, samples = struct.unpack_from("<qqqqqq", data)
        at = 48 + 4 * samples
        return cls(
            count, base, low_bits, np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low),
            np.frombuffer(data, np.uint32, samples, 48),
        )

    def select(self, i: int) -> int:
        """Place of the i-th one of the high bits: from the last sample, byte by byte."""
        place = int(self.samples[i // _SAMPLE])
        missing = i % _SAMPLE
        byte = place >> 3
        bits = int(self.high[byte]) >> (place & 7) << (place & 7)
        while missing >= bits.bit_count():
            missing -= bits.bit_count()
            byte += 1
            bits = int(self.high[byte])
        for _ in range(missing):
            bits &= bits - 1
        return 8 * byte + (bits & -bits).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        first = i * self.low_bits
        low = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3].tobytes(), "little") >> (first & 7)
        return self.base + ((self.select(i) - i) << self.low_bits | low & ((1 << self.low_bits) - 1))

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count] - np.arange(self.count)
        bits = np.unpackbits(self.low, bitorder="little", count=self.count * self.low_bits).reshape(self.count, self.low_bits)
        low = (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        rest = (places.astype(np.uint64) << np.uint64(self.low_bits)) + low
        return (rest + np.uint64(self.base % 2**64)).view(np.int64)


# --- shards -----------------------------------------------------------------------------------------------------

_MAGIC = b"PLTOKENS"
_HEAD = "<8sqqqq"


def shard_bytes(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """Head, document ids, boundaries (with the end), ids."""
    names = EliasFano.of(doc_ids).to_bytes()
    bounds = EliasFano.of(np.concatenate(([0], np.cumsum(lengths)))).to_bytes()
    head = struct.pack(_HEAD, _MAGIC, ids.dtype.itemsize, len(ids), len(names), len(bounds))
    return b"".join([head, names, bounds, ids.astype(ids.dtype.newbyteorder("<")).tobytes()])


def parse_shard(data: bytes) -> tuple[EliasFano, EliasFano, np.ndarray]:
    magic, width, n, names, bounds = struct.unpack_from(_HEAD, data)
    if magic != _MAGIC:
        raise ValueError("not a token shard")
    at = struct.calcsize(_HEAD)
    ids = np.frombuffer(data, f"<u{width}", n, at + names + bounds)
    return EliasFano.from_bytes(data[at : at + names]), EliasFano.from_bytes(data[at + names : at + names + bounds]), ids


@dataclass
class Shard:
    """A written shard: its lists stay coded, ids are read where they are asked for."""

    source: NativeFile
    names: EliasFano
    bounds: EliasFano
    kind: np.dtype
    first: int

    @classmethod
    def open(cls, source: NativeFile) -> Shard:
        size = struct.calcsize(_HEAD)
        magic, width, _, names, bounds = struct.unpack(_HEAD, source.read_at(size, 0))
        if magic != _MAGIC:
            raise ValueError("not a token shard")
        lists = source.read_at(names + bounds, size)
        return cls(source, EliasFano.from_bytes(lists[:names]), EliasFano.from_bytes(lists[names:]), np.dtype(f"<u{width}"), size + names + bounds)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids of a range of places, by one seek."""
        width = self.kind.itemsize
        return np.frombuffer(self.source.read_at(width * (end - start), self.first + width * start), self.kind)

    def document(self, k: int) -> tuple[int, np.ndarray]:
        """Id and token ids of the k-th document: three selects and one seek."""
        return self.names[k], self.ids(self.bounds[k], self.bounds[k + 1])

    def runs(self, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Consecutive documents of some ids together: document ids, boundaries and ids; boundaries come by select."""
        k = 0
        while k < self.names.count:
            cuts = [self.bounds[k]]
            while k + len(cuts) - 1 < self.names.count and cuts[-1] - cuts[0] < most:
                cuts.append(self.bounds[k + len(cuts)])
            docs = [self.names[i] for i in range(k, k + len(cuts) - 1)]
            yield np.array(docs, np.int64), np.array(cuts, np.int64), self.ids(cuts[0], cuts[-1])
            k += len(docs)


def _store(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path)


def _write_shards(folder: str, tokenizer: str, end: int, shard_ids: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, number = WordEncoder(tokenizer), TaskContext.get().partitionId(), 0
        store, root = _store(folder)
        docs, lengths, ids, held = [], [], [], 0

        def save() -> pd.DataFrame:
            nonlocal docs, lengths, ids, held, number
            name = f"shard-{part:07d}-{number:05d}.tok"
            own = f"{root}/.{name}.{uuid.uuid4()}"
            with store.open_output_stream(own) as out:
                out.write(shard_bytes(np.concatenate(docs), np.concatenate(lengths), np.concatenate(ids)))
            store.move(own, f"{root}/{name}")
            row = pd.DataFrame({
                "part": [part], "number": [number], "path": [f"{folder}/{name}"],
                "n_docs": [sum(map(len, docs))], "n_ids": [held],
            })
            docs, lengths, ids, held, number = [], [], [], 0, number + 1
            return row

        for frame in (p for whole in frames for p in split_frames(whole)):
            some, n = encoder.encode(frame["text"].tolist(), end)
            docs.append(frame["doc_id"].to_numpy())
            lengths.append(n)
            ids.append(some)
            held += len(some)
            if held >= shard_ids:
                yield save()
        if docs:
            yield save()

    return run


def write_token_shards(
    docs: DataFrame, folder: str, tokenizer: str, end: int = 2, shard_ids: int = 8 << 20, task_chars: int = 32 << 20
) -> DataFrame:
    """Write the ids of all rows, in the order of ``doc_id``, as shards in a shared folder; return the list of shards.

    Rows come in the order of ids, rows of one id in the order of their texts; null ids come first.  A null text counts
    as the empty one, which has the end id only.  The list (``part``, ``number``, ``path``, ``n_docs``, ``n_ids``) is
    written before it is returned, and its order by part and number is that of the documents.
    """
    texts = texts_of(docs)
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    dealt = texts.repartitionByRange(max(1, chars // task_chars + 1), "doc_id", F.xxhash64("text"))
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    shards = dealt.sortWithinPartitions("doc_id", F.xxhash64("text")).mapInPandas(
        _write_shards(folder, tokenizer, end, shard_ids), "part long, number long, path string, n_docs long, n_ids long"
    )
    return materialize(shards)


def _read_shards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, base in zip(frame["path"], frame["before"], strict=True):
            store, place = _store(path)
            with store.open_input_file(place) as source:
                shard = Shard.open(source)
                for docs, cuts, ids in shard.runs():
                    own = cuts - cuts[0]
                    yield pd.DataFrame({
                        "doc_id": docs, "start": base + cuts[:-1], "n_tokens": np.diff(cuts),
                        "ids_crc32": [crc_of(ids[a:b]) for a, b in zip(own[:-1], own[1:], strict=True)],
                    })


def read_token_shards(shards: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, read from the shards."""
    # one row for each shard, some millions of ids each: the running sum is over the list only
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = shards.withColumn("before", before).select("path", "before")
    n = listed.sparkSession.sparkContext.defaultParallelism
    out = listed.repartition(4 * n, "path").mapInPandas(_read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", id_back("doc_id"))


def scratch_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}/{uuid.uuid4()}"
