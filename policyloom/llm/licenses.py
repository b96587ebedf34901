"""License scans: MinHash bands over text windows retrieve templates, and shingle containment verifies them.

Texts and templates are cut into words of letters and digits (A-Z folded) and shingles of five words; a template of
fewer words is one shingle of all of them, and texts are cut into shingles of that width as well.  A window is
eight consecutive shingles and begins every four, so each run of shingles lies well inside some window.  Every
coordinate of a window's MinHash is a band of its own.  Of a contained template, some window of a shingles has its
percentage of them in the text; the text's windows hold at most eight, so they meet it in a band with a probability of at
least ceil(percent * a / 100) / (a + 7), and the number of bands keeps the chance that none does below a set bound.  What
is retrieved is verified by counting the template's distinct shingles in the whole document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policyloom.llm.arrays import Bytes, byte_values, id_back, rolling, span_hash, split_frames, texts_of, windows

# Notices by which works state a license.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.",),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0.",),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: The templates, and notices that state no license: what a scan looks for unless told otherwise.
NOTICES = TEMPLATES | {"all-rights-reserved": ("All rights reserved.",)}


@dataclass(frozen=True)
class LicenseSettings:
    """``percent`` of a template's distinct shingles must be in the document; the rest shapes retrieval.

    A contained template is missed by all bands with a probability of at most ``miss``.
    """

    words: int = 5
    percent: int = 80
    miss: float = 1e-6
    block: int = 4

    @property
    def coordinates(self) -> int:
        """The least number of bands that keeps the promise for windows of any size."""
        window = 2 * self.block
        least = min(max(1, -(-self.percent * a // 100)) / (a + window - 1) for a in range(1, window + 1))
        return math.ceil(math.log(self.miss) / math.log1p(-least))


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_NONE = np.uint32(2**32 - 1)
#: Two random words for each coordinate.
_SEEDS = np.random.default_rng(96).integers(0, 2**64, 1024, dtype=np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the texts, and the number of each text's first word and of all words."""
    source = Bytes.of(texts)
    inside = _ALNUM[source.buffer]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = span_hash(rolling(byte_values(_FOLD[source.buffer])), start, end)
    return hashes, np.searchsorted(start, source.first)


class Shingles:
    """Hashes of the shingles of a batch; each text's begin at a multiple of the block, with fillers behind."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, width: int, block: int) -> None:
        counts = np.maximum(np.diff(first) - width + 1, 0)
        self.counts = counts
        self.first = np.concatenate(([0], np.cumsum(-(-counts // block) * block)))
        at = np.repeat(first[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        self.place = np.repeat(self.first[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        self.owner = np.repeat(np.arange(len(counts)), counts)
        self.values = windows(hashes, width)[at]
        self.padded = np.full(self.first[-1], _NONE, np.uint32)
        self.padded[self.place] = self.values.astype(np.uint32)
        self.filled = np.zeros(self.first[-1], bool)
        self.filled[self.place] = True
        self.of_block = np.repeat(np.arange(len(counts)), -(-counts // block))


def _window_minima(shingles: Shingles, row: int, block: int) -> np.ndarray:
    """One coordinate for each block: the least value among its shingles and those of the text's next block."""
    h = (shingles.padded ^ np.uint32(int(_SEEDS[row]) & 0xFFFFFFFF)) * np.uint32(int(_SEEDS[row]) >> 32 | 1)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = np.where(shingles.filled, h ^ (h >> np.uint32(13)), _NONE)
    least = h[0::block]
    for k in range(1, block):
        least = np.minimum(least, h[k::block])
    out = least.copy()
    joined = shingles.of_block[1:] == shingles.of_block[:-1]
    out[:-1] = np.where(joined, np.minimum(least[:-1], least[1:]), least[:-1])
    return out


class WidthIndex:
    """Templates of one shingle width by the coordinates of their windows; ``numbers`` are those among all templates."""

    def __init__(self, texts: list[str], numbers: np.ndarray, width: int, settings: LicenseSettings) -> None:
        self.numbers, self.width, self.settings = numbers, width, settings
        found = Shingles(*word_hashes(texts), width, settings.block)
        self.sets = {n: np.unique(found.values[found.owner == k]) for k, n in enumerate(numbers.tolist())}
        block = settings.block
        of_block = numbers[found.of_block]
        self.keys, self.owners, self.maybe = [], [], []
        for row in range(settings.coordinates):
            minima = _window_minima(found, row, block)
            order = np.argsort(minima, kind="stable")
            self.keys.append(minima[order])
            self.owners.append(of_block[order])
            flags = np.zeros(1 << 16, bool)
            flags[minima >> np.uint32(16)] = True
            self.maybe.append(flags)

    def candidates(self, texts: Shingles) -> list[tuple[int, int]]:
        """(text, template) of what shares a band."""
        n, block, of_block = int(self.numbers.max()) + 1, self.settings.block, texts.of_block
        found = []
        for row, (keys, owners, maybe) in enumerate(zip(self.keys, self.owners, self.maybe, strict=True)):
            minima = _window_minima(texts, row, block)
            some = np.flatnonzero(maybe[minima >> np.uint32(16)])
            low, high = np.searchsorted(keys, minima[some], "left"), np.searchsorted(keys, minima[some], "right")
            some, low, high = some[high > low], low[high > low], high[high > low]
            found += [of_block[b] * n + owners[x:y] for b, x, y in zip(some, low, high, strict=True)]
        return [divmod(code, n) for code in np.unique(np.concatenate(found)).tolist()] if found else []

    def matches(self, shingles: Shingles) -> Iterator[tuple[int, int, int, int]]:
        """(text, template, shingles found, place of the first) for each verified candidate."""
        ends = np.cumsum(shingles.counts)
        for text, template in self.candidates(shingles):
            own = shingles.values[ends[text] - shingles.counts[text] : ends[text]]
            wanted = self.sets[template]
            hit = np.isin(own, wanted)
            common = len(np.unique(own[hit]))
            if 100 * common >= self.settings.percent * len(wanted):
                yield text, template, common, int(np.argmax(hit))


class TemplateIndex:
    """Templates by the width of their shingles: all their words if they have fewer than a shingle."""

    def __init__(self, templates: Sequence[tuple[str, str]], settings: LicenseSettings) -> None:
        self.settings = settings
        texts = [text for _, text in templates]
        widths = np.minimum(np.diff(word_hashes(texts)[1]), settings.words)
        self.parts = []
        for width in np.unique(widths[widths > 0]).tolist():
            numbers = np.flatnonzero(widths == width)
            self.parts.append(WidthIndex([texts[n] for n in numbers], numbers, width, settings))
        self.sets = {n: own for part in self.parts for n, own in part.sets.items()}

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(text, template, shingles found, place of the first) for each template that a text contains."""
        hashes, first = word_hashes(texts)
        for part in self.parts:
            yield from part.matches(Shingles(hashes, first, part.width, self.settings.block))


def scan_licenses(
    docs: DataFrame, templates: Mapping[str, Sequence[str]] = NOTICES, settings: LicenseSettings = LicenseSettings()
) -> DataFrame:
    """``(doc_id, license, template, n_matched, n_shingles, first_word)``: a row for each template that a text contains.

    ``template`` numbers the notices of a license from 0, ``first_word`` is where its first shingle stands.  A template
    of fewer words than a shingle is found where all its words follow each other; one without words is never found.
    Null and empty texts have no rows; repeated rows are judged alike; null ids come back as null.  Templates are
    settings of the job and go to the tasks with its code.
    """
    flat = [(name, text) for name, texts in templates.items() for text in texts]
    numbers = [k for texts in templates.values() for k in range(len(texts))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = TemplateIndex(flat, settings)
        for frame in (p for whole in frames for p in split_frames(whole)):
            ids = frame["doc_id"].to_numpy()
            rows = [
                (ids[t], flat[k][0], numbers[k], common, len(index.sets[k]), first)
                for t, k, common, first in index.matches(frame["text"].tolist())
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "license", "template", "n_matched", "n_shingles", "first_word"])

    out = texts_of(docs).mapInPandas(
        run, "doc_id long, license string, template int, n_matched long, n_shingles long, first_word long"
    )
    return out.withColumn("doc_id", id_back("doc_id"))
