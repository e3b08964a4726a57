"""License texts inside documents: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

A template of m shingles is looked for in windows of s shingles, s the smallest power of two from 2m on, which start every s / 2 shingles: wherever the
template stands, one window holds all of it, and then their Jaccard similarity is containment * m / s at least, a quarter of the containment
asked for. The number of one-row bands follows from that and from the chance of a miss allowed.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nosoflow.llm.common import pieces_of, shingles, texts, word_hashes

WORDS = 5
CONTAINMENT = 0.8
MISS = 1e-4
#: More templates than these are an error: every task holds all of them.
MAX_TEMPLATES = 10_000
#: Shingles of a text that are hashed at a time.
CHUNK = 1 << 13
_STEP = 2
_FULL = np.uint32(0xFFFFFFFF)

# Public license notices and the opening paragraphs of public licenses.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "MIT notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions"),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met"),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation"),
    "LGPL header": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL header": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def bands_for(containment: float = CONTAINMENT, miss: float = MISS) -> int:
    """One-row bands so that a window which holds the template meets it in one of them but for the chance ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - containment / 4))


class Scanner:
    """Finds templates in texts. Templates without a word match nothing."""

    def __init__(self, templates: dict[str, str], words: int = WORDS, containment: float = CONTAINMENT, miss: float = MISS):
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
        self.words, self.containment = words, containment
        draws = np.random.default_rng(3).integers(0, 1 << 32, (2, bands_for(containment, miss)), np.uint64).astype(np.uint32)
        self.factors, self.terms = draws[0] | np.uint32(1), draws[1]
        self.names = sorted(n for n, t in templates.items() if len(word_hashes(t)))
        self.sets = [np.unique(shingles(word_hashes(templates[n]), words)) for n in self.names]
        # A template shorter than a shingle is one shingle of all its words, which no longer text has: it is looked for by its own size.
        self.short = {i: len(word_hashes(templates[n])) for i, n in enumerate(self.names) if len(word_hashes(templates[n])) < words}
        sizes = [max(2 * _STEP, 1 << (2 * len(s) - 1).bit_length()) for s in self.sets]
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.filters: dict[int, np.ndarray] = {}
        bands = len(self.factors)
        for size in sorted({z for i, z in enumerate(sizes) if i not in self.short}):
            members = [i for i, z in enumerate(sizes) if z == size and i not in self.short]
            least = np.stack([self._hashed(self.sets[i]).min(axis=1) for i in members], 1)
            self.filters[size] = np.zeros((bands, 1 << 16), bool)
            self.filters[size][np.arange(bands)[:, None], least & np.uint32(0xFFFF)] = True
            flat, owner = self._keys(np.arange(bands)[:, None], least).ravel(), np.tile(members, bands)
            order = np.argsort(flat, kind="stable")
            self.tables[size] = (flat[order], owner[order])
        self.reach = max(self.tables, default=2 * _STEP)

    def _hashed(self, grams: np.ndarray) -> np.ndarray:
        return self.factors[:, None] * (grams >> np.uint64(32)).astype(np.uint32)[None, :] + self.terms[:, None]

    @staticmethod
    def _keys(band: np.ndarray, least: np.ndarray) -> np.ndarray:
        return band.astype(np.uint64) << np.uint64(32) | least.astype(np.uint64)

    def _retrieved(self, grams: np.ndarray, blank: np.ndarray) -> set[tuple[int, int, int]]:
        """Template, window size and window start of all band matches in a run of shingles, of which the blank ones are none."""
        found: set[tuple[int, int, int]] = set()
        hashed = self._hashed(grams)
        hashed[:, blank] = _FULL
        least, covered, lines = hashed.reshape(len(self.factors), -1, _STEP).min(axis=2), _STEP, np.arange(len(self.factors))[:, None]
        step = 1  # windows start every half of their size, but the first ones, which lie side by side
        while covered < self.reach:
            wider = least.copy()
            np.minimum(wider[:, :-step], least[:, step:], out=wider[:, :-step])
            least, step, covered = wider[:, ::step], 2, covered * 2
            if covered not in self.tables:
                continue
            known, owners = self.tables[covered]
            for band, window in np.argwhere(self.filters[covered][lines, least & np.uint32(0xFFFF)]).tolist():
                key = self._keys(np.array([band]), least[band:band + 1, window])[0]
                for at in range(int(np.searchsorted(known, key)), len(known)):
                    if known[at] != key:
                        break
                    found.add((int(owners[at]), covered, window * covered // 2))
        return found

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        return self.scan_all([text])[0]

    def scan_all(self, texts_: list[str]) -> list[list[tuple[str, float, int, int]]]:
        """For each text name, containment, first word and number of words of the best match of each template found; of equal ones the first.

        Texts are searched together, each from a multiple of the largest window's step on, so that the neighbours of a text don't matter.
        """
        hashes = [word_hashes(t) for t in texts_]
        best: list[dict[int, tuple[float, int, int]]] = [{} for _ in texts_]
        grams = [shingles(h, self.words) if len(h) >= self.words and self.tables else h[:0] for h in hashes]

        def verify(number: int, i: int, held: np.ndarray, start: int, end: int, words: int) -> None:
            own = np.flatnonzero(np.isin(held[start:end], self.sets[i]))
            if not len(own):
                return
            share, first = len(np.unique(held[start:end][own])) / len(self.sets[i]), start + int(own[0])
            known = best[number].get(i)
            if share >= self.containment and (known is None or (share, -first) > (known[0], -known[1])):
                best[number][i] = (share, first, int(own[-1] - own[0]) + words)

        for i, size in self.short.items():
            for number, h in enumerate(hashes):
                if len(h) >= size:
                    held = shingles(h, size)
                    for at in np.flatnonzero(held == self.sets[i][0])[:1].tolist():
                        verify(number, i, held, at, at + 1, size)

        align = self.reach // 2
        group: list[tuple[int, int, int]] = []  # text, its first shingle here, place in the run

        def search(length: int) -> None:
            run, blank = np.zeros(length, np.uint64), np.ones(length, bool)
            for number, first, place in group:
                part = grams[number][first:first + length - place]
                run[place:place + len(part)], blank[place:place + len(part)] = part, False
            places = [p for _, _, p in group]
            for i, size, at in sorted(self._retrieved(run, blank)):
                number, first, place = group[bisect_right(places, at) - 1]
                start = first + at - place
                verify(number, i, grams[number], start, min(len(grams[number]), start + size), self.words)
            group.clear()

        used = 0
        for number, held in enumerate(grams):
            for first in range(0, len(held), CHUNK):
                count = min(CHUNK + self.reach, len(held) - first)
                group.append((number, first, used))
                used += -(-count // align) * align
                if used >= CHUNK:
                    search(used)
                    used = 0
        if group:
            search(used)
        return [[(self.names[i], *found[i]) for i in sorted(found)] for found in best]


def scan_documents(docs: DataFrame, templates: dict[str, str] | None = None, **options) -> DataFrame:
    """One row per document and license found: doc_id, license, containment, first_word, n_words.

    A license is found if ``containment`` of its template's shingles (``words`` words each) stand in one window; the best window is reported. Texts of
    fewer words than a shingle hold no longer license; null and empty texts hold none. Repeated rows are reported as often as they occur.
    """
    templates = TEMPLATES if templates is None else templates
    Scanner(templates, **options)  # refuses too many before any task starts
    names = ["doc_id", "license", "containment", "first_word", "n_words"]
    kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, **options)
        for batch in pieces_of(batches, 1024):
            rows = []
            for doc_id, matches in zip(batch.column("doc_id").to_pylist(), scanner.scan_all(batch.column("text").to_pylist())):
                rows += [(doc_id, *found) for found in matches]
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return texts(docs).mapInArrow(scan, "doc_id bigint, license string, containment double, first_word bigint, n_words bigint")
