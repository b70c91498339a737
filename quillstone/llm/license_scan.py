"""License texts in documents: winnowed fingerprints pick candidates, banded alignment confirms them.

Fingerprints of the templates, hashes of word triples of which each run of three keeps its least, make an inverted
index. Documents are fingerprinted alike; where they share a fingerprint with a template, the words around are aligned
with the template within a band around the diagonal of the shared ones. Any five words in a row that a document and a
template have in common share a fingerprint; for templates of fewer than SHORT words any two do, so that no edit that
leaves the least coverage hides one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import LOWER, mix, pieces, prepare, span_hashes, text_or_empty, word_spans

GRAM, WINNOW, BAND = 3, 3, 8
#: Words from which on a template's fingerprints alone pick candidates.
SHORT = 16
#: Share of a template's words that must match.
COVERAGE = 0.8

# The wording of common notices.
TEMPLATES: dict[str, str] = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT notice": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "BSD grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, row = word_spans(data, off, _WORD)
    return starts, ends, row, span_hashes(LOWER[data], starts, ends) if len(starts) else np.zeros(0, np.uint64)


def fingerprints(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of the word triples that winnowing keeps, none across rows; a row of fewer than
    five words keeps all its triples."""
    n = len(h) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = np.zeros(n, np.uint64)
    for k in range(GRAM):
        grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    whole = row[:n] == row[GRAM - 1 :]
    keep = np.zeros(n, bool)
    m = n - WINNOW + 1
    if m > 0:
        runs = np.flatnonzero(whole[:m] & whole[WINNOW - 1 :] & (row[:m] == row[WINNOW - 1 : WINNOW - 1 + m]))
        keep[runs + np.stack([grams[runs + k] for k in range(WINNOW)]).argmin(0)] = True
    size = np.bincount(row)
    keep |= whole & (size[row[:n]] < GRAM + WINNOW - 1)
    at = np.flatnonzero(keep)
    return grams[at], at


def pairs(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of all pairs of neighbouring words, none across rows."""
    both = mix(mix(h[:-1] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    at = np.flatnonzero(row[:-1] == row[1:])
    return both[at], at


@dataclass(frozen=True)
class Prints:
    """Hash -> (template, place), as sorted arrays; their size is that of the templates."""

    hashes: np.ndarray
    template: np.ndarray
    place: np.ndarray

    def find(self, prints: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(word, template, place) of each hash that is here; ``at`` are the words' indices."""
        door = np.zeros(1 << 16, bool)
        door[(self.hashes >> np.uint64(48)).astype(np.int64)] = True
        may = np.flatnonzero(door[(prints >> np.uint64(48)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hashes, prints[may], "left"), np.searchsorted(self.hashes, prints[may], "right")
        some = np.flatnonzero(hi > lo)
        for p, a, b in zip(at[may[some]].tolist(), lo[some].tolist(), hi[some].tolist()):
            for e in range(a, b):
                yield p, int(self.template[e]), int(self.place[e])


@dataclass(frozen=True)
class Index:
    """The templates' words; the fingerprints of all, and all word pairs of those of fewer than SHORT words, in which few
    wrong words may leave no fingerprint."""

    names: list[str]
    words: list[np.ndarray]
    prints: Prints
    short: Prints

    @staticmethod
    def of(templates: dict[str, str]) -> Index:
        raw = [t.encode() for t in templates.values()]
        off = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        _, _, row, h = _words(np.frombuffer(b"".join(raw), np.uint8), off)
        first = np.searchsorted(row, np.arange(len(raw)))

        def sorted_by_hash(hashes: np.ndarray, at: np.ndarray) -> Prints:
            order = np.argsort(hashes, kind="stable")
            return Prints(hashes[order], row[at][order], (at - first[row[at]])[order])

        two, at = pairs(h, row)
        few = np.bincount(row, minlength=len(raw))[row[at]] < SHORT
        return Index(list(templates), [h[row == k] for k in range(len(raw))], sorted_by_hash(*fingerprints(h, row)), sorted_by_hash(two[few], at[few]))


def align(text: np.ndarray, template: np.ndarray, shift: int, band: int = BAND, low: int = 0, gain: int = 2) -> tuple[int, int, int]:
    """Best local alignment of word hashes, from text word ``low`` on, within ``band`` of the diagonal text = template + shift.

    Returns the matched words and the range of text words from the first to the last match. A match scores ``gain``, a
    mismatch or a gap -1: where the gain is less than the wrong words in a row, the match before them is lost.
    """
    width = 2 * band + 1
    score = [0] * width
    state = [(0, -1, -1)] * width  # matches, first and last matched text word
    best, found = 0, (0, -1, -1)
    size = len(text)
    for i, word in enumerate(template.tolist()):
        new, carried = [0] * width, [(0, -1, -1)] * width
        for k in range(width):
            j = i + shift + k - band
            if j < low or j >= size:
                continue
            if text[j] == word:
                s, (m, a, _) = score[k] + gain, state[k]
                top, way = s, (m + 1, a if a >= 0 else j, j)
            else:
                top, way = score[k] - 1, state[k]
            if k + 1 < width and score[k + 1] - 1 > top:
                top, way = score[k + 1] - 1, state[k + 1]
            if k and new[k - 1] - 1 > top:
                top, way = new[k - 1] - 1, carried[k - 1]
            if top > 0:
                new[k], carried[k] = top, way
                if top > best:
                    best, found = top, way
        score, state = new, carried
    return found


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row for each passage that matches a template: doc_id, template, span_start and span_end (bytes of the UTF-8
    text), n_matched, n_template_words and coverage.

    Passages of one template don't overlap; those of different ones may. Null text holds none. Repeated rows report each
    for themselves. An empty table gives no rows; only doc_id and text are looked at.
    """
    prepare(docs.sparkSession)
    index = Index.of(TEMPLATES if templates is None else templates)

    def passages(h: np.ndarray, hits: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """(template, matched, first and last word) in one row of word hashes; hits: (template, word, place in the template).

        Passages of a template are found from the left. Each begins behind the last, and the band is at most half of the
        template, so that of copies in a row none is found twice and none in another's stead.
        """
        template, free, tried = -1, 0, set()
        for k, word, place in sorted(hits):
            if k != template:
                template, free, tried = k, 0, set()
            if word < free or (word - place, free) in tried:
                continue
            tried.add((word - place, free))
            size = len(index.words[k])
            if size < SHORT:  # a pair of words is no rare thing: are enough of the others near?
                near = h[max(free, word - place - size // 2) : word - place + size + size // 2]
                if np.isin(near, index.words[k]).sum() < coverage * size:
                    continue
            m, a, b = align(h, index.words[k], word - place, min(BAND, size // 2), free, 2 if size >= SHORT else size)
            if m >= coverage * size:
                free = b + 1
                yield k, m, a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in pieces(batches):
            starts, ends, row, h = _words(data, off)
            first = np.searchsorted(row, np.arange(len(off)))
            hits: dict[int, list[tuple[int, int, int]]] = {}
            for found in (index.prints.find(*fingerprints(h, row)), index.short.find(*pairs(h, row))):
                for word, template, place in found:
                    r = int(row[word])
                    hits.setdefault(r, []).append((template, word - int(first[r]), place))
            out: list[list] = [[] for _ in range(6)]
            for r, found in hits.items():
                words = h[first[r] : first[r + 1]]
                for k, m, a, b in passages(words, found):
                    for column, value in zip(out, (r, index.names[k], int(starts[first[r] + a] - off[r]), int(ends[first[r] + b] - off[r]), m, len(index.words[k]))):
                        column.append(value)
            ids = part.column(0).take(pa.array(out[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(out[1], pa.string()), *(pa.array(x, pa.int64()) for x in out[2:])], names=["doc_id", "template", "span_start", "span_end", "n_matched", "n_template_words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found = rows.mapInArrow(run, "doc_id long, template string, span_start long, span_end long, n_matched long, n_template_words long")
    return found.withColumn("coverage", F.col("n_matched") / F.col("n_template_words"))
