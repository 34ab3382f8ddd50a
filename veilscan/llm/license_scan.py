"""License scan: winnowed fingerprints of templates pick candidates, a banded alignment measures them.

Templates are cut into words (letters and digits, without case); every window of ``WINDOW`` consecutive n-grams of a
template puts its smallest hash into an inverted index, hash -> (template, place). Texts look up all their
n-grams, so a text that holds a template's words holds all its fingerprints. Each diagonal with a hit and with enough
of the template's fingerprints on the diagonals within the band is aligned with the words around, wherever in the text other
hits lie, and matched words, coverage and span are reported if coverage suffices. Hits that no reported span covers are aligned again.

The index depends on the templates alone (its size is checked) and goes with the task; texts are looked at one by one, in one
narrow pass without a shuffle. Every occurrence in a text is reported whose words lie within ``BAND`` diagonals of a hit; words moved
further by insertions or deletions do not count as matched.

Defined results: null and empty texts and an empty table give no rows; rows that repeat are reported each; an occurrence is
given once per template, and occurrences of one template don't overlap; texts of any length are read in
whole; further columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.llm import words as W

GRAM, WINDOW = 3, 2
#: Half-width of the band, in words; the least coverage reported; the least share of a template's fingerprints in a region.
BAND, COVERAGE, SEEDS = 6, 0.8, 0.3
#: The most fingerprints an index may hold in a task.
INDEX_LIMIT = 1 << 22

# Public license notices.
TEMPLATES: Mapping[str, str] = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:"
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:"
    ),
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "gpl-3-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

_WORD = np.ones(256, dtype=np.uint8) * 32
_WORD[np.r_[48:58, 97:123, 128:256]] = np.r_[48:58, 97:123, 128:256]
_WORD[65:91] = np.arange(97, 123)


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of letter and digit words without case, their spans, and each text's first word."""
    plain = _WORD[data]
    starts, ends, firsts = W.spans(plain, offs)
    return W.word_hashes(plain, starts, ends), starts, ends, firsts


class Index:
    """Winnowed fingerprints of templates, sorted by hash."""

    def __init__(self, templates: Mapping[str, str], gram: int = GRAM, window: int = WINDOW):
        data, offs = W.texts(pa.array(list(templates.values()), pa.string()))
        hashes, _, _, firsts = _words(data, offs)
        self.names, self.gram = list(templates), gram
        self.words = [hashes[a:b] for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
        rows = []
        for t, words in enumerate(self.words):
            if len(words) < gram:
                raise ValueError(f"template {self.names[t]} has fewer than {gram} words")
            grams = W.grams(words, gram)
            last = max(1, len(grams) - window + 1)
            places = {int(i + np.argmin(grams[i : i + window])) for i in range(last)}
            rows += [(int(grams[p]), t, p) for p in sorted(places)]
        if len(rows) > INDEX_LIMIT:
            raise ValueError(f"{len(rows)} fingerprints are more than one task should hold: scan with the templates in parts")
        rows.sort()
        self.hashes = np.array([r[0] for r in rows], dtype=np.uint64)
        self.template = np.array([r[1] for r in rows], dtype=np.int64)
        self.place = np.array([r[2] for r in rows], dtype=np.int64)
        self.prints = np.bincount(self.template, minlength=len(self.names))

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each pair of a gram and an index entry with its hash."""
        low, high = np.searchsorted(self.hashes, grams, "left"), np.searchsorted(self.hashes, grams, "right")
        found = np.flatnonzero(high > low)
        counts = (high - low)[found]
        at = np.repeat(found, counts)
        entry = np.repeat(low[found], counts) + np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        return at, entry


def align(template: np.ndarray, text: np.ndarray, start: int, band: int) -> tuple[int, int, int]:
    """Align a template with text words within ``band`` of the diagonal from ``start``.

    Local alignment, a match counts 2, a mismatch or gap -1. Gives matched words and the span of text words
    from the first to the last match; (0, 0, 0) without any. Ties go to the earlier end.
    """
    m, n, width = len(template), len(text), 2 * band + 1
    template, text = template.tolist(), text.tolist()
    nothing = (0, 0, 0, 0)
    above, best = [nothing] * width, nothing
    for i in range(m):
        row, left = [], nothing
        for j in range(width):
            at = start + i + j - band
            cell = nothing
            if 0 <= at < n:
                score, matched, first, last = above[j]
                if template[i] == text[at]:
                    cell = (score + 2, matched + 1, first if matched else at, at + 1)
                elif score > 1:
                    cell = (score - 1, matched, first, last)
            if j + 1 < width and above[j + 1][0] - 1 > cell[0]:
                cell = (above[j + 1][0] - 1, *above[j + 1][1:])
            if left[0] - 1 > cell[0]:
                cell = (left[0] - 1, *left[1:])
            row.append(cell)
            left = cell
            if cell[0] > best[0]:
                best = cell
        above = row
    return best[1:]


def _supported(index: Index, doc: np.ndarray, template: np.ndarray, diagonal: np.ndarray, band: int, seeds: float) -> tuple[np.ndarray, np.ndarray]:
    """For hits ordered by text, template and diagonal: hits within ``band`` diagonals, and whether those are enough to align."""
    low, high = int(diagonal.min()) - band, int(diagonal.max()) + band
    pair = np.cumsum(np.append(False, (doc[1:] != doc[:-1]) | (template[1:] != template[:-1])))
    key = pair * (high - low + 1) + diagonal - low
    near = np.searchsorted(key, key + band, "right") - np.searchsorted(key, key - band, "left")
    return near, near >= np.maximum(1, np.ceil(seeds * index.prints[template]))


def _occurrences(
    words: np.ndarray, text: np.ndarray, base: int, seeds: list[tuple[int, list[int]]], band: int, coverage: float
) -> list[tuple[int, int, int]]:
    """(matched words, first word, word after the last) of a template's occurrences in a text, in order.

    Each diagonal of ``seeds`` comes with the words its hits begin at. A hit outside of all occurrences so far is aligned with the free
    words around it, again and again until it is inside of one or nothing more is found.
    """
    least = coverage * len(words)
    spans: list[tuple[int, int, int]] = []
    for diagonal, hits in seeds:
        failed = (-1, -1)
        for hit in hits:
            while True:
                k = bisect_right(spans, hit, key=itemgetter(0))
                if k and hit < spans[k - 1][1]:
                    break
                low = max(0, diagonal - base - 2 * band, spans[k - 1][1] if k else 0)
                high = min(len(text), diagonal - base + len(words) + 2 * band, spans[k][0] if k < len(spans) else len(text))
                if (low, high) == failed or high - low < least or np.isin(words, text[low:high]).sum() < least:
                    break
                matched, a, b = align(words, text[low:high], diagonal - base - low, band)
                if matched < least or not matched:
                    failed = (low, high)
                    break
                spans.insert(bisect_right(spans, low + a, key=itemgetter(0)), (low + a, low + b, matched))
    return [(matched, base + a, base + b) for a, b, matched in spans]


def scan_slice(index: Index, data: np.ndarray, offs: np.ndarray, band: int, coverage: float, seeds: float) -> list[tuple[int, int, int, int, int]]:
    """(text, template, matched words, start byte, end byte) of every occurrence in a slice."""
    hashes, starts, ends, firsts = _words(data, offs)
    grams = W.grams(hashes, index.gram)
    fits = W.inside(firsts, index.gram)[: len(grams)]
    at, entry = index.hits(grams)
    at, entry = at[fits[at]], entry[fits[at]]
    if not len(at):
        return []
    owner = W.owners(firsts)
    doc, template = owner[at], index.template[entry]
    diagonal = at - index.place[entry]
    order = np.lexsort((at, diagonal, template, doc))
    doc, template, at, diagonal = doc[order], template[order], at[order], diagonal[order]
    near, enough = _supported(index, doc, template, diagonal, band, seeds)
    doc, template, at, diagonal, near = doc[enough], template[enough], at[enough], diagonal[enough], near[enough]
    new = (doc[1:] != doc[:-1]) | (template[1:] != template[:-1])
    pairs = np.flatnonzero(np.append(True, new)) if len(doc) else np.zeros(0, dtype=np.int64)
    out: list[tuple[int, int, int, int, int]] = []
    for k, after in zip(pairs.tolist(), [*pairs[1:].tolist(), len(doc)], strict=True):
        d, t, base = int(doc[k]), int(template[k]), int(firsts[doc[k]])
        cuts = [k, *(k + 1 + np.flatnonzero(np.diff(diagonal[k:after]))).tolist(), after]
        # the best seeded diagonals first, of equal ones the first in the text
        ranked = sorted(zip(cuts, cuts[1:]), key=lambda c: (-min(int(near[c[0]]), int(index.prints[t])), c[0] - c[1], c[0]))
        found = _occurrences(
            index.words[t], hashes[base : int(firsts[d + 1])], base, [(int(diagonal[a]), (at[a:b] - base).tolist()) for a, b in ranked], band, coverage
        )
        out += [(d, t, matched, int(starts[a]), int(ends[b - 1])) for matched, a, b in found]
    return out


def scan(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
    band: int = BAND,
    coverage: float = COVERAGE,
    seeds: float = SEEDS,
) -> DataFrame:
    """A row per occurrence: id, ``license``, ``matched_words``, ``coverage``, ``span_start``, ``span_end`` (characters, end excluded)."""
    index = Index(templates)
    names = ["id", "license", "matched_words", "coverage", "span_start", "span_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = W.texts(batch.column(1))
            for first, _, part, cuts in W.slices(data, offs):
                found = scan_slice(index, part, cuts, band, coverage, seeds)
                if not found:
                    continue
                doc, template, matched, start, end = (np.array(c) for c in zip(*found, strict=True))
                points = np.zeros(len(part) + 1, dtype=np.int64)
                np.cumsum((part & 0xC0) != 0x80, out=points[1:])
                size = np.array([len(w) for w in index.words])[template]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(doc + first)),
                        pa.array([index.names[t] for t in template]),
                        pa.array(matched.astype(np.int64)),
                        pa.array(matched / size),
                        pa.array(points[start] - points[cuts[doc]]),
                        pa.array(points[end] - points[cuts[doc]]),
                    ],
                    names,
                )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    fields = f"id {kind}, license string, matched_words long, coverage double, span_start long, span_end long"
    return source.mapInArrow(run, fields).withColumnRenamed("id", id_col)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every whole text of ``documents``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
