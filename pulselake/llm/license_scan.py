"""License scans: MinHash bands over overlapping text windows retrieve templates, and exact shingle
containment verifies them.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased and outer punctuation dropped; shingles have five
words. Templates are grouped by their number of shingles m (1, 2-3, 4-7, ...); for a group of up to m
shingles the whole document is covered by windows of 2m - 1 shingles that start every m, so each stretch
of m shingles lies in one of them. A template whose shingles are contained to a share c >= 0.8 has
Jaccard similarity of at least s with that window, where s follows from m, c and the window; one-row
bands are added until a pair at s collides with probability 0.999. Retrieved templates are verified in
the retrieved window on exact shingles: at least 0.8 of the template's distinct shingles.

Templates are a fixed list held by every task. Nothing is shuffled but the matches, which are reduced
to one row for each document and template.

Defined results: null and empty texts match nothing; a match is reported once for each document and
template with its first word and its number of places; repeated rows (same doc_id, null among them) are
reported as one document; a share of exactly 0.8 matches; of equal shares the first place counts; documents
without a match have no row; a template of fewer than five words is an error; extra columns are ignored; empty gives empty.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, documents, mix, slices, small_batches, utf8, word_hashes, words

#: Public license notices, by name.
TEMPLATES = {
    "gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "mit": "Released under the MIT License.",
    "apache-2": "Licensed under the Apache License, Version 2.0.",
    "apache-2-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    'You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, '
    'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, '
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
_EDGE = np.zeros(256, bool)
_EDGE[list(b"\"'()[]{}.,;:!?*")] = True
SHINGLE = 5


def trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word bounds without outer punctuation, however much of it; a word of punctuation alone stays as it is."""
    core = np.flatnonzero(~_EDGE[data])
    if not len(core):
        return starts, ends
    first = core[np.minimum(np.searchsorted(core, starts), len(core) - 1)]
    last = core[np.maximum(np.searchsorted(core, ends) - 1, 0)] + 1
    bare = (first < starts) | (first >= ends)
    return np.where(bare, starts, first), np.where(bare, ends, last)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle fingerprints of all rows, where each row's begin, and each row's first word."""
    lower = LOWER[data]
    starts, ends, first = words(lower, offsets)
    if len(starts):
        starts, ends = trimmed(lower, starts, ends)
    hashed = word_hashes(lower, starts, ends)
    made = np.maximum(np.diff(first) - SHINGLE + 1, 0)
    begin = np.concatenate([[0], np.cumsum(made)])
    at = np.repeat(first[:-1], made) + np.arange(begin[-1]) - np.repeat(begin[:-1], made)
    out = np.full(len(at), SHINGLE, np.uint64)
    for j in range(SHINGLE):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashed[at + j])
    return out, begin, first


def bands_needed(m: int, smallest: int, containment: float, miss: float) -> int:
    """One-row bands so that a contained template of ``smallest`` to m shingles collides with its
    window of 2m - 1 shingles but for ``miss``."""
    similarity = min(0.999, math.ceil(containment * smallest) / (2 * m - 1 + smallest))
    return math.ceil(math.log(miss) / math.log(1 - similarity))


class Group:
    """Templates of up to m shingles with their band tables."""

    def __init__(self, m: int, templates: list[tuple[int, np.ndarray]], containment: float, miss: float):
        self.m, self.templates = m, templates
        self.bands = bands_needed(m, min(len(t) for _, t in templates), containment, miss)
        seeds = np.random.default_rng(m).integers(1, 1 << 63, self.bands, dtype=np.uint64)
        self.seeds = seeds * np.uint64(2) + np.uint64(1)
        self.tables = []
        for seed in self.seeds:
            keys = np.array([(t * seed).min() for _, t in templates], np.uint64)
            order = np.argsort(keys)
            self.tables.append((keys[order], order))


def load(templates: dict[str, str], containment: float, miss: float) -> list[Group]:
    by: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, text in enumerate(templates.values()):
        data, offsets = utf8(pa.array([text]))
        own = np.unique(shingles(data, offsets)[0])
        if not len(own):
            raise ValueError(f"a template needs at least {SHINGLE} words: {text!r}")
        by.setdefault(2 ** math.ceil(math.log2(len(own))), []).append((i, own))
    return [Group(m, own, containment, miss) for m, own in sorted(by.items())]


def _scan(templates: dict[str, str], containment: float, miss: float):
    schema = pa.schema([("doc_id", pa.int64()), ("text_id", pa.int64()), ("template", pa.int32()), ("first_word", pa.int64()), ("share", pa.float64())])

    def run(batches):
        groups = load(templates, containment, miss)
        for batch in small_batches(batches):
            data, offsets = utf8(batch.column(1))
            hashes, begin, _ = shingles(data, offsets)
            if not len(hashes):
                continue
            for group in groups:
                # blocks of m shingles, cut anew in each row; a window is a block and the next one
                m = group.m
                blocks = -(-np.diff(begin) // m)
                first = np.concatenate([[0], np.cumsum(blocks)])
                row = np.repeat(np.arange(len(blocks)), blocks)
                start = begin[row] + (np.arange(first[-1]) - first[row]) * m
                has_next = np.arange(first[-1]) + 1 < first[row + 1]
                found: list[np.ndarray] = []
                for seed, (keys, order) in zip(group.seeds, group.tables, strict=True):
                    low = np.minimum.reduceat(hashes * seed, start)
                    if m > 1:
                        after = np.append(low[1:], np.uint64(0xFFFFFFFFFFFFFFFF))
                        low = np.where(has_next, np.minimum(low, after), low)
                    left, right = np.searchsorted(keys, low, "left"), np.searchsorted(keys, low, "right")
                    hit = np.flatnonzero(right > left)
                    for j in range(int((right - left).max(initial=0))):
                        own = hit[left[hit] + j < right[hit]]
                        found.append(np.stack([own, order[left[own] + j]]))
                if not found:
                    continue
                pairs = np.unique(np.concatenate(found, axis=1), axis=1)
                out = []
                for window, t in pairs.T:
                    which, wanted = group.templates[t]
                    a = int(start[window])
                    part = hashes[a : min(a + 2 * m - 1 if m > 1 else a + 1, int(begin[row[window] + 1]))]
                    inside = np.isin(part, wanted)
                    share = len(np.unique(part[inside])) / len(wanted)
                    if share >= containment:
                        at = a + int(np.argmax(inside)) - int(begin[row[window]])
                        out.append((row[window], which, at, share))
                if out:
                    r, t, w, s = zip(*out, strict=True)
                    yield slices({"doc_id": batch.column(0).take(pa.array(r)), "text_id": batch.column(2).take(pa.array(r)), "template": t, "first_word": w, "share": s}, schema)

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, miss: float = 0.001) -> DataFrame:
    """``(doc_id, license, first_word, n_places, containment)`` of ``docs (doc_id, text)``."""
    templates = TEMPLATES if templates is None else templates
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_id"))
    hits = rows.mapInArrow(_scan(templates, containment, miss), "doc_id long, text_id long, template int, first_word long, share double")
    names = F.array(*[F.lit(n) for n in templates])
    hits = hits.groupBy("doc_id", "template").agg(F.min("first_word").alias("first_word"), F.countDistinct("text_id", "first_word").alias("n_places"), F.max("share").alias("containment"))
    return hits.select("doc_id", F.get(names, F.col("template")).alias("license"), "first_word", "n_places", "containment")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
