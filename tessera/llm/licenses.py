"""License scans: MinHash bands over overlapping text windows retrieve license templates, and an exact shingle containment
verifies each match.

A template is contained where some stretch of at most `REACH` times its length holds 0.8 of its distinct shingles, whatever else
lies between them; the measure is of the text alone and does not depend on where windows begin. Documents are cut into blocks of
the longest reach of a size class; a window is two neighbouring blocks, so it holds any such stretch whole. A window that holds 0.8
of a template has a Jaccard with it of at least 0.8 m / (2 * block + 0.2 m), with m shingles in the template; the number of
one-row bands is chosen for a miss chance of at most `miss` there. Of a document and template that a window retrieves, every
stretch is measured.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, gram_hashes, id_and_text, map_batches
from .decontaminate import words_of

SHINGLE = 5
CONTAINED = 0.8
REACH = 2.5

# The words of public licence notices, to be matched as they are published.
TEMPLATES = {
    "apache-2.0-line": ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    "mit-line": ("MIT", "Released under the MIT License."),
    "gpl-3.0-line": ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    "cc-by-nc-4.0-line": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    "apache-2.0-header": ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    "mit-notice": ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    "gpl-notice": ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "bsd-conditions": ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "mpl-2.0-notice": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "cc-by-4.0-line": ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa-4.0-line": ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
}


@dataclass(frozen=True)
class SizeClass:
    names: tuple[str, ...]
    shingles: tuple[np.ndarray, ...]  # sorted distinct hashes of each template
    reach: tuple[int, ...]  # the longest stretch that a match of each may take, in shingles
    block: int


def shingle_set(text: str, n: int = SHINGLE) -> np.ndarray:
    words = words_of(text)
    if len(words) < n:
        raise ValueError(f"a template needs {n} words: {text!r}")
    return np.unique(gram_hashes(WordHashes().of(words), n))


def size_classes(templates: dict[str, tuple[str, str]], n: int = SHINGLE, ratio: float = 1.4, reach: float = REACH) -> list[SizeClass]:
    """Templates of like size together; a block is the longest reach of its class."""
    out: list[list[tuple[str, np.ndarray, int]]] = []
    for name, s, size in sorted(((k, shingle_set(t, n), len(words_of(t)) - n + 1) for k, (_, t) in templates.items()), key=lambda x: x[2]):
        if not out or size > ratio * out[-1][0][2]:
            out.append([])
        out[-1].append((name, s, size))
    return [SizeClass(tuple(x[0] for x in c), tuple(x[1] for x in c), tuple(math.ceil(reach * x[2]) for x in c), math.ceil(reach * c[-1][2])) for c in out]


def bands_for(classes: list[SizeClass], contained: float = CONTAINED, miss: float = 1e-4) -> int:
    """One-row bands so that a window with a match collides in one of them but for a chance of `miss`."""
    least = min(contained * len(s) / (2 * c.block + (1 - contained) * len(s)) for c in classes for s in c.shingles)
    return math.ceil(math.log(miss) / math.log(1 - least))


def multipliers(bands: int) -> np.ndarray:
    return np.random.default_rng(41).integers(0, 1 << 63, bands, np.uint64) * np.uint64(2) + np.uint64(1)


def _cut(lengths: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the blocks in the joined shingles, each window's first block, start and end. A document of one block is one window."""
    ends = np.cumsum(lengths)
    counts = -(-lengths // block)
    doc = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = (ends - lengths)[doc] + nth * block
    heads = np.flatnonzero((nth + 1 < counts[doc]) | (counts[doc] == 1))
    return starts, heads, starts[heads], np.minimum(starts[heads] + 2 * block, ends[doc[heads]])


def stretches(own: np.ndarray, template: np.ndarray, reach: int, contained: float) -> tuple[float, list[tuple[int, int]]]:
    """The largest share of a template's shingles in any stretch of `reach` shingles of a document, and the places that hold enough of
    it: from the left, each from its first shingle of the template to the last one that is new in the stretch, none over another."""
    at = np.searchsorted(template, own)
    where = np.flatnonzero(template[np.minimum(at, len(template) - 1)] == own)
    kinds, where = at[where].tolist(), where.tolist()
    held, distinct, most, end, beyond, places = [0] * len(template), 0, 0, 0, 0, []
    for i, first in enumerate(where):
        while beyond < len(where) and where[beyond] < first + reach:
            distinct += held[kinds[beyond]] == 0
            held[kinds[beyond]] += 1
            beyond += 1
        most = max(most, distinct)
        if distinct >= contained * len(template) and first >= end:
            seen: set[int] = set()
            for j in range(i, beyond):
                if kinds[j] not in seen:
                    seen.add(kinds[j])
                    end = where[j] + 1
            places.append((first, end))
        held[kinds[i]] -= 1
        distinct -= held[kinds[i]] == 0
    return most / len(template), places


def scan(shingles: np.ndarray, lengths: np.ndarray, classes: list[SizeClass], bands: int, contained: float = CONTAINED):
    """(document, template, containment, places) of the matches in the joined shingle sequences of documents; places count from the
    document's first shingle."""
    factors, cuts = multipliers(bands), [_cut(lengths, c.block) for c in classes]
    ends = np.cumsum(lengths)
    picked: set[tuple[int, int, int]] = set()  # document, class, template
    for f in factors:
        y = shingles * f
        for k, (c, (starts, heads, lo, _)) in enumerate(zip(classes, cuts, strict=True)):
            low = np.minimum.reduceat(y, starts)
            pair = np.minimum(low[heads], low[np.minimum(heads + 1, len(low) - 1)]) if len(low) > 1 else low[heads]
            for t, s in enumerate(c.shingles):
                hits = np.flatnonzero(pair == (s * f).min())
                picked.update((int(d), k, t) for d in np.searchsorted(ends, lo[hits], side="right"))
    for d, k, t in sorted(picked):
        share, places = stretches(shingles[ends[d] - lengths[d] : ends[d]], classes[k].shingles[t], classes[k].reach[t], contained)
        if places:
            yield d, classes[k].names[t], share, places


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, str]] = TEMPLATES, contained: float = CONTAINED, miss: float = 1e-4, n: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs and template it contains: doc_id, template_id, license, containment (of the best stretch),
    n_spans, spans (array of start, end in words, from the left, as `stretches` finds them; neighbours may share words of a shingle).

    Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII. Null, empty and shorter texts match nothing and give no row; texts
    are read whole, however long, with one pass for each template retrieved; of equal stretches the leftmost counts; repeated rows
    each give theirs; an empty table gives none; other columns are ignored.
    """
    classes = size_classes(templates, n)
    bands = bands_for(classes, contained, miss)

    def start():
        hashes = WordHashes()

        def each(batch: pa.RecordBatch):
            sequences = [gram_hashes(hashes.of(words_of(t)), n) for t in batch.column("text").to_pylist()]
            rows = [i for i, s in enumerate(sequences) if len(s)]
            if not rows:
                return None
            lengths = np.array([len(sequences[i]) for i in rows])
            found = sorted((rows[d], name, share, places) for d, name, share, places in scan(np.concatenate([sequences[i] for i in rows]), lengths, classes, bands, contained))
            if not found:
                return None
            spans = [[{"start": a, "end": b + n - 1} for a, b in places] for _, _, _, places in found]
            return {
                "doc_id": batch.column("doc_id").take(pa.array([i for i, *_ in found], pa.int32())), "template_id": [t for _, t, *_ in found],
                "license": [templates[t][0] for _, t, *_ in found], "containment": [share for _, _, share, _ in found], "n_spans": [len(s) for s in spans],
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            }

        return each

    kinds = "doc_id long, template_id string, license string, containment double, n_spans long, spans array<struct<start: long, end: long>>"
    return map_batches(id_and_text(docs, id_col, text_col), kinds, start)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    first, last = F.element_at("spans", 1), F.element_at("spans", -1)
    return out.select("doc_id", "template_id", "license", "containment", "n_spans", first["start"].alias("first_word"), last["end"].alias("last_word"))
