"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Templates and texts are sequences of words in lower case without punctuation, as hashes of their n-grams. Templates fall into
length classes, each at most a quarter longer than the last. A text is cut into windows of the class's length and a quarter more, which overlap by all
but that quarter, so that every place as long as a template of the class lies whole in some window. A window that holds `containment` of
a template has a Jaccard similarity with it of 0.8 T / (0.2 T + W) at least, T and W being their n-grams: 0.45 or more for long templates, and for
each template what Templates.similarity says. A window and a template are a candidate if one of BANDS bands of one MinHash row agrees; at a
similarity s that happens with a probability of 1 - (1 - s)^BANDS, 0.9999 for s = 0.25. A candidate is a match when the window holds at
least `containment` of the template's n-grams. A text without any n-gram of any template cannot match and leaves at once.

Templates are a small fixed table that goes to every executor; nothing is shuffled.

Defined results: a null or empty text has no matches; templates of fewer than N words are one n-gram of all their words and
found by it, those without words never; of several windows with one template the best, then the first, is reported; repeated rows are
scanned each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table
from corpusloom.llm.jaccard_join import BLOCK_BYTES, mix, word_hashes
from corpusloom.session import ship

N, CONTAINMENT, BANDS = 5, 0.8, 32
#: Notices by which works are put under a license.
TEMPLATES: dict[str, str] = {
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
    "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
    "in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0-terms": "Unless required by applicable law or agreed to in writing, software distributed under the License "
    "is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
    "License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
    "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for "
    "more details.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met:",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
    "was not distributed with this file, You can obtain one at",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
    "this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Proprietary": "All rights reserved.",
}
#: Bytes that stand between words: all of ASCII but letters and digits.
_GAPS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Quotes, dashes and blanks beyond ASCII that stand between words, too.
_MARKS = dict.fromkeys([0xA0, *range(0x2010, 0x2016), *range(0x2018, 0x201F), 0x2022, 0x2026], " ")
_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
FILTER = 1 << 16


def plain(text: str) -> str:
    """The text, of the same length, with such marks as blanks."""
    return text if text.isascii() else text.translate(_MARKS)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n words, in text order."""
    count = max(0, len(hashes) - n + 1)
    h = np.full(count, n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + count]
    return mix(h)


class Templates:
    """Sets of the templates' n-grams, their bands and windows by length classes, and what no text without a template's n-gram passes."""

    def __init__(self, texts: dict[str, str], containment: float = CONTAINMENT):
        self.sets: dict[str, np.ndarray] = {}
        self.n: dict[str, int] = {}
        #: (n, step, width): for each band the templates by their least hash.
        self.classes: dict[tuple[int, int, int], list[dict[int, list[str]]]] = {}
        #: The least similarity of a window that holds `containment` of a template, over all templates.
        self.similarity = 1.0
        for name, text in texts.items():
            words = word_hashes(plain(text).encode(), gaps=_GAPS)[0]
            if not len(words):
                continue
            n = min(N, len(words))
            own = np.unique(grams(words, n))
            self.n[name], self.sets[name] = n, own
            size = 1
            while size < len(own):
                size = max(size + 1, size * 5 // 4)
            step = max(1, size // 4)
            least = -(-len(own) * containment // 1)
            self.similarity = min(self.similarity, least / (len(own) + size + step - least))
            held = self.classes.setdefault((n, step, size + step), [{} for _ in range(BANDS)])
            for band, value in zip(held, self.minhash(own)):
                band.setdefault(int(value), []).append(name)
        self.any = {n: np.unique(np.concatenate([s for t, s in self.sets.items() if self.n[t] == n])) for n in set(self.n.values())}
        self.maybe = {n: np.bincount((g & np.uint64(FILTER - 1)).astype(np.int64), minlength=FILTER) > 0 for n, g in self.any.items()}

    @staticmethod
    def minhash(found: np.ndarray) -> np.ndarray:
        return mix(found[None, :] * _SEEDS[:, None]).min(1)

    def hits(self, g: np.ndarray, n: int) -> np.ndarray:
        """Where n-grams of templates stand."""
        at = np.flatnonzero(self.maybe[n][(g & np.uint64(FILTER - 1)).astype(np.int64)])
        return at[np.isin(g[at], self.any[n])]


def matches(hashes: np.ndarray, templates: Templates, containment: float = CONTAINMENT) -> list[tuple[str, float, int, int]]:
    """(license, containment, first word, last word) of the templates found in a text's words."""
    best: dict[str, tuple[float, int, int]] = {}
    held = {n: grams(hashes, n) for n in templates.any}
    hits = {n: templates.hits(g, n) for n, g in held.items()}
    for (n, step, width), bands in templates.classes.items():
        g, hit = held[n], hits[n]
        if not len(hit):
            continue
        first = np.unique(np.concatenate([hit // step - k for k in range(-(-width // step))]))
        for a in (first[first >= 0] * step).tolist():
            window = np.unique(g[a : a + width])
            for name in {t for band, x in zip(bands, templates.minhash(window)) for t in band.get(int(x), ())}:
                share = np.isin(window, templates.sets[name]).sum() / len(templates.sets[name])
                if share >= containment and share > best.get(name, (0,))[0]:
                    at = np.flatnonzero(np.isin(g[a : a + width], templates.sets[name])) + a
                    best[name] = (float(share), int(at[0]), int(at[-1]) + n - 1)
    return [(name, *found) for name, found in sorted(best.items())]


def _in_block(texts: list[str], templates: Templates, containment: float) -> Iterator[tuple[int, str, float, int, int]]:
    """(text's place, license, containment, start, end): words of all texts are hashed at once, and only texts with an n-gram of a template,
    or with one across their border, are looked at alone."""
    raw = [plain(t).encode() for t in texts]
    hashes, starts = word_hashes(b"\n".join(raw), gaps=_GAPS)
    begins = np.concatenate([[0], np.cumsum([len(b) + 1 for b in raw])])
    words = np.searchsorted(starts, begins)
    asked = [np.searchsorted(words, templates.hits(grams(hashes, n), n), "right") - 1 for n in templates.any]
    for i in np.unique(np.concatenate(asked)).tolist() if asked else []:
        own = hashes[words[i] : words[i + 1]]
        found = matches(own, templates, containment)
        if not found:
            continue
        data = np.frombuffer(raw[i], np.uint8)
        place = np.cumsum((data & 0xC0) != 0x80)  # code points up to each byte
        at = starts[words[i] : words[i + 1]] - begins[i]
        for name, share, a, b in found:
            gap = np.flatnonzero(_GAPS[data[at[b] :]])
            stop = at[b] + gap[0] if len(gap) else len(data)
            yield i, name, share, int(place[at[a]]) - 1, int(place[stop - 1])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment, start, end), offsets in code points, for each template found in a document."""
    texts = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(texts, containment)
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), []
            block: list[tuple[int, str]] = []
            size = 0
            for i, x in enumerate(batch.column("text")):
                text = x.as_py() or ""
                if block and size + len(text) > BLOCK_BYTES:
                    rows += [(ids[block[k][0]], *m) for k, *m in _in_block([t for _, t in block], known, containment)]
                    block, size = [], 0
                block.append((i, text))
                size += len(text)
            if block:
                rows += [(ids[block[k][0]], *m) for k, *m in _in_block([t for _, t in block], known, containment)]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "license", "containment", "start", "end"]
            )

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, license string, containment double, start bigint, end bigint"
    )


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
