"""License scans: winnowed fingerprints pick templates, banded alignment reports coverage and spans.

Words are runs of letters and digits, lower-cased in A-Z. Templates are cut into k-word grams; in each window of
`window` grams the one of least hash is a fingerprint, and an inverted index holds their places. Every gram of a document is looked up,
so a text that shares k + window - 1 words in a row with a template has a hit. Hits near one diagonal
are one candidate. The template's words that stand within the band of their place bound what can match; where they suffice, a
local alignment inside the band gives the matched words, their share of the template (coverage) and the span in the document. Matches that reach `least` coverage are reported; of overlapping
ones the longer template's, then the better covered.

Each document is scanned on its own and nothing is shuffled; the index is as large as the templates, a parameter.

Edge cases. Null and empty texts match nothing. Rows that repeat an id are scanned each. Empty tables give empty results.
Extra columns are ignored. Several notices in one text give a row each, also of one template. Of templates that cover the same
words equally well the one listed first is reported. A very long text is scanned in one piece, some 60 bytes a word. A template
of fewer than k words is an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytewords import LOWER, column_bytes, mix, pieces, spans_hash, sums, words

APART = np.ones(256, dtype=bool)
APART[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = False

#: Common notices as their licenses give them. Further or longer templates are a parameter.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
}


class Index:
    """Templates as word codes, and an inverted index of their winnowed fingerprints."""

    def __init__(self, templates: Mapping[str, str], k: int, window: int):
        self.k, self.names = k, list(templates)
        coded = []
        for text in templates.values():
            data = LOWER[np.frombuffer(text.encode(), np.uint8)]
            starts, ends, _ = words(data, np.array([0, len(data)]), APART)
            if len(starts) < k:
                raise ValueError(f"a template needs {k} words: {text!r}")
            coded.append(spans_hash(sums(data), starts, ends))
        self.words = np.unique(np.concatenate(coded)) if coded else np.zeros(0, np.uint64)
        self.templates = [np.searchsorted(self.words, x) for x in coded]
        rows = []
        for t, codes in enumerate(self.templates):
            grams = self.grams(codes)
            for i in range(max(1, len(grams) - window + 1)):
                if len(grams):
                    j = i + int(np.argmin(grams[i : i + window]))
                    rows.append((int(grams[j]), t, j))
        rows = sorted(set(rows))
        self.keys = np.array([r[0] for r in rows], np.uint64)
        self.places = [r[1:] for r in rows]

    def grams(self, codes: np.ndarray) -> np.ndarray:
        n = max(len(codes) - self.k + 1, 0)
        h = np.zeros(n, np.uint64)
        for j in range(self.k):
            h = mix(h + codes[j : j + n].astype(np.uint64) + np.uint64(j))
        return h


def possible(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> int:
    """No alignment inside the band matches more words: the template's words that stand within `band` of their place."""
    size, low = len(template), diagonal - band
    around = np.full(size + 2 * band, -1, text.dtype)
    first, last = max(low, 0), min(low + len(around), len(text))
    if first >= last:
        return 0
    around[first - low : last - low] = text[first:last]
    seen = around[:size] == template
    for d in range(1, 2 * band + 1):
        seen |= around[d : d + size] == template
    return int(seen.sum())


def aligned(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """Best local alignment inside the band: matched words, first and last word of the text (-1 if none).

    The cell (i, i + diagonal + d), |d| <= band; a match gains 2, a replaced, missing or extra word costs 1."""
    width, size = 2 * band + 1, len(template)
    for start in range(max(diagonal - band, 0), min(diagonal + band, len(text) - size) + 1):
        if text[start] == template[0] and np.array_equal(text[start : start + size], template):  # word for word: nothing scores higher
            return size, start, start + size - 1
    none = (0, 0, -1, -1)  # score, matches, first, last
    before: list[tuple] = [none] * width
    best = none
    for i, word in enumerate(template.tolist()):
        row: list[tuple] = [none] * width
        for d in range(width):
            j = i + diagonal + d - band
            if 0 <= j < len(text):
                s, m, a, _ = before[d]
                if text[j] == word:
                    top = (s + 2, m + 1, a if a >= 0 else j, j)
                else:
                    top = (s - 1, m, a, j)
                if d + 1 < width and before[d + 1][0] - 1 > top[0]:
                    top = (before[d + 1][0] - 1, *before[d + 1][1:])
                if d and row[d - 1][0] - 1 > top[0]:
                    top = (row[d - 1][0] - 1, *row[d - 1][1:3], row[d - 1][3])
                row[d] = top if top[0] > 0 else none
                if top[0] > best[0]:
                    best = top
        before = row
    return best[1], best[2], best[3]


def templates_in(folder: str) -> dict[str, str]:
    """Templates from the files of a local folder: the name without its ending, and the text."""
    return {path.stem: path.read_text(encoding="utf-8") for path in sorted(Path(folder).iterdir()) if path.is_file()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, str] | None = None, k: int = 3, window: int = 3, band: int = 6, least: float = 0.8) -> DataFrame:
    """One row per notice found: id, template, matched (words), coverage, start and end (bytes of the text), passage.

    templates: by default the notices above and the full texts of the folder `licenses` beside this module."""
    index = Index(TEMPLATES | templates_in(str(Path(__file__).parent / "licenses")) if templates is None else templates, k, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            out = []
            raw, offsets = column_bytes(batch.column(text_col))
            data = LOWER[raw]
            starts, ends, first = words(data, offsets, APART)
            hashes = spans_hash(sums(data), starts, ends)
            at = np.minimum(np.searchsorted(index.words, hashes), max(len(index.words) - 1, 0))
            codes = np.where(index.words[at] == hashes, at, -1) if len(index.words) else np.full(len(hashes), -1)
            known = codes >= 0
            run_ = np.ones(max(len(codes) - k + 1, 0), bool)
            for j in range(k):
                run_ &= known[j : j + len(run_)]
            place = np.flatnonzero(run_)
            doc = np.searchsorted(first, place, "right") - 1
            inside = place + k <= first[doc + 1] if len(place) else np.zeros(0, bool)
            place, doc = place[inside], doc[inside]
            grams = np.zeros(len(place), np.uint64)
            for j in range(k):
                grams = mix(grams + codes[place + j].astype(np.uint64) + np.uint64(j))
            hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
            low, high = np.searchsorted(index.keys, grams, "left"), np.searchsorted(index.keys, grams, "right")
            for p, d, a, b in zip(place.tolist(), doc.tolist(), low.tolist(), high.tolist()):
                for t, i in index.places[a:b]:
                    hits.setdefault((d, t), []).append((p - int(first[d]) - i, p - int(first[d])))
            found: dict[int, list[tuple]] = {}
            for (d, t), own in hits.items():
                template = index.templates[t]
                wanted, last = least * len(template), None
                if first[d + 1] - first[d] < wanted:  # a text of fewer words can't cover it
                    continue
                text = codes[first[d] : first[d + 1]].copy()
                for diagonal, at_ in sorted(own):
                    # words of a notice found are taken, so that a hit beside it finds its own; one without a notice speaks for its band
                    while text[at_] >= 0 and (last is None or diagonal > last + band):
                        matched, a, b = aligned(template, text, diagonal, band) if possible(template, text, diagonal, band) >= wanted else (0, -1, -1)
                        if matched >= wanted:
                            found.setdefault(d, []).append((len(template), matched / len(template), a, b, t, matched))
                            text[a : b + 1] = -1
                        else:
                            last = diagonal
            for d, matches in found.items():
                taken: list[tuple[int, int]] = []
                for _, coverage, a, b, t, matched in sorted(matches, key=lambda m: (-m[1] * m[0], -m[1], m[2], m[4])):
                    if all(b < x or a > y for x, y in taken):
                        taken.append((a, b))
                        s, e = int(starts[first[d] + a] - offsets[d]), int(ends[first[d] + b] - offsets[d])
                        passage = raw[offsets[d] + s : offsets[d] + e].tobytes().decode("utf-8", "replace")
                        out.append((batch.column(id_col)[d].as_py(), index.names[t], matched, coverage, s, e, passage))
            kinds = (batch.schema.field(id_col).type, pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 7, kinds)], [id_col, "template", "matched", "coverage", "start", "end", "passage"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, template string, matched long, coverage double, start long, end long, passage string")
