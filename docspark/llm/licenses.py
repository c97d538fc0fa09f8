"""License notices in texts: MinHash bands over overlapping windows find templates, exact containment verifies them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.hashing import mix, shingles, word_blocks

#: Fixed values: (template, license, text of the notice).
TEMPLATES = [
    ("mit-line", "MIT", "Released under the MIT License."),
    ("mit-line-2", "MIT", "This project is licensed under the MIT License."),
    ("mit-grant", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit-warranty", "MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("apache-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-header", "Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-warranty", "Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl3-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-grant", "GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-warranty", "GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("bsd-grant", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-endorse", "BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-warranty", "BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("lgpl-grant", "LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-grant", "AGPL", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("epl-line", "EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("boost-grant", "BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib-grant", "Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("mpl-header", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc-grant", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "Unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-line", "CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-line", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-long", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]
_BLANK = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_HEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])


def _plain(text: str | None) -> bytes:
    """UTF-8 with all ASCII but letters and digits blanked: punctuation doesn't part notices."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BLANK)


class Templates:
    """Templates' shingle sets and MinHash band keys, and the windows that fit each."""

    def __init__(self, rows: list[tuple[str, str, str]], k: int, bands: int, rows_a_band: int, threshold: float):
        self.rows, self.k, self.bands, self.each, self.threshold = rows, k, bands, rows_a_band, threshold
        self.factor = mix(np.arange(1, bands * rows_a_band + 1, dtype=np.uint64)) | np.uint64(1)
        self.sets, keys, owner, width = [], [], [], []
        for i, (_, _, text) in enumerate(rows):
            words = np.concatenate([b[4] for b in word_blocks([_plain(text)])])
            items = np.unique(shingles(words, k))
            self.sets.append(items)
            # the least power of two that holds the template with a quarter to spare; a single shingle needs none
            width.append(1 if len(items) == 1 else 1 << int(np.ceil(np.log2(1.25 * len(items)))))
            least = [(items * f).min() for f in self.factor]
            keys += self._keys([np.array([x]) for x in least], self.bands)
            owner += [i] * bands
        self.width = np.array(width)
        flat, own = np.concatenate(keys), np.array(owner)
        self.by_width = {}
        for w in sorted(set(width)):
            some = self.width[own] == w
            order = np.argsort(flat[some], kind="stable")
            self.by_width[w] = flat[some][order], own[some][order]

    def _keys(self, least: list[np.ndarray], bands: int) -> list[np.ndarray]:
        out = []
        for b in range(bands):
            total = np.full(len(least[0]), b + 1, np.uint64)
            for x in least[b * self.each : (b + 1) * self.each]:
                total = mix(total + x)
            out.append(total)
        return out

    def candidates(self, items: np.ndarray, first: np.ndarray, n: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, template, start of window) whose band keys agree; ``items`` holds all texts' shingles in order."""
        found: set[tuple[int, int, int]] = set()
        starts = {}
        for w in self.by_width:
            step = w - max(1, int(w / 1.25)) + 1  # a notice of w / 1.25 shingles at most lies whole in a window
            count = np.where(n > 0, np.maximum(0, -(-(n - w) // step)) + 1, 0)
            text = np.repeat(np.arange(len(n)), count)
            j = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
            starts[w] = text, first[text] + np.minimum(j * step, np.maximum(n[text] - w, 0)), np.minimum(w, n[text])
        widest = max(self.by_width)
        least: dict[int, list[np.ndarray]] = {w: [] for w in self.by_width}
        # windows of one shingle agree in every band or in none: one band tells
        bands = {w: 1 if w == 1 else self.bands for w in self.by_width}
        for i, f in enumerate(self.factor):
            level, size, levels = items * f, 1, {}
            levels[1] = level
            while size < widest and 2 * size <= len(items):
                level = np.minimum(level[: len(level) - size], level[size:])
                size *= 2
                levels[size] = level
            for w, (_, at, length) in starts.items():
                if i >= bands[w] * self.each:
                    continue
                power = (1 << np.floor(np.log2(np.maximum(length, 1))).astype(np.int64)) if len(length) else length
                out = np.empty(len(at), np.uint64)
                for p in np.unique(power):
                    some = power == p
                    out[some] = np.minimum(levels[p][at[some]], levels[p][at[some] + length[some] - p])
                least[w].append(out)
        for w, (text, at, _) in starts.items():
            known, owner = self.by_width[w]
            low, high = known.min(), known.max()
            for key in self._keys(least[w], bands[w]):
                place = np.minimum(np.searchsorted(known, key), len(known) - 1)
                for i in np.flatnonzero((known[place] == key) & (key >= low) & (key <= high)):
                    p = place[i]
                    while p < len(known) and known[p] == key[i]:
                        found.add((int(text[i]), int(owner[p]), int(at[i])))
                        p += 1
        return found


def license_scan(docs: DataFrame, templates: list[tuple[str, str, str]] | None = None, k: int = 5, bands: int = 20, rows: int = 1, threshold: float = 0.8) -> DataFrame:
    """License notices in every whole text of ``docs`` (doc_id, text).

    Returns a row for each text, template and place found: doc_id, template, license, containment (share of the template's
    ``k``-word shingles there, at least ``threshold``), start, end (code points of the first and the last matching
    shingle, end exclusive). Case and punctuation don't count. Windows overlap so that a notice lies whole in
    one of at most 2.5 times its shingles; such a window agrees with its template at 0.3 or more, so one of 20 bands
    of one row does with probability over 0.999; a template of one shingle is found wherever it stands. Places of a
    template with less than its length between them are one, with the best containment. Texts that are null, empty or without a notice give no row.
    Repeated rows give repeated results, empty tables none; very long texts are read whole. Without ``templates`` the
    list above is used; an empty list finds nothing.
    """
    if templates is not None and not templates:
        return docs.sparkSession.createDataFrame([], "doc_id long, template string, license string, containment double, start long, end long")
    library = Templates(TEMPLATES if templates is None else templates, k, bands, rows, threshold)
    held = docs.sparkSession.sparkContext.broadcast(library)  # a fixed list of notices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = held.value
        for batch in batches:
            out: list[tuple] = []
            for i in range(0, batch.num_rows, 200):
                some = batch.slice(i, 200)
                texts = [_plain(x) for x in some.column("text").to_pylist()]
                ids = some.column("doc_id").to_pylist()
                out += _scanned(t, texts, ids)
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["doc_id", "template", "license", "containment", "start", "end"])

    schema = "doc_id long, template string, license string, containment double, start long, end long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _scanned(t: Templates, texts: list[bytes], ids: list) -> list[tuple]:
    blocks = list(word_blocks(texts))
    if not blocks:
        return []
    owner, value = np.concatenate([b[0] for b in blocks]), np.concatenate([b[4] for b in blocks])
    words = np.split(value, np.searchsorted(owner, np.arange(1, len(texts))))
    items = [shingles(w, t.k) for w in words]
    n = np.array([len(x) for x in items])
    first = np.cumsum(n) - n
    flat = np.concatenate(items)
    places: dict[tuple[int, int], set[tuple[int, int, float]]] = {}
    for text, template, at in t.candidates(flat, first, n):
        w, have = int(t.width[template]), t.sets[template]
        low, high = max(int(first[text]), at - w), min(int(first[text] + n[text]), at + 2 * w)
        window = flat[low:high]
        # a place: matching shingles with no gap wider than the template between them
        hits = np.flatnonzero(np.isin(window, have))
        for run in np.split(hits, np.flatnonzero(np.diff(hits) > len(have)) + 1) if len(hits) else ():
            share = len(np.unique(window[run])) / len(have)
            if share >= t.threshold:
                from_text = low - int(first[text])
                places.setdefault((text, template), set()).add((int(run[0]) + from_text, int(run[-1]) + from_text, share))
    out = []
    for (text, template), found in sorted(places.items()):
        edges = _word_edges(texts[text])
        head = np.concatenate([[0], np.cumsum(_HEAD[np.frombuffer(texts[text], np.uint8)])])
        name, license_, _ = t.rows[template]
        joined: list[list] = []
        for a, b, share in sorted(found):
            if joined and a <= joined[-1][1]:
                joined[-1][1:] = max(joined[-1][1], b), max(joined[-1][2], share)
            else:
                joined.append([a, b, share])
        for a, b, share in joined:
            last = min(b + t.k, len(edges)) - 1
            out.append((ids[text], name, license_, share, int(head[edges[a][0]]), int(head[edges[last][1]])))
    return out


def _word_edges(data: bytes) -> np.ndarray:
    gap = np.ones(len(data) + 2, bool)
    raw = np.frombuffer(data, np.uint8)
    gap[1:-1] = raw == 32
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return np.stack([edge[::2], edge[1::2]], 1)
