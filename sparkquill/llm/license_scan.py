"""License scans: MinHash over overlapping windows retrieves templates, exact containment verifies them.

Words are runs of letters and digits, lower-cased; a shingle is five words. Texts are hashed once; windows overlap: for a
template of n shingles, with s the power of two from n on, windows are 1.5 s long and start every s / 2, so each place
where it may stand lies whole in a window. If the window holds a share c of its shingles, their Jaccard similarity is
at least c n / (1.5 s + (1 - c) n), that is 0.25 for c = 0.8 at the worst n. With `BANDS` bands of one row each a window
and a template agree in a band with probability 1 - (1 - J) ** BANDS: over 0.9998 for 48 bands. Whoever agrees is
verified: the exact share of the template's distinct shingles in the window's surroundings must be 0.8 or more.

Window minima are taken from minima of blocks, so all window sizes together cost little more than the smallest. Only
templates are shared with the workers; texts stay where they are read, nothing is shuffled. Giant texts are scanned in
overlapping pieces.

A template of fewer than EXACT shingles, such as a notice or a heading, is too small for a share: it is found by the hash
of its whole sequence of words over runs of its own length; its containment is 1. One that ends with a line break must
fill its line.

Defined results. A null or empty text has no shingles and no matches. A template found several
times has one row, of the best containment and then the first place. Rows without a match give none. Repeated rows give
repeated matches. A word is cut at 4 Mi characters, where a giant text without white space goes on to its next piece;
texts are scanned whole. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.llm.arrowio import in_pieces, lean, sized

SHINGLE, CONTAINED, BANDS = 5, 0.8, 48
#: Shingles below which a template must stand whole.
EXACT = 3
PIECE = 4 << 20

#: Notices and grants by SPDX identifier, as licenses and their stewards publish them.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
]

#: Short notices, headings that fill their line, and SPDX tags. They are numbered after TEMPLATES.
_IDENTIFIERS = "MIT ISC Apache-2.0 BSD-2-Clause BSD-3-Clause 0BSD GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 MPL-2.0 EPL-2.0 BSL-1.0 Zlib Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0"
NOTICES: list[tuple[str, str]] = [
    ("All-Rights-Reserved", "All rights reserved."),
    ("MIT", "MIT License\n"),
    ("MIT", "The MIT License\n"),
    ("MIT", "The MIT License (MIT)\n"),
    ("ISC", "ISC License\n"),
    ("Apache-2.0", "Apache License 2.0\n"),
    ("BSD-2-Clause", "BSD 2-Clause License\n"),
    ("BSD-3-Clause", "BSD 3-Clause License\n"),
    *[(x, f"SPDX-License-Identifier: {x}") for x in _IDENTIFIERS.split()],
]

#: Full texts of licenses that are short enough to stand in a page, without their titles and copyright lines.
_NO_WARRANTY = "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, " + _NO_WARRANTY
FULL_TEXTS: list[tuple[str, str]] = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
]


def all_templates() -> list[tuple[str, str]]:
    """TEMPLATES, NOTICES and FULL_TEXTS, numbered in this order."""
    return [*TEMPLATES, *NOTICES, *FULL_TEXTS]


def templates_of(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """Templates from a folder of license texts, named by their files; a bounded list such as a system's common licenses."""
    rows = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value").collect()
    return sorted((r["name"].removesuffix(".txt"), r["value"]) for r in rows)


_WORD = re.compile(r"[^\W_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Hashes(dict):
    """Hashes of words; those met are kept, up to a number."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of `size` word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, size):
        out = out * _MULT + words[i : i + n]
    return _mixed(out)


def _functions(bands: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(1, 1 << 63, bands, dtype=np.uint64) | np.uint64(1), rng.integers(1, 1 << 63, bands, dtype=np.uint64)


class Templates:
    """Signatures of the templates by window class."""

    def __init__(self, templates: list[tuple[str, str]], bands: int):
        words = _Hashes()
        self.sets, self.sizes, self.n_words = [], [], []
        #: Templates under EXACT shingles, by their words: number, hash of the whole, and the line they must fill.
        self.short: dict[int, list[tuple[int, np.uint64, re.Pattern | None]]] = {}
        for i, (_, text) in enumerate(templates):
            found = _WORD.findall(text.lower())
            self.n_words.append(len(found))
            hashed = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
            short = 0 < len(found) < SHINGLE + EXACT - 1
            if short:
                gap = r"(?:[^\w\n]|_)"
                line = re.compile(rf"^{gap}*+({(gap + '++').join(found)}){gap}*+$", re.M) if text.endswith("\n") else None
                self.short.setdefault(len(found), []).append((i, shingles(hashed, len(found))[0], line))
            s = np.unique(shingles(hashed))
            self.sets.append(s)
            self.sizes.append(0 if short else len(found) - SHINGLE + 1)
        self.mult, self.add = _functions(bands)
        self.classes: dict[int, list[int]] = {}
        for i, n in enumerate(self.sizes):
            if n > 0:
                self.classes.setdefault(1 << (n - 1).bit_length(), []).append(i)
        self.minima = [np.array([_band(s, m, a).min() if len(s) else 0 for s in self.sets], np.uint32) for m, a in zip(self.mult, self.add, strict=True)]


def _band(s: np.ndarray, mult: np.uint64, add: np.uint64) -> np.ndarray:
    return ((s * mult + add) >> np.uint64(32)).astype(np.uint32)


def candidates(s: np.ndarray, valid: np.ndarray, t: Templates) -> dict[int, np.ndarray]:
    """For each template the windows (by number) that agree with it in a band. s: shingles of texts that stand in a row."""
    hits: dict[int, list[np.ndarray]] = {i: [] for members in t.classes.values() for i in members}
    largest = max(t.classes, default=1)
    pad = -len(s) % largest
    for k in range(len(t.mult)):
        values = _band(s, t.mult[k], t.add[k])
        values[~valid] = 0xFFFFFFFF
        block, width = np.r_[values, np.full(pad + largest, 0xFFFFFFFF, np.uint32)], 1
        while width <= max(1, largest // 2):
            for size in (1, 2) if width == 1 else (2 * width,):
                if size in t.classes:
                    window = block[:-2] if size == 1 else np.minimum(np.minimum(block[:-2], block[1:-1]), block[2:])
                    for i in t.classes[size]:
                        hits[i].append(np.flatnonzero(window == t.minima[k][i]))
            block = np.minimum(block[::2], block[1::2]) if len(block) % 2 == 0 else np.minimum(block[: len(block) - 1 : 2], block[1::2])
            width *= 2
    return {i: np.unique(np.concatenate(h)) for i, h in hits.items() if h}


def scan(texts: list[str], t: Templates, words: _Hashes) -> list[tuple[int, int, float, int]]:
    """(text, template, containment, first word) of the verified matches."""
    texts = [x.lower() for x in texts]
    found = [_WORD.findall(x) for x in texts]
    bounds = np.r_[0, np.cumsum([len(f) for f in found], dtype=np.int64)]
    flat = np.fromiter((words[w] for f in found for w in f), np.uint64, int(bounds[-1]))
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for n, members in t.short.items():
        runs = shingles(flat, n)
        for i, whole, line in members:
            at = np.flatnonzero(runs == whole)
            at = at[owner[at] == owner[at + n - 1]]
            docs, first = np.unique(owner[at], return_index=True)
            for doc, k in zip(docs.tolist(), first.tolist(), strict=True):
                if line is None:
                    best[doc, i] = (-1.0, int(at[k] - bounds[doc]))
                elif m := line.search(texts[doc]):
                    best[doc, i] = (-1.0, len(_WORD.findall(texts[doc], 0, m.start(1))))
    s = shingles(flat)
    if not len(s):
        return [(doc, i, -share, at) for (doc, i), (share, at) in sorted(best.items())]
    valid = owner[: len(s)] == owner[SHINGLE - 1 :]
    for i, windows in candidates(s, valid, t).items():
        size = 1 << (t.sizes[i] - 1).bit_length()
        step = max(1, size // 2)
        length = 1 if size == 1 else 3 * step
        for w in windows.tolist():
            a, b = max(0, w * step - step), min(len(s), w * step + length + step)
            part = s[a:b]
            inside = np.flatnonzero(np.isin(part, t.sets[i]) & valid[a:b]) + a
            for doc in np.unique(owner[inside]).tolist():
                own = inside[owner[inside] == doc]
                share = len(np.unique(s[own])) / len(t.sets[i])
                if share >= CONTAINED:
                    key, value = (doc, i), (-share, int(own[0] - bounds[doc]))
                    best[key] = min(best.get(key, value), value)
    return [(doc, i, -share, at) for (doc, i), (share, at) in sorted(best.items())]


def _parts(text: str, overlap: int) -> Iterator[tuple[str, int]]:
    """A giant text in pieces that share `overlap` characters, with the words before each. A piece begins at white space
    if there is some in the overlap, else at its start: every piece but the last advances by PIECE - 2 * overlap or more."""
    at = before = 0
    while True:
        end = min(len(text), at + PIECE)
        yield text[at:end], before
        if end == len(text):
            return
        nxt = end - overlap
        least = max(nxt - overlap, at + 1)
        while nxt > least and (text[nxt - 1].isalnum() or text[nxt - 1] == "_"):
            nxt -= 1
        if nxt == least:
            nxt = end - overlap
        before += sum(1 for _ in _WORD.finditer(text, at, nxt))
        at = nxt


def _run(batches, templates: list[tuple[str, str]], bands: int):
    t, words = Templates(templates, bands), _Hashes()
    overlap = 16 * max(t.n_words, default=1) * 4
    for batch in in_pieces(batches, "text", 4 << 20):
        ids = batch.column("doc_id").to_pylist()
        best: dict[tuple[int, int], tuple[float, int]] = {}
        group: list[tuple[int, str, int]] = []

        def flush(group=group, best=best):
            if not group:
                return
            for row, i, share, at in scan([g[1] for g in group], t, words):
                key, value = (group[row][0], i), (-share, at + group[row][2])
                best[key] = min(best.get(key, value), value)
            group.clear()

        held = 0
        for i, x in enumerate(batch.column("text").to_pylist()):
            for part, before in _parts(x or "", overlap):
                group.append((i, part, before))
                held += len(part)
                if held > PIECE:
                    flush()
                    held = 0
        flush()
        rows = sorted(best.items())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ids[doc] for (doc, _), _ in rows], pa.int64()),
                pa.array([templates[i][0] for (_, i), _ in rows], pa.string()),
                pa.array([i for (_, i), _ in rows], pa.int32()),
                pa.array([round(-v[0], 6) for _, v in rows], pa.float64()),
                pa.array([v[1] for _, v in rows], pa.int64()),
            ],
            names=["doc_id", "license", "template", "containment", "first_word"],
        )


def scanned(docs: DataFrame, templates: list[tuple[str, str]] | None = None, bands: int = BANDS) -> DataFrame:
    """One row per document and template found in it: doc_id, license, template (its number), containment, first_word."""
    rows = sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    chosen = all_templates() if templates is None else templates
    return rows.mapInArrow(lean(lambda it: _run(it, chosen, bands)), "doc_id long, license string, template int, containment double, first_word long")
