"""License scan: MinHash bands over overlapping windows retrieve templates, shingles verify."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from ..functions.columns import named
from .common import slices, texts_of

_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are"
    " permitted provided that the following conditions are met: Redistributions of source code"
    " must retain the above copyright notice, this list of conditions and the following"
    " disclaimer. Redistributions in binary form must reproduce the above copyright notice, this"
    " list of conditions and the following disclaimer in the documentation and/or other materials"
    " provided with the distribution."
)
_BSD_DISCLAIMER = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS"
    " OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF"
    " MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE"
    " COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,"
    " EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE"
    " GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED"
    " AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING"
    " NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED"
    " OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU_HEAD = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the"
    " GNU {0} Public License as published by the Free Software Foundation; either version {1} of"
    " the License, or (at your option) any later version."
)

# Notices of common licenses, as their publishers word them.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this"
        " file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed"
        " to in writing, software distributed under the License is distributed on an \"AS IS\""
        " BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files (the \"Software\"), to deal in the Software"
        " without restriction, including without limitation the rights to use, copy, modify,"
        " merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
        " permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions: The above copyright notice and this permission notice shall be included in"
        " all copies or substantial portions of the Software."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License as published by the Free Software Foundation, either"
        " version 3 of the License, or (at your option) any later version."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met: Redistributions of source"
        " code must retain the above copyright notice, this list of conditions and the following"
        " disclaimer."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    ),
    "MIT-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files (the \"Software\"), to deal in the Software"
        " without restriction, including without limitation the rights to use, copy, modify,"
        " merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
        " permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions: The above copyright notice and this permission notice shall be included in"
        " all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\","
        " WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE"
        " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN"
        " NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR"
        " OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT"
        " OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause": _BSD_HEAD + _BSD_DISCLAIMER,
    "BSD-3-Clause": (
        _BSD_HEAD + " Neither the name of the copyright holder nor the names of its contributors"
        " may be used to endorse or promote products derived from this software without specific"
        " prior written permission." + _BSD_DISCLAIMER
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
        " without fee is hereby granted, provided that the above copyright notice and this"
        " permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR"
        " DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES"
        " OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,"
        " DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS"
        " OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS"
        " ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to"
        " copy, modify, publish, use, compile, sell, or distribute this software, either in source"
        " code form or as a compiled binary, for any purpose, commercial or non-commercial, and by"
        " any means. In jurisdictions that recognize copyright laws, the author or authors of this"
        " software dedicate any and all copyright interest in the software to the public domain."
        " We make this dedication for the benefit of the public at large and to the detriment of"
        " our heirs and successors. We intend this dedication to be an overt act of relinquishment"
        " in perpetuity of all present and future rights to this software under copyright law."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event"
        " will the authors be held liable for any damages arising from the use of this software."
        " Permission is granted to anyone to use this software for any purpose, including"
        " commercial applications, and to alter it and redistribute it freely, subject to the"
        " following restrictions: The origin of this software must not be misrepresented; you must"
        " not claim that you wrote the original software."
    ),
    "GPL-2.0-header": _GNU_HEAD.format("General", 2),
    "LGPL-2.1-header": _GNU_HEAD.format("Lesser General", "2.1"),
    "LGPL-3.0-header": _GNU_HEAD.format("Lesser General", 3),
    "AGPL-3.0-header": _GNU_HEAD.format("Affero General", 3),
    "MIT-notice-1": "Licensed under the MIT License.",
    "MIT-notice-2": "under the terms of the MIT license",
    "MIT-notice-3": "distributed under the MIT License",
    "MIT-notice-4": "available under the MIT license",
    "Apache-2.0-notice-1": "under the Apache License, Version 2.0",
    "Apache-2.0-notice-2": "licensed under the Apache 2.0 license",
    "BSD-notice-1": "licensed under the BSD license",
    "BSD-notice-2": "licensed under the BSD 3-Clause License",
    "BSD-notice-3": "licensed under the BSD 2-Clause License",
    "BSD-notice-4": "Use of this source code is governed by a BSD-style license",
    "ISC-notice": "licensed under the ISC license",
    "GPL-2.0-notice-1": "under the GNU General Public License, version 2",
    "GPL-3.0-notice-1": "under the GNU General Public License, version 3",
    "GPL-2.0-notice-2": "licensed under the GPL v2",
    "GPL-3.0-notice-2": "licensed under the GPL v3",
    "GPL-notice": "under the terms of the GNU General Public License",
    "LGPL-notice": "under the terms of the GNU Lesser General Public License",
    "AGPL-notice": "under the terms of the GNU Affero General Public License",
    "MPL-notice": "under the Mozilla Public License, version 2.0",
    "CC0-1.0-notice": "released under CC0 1.0 Universal",
    "CC-BY-4.0-notice": "licensed under CC BY 4.0",
    "CC-BY-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International"
        " License."
    ),
    "CC-BY-SA-4.0-notice": "licensed under CC BY-SA 4.0",
    "CC-BY-SA-3.0-notice": "licensed under CC BY-SA 3.0",
    "CC-BY-NC-4.0-full-name": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0"
        " International License."
    ),
}

# Whole license texts by file, beside the notices.
TEMPLATES = NOTICES | {
    f"{path.stem}-full": path.read_text(encoding="utf-8", errors="replace")
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
}

SHINGLE, CONTAINMENT = 5, 0.8
WORD = re.compile(r"[^\W_]+")
SCHEMA = (
    "doc_id long, license_id string, containment double, start_word long, end_word long,"
    " windows long"
)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _shingles(codes: np.ndarray) -> np.ndarray:
    """A hash of the words at each place and the four after it."""
    n = max(0, len(codes) - SHINGLE + 1)
    mixed = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        mixed = (mixed ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _word_hashes(found: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in found], np.uint64)


def collision_probability(similarity: float, bands: int, rows: int = 1) -> float:
    """Probability that two sets of this Jaccard similarity agree in a band at least."""
    return 1 - (1 - similarity**rows) ** bands


def bands_for(probability: float) -> int:
    """Bands of one row that retrieve every sufficient window with at least ``probability``.

    A template of ``t`` shingles is looked for in windows of ``2 * c`` shingles, ``c`` being the
    next power of two. A window that contains 0.8 of it has a Jaccard similarity of at least
    ``0.8 t / (2 c + 0.2 t)``, which is least as ``t`` comes down to ``c / 2``: 0.4 / 2.1.
    """
    least = CONTAINMENT / 2 / (2 + (1 - CONTAINMENT) / 2)
    return math.ceil(math.log(1 - probability) / math.log(1 - least))


def _multipliers(bands: int) -> np.ndarray:
    return np.random.default_rng(20240501).integers(1, 1 << 63, bands, np.uint64) * np.uint64(2) + np.uint64(1)


class _Index:
    """Templates by window size; per size and band the least hashes and who has them."""

    def __init__(self, templates: Mapping[str, str], bands: int) -> None:
        self.factors = _multipliers(bands)
        self.shingles = {}
        self.sizes: dict[int, list[str]] = {}
        self.told: dict[tuple[int, int], dict[int, list[str]]] = {}
        for name in sorted(templates):
            found = np.unique(_shingles(_word_hashes(words(templates[name]))))
            if len(found):
                self.shingles[name] = found
                half = 1 << (len(found) - 1).bit_length()
                self.sizes.setdefault(half, []).append(name)

    def least(self, half: int, band: int) -> dict[int, list[str]]:
        out: dict[int, list[str]] = {}
        for name in self.sizes[half]:
            out.setdefault(int((self.shingles[name] * self.factors[band]).min()), []).append(name)
        return out

    def candidates(self, hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> set:
        """(row, window's first shingle, half, template) of all windows that share a band.

        Row ``i`` holds ``hashes[starts[i]:starts[i] + counts[i]]``; its windows of ``2 * half``
        shingles begin at every multiple of ``half``.
        """
        found = set()
        if not counts.any():
            return found
        # Places whose five words reach into the next row count for no window.
        edge = np.zeros(len(hashes) + 1, np.int64)
        held = counts > 0
        np.add.at(edge, starts[held], 1)
        np.add.at(edge, (starts + counts)[held], -1)
        outside = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
        # A block of one size is two of the size below, so only the smallest reads every place.
        plans, below = [], None
        half, last = (min(self.sizes), max(self.sizes)) if self.sizes else (1, 0)
        while half <= last:
            blocks = -(-counts // half)
            row = np.repeat(np.arange(len(counts)), blocks)
            offsets = np.cumsum(blocks) - blocks
            inner = np.arange(len(row)) - np.repeat(offsets, blocks)
            first = starts[row] + inner * half if below is None else below[row] + 2 * inner
            plans.append((half, row, inner, first))
            below, half = offsets, 2 * half
        for band, factor in enumerate(self.factors):
            least = hashes * factor
            least[outside] = np.uint64(0xFFFFFFFFFFFFFFFF)
            for half, row, inner, first in plans:
                least = np.minimum.reduceat(least, first) if half > 1 else least[first]
                if half not in self.sizes:
                    continue
                window = least.copy()
                same = np.flatnonzero(row[1:] == row[:-1])
                window[same] = np.minimum(least[same], least[same + 1])
                if (half, band) not in self.told:
                    self.told[half, band] = self.least(half, band)
                told = self.told[half, band]
                wanted = np.array(sorted(told), np.uint64)
                mask = np.zeros(1 << 12, bool)
                mask[wanted >> np.uint64(52)] = True
                for at in np.flatnonzero(mask[window >> np.uint64(52)]):
                    for name in told.get(int(window[at]), ()):
                        found.add((int(row[at]), int(inner[at]) * half, half, name))
        return found


def scan(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    templates: Mapping[str, str] | None = None,
    probability: float = 0.9999,
) -> DataFrame:
    """Documents that hold a license text, one row per document and template.

    Shingles are five words (runs of letters and digits, in small letters). A template of ``t``
    shingles is found where a window of ``2 * c`` consecutive shingles, ``c`` being the next
    power of two from ``t`` on, holds at least 0.8 of its shingles; windows begin at every
    ``c``-th shingle, so each run of ``c`` shingles lies within one. MinHash bands retrieve
    such a window with at least ``probability``; the containment is then counted exactly.

    Returns doc_id, license_id, containment (of the best window, the first of equals),
    start_word and end_word (the words its shared shingles span) and windows (how many
    sufficed). Null, empty and short texts hold nothing; a null id is reported as null;
    repeated rows are reported each; templates under five words are never found; an empty
    table gives an empty result; other columns are ignored.
    """
    index = _Index(TEMPLATES if templates is None else templates, bands_for(probability))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            known: dict[str, int] = {}
            codes, sizes = [], []
            for text in texts_of(batch, "text"):
                found = words(text)
                codes += [known.setdefault(w, len(known)) for w in found]
                sizes.append(len(found))
            sizes = np.array(sizes, np.int64)
            hashes = _shingles(_word_hashes(list(known))[np.array(codes, np.int64)])
            starts = np.cumsum(sizes) - sizes
            counts = np.maximum(sizes - SHINGLE + 1, 0)
            best: dict[tuple[int, str], list] = {}
            for row, first, half, name in sorted(index.candidates(hashes, starts, counts)):
                a = starts[row] + first
                window = hashes[a : min(a + 2 * half, starts[row] + counts[row])]
                shared = np.flatnonzero(np.isin(window, index.shingles[name]))
                share = len(np.unique(window[shared])) / len(index.shingles[name])
                if share < CONTAINMENT:
                    continue
                span = [share, first + int(shared[0]), first + int(shared[-1]) + SHINGLE, 0]
                held = best.setdefault((row, name), span)
                if share > held[0]:
                    held[:3] = span[:3]
                held[3] += 1
            if best:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[row], name, *span) for (row, name), span in best.items()]
                kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    ["doc_id", "license_id", "containment", "start_word", "end_word", "windows"],
                )

    chosen = docs.select(
        named(id_column).cast("long").alias("doc_id"), named(text_column).alias("text")
    )
    return chosen.mapInArrow(run, SCHEMA)
