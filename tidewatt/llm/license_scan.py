"""Operator 1: licence scans by conditional compression.

Lines that mention licensing, and their neighbours written in licence words,
form candidate blocks.  Every wording of every template is compared word by
word with the stretches of the block that could hold it; it is confirmed if
the differences are few and none touches a number: versions must agree
exactly.  The words of a confirmed stretch are cut out and the rest is
examined again until nothing is confirmed.  What the stretch saves when it is
compressed with the wording as a zstandard raw dictionary is its reduction.
Lines without a confirmed stretch are compressed with every template and keep
the one with the fewest differences, unconfirmed.

Defined results: null and empty texts have no blocks; null ids and repeated
rows give their rows each; unconfirmed runs of more than PIECE words are
reported in overlapping pieces, all of them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import groupby, pairwise

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Wording of common licence notices.  <> stands for names or years.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "LicenseRef-reserved": "Copyright <> All rights reserved.",
}
#: Plain forms that stand for the same licences.
PLAIN = {
    "Apache-2.0": ["under the Apache License, Version 2.0", "under the Apache License 2.0", "under the Apache 2.0 License", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["under the MIT License", "under the terms of the MIT License", "under an MIT License", "under MIT License", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["under the GNU General Public License, version 3", "under the terms of the GNU General Public License, version 3", "under the GNU GPL, version 3", "under the GNU General Public License v3.0",
                "under the GNU GPL v3", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL-2.0": ["under the GNU General Public License, version 2", "under the terms of the GNU General Public License, version 2", "under the GNU GPL, version 2", "under the GNU General Public License v2.0",
                "under the GNU GPL v2", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "LGPL-3.0": ["under the GNU Lesser General Public License, version 3", "under the GNU LGPL, version 3", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "AGPL-3.0": ["under the GNU Affero General Public License, version 3", "under the GNU AGPL, version 3", "SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "MPL-2.0": ["under the Mozilla Public License, v. 2.0", "under the Mozilla Public License, Version 2.0", "under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "BSD-3-Clause": ["under the BSD 3-Clause License", "under the 3-Clause BSD License", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSD-2-Clause": ["under the BSD 2-Clause License", "under the 2-Clause BSD License", "SPDX-License-Identifier: BSD-2-Clause"],
    "ISC": ["under the ISC License", "SPDX-License-Identifier: ISC"],
    "CC-BY-4.0": ["under CC BY 4.0", "under a Creative Commons Attribution 4.0 International License", "under the Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["under CC BY-SA 4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["under CC BY-NC 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-ND-4.0": ["under CC BY-ND 4.0", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "CC0-1.0": ["to the public domain under CC0 1.0", "under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"],
    "Unlicense": ["released into the public domain", "SPDX-License-Identifier: Unlicense"],
    "LicenseRef-reserved": ["All rights reserved."],
}
MARKS = re.compile(r"licen[sc]|copyright|permission|warrant|redistribut|public domain|rights reserved|\b[al]?gpl|\bcc0\b|\bcc[ -]by\b", re.IGNORECASE)
WORD = re.compile(r"[a-z0-9<>]+")
PLACE = re.compile(r"[A-Za-z0-9<>]+")
#: What may end a notice after its last word.
TAIL = re.compile(r"[.,;:!?)\]\"'”’/]*")
#: Words of a piece of an unconfirmed run, and of the overlap between pieces.
PIECE, OVERLAP = 2000, 500
#: Words that <> may stand for.
HOLDER = 20
LEVEL = 12


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


VOCABULARY = {w for t in TEMPLATES.values() for w in words(t)}


def blocks(text: str) -> list[tuple[int, int]]:
    """Places of runs of licence-like lines with a mark among them."""
    out, at, begin, end, marked = [], 0, -1, -1, False
    for line in [*text.split("\n"), ""]:
        mark = bool(MARKS.search(line))
        own = mark or (len(line) < 2000 and len(w := words(line)) >= 3 and sum(x in VOCABULARY for x in w) >= 0.75 * len(w))
        if own:
            begin = at if begin < 0 else begin
            end, marked = at + len(line), marked or mark
        else:
            if marked:
                out.append((begin, end))
            begin, marked = -1, False
        at += len(line) + 1
    return [(a, b) for a, b in out if b > a]


def pieces(text: str, a: int, b: int) -> list[tuple[int, int]]:
    found = [(m.start() + a, m.end() + a) for m in re.finditer(r"\S+", text[a:b])]
    if len(found) <= PIECE:
        return [(a, b)]
    return [(found[k][0], found[min(k + PIECE, len(found)) - 1][1]) for k in range(0, len(found) - OVERLAP, PIECE - OVERLAP)]


@lru_cache(1)
def wordings() -> list[tuple[str, str, list[str]]]:
    """(template's name, text, words) of every template and plain form."""
    return [(name, t, words(t)) for name, main in TEMPLATES.items() for t in (main, *PLAIN.get(name, []))]


@lru_cache(None)
def compressor(text: str | None) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=kind) if text else None)


def saved(data: bytes, text: str) -> float:
    """Share of the compressed size that the dictionary ``text`` saves."""
    return 1 - len(compressor(text).compress(data)) / len(compressor(None).compress(data))


def reductions(block: str) -> list[tuple[float, str]]:
    """(share of the compressed size saved, template), largest first."""
    data = block.encode()
    return sorted(((saved(data, t), name) for name, t in TEMPLATES.items()), key=lambda x: (-x[0], x[1]))


def compared(block: list[str | None], template: list[str]) -> tuple[list[int], list[tuple[str, str]]]:
    """Places of the block's words that the template matches, and (wording in
    the template, wording in the block) wherever they differ between the
    first and the last of them."""
    steps = SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
    hits = [j for kind, _, _, c, d in steps if kind == "equal" for j in range(c, d)]
    out = []
    for kind, a, b, c, d in steps:
        gone = [w for w in template[a:b] if w != "<>"]
        if hits and c > hits[-1]:  # outside the stretch: what stands for the template's words
            d = min(d, c + b - a)
        elif hits and d <= hits[0]:
            c = max(c, d - b + a)
        more = [w or "-" for w in block[c:d]]
        if kind != "equal" and (gone or more and ("<>" not in template[a:b] or len(more) > HOLDER)):
            out.append((" ".join(gone), " ".join(more)))
    return hits, out


def judged(found: list[tuple[str, str]], n: int, most: float) -> tuple[int, int, bool, str]:
    """Words missing and added, whether a template of ``n`` words is
    confirmed, and the differences as text."""
    missing, added = (sum(len(x[k].split()) for x in found) for k in (0, 1))
    numbers = any(ch.isdigit() for x in found for ch in x[0] + x[1])
    return missing, added, not numbers and missing + added <= most * n, "; ".join(f"{a or '-'} > {b or '-'}" for a, b in found)


def parts(template: list[str], most: int) -> list[tuple[int, list[str]]]:
    """(place, words) of parts of the template, more than ``most`` of them:
    one at least stands unchanged wherever so few words differ."""
    out, at = [], 0
    for holder, run in groupby(template, lambda w: w == "<>"):
        run = list(run)
        n = 0 if holder else min(most + 1, len(run))
        cuts = [len(run) * k // n for k in range(n + 1)] if n else []
        out += [(at + a, run[a:b]) for a, b in pairwise(cuts)]
        at += len(run)
    return out


def candidates(own: list[str | None], open_ends: set[int], most: float) -> list[tuple]:
    """(-words matched, differences, rank, places, name, text, missing, added,
    differences as text) of every confirmed wording at every place, the one
    that matches most first.  ``open_ends``: places of version numbers that
    the next word goes on with."""
    line = " " + " ".join(w or "-" for w in own) + " "
    starts = [m.start() for m in re.finditer(" ", line)]
    out = []
    for rank, (name, text, wording) in enumerate(wordings()):
        slack = int(most * len(wording))
        room = slack + HOLDER * wording.count("<>")
        places = set()
        for place, part in parts(wording, slack):
            needle, at = " " + " ".join(part) + " ", -1
            while (at := line.find(needle, at + 1)) >= 0:
                places.add(bisect_left(starts, at) - place)
        for place in places:
            begin = max(0, place - room)
            hits, found = compared(own[begin:max(0, place + len(wording) + room)], wording)
            missing, added, confirmed, says = judged(found, len(wording), most)
            if confirmed and hits and begin + hits[-1] not in open_ends:
                out.append((-len(hits), missing + added, rank, [begin + j for j in hits], name, text, missing, added, says))
    return sorted(out)


def confirmed_in(block: str, most: float) -> list[tuple]:
    """(start, end, name, reduction, words missing and added, True, differences)
    of every confirmed stretch of the block."""
    spans = [m.span() for m in PLACE.finditer(block)]
    own: list[str | None] = [block[a:b].lower() for a, b in spans]
    open_ends = {k for k, (x, y) in enumerate(pairwise(spans)) if block[x[1]:y[0]] == "." and own[k].isdigit() and own[k + 1].isdigit()}
    out, left = [], 1
    while left:
        left = 0
        for _, _, _, hits, name, text, missing, added, says in candidates(own, open_ends, most):
            if all(own[j] for j in hits):
                start, end = spans[hits[0]][0], TAIL.match(block, spans[hits[-1]][1]).end()
                out.append((start, end, name, saved(block[start:end].encode(), text), missing, added, True, says))
                for j in hits:
                    own[j] = None
                left += 1
    return sorted(out)


def closest(block: str, most: float) -> tuple:
    """The template with the fewest differences from the whole block: its
    name, the size reduction, words missing and added, whether it is
    confirmed, and the differences."""
    own, best = words(block), None
    for rank, (share, name) in enumerate(reductions(block)):
        wording = words(TEMPLATES[name])
        missing, added, confirmed, says = judged(compared(own, wording)[1], len(wording), most)
        # equally few differences: the longer template explains more
        order = (not confirmed, (missing + added) / len(wording), -len(wording), rank)
        if best is None or order < best[0]:
            best = order, (name, share, missing, added, confirmed, says)
    return best[1]


def examine_all(block: str, most: float) -> tuple[tuple, ...]:
    """Rows of a block: every confirmed stretch, and every run of marked lines
    that none of them touches."""
    out = confirmed_in(block, most)
    at, runs = 0, []
    for line in block.split("\n"):
        end = at + len(line)
        if not any(a < end and at < b for a, b, *_ in out):
            runs.append((runs.pop()[0], end) if runs and runs[-1][1] == at - 1 else (at, end))
        at = end + 1
    rest = [p for a, b in runs if MARKS.search(block[a:b]) for p in pieces(block, a, b)]
    return (*out, *((a, b, *closest(block[a:b], most)) for a, b in rest))


@lru_cache(20_000)
def examine_short(block: str, most: float) -> tuple[tuple, ...]:
    return examine_all(block, most)


def examine(block: str, most: float) -> tuple:
    """Best template of a block: its name, the size reduction, words missing
    and added, whether it is confirmed, and the differences."""
    best = max(confirmed_in(block, most), key=lambda x: x[1] - x[0], default=None)
    return best[2:] if best else closest(block, most)


FOUND = "doc_id long, start long, end long, license string, reduction double, n_missing long, n_added long, confirmed boolean, differences string"


def scan(docs: DataFrame, most: float = 0.1) -> DataFrame:
    """One row for each confirmed stretch and each candidate without one (code
    points start to end).  ``most``: differing words that a confirmed stretch
    may have, as a share of the template's."""
    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text and MARKS.search(text):
                    rows += [(doc_id, x + a, x + b, *found) for x, y in blocks(text) for a, b, *found in (examine_short if y - x < 2000 else examine_all)(text[x:y], most)]
            columns = list(zip(*rows)) or [[]] * 9
            kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for c, x in zip(columns, FOUND.split(", "))], [x.split()[0] for x in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)
