"""Licence scans: Dice coefficient over word bigrams against licence templates.

A unit is a run of consecutive lines, or of words inside or across lines that begins
and ends with a template's bigrams.  A unit's size is its number of distinct word
bigrams after normalising (lower case, words of letters and digits).  Dice =
2 * shared / (a + b) reaches t only if the sizes are within a factor of (2 - t) / t,
so a unit is compared with the templates of fitting size alone, and a line without
any template bigram begins no unit.  Words are searched only for templates that share
enough bigrams with the whole text.  Of overlapping matches the best stays.

Results in special cases
* Null and empty texts, and texts without a match: no matches, null licence, null Dice.
* Equal Dice: the longer unit, then the first, then the template's name.
* Texts are scanned whole; a unit ends where it outgrows the largest template or, by lines that repeat its
  bigrams, ``REPEATS`` times that in words, so work is linear in lines for a given template table.  Of units from
  one line on with the same bigrams, the longest counts.
* Rows are scanned one by one: repeated rows get equal results, an empty table an
  empty one.  Only id and text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import documents

DICE = 0.8
REPEATS = 4
WORD = re.compile(r"[^\W_]+")

# Public licence notices, headers and short forms.
GNU = ("{program} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software "
       "Foundation, either version {version} of the License, or (at your option) any later version. {program} is distributed in the hope that it will be useful, but WITHOUT ANY "
       "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details. You should have "
       "received a copy of the GNU {kind}General Public License along with {end}")
FSF = "; if not, write to the Free Software Foundation, Inc., {street}, Boston, MA {zip}"
FRANKLIN, TEMPLE = FSF.format(street="51 Franklin Street, Fifth Floor", zip="02110-1301 USA."), FSF.format(street="59 Temple Place, Suite 330", zip="02111-1307 USA")
URL = ". If not, see https://www.gnu.org/licenses/."


def gnu(kind: str, version: str, ends: tuple[str, ...], program: str = "This program") -> list[str]:
    """The header that the licence tells programs to have, with each of its ends."""
    own = program.lower()
    return [GNU.format(program=program, kind=kind, version=version, end=own + end) for end in ends]


BSD_TWO = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
           "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.")
BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = (" THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
           "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
           "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")

TEMPLATES = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", *gnu("", "2", (URL, FRANKLIN, TEMPLE))],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", *gnu("Lesser ", "2.1", (URL, FRANKLIN, TEMPLE), "This library"), *gnu("Lesser ", "2.1", (URL, FRANKLIN))],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", *gnu("Lesser ", "3", (URL,)), *gnu("Lesser ", "3", (URL,), "This library")],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", *gnu("Affero ", "3", (URL,))],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "BSD-3-Clause": [
        "Released under the BSD License.",
        BSD_TWO + BSD_THIRD, BSD_TWO + BSD_THIRD + BSD_END,
    ],
    "BSD-2-Clause": [BSD_TWO + BSD_END],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide. This work is distributed without any warranty."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "all-rights-reserved": ["All rights reserved.", "Copyright. All rights reserved."],
}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bigrams(ws: list[str]) -> set:
    return set(zip(ws, ws[1:], strict=False))


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Templates:
    """Templates by size of their bigram sets."""

    def __init__(self, table: dict[str, list[str]], threshold: float):
        self.all = sorted(((len(b), name, b) for name, texts in table.items() for b in (bigrams(words(t)) for t in texts) if b), key=lambda x: x[:2])
        self.threshold, self.factor = threshold, (2 - threshold) / threshold
        self.union = set().union(*[b for _, _, b in self.all])
        self.largest = max((n for n, _, _ in self.all), default=0) * self.factor

    def best(self, unit: set) -> tuple[float, str] | None:
        """The best template of a fitting size that reaches the threshold."""
        found = [(-d, name) for n, name, b in self.all
                 if n <= len(unit) * self.factor and len(unit) <= n * self.factor and (d := dice(unit, b)) >= self.threshold]
        return (-min(found)[0], min(found)[1]) if found else None

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, licence, dice) in code points, by start, without overlaps."""
        lines, at = [], 0
        for line in text.split("\n"):
            lines.append((at, at + len(line), words(line)))
            at += len(line) + 1
        union, found = self.union, []
        hit = [any(p in union for p in zip(ws, ws[1:], strict=False)) for _, _, ws in lines]
        own, most = [bigrams(ws) for _, _, ws in lines], REPEATS * self.largest
        for i, (start, _, ws) in enumerate(lines):
            # a line may hold the first word of a bigram that the next line ends
            if not hit[i] and not (ws and i + 1 < len(lines) and lines[i + 1][2] and (ws[-1], lines[i + 1][2][0]) in union):
                continue
            unit, last, size, n, best = set(), None, 0, 0, None
            for j in range(i, len(lines)):
                more = lines[j][2]
                if not more:
                    continue
                if last is not None:
                    unit.add((last, more[0]))
                unit |= own[j]
                n += len(more)
                if len(unit) > self.largest or (n > most and j > i):
                    break
                last = more[-1]
                if len(unit) != size or best is None and j == i:  # lines that add no bigram only make the match longer
                    size, best = len(unit), self.best(unit)
                    if best:
                        found.append((-best[0], start - lines[j][1], start, lines[j][1], best[1]))
                elif best:
                    found[-1] = (-best[0], start - lines[j][1], start, lines[j][1], best[1])
        found += self.windows(text, [w for _, _, ws in lines for w in ws])
        out: list[tuple[int, int, str, float]] = []
        for d, _, a, b, name in sorted(found):
            at = bisect_left(out, (a,))
            if (not at or out[at - 1][1] <= a) and (at == len(out) or b <= out[at][0]):
                out.insert(at, (a, b, name, round(-d, 6)))
        return out

    def windows(self, text: str, ws: list[str]) -> list[tuple[float, int, int, int, str]]:
        """(-dice, -length, start, end, licence) of the runs of words that match a template, from one of its bigrams to another.

        A run's distinct bigrams are of a fitting size, and its words at most ``REPEATS`` times as many as that allows.
        """
        present = self.union.intersection(zip(ws, ws[1:], strict=False))
        fitting = [(n, name, b) for n, name, b in self.all if self.factor * len(present) >= n and self.factor * len(b & present) >= n]
        if not fitting:
            return []
        spans = [(m.start(), m.end(), w) for m in WORD.finditer(text) for w in words(m.group())]
        grams = [(x[2], y[2]) for x, y in zip(spans, spans[1:], strict=False)]
        found = []
        for n, name, b in fitting:
            hits = [i for i, g in enumerate(grams) if g in b]
            most = self.factor * n
            for s in hits:
                seen, shared = set(), 0
                for i in range(s, min(len(grams), s + int(REPEATS * most) + 1)):
                    g = grams[i]
                    if g not in seen:
                        seen.add(g)
                        if len(seen) > most:
                            break
                        shared += g in b
                    if g in b and (d := 2 * shared / (len(seen) + n)) >= self.threshold:
                        found.append((-d, spans[s][0] - spans[i + 1][1], spans[s][0], spans[i + 1][1], name))
        return found


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = DICE, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(id, license, dice, n_matches, matches) of every row: the best match, and all as licence:start:end:dice."""
    table = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(table, threshold)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                found = known.scan(text.as_py() or "")
                best = min(found, key=lambda m: (-m[3], m[0] - m[1], m[0], m[2]), default=None)
                rows.append((best and best[2], best and best[3], len(found), ",".join(f"{n}:{a}:{b}:{d:.6f}" for a, b, n, d in found)))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.int32(), pa.string()), strict=True)]],
                                             [id_col, "license", "dice", "n_matches", "matches"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, license string, dice double, n_matches int, matches string")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
