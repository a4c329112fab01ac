"""Licence scans: passages compared with licence templates by the Dice coefficient of their word bigrams."""

from __future__ import annotations

from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import pieces, texts_of, words

#: Notices by which texts are put under public licences, and short licences, by SPDX name; several for one licence are
#: alternatives. Whole texts of longer licences are in license_texts/, a file each.
NOTICES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-3-Clause", "Licensed under the 3-clause BSD License."),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/."),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html."),
    ("BSD-2-Clause", "Licensed under the 2-clause BSD License."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
]
THRESHOLD = 0.85


def whole_texts(folder: Path = Path(__file__).parent / "license_texts") -> list[tuple[str, str]]:
    """Licences that lie in a folder, one to a file that bears its SPDX name."""
    return [(f.stem, f.read_text(encoding="utf-8")) for f in sorted(folder.glob("*.txt"))]


TEMPLATES = NOTICES + whole_texts()


def bigrams(w: list[bytes]) -> list[tuple[bytes, bytes]]:
    """Pairs of neighbouring words; a word alone is a pair with nothing."""
    return list(zip(w, w[1:])) if len(w) != 1 else [(w[0], b"")]


def dice(a: Counter, b: Counter) -> float:
    """2 |a and b| / (|a| + |b|) of multisets; 0 for two empty ones."""
    total = a.total() + b.total()
    return 2 * sum(min(n, b[x]) for x, n in a.items() if x in b) / total if total else 0.0


class Scanner:
    """Compares runs of words with the templates, wherever in a line they start and end.

    For a coefficient of t or more the sizes must be within a factor of t / (2 - t), and a template must share that part of its
    bigrams with the text. The second bound, on the whole text, leaves few templates; the first bounds a run's length. A run
    need only start and end with a bigram of the template, as any other at an end lowers the coefficient; and only start where
    the one before isn't a bigram that still counts, as that would raise it. Both are exact: no passage that reaches t is missed.
    """

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> None:
        self.t, self.share = threshold, threshold / (2 - threshold)
        self.templates = [(name, Counter(bigrams(words(text)))) for name, text in templates]
        self.sizes = [c.total() for _, c in self.templates]
        #: For each bigram the templates that have it, and how often.
        self.having: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
        for k, (_, c) in enumerate(self.templates):
            for x, n in c.items():
                self.having.setdefault(x, []).append((k, n))

    def likely(self, pairs: list[tuple[bytes, bytes]]) -> list[int]:
        """Templates that share enough of their bigrams with a text."""
        found = Counter(x for x in pairs if x in self.having)
        common = [0] * len(self.templates)
        for x, n in found.items():
            for k, most in self.having[x]:
                common[k] += min(n, most)
        return [k for k, n in enumerate(common) if n >= self.share * self.sizes[k] and n]

    def find(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """For each licence found: name, the best coefficient, first and last line of the passage; the best first. Passages of
        different templates that overlap are one, of the template that it is most alike (of several, the longest passage, then the
        first in the text and among the templates)."""
        lines = [words(x) for x in (text or "").split("\n")]
        flat = [x for w in lines for x in w]
        if not flat:
            return []
        pairs = bigrams(flat)
        runs = [(-d, i - j, i, k, j) for k in self.likely(pairs) for d, i, j in self.passages(pairs, k)]
        if not runs:
            return []
        line = [i for i, w in enumerate(lines) for _ in w]
        taken: list[tuple[int, int]] = []
        best: dict[str, tuple[float, int, int]] = {}
        for d, _, i, k, j in sorted(runs):
            at = bisect(taken, (i, -1))
            if at and taken[at - 1][1] >= i or at < len(taken) and taken[at][0] <= j:
                continue
            taken.insert(at, (i, j))
            best.setdefault(self.templates[k][0], (-d, line[i], line[min(j + 1, len(line) - 1)]))
        return sorted(((n, *b) for n, b in best.items()), key=lambda x: (-x[1], x[0]))

    def passages(self, pairs: list[tuple[bytes, bytes]], k: int) -> list[tuple[float, int, int]]:
        """Coefficient, first and last bigram of the passages of a template, from left to right: from the first start at which a run
        reaches t on to the best start inside it, its best run, and on behind that."""
        template, size = self.templates[k][1], self.sizes[k]
        reach = int(size / self.share + 1e-9)
        names = {x: n for n, x in enumerate(template)}
        most = np.fromiter(template.values(), np.int64, len(template))
        place = np.array([i for i, x in enumerate(pairs) if x in template], np.int64)
        kind = np.array([names[pairs[i]] for i in place.tolist()], np.int64)
        order = np.argsort(kind, kind="stable")
        begin = np.searchsorted(kind[order], np.arange(len(template)))
        number = np.empty(len(kind), np.int64)  # the how manieth of its kind
        number[order] = np.arange(len(kind)) - begin[kind[order]]
        last = np.searchsorted(place, place + reach)  # runs from here end before this one

        def from_start(a: int) -> tuple[float, int]:
            """The best run that starts at a: coefficient, last bigram among place."""
            own = slice(a, last[a])
            first = np.full(len(template), -1, np.int64)
            first[kind[own][::-1]] = number[own][::-1]
            same = np.cumsum(number[own] - first[kind[own]] < most[kind[own]])
            d = 2 * same / (place[own] - place[a] + 1 + size)
            b = int(d.argmax())
            return float(d[b]), a + b

        def may_start(a: int) -> bool:
            if a == 0 or place[a - 1] != place[a] - 1:
                return True
            x = kind[a - 1]
            later = a - 1 + most[x]  # a cheap bound first: as many places on as there may be of the kind
            if later >= len(kind):
                return False
            same = order[begin[x] + number[a - 1] + most[x]] if begin[x] + number[a - 1] + most[x] < (begin[x + 1] if x + 1 < len(begin) else len(order)) else -1
            return same >= 0 and place[same] < place[a] + reach

        out, a = [], 0
        while a < len(place):
            if not may_start(a):
                a += 1
                continue
            d, b = from_start(a)
            if d < self.t:
                a += 1
                continue
            at, end, look = a, b, a + 1
            while look <= end:
                if may_start(look):
                    other, b = from_start(look)
                    if other > d:
                        d, at, end = other, look, b
                look += 1
            out.append((d, int(place[at]), int(place[end])))
            a = end + 1
        return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, n_licenses, licenses (SPDX names, the best first, comma-joined), best_license, best_dice,
    first_line, last_line of the best passage (from 0; null if none). A map over the rows. Null and empty texts have none;
    null and repeated ids are rows of their own; an empty table has an empty result; a text of any length is scanned whole; other
    columns are left behind."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_licenses", pa.int64()), ("licenses", pa.string()), ("best_license", pa.string()), ("best_dice", pa.float64()), ("first_line", pa.int32()), ("last_line", pa.int32())])
    shared = docs.sparkSession.sparkContext.broadcast(templates)  # a list that is given, not of the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value, threshold)
        for batch in pieces(batches):
            out = []
            for i, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                found = scanner.find(text)
                name, d, a, b = found[0] if found else (None, None, None, None)
                out.append({"doc_id": i, "n_licenses": len(found), "licenses": ",".join(x[0] for x in found), "best_license": name, "best_dice": d, "first_line": a, "last_line": b})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_licenses long, licenses string, best_license string, best_dice double, first_line int, last_line int")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
