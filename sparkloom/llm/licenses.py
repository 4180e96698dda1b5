"""License scans by patience alignment.

Words unique to both the text and a template are anchors; the longest increasing subsequence of their places is kept, equal words next
to anchors join them, and the gaps between are aligned again, down to gaps without anchors. Coverage is the share of the template's words
that align within the densest stretch of the text of at most ``slack`` times the template's length. Texts whose words can't reach the
coverage, counting each of the template's words as often as both have it, are passed over: that bound loses nothing.

Defined results: null or empty text has no license; a template found twice counts once, at its densest stretch; repeated rows are scanned alike;
extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import scratch

#: Public license texts and notices, fixed values. Licenses of many pages are known by the header that they ask files to carry.
TEMPLATES = {
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0.',
    "AGPL-3.0 header": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "CC-BY-4.0 notice": 'This work is licensed under a Creative Commons Attribution 4.0 International License.',
    "CC-BY-SA-4.0 notice": 'This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.',
    "CC-BY-NC-4.0 notice": 'Licensed under CC BY-NC 4.0.',
    "GPL-3.0 header": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.',
    "GPL-3.0 notice": 'This work is licensed under the GNU General Public License, version 3.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-3.0 header": 'This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see https://www.gnu.org/licenses/.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT notice": 'Released under the MIT License.',
    "MPL-2.0 header": 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.',
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Zlib": 'This software is provided "as-is", without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.',
    "all rights reserved": 'All rights reserved.',
}
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of a and b, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_b, places = Counter(b[b0:b1]), {}
        for i in range(a0, a1):
            if in_b.get(a[i]) == 1:
                places[a[i]] = -1 if a[i] in places else i
        anchors = [(places[w], j) for j in range(b0, b1) if (w := b[j]) in places and places[w] >= 0]
        tails, links, ends = [], [], []  # longest increasing subsequence of the places in a
        for n, (i, _) in enumerate(anchors):
            k = bisect_left(tails, i)
            links.append(ends[k - 1] if k else -1)
            tails[k : k + 1] = [i]
            ends[k : k + 1] = [n]
        chain, n = [], ends[-1] if ends else -1
        while n >= 0:
            chain.append(anchors[n])
            n = links[n]
        if not chain:
            continue
        cut = [(a0 - 1, b0 - 1), *chain[::-1], (a1, b1)]
        out += chain
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(cut, cut[1:], strict=False)]
    return sorted(out)


def coverage(text: list, template: list, slack: float = 1.5) -> tuple[float, int, int]:
    """Share of the template aligned in the densest stretch, and that stretch's first and last word."""
    places = [i for i, _ in patience(text, template)]
    room, low, best = int(slack * len(template)), 0, (0, -1, -1)
    for high, i in enumerate(places):
        while i - places[low] >= room:
            low += 1
        if high - low + 1 > best[0]:
            best = (high - low + 1, places[low], i)
    return best[0] / max(1, len(template)), best[1], best[2]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8, slack: float = 1.5) -> DataFrame:
    """doc_id, licenses (names found, joined by ``; ``, or null), n_licenses, best coverage, and the best one's first and last word."""
    scratch.small_batches(docs.sparkSession)
    kinds = {name: words(t.encode()) for name, t in sorted(templates.items())}
    counts = {name: Counter(t) for name, t in kinds.items()}
    known = frozenset(w for t in kinds.values() for w in t)

    @F.pandas_udf("struct<licenses: string, n: int, coverage: double, first: int, last: int>")
    def look(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            found, best = [], (0.0, -1, -1)
            all_words = words(b"" if t is None else bytes(t))
            places = [i for i, w in enumerate(all_words) if w in known]
            held = Counter(all_words[i] for i in places)
            for name, template in kinds.items():
                if sum(min(n, held[w]) for w, n in counts[name].items()) < least * len(template):
                    continue
                mine = [i for i in places if all_words[i] in counts[name]]
                got = _dense(all_words, mine, template, least, slack)
                if got[0] >= least:
                    found.append(name)
                    best = max(best, got, key=lambda x: x[0])
            rows.append(("; ".join(found) or None, len(found), *best))
        return pd.DataFrame(rows, columns=["licenses", "n", "coverage", "first", "last"])

    out = docs.select("doc_id", look(F.col("text").cast("binary")).alias("l"))
    return out.select("doc_id", "l.licenses", F.col("l.n").alias("n_licenses"), "l.coverage", F.col("l.first").alias("first_word"), F.col("l.last").alias("last_word"))


def _dense(all_words: list, mine: list[int], template: list, least: float, slack: float) -> tuple[float, int, int]:
    """Best coverage over the stretches of the text that hold enough of the template's words; each is aligned alone, so words
    elsewhere in a long text can't take anchors away."""
    room, need, low, best, done = int(slack * len(template)), least * len(template), 0, (0.0, -1, -1), -1
    for high, i in enumerate(mine):
        while i - mine[low] >= room:
            low += 1
        last = high + 1 == len(mine) or mine[high + 1] - mine[low] >= room  # the stretch can't grow
        if last and high - low + 1 >= need and high > done:
            done = high
            a, b = mine[low], i + 1
            share, first, end = coverage(all_words[a:b], template, slack)
            if share > best[0]:
                best = (share, a + first, a + end)
    return best
