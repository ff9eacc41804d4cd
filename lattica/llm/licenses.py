"""Op 3: licence texts found in documents by the Dice coefficient over word bigrams.

Texts are normalised to lower-case words of letters and digits. An index leads from each bigram to
the templates that have it. In a document the places that share bigrams with a template form
windows: each from one such place (hit) to a later one, since words beyond the outer hits only lower
the coefficient. With threshold t, a window of n bigrams can only match a template of m bigrams if n
lies between m*t/(2-t) and m*(2-t)/t, and shares at least t*(n+m)/2 bigrams with it. Hits from which
the longest window shares too few are pruned by running counts; from the others every end is scored.
The coefficient counts repeated bigrams as often as both sides have them.

Defined cases: null and empty texts have no match; of overlapping matches the one that shares most
bigrams stays, then the better score, then the template first in the list; repeated rows get equal results; other columns pass through; an
empty table gives an empty result; texts are read whole, however long. A template needs two words at least.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import as_bytes, slices

THRESHOLD = 0.8
#: Public licence notices, headers and short licences in whole. Of the long ones (Apache, GPL, LGPL, AGPL, MPL, EPL) the
#: notices and headers that works carry; their full texts can be passed as `templates`.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-notice": "Released under the MIT License",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal",
}
WORD = re.compile(r"[^\W_]+")


def normal_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bigrams(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    n = a.total() + b.total()
    return 2 * (a & b).total() / n if n else 0.0


class Templates:
    def __init__(self, texts: Mapping[str, str], threshold: float = THRESHOLD):
        self.names, self.threshold = list(texts), threshold
        self.counts = [Counter(bigrams(normal_words(t))) for t in texts.values()]
        if empty := [n for n, c in zip(self.names, self.counts, strict=True) if not c]:
            raise ValueError(f"templates of less than two words: {empty}")
        self.index = defaultdict(list)
        for i, c in enumerate(self.counts):
            for b in c:
                self.index[b].append(i)
        sizes = [c.total() for c in self.counts]
        self.bounds = [(n * threshold / (2 - threshold), n * (2 - threshold) / threshold) for n in sizes]

    def matches(self, text: str) -> list[tuple[int, int, int, float]]:
        """(template, first word, end word, Dice) of the places that match, left to right."""
        words = normal_words(text)
        pairs = bigrams(words)
        places, known = defaultdict(list), self.index
        for at, b in enumerate(pairs):
            if b in known:
                for i in known[b]:
                    places[i].append(at)
        found = [x for i, hits in places.items() for x in self.windows(i, pairs, hits)]
        kept, taken = [], bytearray(len(words))
        for shared, s, i, a, b in sorted(found, key=lambda m: (-m[0], -m[1], m[2], m[3])):
            if taken.find(1, a, b) < 0:
                taken[a:b] = b"\1" * (b - a)
                kept.append((i, a, b, s))
        return sorted(kept, key=lambda x: x[1])

    def windows(self, i: int, pairs: list[tuple[str, str]], hits: list[int]) -> list[tuple[int, float, int, int, int]]:
        """(shared bigrams, Dice, template, first word, end word) of the windows from hit to hit that match a template.

        Left out: windows whose last hit shares nothing more, as a shorter one inside shares as much and scores better."""
        low, high = self.bounds[i]
        counts, size = self.counts[i], self.counts[i].total()
        need = self.threshold * (low + size) / 2 - 1e-9
        if len(hits) < need:
            return []
        out, seen, have, end = [], Counter(), 0, 0
        for at, h in enumerate(hits):
            while end < len(hits) and hits[end] - h + 1 <= high + 1e-9:
                b = pairs[hits[end]]
                seen[b] += 1
                have += seen[b] <= counts[b]
                end += 1
            if have >= need:
                got, shared = {}, 0
                for k in hits[at:end]:
                    b = pairs[k]
                    n = got.get(b, 0)
                    if n < counts[b]:
                        got[b] = n + 1
                        shared += 1
                        score = 2 * shared / (k - h + 1 + size)
                        if score >= self.threshold:
                            out.append((shared, score, i, h, k + 2))
            b = pairs[h]
            have -= seen[b] <= counts[b]
            seen[b] -= 1
        return out


MATCH = "array<struct<license:string,start:int,end:int,dice:double>>"


def scan_batches(templates: Mapping[str, str], threshold: float):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = Templates(templates, threshold)
        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("dice", pa.float64())]))
        for batch in slices(batches):
            got = [[{"license": known.names[i], "start": a, "end": b, "dice": s} for i, a, b, s in known.matches(t.decode())] for t in as_bytes(batch.column("__text"))]
            yield pa.RecordBatch.from_arrays([batch.column("__doc"), pa.array(got, kind)], names=["__doc", "__licenses"])

    return run


def scanned(docs: DataFrame, text: str = "text", templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """docs as a struct `__doc`, and `__licenses`: name, first word, end word and Dice coefficient of each match. No shuffle."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col(text).alias("__text"))
    kind = T.StructType([packed.schema["__doc"], T.StructField("__licenses", T._parse_datatype_string(MATCH))])
    return packed.mapInArrow(scan_batches(dict(templates), threshold), kind)


def op3_dice_licenses(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    told = "concat_ws(',', transform(__licenses, x -> concat(x.license, ':', x.start, ':', x.end, ':', format_number(x.dice, '0.000000'))))"
    return scanned(docs).select("__doc.doc_id", F.size("__licenses").alias("n_licenses"), F.expr("array_max(transform(__licenses, x -> x.dice))").alias("best_dice"), F.expr(told).alias("licenses"))
