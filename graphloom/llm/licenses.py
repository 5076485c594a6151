"""License scan by a positional rare-token index.

Templates (whole texts of the short licenses; notices, standard headers, titles and opening
texts of the long ones) are indexed by word position.  Each template's rarest words, by
inverse document frequency over the templates, are its entry points, more of them the
longer it is.  A file's occurrences of such words are looked up; each posting votes for
a template at a relative position, file position minus template position, and a
template with enough votes at one position (within SLACK words) is compared word
for word there and must contain its mandatory key phrases.  A BSD text is named by the
clauses that follow its conditions (BSD where there is the opening sentence alone).
The identifiers of an SPDX-License-Identifier line are found by pattern, a row each,
named as the templates are, without -only and -or-later; exceptions are no licenses.

Defined results: null, empty and other texts without a notice have no rows, an empty
table gives an empty result; very long texts are read whole; a notice that occurs twice is
found twice; where notices overlap the one with more matched words is reported (of ties
the first by name); repeated rows report alike; other columns are not read, whatever they
are called.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T

RARE_WORDS = 3  # of a notice; a longer template has one more for each twenty words
SLACK = 2
LEAST_MATCH = 0.8

_GNU = (("GPL", "General Public License", "3.0"), ("GPL", "General Public License", "2.0"), ("LGPL", "Lesser General Public License", "3.0"), ("LGPL", "Lesser General Public License", "2.1"), ("LGPL", "Library General Public License", "2.0"), ("AGPL", "Affero General Public License", "3.0"))
_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
#: Whole texts, without title and copyright line.
BODIES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY, ("permission is hereby granted", "notice shall be included")),
    ("MIT-0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. " + _WARRANTY, ("permission is hereby granted", "furnished to do so the software is provided")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_WARRANTY, ("permission to use", "appear in all copies")),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_WARRANTY, ("permission to use", "is hereby granted the software is provided")),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.", ("permission is granted to anyone", "must not be misrepresented")),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.", ("permission is hereby granted", "machine executable object code")),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.", ("free and unencumbered", "public domain")),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.", ("verbatim or modified copies", "changing it is allowed")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ("apache license", "2 0")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ("mozilla public license", "2 0")),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", ("eclipse public license", "2 0")),
)
#: (license, notice, mandatory key phrases)
TEMPLATES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "2 0")),
    ("MIT", "Released under the MIT License", ("mit license",)),
    ("MIT", "Licensed under the MIT License", ("mit license",)),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3", ("gnu affero general public license", "version 3")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3", ("gnu lesser general public license", "version 3")),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1", ("gnu lesser general public license", "version 2 1")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license", "2 0")),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("redistribution and use", "are permitted")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee", ("permission to use", "without fee")),
    ("CC-BY-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0", ("cc by nc sa 4 0",)),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0", ("cc by nc nd 4 0",)),
    *((f"CC-BY{code}-{v}", f"Creative Commons Attribution{words} {v} {port}", (f"attribution{words} {v}".lower().replace("-", " ").replace(".", " "),)) for v, port in (("4.0", "International"), ("3.0", "Unported")) for code, words in (("", ""), ("-SA", "-ShareAlike"), ("-NC", "-NonCommercial"), ("-ND", "-NoDerivatives" if v == "4.0" else "-NoDerivs"), ("-NC-SA", "-NonCommercial-ShareAlike"), ("-NC-ND", "-NonCommercial-NoDerivatives" if v == "4.0" else "-NonCommercial-NoDerivs"))),
    ("CC0-1.0", "Released under CC0 1.0 Universal", ("cc0 1 0",)),
    ("CC0-1.0", "CC0 1.0 Universal", ("cc0 1 0 universal",)),
    *((f"{short}-{v}", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {v.removesuffix('.0')} of the License, or (at your option) any later version", (f"gnu {name}".lower(), f"version {v.removesuffix('.0')} of".replace(".", " "))) for short, name, v in _GNU),
    *((f"{short}-{v}", f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} version {v.removesuffix('.0')} as published by the Free Software Foundation", (f"gnu {name} version {v.removesuffix('.0')} as".lower().replace(".", " "),)) for short, name, v in _GNU),
    *((f"{short}-{v}", f"GNU {name} Version {v.removesuffix('.0')}, {date}", (f"gnu {name} version {v.removesuffix('.0')} {date.split()[0]}".lower().replace(".", " "),)) for (short, name, v), date in zip(_GNU, ("29 June 2007", "June 1991", "29 June 2007", "February 1999", "June 1991", "19 November 2007"))),
    *((f"{short}-{v}", f"Licensed under the {short}v{v.removesuffix('.0')}", (f"{short}v{v.removesuffix('.0')}".lower().replace(".", " "),)) for short, _, v in _GNU if (short, v) != ("LGPL", "2.0")),
    ("Apache-2.0", "Apache License Version 2.0, January 2004", ("apache license version 2 0",)),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions", ("mozilla public license version 2 0",)),
    ("EPL-2.0", "Eclipse Public License - v 2.0", ("eclipse public license v 2 0",)),
    ("BSL-1.0", "Boost Software License - Version 1.0", ("boost software license version 1 0",)),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ("permission is granted to anyone", "redistribute it freely")),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", ("redistribution and use", "source code must retain", "binary form must reproduce")),
    ("Unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered", "public domain")),
    *BODIES,
)
#: Every template's key phrases hold one of these, so a text without any of them has no notice.
ANCHORS = r"(?i)licen[cs]e|permission|redistribution|\bcc0|\bcc[^\p{L}\p{N}]+by|public[^\p{L}\p{N}]+domain|creative[^\p{L}\p{N}]+commons"
#: Clauses that make another license of a BSD text if they come within so many words of it, the weightiest first.
BSD_CLAUSES = (("BSD-4-Clause", "all advertising materials mentioning features or use of this software"), ("BSD-3-Clause", "to endorse or promote products derived from this software"))
CLAUSE_WORDS = 160
_spdx = re.compile(r"(?i)SPDX-License-Identifier:[ \t]*([^\n]*)")
_spdx_part = re.compile(r"[\w.+-]*\w\+?|[()]|\S")


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", T.fold(text))


@dataclass
class Index:
    words: list[list[str]]
    names: list[str]
    phrases: list[list[list[str]]]
    rare: np.ndarray  # sorted hashes of entry words
    postings: dict[int, list[tuple[int, int]]]  # hash -> (template, position), highest IDF first
    needed: list[int]  # votes a template needs


@lru_cache(maxsize=4)
def index_of(templates: tuple[tuple[str, str, tuple[str, ...]], ...] = TEMPLATES) -> Index:
    words = [_words(t) for _, t, _ in templates]
    df: dict[str, int] = defaultdict(int)
    for w in words:
        for x in set(w):
            df[x] += 1
    idf = {w: math.log(len(words) / n) for w, n in df.items()}
    postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
    needed = []
    for t, w in enumerate(words):
        entry = sorted(set(w), key=lambda x: (-idf[x], x))[: RARE_WORDS + len(w) // 20]
        places = [i for i, x in enumerate(w) if x in entry]
        for i, h in zip(places, T.word_hash([w[i] for i in places]).tolist()):
            postings[h].append((t, i))
        needed.append(max(1, min(2 if len(w) < 40 else 3, len(places))))
    return Index(words, [n for n, _, _ in templates], [[_words(p) for p in ps] for _, _, ps in templates], np.sort(np.fromiter(postings, np.uint64, len(postings))), dict(postings), needed)


def _holds(words: list[str], phrase: list[str]) -> bool:
    return any(words[i : i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


def _aligned(template: list[str], words: list[str]) -> tuple[int, int, int]:
    """(matched, first, last + 1) of template words found in order in words, each at most SLACK further on than due."""
    at, matched, first, last = 0, 0, -1, 0
    for x in template:
        for j in range(at, min(at + SLACK + 1, len(words))):
            if words[j] == x:
                matched, last, at = matched + 1, j + 1, j + 1
                first = j if first < 0 else first
                break
    return matched, max(first, 0), last


def matches(words: list[str], hits: list[tuple[int, int]], index: Index) -> list[tuple[int, int, int, float]]:
    """(template, first word, words, score), given (position, hash) of the entry words in a file of these words."""
    votes: dict[tuple[int, int], set[int]] = defaultdict(set)
    for pos, h in hits:
        for t, i in index.postings[h]:
            votes[t, pos - i].add(i)
    found = []
    for (t, shift), own in votes.items():
        near = set().union(*(votes[t, s] for s in range(shift - SLACK, shift + SLACK + 1) if (t, s) in votes))
        if len(near) < index.needed[t] or not own:
            continue
        template = index.words[t]
        lo = max(0, shift - SLACK)
        part = words[lo : max(0, shift) + len(template) + SLACK + len(template) // 10]
        matched, first, last = _best(template, part)
        score = matched / len(template)
        if score >= LEAST_MATCH and all(_holds(part[first:last], p) for p in index.phrases[t]):
            found.append((t, lo + first, last - first, score, matched))
    found.sort(key=lambda x: (-x[4], index.names[x[0]], x[1]))
    taken: list[tuple[int, int, int, float]] = []
    for t, at, n, score, _ in found:
        if all(at >= b + m or at + n <= b for _, b, m, _ in taken):
            taken.append((t, at, n, score))
    return sorted(taken, key=lambda x: x[1])


def bsd_clauses(words: list[str], found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """(license, first word, words, score), BSD texts named by their clauses and long enough to hold them."""
    out = []
    for i, (name, at, n, score) in enumerate(found):
        if name.startswith("BSD"):
            end = min([at + n + CLAUSE_WORDS, *(x[1] for x in found[i + 1 : i + 2])])
            for other, clause in BSD_CLAUSES:
                phrase = _words(clause)
                if last := next((j + len(phrase) for j in range(at + n, end - len(phrase) + 1) if words[j : j + len(phrase)] == phrase), 0):
                    name, n = (other if name in ("BSD", "BSD-2-Clause") else name), max(n, last - at)
        out.append((name, at, n, score))
    return out


def spdx_tags(text: str) -> list[tuple[str, int, int, int]]:
    """(license, start of the tag, start, end of the identifier) of the identifiers of each SPDX line."""
    out = []
    for m in _spdx.finditer(text):
        due = "id"  # or the exception after WITH, or what joins two
        for x in _spdx_part.finditer(text, *m.span(1)):
            part = x.group()
            if part in "()":
                continue
            if due == "" and part.upper() in ("AND", "OR", "WITH"):
                due = "exception" if part.upper() == "WITH" else "id"
            elif due and part[0].isalnum():
                if due == "id":
                    out.append((re.sub(r"(?i)(?:-only|-or-later|\+)$", "", part), m.start(), *x.span()))
                due = ""
            else:
                break
    return out


def _best(template: list[str], part: list[str]) -> tuple[int, int, int]:
    best = (0, 0, 0)
    for k in range(min(2 * SLACK + 1, len(part))):
        m, a, b = _aligned(template, part[k:])
        if m > best[0] or (m == best[0] and m and b - a < best[2] - best[1]):
            best = (m, a + k, b + k)
    return best


def license_findings(docs: DataFrame) -> DataFrame:
    """A row for each notice: doc_id, license, start_word, n_words, start and end (characters), score."""
    maybe = docs.where(F.col("text").rlike(ANCHORS)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of()
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for at, run in T.chunks(batch.column(1).to_pylist()):
                w = T.split_words(run)
                where = np.searchsorted(index.rare, w.hashes)
                hit = np.flatnonzero(index.rare[np.minimum(where, len(index.rare) - 1)] == w.hashes)
                tags = {d: x for d, t in enumerate(run) if t and (x := spdx_tags(t))}
                for d in np.union1d(np.unique(w.doc[hit]), np.array(list(tags), int)).astype(int):
                    lo, hi, low = int(w.first[d]), int(w.first[d + 1]), T.fold(run[d])
                    words = [low[a:b] for a, b in zip(w.start[lo:hi].tolist(), w.end[lo:hi].tolist())]
                    own = [(int(i) - lo, int(w.hashes[i])) for i in hit[w.doc[hit] == d]]
                    found = bsd_clauses(words, [(index.names[t], first, n, score) for t, first, n, score in matches(words, own, index)])
                    for name, begin, a, b in tags.get(int(d), ()):
                        first, last = np.searchsorted(w.start[lo:hi], [begin if a == tags[int(d)][0][2] else a, b]).tolist()
                        found.append((name, first, last - first, 1.0))
                    for name, first, n, score in sorted(found, key=lambda x: x[1:3]):
                        rows.append((ids[at + int(d)], name, first, n, int(w.start[lo + first]), int(w.end[lo + first + n - 1]), round(score, 4)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], ["doc_id", "license", "start_word", "n_words", "start", "end", "score"])

    return maybe.mapInArrow(make, "doc_id long, license string, start_word long, n_words long, start long, end long, score double")
