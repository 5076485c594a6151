import re

import pytest

from graphloom.llm import licenses

from .helpers import docs, words

GNU = "This {} is free software: you can redistribute it and/or modify\n# it under the terms of the GNU {} as published by\n# the Free Software Foundation, either version {} of the License, or\n# (at your option) any later version.\n"
BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"
BSD2 = BSD + """ provided that the following conditions are met:
* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
* Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
CLAUSE = "* Neither the name of the University of Somewhere Else nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
AD = "* All advertising materials mentioning features or use of this software must display the following acknowledgement: X\n"

CASES = [
    (GNU.format("program", "General Public License", "3"), ["GPL-3.0"]), (GNU.format("file", "General Public License", "2"), ["GPL-2.0"]), (GNU.format("library", "Lesser General Public License", "2.1"), ["LGPL-2.1"]),
    (GNU.format("library", "Lesser General Public License", "3"), ["LGPL-3.0"]), (GNU.format("program", "Affero General Public License", "3"), ["AGPL-3.0"]),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", ["GPL-2.0"]),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n", ["GPL-3.0"]), ("GNU LESSER GENERAL PUBLIC LICENSE\n  Version 2.1, February 1999", ["LGPL-2.1"]),
    ("This work is licensed under the GNU Lesser General Public License, version 2.1", ["LGPL-2.1"]), ("This work is licensed under the GNU Affero General Public License, version 1", []),
    (BSD, ["BSD"]), (BSD2, ["BSD-2-Clause"]), (BSD2 + CLAUSE, ["BSD-3-Clause"]), (BSD2 + AD + CLAUSE, ["BSD-4-Clause"]), (BSD2 + words(200) + " " + BSD2 + CLAUSE, ["BSD-2-Clause", "BSD-3-Clause"]),
    ("Creative Commons Attribution 4.0 International", ["CC-BY-4.0"]), ("under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", ["CC-BY-NC-SA-4.0"]), ("Creative Commons Attribution-ShareAlike 3.0 Unported", ["CC-BY-SA-3.0"]),
    ("# SPDX-License-Identifier: MIT", ["MIT"]), ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note OR BSD-2-Clause) AND Zlib */", ["GPL-2.0", "BSD-2-Clause", "Zlib"]), ("// SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception\nint x;", ["Apache-2.0"]), ("SPDX-License-Identifier:", []),
]


def test_licenses_as_they_occur(spark):
    got = licenses.license_findings(docs(spark, [(i, "before\n" + t + "\nafter", "en", "s") for i, (t, _) in enumerate(CASES)])).collect()
    names = [[r["license"] for r in sorted((r for r in got if r["doc_id"] == i), key=lambda r: (r["start"], r["end"]))] for i in range(len(CASES))]
    assert [(t, n, want) for (t, want), n in zip(CASES, names) if n != want] == []
    assert {("before\n" + CASES[r["doc_id"]][0] + "\nafter")[r["start"] : r["end"]] for r in got if r["doc_id"] == 18} == {"SPDX-License-Identifier: MIT"}


def _wrapped(text, prefix):
    import textwrap

    return "\n".join(prefix + line for line in textwrap.wrap(text.replace("AS IS", '"AS IS"').replace("(the Software)", '(the "Software")'), 68))


def test_whole_licenses_are_one_notice_each(spark):
    rows = [(i, f"Copyright (c) 2024 Some Body\n\n{_wrapped(text, prefix)}\n\nint main;", "en", "s") for i, (_, text, _) in enumerate(licenses.BODIES) for prefix in ("", "# ", " * ")]
    names = [name for name, _, _ in licenses.BODIES]
    got = licenses.license_findings(docs(spark, rows, clash=True)).collect()
    assert sorted((r["doc_id"], r["license"]) for r in got) == sorted((i, n) for i, n in enumerate(names) for _ in range(3))
    assert all(r["n_words"] >= 0.9 * len(licenses._words(licenses.BODIES[r["doc_id"]][1])) for r in got)


def _brute(text, index):
    """Every template at every word, then the same choice among overlapping notices."""
    words, found = licenses._words(text), []
    for t, template in enumerate(index.words):
        for at in range(len(words)):
            part = words[at : at + len(template) + licenses.SLACK + len(template) // 10]
            matched, first, last = licenses._aligned(template, part)
            if first == 0 and matched / len(template) >= licenses.LEAST_MATCH and all(licenses._holds(part[first:last], p) for p in index.phrases[t]):
                found.append((-matched, index.names[t], at, last))
    taken = []
    for m, name, at, n in sorted(found):
        if all(at >= b + k or at + n <= b for _, b, k in taken):
            taken.append((name, at, n))
    return sorted((name, at) for name, at, _ in taken)


def test_notices_against_brute_force(spark, sf_dir):
    index = licenses.index_of()
    table = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if re.search("licen|permission", r["text"], re.I)][:25]
    mixed = [f"{words(7)} {licenses.TEMPLATES[i][1]} {words(9)} {licenses.TEMPLATES[-i - 1][1]}. {licenses.TEMPLATES[i][1]}" for i in range(0, 40, 5)]
    rows = [(r["doc_id"], r["text"], "en", "s") for r in table] + [(10_000_000 + i, t, "en", "s") for i, t in enumerate(mixed)] * 2
    got = licenses.license_findings(docs(spark, rows)).where("NOT license LIKE 'BSD%'").collect()
    for i, text, *_ in {r[0]: r for r in rows}.values():
        own = sorted({(r["license"], r["start_word"]) for r in got if r["doc_id"] == i})
        assert own == [x for x in _brute(text, index) if not x[0].startswith("BSD")], text[:200]
    assert table and len(got) > len(mixed)
