"""License scans by patience alignment.

Words that occur once in the text and once in a template are anchors; the longest run of
anchors that rises in both is kept, and each gap between them is aligned in the same way.
The share of template words that get matched is the coverage.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from importlib.resources import files
from typing import Callable, Iterator

from pyspark.sql import DataFrame

from spatialqa.llm.common import fields, flat_map

WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")
#: The least coverage that is reported, and how much longer than the template a place in the text may be.
COVERAGE, STRETCH = 0.8, 2

def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


#: Full texts that are carried, and the phrases that tell each from its relatives.
FULL = {
    "0BSD": ["is hereby granted the software is provided"], "Apache-2.0": ["apache license version 2.0"], "Artistic-1.0-Perl": ["artistic license"],
    "BSD-2-Clause": ["with the distribution this software is provided"], "BSD-3-Clause": ["endorse or promote products derived from this software"],
    "BSD-4-Clause": ["advertising materials mentioning features or use", "endorse or promote products derived from this software"],
    "BSL-1.0": ["machine-executable object code generated"], "CC-BY-SA-4.0": ["attribution-sharealike 4.0 international"], "CC0-1.0": ["cc0 1.0 universal"],
    "GFDL-1.2": ["gnu free documentation license version 1.2"], "GFDL-1.3": ["gnu free documentation license version 1.3"],
    "GPL-1.0": ["gnu general public license version 1"], "GPL-2.0": ["gnu general public license version 2"], "GPL-3.0": ["gnu general public license version 3"],
    "ISC": ["copyright notice and this permission notice appear in all copies"], "LGPL-2.0": ["gnu library general public license version 2"],
    "LGPL-2.1": ["gnu lesser general public license version 2.1"], "LGPL-3.0": ["gnu lesser general public license version 3"],
    "MIT": ["included in all copies or substantial portions"], "MIT-0": ["to do so the software is provided"],
    "MPL-1.1": ["mozilla public license version 1.1"], "MPL-2.0": ["mozilla public license version 2.0"], "NCSA": ["names of its contributors may be used to endorse or promote"],
    "OFL-1.1": ["sil open font license version 1.1"], "Unlicense": ["free and unencumbered software"], "Zlib": ["altered source versions must be plainly marked"],
}


def fixed_templates() -> dict[str, tuple[str, list[str]]]:
    """Text and telling phrases by name: full texts, ``-header`` of source files, ``-notice`` and ``-statement`` of one sentence, ``-tag`` of SPDX."""
    folder = files("spatialqa.llm") / "license_texts"
    out = {name: ((folder / f"{name}.txt").read_text(encoding="utf-8"), telling) for name, telling in FULL.items()}
    gnu = [("GPL", "", v) for v in ("1.0", "2.0", "3.0")] + [("LGPL", "Library ", "2.0"), ("LGPL", "Lesser ", "2.1"), ("LGPL", "Lesser ", "3.0"), ("AGPL", "Affero ", "3.0")]
    for family, kind, version in gnu:
        name, v = f"GNU {kind}General Public License", version.removesuffix(".0")
        what = "library" if family == "LGPL" else "program"
        out[f"{family}-{version}-notice"] = f"This work is licensed under the {name}, version {v}.", [f"{name} version {v}"]
        for suffix, terms in (("or-later", f"either version {v} of the License, or (at your option) any later version"), ("only", f"version {v} of the License")):
            out[f"{family}-{version}-{suffix}-header"] = (
                f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software "
                f"Foundation, {terms}. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
                f"warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the "
                f"{name} along with this {what}. If not, see <https://www.gnu.org/licenses/>.",
                [name, *([f"either version {v} of the License", "any later version"] if suffix == "or-later" else [f"Foundation version {v} of the License"])])
    for name, family, versions in (("Apache License", "Apache", ("1.0", "1.1", "2.0")), ("Mozilla Public License", "MPL", ("1.0", "1.1", "2.0")),
                                   ("Eclipse Public License", "EPL", ("1.0", "2.0")), ("Boost Software License", "BSL", ("1.0",)),
                                   ("GNU Free Documentation License", "GFDL", ("1.1", "1.2", "1.3")), ("SIL Open Font License", "OFL", ("1.0", "1.1"))):
        for v in versions:
            out[f"{family}-{v}-notice"] = f"Licensed under the {name}, Version {v}.", [f"{name} Version {v}"]
    for name, said in (("MIT", "MIT"), ("ISC", "ISC"), ("Zlib", "zlib"), ("NCSA", "NCSA"), ("BSD", "BSD"), ("BSD-2-Clause", "BSD 2-Clause"), ("BSD-3-Clause", "BSD 3-Clause"),
                       ("BSD-4-Clause", "BSD 4-Clause")):
        out[f"{name}-notice"] = f"Released under the {said} License.", [f"{said} License"]
    for short, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
                        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
        for v, where in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
            worded = long.replace("NoDerivatives", "NoDerivs") if v < "4" else long
            out[f"CC-{short}-{v}-notice"] = f"Licensed under CC {short} {v}.", [f"CC {short} {v}"]
            out[f"CC-{short}-{v}-statement"] = f"This work is licensed under a Creative Commons {worded} {v} {where} License.", [f"Commons {worded} {v}"]
    out |= {
        "CC0-1.0-notice": ("Licensed under CC0 1.0.", ["CC0 1.0"]),
        "CC0-1.0-statement": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ["waived all copyright and related or neighboring rights"]),
        "Apache-2.0-header": (
            "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy "
            "of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
            "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
            "language governing permissions and limitations under the License.", ["Apache License Version 2.0"]),
        "MPL-1.1-header": (
            "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the "
            "License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an \"AS IS\" basis, "
            "WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and limitations under the License.",
            ["Mozilla Public License Version 1.1"]),
        "MPL-2.0-header": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
                           "You can obtain one at https://mozilla.org/MPL/2.0/.", ["Mozilla Public License v 2.0"]),
        "EPL-1.0-header": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this "
                           "distribution, and is available at http://www.eclipse.org/legal/epl-v10.html", ["Eclipse Public License v1.0"]),
        "EPL-2.0-header": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
                           "https://www.eclipse.org/legal/epl-2.0/", ["Eclipse Public License 2.0"]),
        "BSL-1.0-header": ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
                           "http://www.boost.org/LICENSE_1_0.txt)", ["Boost Software License Version 1.0"]),
        "BSD-style-header": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", ["BSD-style license"]),
        "MIT-style-header": ("Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.", ["MIT-style license"]),
    }
    tags = [*FULL, "EPL-1.0", "EPL-2.0", *{f"CC-{n.split('-', 1)[1].rsplit('-', 1)[0]}" for n in out if n.startswith("CC-BY") and n.endswith("-notice")}]
    tags += [f"{f}-{v}-{s}" for f, _, v in gnu for s in ("only", "or-later")] + ["AGPL-3.0"]
    return out | {f"{t}-tag": (f"SPDX-License-Identifier: {t}", [f"SPDX-License-Identifier {t}"]) for t in tags}


#: Fixed values.
FIXED = fixed_templates()
TEMPLATES, TELLING = {name: text for name, (text, _) in FIXED.items()}, {name: telling for name, (_, telling) in FIXED.items()}


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (in order of their first) whose second rises."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        tops[k:k + 1], at[k:k + 1] = [b], [i]
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions of ``a`` and ``b``, rising in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:  # equal ends need no anchor
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            out.append((a1 - 1, b1 - 1))
            a1, b1 = a1 - 1, b1 - 1
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if once_b[w] == 1}
        anchors = rising([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if once_a[w] == 1 and w in place])
        out += anchors
        if anchors:
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            work += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:])]
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, telling: list[str] | None = None) -> None:
        self.name, self.words = name, words_of(text)
        self.count = Counter(self.words)
        phrases = [words_of(p) for p in telling or ()]
        self.needed = {w for p in phrases for w in p}
        #: For each telling phrase its length and its places in the template.
        self.telling = [(len(p), [i for i in range(len(self.words)) if self.words[i:i + len(p)] == p]) for p in phrases]

    def told(self, match: list[tuple[int, int]]) -> bool:
        """Whether each telling phrase is aligned somewhere as a whole, without other words in it."""
        at = {b: a for a, b in match}
        return all(any(i in at and all(at.get(i + k) == at[i] + k for k in range(n)) for i in places_) for n, places_ in self.telling)


def places(words: list[str], template: Template, coverage: float) -> Iterator[tuple[int, int]]:
    """Ranges of the text, apart from each other, that hold enough words of the template within its stretched length.

    Every range of that length whose alignment could reach the coverage lies in or meets one of them.
    """
    need, width = coverage * len(template.words), STRETCH * len(template.words)
    hits = [i for i, w in enumerate(words) if w in template.count]
    seen: Counter = Counter()
    have, left, start, stop = 0, 0, None, 0
    for right, i in enumerate(hits):
        w = words[i]
        seen[w] += 1
        have += seen[w] <= template.count[w]
        while hits[left] <= i - width:
            w = words[hits[left]]
            have -= seen[w] <= template.count[w]
            seen[w] -= 1
            left += 1
        if have >= need:
            if start is not None and hits[left] >= stop:
                yield start, stop
                start = None
            if start is None:
                start = hits[left]
            stop = i + 1
    if start is not None:
        yield start, stop


def scan(text: str, templates: list[Template], coverage: float = COVERAGE) -> list[tuple[str, float, int, int, int]]:
    """(template, best coverage, places that reach it, first and last word of the best one) of each template that is found.

    Where several templates claim the same words, the one with most of them aligned keeps the place, then the better covered one.
    """
    words = words_of(text)
    known = set(words)
    claims = []
    for t in templates:
        if not t.needed <= known or sum(n for w, n in t.count.items() if w in known) < coverage * len(t.words):
            continue
        for start, stop in places(words, t, coverage):
            cuts = list(pieces(words, t, start, stop))
            found = [m for at, end in cuts if (m := claim(words, t, at, end, coverage))]
            if not found and len(cuts) > 1 and (m := claim(words, t, start, stop, coverage)):
                found = [m]
            claims += [(-len(m), len(t.words), t.name, m) for m in found]
    taken: set[int] = set()
    out: dict[str, list[tuple[float, int, int]]] = {}
    for matched, size, name, at in sorted(claims):
        if 2 * len(taken.intersection(at)) < len(at):
            taken.update(at)
            out.setdefault(name, []).append((-matched / size, -at[0], at[-1]))
    return [(name, max(found)[0], len(found), -max(found)[1], max(found)[2]) for name, found in sorted(out.items())]


def claim(words: list[str], template: Template, start: int, stop: int, coverage: float) -> list[int]:
    """The words of a range that the template takes; none below the coverage or without what tells it from others."""
    match = align(words[start:stop], template.words)
    return [start + a for a, _ in match] if match and len(match) >= coverage * len(template.words) and template.told(match) else []


def pieces(words: list[str], template: Template, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """Parts of a range, cut where the template's first anchor word comes again; several notices in a row are told apart."""
    head = next((w for w in template.words if template.count[w] == 1), template.words[0])
    before = template.words.index(head)
    cuts = sorted({max(start, i - before) for i in range(start, stop) if words[i] == head} | {start})
    yield from zip(cuts, [*cuts[1:], stop])


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, n_places, first_word, last_word for each template found in each document.

    ``coverage`` counts matched template words. The fixed templates are found only with their
    telling phrases (name, version, NC/SA/ND); ``templates`` of the caller have none. A null or empty text finds nothing; repeated
    rows and null ids are scanned row by row. Equal coverage: the first place. A template
    without words is never found. Only doc_id and text are read.
    """
    texts, telling = (TEMPLATES, TELLING) if templates is None else (templates, {})

    def start() -> Callable[..., Iterator[tuple]]:
        ready = [t for t in (Template(n, x, telling.get(n)) for n, x in sorted(texts.items())) if t.words]
        return lambda doc, text: ((doc, *row) for row in scan(text or "", ready, coverage))

    schema = fields("doc_id long,license string,coverage double,n_places long,first_word long,last_word long")
    return flat_map(docs.select("doc_id", "text"), start, schema)
