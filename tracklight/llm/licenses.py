"""Licence scans: passages compared to licence templates by the Dice coefficient over word bigrams.

Text and templates are normalised alike. Dice can reach the threshold only if the sizes of the two are near and most
of a template's bigrams are there, so size bounds leave few templates for a text and few windows for a template. A window
that doesn't start and end with a bigram of the template is worse than the one inside that does, so only
those are tried, and all of them. A notice of one line is found only with its licence's whole name in it: its
other words are anybody's.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracklight.llm.common import as_bytes, long, map_columns, string

#: Least Dice coefficient of a find.
THRESHOLD = 0.8
#: Licences by the names that one-line notices use. Longer texts follow.
NAMED = {
    "Apache-2.0": ("apache license version 2.0", "apache license 2.0", "apache 2.0 license"),
    "MIT": ("mit license",),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "bsd license"),
    "ISC": ("isc license",),
    "GPL-2.0": ("gnu general public license version 2", "gnu gpl version 2", "gpl v2"),
    "GPL-3.0": ("gnu general public license version 3", "gnu gpl version 3", "gpl v3"),
    "LGPL-2.1": ("gnu lesser general public license version 2.1",),
    "LGPL-3.0": ("gnu lesser general public license version 3",),
    "AGPL-3.0": ("gnu affero general public license version 3",),
    "MPL-2.0": ("mozilla public license version 2.0", "mozilla public license v. 2.0"),
    "EPL-2.0": ("eclipse public license version 2.0",),
    "Unlicense": ("unlicense",),
    "Zlib": ("zlib license",),
    "BSL-1.0": ("boost software license version 1.0",),
    "CC0-1.0": ("cc0 1.0 universal", "creative commons zero v1.0 universal"),
    "CC-BY-4.0": ("cc by 4.0", "creative commons attribution 4.0 international license"),
    "CC-BY-SA-4.0": ("cc by sa 4.0", "creative commons attribution sharealike 4.0 international license"),
    "CC-BY-NC-4.0": ("cc by nc 4.0", "creative commons attribution noncommercial 4.0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4.0",),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4.0",),
    "CC-BY-NC-ND-4.0": ("cc by nc nd 4.0",),
}
NOTICES = (
    "licensed under {the}{name}",
    "released under {the}{name}",
    "distributed under {the}{name}",
    "available under {the}{name}",
    "this work is licensed under {the}{name}",
    "this software is licensed under {the}{name}",
    "licensed under the terms of {the}{name}",
    "distributed under the terms of {the}{name}",
    "spdx license identifier {spdx}",
)
#: Of dual notices, for names of two words and more, three after "the": beside less, the notice's own words alone would reach the threshold.
DUAL = ("licensed under either of {the}{name}", "or {the}{name} at your option")
#: Texts of public licences, copyright lines left out.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES
OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3.
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely.""",
}
#: The header of GNU licences, and the name and version each has in it.
HEADER = """This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as
published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {thing}
is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License for more details."""
GNU = {
    "GPL-2.0": ("General", "2"),
    "GPL-3.0": ("General", "3"),
    "LGPL-2.1": ("Lesser General", "2.1"),
    "LGPL-3.0": ("Lesser General", "3"),
    "AGPL-3.0": ("Affero General", "3"),
}

#: ASCII marks that part words, but for the point, which stays within a number.
PART = bytes(c if chr(c).isalnum() or c in b"." or c > 127 or chr(c).isspace() else 32 for c in range(256))
SPELLINGS = {b"licence": b"license", b"licences": b"licenses", b"licenced": b"licensed"}


def normalize(text: bytes) -> list[bytes]:
    """Words in lower case, marks taken off, spelt alike."""
    words = text.lower().translate(PART).split()
    return [SPELLINGS.get(w, w) for x in words if (w := x.strip(b"."))]


class Templates:
    """The templates by size, and those that have each bigram, with how often. `more` are whole texts by licence, scanned for beside TEXTS."""

    def __init__(self, more: dict[str, str] | None = None) -> None:
        #: Words of each template, with the bigrams that a find of it must have.
        made: dict[tuple[str, tuple[bytes, ...]], frozenset] = {}
        for spdx, names in NAMED.items():
            for name in names:
                for notice in NOTICES + DUAL:
                    for the in ("the ", ""):
                        if notice in DUAL and len(name.split()) < (3 if the else 2):
                            continue
                        words = normalize(notice.format(the=the, name=name, spdx=spdx).encode())
                        own = normalize((spdx if "{spdx}" in notice else name).encode())
                        first = next(i for i in range(len(words)) if words[i : i + len(own)] == own)
                        first -= len(own) == 1  # a name of one word stands with the word before it
                        name_words = words[first : first + max(2, len(own))]
                        made[spdx, tuple(words)] = frozenset(zip(name_words, name_words[1:]))
        for spdx, text in [*TEXTS.items(), *(more or {}).items()]:
            made[spdx, tuple(normalize(text.encode()))] = frozenset()
        for spdx, (name, version) in GNU.items():
            for thing in ("program", "library"):
                made[spdx, tuple(normalize(HEADER.format(thing=thing, name=name, version=version).encode()))] = frozenset()
        kept = [(len(words) - 1, spdx, Counter(zip(words, words[1:])), must) for (spdx, words), must in made.items() if len(words) > 1]
        kept.sort(key=lambda t: (t[0], t[1]))
        self.templates = [t[:3] for t in kept]
        self.must = [t[3] for t in kept]
        self.sizes = [t[0] for t in self.templates]
        self.having: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
        for at, (_, _, bag) in enumerate(self.templates):
            for bigram, k in bag.items():
                self.having.setdefault(bigram, []).append((at, k))

    def best(self, bag: Counter, size: int, threshold: float) -> tuple[float, str] | None:
        """The most alike template; the first name of equals."""
        lo = bisect_left(self.sizes, size * threshold / (2 - threshold) - 1e-9)
        hi = bisect_right(self.sizes, size * (2 - threshold) / threshold + 1e-9)
        found = None
        for n, spdx, other in self.templates[lo:hi]:
            dice = 2 * sum(min(k, other[b]) for b, k in bag.items() if b in other) / (size + n)
            if dice >= threshold and (found is None or (-dice, spdx) < (-found[0], found[1])):
                found = (dice, spdx)
        return found


def windows(hits: list, size: int, spdx: str, bag: Counter, must: frozenset, threshold: float) -> list[tuple[int, int, str, float]]:
    """The finds of one template among the places of its bigrams, overlapping ones included."""
    longest = size * (2 - threshold) / threshold + 1e-9
    out = []
    for a, (first, _) in enumerate(hits):
        shared, seen = 0, Counter()
        for at in range(a, len(hits)):
            last, bigram = hits[at]
            length = last - first + 1
            if length > longest:
                break
            seen[bigram] += 1
            if seen[bigram] <= bag[bigram]:
                shared += 1
                if (dice := 2 * shared / (length + size)) >= threshold and must <= seen.keys():
                    out.append((first, last + 2, spdx, dice))
    return out


def scan(text: bytes | None, templates: Templates, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """(first word, word after the last, licence, Dice) of the finds, in order; words are those of normalize()."""
    if not text:
        return []
    words = normalize(text)
    having = templates.having
    hits = [(i, b) for i, b in enumerate(zip(words, words[1:])) if b in having]
    counts = Counter(b for _, b in hits)
    shared: Counter = Counter()
    for bigram, k in counts.items():
        for at, most in having[bigram]:
            shared[at] += min(k, most)
    found = []
    for at, k in shared.items():
        size, spdx, bag = templates.templates[at]
        if k >= size * threshold / (2 - threshold) - 1e-9:
            if templates.must[at] <= counts.keys():
                found += windows([h for h in hits if h[1] in bag], size, spdx, bag, templates.must[at], threshold)
    out: list[tuple[int, int, str, float]] = []
    for find in sorted(found, key=lambda f: (-f[3], f[0] - f[1], f[0], f[2])):  # of overlapping finds the best stays
        i = bisect_left(out, find)
        if (i == 0 or out[i - 1][1] <= find[0]) and (i == len(out) or find[1] <= out[i][0]):
            insort(out, find)
    return out


FINDS = T.ArrayType(
    T.StructType([long("first"), long("after"), string("license"), T.StructField("dice", T.DoubleType())])
)


def scan_licenses(df: DataFrame, text: str = "text", threshold: float = THRESHOLD, drop_text: bool = False, more: dict[str, str] | None = None) -> DataFrame:
    """`df` with finds: an array of (first, after, license, dice) over the whole text, in order.

    `more` are whole texts by licence that are scanned for too. Null and empty texts, and those without a licence, have an empty array. Repeated rows keep
    theirs; a column of `df` named finds is replaced, others stay.
    """

    def make():
        templates = Templates(more)

        def run(column):
            keys = ("first", "after", "license", "dice")
            return [[[dict(zip(keys, f)) for f in scan(x, templates, threshold)] for x in as_bytes(column)]]

        return run

    return map_columns(df, make, [text], [T.StructField("finds", FINDS)], drop=[text] if drop_text else [])
