"""Licence finds against all windows, and headers of their own names."""

from collections import Counter

import pytest

from tracklight.llm import licenses

T = licenses.Templates()
MIT, APACHE = "Licensed under the MIT License", "Apache License, Version 2.0"


def brute(text):
    words = licenses.normalize(text.encode())
    found = []
    for i in range(len(words)):
        for j in range(i + 2, len(words) + 1):
            bag = Counter(zip(words[i:j], words[i + 1 : j]))
            for size, spdx, other in T.templates:
                dice = 2 * sum((bag & other).values()) / (j - i - 1 + size)
                if dice >= 0.8:
                    found.append((i, j, spdx, dice))
    out = []
    for f in sorted(found, key=lambda f: (-f[3], f[0] - f[1], f[0], f[2])):
        if all(f[1] <= o[0] or f[0] >= o[1] for o in out):
            out.append(f)
    return sorted(out)


@pytest.mark.parametrize(
    ("text", "names"),
    [
        (f"{MIT} or the {APACHE}", ["MIT", "Apache-2.0"]),
        (f"Licensed under either of {APACHE} or MIT license at your option", ["Apache-2.0", "MIT"]),
        ("Licensed under either of the two terms at your option", []),
        (f"{MIT}\n{MIT}\n{MIT}", ["MIT"] * 3),
        (f"Some prose. {MIT}. Released under the ISC License. And so on.", ["MIT", "ISC"]),
        ("The words of the driver under the seat.", []),
    ],
)
def test_windows(text, names):
    out = licenses.scan(text.encode(), T)
    assert out == brute(text)
    if names is not None:
        assert [f[2] for f in out] == names


def test_repeated_text():
    out = licenses.scan(" ".join([licenses.TEXTS["ISC"]] * 2 + ["and", MIT]).encode(), T)
    assert [f[2] for f in out] == ["ISC", "ISC", "MIT"]


@pytest.mark.parametrize(
    ("spdx", "name", "version"),
    [
        ("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.1", "Lesser General", "2.1"),
        ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3"),
    ],
)
@pytest.mark.parametrize("thing", ["program", "library"])
def test_headers_have_their_own_name(spdx, name, version, thing):
    header = f"""This {thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} Public
    License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.
    This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License for more details."""
    assert [f[2] for f in licenses.scan(f"Before it. {header} After it.".encode(), T)] == [spdx]
