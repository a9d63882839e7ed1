"""Texts of well-known licences and one-line notices, and spellings that count as equal."""

from itertools import product
from pathlib import Path

_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_ISC_TAIL = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""

#: (SPDX-like name, whole text without title)
_SHORT = [
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies." + _ISC_TAIL),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted." + _ISC_TAIL),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    (
        "BSD-3-Clause",
        _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." + _BSD_TAIL,
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
""",
    ),
]

#: Whole texts as published, in the folder ``spdx``: (SPDX-like name, lines that are title).
_LONG = [
    ("Apache-2.0", 3), ("Artistic-1.0-Perl", 1), ("BSL-1.0", 1), ("CC0-1.0", 2), ("GFDL-1.2", 2), ("GFDL-1.3", 2), ("GPL-1.0", 2), ("GPL-2.0", 2), ("GPL-3.0", 2),
    ("LGPL-2.0", 2), ("LGPL-2.1", 2), ("LGPL-3.0", 2), ("MPL-1.1", 2), ("MPL-2.0", 1), ("Unlicense", 0),
]

#: Titles that may stand above a text.
_TITLES = {
    "MIT": ["MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "Expat License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "0BSD License"],
    "BSD-2-Clause": ["BSD License", "BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "2-Clause BSD License"],
    "BSD-3-Clause": [
        "BSD License", "BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License", "Revised BSD License", "3-Clause BSD License",
    ],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License", "zlib License (Zlib)"],
    "Apache-2.0": ["Apache License\nVersion 2.0, January 2004\nhttps://www.apache.org/licenses/", "Apache License\nVersion 2.0, January 2004", "Apache License 2.0"],
    "BSL-1.0": ["Boost Software License 1.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
#: What some copies leave out at the end: (the last line that stays, whether it stays).
_ENDS = [("END OF TERMS AND CONDITIONS", True), ("END OF TERMS AND CONDITIONS", False), ("For more information, please refer to <https://unlicense.org/>", False)]


def _read(name: str, titles: int) -> tuple[str, str]:
    """(title, text) of a published text."""
    lines = (Path(__file__).parent / "spdx" / f"{name}.txt").read_text(encoding="utf-8").strip().splitlines()
    at = [i for i, x in enumerate(lines) if x.strip()][titles]
    return "\n".join(lines[:at]), "\n".join(lines[at:])


def _variants(name: str, title: str, text: str) -> list[tuple[str, str]]:
    """The text under each title, whole and with its end left out; last without title."""
    bodies = [text]
    for line, stays in _ENDS:
        at = text.find(line)
        if at >= 0:
            bodies.insert(0, text[: at + len(line) * stays])
    if name == "Unlicense":
        bodies.insert(0, text.replace("https://", "http://"))
    return [(name, f"{t}\n\n{body}" if t else body) for t, body in product(dict.fromkeys([*_TITLES.get(name, []), title, ""]), bodies)]


#: Names of licences in one-line notices.
_NAMED = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "MIT": ["MIT License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"],
    "CC-BY-4.0": ["CC BY 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0"],
    "Unlicense": ["Unlicense"],
}
_IDS = [*_NAMED, "0BSD", *(f"{n}-{x}" for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for x in ("only", "or-later"))]
_NOTICES = [
    *((f"{n}-notice", f"{verb} under {the}{name}") for n, names in _NAMED.items() for name in names for verb in ("Licensed", "Released", "This work is licensed") for the in ("", "the ")),
    *((f"{n}-notice", f"SPDX-License-Identifier: {n}") for n in _IDS),
]

#: (SPDX-like name, whole text or notice); of a licence's texts the one without title is last.
LICENCES = [
    *(v for name, text in _SHORT for v in _variants(name, "", text)),
    *(v for name, titles in _LONG for v in _variants(name, *_read(name, titles))),
    *_NOTICES,
]

#: (spelling, the one it counts as), applied in this order to lower-cased text
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("merchantibility", "merchantability"),
    ("per cent", "percent"),
]
