"""What licence texts are compared with: fixed values, all of them public."""

from __future__ import annotations

# Spellings that count as equal in licence texts, in lower case; the first is read as the second.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sublicence", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

# Lines that name a licence before its text.
TITLES = (
    "bsd 2 clause license",
    "bsd 3 clause license",
    "bsd license",
    "bsd zero clause license",
    "isc license",
    "mit license",
    "mit no attribution",
    "new bsd license",
    "simplified bsd license",
    "the bsd license",
    "the isc license",
    "the mit license",
    "the mit license mit",
    "the unlicense",
    "the zlib license",
    "zlib license",
)

_AS_IS_BSD = (
    'THIS SOFTWARE IS PROVIDED BY {who} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL {liable} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_HOLDERS = _AS_IS_BSD.format(who="THE COPYRIGHT HOLDERS AND CONTRIBUTORS", liable="{liable}")
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_TWO = (
    "{a} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "{b} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "{c} Neither the name of {name} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_AS_IS_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_AS_IS_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and{or_} distribute this software for any purpose with or without fee is hereby granted"


def _bsd() -> list[tuple[str, str]]:
    """Numbered with a point or a parenthesis, or by marks alone; of the copyright holder or owner, or the names that are usual."""
    found = []
    for a, b, c in (("1.", "2.", "3."), ("*", "*", "*")):
        for liable in ("THE COPYRIGHT HOLDER OR CONTRIBUTORS", "THE COPYRIGHT OWNER OR CONTRIBUTORS"):
            found.append(("BSD-2-Clause", _BSD_START + _BSD_TWO.format(a=a, b=b) + _HOLDERS.format(liable=liable)))
            for name in ("the copyright holder", "the copyright owner", "the author", "the organization"):
                found.append(("BSD-3-Clause", _BSD_START + _BSD_TWO.format(a=a, b=b) + _BSD_THIRD.format(c=c, name=name) + _HOLDERS.format(liable=liable)))
        regents = _AS_IS_BSD.format(who="THE REGENTS AND CONTRIBUTORS", liable="THE REGENTS OR CONTRIBUTORS")
        found.append(("BSD-3-Clause", _BSD_START + _BSD_TWO.format(a=a, b=b) + _BSD_THIRD.format(c=c, name="the University") + regents))
    return found


# Notices, and short licence texts without their copyright lines.
TEXTS = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("MIT", f"{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS_MIT}"),
    ("MIT", f"{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software. {_AS_IS_MIT}"),
    ("MIT-0", f"{_MIT_GRANT}. {_AS_IS_MIT}"),
    *(("ISC", f"{_ISC_GRANT.format(or_=x)}, provided that the above copyright notice and this permission notice appear in all copies. {_AS_IS_ISC}") for x in ("", "/or")),
    *(("0BSD", f"{_ISC_GRANT.format(or_=x)}. {_AS_IS_ISC}") for x in ("", "/or")),
    *_bsd(),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. "
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. "
        "For more information, please refer to <http://unlicense.org/>",
    ),
    (
        "BSL-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003 "
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: '
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "WTFPL",
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004 "
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. "
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
    ),
)

# The paragraphs that source files begin with, and the line by which they name a licence.
_APACHE_END = 'the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
_GNU = "{what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{how} version {n} of the License{later}."
HEADERS = (
    ("Apache-2.0", f"Licensed under {_APACHE_END}"),
    ("Apache-2.0", f"Licensed under {_APACHE_END} http://www.apache.org/licenses/LICENSE-2.0"),
    (
        "Apache-2.0",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. "
        f"The ASF licenses this file to You under {_APACHE_END}",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    *(
        (f"{name}-{version}", _GNU.format(what=what, mark=mark, kind=kind, how=how, n=n, later=later))
        for name, kind, versions in (("GPL", "", (("2.0", "2"), ("3.0", "3"))), ("LGPL", "Lesser ", (("2.1", "2.1"), ("3.0", "3"))), ("AGPL", "Affero ", (("3.0", "3"),)))
        for version, n in versions
        for what in ("This program", "This library")
        for mark in (";", ":")
        for how, later in ((", either", ", or (at your option) any later version"), (";", ""), (",", ""))
    ),
)
_SPDX = (
    *("0BSD", "AGPL-3.0", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0"),
    *("GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "Unlicense", "WTFPL", "Zlib"),
)
_VARIANTS = {"AGPL", "GFDL", "GPL", "LGPL"}
IDENTIFIERS = tuple((name, f"SPDX-License-Identifier: {name}{more}") for name in _SPDX for more in (("", "-only", "-or-later", "+") if name.split("-")[0] in _VARIANTS else ("",)))

# Digests of the canonical form of whole texts, as their publishers distribute them.
DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "616beafc01d122b7fa90c42ab6fb5928871fd932cf7d4f8acfd9393299e0e712"),
    ("Apache-2.0", "9385e77162734bf297f30f924cb02e25e9b96adc73405f38cf55279760020177"),
    ("Artistic-1.0-Perl", "0b2d9a8f02e70510bb78040ef79d0182a1ce0aeaffaab13a274e46e7ec26faa2"),
    ("CC0-1.0", "a1c5451395262a9c57097cf8ed1be6259bce24f74691c20b350916c920658336"),
    ("GFDL-1.2", "091d3d8b9fecc67ae1858f4c2d21c09ef1757c90b3919f795c6e8ff6e83f8019"),
    ("GFDL-1.3", "02c039ff6013ec01dc618dc26d1a2106e605e7a23bdcda805cc1b3543d57ba83"),
    ("GPL-1.0", "652eeefe4542a613bbc824b2d3125883eeb0dba3f1a7500aaf53e3f42c7a7609"),
    ("GPL-2.0", "a74f1eeb28b124d61f4b41d1dfdae0bbf57f0626948953dde2fcf7105aed65f5"),
    ("GPL-3.0", "f1c58b3b6ae9cddab1a787a6f5d9a6d65b0f1b47d5d7e0bef0ec522397af3f00"),
    ("LGPL-2.0", "29707cf9e35d2c823e79cc5767a98cd6b33ca3b39982078cfb16747790f527f6"),
    ("LGPL-2.1", "9399a25c7bf3d1056abba0b7bd3666aa103743270f45e1eff943cf42f74c2e3f"),
    ("LGPL-3.0", "9da940a5cdd0ef8c6da67bf24cbe851115f32bfcb87aa56b7dec93a85f943e6d"),
    ("MPL-1.1", "a7dad95978f506c642d3935585e0a33d63e1b2284ee8a87044178d7029154dc4"),
    ("MPL-2.0", "b203b68ce18fc8813145291e137d23b974d9d04de13b0366be0bb4431a2d1cb1"),
)
