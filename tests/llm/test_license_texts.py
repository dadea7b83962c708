"""Licence texts as published, as they stand, wrapped anew and behind comment signs."""

import textwrap

from tracewell.llm.license_scan import scan_licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD3 = BSD2 + """

3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version."""
GNU = """This {0} is free software; you can redistribute it and/or modify
it under the terms of the GNU {1} General Public License as published by
the Free Software Foundation; either version {2} of the License, or
(at your option) any later version."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
TEXTS = [
    ("MIT", MIT, "mit-grant,as-is"), ("BSD-2-Clause", BSD2, "bsd-grant"), ("BSD-3-Clause", BSD3.format("the copyright holder"), "bsd-grant,bsd-no-endorse"),
    ("BSD-3-Clause", BSD3.format("the University of Somewhere, Inc"), "bsd-grant,bsd-no-endorse"), ("Apache-2.0", APACHE, "apache-2-notice,apache-compliance,apache-copy-at"),
    ("GPL-3.0", GPL3, "gnu-free-software,gpl-3-notice"), ("GPL-2.0", GPL2, "gnu-free-software,gpl-2-notice"),
    ("GPL-3.0", "   GNU GENERAL PUBLIC LICENSE\n      Version 3, 29 June 2007\n\n Copyright", "gpl-3-notice"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991\n", "gpl-2-notice"),
    ("MIT", "This software is released\nunder the MIT License.", "mit-notice"),
    ("BSD-3-Clause", BSD3.format("Foo, Inc."), "bsd-grant,bsd-no-endorse"), ("LGPL-2.1", GNU.format("library", "Lesser", "2.1"), "lgpl-2-1-notice"),
    ("LGPL-3.0", GNU.format("library", "Lesser", "3"), "lgpl-3-notice"), ("AGPL-3.0", GNU.format("program", "Affero", "3"), "gnu-free-software,agpl-3-notice"), ("ISC", ISC, "isc-grant"),
    ("MPL-2.0", MPL, "mpl-2-notice"), ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy.", "unlicense-grant"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons\nAttribution 4.0 International License.", "cc-by-4-notice"),
    ("CC-BY-SA-4.0", "Licensed under the Creative Commons\nAttribution-ShareAlike 4.0 International License.", "cc-by-sa-4-notice"),
    # The library licence, a sentence that goes on, and one torn by a blank line are others.
    (None, GPL2.replace("General", "Lesser General"), "gnu-free-software"), (None, "not released\n\nunder the MIT license", ""), (None, MIT[:300], ""),
]


def shapes(text):
    yield text
    yield text.replace("\n", "\r\n")
    for width in (30, 60, 500):
        yield "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))
    for sign in ("# ", " * ", "// "):
        yield "/* A header.\n" + "\n".join((sign + line).rstrip() for line in ["", *text.split("\n"), ""]) + "\ncode()"


def test_published_texts(spark):
    rows = [(i, s, n, ids) for i, (n, t, ids) in enumerate(TEXTS) for s in shapes(t)]
    got = scan_licenses(spark.createDataFrame([(k, r[1]) for k, r in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["license"], r["sentence_ids"]) for r in got} == {k: (r[2], r[3]) for k, r in enumerate(rows)}


def test_long_runs_of_lines(spark):
    df = spark.createDataFrame([(1, "\n" * 200_000 + "Released under the MIT License" + "\n \n" * 100_000), (2, "the software\n" * 50_000)], "doc_id long, text string")
    assert {r["doc_id"]: r["license"] for r in scan_licenses(df).collect()} == {1: "MIT", 2: None}


def test_exactly_one_licence(spark):
    """With the usual header, all rights reserved; two grants of which one goes without the third clause are two licences."""
    header = "Copyright (c) 2020, Some Owner.\nAll rights reserved.\n\n"
    bsd3 = BSD3.format("the copyright holder")
    cases = [
        ("MIT", header + MIT), ("BSD-2-Clause", header + BSD2), ("BSD-3-Clause", header + bsd3), ("BSD-3-Clause", header + BSD3.format("Foo, Inc.")), ("Apache-2.0", header + APACHE),
        ("GPL-3.0", header + GPL3), ("LGPL-2.1", header + GNU.format("library", "Lesser", "2.1")), ("ISC", header + ISC), ("MPL-2.0", header + MPL), ("Proprietary", header),
        ("BSD-3-Clause", header + bsd3 + "\n\n" + bsd3), ("BSD-3-Clause,BSD-2-Clause", header + BSD2 + "\n\n" + header + bsd3), ("BSD-3-Clause,BSD-2-Clause", bsd3 + "\n\n" + BSD2),
        ("", "All rights reserved by the owner"), ("MIT,BSD-3-Clause", MIT + "\n\n" + bsd3),
    ]
    tags = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "Unlicense", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "AGPL-3.0"]
    cases += [(t, f"{sign} SPDX-License-Identifier: {t}{end}\nint main") for t in tags for sign, end in (("//", ""), ("/*", " */"))]
    cases += [("GPL-2.0", "# SPDX-License-Identifier: GPL-2.0-or-later"), ("LGPL-3.0", "# SPDX-License-Identifier: LGPL-3.0-only"), ("", "SPDX-License-Identifier: MITX")]
    got = scan_licenses(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(cases)], "doc_id long, text string")).collect()
    assert {k: (cases[k][1], n) for k, (n, _) in enumerate(cases)} == {r["doc_id"]: (cases[r["doc_id"]][1], r["licenses"]) for r in got}
