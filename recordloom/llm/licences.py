"""Licence scans by sentence rules.

A text is cut into sentences, each is normalised and looked up among known licence sentences, and
the sequence of their identifiers is matched against licence rules in order: a rule that fits
names its licence and uses up the identifiers it matched. All of it happens inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences, normalised (ASCII lower case, everything but letters and digits as one
# space, years as <year>, holders as <holder>), by identifier. One identifier can have several wordings.
SENTENCES: dict[str, tuple[str, ...]] = {
    "copyright": ("copyright <holder>",),
    "reserved": ("all rights reserved",),
    "mitTitle": ("mit license", "the mit license", "the mit license mit"),
    "mitRef": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license"),
    "mitGrant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ),
    "mitNotice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "mitAsIs": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    "mitLiable": (
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    "iscGrant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "bsdGrant": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ),
    "bsdSource": (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ),
    "bsdBinary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    "bsdNames": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "apacheRef": (
        "licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license",
        "released under the apache license version 2 0", "this work is licensed under the apache license version 2 0",
    ),
    "apacheComply": ("you may not use this file except in compliance with the license",),
    "apacheCopy": ("you may obtain a copy of the license at http www apache org licenses license 2 0",),
    "apacheAsIs": (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    "gpl2Ref": ("this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2"),
    "gpl3Ref": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3"),
    "gplFree": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "gpl2Free": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    ),
    "gplHope": (
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ),
    "gplMore": ("see the gnu general public license for more details",),
    "lgplRef": ("this work is licensed under the gnu lesser general public license version 3", "licensed under the gnu lesser general public license version 3"),
    "agplRef": ("this work is licensed under the gnu affero general public license version 3", "licensed under the gnu affero general public license version 3"),
    "mplForm": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "mplCopy": ("if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    "ccBy": ("licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "ccBySa": ("licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "ccByNc": ("licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "ccByNd": ("licensed under cc by nd 4 0", "this work is licensed under cc by nd 4 0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    "cc0": ("licensed under cc0 1 0", "this work is licensed under cc0 1 0", "released under cc0 1 0"),
    "publicDomain": ("this work is in the public domain", "released into the public domain", "this is free and unencumbered software released into the public domain"),
}

# Licences by SPDX identifier, in lines such as "SPDX-License-Identifier: MIT".
SPDX = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
    "LGPL-3.0-only", "AGPL-3.0-only", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC0-1.0",
)
SENTENCES |= {f"spdx:{name}": (f"spdx license identifier {name.lower().replace('-', ' ').replace('.', ' ')}",) for name in SPDX}

# Licence rules in order, longest first; a rule names sentences that follow one another
# among the known ones.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apacheRef", "apacheComply", "apacheCopy", "apacheAsIs")),
    ("BSD-3-Clause", ("bsdGrant", "bsdSource", "bsdBinary", "bsdNames")),
    ("MIT", ("mitGrant", "mitNotice", "mitAsIs", "mitLiable")),
    ("GPL-3.0-or-later", ("gplFree", "gplHope", "gplMore")),
    ("GPL-2.0-or-later", ("gpl2Free", "gplHope", "gplMore")),
    ("BSD-2-Clause", ("bsdGrant", "bsdSource", "bsdBinary")),
    ("MPL-2.0", ("mplForm", "mplCopy")),
    ("ISC", ("iscGrant", "mitAsIs", "mitLiable")),
    ("MIT", ("mitTitle", "mitGrant")),
    ("ISC", ("iscGrant",)),
    ("MPL-2.0", ("mplForm",)),
    ("Apache-2.0", ("apacheRef",)),
    ("MIT", ("mitRef",)),
    ("MIT", ("mitTitle",)),
    ("GPL-3.0-only", ("gpl3Ref",)),
    ("GPL-2.0-only", ("gpl2Ref",)),
    ("LGPL-3.0-only", ("lgplRef",)),
    ("AGPL-3.0-only", ("agplRef",)),
    ("CC-BY-4.0", ("ccBy",)),
    ("CC-BY-SA-4.0", ("ccBySa",)),
    ("CC-BY-NC-4.0", ("ccByNc",)),
    ("CC-BY-ND-4.0", ("ccByNd",)),
    ("CC0-1.0", ("cc0",)),
    ("public-domain", ("publicDomain",)),
    *((name, (f"spdx:{name}",)) for name in SPDX),
    ("all-rights-reserved", ("copyright", "reserved")),
    ("all-rights-reserved", ("reserved",)),
    ("copyright-notice", ("copyright",)),
)

#: A normalised sentence of a licence has one of these; the others are not looked up. Texts without
#: any of their letters are not even cut.
CUES = r"licen[sc]e|copyright|rights reserved|permission|redistribut|warrant|\bliable\b|\bas is\b|public domain|\bmpl\b|\bcc0\b"
LETTERS = r"licen[sc]e|copyright|rights|permission|redistribut|warrant|liable|as[^a-z0-9]+is|public|mpl|cc0"
#: Breaks between sentences, marked one after the other: SPDX lines, empty lines, white space behind the
#: end of a sentence, and line ends before what begins a sentence. Before that, the known notices lose
#: the signs and empty lines that would cut their sentences: an address on a line of its own, "v. 2.0", and
#: the colons and semicolons of the whole GNU notice.
MARK = "\x01"
BREAKS = (
    (r"SPDX-License-Identifier:[ \t]*([^\r\n*<>]*)", r"SPDX-License-Identifier \1" + MARK),
    (r"\bat[ \t#*/]*\r?\n[ \t\r\n#*/]*(https?://)", r"at \1"),
    (r"(\bLicense, [vV])\.", r"\1"),
    (r"\bFoundation;([ \t\r\n#*/]+either version)", r"Foundation\1"),
    (r"\bfree software[:;]([ \t\r\n#*/]+you can redistribute[^:;]{0,900}?This program is distributed in the hope)", r"free software\1"),
    (r"(WITHOUT ANY WARRANTY);", r"\1"),
    (r"\n[ \t\r\n]*\n", MARK),
    (r"([.!?:;])[ \t\r\n]+", r"\1" + MARK),
    (r"\n([ \t#*/-]*(?:Copyright|All rights|Licensed|Released|Permission|Redistribut|The MIT|MIT License|This work|This program|This project|Unless|You may|SPDX))", MARK + r"\1"),
)
OWNED = r"^copyright (c |(19|20)[0-9][0-9] ).+$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(sentence: Column) -> Column:
    """ASCII lower case, runs of other characters as one space, copyright lines as one form."""
    plain = F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), r"[^a-z0-9]+", " "))
    return F.when(F.regexp_like(plain, F.lit(OWNED)), F.lit("copyright <holder>")).otherwise(plain)


def sentences(text: Column) -> Column:
    """The normalised sentences that hold a cue, in order."""
    marked = text
    for pattern, by in BREAKS:
        marked = F.regexp_replace(marked, pattern, by.replace("\\1", "$1"))
    cued = F.filter(F.transform(F.split(marked, MARK, -1), normalised), lambda s: F.regexp_like(s, F.lit(CUES)))
    some = F.regexp_like(F.translate(text, UPPER, LOWER), F.lit(LETTERS))
    return F.when(some, cued).otherwise(F.array().cast("array<string>"))


def _known() -> Column:
    pairs = [(wording, name) for name, wordings in SENTENCES.items() for wording in wordings]
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def matched(ids: Column) -> Column:
    """Licences of a sequence of identifiers, by rule order: struct of licences and what is left.

    The sequence is text with a bar around every identifier; matched ones become a dash, so
    that identifiers on both sides of a match do not become neighbours.
    """
    rules = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit("|" + "||".join(seq) + "|").alias("seq")) for name, seq in RULES
    ])
    start = F.struct(
        F.concat(F.lit("|"), F.array_join(ids, "||"), F.lit("|")).alias("left"), F.array().cast("array<string>").alias("licences")
    )

    def step(seen: Column, rule: Column) -> Column:
        fits = F.contains(seen["left"], rule["seq"])
        return F.struct(
            F.when(fits, F.replace(seen["left"], rule["seq"], F.lit("|-|"))).otherwise(seen["left"]).alias("left"),
            F.when(fits, F.array_union(seen["licences"], F.array(rule["name"]))).otherwise(seen["licences"]).alias("licences"),
        )

    return F.aggregate(rules, start, step)


def scan_licences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Licences of every whole text, one row per input row.

    ``licences`` joins what the rules found, in rule order; ``sentence_ids`` is the sequence of
    known sentences; ``n_unmatched`` counts the known ones that no rule used and ``n_unknown`` the
    sentences with a licence cue that are not known. A null or empty text has none of them;
    repeated rows are scanned each; other columns are not read; no rows give no rows.
    """
    cued = docs.select(F.col(key), sentences(F.coalesce(F.col(text), F.lit(""))).alias("__cued"))
    ids = F.filter(F.transform("__cued", lambda s: F.try_element_at(_known(), s)), lambda x: x.isNotNull())
    found = cued.select(key, F.size("__cued").alias("__cues"), F.when(F.size("__cued") > 0, ids).otherwise(F.array().cast("array<string>")).alias("__ids"))
    none = F.struct(F.lit("").alias("left"), F.array().cast("array<string>").alias("licences"))
    found = found.withColumn("__match", F.when(F.size("__ids") > 0, matched(F.col("__ids"))).otherwise(none))
    left = F.size(F.filter(F.split("__match.left", r"\|+", -1), lambda x: (x != "") & (x != "-")))
    return found.select(
        key,
        F.array_join("__match.licences", ",").alias("licences"),
        F.array_join("__ids", ",").alias("sentence_ids"),
        left.cast("long").alias("n_unmatched"),
        (F.col("__cues") - F.size("__ids")).cast("long").alias("n_unknown"),
    )
