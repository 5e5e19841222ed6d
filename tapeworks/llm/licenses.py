"""Licence scans by sentence rules, in DataFrame functions alone.

A text is cut into sentences, each is normalised (lower case, runs of other characters than letters and digits to one space)
and looked up among known licence sentences. The identifiers found, in order, are then matched against ordered rules: a rule
is a sequence of identifiers that gives a licence; longer rules come first, and what a rule has matched is used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

# Sentences of well-known licences, by identifier, as their texts have them.
SENTENCES = {
    "MITgrant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MITnotice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MITasis": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "MITref": "Released under the MIT License.",
    "MITlicensed": "Licensed under the MIT License.",
    "BSDgrant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSDsource": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSDbinary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSDendorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSDasis": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "ISCgrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache2ref": "Licensed under the Apache License, Version 2.0.",
    "Apache2head": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "Apache2use": "you may not use this file except in compliance with the License.",
    "Apache2copy": "You may obtain a copy of the License at",
    "GPLfree": "This program is free software:",
    "GPL3terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL2terms": "either version 2 of the License, or (at your option) any later version.",
    "GPL3ref": "This work is licensed under the GNU General Public License, version 3.",
    "GPL2ref": "This work is licensed under the GNU General Public License, version 2.",
    "GPLhope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "LGPL3ref": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL2ref": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CCBYNC4ref": "Licensed under CC BY-NC 4.0.",
    "CCBY4ref": "Licensed under CC BY 4.0.",
    "CCBYSA4ref": "Licensed under CC BY-SA 4.0.",
    "CC0ref": "Released under CC0 1.0.",
    "BSDadvert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "0BSDgrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "ISCasis": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "Apache2grant": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "Apache2law": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL3preamble": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "AGPL3preamble": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "AGPL3terms": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPLfree": "This library is free software;",
    "LGPL2terms": "either version 2.1 of the License, or (at your option) any later version.",
    "LGPL3terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL3extra": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "LGPLhope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "MPL2copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL2made": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "EPL1made": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "UnlicenseFree": "This is free and unencumbered software released into the public domain.",
    "UnlicenseAnyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "ZlibAsis": "This software is provided 'as-is', without any express or implied warranty.",
    "ZlibGrant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BoostGrant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "BoostRef": "Distributed under the Boost Software License, Version 1.0.",
    "CDDLhead": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").",
    "PostgreSQLgrant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "CC0law": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
}
# SPDX identifiers of common licences and the names that references give them.
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "ISC": ["ISC License"],
    "0BSD": ["Zero-Clause BSD License"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"],
    "Unlicense": ["Unlicense"],
    "PostgreSQL": ["PostgreSQL License"],
    "NCSA": ["University of Illinois/NCSA Open Source License"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU General Public License v2.0"],
    "GPL-2.0-or-later": ["GNU General Public License, version 2 or later"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License v3.0"],
    "GPL-3.0-or-later": ["GNU General Public License, version 3 or later"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1"],
    "LGPL-2.1-or-later": ["GNU Lesser General Public License, version 2.1 or later"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3"],
    "LGPL-3.0-or-later": ["GNU Lesser General Public License, version 3 or later"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3"],
    "AGPL-3.0-or-later": ["GNU Affero General Public License, version 3 or later"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "EPL-1.0": ["Eclipse Public License 1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0"],
    "EUPL-1.2": ["European Union Public Licence 1.2"],
    "MS-PL": ["Microsoft Public License"],
    "CC0-1.0": ["Creative Commons Zero 1.0 Universal"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License"],
}
# How texts refer to a licence by name.
REFERENCES = ["Licensed under the {}.", "Released under the {}.", "This project is licensed under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "This software is released under the {}."]
# Ordered rules; the first that matches uses its sentences up.
RULES = [
    ("BSD-4-Clause", ["BSDgrant", "BSDsource", "BSDbinary", "BSDadvert", "BSDendorse", "BSDasis"]),
    ("BSD-3-Clause", ["BSDgrant", "BSDsource", "BSDbinary", "BSDendorse", "BSDasis"]),
    ("BSD-2-Clause", ["BSDgrant", "BSDsource", "BSDbinary", "BSDasis"]),
    ("MIT", ["MITgrant", "MITnotice", "MITasis"]),
    ("Apache-2.0", ["Apache2head", "Apache2use", "Apache2copy"]),
    ("GPL-3.0-or-later", ["GPLfree", "GPL3terms", "GPLhope"]),
    ("GPL-2.0-or-later", ["GPLfree", "GPL2terms", "GPLhope"]),
    ("GPL-3.0-or-later", ["GPLfree", "GPL3terms"]),
    ("GPL-2.0-or-later", ["GPLfree", "GPL2terms"]),
    ("MIT", ["MITgrant", "MITnotice"]),
    ("ISC", ["ISCgrant", "ISCasis"]),
    ("0BSD", ["0BSDgrant", "ISCasis"]),
    ("ISC", ["ISCgrant"]),
    ("MIT", ["MITref"]),
    ("MIT", ["MITlicensed"]),
    ("Apache-2.0", ["Apache2ref"]),
    ("GPL-3.0-only", ["GPL3ref"]),
    ("GPL-2.0-only", ["GPL2ref"]),
    ("LGPL-3.0-only", ["LGPL3ref"]),
    ("MPL-2.0", ["MPL2ref"]),
    ("CC-BY-NC-4.0", ["CCBYNC4ref"]),
    ("CC-BY-4.0", ["CCBY4ref"]),
    ("CC-BY-SA-4.0", ["CCBYSA4ref"]),
    ("CC0-1.0", ["CC0ref"]),
    ("Apache-2.0", ["Apache2law"]),
    ("Apache-2.0", ["Apache2grant"]),
    ("AGPL-3.0-or-later", ["GPLfree", "AGPL3terms", "GPLhope"]),
    ("AGPL-3.0-or-later", ["GPLfree", "AGPL3terms"]),
    ("LGPL-3.0-or-later", ["GPLfree", "LGPL3terms", "GPLhope"]),
    ("LGPL-2.1-or-later", ["LGPLfree", "LGPL2terms", "LGPLhope"]),
    ("LGPL-2.1-or-later", ["LGPLfree", "LGPL2terms"]),
    ("LGPL-3.0-or-later", ["LGPLfree", "LGPL3terms", "LGPLhope"]),
    ("LGPL-3.0-only", ["LGPL3extra"]),
    ("AGPL-3.0-only", ["AGPL3preamble"]),
    ("GPL-3.0-only", ["GPL3preamble"]),
    ("MPL-2.0", ["MPL2copy"]),
    ("EPL-2.0", ["EPL2made"]),
    ("EPL-1.0", ["EPL1made"]),
    ("Unlicense", ["UnlicenseFree", "UnlicenseAnyone"]),
    ("Unlicense", ["UnlicenseFree"]),
    ("Zlib", ["ZlibAsis", "ZlibGrant"]),
    ("BSL-1.0", ["BoostGrant"]),
    ("BSL-1.0", ["BoostRef"]),
    ("0BSD", ["0BSDgrant"]),
    ("CDDL-1.0", ["CDDLhead"]),
    ("PostgreSQL", ["PostgreSQLgrant"]),
    ("CC0-1.0", ["CC0law"]),
]
RULES = [*RULES, *[(name, [f"ref:{name}"]) for name in NAMES]]
#: A line that goes on in lower case, with comment marks between, is one sentence with the line before it.
WRAP = r"([a-z,])[ \t]*\r?\n[ \t]*[*#/;-]*[ \t]*([a-z(])"
#: A tag and the identifier after it are one sentence.
TAG = r"(SPDX-License-Identifier):[ \t]*"
END = r"[.:;!?]+[ \t]+|[.:;!?]*[ \t]*[\r\n]+"


def normal(sentence: str) -> str:
    import re

    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def parts(sentence: str) -> list[str]:
    """A known sentence, cut and normalised as texts are."""
    import re

    return [x for x in map(normal, re.split(END, sentence)) if x]


def known() -> dict[str, str]:
    """Normalised sentence -> identifier. A known sentence that texts are cut within is known by its longest part.

    References by name and SPDX tags are made of NAMES; those that SENTENCES has keep its identifiers.
    """
    made = {normal(way.format(name)): f"ref:{k}" for k, names in NAMES.items() for name in names for way in REFERENCES}
    tags = {normal(f"SPDX-License-Identifier {k}"): f"ref:{k}" for k in NAMES}
    return made | tags | {max(parts(s), key=len): k for k, s in SENTENCES.items()}


def sentences(text: Column) -> Column:
    return F.split(F.regexp_replace(F.regexp_replace(text, WRAP, "$1 $2"), TAG, "$1 "), END)


def identifiers(text: Column) -> Column:
    """The known sentences of a text, in order, as identifiers. A hash set drops the unknown ones; only known ones search the map."""
    names = known()
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    clean = lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    return F.transform(F.filter(F.transform(sentences(text), clean), lambda c: c.isin(list(names))), lambda c: table[c])


def rule_matches(ids: Column) -> Column:
    """The licences of a sequence of identifiers, sorted, once each. Sentences that no rule takes give `unknown`."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"|{x}|" for x in seq)).alias("seq")) for name, seq in RULES])
    start = F.struct(F.array_join(F.transform(ids, lambda i: F.concat(F.lit("|"), i, F.lit("|"))), "").alias("left"), F.array().cast("array<string>").alias("found"))

    def apply(acc, rule):
        hit = F.instr(acc["left"], rule["seq"]) > 0
        return F.struct(F.when(hit, F.replace(acc["left"], rule["seq"], F.lit("#"))).otherwise(acc["left"]).alias("left"), F.when(hit, F.array_append(acc["found"], rule["name"])).otherwise(acc["found"]).alias("found"))

    def finish(acc):
        rest = F.when(F.regexp_like(acc["left"], F.lit("[A-Za-z]")), F.array(F.lit("unknown"))).otherwise(F.array().cast("array<string>"))
        return F.sort_array(F.array_distinct(F.concat(acc["found"], rest)))

    return F.when(F.size(ids) == 0, F.array().cast("array<string>")).otherwise(F.aggregate(rules, start, apply, finish))


def scan_licenses(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """docs (columns `keep`) with sentence_ids and licenses (arrays). Null and empty texts have empty arrays; repeated rows each stay.
    Of rules that overlap, the one listed first takes the sentences. Texts are scanned whole, whatever their length.

    Columns of docs that have these names are replaced. An empty table gives no rows.
    """
    rows = docs.select(*quoted([c for c in keep or docs.columns if c not in ("sentence_ids", "licenses")]), identifiers(F.coalesce(F.col(text_col), F.lit(""))).alias("sentence_ids"))
    return rows.withColumn("licenses", rule_matches(F.col("sentence_ids")))
