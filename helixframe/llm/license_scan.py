"""Licence scans by sentence rules: known sentences become identifiers, identifier sequences match ordered rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import unclaimed

# Sentences of public licences and notices.  A number in a sentence stands for any version.
SENTENCES = {
    "gpl-grant": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl-grant": ["This work is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "agpl-grant": ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "apache-grant": ["Licensed under the Apache License, Version 2.0.", "This software is licensed under the Apache License, Version 2.0.", "This project is licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.", "You may obtain a copy of the License at"],
    "apache-as-is": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "mit-short": ["Released under the MIT License.", "Licensed under the MIT License.", "This software is licensed under the MIT License.", "This project is licensed under the MIT License.", "This software is released under the MIT License."],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "isc-grant-0": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "bsd-use": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd-as-is": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "mpl-grant": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "epl-grant": ["Licensed under the Eclipse Public License, version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/."],
    "boost-grant": ["Distributed under the Boost Software License, Version 1.0."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "unlicense-domain": ["This is free and unencumbered software released into the public domain."],
    "unlicense-grant": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc-by-nc-sa": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "cc0": ["Released under CC0 1.0.", "Dedicated to the public domain under CC0 1.0."],
    "reserved": ["All rights reserved."],
}

#: Tried in this order, each wherever its identifiers stand next to each other; what a rule has matched is used up, and
#: its neighbours don't become neighbours.  "?" marks identifiers that may be missing.  ``{v}`` in a name is the version
#: (or, in a tag, the name) that the first identifier carries.
RULES = (
    ("BSD-3-Clause", ("bsd-use", "bsd-source?", "bsd-binary?", "bsd-endorse", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-use", "bsd-source?", "bsd-binary?", "bsd-as-is")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is?")),
    ("MIT-0", ("mit-grant", "mit-as-is")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("isc-grant-0",)),
    ("Apache-{v}", ("apache-grant", "apache-copy?", "apache-as-is?", "apache-see?")),
    ("AGPL-{v}", ("agpl-grant", "gpl-hope?")),
    ("LGPL-{v}", ("lgpl-grant", "gpl-hope?")),
    ("GPL-{v}", ("gpl-grant", "gpl-hope?")),
    ("MPL-{v}", ("mpl-grant", "mpl-copy?")),
    ("EPL-{v}", ("epl-grant",)),
    ("BSL-{v}", ("boost-grant",)),
    ("Zlib", ("zlib-grant",)),
    ("Unlicense", ("unlicense-domain", "unlicense-grant?")),
    ("MIT", ("mit-short",)),
    ("CC-BY-NC-SA-{v}", ("cc-by-nc-sa",)),
    ("CC-BY-NC-{v}", ("cc-by-nc",)),
    ("CC-BY-ND-{v}", ("cc-by-nd",)),
    ("CC-BY-SA-{v}", ("cc-by-sa",)),
    ("CC-BY-{v}", ("cc-by",)),
    ("CC0-{v}", ("cc0",)),
    ("{v}", ("spdx",)),
    ("All-rights-reserved", ("reserved",)),
)

#: Every known sentence has one of these, in lower case; others aren't looked up.
TRIGGERS = "licen|rights reserved|permission|permitted|warrant|is provided|public domain|cc0|redistribut|the mpl|copy, modify"
_NUMBER = "[0-9]+([.][0-9]+)*"
_TAG = "(?i:spdx-license-identifier:)"
_ID = "[A-Za-z0-9](?:[A-Za-z0-9.:+-]*[A-Za-z0-9+])?"
_UNIT = f"{_ID}(?:[ \\t]+WITH[ \\t]+{_ID})?"
#: Licences with their exceptions, joined by AND and OR, brackets anywhere; what follows isn't part of the tag.  The
#: possessive loop keeps Java's matcher from recursing over a long expression.
_SPDX = f"{_TAG}[( \\t]*{_UNIT}[) \\t]*(?:(?:AND|OR)[( \\t]+{_UNIT}[) \\t]*)*+"
#: After these a sentence ends: a stop before a blank or a line end, a colon at a line end, and an empty line, comment
#: marks aside.
_ENDS = "([.!?][ \\t\\r]+|[.!?]\\r?\\n|:[ \\t\\r]*\\n|\\n[ \\t\\r#/*;%-]*\\n)"
_BREAK = "\x01"


def normal_form(sentence: str) -> str:
    """Lower case, words and versions parted by single spaces, versions as ``#``: what the Spark expression gives."""
    s = re.sub(r"[^a-z0-9.]+", " ", sentence.lower())
    return re.sub(r"^[. ]+|[. ]+$", "", re.sub(_NUMBER, "#", s))


KNOWN = {normal_form(s): name for name, each in SENTENCES.items() for s in each}


def _at_lines() -> str:
    """Any known sentence, in a text of words and line ends, that starts where a line does and ends where one does.
    Longer sentences come first, since one may begin with another."""
    each = ("".join({" ": "[ \\n]+", "#": f"(?:{_NUMBER})"}.get(c) or re.escape(c) for c in k) for k in sorted(KNOWN, key=len, reverse=True))
    return f"(?m)^[. ]*(?:{'|'.join(each)})[. ]*$"


def rule_pattern(ids: tuple[str, ...]) -> str:
    """Over a string like ``;gpl-grant@3;;reserved@;``, where each element has two semicolons of its own."""
    first, *rest = ids
    more = "".join(f"(?:;{i.rstrip('?')}@[^;]*;){'?' if i.endswith('?') else ''}" for i in rest)
    return f";{first}@([^;]*);{more}"


def _named(name: str):
    return lambda version: F.replace(F.lit(name), F.lit("{v}"), version)


def scan_licenses(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Adds ``sentence_ids`` (recognised sentences in order, ``id@version``), ``licenses`` (names, in rule order, then
    in text order; repeated as often as met) and ``n_unmatched`` (recognised sentences that no rule used).

    ``expressions`` holds the SPDX tags' expressions, as written but for blanks: ``licenses`` lists each licence of one,
    with its exception, whether OR offers it or AND demands it.

    Sentences end at stops before a blank or a line end, at a colon that ends a line, at empty lines, and before and
    after a tag; inside a sentence line ends, indents and comment marks count as blanks, so wrapped and commented
    headers are recognised.  In a sentence that isn't known as a whole, known ones are looked up from each line start
    to any line end, so that a header may follow a line without a stop.  Null and empty texts have none; very long
    texts are scanned whole; rows are independent, repeated rows all stay, an empty table gives an empty one, nothing is
    shuffled.  Input columns called like the new ones are replaced; all others stay, whatever their names.
    """
    known, at_lines = F.create_map(*(F.lit(x) for pair in KNOWN.items() for x in pair)), _at_lines()

    def identified(s: Column) -> Column:
        flat = F.regexp_replace(F.lower(s), "[^a-z0-9.]+", " ")
        name = known[F.regexp_replace(F.regexp_replace(flat, _NUMBER, "#"), "^[. ]+|[. ]+$", "")]
        return F.concat(name, F.lit("@"), F.regexp_extract(flat, f"({_NUMBER})", 1))

    def expression(s: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, f"^{_TAG}", ""), "[ \\t]+", " "), "([(]) | (?=[)])", "$1"))

    def tagged(s: Column) -> Column:
        units = F.split(F.trim(F.regexp_replace(F.regexp_replace(s, f"^{_TAG}", ""), "[() \\t]+", " ")), " (?:AND|OR) ")
        return F.transform(units, lambda u: F.concat(F.lit("spdx@"), u))

    def each(s: Column) -> Column:
        lines = F.regexp_extract_all(F.regexp_replace(F.lower(s), "[^a-z0-9.\\n]+", " "), F.lit(at_lines), F.lit(0))
        found = F.transform(F.array(identified(s)), lambda x: F.when(x.isNull(), F.transform(lines, identified)).otherwise(F.array(x)))[0]
        return F.when(s.rlike(f"^{_SPDX}$"), tagged(s)).otherwise(found)

    value = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(_BREAK), F.lit(" "))
    value = F.regexp_replace(value, _SPDX, f"{_BREAK}$0{_BREAK}")
    sentences = F.split(F.regexp_replace(value, _ENDS, f"$1{_BREAK}"), _BREAK)
    likely = F.filter(sentences, lambda s: F.lower(s).rlike(TRIGGERS))
    seq, part = unclaimed(df.columns, "seq", "part")
    out = df.withColumn(part, likely).withColumn("sentence_ids", F.flatten(F.transform(part, each)))
    out = out.withColumn("expressions", F.transform(F.filter(part, lambda s: s.rlike(f"^{_SPDX}$")), expression)).drop(part)
    out = out.withColumn(seq, F.array_join(F.transform("sentence_ids", lambda x: F.concat(F.lit(";"), x, F.lit(";"))), "")).withColumn("licenses", F.array().cast("array<string>"))
    for name, ids in rules:
        pattern = rule_pattern(ids)
        met = F.transform(F.regexp_extract_all(seq, F.lit(pattern), F.lit(1)), _named(name))
        # What is used up leaves a bar, which no rule matches.
        out = out.withColumn("licenses", F.concat("licenses", met)).withColumn(seq, F.regexp_replace(seq, pattern, "|"))
    left = F.filter(F.split(seq, "[;|]+"), lambda x: x != "")
    return out.withColumn("n_unmatched", F.size(left).cast("long")).drop(seq)
