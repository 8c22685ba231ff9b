"""Licence scans by canonical digest lookup (DataFrame functions only).

Case, punctuation, copyright lines and equivalent spellings are normalised away, and the SHA-256 of what
remains is joined to the digests of known licences. Each line, each paragraph of several lines and the entire
text of a document are looked up: a notice is a line or a paragraph at the head of a file, a licence file is an
entire text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspan.llm.common import small_side, table

#: Lines that name the holder of the rights, and equivalent spellings (after punctuation has gone).
COPYRIGHT_LINE = r"^[^\p{L}\p{N}(©]*(copyright|\(c\)|©)\s*(\(c\)|©|[0-9]{4}|by\b)[^\n]*$|^[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"
SPELLINGS = (
    (r"\blicence(s|d|e|es|ees)?\b", r"license$1"),
    (r"\bsub license(s|d)?\b", r"sublicense$1"),
    (r"\b(v|ver|vers) ?([0-9]+)\b", r"version $2"),
    (r"\bversion ([0-9]+) 0\b", r"version $1"),
    (r"\bcc by( nc| sa| nd| nc sa| nc nd)? ([0-9]) 0\b", r"cc by$1 $2"),
    (r"\bcreative commons attribution( noncommercial| non commercial)? ([0-9])( 0)?( international)?( license)?\b", r"cc by$1 $2"),
    (r"\bcc by non ?commercial\b", r"cc by nc"),
    (r"\bgnu (affero |lesser )?gpl\b", r"gnu $1general public license"),
    (r"\borganisation(s)?\b", r"organization$1"),
    (r"\backnowledgement(s)?\b", r"acknowledgment$1"),
    (r"\bhttps\b", r"http"),
)

#: Names that notices give, by licence.
NAMES = {
    "MIT": ("MIT License", "MIT"),
    "ISC": ("ISC License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "GPL-2.0": ("GNU General Public License, version 2",),
    "GPL-3.0": ("GNU General Public License, version 3",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0"),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero 1.0"),
    "CC-BY-3.0": ("CC BY 3.0",),
    "CC-BY-4.0": ("CC BY 4.0",),
    "CC-BY-SA-3.0": ("CC BY-SA 3.0",),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0",),
    "CC-BY-NC-3.0": ("CC BY-NC 3.0",),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0",),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0",),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0",),
    "Unlicense": ("Unlicense", "The Unlicense"),
    "Zlib": ("zlib License",),
}
#: The sentences in which notices give a name.
NOTICES = (
    "Licensed under {}.",
    "Licensed under the {}.",
    "Released under {}.",
    "Released under the {}.",
    "Distributed under the {}.",
    "Available under the {}.",
    "This work is licensed under {}.",
    "This work is licensed under the {}.",
    "This project is licensed under the {}.",
    "This software is licensed under the {}.",
)
#: Identifiers of the SPDX list that name each licence, where they aren't the licence's key alone.
SPDX = {
    "GPL-2.0": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0+"),
    "GPL-3.0": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0+"),
    "LGPL-2.1": ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-2.1+"),
    "LGPL-3.0": ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL-3.0+"),
    "AGPL-3.0": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
}
#: What the notices of the GNU licences have in common.
GNU_NOTICE = "{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} version {} of the License, or (at your option) any later version."
#: Notices and titles of several lines, as the licences publish them.
BLOCKS = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License");',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "Apache License Version 2.0, January 2004",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ),
    "GPL-2.0": (GNU_NOTICE.format("This program is free software;", "", "; either", "2"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "GPL-3.0": (GNU_NOTICE.format("This program is free software:", "", ", either", "3"), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "LGPL-2.1": (GNU_NOTICE.format("This library is free software;", "Lesser ", "; either", "2.1"), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    "LGPL-3.0": (GNU_NOTICE.format("This library is free software:", "Lesser ", ", either", "3"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "AGPL-3.0": (GNU_NOTICE.format("This program is free software:", "Affero ", ", either", "3"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
}
#: What the BSD texts have in common.
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Entire texts of short licences, as published.
TEXTS = {
    "BSD-2-Clause": BSD_HEAD + BSD_TAIL,
    "BSD-3-Clause": BSD_HEAD + BSD_THIRD + BSD_TAIL,
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}


#: The line that may precede an entire text.
TITLES = {"MIT": "MIT License", "ISC": "ISC License", "0BSD": "BSD Zero Clause License", "Zlib": "zlib License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Unlicense": "The Unlicense"}


def known_rows() -> list[tuple[str, str]]:
    rows = [(k, n.format(name)) for k, names in NAMES.items() for name in names for n in NOTICES]
    rows += [(k, f"SPDX-License-Identifier: {i}") for k in dict.fromkeys([*NAMES, *TEXTS]) for i in SPDX.get(k, (k,))]
    rows += [(k, b) for k, blocks in BLOCKS.items() for b in blocks]
    return rows + [(k, head + t) for k, t in TEXTS.items() for head in ("", TITLES[k] + "\n\n")]


def known_licenses(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """(license, text): the notices and short texts that this module states, and the whole of each file in `folder`, whose name is the licence's.

    Long licences (Apache, GPL, MPL, CC) have no entire text here: without a folder of their published texts
    notices, titles and SPDX lines of one identifier find them.
    """
    known = spark.createDataFrame(known_rows(), "license string, text string")
    if folder is None:
        return known
    name = F.regexp_extract(F.input_file_name(), r"([^/]*?)(\.txt)?$", 1)
    return known.unionByName(spark.read.text(folder, wholetext=True).select(name.alias("license"), F.col("value").alias("text")))


def canonical(line: Column) -> Column:
    """A line without case, punctuation, copyright statement or variant spelling; several lines' forms are joined by blanks."""
    out = F.regexp_replace(F.lower(line), COPYRIGHT_LINE, "")
    out = F.regexp_replace(out, NOT_WORD, " ")
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def all_canonical_lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), canonical)


def filled(forms: Column) -> Column:
    return F.filter(forms, lambda x: x != "")


def canonical_lines(text: Column) -> Column:
    """The canonical forms of a text's lines, without empty ones."""
    return filled(all_canonical_lines(text))


def canonical_blocks(lines: Column) -> Column:
    """Paragraphs of two lines or more, as one form each: lines between those of empty form (blank ones, bare comment marks, copyright lines)."""
    blocks = F.transform(F.split(F.array_join(lines, "\n"), "\n\n+"), lambda x: F.btrim(x, F.lit("\n")))
    return F.transform(F.filter(blocks, lambda x: F.contains(x, F.lit("\n"))), lambda x: F.translate(x, "\n", " "))


def digest(canonical_text: Column) -> Column:
    return F.sha2(canonical_text, 256)


def known_digests(known: DataFrame) -> DataFrame:
    """(license, digest), once each. A text that two licences share counts for both; null and empty texts are left out."""
    text = F.array_join(canonical_lines(F.col("text")), " ")
    return known.select("license", text.alias("form")).where("form != '' and license is not null").select("license", digest(F.col("form")).alias("digest")).distinct()


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, n_lines, n_blocks, entire_text): known licences that documents state, a row for each document and licence.

    `n_lines` counts the lines that are a notice of the licence, `n_blocks` the paragraphs of several lines that
    are a known text of it, however they are wrapped or commented out; `entire_text` says whether all of the
    text is one. Null and empty texts state none. Rows with the same doc_id are one document with their
    findings added up (a null doc_id too), so a repeated row counts its lines twice. Other columns are ignored.
    One pass over the texts and a hash join to the digests; only findings are shuffled.
    """
    every = docs.select(F.col(doc_id).alias("doc_id"), all_canonical_lines(F.col(text)).alias("every"))
    forms = every.select("doc_id", filled(F.col("every")).alias("lines"), canonical_blocks(F.col("every")).alias("blocks"))
    unit = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), digest(x).alias("digest"))
    units = F.concat(F.transform("lines", unit("line")), F.transform("blocks", unit("block")), F.array(unit("entire")(F.array_join("lines", " "))))
    found = forms.select("doc_id", F.explode(units).alias("unit")).select("doc_id", "unit.kind", "unit.digest").join(small_side(known_digests(known)), "digest")
    return found.groupBy("doc_id", "license").agg(
        F.count_if(F.col("kind") == "line").alias("n_lines"),
        F.count_if(F.col("kind") == "block").alias("n_blocks"),
        F.max(F.col("kind") == "entire").alias("entire_text"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known_licenses(spark))


def op2_sql() -> str:
    """The same scan in DuckDB SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    text = f"regexp_replace(regexp_replace(lower(x), {quoted(COPYRIGHT_LINE)}, '', 'g'), {quoted(NOT_WORD)}, ' ', 'g')"
    for pattern, to in SPELLINGS:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(to.replace('$', chr(92)))}, 'g')"
    every = f"list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim({text}, ' '))"
    filled = "list_filter(every, lambda y: y <> '')"
    blocks = "list_transform(string_split_regex(array_to_string(every, chr(10)), '\\n\\n+'), lambda x: trim(x, chr(10)))"
    blocks = f"list_transform(list_filter({blocks}, lambda x: contains(x, chr(10))), lambda x: replace(x, chr(10), ' '))"
    values = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in known_rows())
    return f"""
WITH known AS (SELECT DISTINCT license, array_to_string({filled}, ' ') AS form FROM (SELECT license, {every} AS every FROM (VALUES {values}) AS v(license, text))),
forms AS (SELECT doc_id, {filled} AS lines, {blocks} AS blocks FROM (SELECT doc_id, {every} AS every FROM documents)),
units AS (SELECT doc_id, 'line' AS kind, unnest(lines) AS form FROM forms
          UNION ALL SELECT doc_id, 'block', unnest(blocks) FROM forms
          UNION ALL SELECT doc_id, 'entire', array_to_string(lines, ' ') FROM forms)
SELECT doc_id, license, count(*) FILTER (kind = 'line') AS n_lines, count(*) FILTER (kind = 'block') AS n_blocks, bool_or(kind = 'entire') AS entire_text
FROM units JOIN known USING (form) WHERE form <> '' GROUP BY doc_id, license
"""
