"""Licence scan by canonical digests. DataFrame functions only.

A text is brought to a canonical form: lower case, no copyright notice lines,
one spelling for words that count as the same, and single spaces for all
punctuation and white space. Its SHA-256 is looked up, by a hash join, among
the digests of known licence texts, which pass through the same form. The
whole document is looked up, and so is each of its paragraphs and lines, as
notices stand in documents as lines of their own, and each run of as many
consecutive paragraphs as a known text has, as a licence stands before code or
prose. Each such unit is compared as an entire text, never in part. Lines
without letters or digits part paragraphs.

Texts are read once; only digests are kept and joined, of units only those
whose canonical length a known text (of that many paragraphs) has. The known
side has one row a licence text.

The list that comes with the module is short: the permissive licences of up
to a page, the notices that the longer licences ask for, usual one-line
notices, and SPDX identifier lines. :func:`read_known` reads any folder of
licence texts, such as the SPDX list, for the parameter ``known``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, text_or_empty

# FIXED values: public licence texts and notices, by SPDX identifier.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("MIT", """MIT License

Copyright (c) <year> <copyright holders>

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
"""),
    ("ISC", """Copyright (c) <year> <copyright holders>

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""),
    ("Apache-2.0", """Copyright <year> <name of copyright owner>

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""),
    ("MIT-0", """MIT No Attribution

Copyright <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software
without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""),
    ("BSD-2-Clause", """BSD 2-Clause License

Copyright (c) <year>, <owner>

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""),
    ("BSD-3-Clause", """BSD 3-Clause License

Copyright (c) <year>, <owner>

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""),
    ("0BSD", """Zero-Clause BSD

Permission to use, copy, modify, and/or distribute this software for
any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT
OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""),
    ("Zlib", """zlib License

This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.
"""),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:

The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part, and
all derivative works of the Software, unless such copies or derivative
works are solely in the form of machine-executable object code generated by
a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT
SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE
FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.
"""),
    ("Unlicense", """The Unlicense

This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>
"""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""),
)

# FIXED values: the notice that the GNU licences ask programs to carry.
GNU_NOTICE = """This program is free software{colon} you can redistribute it and/or modify
it under the terms of the GNU {name} as published by
the Free Software Foundation, either version {version} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU {name} for more details.
"""
GNU = (("GPL-2.0-or-later", "General Public License", "2"), ("GPL-3.0-or-later", "General Public License", "3"),
       ("LGPL-2.1-or-later", "Lesser General Public License", "2.1"), ("LGPL-3.0-or-later", "Lesser General Public License", "3"),
       ("AGPL-3.0-or-later", "Affero General Public License", "3"))
SPDX = ("0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0",
        "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
        "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "Zlib")


def known_texts() -> list[tuple[str, str]]:
    """The module's licence texts: as written, without a title of few words, and those made by rule."""
    out = list(KNOWN)
    for name, text in KNOWN:
        first, _, rest = text.partition("\n\n")
        if rest and len(first.split()) <= 10 and "permi" not in first.lower():
            out.append((name, rest))
    for name, title, version in GNU:
        out += [(name, GNU_NOTICE.format(name=title, version=version, colon=c)) for c in (":", ";")]
    out += [(name, f"SPDX-License-Identifier: {name}") for name in SPDX]
    return out


# FIXED values: spellings that count as the same in licence texts.
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("licence", "license"), ("organisation", "organization"), ("favour", "favor"), ("behaviour", "behavior"),
    ("centre", "center"), ("fulfilment", "fulfillment"), ("judgement", "judgment"), ("per cent", "percent"),
    ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("sub license", "sublicense"),
    ("copyright holder", "copyright owner"), ("web site", "website"), ("https", "http"),
)
NOTICE_LINE = r"(?m)^[ \t#*/;-]*(copyright\b[^\n]*(\([cC]\)|©|[0-9]{4}|<year>)|\([cC]\)|©|all rights reserved)[^\n]*$"


def without_notices(text: Column) -> Column:
    """Lower case, without copyright notice lines."""
    return F.regexp_replace(F.lower(text), NOTICE_LINE, "")


def _spelled(text: Column, spellings=SPELLINGS) -> Column:
    """One spelling for all; a text that contains none of them, which is quicker to find out, is left as it is."""
    out, any_of = text, F.lit(False)
    for a, b in spellings:
        out = F.replace(out, F.lit(a), F.lit(b))
        any_of = any_of | text.contains(a)
    return F.when(any_of, out).otherwise(text)


def canonical(cleaned: Column) -> Column:
    """Letters and digits with single spaces between words, in one spelling."""
    return _spelled(F.trim(F.regexp_replace(cleaned, r"[^\p{L}\p{N}]+", " ")))


def canonical_lines(cleaned: Column) -> Column:
    """The canonical form of each line, with the line breaks kept: one pass for all units of a document."""
    return _spelled(F.regexp_replace(F.regexp_replace(cleaned, r"[^\p{L}\p{N}\n]+", " "), r" ?\n ?", "\n"))


def joined_lines(lines: Column) -> Column:
    """The canonical form of text made of canonical lines; only spellings of several words can lie across a break."""
    return _spelled(F.trim(F.regexp_replace(lines, r"\n+", " ")), [s for s in SPELLINGS if " " in s[0]])


def paragraphs_of(lines: Column) -> Column:
    """The canonical paragraphs of a text of canonical lines, without empty ones."""
    return F.filter(F.transform(F.split(lines, r"\n\n+"), joined_lines), lambda u: u != "")


def known_digests(known: DataFrame) -> DataFrame:
    """(license, digest, n, paragraphs) of a table (license, text); empty forms are no licences."""
    cleaned = without_notices(F.col("text"))
    form = known.select("license", canonical(cleaned).alias("form"), F.size(paragraphs_of(canonical_lines(cleaned))).alias("paragraphs")).where("form <> ''")
    return form.select("license", F.sha2("form", 256).alias("digest"), F.length("form").alias("n"), "paragraphs").distinct()


def read_known(spark: SparkSession, path: str) -> DataFrame:
    """(license, text) of a folder of licence texts, one a file, named by its identifier and ``.txt``."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.txt)?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("license"), F.col("value").alias("text"))


def _runs(paragraphs: str, count: int, lengths: list[int]) -> Column:
    """Digests of the runs of ``count`` paragraphs whose joined length is one of ``lengths``."""
    p = F.col(paragraphs)
    starts = F.when(F.size(p) >= count, F.sequence(F.lit(1), F.size(p) - (count - 1))).otherwise(F.array().cast("array<int>"))

    def size(at):
        return F.aggregate(F.slice(p, at, count), F.lit(count - 1), lambda acc, u: acc + F.length(u))

    return F.transform(F.filter(starts, lambda at: size(at).isin(lengths)), lambda at: F.sha2(F.array_join(F.slice(p, at, count), " "), 256))


def scan(df: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id_col, digest, license, notices, n_notices).

    ``digest`` is the SHA-256 of the whole canonical text, ``license`` the
    known licence with that digest (the first by name, else null), ``notices``
    the distinct known licences among the document's paragraphs, lines and
    runs of paragraphs, sorted and joined by commas. Null counts as the empty
    text, which is no licence. Texts of any length are scanned whole. Rows that repeat an id and a text repeat the result; an empty
    table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    table = known if known is not None else spark.createDataFrame(known_texts(), "license string, text string")
    digests = known_digests(table)
    whole = digests.groupBy("digest").agg(F.min("license").alias("license"))
    shapes = digests.select("paragraphs", "n").distinct().collect()            # one row a known text at most
    lengths = [r["n"] for r in shapes]

    lines = canonical_lines(without_notices(text_or_empty(text_col)))
    body = (df.select(F.col(id_col).alias("id"), lines.alias("t"))
            .select("id", F.trim(F.col("t"), F.lit(" \n")).alias("t"))
            .select("id", "t", joined_lines(F.col("t")).alias("whole"), paragraphs_of(F.col("t")).alias("p")))
    # a line is canonical as it stands; the text's only paragraph is the whole text
    units = F.filter(F.concat(F.split("t", r"\n"), F.when(F.size("p") > 1, F.col("p")).otherwise(F.array("whole"))), lambda u: F.length(u).isin(lengths))
    runs = [_runs("p", count, [r["n"] for r in shapes if r["paragraphs"] == count]) for count in sorted({r["paragraphs"] for r in shapes}) if count > 1]
    found = F.concat(F.transform(units, lambda u: F.sha2(u, 256)), *runs)
    docs = staged(body.select("id", F.sha2("whole", 256).alias("digest"), F.array_distinct(found).alias("units")), "forms")
    hits = (docs.select("id", F.col("digest").alias("of"), F.explode("units").alias("digest"))
            .join(digests.select("license", "digest"), "digest")
            .groupBy("id", "of").agg(F.array_sort(F.collect_set("license")).alias("found")))
    d, w, h = docs.drop("units").alias("d"), whole.alias("w"), hits.alias("h")
    same = F.col("d.id").eqNullSafe(F.col("h.id")) & (F.col("d.digest") == F.col("h.of"))
    return (d.join(w, F.col("d.digest") == F.col("w.digest"), "left").join(h, same, "left")
            .select(F.col("d.id").alias(id_col), "d.digest", "w.license", F.coalesce(F.array_join("h.found", ","), F.lit("")).alias("notices"),
                    F.coalesce(F.size("h.found"), F.lit(0)).cast("long").alias("n_notices")))


def oracle_sql() -> str:
    """The scan of ``documents`` in DuckDB SQL."""
    def quoted(s):
        return "'" + s.replace("'", "''") + "'"

    def form(of):
        out = f"trim(regexp_replace({of}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        for a, b in SPELLINGS:
            out = f"replace({out}, {quoted(a)}, {quoted(b)})"
        return out

    def clean(of):
        return f"regexp_replace(lower({of}), {quoted(NOTICE_LINE)}, '', 'g')"

    known = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in known_texts())
    part = r"\n[^\p{L}\p{N}\n]*\n"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS k, license, {clean('text')} AS t FROM (VALUES {known}) k(license, text)),
known AS (SELECT DISTINCT license, sha256({form('t')}) AS digest FROM texts),
counts AS (SELECT DISTINCT n FROM (SELECT k, count(*) AS n FROM (SELECT k, unnest(regexp_split_to_array(t, '{part}')) AS u FROM texts)
           WHERE {form('u')} <> '' GROUP BY 1) WHERE n > 1),
d AS (SELECT doc_id, t, sha256({form('t')}) AS digest
      FROM (SELECT doc_id, {clean("coalesce(text, '')")} AS t FROM documents)),
parts AS (SELECT doc_id, digest, {form('u')} AS u, i FROM (
            SELECT doc_id, digest, unnest(p) AS u, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, digest, regexp_split_to_array(t, '{part}') AS p FROM d))),
lists AS (SELECT doc_id, digest, list(u ORDER BY i) AS p FROM parts WHERE u <> '' GROUP BY 1, 2),
units AS (SELECT doc_id, digest, u FROM parts UNION ALL
          SELECT doc_id, digest, {form('u')} FROM (SELECT doc_id, digest, unnest(string_split(t, chr(10))) AS u FROM d) UNION ALL
          SELECT doc_id, digest, array_to_string(p[i:i + n - 1], ' ') FROM (
            SELECT doc_id, digest, p, n, unnest(range(1, len(p) - n + 2)) AS i FROM lists, counts WHERE len(p) >= n)),
u AS (SELECT DISTINCT doc_id, digest, u AS unit FROM units),
h AS (SELECT u.doc_id, u.digest, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS notices, count(DISTINCT k.license) AS n
      FROM u JOIN known k ON sha256(u.unit) = k.digest GROUP BY 1, 2)
SELECT d.doc_id, d.digest, (SELECT min(license) FROM known k WHERE k.digest = d.digest) AS license,
       coalesce(h.notices, '') AS notices, coalesce(h.n, 0) AS n_notices
FROM d LEFT JOIN h ON h.doc_id = d.doc_id AND h.digest = d.digest"""
