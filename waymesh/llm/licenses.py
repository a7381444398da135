"""Licence scans by canonical digest lookup, in DataFrame functions only.

A line is normalised (case, punctuation, white space, equivalent spellings),
copyright lines and empty lines go, and the rest of a text, joined, has one
SHA-256 digest. Digests of whole texts are hash-joined to those of known
licences; single lines are looked up the same way among known one-line
notices.

The short licences are shipped whole, and the notices by which files refer to
the long ones (Apache, GPL, LGPL, AGPL, MPL); the long texts themselves come in
as a table of texts or digests.

A null or empty text has the digest of the empty string and no licence. Rows
are never dropped; a known text that appears under two names goes by the first
name in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The texts of public licences and of the notices that name them.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
}
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
_AUTHOR = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
"""
_BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software without
specific prior written permission.
"""
_PERMISSION = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted"""
TEXTS = {
    "0BSD": f"{_PERMISSION}.\n\n{_AUTHOR}",
    "BSD-2-Clause": f"{_BSD_HEAD}\n{_BSD_TAIL}",
    "BSD-3-Clause": f"{_BSD_HEAD}{_BSD_NAME}\n{_BSD_TAIL}",
    "ISC": f"{_PERMISSION}, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\n{_AUTHOR}",
    "MIT": f"""MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

{_WARRANTY}""",
    "MIT-0": f"""MIT No Attribution

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so.

{_WARRANTY}""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In
no event will the authors be held liable for any damages arising from the use of
this software.

Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to
the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim
that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this
software dedicate any and all copyright interest in the software to the public
domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an
overt act of relinquishment in perpetuity of all present and future rights to
this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by this
license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to
permit third-parties to whom the Software is furnished to do so, all subject to
the following:

The copyright notices in the Software and this entire statement, including the
above license grant, this restriction and the following disclaimer, must be
included in all copies of the Software, in whole or in part, and all derivative
works of the Software, unless such copies or derivative works are solely in the
form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE
COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES
OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}


def _gnu(name: str, short: str, version: str, free: str) -> str:
    return f"""This {free} is free software{"; " if "library" in free else ": "}you can redistribute it and/or modify it under the
terms of the GNU {name} as published by the Free Software Foundation, either
version {version} of the License, or (at your option) any later version.

This {free} is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU {name} for more details.

You should have received a copy of the GNU {short} along with this {free}. If
not, see <https://www.gnu.org/licenses/>."""


#: Notices of several lines by which a file names a long licence.
HEADERS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "GPL-3.0-or-later": _gnu("General Public License", "General Public License", "3", "program"),
    "GPL-2.0-or-later": _gnu("General Public License", "General Public License", "2", "program"),
    "AGPL-3.0-or-later": _gnu("Affero General Public License", "Affero General Public License", "3", "program"),
    "LGPL-2.1-or-later": _gnu("Lesser General Public License", "Lesser General Public License", "2.1", "library"),
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License,
v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain
one at http://mozilla.org/MPL/2.0/.""",
}
# Spellings that count as one.
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("sublicence", "sublicense"),
    ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("whilst", "while"),
    ("http", "https"),
    ("and or", "or"),
]
_NOT_WORD = r"[^\p{L}\p{N}]+"


#: Words that follow "copyright" in the licences' own sentences.
_OWN = ("notice", "notices", "holder", "holders", "owner", "owners", "law", "laws", "license", "licence", "interest", "and", "or", "statement", "act")


def _spaced(words: str) -> str:
    """Words as they stand within a normalised line."""
    return f" {words.replace(' ', '  ')} "


def canonical_lines(text: Column) -> Column:
    """The normalised lines of a text without its empty and copyright lines.

    A copyright line is one that starts with a copyright mark and goes on with
    anything but what licences themselves say of copyright, or that says "all
    rights reserved" and nothing else. Words have two spaces between them and one
    at either end, so that neighbouring spellings are each found.
    """
    marked = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\(c\)|©", " copyright ")

    def clean(x: Column) -> Column:
        for a, b in SPELLINGS:
            x = F.replace(x, F.lit(_spaced(a)), F.lit(_spaced(b)))
        return x

    lines = F.transform(F.split(marked, "\n"), lambda x: F.regexp_replace(F.concat(F.lit(" "), x, F.lit(" ")), _NOT_WORD, "  "))
    kept = F.filter(lines, lambda x: (x != "  ") & ~_marked(x))
    return F.transform(kept, lambda x: clean(F.regexp_replace(x, "^ | $", "")))


def _marked(line: Column) -> Column:
    """Whether a normalised line is a copyright line."""
    own = F.lit(False)
    for w in _OWN:
        own = own | line.startswith(f"  copyright  {w} ")
    return (line.startswith("  copyright ") & ~own) | (line == _MARK)


#: A line that says only that.
_MARK = "  all  rights  reserved  "


def digest(lines: Column) -> Column:
    """SHA-256 of normalised lines, joined with one space between words."""
    return F.sha2(F.encode(F.trim(F.replace(F.array_join(lines, ""), F.lit("  "), F.lit(" "))), "UTF-8"), 256)


def known_digests(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """(license_id, digest) of known licence texts, one row per digest."""
    t = spark.createDataFrame(sorted(texts), "license_id string, text string")
    return t.select("license_id", digest(canonical_lines(F.col("text"))).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def _shipped() -> list[tuple[str, str]]:
    return [*TEXTS.items(), *HEADERS.items(), *((k, t) for k, v in NOTICES.items() for t in v)]


def scan_licenses(docs: DataFrame, more: DataFrame | None = None, notices: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, digest, license_id of the whole text (or null) and the sorted ids of its one-line notices.

    The texts shipped are few and broadcast; more, a table of (license_id, text)
    or (license_id, digest) of any size, is joined as Spark sees fit.
    """
    spark = docs.sparkSession
    known = known_digests(spark, _shipped())
    if more is not None:
        other = more.select("license_id", (F.col("digest") if "digest" in more.columns else digest(canonical_lines(F.col("text")))).alias("digest"))
        known = known.unionByName(other).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    else:
        known = F.broadcast(known)
    pairs = sorted((t, k) for k, v in (NOTICES if notices is None else notices).items() for t in v)
    lines = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    wanted = F.array(*(canonical_lines(F.lit(t))[0] for t, _ in pairs)) if pairs else F.array().cast("array<string>")
    names = F.array(*(F.lit(k) for _, k in pairs)) if pairs else F.array().cast("array<string>")
    found = F.filter(F.transform(F.col("lines"), lambda x: F.element_at(names, F.nullif(F.array_position(wanted, x), F.lit(0)).cast("int"))), lambda x: x.isNotNull())
    out = lines.select("doc_id", digest(F.col("lines")).alias("digest"), F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("notices"))
    return out.join(known, "digest", "left").select("doc_id", "digest", "license_id", "notices")


def _sql_lines(text: str) -> str:
    line = "substr(x, 2, length(x) - 2)"
    for a, b in SPELLINGS:
        line = f"replace({line}, '{_spaced(a)}', '{_spaced(b)}')"
    raw = rf"[regexp_replace(' ' || y || ' ', '{_NOT_WORD}', '  ', 'g') for y in string_split(regexp_replace(lower(coalesce({text}, '')), '\(c\)|©', ' copyright ', 'g'), chr(10))]"
    own = "|".join(_OWN)
    return f"[{line} for x in {raw} if x <> '  ' and not (starts_with(x, '  copyright ') and not regexp_matches(x, '^  copyright  ({own}) ') or x = '{_MARK}')]"


def scan_sql() -> str:
    """The scan in DuckDB SQL over the table documents."""
    quote = lambda s: s.replace("'", "''")
    values = ", ".join(f"('{k}', '{quote(t)}')" for k, t in _shipped())
    notes = ", ".join(f"('{k}', '{quote(t)}')" for k, v in NOTICES.items() for t in v)
    dig = "sha256(trim(replace(array_to_string(l, ''), '  ', ' ')))"
    return f"""
with d as (select doc_id, {_sql_lines("text")} l from documents),
known as (select min(k) license_id, {dig} digest from (select k, {_sql_lines("t")} l from (values {values}) v(k, t)) group by 2),
note as (select distinct k, ({_sql_lines("t")})[1] line from (values {notes}) v(k, t)),
hit as (select doc_id, string_agg(distinct k, ',' order by k) notices from (select doc_id, unnest(l) line from d) join note using (line) group by 1)
select d.doc_id, {dig} digest, license_id, coalesce(notices, '') notices
from d left join known on known.digest = {dig} left join hit on hit.doc_id = d.doc_id"""
