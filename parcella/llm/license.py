"""Licence scans by canonical digest.

Texts are brought into a canonical form: lower case, lines that only state a copyright removed, equivalent spellings made
one, punctuation and white space reduced to single blanks. The SHA-256 of the whole canonical text is then looked up
among the digests of known licence texts and notices by a hash join. The same lookup takes whole documents (scan_texts) or
each of their lines as a text of its own (scan_lines), which finds notices that have a line to themselves.

The known texts are given as a table or taken from KNOWN; their digests come from the same canonical form. The join
broadcasts them if there are at most BROADCAST of them, by their count, and shuffles digests otherwise.

Cases: a null or empty text, or one whose canonical form is empty, has no licence. Ties: a digest known by several names goes
to the smallest name. Repeated rows are looked up each. Extra columns don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST = 10_000
#: Spellings that count as equal, each with the one that stands for all.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("merchantibility", "merchantability"),
    ("noninfringement", "non infringement"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("per cent", "percent"),
    ("v2 0", "version 2 0"),
    ("v3", "version 3"),
    ("https", "http"),
)
#: Licence texts and notices, by name.
KNOWN = {
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-2.0-or-later header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-3.0-or-later header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004
Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.
DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT notice": "Released under the MIT License.",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <http://unlicense.org>""",
    "all rights reserved notice": "All rights reserved.",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
#: A line that only states a copyright, with a year or a sign, and what separates words.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n©(]*(?:copyright[^\n]*\d{4}|copyright[ \t]*(?:\(c\)|©)|\(c\)[^\n]*\d{4}|©)[^\n]*$"
BETWEEN = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""), BETWEEN, " ")), F.lit(" "))
    for spelling, one in SPELLINGS * 2:  # neighbours share a blank: the second time finds those between
        words = F.replace(words, F.lit(f" {spelling} "), F.lit(f" {one} "))
    return F.trim(words)


def digested(rows: DataFrame, text: str) -> DataFrame:
    """rows with the digest of a text column's canonical form, null where that is empty. explode keeps the optimizer from
    bringing a text into its form once for the comparison and once for the digest."""
    formed = rows.select("*", F.explode(F.array(canonical(F.col(text)))).alias("__form"))
    return formed.withColumn("digest", F.when(F.col("__form") != "", F.sha2(F.col("__form").cast("binary"), 256))).drop("__form")


#: First lines that licence texts come with, by name. Each text is known without a title and with any of its own.
TITLES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License'),
    "ISC": ("ISC License", "The ISC License"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "Unlicense": ("The Unlicense",),
    "zlib": ("zlib License", "The zlib/libpng License"),
}


def known_texts() -> list[tuple[str, str]]:
    """(license, text) of all known texts, under each title and none."""
    bare = {k: v.removeprefix(f"{TITLES[k][0]}\n") if k in TITLES else v for k, v in KNOWN.items()}
    titled = [(k, f"{title}\n{bare[k]}") for k, titles in TITLES.items() for title in titles]
    return sorted([*bare.items(), *titled])


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, license) of known texts, a table of (license, text)."""
    if known is None:
        known = spark.createDataFrame(known_texts(), "license string, text string")
    rows = digested(known.select("license", "text"), "text").where("digest is not null")
    return rows.groupBy(F.col("digest").alias("known")).agg(F.min("license").alias("license"))


def _looked_up(rows: DataFrame, known: DataFrame | None, how: str) -> DataFrame:
    table = known_digests(rows.sparkSession, known)
    if known is None or known.count() <= BROADCAST:
        table = F.broadcast(table)
    return rows.join(table, F.col("digest") == F.col("known"), how).drop("known")


def scan_texts(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, license): one row per row of docs; license is null where the whole text isn't a known one."""
    rows = digested(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    return _looked_up(rows.drop("text"), known, "left")


def scan_lines(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, digest, license): the lines, counted from 0, that are known texts."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))
    return _looked_up(digested(lines, "line").drop("line"), known, "inner")


def _sql_form(text: str) -> str:
    form = f"' ' || trim(regexp_replace(regexp_replace(lower({text}), '{COPYRIGHT_LINE}', '', 'g'), '{BETWEEN}', ' ', 'g')) || ' '"
    for spelling, one in SPELLINGS * 2:
        form = f"replace({form}, ' {spelling} ', ' {one} ')"
    return f"trim({form})"


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: DuckDB: the same canonical forms and lookups.
SQL = f"""
WITH given(license, text) AS (VALUES {", ".join(f"({_sql_text(k)}, {_sql_text(v)})" for k, v in known_texts())}),
known AS (SELECT sha256({_sql_form("text")}) AS digest, min(license) AS license FROM given GROUP BY 1),
whole AS (SELECT doc_id, {_sql_form("text")} AS form FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
found AS (
  SELECT l.doc_id, count(*) AS n, string_agg(DISTINCT k.license, ';' ORDER BY k.license) AS names
  FROM lines l JOIN known k ON sha256({_sql_form("l.line")}) = k.digest WHERE {_sql_form("l.line")} <> '' GROUP BY l.doc_id)
SELECT w.doc_id, CASE WHEN w.form <> '' THEN sha256(w.form) END AS canonical_sha256, k.license,
       coalesce(f.n, 0)::BIGINT AS notice_lines, coalesce(f.names, '') AS notices
FROM whole w LEFT JOIN known k ON w.form <> '' AND sha256(w.form) = k.digest LEFT JOIN found f ON f.doc_id = w.doc_id
"""
