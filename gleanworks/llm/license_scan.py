"""Licence scan by canonical digests.

A text is brought to a canonical form: A-Z lower-cased, copyright lines taken out, equivalent spellings made one, everything but
letters and digits turned into single blanks. The digest of the whole canonical text is joined with the digests of
known licences; the digest of each line's canonical text is looked up among those of known notices, the one-line texts by which
a work names its licence. Both tables are fixed and small (below 100 rows), so the join is a broadcast hash join and one
pass over the texts does all.

Defined cases: a null text counts as empty; the empty canonical text is no licence; repeated rows are judged each; a null
doc_id is carried through; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ascii_lower, query, read

# Licence texts, without copyright lines.
LICENSES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
# Notices that name a licence.
NOTICES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "Licensed under the Apache License 2.0."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Licensed under the GPL v3."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."),
    "CC0-1.0": ("Released into the public domain under CC0 1.0.", "Licensed under CC0 1.0."),
    "proprietary": ("All rights reserved.",),
}
# Spellings that count as one, in canonical form (lower case, blanks for marks), around whole words.
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub licence", "sublicense"), ("non infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"),
             ("favour", "favor"), ("whilst", "while"), ("merchantibility", "merchantability"), ("per cent", "percent"), ("non commercial", "noncommercial"), ("and or", "andor"),
             ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"))
# A line that begins with a copyright mark and names a year or a holder.
_COPYRIGHT = r"(?m)^[ \t#*/;-]*(copyright|\(c\)|©)[^\n]*([0-9]{4}|©|\(c\))[^\n]*$"
_MARKS = r"[^0-9a-z\n]+"  # other scripts' letters part words like marks do


def canonical(text: Column) -> Column:
    """Canonical text; line ends stay, blanks around them do not."""
    out = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), _COPYRIGHT, "")
    out = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(out, r"\r\n?", "\n"), _MARKS, " "), F.lit(" "))
    out = F.replace(out, F.lit("\n"), F.lit(" \n "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return out


def _whole(canon: Column) -> Column:
    return F.trim(F.regexp_replace(canon, r"\s+", " "))


def _known(spark: SparkSession) -> tuple[DataFrame, dict[str, str]]:
    """(digest, license) of the licence texts as a table, and of the notices as a mapping."""
    rows = [(k, True, t) for k, t in LICENSES.items()] + [(k, False, t) for k, ts in NOTICES.items() for t in ts]
    table = spark.createDataFrame(rows, "license string, whole boolean, text string")
    table = table.select("license", "whole", F.sha2(_whole(canonical(F.col("text"))), 256).alias("digest"))
    notices = {r.digest: r.license for r in table.where("not whole").collect()}
    return table.where("whole").select("digest", "license"), notices


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest of the canonical text, license (of the whole text, else null), notices (sorted ids found in lines, comma-joined), licensed."""
    texts, notices = _known(docs.sparkSession)
    of = F.create_map(*[F.lit(x) for pair in notices.items() for x in pair])
    lines = F.filter(F.transform(F.split("_canon", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    found = F.array_sort(F.array_distinct(F.filter(F.transform(lines, lambda x: F.try_element_at(of, F.sha2(x, 256))), lambda x: x.isNotNull())))
    made = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.explode(F.array(canonical(F.col(f"`{text}`")))).alias("_canon"))
    made = made.select("doc_id", F.sha2(_whole(F.col("_canon")), 256).alias("digest"), F.array_join(found, ",").alias("notices"))
    return (made.join(F.broadcast(texts), "digest", "left")  # a handful of fixed rows
            .select("doc_id", "digest", "license", "notices", (F.col("license").isNotNull() | (F.col("notices") != "")).alias("licensed")))


def _sql_canon(c: str) -> str:
    lower = f"translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"regexp_replace({lower}, '{_COPYRIGHT}', '', 'g')"
    out = f"replace(' ' || regexp_replace(regexp_replace({out}, '\\r\\n?', chr(10), 'g'), '{_MARKS}', ' ', 'g') || ' ', chr(10), ' ' || chr(10) || ' ')"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return out


def _sql_rows(pairs) -> str:
    return ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in pairs)


_SQL = f"""
WITH known AS (SELECT license, sha256(trim(regexp_replace({_sql_canon('t')}, '\\s+', ' ', 'g'))) AS digest FROM (VALUES {_sql_rows(LICENSES.items())}) v(license, t)),
notice AS (SELECT license, sha256(trim(regexp_replace({_sql_canon('t')}, '\\s+', ' ', 'g'))) AS digest FROM (VALUES {_sql_rows((k, t) for k, ts in NOTICES.items() for t in ts)}) v(license, t)),
c AS (SELECT doc_id, {_sql_canon('text')} AS canon FROM documents),
l AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT doc_id, trim(unnest(string_split(canon, chr(10)))) AS line FROM c) JOIN notice ON sha256(line) = digest WHERE line <> '' GROUP BY 1)
SELECT doc_id, sha256(trim(regexp_replace(canon, '\\s+', ' ', 'g'))) AS digest, license, coalesce(notices, '') AS notices, license IS NOT NULL OR notices IS NOT NULL AS licensed
FROM c LEFT JOIN l USING (doc_id) LEFT JOIN known ON known.digest = sha256(trim(regexp_replace(canon, '\\s+', ' ', 'g')))"""


@query("op5_license_scan", _SQL)
def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan(read(spark, folder, "documents"))
