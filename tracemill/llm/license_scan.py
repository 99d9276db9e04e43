"""Licence texts by canonical digests, in DataFrame operations only.

A text is brought to one form (case, punctuation, white space, equivalent spellings, no copyright lines); the digest of the
whole text and of each of its lines is hash-joined to the digests of known licences and notices.  Short licences and notices
are listed as texts that go through the same expressions, long ones as digests of their canonical form.  Spellings of several
words are replaced after lines are joined, so a text may be wrapped at any column.  Lines that match nothing leave at the
join, so only matches are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import fresh, query, read, with_key

# Equivalent spellings, in the order they are replaced; those of several words in the canonical whole text.
SIGNS = [("©", " c "), ("&", " and ")]
SPELLINGS = [("licence", "license"), ("merchantibility", "merchantability"), ("favour", "favor"), ("organisation", "organization"), ("https:", "http:")]
PHRASES = [("sub license", "sublicense"), ("non commercial", "noncommercial"), ("copyright holder", "copyright owner")]
#: Canonical lines that state a holder or a year; but blank forms (``Copyright (C) <year>``) and a licence's own line are its text.
COPYRIGHT_LINE = "^((portions )?copyright (c )?(19|20)[0-9][0-9]|c (19|20)[0-9][0-9]|(portions )?copyright c |all rights reserved$)"
OWN_LINE = "^copyright c (year|yyyy|1989 1991 free|2007 free)( |$)"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD3 = _BSD2.replace("THIS SOFTWARE IS", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nTHIS SOFTWARE IS")
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
#: Names used in notices of one line.
_NAMES = {
    "MIT": ["MIT License"], "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"], "GPL-2.0": ["GNU General Public License, version 2"],
    "GPL-3.0": ["GNU General Public License, version 3"], "LGPL-3.0": ["GNU Lesser General Public License, version 3"], "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0"], "BSD-2-Clause": ["BSD 2-Clause License"], "BSD-3-Clause": ["BSD 3-Clause License"], "ISC": ["ISC License"],
    "CC-BY-4.0": ["CC BY 4.0"], "CC-BY-SA-4.0": ["CC BY-SA 4.0"], "CC-BY-NC-4.0": ["CC BY-NC 4.0"], "CC0-1.0": ["CC0 1.0"], "Unlicense": ["Unlicense"],
}
_FORMS = ["Licensed under the {}", "Licensed under {}", "Released under the {}", "Released under {}", "Distributed under the {}", "This work is licensed under the {}", "This work is licensed under {}", "{}"]


# SHA-256 of the canonical form of whole published texts, with and without the appendix on how to apply them and
# the line that ends their terms.
KNOWN_DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184"),
    ("Apache-2.0", "37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a"),
    ("Apache-2.0", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("GPL-2.0", "ae3b95b52f656d001aef1261789ff7235942239f226c063ecb26e091e7e4d750"),
    ("GPL-2.0", "ba7be4083315e3a427bd3b5f26c32477d0ef7e529f880fb1cfefb6c5c690f1a2"),
    ("GPL-2.0", "67c355c9fc1a00e29376bf3f7d4ad0671d4f962edb440383e534c3d648fc63a7"),
    ("GPL-3.0", "121175fa6ae915ec6427a332803f9f83d083473984feca609a8cf6910540b769"),
    ("GPL-3.0", "a18f80bd189faf4275400e8d55dcc4f18b67ad568dc0a7dc386c6654b9c4bac5"),
    ("GPL-3.0", "e30d7ee4c084116718756aaece5672bc9b5b28aa116326aed20bb38a69ebb59c"),
    ("LGPL-3.0", "ab1202917a49a52eb4671fc091c00933076c119053fff6e8b5849ca93d6b53b3"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("MPL-2.0", "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
]


def known_licenses() -> list[tuple[str, str]]:
    """Licence id and text: whole licences with and without their title, clauses numbered or not, and notices of one line."""
    whole = [("MIT", "MIT License", _MIT), ("ISC", "ISC License", _ISC), ("BSD-2-Clause", "BSD 2-Clause License", _BSD2), ("BSD-3-Clause", "BSD 3-Clause License", _BSD3)]
    out = [("Apache-2.0", _APACHE), ("Unlicense", _UNLICENSE)]
    for i, title, text in whole:
        plain = "\n".join(line.lstrip("123. ") for line in text.split("\n"))
        out += [(i, head + body) for body in dict.fromkeys((text, plain)) for head in ("", f"{title}\n", f"The {title}\n")]
    out += [(i, form.format(name)) for i, names in _NAMES.items() for name in names for form in _FORMS]
    return out + [(i, f"SPDX-License-Identifier: {i}") for i in _NAMES]


def canonical_lines(text: Column) -> Column:
    """Lines in canonical form, without blank and copyright lines."""
    t = F.lower(text)
    for old, new in SIGNS + SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " ")
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (x != "") & (~x.rlike(COPYRIGHT_LINE) | x.rlike(OWN_LINE)))


def canonical_text(lines: Column) -> Column:
    """Canonical lines as one text, the same however the lines were wrapped."""
    t = F.array_join(lines, " ")
    for old, new in PHRASES:
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def known_digests(spark: SparkSession, licenses: list[tuple[str, str]], digests: list[tuple[str, str]] = ()) -> DataFrame:
    """``license_id, digest``: one row per known text, a table bounded by the list."""

    def table(rows, name):
        return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(x).alias(name)) for i, x in rows])))

    rows = table(licenses, "text").select("license_id", _digest(canonical_text(canonical_lines(F.col("text")))).alias("digest"))
    rows = rows.unionByName(table(digests, "digest")) if digests else rows
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, licenses: list[tuple[str, str]] | None = None) -> DataFrame:
    """``doc_id, text_license, n_license_lines, licenses`` per row of ``docs``.

    ``text_license`` is the licence whose text the document is as a whole (null: none); ``licenses`` are all licences found as
    the whole text or as a line, sorted.  ``licenses`` as an argument (id, text) replaces the shipped list.  Null and empty
    texts match nothing; texts of copyright lines only match nothing; rows with repeated or null ids are documents of their
    own; repeated lines count each time; other columns are not read.
    """
    digests = KNOWN_DIGESTS if licenses is None else []
    known = F.broadcast(known_digests(docs.sparkSession, known_licenses() if licenses is None else licenses, digests))  # a list shipped with the code
    key = fresh(docs, "_row")
    rows, _ = with_key(docs.select("doc_id", "text"), key)
    lines = rows.select(key, canonical_lines(F.coalesce("text", F.lit(""))).alias("lines")).filter(F.size("lines") > 0)
    whole = F.array(F.struct(F.lit(True).alias("whole"), canonical_text(F.col("lines")).alias("t")))
    units = lines.select(key, F.explode(F.concat(whole, F.transform("lines", lambda x: F.struct(F.lit(False).alias("whole"), x.alias("t"))))).alias("u"))
    hits = units.select(key, "u.whole", _digest(F.col("u.t")).alias("digest")).join(known, "digest")
    per_doc = hits.groupBy(F.col(key).alias("id")).agg(
        F.min(F.when(F.col("whole"), F.col("license_id"))).alias("text_license"),
        F.count_if(~F.col("whole")).alias("n_license_lines"),
        F.array_sort(F.collect_set("license_id")).alias("licenses"),
    )
    found = rows.select(key, "doc_id").join(per_doc, F.col(key) == F.col("id"), "left")
    return found.select("doc_id", "text_license", F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"), F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"))


def _sql_lines(text: str) -> str:
    t = f"lower({text})"
    for old, new in SIGNS + SPELLINGS:
        t = f"replace({t}, '{old}', '{new}')"
    lines = f"list_transform(string_split(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), chr(10)), lambda x: trim(x))"
    return f"list_filter({lines}, lambda x: x <> '' AND (NOT regexp_matches(x, '{COPYRIGHT_LINE}') OR regexp_matches(x, '{OWN_LINE}')))"


def _sql_text(lines: str) -> str:
    t = f"array_to_string({lines}, ' ')"
    for old, new in PHRASES:
        t = f"replace({t}, '{old}', '{new}')"
    return t


def _sql() -> str:
    rows = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in known_licenses())
    ready = ", ".join(f"('{i}', '{d}')" for i, d in KNOWN_DIGESTS)
    return f"""
WITH k0 AS (SELECT license_id, sha256({_sql_text(_sql_lines('text'))}) AS digest FROM (VALUES {rows}) AS t(license_id, text)
 UNION ALL SELECT license_id, digest FROM (VALUES {ready}) AS t(license_id, digest)),
k AS (SELECT digest, min(license_id) AS license_id FROM k0 GROUP BY digest),
l AS (SELECT doc_id, {_sql_lines("coalesce(text, '')")} AS lines FROM documents),
u AS (SELECT doc_id, true AS whole, {_sql_text('lines')} AS t FROM l WHERE len(lines) > 0 UNION ALL SELECT doc_id, false, unnest(lines) FROM l),
h AS (SELECT doc_id, whole, license_id FROM u JOIN k ON sha256(t) = digest),
a AS (SELECT doc_id, min(CASE WHEN whole THEN license_id END) AS text_license, count(*) FILTER (WHERE NOT whole) AS n FROM h GROUP BY doc_id),
s AS (SELECT doc_id, string_agg(license_id, ',' ORDER BY license_id) AS licenses FROM (SELECT DISTINCT doc_id, license_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, text_license, CAST(coalesce(n, 0) AS BIGINT) AS n_license_lines, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id LEFT JOIN s ON d.doc_id = s.doc_id
"""


@query("op4_license_scan", _sql())
def op4(spark, sf_dir):
    return license_scan(read(spark, sf_dir, "documents")).withColumn("licenses", F.concat_ws(",", "licenses"))
