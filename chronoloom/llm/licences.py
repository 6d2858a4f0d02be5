"""Licence scans by canonical digests, with DataFrame functions alone.

A text is brought to a canonical form (case, punctuation, white space,
copyright lines, comment marks, equivalent spellings) and digested; the digest
of the entire text is hash-joined to those of known licence texts. Licence
notices, which stand on a line of their own in documents, are looked up alike,
line by line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PERMISSION = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'

#: Known licence texts and notices, as published. (licence, text)
KNOWN = [
    ("MIT", f"MIT License\n\nCopyright (c) <year> <holders>\n\n{_PERMISSION}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_AS_IS}"),
    ("MIT", f"{_PERMISSION}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_AS_IS}"),
    ("MIT-0", f"MIT No Attribution\n\n{_PERMISSION}.\n\n{_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n{_BSD_TAIL}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_HEAD}\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n{_BSD_TAIL}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD_HEAD}3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n{_BSD_TAIL}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_TAIL}"),
    ("ISC", f"ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_TAIL}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC_TAIL}"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
]

#: Spellings that count as equal, after lower-casing. (pattern, replacement)
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
    ("https:", "http:"),
]
#: A line that holds nothing but a copyright claim (in lower case).
COPYRIGHT_LINE = "(?m)^[^a-z0-9\\n]*(copyright|\\(c\\)|©)[ \\t]+(\\(c\\)|©|<|[0-9]|by )[^\\n]*$"
ALL_RIGHTS = "(?m)^[^a-z0-9\\n]*all rights reserved[^a-z0-9\\n]*$"
#: What separates words: all but ASCII letters and digits and letters beyond ASCII.
SEPARATORS = "[\\x00-/:-@\\[-`{-\\x7f\\x{a0}\\x{a9}\\x{ab}\\x{ad}\\x{b7}\\x{bb}\\x{2010}-\\x{2026}\\x{3000}]+"


def canonical(text: Column, whole: bool = True) -> Column:
    """The canonical form of a text (``whole``: may hold copyright lines); null for null."""
    out = F.lower(text)
    if whole:
        out = F.regexp_replace(F.regexp_replace(out, F.lit(COPYRIGHT_LINE), F.lit("")), F.lit(ALL_RIGHTS), F.lit(""))
    out = reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), SPELLINGS, out)
    return F.trim(F.regexp_replace(out, F.lit(SEPARATORS), F.lit(" ")))


def known(spark: SparkSession) -> DataFrame:
    """licence, text: the texts in KNOWN."""
    return spark.createDataFrame(KNOWN, "licence string, text string")


def scan(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One row a document: doc_id, digest, licence of the entire text, licences of its lines.

    ``texts`` (licence, text) are the known licences, a list that a driver can
    hold; KNOWN unless given. ``digest`` is the SHA-256 of the canonical text.
    ``licence`` is null where the digest is unknown; ``notices`` lists, sorted and
    each once, the licences of the lines, of any length, that are known texts
    (empty if none). Null and empty texts have no licence (a null text's digest is
    null); of two known texts with one canonical form the first name counts; very
    long texts are scanned whole; repeated rows are scanned each; no rows give no
    rows; columns beyond doc_id and text are not read.
    """
    texts = known(docs.sparkSession) if texts is None else texts
    table = texts.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence"))
    names = sorted((r["digest"], r["licence"]) for r in table.collect())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digests = rows.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), F.split(F.col("text"), "\n").alias("lines"))
    whole = digests.join(F.broadcast(table), "digest", "left")
    # each line's digest is looked up in the same list
    lookup = F.create_map(*[F.lit(x) for pair in names or [("", "")] for x in pair])
    found = F.transform("lines", lambda x: F.element_at(lookup, F.sha2(canonical(x, whole=False), 256)))
    return whole.select("doc_id", "digest", "licence", F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))), ","), F.lit("")).alias("notices"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` against the known licences."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_canonical(text: str, whole: bool = True) -> str:
    out = f"lower({text})"
    if whole:
        out = f"regexp_replace(regexp_replace({out}, {_sql_text(COPYRIGHT_LINE)}, '', 'g'), {_sql_text(ALL_RIGHTS)}, '', 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, {_sql_text(a)}, {_sql_text(b)})"
    return f"trim(regexp_replace({out}, {_sql_text(SEPARATORS)}, ' ', 'g'))"


ORACLE = f"""
WITH known AS (
  SELECT sha256({_sql_canonical("t")}) AS digest, min(licence) AS licence
  FROM (VALUES {", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in KNOWN)}) AS k(licence, t)
  GROUP BY 1
), d AS (
  SELECT doc_id, sha256({_sql_canonical("text")}) AS digest, text FROM documents
), n AS (
  SELECT l.doc_id, string_agg(DISTINCT k.licence, ',' ORDER BY k.licence) AS notices
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) l
  JOIN known k ON k.digest = sha256({_sql_canonical("l.line", False)})
  GROUP BY l.doc_id
)
SELECT d.doc_id, d.digest, k.licence, coalesce(n.notices, '') AS notices
FROM d LEFT JOIN known k ON k.digest = d.digest LEFT JOIN n ON n.doc_id = d.doc_id
"""
