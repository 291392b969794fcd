"""Licence scans by canonical digest lookup, in DataFrame functions only.

A text is brought to a canonical form: letters A-Z in lower case, copyright lines and "all rights reserved" dropped,
equivalent spellings made one, everything but letters and digits turned into single spaces. The sha256 of that form is
hash-joined with the digests of known licences. A document is looked up whole, and by each of its lines for notices
of one line. Only texts with a word that every known licence has one of are brought to canonical form: a text that has
none once the phrases are gone that the form leaves out cannot equal one.

A null or empty text has no licence. Lines that repeat count once each; repeated rows each get the result. Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licences and one-line notices. Names are SPDX identifiers.
_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
KNOWN: list[tuple[str, str]] = [
    ("MIT", 'MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_WARRANTY}"),
    ("ISC", f"ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_WARRANTY}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD_START} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_START} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under the CC0 1.0 License."),
]
#: Every known text has one of these in lower case; checked by a test.
TRIGGER = "licen[cs]e|permi[st]|redistribut"
#: Spellings that count as the same, as patterns of the text in lower case.
SPELLINGS: list[tuple[str, str]] = [
    (r"\b(sub)?(licen)c(e|ed|es)\b", r"$1$2s$3"),
    (r"(organi|authori|recogni|reali|utili|initiali|customi|generali)s(e|ed|es|ing|ation)\b", r"$1z$2"),
    (r"\b(fav|behavi|lab|hon)our", r"$1or"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\bwhilst\b", "while"),
    (r"\bnon-infringement\b", "noninfringement"),
    (r"https?://", ""),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT = r"(^|\n)[ \t#*/;-]*(copyright|\(c\)|©)[^\n]*"


def _plain(text: Column) -> Column:
    """In lower case, without what may stand within a word and is left out of the canonical form."""
    return F.regexp_replace(F.regexp_replace(F.translate(text, UPPER, LOWER), r"all rights reserved", ""), r"https?://", "")


def canonical(text: Column) -> Column:
    out = F.translate(text, UPPER, LOWER)
    out = F.regexp_replace(out, COPYRIGHT, "$1")
    for pattern, new in [(r"all rights reserved", ""), *SPELLINGS]:
        out = F.regexp_replace(out, pattern, new)
    return F.trim(F.regexp_replace(out, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def canonical_sql(text: str) -> str:
    """The same in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"translate({text}, {quote(UPPER)}, {quote(LOWER)})"
    for pattern, new in [(COPYRIGHT, "$1"), (r"all rights reserved", ""), *SPELLINGS]:
        out = f"regexp_replace({out}, {quote(pattern)}, {quote(new.replace('$', chr(92)))}, 'g')"
    return f"trim(regexp_replace({out}, {quote(r'[\x00-\x2F\x3A-\x60\x7B-\x7F]+')}, ' ', 'g'), ' ')"


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, licenses (names, sorted, comma-joined), n_lines (lines that are a known notice), whole_text.

    `known` has license and text, and takes the place of KNOWN; every text and line is then looked up, whatever its words.
    """
    spark = docs.sparkSession
    own = known is None
    known = spark.createDataFrame(KNOWN, "license string, text string") if own else known.where("license is not null and text is not null")
    known = known.select("license", canonical(F.col("text")).alias("form")).where("form != ''").select("license", F.sha2("form", 256).alias("digest")).distinct()
    trigger = (lambda text: _plain(text).rlike(TRIGGER)) if own else lambda text: text.isNotNull()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    likely = rows.where(trigger(F.col("text")))
    # position -1 is the whole text
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("part"))), lambda x: trigger(x.part))
    parts = likely.select("doc_id", "text_hash", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.col("text").alias("part"))), lines)).alias("p"))
    parts = parts.select("doc_id", "text_hash", F.col("p.at").alias("at"), F.sha2(canonical(F.col("p.part")), 256).alias("digest"))
    hits = parts.join(F.broadcast(known) if own else known, "digest")  # KNOWN is a fixed table of a few rows
    found = hits.groupBy("doc_id", "text_hash").agg(
        F.concat_ws(",", F.sort_array(F.collect_set("license"))).alias("licenses"), F.countDistinct(F.when(F.col("at") >= 0, F.col("at"))).alias("n_lines"), F.max(F.col("at") == -1).alias("whole_text")
    )
    every = rows.select("doc_id", "text_hash").alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_hash") == F.col("f.text_hash"))
    return every.join(found.alias("f"), same, "left").select(
        "d.doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce("whole_text", F.lit(False)).alias("whole_text")
    )


def scan_sql() -> str:
    values = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in KNOWN)
    return f"""
WITH known AS (SELECT DISTINCT license, sha256({canonical_sql('known_text')}) AS digest FROM (VALUES {values}) AS k(license, known_text)),
parts AS (
  SELECT doc_id, -1 AS place, text AS part FROM documents
  UNION ALL
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS place, unnest(string_split(text, chr(10))) AS part FROM documents
),
hits AS (
  SELECT p.doc_id, p.place, k.license FROM (SELECT doc_id, place, sha256({canonical_sql('part')}) AS digest FROM parts WHERE part IS NOT NULL) p JOIN known k USING (digest)
),
found AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(DISTINCT place) FILTER (WHERE place >= 0) AS n_lines, bool_or(place = -1) AS whole_text FROM hits GROUP BY doc_id
)
SELECT d.doc_id, coalesce(licenses, '') AS licenses, coalesce(n_lines, 0) AS n_lines, coalesce(whole_text, false) AS whole_text
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id
"""
