"""License scans by canonical digests.

A text is normalised - lower case, copyright lines dropped, equivalent spellings
made one, punctuation and white space made single spaces - and hashed; equal
digests are equal licences.  Three units of a document are looked up: the entire
text, each paragraph and each line, so that a notice inside a longer document is
found by the same join.  Digests are joined by hash with those of the known
licences; nothing compares texts pairwise.

Normalising keeps line ends; a paragraph's canonical form is its lines' forms
joined by a space, and so is the entire text's.  All of it is DataFrame
expressions, one pass over the text, and only digests reach the join.

Defined cases: results belong to rows, so rows with equal ids and other texts, and
null ids, have their own; texts of any length count whole; a null or empty text, or one of nothing but punctuation and
copyright lines, matches nothing (licence_id null, no notices); repeated rows
each give a row (their notices are counted once a row); an empty table gives an
empty one; known licences with equal canonical texts count as the one whose id
sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts and notices, by a short id.
_MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
_ISC_BODY = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
    "USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ZERO_BSD_BODY = _ISC_BODY.replace(
    " granted, provided that the above copyright notice and this permission notice appear in all copies.", " granted."
)
_BSD_2_BODY = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_3_CLAUSE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
KNOWN = [
    ("BSD-2-Clause", _BSD_2_BODY + _BSD_END),
    ("BSD-3-Clause", _BSD_2_BODY + _BSD_3_CLAUSE + _BSD_END),
    ("0BSD", _ZERO_BSD_BODY),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", _ISC_BODY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "MIT License\n" + _MIT_BODY),
    ("MIT", _MIT_BODY),
]
# Digests of the canonical forms of long public licences, as Debian's base-files has them in /usr/share/common-licenses.
KNOWN_DIGESTS = [
    ("Apache-2.0", "84d3349e651a19710ff5663d85fa8909a755f8fd41df0ba718da14a02975dda0"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "1cfb6cca26abe2169c9c61164807107b2d4a0b64955a2cf2de46fad3483acda1"),
    ("MPL-2.0", "8f0473f9c917c507827dca355168119bb065ca1a9dab0e366988bcdba5fa039b"),
]
# Spellings that count as the same, as (pattern, replacement) on lower-case text.
SPELLINGS = [
    (r"\blicence(s|d|e|es)?\b", r"license$1"),
    (r"\bsub[- ]licen[cs]e", "sublicense"),
    (r"\bnon[- ]?commercial\b", "noncommercial"),
    (r"\bnon[- ]infringement\b", "noninfringement"),
    (r"\bmerchantibility\b", "merchantability"),
    (r"\bcopyright (owner|holder)", "copyright holder"),
    (r"\bhttp://", "https://"),
    (r"\bper cent\b", "percent"),
]
#: Lines that state a copyright; they differ between copies of one licence.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*((\(c\)|©|copyright[ \t]+(\(c\)|©|[0-9]{4}|by\b))[^\n]*|all rights reserved[^a-z0-9\n]*)$"
#: What becomes one space; line ends stay.
BETWEEN = r"[\p{P}\p{S}\p{Z}\p{C}&&[^\n]]+"


def canonical(text: Column) -> Column:
    """The text in canonical form, line by line; lines without letters and digits are empty or a space."""
    x = F.lower(F.coalesce(text, F.lit("")))
    spelled = x
    for pattern, to in SPELLINGS:
        spelled = F.regexp_replace(spelled, pattern, to)
    # Most texts hold none of the words that have other spellings, and none about copyright.
    words = ("licen", "commercial", "infring", "merchant", "copyright", "http:", "per cent")
    some = F.lit(False)
    for w in words:
        some |= x.contains(w)
    stated = x.contains("copyright") | x.contains("all rights reserved") | x.contains("(c)") | x.contains("©")
    plain = F.when(some, spelled).otherwise(x)
    plain = F.when(stated, F.regexp_replace(plain, COPYRIGHT_LINE, "")).otherwise(plain)
    return F.regexp_replace(plain, BETWEEN, " ")


def _digests(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``_units``: array of (scope, at, digest) of the entire text, its paragraphs and its lines.

    A paragraph is a run of lines that aren't empty in canonical form; ``at``
    numbers the units of a scope from 0.
    """
    out = docs.select(*keep, canonical(F.col(text)).alias("_c"))
    c = F.col("_c")
    flat = lambda x: F.trim(F.regexp_replace(x, "[ \n]+", " "))

    def unit(scope: str, at: Column, x: Column) -> Column:
        return F.struct(F.lit(scope).alias("scope"), at.cast("int").alias("at"), F.when(x != "", F.sha2(x, 256)).alias("digest"))

    out = out.select(*keep, F.array(unit("text", F.lit(0), flat(c))).alias("_t"), F.transform(F.split(c, r"\n *(\n *)+"), flat).alias("_p"), F.transform(F.split(c, "\n"), lambda x: F.trim(x)).alias("_l"))
    paragraphs = F.transform(F.filter("_p", lambda x: x != ""), lambda x, i: unit("paragraph", i, x))
    single = F.transform("_l", lambda x, i: unit("line", i, x))
    return out.select(*keep, F.concat("_t", paragraphs, single).alias("_units"))


def known_digests(known: DataFrame) -> DataFrame:
    """licence_id, digest (unique) of licences given as (licence_id, text)."""
    found = _digests(known, "text", ["licence_id"]).select("licence_id", F.explode_outer("_units").alias("u")).where("u.scope = 'text' AND u.digest IS NOT NULL")
    return found.groupBy(F.col("u.digest").alias("digest")).agg(F.min("licence_id").alias("licence_id"))


def default_digests(spark: SparkSession) -> DataFrame:
    """licence_id, digest of the texts and digests above."""
    given = spark.createDataFrame(KNOWN_DIGESTS, "licence_id string, digest string").select("digest", "licence_id")
    both = known_digests(spark.createDataFrame(KNOWN, "licence_id string, text string")).unionByName(given)
    return both.groupBy("digest").agg(F.min("licence_id").alias("licence_id"))


def known_from(spark: SparkSession, folder: str) -> DataFrame:
    """Known licences from a folder with one whole text a file, named by its id (as in a list of public licences)."""
    files = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.select(F.regexp_extract("path", r"([^/]+?)(\.txt)?$", 1).alias("licence_id"), F.col("value").alias("text"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per matched unit: doc_id, scope (text, paragraph, line), at (its number within the scope), licence_id."""
    known = known_digests(known) if known is not None else default_digests(docs.sparkSession)
    # Not explode(): its implied filter on the array would have all of it computed twice.
    units = _digests(docs, text, [id_column]).select(id_column, F.explode_outer("_units").alias("u"))
    return units.where("u.digest IS NOT NULL").select(id_column, "u.*").join(known, "digest").select(id_column, "scope", "at", "licence_id")


def report(docs: DataFrame, known: DataFrame | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: licence_id of the entire text (or null), notices (licences found in it, sorted, comma-joined), n_notices (matched lines)."""
    key = F.struct(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.col(id_column).isNull().alias("none"), F.xxhash64(text).alias("hash"))
    keyed = docs.select(F.col(id_column).alias("_id"), key.alias("_key"), F.col(text).alias("_text"))
    hits = scan(keyed, known, "_key", "_text").distinct()
    by_doc = hits.groupBy("_key").agg(
        F.max(F.when(F.col("scope") == "text", F.col("licence_id"))).alias("licence_id"),
        F.array_join(F.array_sort(F.collect_set("licence_id")), ",").alias("notices"),
        F.count_if(F.col("scope") == "line").alias("n_notices"),
    )
    joined = keyed.select("_id", "_key").join(by_doc, "_key", "left")
    return joined.select(F.col("_id").alias(id_column), "licence_id", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document's entire text, and the notices in it."""
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in KNOWN)
    digests = ", ".join(f"({quote(i)}, {quote(d)})" for i, d in KNOWN_DIGESTS)
    spelled = "lower(t)"
    for pattern, to in SPELLINGS:
        spelled = f"regexp_replace({spelled}, {quote(pattern)}, {quote(to.replace('$1', chr(92) + '1'))}, 'g')"
    return f"""
WITH src AS (SELECT 'd' AS kind, doc_id::VARCHAR AS id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents
  UNION ALL SELECT 'k', licence_id, -row_number() OVER (), t FROM (VALUES {known}) v(licence_id, t)),
c0 AS (SELECT kind, id, r, regexp_replace(regexp_replace({spelled}, {quote(COPYRIGHT_LINE)}, '', 'g'), '([\\p{{P}}\\p{{S}}\\p{{Z}}]|[^\\P{{C}}\\n])+', ' ', 'g') AS c FROM src),
l0 AS (SELECT kind, id, r, string_split(c, chr(10)) AS ls FROM c0),
l3 AS (SELECT kind, id, r, unnest(range(len(ls))) AS i, trim(unnest(ls)) AS c FROM l0),
l4 AS (SELECT *, sum((c <> '' AND before = '')::INT) OVER (PARTITION BY r ORDER BY i) AS p FROM (SELECT *, coalesce(lag(c) OVER (PARTITION BY r ORDER BY i), '') AS before FROM l3)),
units AS (
  SELECT kind, id, r, 'line' AS scope, i AS pos, c FROM l3
  UNION ALL SELECT kind, id, r, 'paragraph', p, string_agg(c, ' ' ORDER BY i) FILTER (c <> '') FROM l4 WHERE p > 0 GROUP BY kind, id, r, p
  UNION ALL SELECT kind, id, r, 'text', 0, string_agg(c, ' ' ORDER BY i) FILTER (c <> '') FROM l3 GROUP BY kind, id, r),
known AS (SELECT d, min(id) AS licence_id FROM (SELECT sha256(c) AS d, id FROM units WHERE kind = 'k' AND scope = 'text' AND c <> '' UNION ALL SELECT d, id FROM (VALUES {digests}) w(id, d)) GROUP BY d),
hits AS (SELECT DISTINCT r, scope, pos, licence_id FROM units JOIN known ON sha256(c) = d WHERE kind = 'd'),
by_doc AS (SELECT r, max(licence_id) FILTER (scope = 'text') AS licence_id, array_to_string(list_sort(list_distinct(list(licence_id))), ',') AS notices, count(*) FILTER (scope = 'line') AS n_notices FROM hits GROUP BY r)
SELECT id::BIGINT AS doc_id, licence_id, coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices
FROM (SELECT r, id FROM src WHERE kind = 'd') LEFT JOIN by_doc USING (r)"""


ORACLE_SQL = _sql()
