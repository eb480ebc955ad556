"""License scans by canonical digest, in DataFrame and SQL functions only.

Entire texts (a document, and each line of it) are brought to a canonical form and their SHA-256 is hash-joined to the
digests of known licence texts. The known table has a fixed number of rows, so it is broadcast.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm.common import cut

# The wording of public licences and of the notices that name them.
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
    "3. This notice may not be removed or altered from any source distribution."
)
LICENSES: list[tuple[str, str]] = [
    ("0BSD", f"{_ISC_GRANT}.\n{_ISC_TAIL}"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_TAIL}"),
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("Zlib", _ZLIB),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
]
#: Spellings that licence matching holds for equal: left becomes right. Letters are lower case by then.
EQUIVALENT: list[tuple[str, str]] = [
    ("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("non-infringement", "noninfringement"),
    ("copyright owner", "copyright holder"), ("organisation", "organization"), ("favour", "favor"), ("wilful", "willful"), ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"), ("https:", "http:"), ("&", " and "),
]
#: A line that only tells who holds the copyright since when.
COPYRIGHT_LINE = r"(^|\n)[ \t*#/;-]*((copyright[ \t]*(\(c\)|©)?|\(c\)|©)[ \t]*[0-9<\[{]|copyright[ \t]*(\(c\)|©|by )|all rights reserved)[^\n]*"
NO_LETTER = r"[^\p{L}\p{N}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical_sql(text: str, every: str = "") -> str:
    """SQL for the canonical form; every: what regexp_replace needs to replace all matches (DuckDB: `, 'g'`)."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    x = f"translate({text}, '{_UPPER}', '{_LOWER}')"
    pattern = (lambda p: quoted(p)) if every else (lambda p: "r" + quoted(p))
    newline = "chr(10)"
    x = f"regexp_replace({x}, {pattern(COPYRIGHT_LINE)}, {newline}{every})"
    for a, b in EQUIVALENT:
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    return f"trim(regexp_replace({x}, {pattern(NO_LETTER)}, ' '{every}))"


#: Files of entire texts beside this module and the licences they are.
TEXTS: dict[str, str] = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0",
    "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
#: The notices by which works name these licences, as texts and as single lines.
NOTICES: list[tuple[str, str]] = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\n'
     'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
     'See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    *((name, f"{verb} under the {title}, version {version}.") for verb in ("Licensed", "This work is licensed", "Released") for name, title, version in (
        ("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"), ("LGPL-3.0", "GNU Lesser General Public License", "3"), ("MPL-2.0", "Mozilla Public License", "2.0"))),
]


def known_texts() -> list[tuple[str, str]]:
    """(license, text) of all that is known without a caller's table."""
    folder = Path(__file__).parent / "license_texts"
    return [*LICENSES, *NOTICES, *((name, (folder / file).read_text("utf-8")) for file, name in TEXTS.items())]


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, license): one row for each distinct digest. known: a table (license, text) in place of `known_texts`."""
    rows = spark.createDataFrame(known_texts(), "license string, text string") if known is None else known.select("license", "text")
    return rows.select(F.sha2(F.expr(canonical_sql("text")), 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, canonical_sha256, license, n_license_lines, line_licenses) for every row of docs.

    license: of the entire text, else null. n_license_lines: lines that are a licence or a notice as a whole;
    line_licenses: theirs, distinct, sorted, joined by commas, else ''. Null text: as empty. Repeated rows give repeated
    results, a null doc_id stays null, other columns are not looked at. known: a table
    (license, text) of the texts to look for in place of `known_texts`; it may be of any size, as only the fixed table is
    broadcast. Texts and lines of any length are read whole, an empty table gives no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    units = rows.select("row", "doc_id", F.expr("posexplode(concat(array(text), split(text, chr(10))))").alias("unit", "text"))
    units = units.select("row", "doc_id", "unit", F.sha2(F.expr(canonical_sql("text")), 256).alias("digest"))
    digests = known_digests(docs.sparkSession, known)
    # a caller's table is written, so that both sides of the join are plain exchanges and the digest of a very frequent line can be split
    hit = units.join(F.broadcast(digests) if known is None else cut(digests), "digest", "left")
    whole = F.col("unit") == 0
    line = ~whole & F.col("license").isNotNull()
    return (
        hit.groupBy("row", "doc_id")
        .agg(
            F.max(F.when(whole, F.col("digest"))).alias("canonical_sha256"),
            F.max(F.when(whole, F.col("license"))).alias("license"),
            F.count_if(line).alias("n_license_lines"),
            F.array_join(F.sort_array(F.collect_set(F.when(line, F.col("license")))), ",").alias("line_licenses"),
        )
        .drop("row")
    )


def oracle_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in LICENSES)
    canon = lambda x: canonical_sql(x, ", 'g'")
    return f"""
WITH known AS (SELECT digest, min(license) AS license FROM (SELECT license, sha256({canon("text")}) AS digest FROM (VALUES {known}) AS v(license, text)) GROUP BY digest),
whole AS (SELECT doc_id, sha256({canon("coalesce(text, '')")}) AS digest FROM documents),
lines AS (SELECT doc_id, sha256({canon("line")}) AS digest FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
hits AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names FROM lines JOIN known USING (digest) GROUP BY doc_id)
SELECT w.doc_id, w.digest AS canonical_sha256, k.license, coalesce(h.n, 0) AS n_license_lines, coalesce(h.names, '') AS line_licenses
FROM whole w LEFT JOIN known k ON k.digest = w.digest LEFT JOIN hits h ON h.doc_id = w.doc_id
"""
