"""Licence scan by canonical digest: whole texts, and notices of one line.

A text is put into a canonical form (case, punctuation, copyright lines, line breaks
and equivalent spellings do not matter), and its SHA-256 is hash-joined to the
digests of known licence texts in the same form. Every line is compared with known
one-line notices likewise. Everything is a column expression.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import local_rows

# Spellings that mean the same, each with the one that is kept. They are
# replaced in canonical text, where words stand one blank apart without punctuation.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
    ("http ", "https "),
)
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright|\(c\)|©)[^\n]*(?:[0-9]{4}|\(c\)|©|year)[^\n]*$"
RIGHTS_LINE = r"(?m)^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
OTHER = r"[^\p{L}\p{N}]+"
#: What is no word, but for line breaks.
OTHER_IN_LINE = r"[^\p{L}\p{N}\r\n]+"
#: Further public licence texts, a file each, named by SPDX identifier.
FOLDER = Path(__file__).parent / "license_texts"

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_MIT_TERMS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

# Public licence texts, by SPDX identifier.
TEXTS = {
    "MIT": f"MIT License\n\n{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_TERMS}",
    "MIT-bare": f"{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_TERMS}",
    "MIT-0": f"MIT No Attribution\n\n{_MIT_GRANT}.\n\n{_MIT_TERMS}",
    "BSD-2-Clause": f"{_BSD_HEAD}\n\n{_BSD_TAIL}",
    "BSD-3-Clause": f"{_BSD_HEAD}\n\n{_BSD_NAME}\n\n{_BSD_TAIL}",
    "ISC": f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_TAIL}",
    "0BSD": f"{_ISC_GRANT}.\n\n{_ISC_TAIL}",
    "Apache-2.0-notice": _APACHE_NOTICE,
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004

Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>""",
}
# Notices of one line, by SPDX identifier.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
)


def texts() -> dict[str, str]:
    """All known licence texts by name, those in files included; read on the driver."""
    return TEXTS | {p.stem: p.read_text(encoding="utf-8") for p in sorted(FOLDER.glob("*.txt"))}


def _without_marks(text: Column) -> Column:
    out = F.lower(text)
    for pattern in (COPYRIGHT_LINE, RIGHTS_LINE):
        out = F.regexp_replace(out, pattern, "")
    return F.replace(out, F.lit("&"), F.lit(" and "))


def _spelled(text: Column) -> Column:
    for spelling, kept in SPELLINGS:
        text = F.replace(text, F.lit(spelling), F.lit(kept))
    return text


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, words joined by one blank, one spelling."""
    return F.trim(_spelled(F.regexp_replace(_without_marks(text), OTHER, " ")))


def canonical_lines(text: Column) -> Column:
    """``canonical`` of every line of a text, all at once; null of null."""
    spelled = _spelled(F.regexp_replace(_without_marks(text), OTHER_IN_LINE, " "))
    return F.transform(F.split(spelled, r"[\r\n]+"), lambda x: F.trim(x))


def known(spark: SparkSession, given: dict[str, str] | None = None) -> DataFrame:
    """(digest, license) of known texts; a digest that two share goes to the first name."""
    rows = local_rows(spark, [{"license": k, "text": t} for k, t in (given or texts()).items()], "license string, text string")
    return rows.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, licenses: DataFrame | None = None, notices: tuple[tuple[str, str], ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, license, notices) for every row.

    ``digest`` is that of the canonical whole text, ``license`` the known text it
    equals or null. ``notices`` names, sorted and once each, the licences of lines
    that equal a known notice in canonical form, however long or padded a line is. A
    null text has a null digest and no notices; an empty one has the digest of the
    empty string and matches no licence unless one is empty. Repeated rows keep a row
    each. Of a table of ``licenses`` with several names for a digest, the first in
    order counts.
    """
    table = known(docs.sparkSession) if licenses is None else licenses.groupBy("digest").agg(F.min("license").alias("license"))
    flags = [F.when(F.array_contains("lines", canonical(F.lit(n))), F.lit(k)) for k, n in notices]
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    lines = F.coalesce(canonical_lines(F.col("text")), F.array().cast("array<string>"))
    found = chosen.select("id", F.sha2(canonical(F.col("text")), 256).alias("digest"), lines.alias("lines"))
    found = found.select("id", "digest", F.array_sort(F.array_distinct(F.array_compact(F.array(*flags)))).alias("notices"))
    return found.join(table.select("digest", "license"), "digest", "left").select("id", "digest", "license", "notices")


def _sql(text: str) -> str:
    out = f"lower({text})"
    for pattern in (COPYRIGHT_LINE, RIGHTS_LINE):
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    out = f"regexp_replace(replace({out}, '&', ' and '), '{OTHER}', ' ', 'g')"
    for spelling, kept in SPELLINGS:
        out = f"replace({out}, '{spelling}', '{kept}')"
    return f"trim({out})"


def oracle() -> str:
    """The scan of ``documents`` for DuckDB, notices joined by commas."""

    def rows(items: list[tuple[str, str]]) -> str:
        return ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in items)

    return f"""
        WITH texts(license, body) AS (VALUES {rows(list(texts().items()))}),
        table_ AS (SELECT sha256({_sql("body")}) AS digest, min(license) AS license FROM texts GROUP BY 1),
        marks(license, body) AS (VALUES {rows(list(NOTICES))}),
        mark AS (SELECT DISTINCT license, {_sql("body")} AS line FROM marks),
        lines AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[\\r\\n]+')) AS line FROM documents),
        hits AS (SELECT DISTINCT doc_id, license FROM (SELECT doc_id, {_sql("line")} AS line FROM lines) JOIN mark USING (line)),
        noted AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices FROM hits GROUP BY 1),
        whole AS (SELECT doc_id, sha256({_sql("text")}) AS digest FROM documents)
        SELECT whole.doc_id, whole.digest, table_.license, coalesce(noted.notices, '') AS notices
        FROM whole LEFT JOIN table_ USING (digest) LEFT JOIN noted ON noted.doc_id = whole.doc_id
    """
