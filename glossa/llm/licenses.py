"""Operator 2: licence scan by canonical digest look-up, native DataFrame expressions only.

A text's canonical form is lower case, without copyright notices, with every run of characters other than letters and
digits as one space, and with equivalent spellings unified (``EQUIVALENT``). A notice is a line that begins with the
sign, or with "copyright" or "(c)" before the sign, a year, a placeholder or a name, or a line's leading "all rights
reserved". A line that begins so because the licence's own words are wrapped there ("copyright holders be liable",
"copyright notice", list item "(c) you must") stays, so a digest does not depend on the wrapping. The SHA-256 digest of the canonical form of an entire text is hash-joined
to the digests of known licence texts; the same is done for every line of a document, and for every block of several
lines between blank ones, taken as a text of its own, so notices are found in longer documents. A known text that blank
lines cut into several blocks is found only as an entire document.

The SQL twin (``oracle_sql``) still deletes every line that begins with one of these words (``COPYRIGHT_LINE``); the two
agree on texts whose only such lines are whole notices.

Scale: canonical forms and digests are JVM expressions in the scan; the known digests are a small given table (its size
is checked before it is broadcast; a larger one is joined by shuffle); only lines that are a known text leave the
scan, with doc_id. A document's text is never shuffled.

Defined cases: null and empty texts, and texts of copyright lines only, have an empty canonical form, whose digest is
given but matches nothing; a known text with an empty canonical form is ignored; of known texts with equal forms the
smallest license_id counts; rows that repeat a doc_id are reported each, with the line findings of all rows of that id; a
null doc_id has no line findings; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 20_000

# The rule of the SQL twin.
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
# Words after "copyright" or "(c)" that go on with a licence's sentence; any other word there is a name.
AFTER_COPYRIGHT = (
    r"(?:holders?|owners?|notices?|laws?|licen[sc]e[sd]?|licen[sc]ing|statements?|interests?|permissions?|protections?|rights?"
    r"|infringements?|claims?|treat(?:y|ies)|conditions?|doctrines?|lines?|disclaimers?|legislation|materials?|works?"
    r"|the[ \t]+(?:software|program|library|works?|code|author|holder|owner)|and|or|in|is|are|on|of|to|for|as|at|it|that|this"
    r"|which|with|under|from|has|have|may|shall|will|does|applies|resulting|status|information|year)\b")
AFTER_C = (
    r"(?:you|your|we|the|any|all|an?|if|to|in|on|of|that|this|these|those|each|every|such|for|from|where|when|whether|with"
    r"|without|by|at|as|no|not|or|and|under|upon|it|its|is|are|be|must|may|shall|will|use|using|include|includes|ensure"
    r"|other|one|either|both)\b")
COPYRIGHT_NOTICE = (
    r"(?m)^[ \t]*(?:©[^\n]*"
    r"|(?:copyright|\(c\))[ \t:,]*(?:\(c\)|©|&copy;|copyright[ \t]+\d|[\[<{]|\d{4}\b)[^\n]*"
    r"|copyright[ \t:]+(?!" + AFTER_COPYRIGHT + r")\p{L}[^\n]*"
    r"|\(c\)[ \t]+(?!" + AFTER_C + r")\p{L}[^\n]*"
    r"|all rights reserved(?:[ \t]+(?:by|to)\b[^\n]*|[ \t.!]*))")
NOT_WORD = r"[^\p{L}\p{N}]+"
# Equivalent spellings, applied in this order to the spaced lower-case form.
EQUIVALENT = (
    ("licenc", "licens"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"), ("organis", "organiz"), ("favour", "favor"), ("judgement", "judgment"),
    ("copyright owner", "copyright holder"), ("merchantibility", "merchantability"), ("http ", "https "),
)

# Licence texts and notices by SPDX identifier.
MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""

KNOWN = (
    ("MIT", MIT), ("ISC", ISC), ("0BSD", ZERO_BSD), ("BSD-2-Clause", BSD_2), ("Apache-2.0", APACHE_NOTICE),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
)

BSD_3 = BSD_2.replace("""

THIS SOFTWARE""", """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.

THIS SOFTWARE""")

UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as
a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and
the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of
the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by
a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT
HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

# Texts that are known with each of these headings and without one (the SQL twin knows ``KNOWN`` only).
HEADED = (
    ("MIT", MIT.split("\n\n", 1)[1], ("MIT License", "The MIT License", "The MIT License (MIT)")),
    ("ISC", ISC.split("\n\n", 1)[1], ("ISC License", "The ISC License")),
    ("0BSD", ZERO_BSD, ("BSD Zero Clause License", "Zero-Clause BSD")),
    ("BSD-2-Clause", BSD_2, ("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License")),
    ("BSD-3-Clause", BSD_3, ("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License")),
    ("Unlicense", UNLICENSE, ("The Unlicense",)),
    ("Unlicense", UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>", ("The Unlicense",)), ("Zlib", ZLIB, ("zlib License", "The zlib License")),
    ("BSL-1.0", BSL, ("Boost Software License - Version 1.0 - August 17th, 2003",)),
)
# Long texts, files of ``license_texts``.
FILES = ("Apache-2.0", "CC0-1.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0")
TERMS_END = "END OF TERMS AND CONDITIONS"


def more_texts() -> list[tuple[str, str]]:
    """(license_id, text): ``HEADED`` with and without heading; ``FILES`` also without heading, and without what follows
    the end of the terms."""
    out = [(i, f"{head}\n\n{text}") for i, text, heads in HEADED for head in ("", *heads)]
    for i in FILES:
        text = resources.files(__package__).joinpath("license_texts", f"{i}.txt").read_text("utf-8").strip()
        for form in (text, re.split(r"\n[ \t]*\n", text, maxsplit=1)[1]):
            terms, end, _ = form.partition(TERMS_END)
            out += [(i, form)] + ([(i, terms + end), (i, terms)] if end else [])
    return out


def canonical(text: Column) -> Column:
    """Canonical form of an entire text (null: empty)."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_NOTICE, "")
    t = F.trim(F.regexp_replace(t, NOT_WORD, " "))
    for a, b in EQUIVALENT:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def _digest(text: Column) -> Column:
    # never null, and said so: the join then adds no null filter that computes the form a second time
    return F.coalesce(F.sha2(canonical(text), 256), F.lit(""))


def known_digests(texts: DataFrame) -> DataFrame:
    """(digest, license_id) of known texts (license_id, text)."""
    form = texts.select("license_id", canonical(F.col("text")).alias("form")).filter("form <> ''")
    return form.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def builtin_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*KNOWN, *more_texts()], "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Per document: digest of its canonical text, the licence it entirely is (or null), and the number and sorted,
    comma-joined identifiers of its lines, and blocks of two or more lines with words, that are known licence texts."""
    small = known.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    side = F.broadcast(known) if small else known
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(F.col("text")).alias("digest"))
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.split("text", "\n")).alias("line")) \
        .filter(F.col("doc_id").isNotNull()).select("doc_id", _digest(F.col("line")).alias("digest"))
    worded = F.filter(F.split(F.regexp_replace(F.lower("block"), COPYRIGHT_NOTICE, ""), "\n"), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    blocks = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.explode(F.split("text", r"\n[ \t\r]*(?=\n)")).alias("block")) \
        .filter(F.col("doc_id").isNotNull() & F.trim(F.col("block"), F.lit("\n")).contains("\n") & (F.size(worded) > 1)) \
        .select("doc_id", _digest(F.col("block")).alias("digest"))
    per_id = lines.unionAll(blocks).join(side, "digest").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("ids"))
    return whole.join(side, "digest", "left").join(per_id, "doc_id", "left").select(
        "doc_id", "digest", "license_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines"),
        F.coalesce("ids", F.lit("")).alias("line_licenses"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_canonical(col: str) -> str:
    t = f"regexp_replace(lower(coalesce({col}, '')), {_sql_text(COPYRIGHT_LINE)}, '', 'g')"
    t = f"trim(regexp_replace({t}, {_sql_text(NOT_WORD)}, ' ', 'g'))"
    for a, b in EQUIVALENT:
        t = f"replace({t}, {_sql_text(a)}, {_sql_text(b)})"
    return t


def oracle_sql() -> str:
    """The scan over ``documents`` in SQL."""
    values = ", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in KNOWN)
    return f"""
WITH known AS (
  SELECT sha256(form) AS digest, min(license_id) AS license_id
  FROM (SELECT license_id, {_sql_canonical('txt')} AS form FROM (VALUES {values}) v(license_id, txt))
  WHERE form <> '' GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id IS NOT NULL),
hits AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids
  FROM (SELECT doc_id, sha256({_sql_canonical('line')}) AS digest FROM lines) JOIN known USING (digest) GROUP BY 1)
SELECT d.doc_id, d.digest, k.license_id, coalesce(h.n, 0) AS n_license_lines, coalesce(h.ids, '') AS line_licenses
FROM (SELECT doc_id, sha256({_sql_canonical('text')}) AS digest FROM documents) d
LEFT JOIN known k USING (digest) LEFT JOIN hits h ON h.doc_id = d.doc_id"""
