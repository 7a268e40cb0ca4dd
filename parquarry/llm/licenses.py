"""License scans by canonical digest lookup, on DataFrame functions only.

A text is brought to a canonical form (case, equivalent spellings, copyright lines, punctuation,
white space) and hashed; whole texts are hash-joined to the digests of known licences. The known
side holds one row a licence, so texts are never compared with one another.

Edge cases. Null text: digest null, licence null. A text with nothing left after normalising has
the digest of the empty string, which no licence may have. Empty tables, on either side: no match.
Several known licences of one digest: the smallest id wins. Columns with clashing names: the
three added columns replace columns of their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parquarry.llm._common import col, fresh

#: Equivalent spellings, applied in this order to lower-case text. Fixed values.
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("copyright holder", "copyright owner"),
    ("fulfil ", "fulfill "),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("judgement", "judgment"),
    ("while", "whilst"),
    ("per cent", "percent"),
    ("http:", "https:"),
]
_MARK = r"(?:copyright|\(c\)|©)"
_YEAR = r"(?:\d{4}|all rights reserved|<year>|\[year\])"
#: A line that only names who holds the copyright, after lowering case; lines end at a newline.
#: The first mark of a line is the only one tried (a later one could not match more), so that a
#: long line of marks takes time in proportion; ``d`` leaves other line ends to other characters.
#: "Copyright (c)" at a line's beginning needs no year.
_YEARLESS = r"copyright *(?:\(c\)|©)"
COPYRIGHT_LINE = rf"(?md)^(?:(?>[^a-z\n]*?{_MARK})[^\n]*{_YEAR}|[^a-z\n]*+{_YEARLESS})[^\n]*$"
#: The same without atomic groups and the flag, for engines that have neither.
COPYRIGHT_LINE_PLAIN = rf"(?m)^[^a-z\n]*(?:{_MARK}[^\n]*{_YEAR}|{_YEARLESS})[^\n]*$"
#: Above this many known licences the join is left to the planner instead of being broadcast.
BROADCAST_ROWS = 100_000

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_0BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_MIT0 = _MIT.split(", subject to the following conditions")[0] + ".\n\n" + _MIT.split("\n\n")[-1]
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""


def _headed(text: str, *names: str) -> list[str]:
    """A licence alone and under its usual headings."""
    return [text, *[f"{n}\n\n{text}" for n in names]]


#: Whole texts of licences with their usual headings, and the usual notices. Fixed values.
KNOWN = {
    "MIT": [*_headed(_MIT, "MIT License", "The MIT License", "The MIT License (MIT)"), "Released under the MIT License."],
    "MIT-0": _headed(_MIT0, "MIT No Attribution"),
    "BSD-2-Clause": _headed(_BSD_HEAD + _BSD_TAIL, "BSD 2-Clause License", "The 2-Clause BSD License"),
    "BSD-3-Clause": _headed(_BSD_HEAD + _BSD_THIRD + _BSD_TAIL, "BSD 3-Clause License", "The 3-Clause BSD License"),
    "0BSD": _headed(_0BSD, "BSD Zero Clause License", "Zero-Clause BSD"),
    "Unlicense": [_UNLICENSE, _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org/>"],
    "BSL-1.0": _headed(_BOOST, "Boost Software License - Version 1.0 - August 17th, 2003"),
    "ISC": _headed(_ISC, "ISC License", "The ISC License"),
    "Zlib": [_ZLIB, "zlib License\n\n" + _ZLIB],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", _APACHE_NOTICE],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
}


def canonical(text: Column) -> Column:
    """The canonical form; null for null."""
    out = F.lower(text)
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, COPYRIGHT_LINE, " ")
    # punctuation and space alike part words; letters of all scripts and digits stay
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_licenses(spark: SparkSession, known: dict[str, list[str]] | None = None) -> DataFrame:
    """``license_id, text`` of ``known`` (by default the built-in ones)."""
    rows = [(k, t) for k, texts in (KNOWN if known is None else known).items() for t in texts]
    one = [F.struct(F.lit(k).alias("license_id"), F.lit(t).alias("text")) for k, t in rows]
    return spark.range(1).select(F.inline(F.array(*one)))


def scan(docs: DataFrame, known: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``canonical_chars``, ``license_digest`` and ``license_id`` (null: none known)."""
    d, k, c = fresh(docs, "license_known_digest", "license_known_id", "license_canonical")
    table = known.where(F.length(canonical(F.col("text"))) > 0).select(digest(F.col("text")).alias(d), F.col("license_id").alias(k))
    table = table.groupBy(d).agg(F.min(k).alias(k))
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    keep = [x for x in docs.columns if x not in ("license_digest", "canonical_chars", "license_id")]
    out = docs.select(*[col(x) for x in keep], canonical(col(text_col)).alias(c))
    out = out.select(*[col(x) for x in keep], F.char_length(col(c)).cast("long").alias("canonical_chars"), F.sha2(col(c).cast("binary"), 256).alias("license_digest"))
    return out.join(table, F.col("license_digest") == F.col(d), "left").select(*[col(x) for x in keep], "canonical_chars", "license_digest", F.col(k).alias("license_id"))


def oracle() -> str:
    """DuckDB SQL for ``doc_id, canonical_chars, license_digest, license_id`` of all documents."""

    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def norm(c: str) -> str:
        out = f"lower({c})"
        for a, b in SPELLINGS:
            out = f"replace({out}, {q(a)}, {q(b)})"
        out = f"regexp_replace({out}, {q(COPYRIGHT_LINE_PLAIN)}, ' ', 'g')"
        return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

    rows = ", ".join(f"({q(k)}, {q(t)})" for k, texts in KNOWN.items() for t in texts)
    return f"""
WITH k AS (SELECT sha256({norm("t")}) AS d, min(i) AS license_id FROM (VALUES {rows}) AS v(i, t) GROUP BY ALL),
n AS (SELECT doc_id, {norm("text")} AS c FROM documents)
SELECT doc_id, length(c)::BIGINT AS canonical_chars, sha256(c) AS license_digest, license_id FROM n LEFT JOIN k ON sha256(c) = k.d
"""
