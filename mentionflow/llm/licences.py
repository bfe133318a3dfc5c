"""Licence scans by canonical digests.

A text is normalised (case, punctuation, copyright lines, equivalent spellings, white space) and hashed; entire texts
are hash-joined to the digests of known licences. Each line of a text is looked up the same way, as an entire text of
its own, among the known licence notices. The known texts are those below, or any other table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Known digests are sent to every executor up to this number, and lines are chosen by the notices' words up to this number of notices; beyond, digests are joined by a shuffle, each in SALTS copies.
KNOWN_AT_HAND, WORDS_AT_HAND, SALTS = 100_000, 200, 16

# The wording of public licences and of the notices that name them.
MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License

Copyright <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = ISC.replace("ISC License", "BSD Zero Clause License").replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
BSD_2 = """BSD 2-Clause License

Copyright (c) <year>, <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_3 = BSD_2.replace("2-Clause", "3-Clause").replace(
    "\n\nTHIS SOFTWARE",
    "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE",
)
ZLIB = """zlib License

Copyright (c) <year> <owner>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
MIT_0 = MIT.replace("MIT License", "MIT No Attribution").replace(", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ".")
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
KNOWN = [
    ("Unlicense", "licence", UNLICENSE), ("MIT-0", "licence", MIT_0), ("BSL-1.0", "licence", BOOST),
    ("MIT", "licence", MIT), ("ISC", "licence", ISC), ("0BSD", "licence", ZERO_BSD), ("BSD-2-Clause", "licence", BSD_2), ("BSD-3-Clause", "licence", BSD_3), ("Zlib", "licence", ZLIB),
    ("MIT", "notice", "Released under the MIT License."), ("MIT", "notice", "Licensed under the MIT License."), ("MIT", "notice", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "notice", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "notice", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
]
#: Spellings that licence matching guidelines count as equal, as whole words, after lower-casing.
EQUAL = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("favour", "favor"), ("merchantibility", "merchantability"), ("noninfringement", "non infringement"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners")]
COPYRIGHT = r"(^|\n)[^\p{L}\p{N}\n]*(copyright|©|\(c\))[ \t]+(\(c\)|©|[0-9<])[^\n]*"


def canonical(text: Column) -> Column:
    """Lower case without copyright lines; equivalent spellings as one; words, numbers and © apart by single spaces."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT, "$1")
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for a, b in EQUAL:
        out = F.regexp_replace(out, f" {a} ", f" {b} ") if a != b else out
    return F.trim(F.regexp_replace(out, " +", " "))


def folder(spark: SparkSession, path: str) -> DataFrame:
    """licence (a file's name), kind, text: known texts from files, such as a system's folder of common licences."""
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    return spark.read.text(path, wholetext=True).select(name.alias("licence"), F.lit("licence").alias("kind"), F.col("value").alias("text"))


def known(spark: SparkSession, texts: list[tuple[str, str, str]] | DataFrame = KNOWN) -> DataFrame:
    """digest, kind, licence, canon: one row per digest and kind; of two licences with one digest the first in alphabetical order. Texts without a word are left out."""
    rows = texts if isinstance(texts, DataFrame) else spark.createDataFrame(texts, "licence string, kind string, text string")
    made = rows.withColumn("canon", canonical(F.col("text"))).filter("canon <> ''")
    return made.groupBy(F.sha2("canon", 256).alias("digest"), "kind").agg(F.min("licence").alias("licence"), F.min("canon").alias("canon"))


def likely(line: Column, notices: list[str]) -> Column:
    """Whether a line may be one of the canonical notices: it holds each one's longest word that no other spelling turns into, or any such spelling."""
    made = {w for _, b in EQUAL for w in b.split()}
    own = [[w for w in n.split() if w not in made] for n in notices]
    words = {max(x, key=len) for x in own if x}
    if not all(own):
        words |= made | {w for a, _ in EQUAL for w in a.split()}
    return F.lower(line).rlike("|".join(sorted(map(re.escape, words)))) if words else F.lit(False)


def _looked_up(df: DataFrame, digests: DataFrame, n: int) -> DataFrame:
    """df with the licence of each row's digest, null if it's unknown; no task gets all rows of one digest."""
    if n <= KNOWN_AT_HAND:
        return df.join(F.broadcast(digests), "digest", "left")
    salted = df.withColumn("_salt", F.floor(F.rand(1) * SALTS).cast("int"))
    return salted.join(digests.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["digest", "_salt"], "left").drop("_salt")


def scan(df: DataFrame, text: str = "text", texts: list[tuple[str, str, str]] | DataFrame = KNOWN, columns: list[str] | None = None) -> DataFrame:
    """columns (all, if None) of df with digest, licence and notices; columns of these three names are replaced.

    digest: of the canonical text, null for a null text. licence: the known licence that the whole text is, else null; a
    text with no word matches none. notices: the licences that lines of the text name, distinct and sorted, an empty array if
    none. Rows keep their number, repeated ones too; an empty table gives an empty result. The rows are written once with digests and the lines that may be notices.
    """
    spark = df.sparkSession
    table = materialize(known(spark, texts))
    sizes = {r["kind"]: r["count"] for r in table.groupBy("kind").count().collect()}
    some = [r["canon"] for r in table.filter("kind = 'notice'").select("canon").limit(WORDS_AT_HAND + 1).collect()]
    kept = [c for c in (columns or df.columns) if c.lower() not in ("digest", "licence", "notices")]
    near = likely if sizes.get("notice", 0) <= WORDS_AT_HAND else lambda line, _: F.lit(True)
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: near(x, some)) if some else F.array().cast("array<string>")
    own = F.struct(*kept) if kept else F.struct(F.lit(1).alias("_none"))
    read = materialize(df.select(own.alias("own"), F.sha2(canonical(F.col(text)), 256).alias("digest"), lines.alias("lines"), F.monotonically_increasing_id().alias("row")))
    side = lambda kind: table.filter(F.col("kind") == kind).select("digest", "licence")
    whole = _looked_up(read.select("own", "digest", "row"), side("licence"), sizes.get("licence", 0))
    each = read.filter("size(lines) > 0").select("row", F.explode("lines").alias("line")).select("row", F.sha2(canonical(F.col("line")), 256).alias("digest"))
    named = _looked_up(each, side("notice"), sizes.get("notice", 0)).filter("licence is not null").groupBy("row").agg(F.sort_array(F.collect_set("licence")).alias("notices"))
    found = whole.join(named, "row", "left")
    return found.select(*(F.col("own")[c].alias(c) for c in kept), "digest", "licence", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))


def op4(documents: DataFrame) -> DataFrame:
    """doc_id, the canonical digest, the licence that the whole text is, and the licences its lines name: a row for each document."""
    return scan(documents.select("doc_id", "text"), columns=["doc_id"]).select("doc_id", "digest", "licence", F.array_join("notices", ",").alias("notices"))


def op4_sql(texts=KNOWN) -> str:
    """DuckDB SQL for op4."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def canon(x: str) -> str:
        out = f"regexp_replace(lower({x}), {quoted(COPYRIGHT)}, '\\1', 'g')"
        out = f"' ' || regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
        for a, b in EQUAL:
            out = f"regexp_replace({out}, ' {a} ', ' {b} ', 'g')"
        return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"

    values = ", ".join(f"({quoted(a)}, {quoted(b)}, {quoted(c)})" for a, b, c in texts)
    return f"""
WITH raw(licence, kind, text) AS (VALUES {values}),
known AS (SELECT sha256({canon('text')}) digest, kind, min(licence) licence FROM raw GROUP BY 1, 2),
docs AS (SELECT row_number() OVER () r, doc_id, text, sha256({canon('text')}) digest FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) line FROM docs),
named AS (SELECT r, string_agg(licence, ',' ORDER BY licence) notices
          FROM (SELECT DISTINCT r, licence FROM (SELECT r, sha256({canon('line')}) digest FROM lines) JOIN known USING (digest) WHERE kind = 'notice') GROUP BY r)
SELECT doc_id, docs.digest, known.licence, coalesce(notices, '') notices
FROM docs LEFT JOIN known ON known.digest = docs.digest AND kind = 'licence' LEFT JOIN named USING (r)"""
