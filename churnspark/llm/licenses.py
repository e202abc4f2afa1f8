"""Operator 3: licence scans by canonical digest lookup.

A text is brought to a canonical form: lower case, copyright lines and a title in front
dropped, equivalent spellings unified, punctuation dropped, white space collapsed.  Its digest
is joined to the digests of known licence texts and notices.  The whole text of a document is
looked up, and so are every line and every paragraph of several lines, since a notice is one
of the two; comment marks before its lines are punctuation and do not matter.

Canonical forms are compared entire: a text that only contains a licence among other words
is no match for the whole-text lookup, while a notice on lines of its own is one for the
block lookup.  Null and empty texts, and texts of copyright lines and a title alone, have the digest of
the empty form and match nothing.  Two known texts with one canonical form count as one, the
first by name.  Repeated rows get equal results; an empty table gives no rows; very long texts are
processed whole; names of extra columns do not matter.  The table of
known digests has one row per known text, a fixed number, and is broadcast.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.llm._shared import col, table, text_or_empty

#: Known licence texts and notices (public licence wording).
KNOWN: dict[str, str] = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at""",
    "Apache-2.0-header-short": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.""",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
                      "If a copy of the MPL was not distributed with this file, You can obtain one at "
                      "http://mozilla.org/MPL/2.0/.",
    "MIT": """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE.""",
    "ISC": """ISC License

Copyright (c) <year> <copyright holders>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
3. This notice may not be removed or altered from any source distribution.""",
}

#: Equivalent spellings, (pattern over the lower-cased text, replacement).
SPELLINGS: list[tuple[str, str]] = [
    ("licence", "license"), ("sub[- ]licen[sc]", "sublicens"), ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"), ("non-?infringement", "noninfringement"),
    ("non-commercial", "noncommercial"), ("per cent", "percent"), ("https://", "http://"),
    ("merchantibility", "merchantability"), ("whilst", "while"), ("favour", "favor"), ("&", " and "),
]

#: A copyright line: comment marks, then "copyright", "(c)" or the sign, then a sign, a year, a
#: placeholder or "by"; or the reservation of rights.
COPYRIGHT_LINE = (r"(?m)^[\x20\t/*#;<!-]*(?:(?:copyright|\(c\)|©)[\x20\t]*(?:\(c\)|©|[0-9]{4}|by\b|<)"
                  r"|all rights reserved)[^\n]*$")

#: A title in front of a lower-cased text: the licence's name alone on the first line.
TITLE_LINE = (r"\A\s*[\x20\t/*#;<!-]*(?:the[\x20\t]+)?(?:mit|isc|zlib|bsd zero clause|zero-clause bsd|0bsd)"
              r"[\x20\t]+licen[sc]e(?:[\x20\t]*\([a-z0-9/\x20-]+\))?[\x20\t:.*/#=-]*(?:\r?\n|\z)")


#: Between paragraphs: lines that hold nothing but comment marks.
PARAGRAPH_GAP = r"(?:^|\n)[\x20\t\r/*#;-]*(?=\n)"
HINT = re.compile(r"licen[sc]|permission")


def canonical(text: Column) -> Column:
    c = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    c = F.regexp_replace(c, TITLE_LINE, "")
    for pattern, same in SPELLINGS:
        c = F.regexp_replace(c, pattern, same) if any(x in pattern for x in "[?") else F.replace(c, F.lit(pattern), F.lit(same))
    c = F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")
    return F.btrim(c)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(digest, license): one row per canonical form, a fixed number of rows."""
    rows = sorted((texts or KNOWN).items())
    df = spark.createDataFrame(rows, "license string, t string").coalesce(1)
    return (df.withColumn("canon", canonical(F.col("t"))).filter(F.col("canon") != "")
              .select(F.sha2("canon", 256).alias("digest"), "license")
              .groupBy("digest").agg(F.min("license").alias("license")))


def lookup(blocks: DataFrame, known: DataFrame, digest_col: str, name: str) -> DataFrame:
    """Hash-join a digest column to the known digests; no match gives null."""
    k = known.select(F.col("digest").alias("_known"), F.col("license").alias(name))
    return blocks.join(F.broadcast(k), F.col(digest_col) == F.col("_known"), "left").drop("_known")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         texts: dict[str, str] | None = None) -> DataFrame:
    """One row per input row: ``doc_id``, ``digest`` of the whole text, ``license`` it equals (or
    null) and ``notices``, the licences whose texts stand on lines of it, in order of the line,
    then those that fill a paragraph of several lines, in order of the paragraph.

    The block lookup is a map from digest to name held in the expression: it has as many
    entries as there are known texts, and blocks are never shuffled."""
    known = known_digests(docs.sparkSession, texts)
    base = docs.select(col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    names_of = [x for r in known.collect() for x in (r.digest, r.license)]
    paragraphs = F.filter(F.split("t", PARAGRAPH_GAP), lambda x: F.contains(x, F.lit("\n")))
    lines = F.concat(F.split("t", "\n"), paragraphs)
    if all(HINT.search(t.lower()) for t in (texts or KNOWN).values()):
        # every known text holds one of these words, so blocks without one need no digest
        lines = F.filter(lines, lambda x: F.lower(x).rlike(HINT.pattern))
    table_ = F.create_map(*map(F.lit, names_of)) if names_of else F.create_map().cast("map<string,string>")
    step = base.select("doc_id", digest(F.col("t")).alias("digest"), lines.alias("lines"))
    names = F.array_compact(F.transform("lines", lambda x: F.try_element_at(table_, digest(x))))
    found = lookup(step.withColumn("notices", names).drop("lines"), known, "digest", "license")
    return found.select("doc_id", "digest", "license", "notices")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "digest", "license", F.concat_ws(",", "notices").alias("notices"))
