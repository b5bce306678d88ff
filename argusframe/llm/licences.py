"""Licence scans: canonical digests of entire texts, and of single lines, joined with those of known licences."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, text_of

# Published licence texts and notices; copyright lines, case and punctuation do not count.
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n"
)
_BSD_TAIL = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
    "the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software.\n"
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies.\n"
)
_ISC_TAIL = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT + _AS_IS),
    ("MIT", "MIT License\n" + _MIT + _AS_IS),
    ("ISC", _ISC + _ISC_TAIL),
    ("ISC", "ISC License\n" + _ISC + _ISC_TAIL),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_TAIL),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
     "products derived from this software without specific prior written permission.\n" + _BSD_TAIL),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
]
#: Published texts in licence_texts, and titles above the short ones.
TEXTS = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0",
    "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License"],
}
#: Where some copies of a published text begin or end.
_FIRST, _LAST = "CC0 1.0 Universal", "END OF TERMS AND CONDITIONS"
#: Spellings of one word, as patterns of whole lower-case words, and the one that stands for them.
SPELLINGS: list[tuple[str, str]] = [
    (r"\b(sub)?licenc(e[sd]?|ing)\b", r"{1}licens{2}"),
    (r"\b(organ|author|recogn|util|real|custom|minim|maxim)is(e[sd]?|ing|ations?)\b", r"{1}iz{2}"),
    (r"\b(fav|behavi|col|hon|lab)our(s|ed|able)?\b", r"{1}or{2}"),
    (r"\b(acknowledg|judg)ement", r"{1}ment"),
    (r"\bcopyright owner(s?)\b", r"copyright holder{1}"),
    (r"\bwhilst\b", "while"),
]
#: A line that only says whose copyright it is and of when.
COPYRIGHT_LINE = r"(?m)^[ \t*#/;!-]*(?:copyright\b|\(c\)|©)[ \t]*(?:\(c\)|©|[0-9<\[]|by\b)[^\n]*$"

#: A line after one of those that only reserves all rights.
RESERVED_LINE = COPYRIGHT_LINE.replace("(?m)^", "(?m)^(", 1).removesuffix("$") + r"\n)[ \t*#/;!-]*all rights reserved\.?[ \t\r]*$"


def bodies() -> list[tuple[str, str]]:
    """Licences with their entire texts: the published ones, and the short ones under each title."""
    folder = Path(__file__).parent / "licence_texts"
    texts = [(licence, (folder / name).read_text("utf-8", "replace")) for name, licence in TEXTS.items()]
    short = [(n, t) for n, t in [*KNOWN, *texts] if n in TITLES and len(t) > 500 and not t.startswith(tuple(TITLES[n]))]
    cut = [(n, t[: t.index(_LAST)] + _LAST) for n, t in texts if _LAST in t] + [(n, t[t.index(_FIRST) :]) for n, t in texts if _FIRST in t]
    found = texts + cut + [(n, f"{title}\n{t}") for n, t in short for title in TITLES[n]]
    # some reserve all rights themselves; a copy may say so elsewhere
    return found + [(n, bare) for n, t in found if (bare := re.sub(RESERVED_LINE, r"\1", t.lower())) != t.lower()]


def _steps() -> list[tuple[str, str]]:
    """Patterns and replacements, in order, on the lower-case text; each line keeps its place."""
    return [(COPYRIGHT_LINE, " "), (r"[^\p{L}\p{N}\n]+", " "), *SPELLINGS, (r"(?m)^ +| +$", "")]


def canonical(text: Column) -> Column:
    """Lower case, without punctuation and copyright lines, one spelling of each word; lines are kept."""
    out = F.lower(text)
    for pattern, to in _steps():
        out = F.regexp_replace(out, pattern, to.replace("{1}", "$1").replace("{2}", "$2"))
    return out


def canonical_sql(text: str) -> str:
    """canonical() in DuckDB's SQL."""
    out = f"lower({text})"
    for pattern, to in _steps():
        out = f"regexp_replace({out}, '{pattern}', '{to.replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2')}', 'g')"
    return out


def entire(lines: Column) -> Column:
    """All lines as one: where they break does not count."""
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """licence, digest and length of the canonical texts; a few hundred rows at most, so it may be broadcast."""
    rows = spark.createDataFrame(known or KNOWN, "licence string, text string").withColumn("text", entire(canonical(F.col("text"))))
    return rows.select("licence", F.sha2("text", 256).alias("digest"), F.length("text").alias("length")).distinct()


def licences(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", known: list[tuple[str, str]] | None = None) -> DataFrame:
    """id, digest, licence (of the entire text, null if unknown) and notices (licences of single lines, sorted, comma-joined).

    A null text counts as empty; the empty text is no licence. A line is a notice if its canonical form is that of a known
    text; a text is a licence with and without a line that reserves all rights under one that says whose they are. Repeated
    rows give a row each, null ids stay null, and texts may be of any length. An empty table gives no rows; other columns
    of docs play no part, whatever their names. known: texts to know instead of the ready ones, a few hundred at most.
    """
    spark = docs.sparkSession
    table = saved(known_digests(spark, known), "licences_known")
    lengths = [r.length for r in table.select("length").distinct().collect()]
    body = text_of(text_column)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_column).alias("id"), body.alias("body"), canonical(body).alias("lines"))
    alike = F.filter(F.split("lines", "\n"), lambda x: F.length(x).isin(lengths))
    digests = F.transform(F.array_distinct(alike), lambda x: F.sha2(x, 256))
    unreserved = canonical(F.regexp_replace(F.lower("body"), RESERVED_LINE, "$1"))
    other = F.when(F.contains("lines", F.lit("all rights reserved")), F.sha2(entire(unreserved), 256))
    rows = saved(rows.select("uid", "id", F.sha2(entire(F.col("lines")), 256).alias("digest"), other.alias("other"), digests.alias("notices")), "licences_rows")
    known_small = F.broadcast(table.groupBy("digest").agg(F.min("licence").alias("licence")))
    met = rows.where(F.size("notices") > 0).select("uid", F.explode("notices").alias("digest")).join(known_small, "digest")
    notices = met.groupBy("uid").agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices"))
    every = table if known else saved(table.unionByName(known_digests(spark, bodies())), "licences_bodies")
    whole = F.broadcast(every.groupBy("digest").agg(F.min("licence").alias("licence")))
    also = F.broadcast(every.groupBy(F.col("digest").alias("other")).agg(F.min("licence").alias("licence_other")))
    found = rows.drop("notices").join(whole, "digest", "left").join(also, "other", "left").join(notices, "uid", "left")
    return found.select("id", "digest", F.coalesce("licence", "licence_other").alias("licence"), F.coalesce("notices", F.lit("")).alias("notices"))
