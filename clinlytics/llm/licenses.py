"""Operator 4: licence scan by canonical digests, DataFrame functions only.

A unit of text (the whole text, a paragraph of a text with several, a line, a
run of paragraphs inside a longer text) is normalised: ASCII lower case, copyright lines dropped, punctuation folded to
single spaces, equivalent spellings unified. Its SHA-256 is hash-joined to the
digests of the known licence texts and notices, which are normalised by the
same expressions. The known table is a fixed list, so it is broadcast. Known texts of
several paragraphs also stand there paragraph by paragraph: a run is found
where all of them match in a row. Lines that start with "copyright" are
dropped, so the short texts are known in every wrap that makes such a line.

Result: one row per matching unit. Null and empty texts, and units that are
empty after normalisation, match nothing; repeated rows each give their rows;
extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import re
import textwrap
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinlytics.llm.common import prepare

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"(^|\n)[ \t\r]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
BLANK_LINES = r"\n[ \t\r]*\n[ \t\r\n]*"
PUNCTUATION = "[^a-z0-9]+"

# Spellings held equal, in the order they are applied.
EQUIVALENT = (
    ("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
    ("favour", "favor"), ("behaviour", "behavior"), ("organisation", "organization"), ("initialise", "initialize"),
    ("acknowledgement", "acknowledgment"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
    ("https ", "http "), (" v 2 0", " version 2 0"), (" v2 0", " version 2 0"), (" v3", " version 3"), (" v2", " version 2"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

# Known notices, and the bodies of MIT and ISC.
_NOTICES = (
    ("MIT", _MIT), ("ISC", _ISC),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."), ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."), ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."), ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# Titles of the texts that are usually given one.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", 'BSD 3-Clause "New" or "Revised" License'),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
#: full texts in license_texts, by their file's name
FULL = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0",
        "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "Unlicense": "Unlicense"}


def _wraps(body: str) -> set[str]:
    """The text as it is, with a line a paragraph, and wrapped where a line then starts with "copyright", which is dropped."""
    parts = [" ".join(p.split()) for p in re.split(r"\n\s*\n", body.strip())]
    out = {body, "\n\n".join(parts)}
    if len(body) < 4_000:
        for width in range(50, 121):
            lines = "\n\n".join(textwrap.fill(p, width, break_on_hyphens=False) for p in parts)
            if re.search(r"^copyright", lines, re.IGNORECASE | re.MULTILINE):
                out.add(lines)
    return out


def _known() -> tuple[tuple[str, str], ...]:
    """(license_id, text): notices, and full texts with and without title, terms only, and as usually wrapped."""
    bodies = {("MIT", _MIT), ("ISC", _ISC)}
    for name, license_id in FULL.items():
        text = files(__package__).joinpath("license_texts", f"{name}.txt").read_text(encoding="utf-8")
        forms = {text, re.sub(r"(?s)(END OF TERMS AND CONDITIONS).*", r"\1", text)}
        if license_id in TITLES:
            forms.add(re.sub(r"(?m)^\d\. ", "* ", text))
        else:  # the first paragraph is the title
            forms |= {re.split(r"\n\s*\n", x.strip(), maxsplit=1)[1] for x in forms}
        bodies |= {(license_id, x) for x in forms}
    texts = {(i, w) for i, x in bodies for w in _wraps(x)}
    texts |= {(i, f"{title}\n\n{x}") for i, x in texts for title in TITLES.get(i, ())}
    return (*_NOTICES, *sorted(texts - set(_NOTICES)))


KNOWN = _known()


def without_copyright(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT_LINE, "\n")


def folded(unit: Column) -> Column:
    out = F.regexp_replace(unit, PUNCTUATION, " ")
    for old, new in EQUIVALENT:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(out)


def known_digests(spark: SparkSession) -> DataFrame:
    """(license_id, digest) of the fixed list."""
    rows = spark.createDataFrame(list(KNOWN), "license_id string, text string")
    return rows.select("license_id", F.sha2(folded(without_copyright(F.col("text"))), 256).alias("digest")).distinct()


def known_units(spark: SparkSession) -> DataFrame:
    """(digest, license_id, whole, pos, n_parts): known texts (n_parts 1), and the paragraphs of those that have several."""
    rows = spark.createDataFrame(list(KNOWN), "license_id string, text string")
    clean = rows.select("license_id", without_copyright(F.col("text")).alias("_text"))
    parts = F.filter(F.transform(F.split("_text", BLANK_LINES), lambda x: F.sha2(folded(x), 256)), lambda x: x != F.sha2(F.lit(""), 256))
    runs = clean.select("license_id", F.sha2(folded(F.col("_text")), 256).alias("whole"), parts.alias("p")).where(F.size("p") > 1)
    runs = runs.select("license_id", "whole", F.size("p").alias("n_parts"), F.posexplode("p").alias("pos", "digest")).select("digest", "license_id", "whole", "pos", "n_parts")
    texts = known_digests(spark).select("digest", "license_id", F.col("digest").alias("whole"), F.lit(0).alias("pos"), F.lit(1).alias("n_parts"))
    return texts.unionByName(runs.distinct())


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, unit, unit_no, license_id, digest) of every unit that is a known licence text."""
    prepare(docs.sparkSession)
    clean = docs.select("doc_id", F.xxhash64("text").alias("_key"), without_copyright(F.col("text")).alias("_text"))
    parts = F.split("_text", BLANK_LINES)
    lines = F.split("_text", "\n")
    # A text of one paragraph or line is the whole text's unit already.
    units = F.concat(
        F.array(F.struct(F.lit("text").alias("unit"), F.lit(0).alias("unit_no"), F.col("_text").alias("body"))),
        F.when(F.size(parts) > 1, F.transform(parts, lambda x, i: F.struct(F.lit("paragraph").alias("unit"), (i + 1).alias("unit_no"), x.alias("body"))))
        .otherwise(F.array()),
        F.when(F.size(lines) > 1, F.transform(lines, lambda x, i: F.struct(F.lit("line").alias("unit"), (i + 1).alias("unit_no"), x.alias("body"))))
        .otherwise(F.array()))
    rows = clean.where("_text is not null").select("doc_id", "_key", F.explode(units).alias("u"))
    rows = rows.select("doc_id", "_key", "u.unit", F.col("u.unit_no").cast("bigint").alias("unit_no"), F.sha2(folded(F.col("u.body")), 256).alias("digest"))
    # The known table is a fixed list in this package: a proven bound for the broadcast.
    hits = rows.join(F.broadcast(known_units(docs.sparkSession)), "digest")
    hits = hits.where((F.col("n_parts") == 1) | (F.col("unit") == "paragraph"))
    unit = F.when(F.col("n_parts") > 1, "paragraphs").otherwise(F.col("unit")).alias("unit")
    found = (hits.groupBy("doc_id", "_key", unit, (F.col("unit_no") - F.col("pos")).alias("unit_no"), "license_id", F.col("whole").alias("digest"), "n_parts")
             .agg(F.count(F.lit(1)).alias("n"), F.size(F.collect_set("pos")).alias("n_pos")).where("n_pos = n_parts"))
    # A run of all the text's paragraphs is the text's unit already.
    same = Window.partitionBy("doc_id", "_key", "license_id", "digest")
    found = found.withColumn("_whole", F.max(F.col("unit") == "text").over(same)).where("unit <> 'paragraphs' or not _whole")
    # equal rows come together: as many as there are
    copies = F.explode(F.sequence(F.lit(1), (F.col("n") / F.col("n_parts")).cast("int")))
    return found.select("doc_id", "unit", "unit_no", "license_id", "digest", copies.alias("_copy")).drop("_copy")


def oracle() -> str:
    """DuckDB SQL of :func:`scan` over ``documents``."""
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def clean(c: str) -> str:
        return f"regexp_replace(translate({c}, '{UPPER}', '{LOWER}'), {q(COPYRIGHT_LINE)}, chr(10), 'g')"

    def fold(c: str) -> str:
        out = f"regexp_replace({c}, '{PUNCTUATION}', ' ', 'g')"
        for old, new in EQUIVALENT:
            out = f"replace({out}, {q(old)}, {q(new)})"
        return f"trim({out}, ' ')"

    known = ", ".join(f"({q(i)}, {q(t)})" for i, t in KNOWN)
    return f"""
    WITH known AS (SELECT DISTINCT license_id, sha256({fold(clean('text'))}) AS digest FROM (VALUES {known}) k(license_id, text)),
    clean AS (SELECT doc_id, {clean('text')} AS t FROM documents WHERE text IS NOT NULL),
    part AS (SELECT doc_id, regexp_split_to_array(t, {q(BLANK_LINES)}) AS p, string_split(t, chr(10)) AS l, t FROM clean),
    units AS (
      SELECT doc_id, 'text' AS unit, 0 AS unit_no, t AS body FROM part
      UNION ALL SELECT doc_id, 'paragraph', unnest(range(1, len(p) + 1)), unnest(p) FROM part WHERE len(p) > 1
      UNION ALL SELECT doc_id, 'line', unnest(range(1, len(l) + 1)), unnest(l) FROM part WHERE len(l) > 1)
    SELECT doc_id, unit, CAST(unit_no AS BIGINT) AS unit_no, license_id, digest
    FROM (SELECT doc_id, unit, unit_no, sha256({fold('body')}) AS digest FROM units) JOIN known USING (digest)"""
