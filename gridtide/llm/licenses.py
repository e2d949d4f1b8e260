"""Licence scan by canonical digests (DataFrame functions only).

A text is brought into a canonical form: A-Z lowered, copyright lines dropped, equivalent spellings made
one, everything but letters and digits turned into single spaces. Whole texts and their single lines
are then joined by digest with a catalogue of known licences, which has one row per known statement.
"""

from __future__ import annotations

import json
import pkgutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts and customary licence statements, as published.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
# The catalogue table: [license, statement] rows of full texts, with their usual headings, and of customary notices.
CATALOGUE = tuple((name, statement) for name, statement in json.loads(pkgutil.get_data("gridtide.llm", "license_catalogue.json")))
EQUIVALENT = (("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"),
              ("non-infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("https:", "http:"), ("favour", "favor"), ("&", " and "))
# End of fixed values.

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright[ \t]+(\(c\)|©|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©)[^\n]*"
NOT_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    """The canonical form; equal for texts that differ only in case, punctuation, spacing, copyright lines or listed spellings."""
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT_LINE, "\n")
    for spelled, one in EQUIVALENT:
        out = F.replace(out, F.lit(spelled), F.lit(one))
    return F.trim(F.regexp_replace(out, NOT_WORD, " "))


def canonical_sql(text: str) -> str:
    """The same as SQL text."""
    out = f"regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '{COPYRIGHT_LINE}', chr(10), 'g')"
    for spelled, one in EQUIVALENT:
        out = f"replace({out}, '{spelled}', '{one}')"
    return f"trim(regexp_replace({out}, '{NOT_WORD}', ' ', 'g'))"


def known_digests(spark: SparkSession, catalogue: tuple = CATALOGUE) -> DataFrame:
    """(digest, license): one row per distinct canonical statement of the catalogue."""
    listed = spark.createDataFrame(list(catalogue), "license string, statement string")
    return listed.select(F.md5(canonical(F.col("statement"))).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, catalogue: tuple = CATALOGUE) -> DataFrame:
    """doc_id, text_digest, text_license, n_license_lines and licenses of every row of `docs`.

    text_license is that of the whole text, null if unknown; licenses are the distinct ones of text and
    lines, in order, joined by commas, empty if none. A null or empty text, and one without letters or
    digits, has no licence; the digest of a null text is null. Repeated rows get equal results. The
    catalogue is part of the program, so its broadcast has a fixed size; matched rows only are shuffled.
    """
    known = F.broadcast(known_digests(docs.sparkSession, catalogue))
    texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), "text", F.md5(canonical(F.col("text"))).alias("text_digest"))
    whole = texts.select("rid", F.lit(-1).alias("at"), F.col("text_digest").alias("digest"))
    lines = texts.select("rid", F.posexplode(F.split("text", "\n")).alias("at", "line")).filter(F.length("line") > 0)
    units = whole.union(lines.select("rid", "at", F.md5(canonical(F.col("line"))).alias("digest")))
    found = units.join(known, "digest").select("rid", "at", "license").distinct()
    per_text = found.groupBy("rid").agg(
        F.max(F.when(F.col("at") < 0, F.col("license"))).alias("text_license"), F.count(F.when(F.col("at") >= 0, 1)).alias("n_license_lines"),
        F.concat_ws(",", F.array_sort(F.collect_set("license"))).alias("licenses"))
    narrow = texts.select("doc_id", "rid", "text_digest")
    return narrow.join(per_text, "rid", "left").select(
        "doc_id", "text_digest", "text_license", F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"),
        F.coalesce("licenses", F.lit("")).alias("licenses"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SCAN_SQL = f"""WITH listed(license, statement) AS (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, t in CATALOGUE)}),
known AS (SELECT md5({canonical_sql("statement")}) AS digest, min(license) AS license FROM listed GROUP BY 1),
units AS (SELECT doc_id, -1 AS pos, text AS unit FROM documents
  UNION ALL SELECT doc_id, pos, lines[pos + 1] AS unit FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS pos
    FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) s) x WHERE length(lines[pos + 1]) > 0),
found AS (SELECT doc_id, pos, k.license FROM units JOIN known k ON md5({canonical_sql("unit")}) = k.digest),
per_text AS (SELECT doc_id, max(CASE WHEN pos < 0 THEN license END) AS text_license, count(*) FILTER (WHERE pos >= 0) AS n_license_lines,
  string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM found GROUP BY doc_id)
SELECT d.doc_id, md5({canonical_sql("d.text")}) AS text_digest, p.text_license, coalesce(p.n_license_lines, 0) AS n_license_lines, coalesce(p.licenses, '') AS licenses
FROM documents d LEFT JOIN per_text p ON d.doc_id = p.doc_id"""
