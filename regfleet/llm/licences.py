"""Licence texts and notices by canonical digests, with DataFrame functions only.

A text, each of its paragraphs and each of its lines are brought to a canonical
form (lower case, no lines that state a copyright, one spelling of words with several, only
letters and digits) and their digests are joined with those of known texts. A
licence is found only as an entire text, paragraph or line.
"""

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as equal, from the public matching guidelines for licence texts.
SPELLINGS = {
    "licence": "license",
    "licencing": "licensing",
    "sub-license": "sublicense",
    "sub license": "sublicense",
    "non-infringement": "noninfringement",
    "non-commercial": "noncommercial",
    "copyright owner": "copyright holder",
    "favour": "favor",
    "fulfilment": "fulfillment",
    "organisation": "organization",
    "per cent": "percent",
    "https:": "http:",
    "whilst": "while",
    "wilful": "willful",
    "acknowledgement": "acknowledgment",
    "judgement": "judgment",
    "merchantable quality": "merchantability",
    "&": " and ",
}

# Known texts by licence. Notices are licence statements that stand on a line of their own.
_PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
    " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
    " permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_CONDITION = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the"
    " Software."
)
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE"
    " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR"
    " COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR"
    " OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
)
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL"
    " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,"
    " INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN"
    " AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR"
    " PERFORMANCE OF THIS SOFTWARE."
)
KNOWN = [
    ("MIT", f"{_PERMISSION}\n\n{_MIT_CONDITION}\n\n{_MIT_WARRANTY}"),
    ("MIT", f"MIT License\n\n{_PERMISSION}\n\n{_MIT_CONDITION}\n\n{_MIT_WARRANTY}"),
    ("MIT", f"The MIT License (MIT)\n\n{_PERMISSION}\n\n{_MIT_CONDITION}\n\n{_MIT_WARRANTY}"),
    ("MIT", _PERMISSION),
    ("ISC", f"{_ISC_GRANT}{_ISC_NOTICE}\n\n{_ISC_WARRANTY}"),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}{_ISC_NOTICE}\n\n{_ISC_WARRANTY}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_WARRANTY}"),
    ("0BSD", f"Zero-Clause BSD\n\n{_ISC_GRANT}.\n\n{_ISC_WARRANTY}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
]

#: Entire texts, one file per licence, that are known besides.
TEXTS = Path(__file__).parent / "licence_texts"

#: Where the terms of a text end that has more, which is often left out.
_TERMS_END = "END OF TERMS AND CONDITIONS"

# A line that states a copyright: the sign, a year or a holder (a name with a capital letter) follows. Other lines
# that begin with the word are prose.
PROSE = (
    "notices?|holders?|owners?|ownership|licen[cs]\\w*|laws?|statements?|acts?|and|or|in|on|is|to|for|of|under|which|that|shall|may"
    "|interests?|treat\\w*|permissions?|rights?|protect\\w*|infring\\w*|claims?|disclaimers?|materials?|works?|status|control\\w*"
)
_DATE = r"[\[{(<]?(?:[0-9]{4}|(?i:yyyy|years?)\b)"
_SIGN = r"(?i:\(c\)|©)"
_COPYRIGHT_LINE = (
    r"(?m)^[^\p{L}\p{N}\n]*(?:"
    rf"(?i:copyright)[\s&&[^\n]]*[:,]?[\s&&[^\n]]*(?:{_SIGN}|{_DATE}|(?i:by)\b|(?<=[^\p{{L}}])(?!(?i:{PROSE})\b)\p{{Lu}})"
    rf"|(?<=\()[cC]\)[\s&&[^\n]]*(?:{_DATE}|(?i:copyright))|(?<=©)[\s&&[^\n]]*\S|(?i:all rights reserved))[^\n]*$"
)


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of every text that is looked for."""
    texts = [(path.stem, path.read_text(encoding="utf-8")) for path in sorted(TEXTS.glob("*.txt"))]
    terms = [(name, text[: text.index(_TERMS_END) + len(end)]) for name, text in texts for end in (_TERMS_END, "") if _TERMS_END in text]
    return [*KNOWN, *texts, *terms]


def known_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_texts(), "licence string, text string")


def canonical(text: Column) -> Column:
    """Canonical lines of a text; null for null."""
    out = F.lower(F.regexp_replace(text, _COPYRIGHT_LINE, ""))
    for old, new in SPELLINGS.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def one_line(lines: Column) -> Column:
    out = F.btrim(F.regexp_replace(lines, r"[\n ]+", " "))
    # Spellings of two words that a line end stood between.
    for old, new in SPELLINGS.items():
        if " " in (words := old.replace("-", " ").strip()):
            out = F.replace(out, F.lit(words), F.lit(new))
    return out


def find_licences(
    docs: DataFrame, known: DataFrame, doc: str = "doc_id", text: str = "text", max_broadcast: int = 100_000
) -> DataFrame:
    """One row per document: doc, licence (of the entire text, else null) and notices (sorted licences of its parts).

    ``known`` holds (licence, text); a text known for several licences gives the
    first by name. Its digests are broadcast up to ``max_broadcast`` of them and
    joined by shuffle beyond. Null and empty texts and texts of copyright lines only
    match nothing. Rows that repeat both id and text give as many equal rows. Other
    columns are ignored.
    """
    table = (
        known.select("licence", one_line(canonical(F.col("text"))).alias("canon"))
        .filter("canon != ''")
        .groupBy(F.sha2("canon", 256).alias("unit"))
        .agg(F.min("licence").alias("licence"))
    )
    table = F.broadcast(table) if table.limit(max_broadcast + 1).count() <= max_broadcast else table
    lines = docs.select(
        F.col(doc).alias("doc"),
        F.coalesce(F.xxhash64(text), F.lit(0)).alias("digest"),
        F.coalesce(canonical(F.col(text)), F.lit("")).alias("canon"),
    )
    parts = F.array_distinct(F.concat(F.split("canon", "\n"), F.split("canon", r"\n *\n[\n ]*")))
    units = F.concat(
        F.array(F.struct(F.lit(True).alias("whole"), F.col("canon").alias("unit"))),
        F.transform(F.filter(parts, lambda p: F.btrim(p) != ""), lambda p: F.struct(F.lit(False).alias("whole"), p.alias("unit"))),
    )
    rows = lines.select("doc", "digest", F.inline(units)).withColumn("unit", F.sha2(one_line(F.col("unit")), 256))
    hits = rows.join(table, "unit", "left").filter("whole OR licence IS NOT NULL")
    found = hits.groupBy("doc", "digest").agg(
        F.max(F.when(F.col("whole"), F.col("licence"))).alias("licence"),
        F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("licence")))).alias("notices"),
        F.count(F.when(F.col("whole"), 1)).cast("int").alias("rows"),
    )
    return found.select(
        F.col("doc").alias(doc), "licence", "notices", F.explode(F.expr("sequence(1, rows)")).alias("_copy")
    ).drop("_copy")
