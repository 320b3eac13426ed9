"""Licence scans by sentence rules.

A text is cut into sentences, normalised sentences are mapped to identifiers of known licence sentences, and the
sequence of identifiers is matched against rules, the first rule that fits at a place winning. Everything is Spark
functions over one row, so there is no shuffle and no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Known licence sentences: (identifier, normalised text: lower case, single spaces, no quotes, no full stop at the end).
#: Public licence texts; several wordings may share an identifier.
SENTENCES = [
    ("ApacheRef", "licensed under the apache license, version 2.0"),
    ("ApacheRef", "licensed under the apache license, version 2.0 (the license)"),
    ("ApacheUse", "you may not use this file except in compliance with the license"),
    ("ApacheCopy", "you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0 unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied"),
    ("ApacheSee", "see the license for the specific language governing permissions and limitations under the license"),
    ("MitRef", "released under the mit license"),
    ("MitRef", "licensed under the mit license"),
    ("MitGrant", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions"),
    ("MitNotice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("AsIs", "the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("NoLiability", "in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"),
    ("BsdGrant", "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BsdSource", "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BsdBinary", "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("BsdEndorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("Gpl3Ref", "this work is licensed under the gnu general public license, version 3"),
    ("Gpl3Ref", "licensed under the gnu general public license, version 3"),
    ("GplGrant3", "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version"),
    ("GplGrant2", "this program is free software"),
    ("GplTerms2", "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("GplLater2", "either version 2 of the license, or (at your option) any later version"),
    ("GplTerms3", "you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version"),
    ("GplNoWarranty", "this program is distributed in the hope that it will be useful, but without any warranty"),
    ("GplImplied", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GplSee", "see the gnu general public license for more details"),
    ("CcByNcRef", "licensed under cc by-nc 4.0"),
    ("CcByNcRef", "this work is licensed under cc by-nc 4.0"),
    ("CcByRef", "licensed under cc by 4.0"),
    ("CcBySaRef", "licensed under cc by-sa 4.0"),
    ("Cc0Ref", "licensed under cc0 1.0"),
    ("MplRef", "this source code form is subject to the terms of the mozilla public license, v. 2.0"),
    ("SpdxMit", "spdx-license-identifier: mit"),
    ("SpdxApache", "spdx-license-identifier: apache-2.0"),
    ("SpdxBsd3", "spdx-license-identifier: bsd-3-clause"),
    ("SpdxGpl3", "spdx-license-identifier: gpl-3.0-only"),
    ("AllRights", "all rights reserved"),
]
#: Rules in order: (licence, identifiers that must follow one another). Longer wordings stand before their parts.
RULES = [
    ("Apache-2.0", ["ApacheRef", "ApacheUse", "ApacheCopy", "ApacheSee"]),
    ("Apache-2.0", ["ApacheRef", "ApacheUse"]),
    ("Apache-2.0", ["ApacheRef"]),
    ("Apache-2.0", ["SpdxApache"]),
    ("MIT", ["MitGrant", "MitNotice", "AsIs", "NoLiability"]),
    ("MIT", ["MitGrant", "MitNotice"]),
    ("MIT", ["MitRef"]),
    ("MIT", ["SpdxMit"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("BSD-3-Clause", ["SpdxBsd3"]),
    ("GPL-3.0-or-later", ["GplGrant2", "GplTerms3"]),
    ("GPL-3.0-or-later", ["GplGrant3"]),
    ("GPL-2.0-or-later", ["GplGrant2", "GplTerms2", "GplLater2"]),
    ("GPL-3.0-only", ["Gpl3Ref"]),
    ("GPL-3.0-only", ["SpdxGpl3"]),
    ("CC-BY-NC-4.0", ["CcByNcRef"]),
    ("CC-BY-SA-4.0", ["CcBySaRef"]),
    ("CC-BY-4.0", ["CcByRef"]),
    ("CC0-1.0", ["Cc0Ref"]),
    ("MPL-2.0", ["MplRef"]),
    ("AllRightsReserved", ["AllRights"]),
]
#: Every known sentence holds one of these words, which no line break, comment mark or doubled space can part; so a text
#: that has none of them once its quotes are gone needs no cutting.
ANCHOR_WORDS = ["licen", "software", "reserved", "redistribution", "warranty"]
#: The prefilter of the DuckDB equivalent; it misses sentences that are wrapped inside an anchor.
ANCHORS = ["licen", "rights reserved", "permission notice", "redistribution", "free software", "software is provided", "authors or copyright", "general public", "implied warranty", "endorse or promote", "any warranty", "permission is hereby", "following disclaimer", "following conditions", "cc by", "cc0"]
#: The first words of known sentences: a line break before them ends a sentence, other single line breaks are spaces.
STARTS = sorted({" ".join(s.split()[:2]) for _, s in SENTENCES})

QUOTES = "\"'`\u201c\u201d\u2018\u2019"
SPACE = r"[ \t\n\x0B\f\r]"
BREAK = "\x01"
_START = "(?:" + "|".join(re.escape(s).replace("\\ ", SPACE + "+").replace("\\-", "-") for s in STARTS) + ")"
#: Steps on the lower-case text: (pattern, what stands for it). They put BREAK between sentences and tidy the rest.
STEPS = [
    (r"[\"'`\x{201C}\x{201D}\x{2018}\x{2019}]", ""),
    (r"(?:^|\n)[ \t]*(?:#+|//+|/\*+|\*+/?|--|;+)[ \t]*", "\n"),
    (r"\n[ \t\r\f\x0B]*\n", BREAK),
    (r"\n[ \t\r\f\x0B]*(" + _START + ")", BREAK + "$1"),
    (r"([.!?])" + SPACE + "+(v|version)?", r"$1" + BREAK + "$2"),
    (r"([:;])" + SPACE + "*\n", r"$1" + BREAK),
    (r"; (you can|either|without even)", BREAK + "$1"),
    (SPACE + "+", " "),
    (" ?" + BREAK + " ?", BREAK),
    (r"[.!?:;,]+(" + BREAK + "|$)", "$1"),
]


def _known() -> dict[str, str]:
    return {s: i for i, s in SENTENCES}


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, licenses, unmatched, status) for every row.

    sentence_ids are the known sentences in their order, licenses what the rules make of them, unmatched the
    identifiers no rule took; all are comma-separated strings. status is 'licensed', 'unknown' (known sentences, but no
    rule) or 'none'. Null and empty texts have 'none'. Repeated rows repeat, null ids stay, other columns are ignored,
    an empty table gives no rows. Texts of any length are read whole.
    """
    low = F.lower(F.col("text"))
    bare = F.translate(low, QUOTES, "")
    has = F.lit(False)
    for a in ANCHOR_WORDS:
        has = has | bare.contains(a)
    cut = low
    for pattern, by in STEPS:
        cut = F.regexp_replace(cut, F.lit(pattern), F.lit(by))
    known = F.create_map(*[F.lit(x) for pair in _known().items() for x in pair])
    ids = F.filter(F.transform(F.split(cut, BREAK), lambda s: F.try_element_at(known, F.trim(s))), lambda x: x.isNotNull())
    # '#' ends an identifier, so that rules match whole identifiers
    sequence = F.coalesce(F.when(has, F.concat(F.lit("#"), F.array_join(F.transform(ids, lambda x: F.concat(x, F.lit("#"))), ""))), F.lit("#"))
    rules = {"".join(f"{i}#" for i in ids): name for name, ids in RULES}
    pattern = "(?:" + "|".join(rules) + ")"
    names = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    rows = docs.select(F.col("doc_id"), F.substring(sequence, 2, 1_000_000_000).alias("seq"))
    found = F.transform(F.regexp_extract_all("seq", F.lit(pattern), F.lit(0)), lambda m: F.element_at(names, m))
    rest = F.regexp_replace("seq", pattern, "")
    strip = lambda c: F.regexp_replace(F.regexp_replace(c, "#$", ""), "#", ",")
    rows = rows.select("doc_id", strip(F.col("seq")).alias("sentence_ids"), F.array_join(found, ",").alias("licenses"), strip(rest).alias("unmatched"))
    return rows.withColumn("status", F.when(F.col("licenses") != "", "licensed").when(F.col("sentence_ids") != "", "unknown").otherwise("none"))


def op1_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.read(spark, sf_dir, "documents"))


def _sql() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def re2(s: str) -> str:
        return quoted(s.replace("\\x0B", "\\x0b"))

    low = "lower(text)"
    cut = low
    for pattern, by in STEPS:
        cut = f"regexp_replace({cut}, {re2(pattern)}, {quoted(by.replace('$', chr(92)))}, 'g')"
    known = "MAP {" + ", ".join(f"{quoted(s)}: {quoted(i)}" for s, i in _known().items()) + "}"
    rules = {"".join(f"{i}#" for i in ids): name for name, ids in RULES}
    names = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in rules.items()) + "}"
    pattern = quoted("(?:" + "|".join(rules) + ")")
    has = " OR ".join(f"contains({low}, {quoted(a)})" for a in ANCHORS)
    return f"""
WITH cut AS (
  SELECT doc_id, CASE WHEN {has} THEN string_split({cut}, chr(1)) ELSE [] END AS parts FROM documents
), ids AS (
  SELECT doc_id, coalesce(list_filter(list_transform(parts, lambda s: {known}[trim(s)]), lambda x: x IS NOT NULL), []) AS ids FROM cut
), seq AS (
  SELECT doc_id, coalesce(array_to_string(list_transform(ids, lambda x: x || '#'), ''), '') AS seq FROM ids
), found AS (
  SELECT doc_id, rtrim(replace(seq, '#', ','), ',') AS sentence_ids,
    coalesce(array_to_string(list_transform(regexp_extract_all(seq, {pattern}), lambda m: {names}[m]), ','), '') AS licenses,
    rtrim(replace(regexp_replace(seq, {pattern}, '', 'g'), '#', ','), ',') AS unmatched
  FROM seq
)
SELECT *, CASE WHEN licenses <> '' THEN 'licensed' WHEN sentence_ids <> '' THEN 'unknown' ELSE 'none' END AS status FROM found
"""


SQL = _sql()
