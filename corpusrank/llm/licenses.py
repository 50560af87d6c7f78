"""License scans (operator 5): sentences become known identifiers, and identifier sequences are matched against rules.

Everything on the main path is DataFrame expressions.  A text is cut into sentences, each sentence is normalised to its
letters and digits, and an equi-join with the table of known sentences (its size is fixed here, not by data) leaves the
few that matter.  Each known sentence has one private-use character; a document's characters in order form a short
string, in which a gap of unknown sentences is marked, and the ordered rules, longest first, are one regular expression
over that string.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """An ordered sequence of sentence kinds that together are a licence's text, header or notice."""

    licence: str
    part: str
    kinds: tuple[str, ...]


# fixed values: licence names as notices write them, by SPDX identifier
NAMES = {
    "MIT": ["MIT License", "MIT licence", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License Version 2.0", "Apache 2.0 License", "Apache-2.0", "Apache 2.0", "Apache License, Version 2.0 (the \"License\")"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License version 2", "GNU General Public License v2", "GNU GPL version 2", "GNU GPL v2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License version 3", "GNU General Public License v3", "GNU General Public License v3.0", "GNU GPL version 3", "GNU GPL v3", "GPLv3", "GPL-3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License version 2.1", "GNU LGPL version 2.1", "LGPLv2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License version 3", "GNU LGPL version 3", "LGPLv3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License version 3", "GNU AGPL version 3", "AGPLv3", "AGPL-3.0"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL-2.0", "MPL 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-clause BSD license", "Simplified BSD License", "FreeBSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-clause BSD license", "New BSD License", "Modified BSD License", "BSD-3-Clause"],
    "ISC": ["ISC License", "ISC"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "CC0", "CC0-1.0", "Creative Commons CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 International", "Creative Commons Attribution License 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-SA-3.0": ["CC BY-SA 3.0", "CC-BY-SA-3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"],
}
SUBJECTS = ["", "this work is", "this file is", "this software is", "this project is", "this program is", "this document is", "this text is", "this article is", "this content is", "this code is", "this library is", "this page is", "it is", "the code is", "the text is"]
VERBS = ["licensed under", "licenced under", "released under", "distributed under", "made available under", "available under", "published under", "provided under"]

# fixed values: sentences of licence texts and headers, by kind
SENTENCES = {
    "mit.grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit.notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit.asis": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "mit.liability": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "isc.grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "isc.asis": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "apache.use": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "apache.copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache.at": ["You may obtain a copy of the License at"],
    "apache.url": ["http://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0"],
    "apache.asis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "apache.see": ["See the License for the specific language governing permissions and limitations under the License."],
    "gpl3.free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl2.free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "agpl3.free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl3.free": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gnu.hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl.details": ["See the GNU General Public License for more details."],
    "agpl.details": ["See the GNU Affero General Public License for more details."],
    "lgpl.details": ["See the GNU Lesser General Public License for more details."],
    "gpl.copy": ["You should have received a copy of the GNU General Public License along with this program."],
    "agpl.copy": ["You should have received a copy of the GNU Affero General Public License along with this program."],
    "mpl.subject": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl.obtain": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "bsd.redist": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd.source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd.binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd.endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd.asis": ["THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "unlicense.free": ["This is free and unencumbered software released into the public domain."],
    "unlicense.anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
RULES = [
    Rule("MIT", "text", ("mit.grant", "mit.notice", "mit.asis", "mit.liability")),
    Rule("MIT", "text", ("mit.grant", "mit.notice", "mit.asis")),
    Rule("ISC", "text", ("isc.grant", "isc.asis")),
    *[Rule("Apache-2.0", "header", ("apache.use", *copy, *rest)) for copy in (("apache.copy",), ("apache.at", "apache.url")) for rest in (("apache.asis", "apache.see"), ("apache.asis",), ())],
    Rule("GPL-3.0", "header", ("gpl3.free", "gnu.hope", "gpl.details", "gpl.copy")),
    Rule("GPL-3.0", "header", ("gpl3.free", "gnu.hope", "gpl.details")),
    Rule("GPL-2.0", "header", ("gpl2.free", "gnu.hope", "gpl.details", "gpl.copy")),
    Rule("GPL-2.0", "header", ("gpl2.free", "gnu.hope", "gpl.details")),
    Rule("AGPL-3.0", "header", ("agpl3.free", "gnu.hope", "agpl.details", "agpl.copy")),
    Rule("AGPL-3.0", "header", ("agpl3.free", "gnu.hope", "agpl.details")),
    Rule("LGPL-3.0", "header", ("lgpl3.free", "gnu.hope", "lgpl.details")),
    Rule("MPL-2.0", "header", ("mpl.subject", "mpl.obtain")),
    Rule("BSD-3-Clause", "text", ("bsd.redist", "bsd.source", "bsd.binary", "bsd.endorse", "bsd.asis")),
    Rule("BSD-2-Clause", "text", ("bsd.redist", "bsd.source", "bsd.binary", "bsd.asis")),
    Rule("Unlicense", "text", ("unlicense.free", "unlicense.anyone")),
    *[Rule(name, "header", (kind,)) for name, kind in (("GPL-3.0", "gpl3.free"), ("GPL-2.0", "gpl2.free"), ("AGPL-3.0", "agpl3.free"), ("LGPL-3.0", "lgpl3.free"), ("MPL-2.0", "mpl.subject"), ("Apache-2.0", "apache.use"), ("Unlicense", "unlicense.free"), ("MIT", "mit.grant"), ("ISC", "isc.grant"))],
    *[Rule(name, "notice", (f"{name}.notice",)) for name in NAMES],
]
#: A sentence ends at a stop before white space and anything but a digit ("v. 2.0" goes on), at a colon before white
#: space unless it follows a licence tag, or at a line with nothing but comment marks; its lines also stand alone.
_TAG = r"(?i)(license-identifier|licen[cs]e):"
_STOP = r"([.;!?])[ \t\r\n\f]+([^0-9])"
_COLON = r":[ \t\r\n\f]+"
_EMPTY = r"\n[ \t\r\f#*/;%-]*\n"
_CUT = "\x01"
#: Unknown sentences that may lie between two sentences of one sequence.
GAP = 2
_FIRST = 0xE001
_BREAK = ""
#: Every known sentence has one of these, so that texts without any need no cutting.
ANCHORS = ("licen[cs]", "copyright", "permission", "warrant", "redistribut", "public[^a-z0-9]+domain", "released[^a-z0-9]+under", "distributed[^a-z0-9]+under", "available[^a-z0-9]+under", "published[^a-z0-9]+under", "provided[^a-z0-9]+under", "free[^a-z0-9]+software", "public[^a-z0-9]+license", "anyone[^a-z0-9]+is", "in[^a-z0-9]+no[^a-z0-9]+event", "apache", "mpl", "either[^a-z0-9]+version", "without[^a-z0-9]+even")


def normalise(sentence: str) -> str:
    """Lower-cased runs of a-z and 0-9, one space apart (the same as the column expression ``_normal``)."""
    out = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in sentence))
    return " ".join(out.split())


def notice_prefix() -> str:
    """What comes before the licence's name in a normalised notice, as a regular expression; replaced by "notice "."""
    subjects = "|".join(x for x in SUBJECTS if x)
    return f"^((({subjects}) )?({'|'.join(VERBS)})( the terms of)?( the| a)? |(spdx license identifier|licen[cs]e) )"


def _cut_known(sentence: str) -> list[str]:
    """What the scan's cutting makes of one known sentence."""
    return re.sub(_COLON, ":" + _CUT, re.sub(_STOP, r"\1" + _CUT + r"\2", sentence)).split(_CUT)


def sentence_table() -> tuple[list[tuple[str, str]], dict[str, str]]:
    """((normalised sentence, character), ...), and the characters of each kind: several where the scan cuts its sentence."""
    sentences: dict[str, str] = {}
    kinds: dict[str, str] = {}

    def char(sentence: str) -> str:
        return sentences.setdefault(normalise(sentence), chr(_FIRST + len(set(sentences.values()))))

    for name, forms in NAMES.items():
        own = char(f"notice {forms[0]}")
        kinds[f"{name}.notice"] = own
        for form in forms:
            for end in ("", "-only", "-or-later", " or later", ", or (at your option) any later version"):
                sentences.setdefault(normalise(f"notice {form}{end}"), own)
    for kind, forms in SENTENCES.items():
        first = [char(_as_scanned(x)) for x in _cut_known(forms[0])]
        kinds[kind] = "".join(first)
        for form in forms[1:]:
            for piece, own in zip(_cut_known(form), first, strict=True):
                sentences.setdefault(normalise(_as_scanned(piece)), own)
    return sorted(sentences.items()), kinds


def _as_scanned(piece: str) -> str:
    return re.sub(notice_prefix(), "notice ", normalise(piece))


def rule_table(kinds: dict[str, str]) -> list[tuple[str, str, str]]:
    """(characters, licence, part) of each rule, longest first; the first of equal sequences counts."""
    out: dict[str, tuple[str, str]] = {}
    for rule in RULES:
        out.setdefault("".join(kinds[k] for k in rule.kinds), (rule.licence, rule.part))
    return sorted(((s, *x) for s, x in out.items()), key=lambda r: (-len(r[0]), r[0]))


def _normal(column: str) -> Column:
    lower = F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " ")), notice_prefix(), "notice ")


def _local(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A fixed table as a plan of literals: no Python on the executors."""
    values = ", ".join("(" + ", ".join("'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'" for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def scan_licences(docs: DataFrame, gap: int = GAP, text: str = "text", row: str = "doc_id") -> DataFrame:
    """A row for each match: (row, licence, part, first_sentence, last_sentence, sentences), in the texts of ``docs``.

    Sentences are numbered from 0 in a text; a line of a longer sentence has its number.  ``part`` is text,
    header or notice, or "fragment" (licence "unknown") for known sentences that complete no rule.  Longer rules win;
    a sentence counts in one match.  More than ``gap`` unknown sentences end a sequence.  Null, empty and unlicensed
    texts give no row; repeated rows give their matches each; a null ``row`` value is kept.  Case, punctuation, comment
    marks and line breaks do not matter.
    """
    spark = docs.sparkSession
    sentences, kinds = sentence_table()
    rules = rule_table(kinds)
    known = F.broadcast(_local(spark, sentences, ["sentence", "id"]))
    given = docs.select(F.col(row).alias("row"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("uid")).where(F.col("text").rlike("(?i)" + "|".join(ANCHORS)))
    stopped = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", _TAG, "$1 "), _STOP, "$1" + _CUT + "$2"), _COLON, ":" + _CUT), _EMPTY, _CUT)
    lines = F.transform(F.split(stopped, _CUT), lambda s: F.when(F.contains(s, F.lit("\n")), F.concat(F.array(s), F.split(s, "\n"))).otherwise(F.array(s)))
    whole = given.select("uid", "row", F.posexplode(lines).alias("at", "raws"))
    cut = whole.select("uid", "row", "at", F.posexplode("raws").alias("line", "raw"))
    found = cut.select("uid", "row", "at", "line", _normal("raw").alias("sentence")).join(known, "sentence").select("uid", "row", "at", "line", "id")
    ordered = Window.partitionBy("uid").orderBy("at", "line")
    apart = F.col("at") - F.lag("at").over(ordered) > gap + 1
    marked = found.select("uid", "row", "at", "line", F.concat(F.when(apart, F.lit(_BREAK)).otherwise(""), "id").alias("id"))
    series = marked.groupBy("uid", "row").agg(F.sort_array(F.collect_list(F.struct("at", "line", "id"))).alias("hits"))
    pattern = "|".join([*(s for s, _, _ in rules), "(?s)."])
    matches = F.regexp_extract_all(F.array_join("hits.id", ""), F.lit(pattern), F.lit(0))
    each = series.select("uid", "row", "hits.at", F.posexplode(matches).alias("k", "match")).withColumn("size", F.length(F.regexp_replace("match", _BREAK, "")))
    end = F.sum("size").over(Window.partitionBy("uid").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    named = F.broadcast(_local(spark, rules, ["match", "licence", "part"]))
    return (
        each.withColumn("end", end).where("size > 0").join(named, "match", "left")
        .select("row", F.coalesce("licence", F.lit("unknown")).alias("licence"), F.coalesce("part", F.lit("fragment")).alias("part"), F.element_at("at", (F.col("end") - F.col("size") + 1).cast("int")).cast("long").alias("first_sentence"), F.element_at("at", F.col("end").cast("int")).cast("long").alias("last_sentence"), F.col("size").cast("long").alias("sentences"))
    )


def scan_sql() -> str:
    """DuckDB SQL for ``scan_licences`` over the table documents."""
    sentences, kinds = sentence_table()
    rules = rule_table(kinds)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in sentences)
    named = ", ".join(f"({quote(s)}, {quote(a)}, {quote(b)})" for s, a, b in rules)
    pattern = "|".join([*(s for s, _, _ in rules), "(?s)."])
    return f"""
WITH known(sentence, id) AS (VALUES {known}), named(match, licence, part) AS (VALUES {named}),
given AS (SELECT row_number() OVER () AS uid, doc_id, text FROM documents WHERE text IS NOT NULL),
stopped AS (SELECT uid, doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(license-identifier|licen[cs]e):', '\\1 ', 'gi'), '([.;!?])[ \\t\\r\\n\\f]+([^0-9])', '\\1' || chr(1) || '\\2', 'g'), ':[ \\t\\r\\n\\f]+', ':' || chr(1), 'g'), '\\n[ \\t\\r\\f#*/;%-]*\\n', chr(1), 'g'), chr(1)) AS s FROM given),
whole AS (SELECT uid, doc_id, unnest(s) AS x, unnest(range(len(s))) AS pos FROM stopped),
alts AS (SELECT uid, doc_id, pos, CASE WHEN contains(x, chr(10)) THEN list_concat([x], string_split(x, chr(10))) ELSE [x] END AS p FROM whole),
cut AS (SELECT uid, doc_id, pos, unnest(p) AS raw, unnest(range(len(p))) AS line FROM alts),
plain AS (SELECT *, trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) AS t FROM cut),
found AS (SELECT uid, doc_id, pos, line, id FROM (SELECT *, regexp_replace(t, {quote(notice_prefix())}, 'notice ') AS sentence FROM plain) AS n JOIN known USING (sentence)),
marked AS (SELECT uid, doc_id, pos, line, CASE WHEN pos - lag(pos) OVER (PARTITION BY uid ORDER BY pos, line) > {GAP + 1} THEN chr({ord(_BREAK)}) ELSE '' END || id AS id FROM found),
series AS (SELECT uid, doc_id, list(pos ORDER BY pos, line) AS ats, regexp_extract_all(string_agg(id, '' ORDER BY pos, line), {quote(pattern)}) AS m FROM marked GROUP BY uid, doc_id),
each AS (SELECT uid, doc_id, ats, unnest(m) AS match, unnest(range(len(m))) AS k FROM series),
sized AS (SELECT *, length(replace(match, chr({ord(_BREAK)}), '')) AS size FROM each),
ended AS (SELECT *, sum(size) OVER (PARTITION BY uid ORDER BY k) AS e FROM sized)
SELECT doc_id, coalesce(licence, 'unknown') AS licence, coalesce(part, 'fragment') AS part, CAST(ats[CAST(e - size + 1 AS BIGINT)] AS BIGINT) AS first_sentence,
  CAST(ats[CAST(e AS BIGINT)] AS BIGINT) AS last_sentence, CAST(size AS BIGINT) AS sentences
FROM ended LEFT JOIN named USING (match) WHERE size > 0
"""
