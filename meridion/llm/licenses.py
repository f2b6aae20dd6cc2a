"""Licence recognition by sentence rules, in DataFrame functions alone.

A text is cut at lines without ASCII letters and digits and after `.`, `!` or
`?` before white space; single line feeds are soft cuts. What lies between two
cuts of either kind, over any number of soft ones, may be a sentence: so titles
are found as lines and hard-wrapped notices as wholes. A sentence is normalised:
runs of other characters than ASCII letters and digits (comment marks, too) and
marks of list items become one space, letters become lower case. Normalised
sentences are sought in a fixed table of identifiers, the longest first; the
identifiers found, in order, form the text's sequence. Ordered rules then match contiguous parts
of the sequence; what a rule has matched is taken out before the next rule.

Cases: null or empty text has the empty sequence and no licence; repeated
sentences repeat their identifier; every row of the input gives one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_of

# Identifier -> normalised sentence.
SENTENCES = {
    "mit-name": "mit license",
    "mit-the-name": "the mit license",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-licensed": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl2-work": "this work is licensed under the gnu general public license version 2",
    "gpl3-licensed": "licensed under the gnu general public license version 3",
    "gpl2-licensed": "licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "lgpl3-licensed": "licensed under the gnu lesser general public license version 3",
    "agpl3-licensed": "licensed under the gnu affero general public license version 3",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-licensed": "licensed under the mozilla public license version 2 0",
    "bsd3-licensed": "licensed under the bsd 3 clause license",
    "bsd2-licensed": "licensed under the bsd 2 clause license",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "ccby-licensed": "licensed under cc by 4 0",
    "ccbysa-licensed": "licensed under cc by sa 4 0",
    "ccbync-licensed": "licensed under cc by nc 4 0",
    "ccbyncsa-licensed": "licensed under cc by nc sa 4 0",
    "cc0-licensed": "licensed under cc0 1 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "all-rights": "all rights reserved",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2 0",
    "spdx-gpl3": "spdx license identifier gpl 3 0 only",
    "spdx-gpl2": "spdx license identifier gpl 2 0 only",
    "spdx-bsd3": "spdx license identifier bsd 3 clause",
}

# Rules in order: rule, licence, class, identifiers.
RULES = [
    ("mit-text", "MIT", "permissive", "mit-grant mit-notice mit-asis"),
    ("mit-short-text", "MIT", "permissive", "mit-grant mit-notice"),
    ("apache-text", "Apache-2.0", "permissive", "apache-header apache-comply apache-copy apache-asis apache-see"),
    ("apache-short-text", "Apache-2.0", "permissive", "apache-licensed apache-comply"),
    ("gpl3-text", "GPL-3.0", "copyleft", "gpl-free gpl-hope gpl-see"),
    ("gpl2-text", "GPL-2.0", "copyleft", "gpl2-free gpl-hope gpl-see"),
    ("bsd3-text", "BSD-3-Clause", "permissive", "bsd-grant bsd-source bsd-binary bsd-endorse"),
    ("bsd2-text", "BSD-2-Clause", "permissive", "bsd-grant bsd-source bsd-binary"),
    ("mit-released", "MIT", "permissive", "mit-released"),
    ("mit-licensed", "MIT", "permissive", "mit-licensed"),
    ("mit-name", "MIT", "permissive", "mit-name"),
    ("mit-the-name", "MIT", "permissive", "mit-the-name"),
    ("mit-spdx", "MIT", "permissive", "spdx-mit"),
    ("apache-licensed", "Apache-2.0", "permissive", "apache-licensed"),
    ("apache-header", "Apache-2.0", "permissive", "apache-header"),
    ("apache-spdx", "Apache-2.0", "permissive", "spdx-apache"),
    ("gpl3-work", "GPL-3.0", "copyleft", "gpl3-work"),
    ("gpl3-licensed", "GPL-3.0", "copyleft", "gpl3-licensed"),
    ("gpl3-free", "GPL-3.0", "copyleft", "gpl-free"),
    ("gpl3-spdx", "GPL-3.0", "copyleft", "spdx-gpl3"),
    ("gpl2-work", "GPL-2.0", "copyleft", "gpl2-work"),
    ("gpl2-licensed", "GPL-2.0", "copyleft", "gpl2-licensed"),
    ("gpl2-free", "GPL-2.0", "copyleft", "gpl2-free"),
    ("gpl2-spdx", "GPL-2.0", "copyleft", "spdx-gpl2"),
    ("lgpl3", "LGPL-3.0", "copyleft", "lgpl3-licensed"),
    ("agpl3", "AGPL-3.0", "copyleft", "agpl3-licensed"),
    ("mpl2-form", "MPL-2.0", "copyleft", "mpl2-form"),
    ("mpl2", "MPL-2.0", "copyleft", "mpl2-licensed"),
    ("bsd3", "BSD-3-Clause", "permissive", "bsd3-licensed"),
    ("bsd3-spdx", "BSD-3-Clause", "permissive", "spdx-bsd3"),
    ("bsd2", "BSD-2-Clause", "permissive", "bsd2-licensed"),
    ("isc", "ISC", "permissive", "isc-grant"),
    ("cc-by-nc-sa", "CC-BY-NC-SA-4.0", "noncommercial", "ccbyncsa-licensed"),
    ("cc-by-nc", "CC-BY-NC-4.0", "noncommercial", "ccbync-licensed"),
    ("cc-by-sa", "CC-BY-SA-4.0", "copyleft", "ccbysa-licensed"),
    ("cc-by", "CC-BY-4.0", "permissive", "ccby-licensed"),
    ("cc0", "CC0-1.0", "permissive", "cc0-licensed"),
    ("unlicense", "Unlicense", "permissive", "unlicense-free"),
    ("all-rights", "Proprietary", "proprietary", "all-rights"),
]
CUT = r"\n+|[.!?]+[ \t\r\n]+"
OTHER = "[^A-Za-z0-9]+"


# The reading of wrapped texts: cuts become \x01, single line feeds \x02. CUT and OTHER are those of the SQL, line by line.
HARD = r"(?<![.!?])[.!?]+[ \t\r\n]+|\n[^A-Za-z0-9]*\n"
ITEM = r"(^|\n)[^A-Za-z0-9\n]*?\(?(?:[0-9]{1,2}|[a-z])\)[ \t]+"
LINE = r"[\r\n]+"


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences, in order."""
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s, i)])
    plain = F.translate(F.coalesce(text, F.lit("")), "\x01\x02", "  ")
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, ITEM, "$1"), HARD, "\x01"), LINE, "\x02")
    normal = F.concat(F.lit("\x01"), F.lower(F.regexp_replace(cut, "[^A-Za-z0-9\x01\x02]+", " ")), F.lit("\x01"))
    any_of = "|".join(s.replace(" ", "(?: | ?\x02 ?)") for s in sorted(SENTENCES.values(), key=len, reverse=True))
    found = F.regexp_extract_all(normal, F.lit(f"[\x01\x02] ?({any_of})(?= ?[\x01\x02])"), F.lit(1))
    return F.transform(found, lambda s: F.element_at(known, F.regexp_replace(s, "[ \x02]+", " ")))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with sentence_ids, rules, licenses (arrays) and license_class; columns of these names are overwritten."""
    # Two steps, so that the cutting isn't repeated for each rule.
    out = docs.withColumn("sentence_ids", sentence_ids(F.col(text)))
    seq = F.concat(F.lit(" "), F.array_join("sentence_ids", "  "), F.lit(" "))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(n).alias("license"), F.lit(c).alias("kind"), F.lit(" " + "  ".join(ids.split(" ")) + " ").alias("ids")) for r, n, c, ids in RULES])
    start = F.struct(seq.alias("left"), F.array().cast("array<struct<rule:string,license:string,kind:string>>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["ids"])
        more = F.array(F.struct(rule["rule"], rule["license"], rule["kind"]))
        return F.struct(F.when(hit, F.replace(state["left"], rule["ids"], F.lit(" | "))).otherwise(state["left"]).alias("left"), F.when(hit, F.concat(state["found"], more)).otherwise(state["found"]).alias("found"))

    found = F.when(F.size("sentence_ids") > 0, F.aggregate(rules, start, step)["found"]).otherwise(F.array().cast("array<struct<rule:string,license:string,kind:string>>"))
    out = out.withColumn("__found", found)
    kinds = F.col("__found.kind")
    kind = F.coalesce(*[F.when(F.array_contains(kinds, k), F.lit(k)) for k in ("proprietary", "noncommercial", "copyleft", "permissive")], F.lit("none"))
    return out.withColumns({"rules": F.col("__found.rule"), "licenses": F.array_sort(F.array_distinct(F.col("__found.license"))), "license_class": kind}).drop("__found")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(docs_of(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("rules", ",").alias("rules"), F.array_join("licenses", ",").alias("licenses"), "license_class")


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({q(s)}, {q(i)})" for i, s in SENTENCES.items())
    steps = []
    for k, (_, _, _, ids) in enumerate(RULES):
        pattern = q(" " + "  ".join(ids.split(" ")) + " ")
        steps.append(f"r{k} AS (SELECT *, contains(left{k}, {pattern}) AS hit{k}, replace(left{k}, {pattern}, ' | ') AS left{k + 1} FROM {'base' if not k else f'r{k - 1}'})")
    n = len(RULES)
    rules = "concat_ws(','," + ", ".join(f"CASE WHEN hit{k} THEN {q(r[0])} END" for k, r in enumerate(RULES)) + ")"
    licences = sorted({r[1] for r in RULES})
    has = lambda p: " OR ".join(f"hit{k}" for k, r in enumerate(RULES) if p(r))
    names = "concat_ws(','," + ", ".join(f"CASE WHEN {has(lambda r, x=x: r[1] == x)} THEN {q(x)} END" for x in licences) + ")"
    kind = "CASE " + " ".join(f"WHEN {has(lambda r, x=x: r[2] == x)} THEN {q(x)}" for x in ("proprietary", "noncommercial", "copyleft", "permissive")) + " ELSE 'none' END"
    return f"""WITH known(sentence, id) AS (VALUES {known}),
parts AS (SELECT doc_id, rid, unnest(p) AS s, generate_subscripts(p, 1) AS pos FROM (SELECT doc_id, row_number() OVER () AS rid, regexp_split_to_array(coalesce(text, ''), '{CUT}') AS p FROM documents)),
ids AS (SELECT rid, list(k.id ORDER BY pos) AS ids FROM parts JOIN known k ON lower(trim(regexp_replace(s, '{OTHER}', ' ', 'g'))) = k.sentence GROUP BY rid),
base AS (SELECT d.doc_id, coalesce(len(ids), 0) AS n, coalesce(array_to_string(ids, ','), '') AS sentence_ids, ' ' || coalesce(array_to_string(ids, '  '), '') || ' ' AS left0 FROM (SELECT DISTINCT doc_id, rid FROM parts) d LEFT JOIN ids USING (rid)),
{", ".join(steps)}
SELECT doc_id, n::BIGINT AS n_sentences, sentence_ids, {rules} AS rules, {names} AS licenses, {kind} AS license_class FROM r{n - 1}"""


OP3_SQL = _sql()
