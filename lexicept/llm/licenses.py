"""License scans by sentence-rule recognition. DataFrame and SQL functions only.

A text is cut into sentences, once with line ends as sentence ends and once
with line ends as spaces (wrapped license texts). Sentences are normalised
(lower case, letters and digits, single spaces) and looked up among known
licence sentences; what is left is the ordered sequence of sentence
identifiers. Ordered rules are then matched against that sequence: a rule is
a sequence of identifiers, other identifiers may stand between them, and a
rule consumes what it matches, so that a later, more general rule does not
claim the same sentences.

Everything is row-local: no shuffle, no join. Texts without any of the words
that every known sentence has one of are passed over.

A rule that one cut matches gives way to a fuller rule (all its identifiers
and more) that only the other cut completes, so a wrapped clause does not add
a second licence.

Defined cases: null and empty texts have no sentences and no licence;
repeated rows get equal results; sentences split over several lines are found
by the second cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_struct

# Known licence sentences, normalised, by identifier, as the two cuts yield them from the licence texts. A
# licence whose text comes out differently (wrapped or one line a paragraph, ';' or ',') has one identifier for each form.
# A copyright line before the first sentence has no sentence end and is joined to it by the second cut: such licences also
# have a rule without their first sentence.
SENTENCES = {
    "all_rights": "all rights reserved",
    "apache_line": "licensed under the apache license version 2 0",
    "apache_grant": "licensed under the apache license version 2 0 the license",
    "apache_use": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache_at": "you may obtain a copy of the license at",
    "apache_url": "http www apache org licenses license 2 0",
    "apache_urls": "https www apache org licenses license 2 0",
    "apache_asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_copy_asis": "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_copys_asis": "you may obtain a copy of the license at https www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_see": "see the license for the specific language governing permissions and limitations under the license",
    "mit_line": "released under the mit license",
    "mit_line2": "licensed under the mit license",
    "mit_name": "mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_endorse_owner": "neither the name of the copyright owner nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc_asis": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "mpl_subject": "this source code form is subject to the terms of the mozilla public license v",
    "lgpl_terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "lgpl3_terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21_terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl21_either": "either version 2 1 of the license or at your option any later version",
    "agpl_terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "agpl3_terms": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "unlicense_free": "this is free and unencumbered software released into the public domain",
    "cc0_law": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "spdx_mit": "spdx license identifier mit",
    "spdx_apache": "spdx license identifier apache 2 0",
    "spdx_bsd2": "spdx license identifier bsd 2 clause",
    "spdx_bsd3": "spdx license identifier bsd 3 clause",
    "spdx_isc": "spdx license identifier isc",
    "spdx_mpl": "spdx license identifier mpl 2 0",
    "spdx_gpl2": "spdx license identifier gpl 2 0 only",
    "spdx_gpl2_later": "spdx license identifier gpl 2 0 or later",
    "spdx_gpl3": "spdx license identifier gpl 3 0 only",
    "spdx_gpl3_later": "spdx license identifier gpl 3 0 or later",
    "spdx_lgpl21_later": "spdx license identifier lgpl 2 1 or later",
    "spdx_agpl3_later": "spdx license identifier agpl 3 0 or later",
    "spdx_cc0": "spdx license identifier cc0 1 0",
    "spdx_unlicense": "spdx license identifier unlicense",
    "gpl3_line": "this work is licensed under the gnu general public license version 3",
    "gpl2_line": "this work is licensed under the gnu general public license version 2",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl3_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl3_either": "either version 3 of the license or at your option any later version",
    "gpl2_either": "either version 2 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl_even": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_copy": "you should have received a copy of the gnu general public license along with this program",
    "cc_by_line": "licensed under cc by 4 0",
    "cc_by_sa_line": "licensed under cc by sa 4 0",
    "cc_by_nc_line": "licensed under cc by nc 4 0",
    "cc_by_long": "this work is licensed under a creative commons attribution 4 0 international license",
    "public_domain": "this work is released into the public domain without copyright",
}
# Fixed values: (licence, class, identifier sequence), in the order in which rules are tried.
RULES = (
    ("Apache-2.0", "permissive", ("apache_grant", "apache_use", "apache_copy", "apache_asis", "apache_see")),
    ("Apache-2.0", "permissive", ("apache_grant", "apache_use", "apache_copy_asis", "apache_see")),
    ("Apache-2.0", "permissive", ("apache_grant", "apache_use", "apache_copys_asis", "apache_see")),
    ("Apache-2.0", "permissive", ("apache_use", "apache_copy_asis", "apache_see")),
    ("Apache-2.0", "permissive", ("apache_use", "apache_copys_asis", "apache_see")),
    ("Apache-2.0", "permissive", ("apache_grant", "apache_use", "apache_at", "apache_url", "apache_asis", "apache_see")),
    ("Apache-2.0", "permissive", ("apache_grant", "apache_use", "apache_at", "apache_urls", "apache_asis", "apache_see")),
    ("BSD-3-Clause", "permissive", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-3-Clause", "permissive", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse_owner")),
    ("BSD-2-Clause", "permissive", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("ISC", "permissive", ("isc_grant", "isc_asis")),
    ("LGPL-3.0-or-later", "copyleft", ("lgpl3_terms",)),
    ("LGPL-3.0-or-later", "copyleft", ("lgpl_terms", "gpl3_either")),
    ("LGPL-2.1-or-later", "copyleft", ("lgpl21_terms",)),
    ("LGPL-2.1-or-later", "copyleft", ("lgpl_terms", "lgpl21_either")),
    ("AGPL-3.0-or-later", "copyleft", ("agpl3_terms",)),
    ("AGPL-3.0-or-later", "copyleft", ("agpl_terms", "gpl3_either")),
    ("GPL-3.0-or-later", "copyleft", ("gpl_free", "gpl_warranty", "gpl_copy")),
    ("GPL-3.0-or-later", "copyleft", ("gpl3_terms", "gpl_hope", "gpl_even", "gpl_copy")),
    ("GPL-3.0-or-later", "copyleft", ("gpl_terms", "gpl3_either", "gpl_hope", "gpl_even", "gpl_copy")),
    ("GPL-2.0-or-later", "copyleft", ("gpl2_terms", "gpl_hope", "gpl_even", "gpl_copy")),
    ("GPL-2.0-or-later", "copyleft", ("gpl_terms", "gpl2_either", "gpl_hope", "gpl_even", "gpl_copy")),
    ("MIT", "permissive", ("mit_name", "mit_grant", "mit_notice", "mit_asis")),
    ("MIT", "permissive", ("mit_grant", "mit_notice", "mit_asis")),
    ("MIT", "permissive", ("mit_grant", "mit_asis")),
    ("MIT", "permissive", ("mit_notice", "mit_asis")),
    ("Apache-2.0", "permissive", ("apache_grant",)),
    ("Apache-2.0", "permissive", ("apache_line",)),
    ("MIT", "permissive", ("mit_line",)),
    ("MIT", "permissive", ("mit_line2",)),
    ("MIT", "permissive", ("mit_name",)),
    ("GPL-3.0-only", "copyleft", ("gpl3_line",)),
    ("GPL-2.0-only", "copyleft", ("gpl2_line",)),
    ("GPL-3.0-or-later", "copyleft", ("gpl_free",)),
    ("GPL-3.0-or-later", "copyleft", ("gpl3_terms",)),
    ("GPL-3.0-or-later", "copyleft", ("gpl_terms", "gpl3_either")),
    ("GPL-2.0-or-later", "copyleft", ("gpl2_terms",)),
    ("GPL-2.0-or-later", "copyleft", ("gpl_terms", "gpl2_either")),
    ("CC-BY-NC-4.0", "noncommercial", ("cc_by_nc_line",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc_by_sa_line",)),
    ("CC-BY-4.0", "permissive", ("cc_by_line",)),
    ("CC-BY-4.0", "permissive", ("cc_by_long",)),
    ("ISC", "permissive", ("isc_grant",)),
    ("MPL-2.0", "copyleft", ("mpl_subject",)),
    ("Unlicense", "permissive", ("unlicense_free",)),
    ("CC0-1.0", "permissive", ("cc0_law",)),
    ("MIT", "permissive", ("spdx_mit",)),
    ("Apache-2.0", "permissive", ("spdx_apache",)),
    ("BSD-2-Clause", "permissive", ("spdx_bsd2",)),
    ("BSD-3-Clause", "permissive", ("spdx_bsd3",)),
    ("ISC", "permissive", ("spdx_isc",)),
    ("MPL-2.0", "copyleft", ("spdx_mpl",)),
    ("GPL-2.0-only", "copyleft", ("spdx_gpl2",)),
    ("GPL-2.0-or-later", "copyleft", ("spdx_gpl2_later",)),
    ("GPL-3.0-only", "copyleft", ("spdx_gpl3",)),
    ("GPL-3.0-or-later", "copyleft", ("spdx_gpl3_later",)),
    ("LGPL-2.1-or-later", "copyleft", ("spdx_lgpl21_later",)),
    ("AGPL-3.0-or-later", "copyleft", ("spdx_agpl3_later",)),
    ("CC0-1.0", "permissive", ("spdx_cc0",)),
    ("Unlicense", "permissive", ("spdx_unlicense",)),
    ("Public-Domain", "permissive", ("public_domain",)),
    ("Proprietary", "proprietary", ("all_rights",)),
)
#: Every known sentence holds one of these; parts of single words, because they are searched before white space and marks are normalised.
MARKERS = "licen|copyright|reserved|warrant|redistribut|permission|unencumbered"
#: For each rule the ranks of the rules with all its identifiers and more.
FULLER = tuple(tuple(i for i, (_, _, more) in enumerate(RULES, 1) if set(ids) < set(more)) for _, _, ids in RULES)
SENTENCE_END = r"[.!?;:]+(?:\s+|$)"
#: The colon of an SPDX line does not end a sentence.
SPDX_TAG = "spdx-license-identifier"


def rule_pattern(ids: tuple[str, ...]) -> str:
    """The rule as a pattern over '|id|id|...|'; what stands between its identifiers is captured."""
    return r"\|" + r"\|((?:[a-z0-9_|]*?\|)??)".join(ids) + r"\|"


def occurs(ids: tuple[str, ...]) -> str:
    """Whether the identifiers occur in this order at all, without going back: each part takes its first place for good."""
    return rf"^(?>[a-z0-9_|]*?\|{ids[0]}\|)" + "".join(rf"(?>(?:[a-z0-9_|]*?\|)??{i}\|)" for i in ids[1:])


def _kept(ids: tuple[str, ...]) -> str:
    return "|" + "".join(f"${i}" for i in range(1, len(ids)))


def sentences(text: Column, wrapped: bool) -> Column:
    """Normalised sentences; ``wrapped`` takes line ends as spaces."""
    t = F.replace(F.lower(text), F.lit(f"{SPDX_TAG}:"), F.lit(SPDX_TAG))
    if wrapped:
        t = F.regexp_replace(t, r"\s+", " ")
    t = F.regexp_replace(t, SENTENCE_END, "\n")
    return F.transform(F.split(t, "\n"), lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))


def _sequence(text: Column, wrapped: bool) -> Column:
    known = F.create_map(*[F.lit(x) for k, v in SENTENCES.items() for x in (v, k)])
    hits = F.filter(sentences(text, wrapped), lambda s: s.isin(*SENTENCES.values()))
    return F.transform(hits, lambda s: F.element_at(known, s))


def _matched(sequence: Column) -> Column:
    """Ranks (from 1) of the rules that match the sequence, each tried on what earlier rules left."""
    rules = F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(occurs(ids)).alias("there"), F.lit(rule_pattern(ids)).alias("p"), F.lit(_kept(ids)).alias("rest"))
        for i, (_, _, ids) in enumerate(RULES, 1)
    ])
    start = F.struct(
        F.concat(F.lit("|"), F.array_join(F.transform(sequence, lambda s: F.concat(s, F.lit("|"))), "")).alias("seq"),
        F.array().cast("array<int>").alias("found"),
    )
    return F.aggregate(
        rules, start,
        lambda acc, r: F.when(
            F.rlike(acc["seq"], r["there"]),
            F.struct(F.regexp_replace(acc["seq"], r["p"], r["rest"]).alias("seq"), F.concat(acc["found"], F.array(r["rank"])).alias("found")),
        ).otherwise(acc),
        lambda acc: acc["found"],
    )


def _not_fuller(found: Column, other: Column) -> Column:
    """Rules of one cut without those of which the other cut has a fuller rule in their place."""
    fuller = F.array(*[F.array(*[F.lit(i) for i in more]).cast("array<int>") for more in FULLER])
    return F.filter(found, lambda k: F.array_contains(other, k) | ~F.arrays_overlap(F.element_at(fuller, k), other))


def scan(docs: DataFrame, text_col: str = "text", out_col: str = "license") -> DataFrame:
    """``docs`` with a struct column: sentence_ids (by lines), licenses (names, by rule order) and classes."""
    text = F.col(text_col)
    marked = F.lower(text).rlike(MARKERS)
    empty = F.array().cast("array<string>")
    by_line = F.when(marked, _sequence(text, False)).otherwise(empty)
    by_text = F.when(marked, _sequence(text, True)).otherwise(empty)
    cuts = add_struct(docs, out_col, F.struct(by_line.alias("by_line"), by_text.alias("by_text")))
    of_cut = lambda cut: F.when(F.size(f"{out_col}.{cut}") > 0, _matched(F.col(f"{out_col}.{cut}"))).otherwise(F.array().cast("array<int>")).alias(f"{cut}_rules")
    step = cuts.withColumn(out_col, F.struct(f"{out_col}.by_line", f"{out_col}.by_text", of_cut("by_line"), of_cut("by_text")))
    line, text_ = F.col(f"{out_col}.by_line_rules"), F.col(f"{out_col}.by_text_rules")
    names, classes = (F.array(*[F.lit(r[i]) for r in RULES]) for i in (0, 1))
    found = F.array_sort(F.array_union(_not_fuller(line, text_), _not_fuller(text_, line)))
    pick = lambda a: F.array_distinct(F.transform(found, lambda i: F.element_at(a, i)))
    return step.withColumn(out_col, F.struct(
        F.col(f"{out_col}.by_line").alias("sentence_ids"), pick(names).alias("licenses"), pick(classes).alias("classes")))


def digest(docs: DataFrame, id_col: str = "doc_id", license_col: str = "license") -> DataFrame:
    return docs.select(
        id_col, F.size(f"{license_col}.sentence_ids").cast("long").alias("n_license_sentences"),
        F.array_join(f"{license_col}.sentence_ids", ",").alias("sentence_ids"),
        F.array_join(f"{license_col}.licenses", ",").alias("licenses"),
        F.array_join(f"{license_col}.classes", ",").alias("classes"),
    )


def oracle_sql() -> str:
    """The digest of ``documents`` as DuckDB SQL, one step per rule."""
    known = ", ".join(f"('{k}', '{v}')" for k, v in SENTENCES.items())
    norm = "trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))"
    steps = [
        f"t AS (SELECT row_number() OVER () AS r, doc_id, replace(lower(text), '{SPDX_TAG}:', '{SPDX_TAG}') AS text FROM documents)",
        f"known(id, s) AS (VALUES {known})",
        f"cuts AS (SELECT r, 'line' AS how, string_split(regexp_replace(text, '{SENTENCE_END}', chr(10), 'g'), chr(10)) AS ss FROM t "
        f"UNION ALL SELECT r, 'text', string_split(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '{SENTENCE_END}', chr(10), 'g'), chr(10)) FROM t)",
        "ex AS (SELECT r, how, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM cuts)",
        f"hit AS (SELECT r, how, i, id FROM ex JOIN known ON known.s = {norm.replace('(s,', '(ex.s,')})",
        "q0 AS (SELECT r, how, '|' || string_agg(id || '|', '' ORDER BY i) AS seq, CAST([] AS INTEGER[]) AS found FROM hit GROUP BY r, how)",
    ]
    for i, (_, _, ids) in enumerate(RULES, 1):
        rest = "|" + "".join(f"\\{k}" for k in range(1, len(ids)))
        p = rule_pattern(ids)
        steps.append(
            f"q{i} AS (SELECT r, how, regexp_replace(seq, '{p}', '{rest}', 'g') AS seq, "
            f"CASE WHEN regexp_matches(seq, '{p}') THEN list_append(found, {i}) ELSE found END AS found FROM q{i - 1})"
        )
    fuller = ", ".join(f"({i}, {j})" for i, more in enumerate(FULLER, 1) for j in more)
    rules = ", ".join(f"({i}, '{n}', '{c}')" for i, (n, c, _) in enumerate(RULES, 1))
    steps += [
        f"rules(k, name, class) AS (VALUES {rules})",
        f"fuller(k, more) AS (VALUES {fuller})",
        f"f AS (SELECT r, how, unnest(found) AS k FROM q{len(RULES)})",
        "gone AS (SELECT a.r, a.how, a.k FROM f a JOIN fuller USING (k) JOIN f b ON b.r = a.r AND b.how <> a.how AND b.k = more "
        "WHERE NOT EXISTS (SELECT 1 FROM f c WHERE c.r = a.r AND c.how <> a.how AND c.k = a.k))",
        "m AS (SELECT DISTINCT r, k FROM (SELECT r, how, k FROM f EXCEPT SELECT r, how, k FROM gone))",
        "names AS (SELECT r, name, min(k) AS k FROM m JOIN rules USING (k) GROUP BY r, name)",
        "classes AS (SELECT r, class, min(k) AS k FROM m JOIN rules USING (k) GROUP BY r, class)",
        "l AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY i) AS ids FROM hit WHERE how = 'line' GROUP BY r)",
        "ns AS (SELECT r, string_agg(name, ',' ORDER BY k) AS licenses FROM names GROUP BY r)",
        "cs AS (SELECT r, string_agg(class, ',' ORDER BY k) AS classes FROM classes GROUP BY r)",
    ]
    return (
        "WITH " + ", ".join(steps) + " SELECT doc_id, coalesce(n, 0) AS n_license_sentences, coalesce(ids, '') AS sentence_ids, "
        "coalesce(licenses, '') AS licenses, coalesce(classes, '') AS classes FROM t LEFT JOIN l USING (r) LEFT JOIN ns USING (r) LEFT JOIN cs USING (r)"
    )
