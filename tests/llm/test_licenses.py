import re
import textwrap

from pyspark.sql import functions as F

from lexicept.llm import licenses, queries


def found(spark, *texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [tuple(r)[1:] for r in licenses.digest(licenses.scan(docs)).orderBy("doc_id").collect()]


def test_lines_and_rules(spark):
    got = found(
        spark, None, "", "no terms here", "Intro.\nReleased under the MIT License.\nbye", "All rights reserved.\nLicensed under CC BY-NC 4.0.",
        "word word\nThis work is licensed under the GNU General Public License, version 3.", "a license that nobody knows",
    )
    assert got[:3] == [(0, "", "", "")] * 3
    assert got[3] == (1, "mit_line", "MIT", "permissive")
    assert got[4] == (2, "all_rights,cc_by_nc_line", "CC-BY-NC-4.0,Proprietary", "noncommercial,proprietary")
    assert got[5][2] == "GPL-3.0-only"
    assert got[6] == (0, "", "", "")


def test_wrapped_texts_and_sequences(spark):
    bsd = [licenses.SENTENCES[k] for k in ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")]
    wrap = lambda s: "\n".join(re.findall(r".{1,60}(?:\s|$)", s))
    three, two, none = (". ".join(x) + "." for x in (bsd, bsd[:3], bsd[:2]))
    swapped = ". ".join([bsd[2], bsd[1], bsd[0]]) + "."
    got = found(spark, wrap(three), two, none, swapped, f"{bsd[0]}. something else. {bsd[1]}. All rights reserved. {bsd[2]}.")
    assert [g[2] for g in got] == ["BSD-3-Clause", "BSD-2-Clause", "", "", "BSD-2-Clause,Proprietary"]


def test_every_sentence_has_a_marker_and_a_rule():
    used = {i for _, _, ids in licenses.RULES for i in ids}
    for k, s in licenses.SENTENCES.items():
        assert re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", s)
        assert re.search(licenses.MARKERS, s)
    assert used <= set(licenses.SENTENCES)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT License.", 1), (1, "Released under the MIT License.", 1), (None, "x " * 200_000 + "\nAll rights reserved.", 2)],
                                 "doc_id long, text string, License int")
    out = licenses.digest(licenses.scan(docs)).collect()
    assert [r["licenses"] for r in out] == ["MIT", "MIT", "Proprietary"]
    assert licenses.digest(licenses.scan(docs.limit(0))).count() == 0


def test_query_plan_is_native(spark, sf_small):
    plan = queries.op3_licenses(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


MIT = """Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM."""
APACHE = """Copyright 2020 Jane Doe

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """Copyright (C) 2020 Jane Doe

This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
GPL2 = GPL.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
GENUINE = {"MIT": [MIT], "Apache-2.0": [APACHE, APACHE.replace("http:", "https:")],
           "GPL-3.0-or-later": [GPL, GPL2.replace("version 2", "version 3")], "GPL-2.0-or-later": [GPL2, GPL2.replace("Foundation; ", "Foundation, ")]}


def wrapped(text, start="", width=70):
    return "\n\n".join("\n".join(start + x for x in textwrap.wrap(p, width, break_on_hyphens=False)) for p in text.split("\n\n"))


def test_genuine_texts(spark):
    texts = [(name, t, form(t)) for name, ts in GENUINE.items() for t in ts for form in (str, wrapped, lambda t: wrapped(t, "# "), lambda t: wrapped(t, "", 45))]
    assert [g[2] for g in found(spark, *[x for _, _, x in texts])] == [name for name, _, _ in texts]


def test_long_rules_match_genuine_texts(spark):
    bodies = [x for ts in GENUINE.values() for t in ts for x in (t, t.split("\n\n", 1)[1])]  # with and without the copyright line
    texts = bodies + [wrapped(t) for t in bodies] + ["MIT License\n\n" + MIT]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    cuts = docs.select(*[licenses._matched(licenses._sequence(F.col("text"), w)) for w in (False, True)]).collect()
    seen = {licenses.RULES[i - 1][2] for row in cuts for c in row for i in c}
    for ids in (("apache_grant", "apache_use", "apache_copy_asis", "apache_see"), ("apache_grant", "apache_use", "apache_copys_asis", "apache_see"),
                ("apache_use", "apache_copy_asis", "apache_see"), ("apache_use", "apache_copys_asis", "apache_see"),
                ("apache_grant", "apache_use", "apache_at", "apache_url", "apache_asis", "apache_see"),
                ("apache_grant", "apache_use", "apache_at", "apache_urls", "apache_asis", "apache_see"),
                ("mit_name", "mit_grant", "mit_notice", "mit_asis"), ("mit_grant", "mit_notice", "mit_asis"), ("mit_notice", "mit_asis"), ("gpl3_terms", "gpl_hope", "gpl_even", "gpl_copy"),
                ("gpl_terms", "gpl3_either", "gpl_hope", "gpl_even", "gpl_copy"), ("gpl2_terms", "gpl_hope", "gpl_even", "gpl_copy"),
                ("gpl_terms", "gpl2_either", "gpl_hope", "gpl_even", "gpl_copy")):
        assert ids in seen


def test_markers_do_not_depend_on_spacing(spark):
    texts = ["All rights\nreserved.", "x. All rights  reserved.", "All rights-reserved.", "All\nrights\u00a0reserved.", "Tables are reserved."]
    assert [g[2] for g in found(spark, *texts)] == ["Proprietary"] * 4 + [""]
    assert re.fullmatch("[a-z0-9|]+", licenses.MARKERS)


LGPL = GPL.replace("GNU General", "GNU Lesser General").replace("program is free", "library is free")
MORE = {
    "ISC": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE."""],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "LGPL-3.0-or-later": [LGPL, LGPL.replace("Foundation, ", "Foundation; ")],
    "LGPL-2.1-or-later": [LGPL.replace("version 3", "version 2.1"), LGPL.replace("Foundation, either version 3", "Foundation; either version 2.1")],
    "AGPL-3.0-or-later": [GPL.replace("GNU General", "GNU Affero General")],
    "Unlicense": ["This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software."],
    "CC0-1.0": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."],
}


def test_more_genuine_texts(spark):
    texts = [(name, form(t)) for name, ts in MORE.items() for t in ts for form in (str, wrapped, lambda t: wrapped(t, "", 45))]
    assert [g[2] for g in found(spark, *[x for _, x in texts])] == [name for name, _ in texts]


def test_spdx_lines(spark):
    names = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
             "LGPL-2.1-or-later", "AGPL-3.0-or-later", "CC0-1.0", "Unlicense"]
    texts = [f"#!/bin/sh\n{mark} SPDX-License-Identifier: {n} {end}\nint x;" for n in names for mark, end in (("//", ""), ("/*", "*/"), ("#", ""))]
    assert [g[2] for g in found(spark, *texts)] == [n for n in names for _ in range(3)]
    assert [g[2] for g in found(spark, "Copyright. Geh mit. Apache 2.0.", "SPDX-License-Identifier: Unknown-1.0")] == ["", ""]


def test_one_verdict_per_passage(spark):
    bsd = [licenses.SENTENCES[k] for k in ("bsd_grant", "bsd_source", "bsd_binary")]
    for end in ("bsd_endorse", "bsd_endorse_owner"):
        last = "\n".join(re.findall(r".{1,60}(?:\s|$)", licenses.SENTENCES[end]))
        three = "\n".join(f"{x}." for x in [*bsd, last])  # only the last clause is wrapped
        assert [g[2] for g in found(spark, three)] == ["BSD-3-Clause"]
