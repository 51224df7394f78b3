"""License scans by sentence rules, with DataFrame operations only.

A text is normalised: lower case, sentence ends (. ! ? ; : before white space or the end, and lines without letters or digits) as one
mark, single line breaks as another, runs of other characters than letters and digits as one space. A known licence sentence is found
where it stands between marks; within it any line may break, and marks may stand where its notice has sentence ends of its own. At one
place the longest sentence counts. The ordered identifiers are matched against ordered rules: a rule is a sequence of identifiers that
follow each other with at most ``GAP`` other sentences between two, the first rules are the most specific, and what a rule has matched
no later rule sees again.

The SQL finds sentences of one mark each by equality and matches rules by positions; on texts without wrapped lines inside a known
sentence, and without notices that hold sentence ends, it gives the same.

Defined results: null or empty text: no sentence, no licence (empty lists). A sentence that is repeated counts each time; a licence is
listed once, in the order of the rules. Repeated rows: each on its own. No documents: no rows. Whole texts are scanned, however long.
Columns sentence_ids and licences that docs has already are replaced, other columns are not touched.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Known sentences, normalised, by identifier. Public licence texts' own words.
SENTENCES = {
    "ccbync4": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "ccby4": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "ccbysa4": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "gpl3": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "gpl2": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "orlater": ["or at your option any later version", "either version 3 of the license or at your option any later version", "either version 2 of the license or at your option any later version"],
    "gplfree": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "apache2": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"],
    "apacheuse": ["you may not use this file except in compliance with the license"],
    "mitname": ["released under the mit license", "licensed under the mit license", "the mit license", "mit license"],
    "mitgrant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"],
    "bsdredist": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsdname": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "mpl2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "allrights": ["all rights reserved"],
}
#: Ordered rules: sequence of identifiers, licence.
RULES = [
    (("gplfree", "orlater"), "GPL-any-or-later"),
    (("gpl3", "orlater"), "GPL-3.0-or-later"),
    (("gpl2", "orlater"), "GPL-2.0-or-later"),
    (("bsdredist", "bsdname"), "BSD-3-Clause"),
    (("mitname", "mitgrant"), "MIT"),
    (("apache2", "apacheuse"), "Apache-2.0"),
    (("gplfree",), "GPL-any"),
    (("gpl3",), "GPL-3.0-only"),
    (("gpl2",), "GPL-2.0-only"),
    (("bsdredist",), "BSD-2-Clause"),
    (("mitgrant",), "MIT"),
    (("mitname",), "MIT"),
    (("apache2",), "Apache-2.0"),
    (("ccbync4",), "CC-BY-NC-4.0"),
    (("ccbysa4",), "CC-BY-SA-4.0"),
    (("ccby4",), "CC-BY-4.0"),
    (("mpl2",), "MPL-2.0"),
    (("allrights",), "All-Rights-Reserved"),
]
#: Other sentences that may stand between two of a rule.
GAP = 8
#: More known sentences, in the notices' own spelling; some hold sentence ends. Public licence texts' own words.
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
LGPL = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"
AGPL = GPL.replace("GNU General", "GNU Affero General")
EITHER = "{0} either version {1} of the License, or (at your option) any later version."
NOTICES = {
    "gplfree": [GPL],
    "gpl3later": [GPL + EITHER.format(",", 3), GPL + EITHER.format(";", 3)],
    "gpl2later": [GPL + EITHER.format(";", 2), GPL + EITHER.format(",", 2)],
    "gpl3this": [GPL + "; version 3.", GPL + "; version 3 of the License.", GPL + ", either version 3 of the License.", GPL + ", version 3."],
    "gpl2this": [GPL + "; version 2.", GPL + "; version 2 of the License.", GPL + ", either version 2 of the License.", GPL + ", version 2."],
    "lgpl21later": [LGPL + EITHER.format(";", "2.1")],
    "lgpl3later": [LGPL + EITHER.format(";", 3), LGPL + EITHER.format(",", 3)],
    "agpl3later": [AGPL + EITHER.format(",", 3), AGPL + EITHER.format(";", 3)],
    "mitgrant": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
    ],
    "mitname": ["Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at https://opensource.org/licenses/MIT."],
    "bsdstyle": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "apache2": ['The ASF licenses this file to You under the Apache License, Version 2.0 (the "License");', "Licensed under the Apache License 2.0."],
    "isc": [f"Permission to use, copy, modify, {x} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies." for x in ("and", "and/or")],
    "zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "cc0": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.", "CC0 1.0 Universal license."],
    "epl2": [f"This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at {x}://www.eclipse.org/legal/epl-2.0" for x in ("http", "https")],
    "bsl1": ["Distributed under the Boost Software License, Version 1.0."],
    "wtfpl": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "mpl2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ccby4": ["This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "ccbysa4": ["This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "ccbync4": ["This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
}
#: Rules for identifiers that only NOTICES has; they go first.
NOTICE_RULES = [
    (("gpl3later",), "GPL-3.0-or-later"),
    (("gpl2later",), "GPL-2.0-or-later"),
    (("gpl3this",), "GPL-3.0-only"),
    (("gpl2this",), "GPL-2.0-only"),
    (("lgpl21later",), "LGPL-2.1-or-later"),
    (("lgpl3later",), "LGPL-3.0-or-later"),
    (("agpl3later",), "AGPL-3.0-or-later"),
    (("bsdstyle",), "BSD-3-Clause"),
    (("isc",), "ISC"),
    (("zlib",), "Zlib"),
    (("unlicense",), "Unlicense"),
    (("cc0",), "CC0-1.0"),
    (("epl2",), "EPL-2.0"),
    (("bsl1",), "BSL-1.0"),
    (("wtfpl",), "WTFPL"),
]
#: Names that a line "SPDX-License-Identifier: name" may give, besides those of the rules.
SPDX = ("LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "0BSD", "Artistic-2.0", "EUPL-1.2", "OFL-1.1", "CDDL-1.0", "PostgreSQL", "BlueOak-1.0.0")
#: Every known sentence has one of these.
HINT = "licen|rights|permitted|permission|redistribut|version|public domain"


def _tags() -> dict[str, str]:
    """Identifier of each SPDX line, and the licence that it names."""
    names = [n for _, n in NOTICE_RULES + RULES if "-any" not in n and n != "All-Rights-Reserved"]
    return {f"spdx.{n}": n for n in dict.fromkeys([*names, *SPDX])}


def _rules() -> list[tuple[tuple[str, ...], str]]:
    return [((i,), n) for i, n in _tags().items()] + NOTICE_RULES + RULES


def _known() -> dict[str, str]:
    return {s: k for k, many in SENTENCES.items() for s in many}


#: Steps of normalising lower-case text: pattern, replacement. \x01 marks a sentence's end, \x02 a line's.
STEPS = [
    (r"[\x01\x02]", " "),
    (r"\r\n", "\n"),
    (r"[.!?;:]+(?:[\x20\x09-\x0D]+|$)|[\x0A-\x0D][^a-z0-9]*[\x0A-\x0D]", "\x01"),
    (r"[\x0A-\x0D]", "\x02"),
    (r"[^a-z0-9\x01\x02]+", " "),
    (r" ?\x02 ?", "\x02"),
    (r"[ \x02]*\x01[ \x01\x02]*", "\x01"),
]


def _marked(text: str) -> str:
    """A known sentence as the operator's own steps normalise it."""
    text = text.lower()
    for pattern, to in STEPS:
        text = re.sub(pattern, to, text)
    return text.strip(" \x01\x02")


def _notices() -> dict[str, str]:
    """Each notice as normalised, with its marks, and its identifier."""
    return {_marked(n): k for k, many in NOTICES.items() for n in many} | {_marked(f"SPDX-License-Identifier: {n}"): i for i, n in _tags().items()}


def _sentences() -> dict[str, str]:
    """Plain text of each known sentence and its identifier."""
    return _known() | {m.replace("\x01", " "): k for m, k in _notices().items()}


def _pattern() -> str:
    """Any known sentence between marks, the longest first."""
    longest = sorted({*_known(), *_notices()}, key=lambda m: (-len(m), m))
    return "(?<=[\x01\x02])(?:" + "|".join(m.replace("\x01", "[ \x01\x02]").replace(" ", "[ \x02]").replace("[[ \x02]\x01\x02]", "[ \x01\x02]") for m in longest) + ")(?=[\x01\x02])"


def _framed(text: Column) -> Column:
    marked = F.lower(text)
    for pattern, to in STEPS:
        marked = F.regexp_replace(marked, pattern, to)
    return F.concat(F.lit("\x01"), F.trim(marked), F.lit("\x01"))


def identifiers(text: Column) -> Column:
    """The known sentences of a text in order: id, and apart (more than GAP other sentences stand before it)."""
    known = F.create_map(*[F.lit(x) for pair in _sentences().items() for x in pair])

    def found(framed: Column) -> Column:
        between = F.split(framed, _pattern(), -1)
        marks = lambda i: F.length(F.get(between, i)) - F.length(F.replace(F.get(between, i), F.lit("\x01"), F.lit("")))
        apart = lambda i: (i > 0) & (marks(i) - 1 > GAP)
        return F.transform(F.regexp_extract_all(framed, F.lit(_pattern()), F.lit(0)), lambda s, i: F.struct(F.element_at(known, F.translate(s, "\x01\x02", "  ")).alias("id"), apart(i).alias("apart")))

    # the normalised text is bound once, as the element of an array of one
    return F.when(F.lower(text).rlike(HINT), F.get(F.transform(F.array(_framed(text)), found), 0)).otherwise(F.array().cast("array<struct<id: string, apart: boolean>>"))


def scanned(docs: DataFrame) -> DataFrame:
    """docs with sentence_ids and licences (arrays)."""
    rules = F.array(*[F.struct(F.lit("".join(f",{i}," for i in ids)).alias("p"), F.lit(name).alias("n")) for ids, name in _rules()])
    found = F.coalesce(identifiers(F.col("text").cast("string")), F.array().cast("array<struct<id: string, apart: boolean>>"))
    none = F.array().cast("array<string>")

    def matched(found: Column) -> Column:
        # every identifier stands between two commas of its own, so neighbours share none and all occurrences of a rule are found
        line = F.array_join(F.transform(found, lambda x: F.concat(F.when(x["apart"], ",/,").otherwise(""), F.lit(","), x["id"], F.lit(","))), "")

        def step(a: Column, r: Column) -> Column:
            hit = F.instr(a["left"], r["p"]) > 0
            return F.struct(F.when(hit, F.replace(a["left"], r["p"], F.lit(",|,"))).otherwise(a["left"]).alias("left"), F.when(hit, F.concat(a["found"], F.array(r["n"]))).otherwise(a["found"]).alias("found"))

        names = F.aggregate(rules, F.struct(line.alias("left"), none.alias("found")), step, lambda a: a["found"])
        return F.struct(F.transform(found, lambda x: x["id"]).alias("ids"), F.when(F.size(found) > 0, F.array_distinct(names)).otherwise(none).alias("names"))

    both = F.get(F.transform(F.array(found), matched), 0)
    kept = docs.drop("sentence_ids", "licences")
    name = fresh("__found", kept.columns)
    out = kept.select("*", both.alias(name))
    return out.select(*[f"`{c}`" for c in kept.columns], F.col(f"{name}.ids").alias("sentence_ids"), F.col(f"{name}.names").alias("licences"))


def oracle(columns: str) -> str:
    """DuckDB SQL for the same scan of documents; columns may use doc_id, sentence_ids and licences (lists)."""
    known = "map {" + ", ".join(f"'{s}': '{k}'" for s, k in (_known() | {m: k for m, k in _notices().items() if "\x01" not in m}).items()) + "}"
    text = "lower(coalesce(text, ''))"
    for pattern, to in STEPS:
        escape = lambda x: x.replace("\x01", "\\x01").replace("\x02", "\\x02").replace("\r", "\\r").replace("\n", "\\n")
        text = f"regexp_replace({text}, '{escape(pattern)}', {_chr(to)}, 'g')"
    units = f"list_filter(list_transform(string_split({text}, chr(1)), lambda s: trim(s)), lambda s: s <> '')"
    ids = f"flatten(list_transform(units, lambda s, p: list_filter(list_transform(string_split(s, chr(2)), lambda u: {{'id': {known}[trim(u)], 'p': p}}), lambda x: x.id is not null)))"
    steps, last = [], "s"
    for i, (rule, _) in enumerate(_rules()):
        # places where the rule's identifiers stand in order, none of them too far from the one before
        here = " and ".join([f"l{i}[j] = '{rule[0]}'"] + [f"coalesce(l{i}[j + {d}] = '{x}' and spot[j + {d}] - spot[j + {d - 1}] - 1 <= {GAP}, false)" for d, x in enumerate(rule[1:], 1)])
        steps.append(f"r{i} as materialized (select *, list_filter(range(1, len(l{i}) + 1), lambda j: {here}) as h{i}, list_transform(l{i}, lambda x, j: case when {' or '.join(f'list_contains(h{i}, j - {d})' for d in range(len(rule)))} then '|' else x end) as l{i + 1} from {last})")
        last = f"r{i}"
    found = "list_filter([" + ", ".join(f"case when len(h{i}) > 0 then '{name}' end" for i, (_, name) in enumerate(_rules())) + "], lambda x: x is not null)"
    return f"with d as (select doc_id, {units} as units from documents), t as (select doc_id, {ids} as ids from d), s as (select doc_id, list_transform(ids, lambda x: x.id) as sentence_ids, list_transform(ids, lambda x: x.p) as spot, sentence_ids as l0 from t), {', '.join(steps)}, u as (select doc_id, sentence_ids, {found} as all_ from {last}), v as (select doc_id, sentence_ids, list_filter(all_, lambda x, i: list_position(all_, x) = i) as licences from u) select {columns} from v"


def _chr(s: str) -> str:
    """SQL for a replacement, whose control characters are written as chr()."""
    return {"\x01": "chr(1)", "\x02": "chr(2)", "\n": "chr(10)"}.get(s, f"'{s}'")
