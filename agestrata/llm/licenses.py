"""License scans by sentence rules: normalised sentences are mapped to identifiers of known licence sentences, then the
sequence of identifiers is matched against ordered rules, each of which uses up the sentences it covers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agestrata.llm.shared import let, only, table

# How a notice names a licence.
VERBS = (
    "Licensed under", "Released under", "Distributed under", "Published under", "Available under", "This work is licensed under", "This project is licensed under", "This software is licensed under",
    "This program is licensed under", "This file is licensed under", "The code is licensed under",
)


def _notices(*names: str) -> list[str]:
    """The verbs before the names; names that don't say "license" follow only verbs that do."""
    return [f"{verb} {name}" for verb in VERBS for name in names if "licens" in f"{verb} {name}".lower()]


def _spdx(*ids: str) -> list[str]:
    return [f"SPDX-License-Identifier: {x}" for x in ids]


# Sentences of well-known licences and of notices that name them, and the identifier of each.
SENTENCES = {
    "ApacheNotice": [*_notices("the Apache License, Version 2.0", 'the Apache License, Version 2.0 (the "License")', "the Apache License 2.0", "the Apache 2.0 License"), *_spdx("Apache-2.0")],
    "ApacheCompliance": ["you may not use this file except in compliance with the License"],
    "ApacheCopy": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "ApacheAsIs": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "ApacheLimits": ["See the License for the specific language governing permissions and limitations under the License"],
    "MitNotice": [*_notices("the MIT License", "the MIT license (MIT)", "MIT license"), "The MIT License (MIT)", "MIT License", *_spdx("MIT")],
    "MitGrant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'],
    "MitKeep": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "MitNoWarranty": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'],
    "BsdGrant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BsdSource": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "BsdBinary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "BsdEndorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "BsdNoWarranty": ['THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED'],
    "BsdNotice": _notices("the BSD License", "a BSD-style license"),
    "Bsd2Notice": [*_notices("the BSD 2-Clause License", "the Simplified BSD License"), *_spdx("BSD-2-Clause")],
    "Bsd3Notice": [*_notices("the BSD 3-Clause License", "the New BSD License"), *_spdx("BSD-3-Clause")],
    "Gpl3Notice": [*_notices("the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GPLv3 license"), *_spdx("GPL-3.0-only", "GPL-3.0")],
    "Gpl2Notice": [*_notices("the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GPLv2 license"), *_spdx("GPL-2.0-only", "GPL-2.0")],
    "GplFree3": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", *_spdx("GPL-3.0-or-later")],
    "GplFree2": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", *_spdx("GPL-2.0-or-later")],
    "GplNoWarranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "GplSee": ["See the GNU General Public License for more details", "See the GNU Lesser General Public License for more details", "See the GNU Affero General Public License for more details"],
    "AgplFree3": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", *_spdx("AGPL-3.0-or-later")],
    "Agpl3Notice": [*_notices("the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0"), *_spdx("AGPL-3.0-only", "AGPL-3.0")],
    "LgplFree21": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", *_spdx("LGPL-2.1-or-later")],
    "LgplFree3": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", *_spdx("LGPL-3.0-or-later")],
    "Lgpl21Notice": [*_notices("the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1"), *_spdx("LGPL-2.1-only", "LGPL-2.1")],
    "Lgpl3Notice": [*_notices("the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0"), *_spdx("LGPL-3.0-only", "LGPL-3.0")],
    "MplNotice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", *_notices("the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0"), *_spdx("MPL-2.0")],
    "MplCopy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"],
    "IscGrant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "IscNoWarranty": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'],
    "IscNotice": [*_notices("the ISC License", "ISC license"), "ISC License", *_spdx("ISC")],
    "ZlibNoWarranty": ["This software is provided 'as-is', without any express or implied warranty"],
    "ZlibGrant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "ZlibNotice": [*_notices("the zlib License", "the zlib/libpng license"), *_spdx("Zlib")],
    "UnlicenseFree": ["This is free and unencumbered software released into the public domain"],
    "UnlicenseGrant": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "UnlicenseNotice": [*_notices("the Unlicense"), *_spdx("Unlicense")],
    "BoostGrant": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following'],
    "BoostNotice": [*_notices("the Boost Software License, Version 1.0"), "Boost Software License - Version 1.0", *_spdx("BSL-1.0")],
    "EplNotice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", *_notices("the Eclipse Public License 2.0", "the Eclipse Public License, Version 2.0"), *_spdx("EPL-2.0")],
    "Cc0Notice": [*_notices("CC0 1.0", "CC0 1.0 Universal", "a Creative Commons Zero 1.0 Universal License"), "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", *_spdx("CC0-1.0")],
    "CcByNotice": [*_notices("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"), *_spdx("CC-BY-4.0")],
    "CcByNcNotice": [*_notices("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"), *_spdx("CC-BY-NC-4.0")],
    "CcBySaNotice": [*_notices("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"), *_spdx("CC-BY-SA-4.0")],
    "CcByNcSaNotice": [*_notices("CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"), *_spdx("CC-BY-NC-SA-4.0")],
    "CcByNdNotice": [*_notices("CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"), *_spdx("CC-BY-ND-4.0")],
    "AllRights": ["All rights reserved"],
}
# Licences by the sequence of sentences that shows them; earlier rules go first. Other sentences may stand
# between those of a rule.
RULES = (
    ("Apache-2.0", ("ApacheNotice", "ApacheCompliance", "ApacheCopy", "ApacheAsIs", "ApacheLimits")),
    ("Apache-2.0", ("ApacheNotice", "ApacheAsIs", "ApacheLimits")),
    ("Apache-2.0", ("ApacheNotice",)),
    ("MIT", ("MitNotice", "MitGrant", "MitKeep", "MitNoWarranty")),
    ("MIT", ("MitGrant", "MitKeep", "MitNoWarranty")),
    ("MIT", ("MitGrant", "MitKeep")),
    ("MIT", ("MitNotice",)),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdNoWarranty")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdNoWarranty")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("BSD-2-Clause", ("Bsd2Notice",)),
    ("BSD-3-Clause", ("Bsd3Notice",)),
    ("BSD", ("BsdNotice",)),
    ("AGPL-3.0-or-later", ("AgplFree3", "GplNoWarranty", "GplSee")),
    ("AGPL-3.0-or-later", ("AgplFree3",)),
    ("LGPL-2.1-or-later", ("LgplFree21", "GplNoWarranty", "GplSee")),
    ("LGPL-2.1-or-later", ("LgplFree21",)),
    ("LGPL-3.0-or-later", ("LgplFree3", "GplNoWarranty", "GplSee")),
    ("LGPL-3.0-or-later", ("LgplFree3",)),
    ("GPL-3.0-or-later", ("GplFree3", "GplNoWarranty", "GplSee")),
    ("GPL-3.0-or-later", ("GplFree3",)),
    ("GPL-2.0-or-later", ("GplFree2", "GplNoWarranty", "GplSee")),
    ("GPL-2.0-or-later", ("GplFree2",)),
    ("GPL-3.0-only", ("Gpl3Notice",)),
    ("GPL-2.0-only", ("Gpl2Notice",)),
    ("AGPL-3.0-only", ("Agpl3Notice",)),
    ("LGPL-2.1-only", ("Lgpl21Notice",)),
    ("LGPL-3.0-only", ("Lgpl3Notice",)),
    ("MPL-2.0", ("MplNotice", "MplCopy")),
    ("MPL-2.0", ("MplNotice",)),
    ("ISC", ("IscGrant", "IscNoWarranty")),
    ("ISC", ("IscGrant",)),
    ("ISC", ("IscNotice",)),
    ("Zlib", ("ZlibNoWarranty", "ZlibGrant")),
    ("Zlib", ("ZlibNotice",)),
    ("Unlicense", ("UnlicenseFree", "UnlicenseGrant")),
    ("Unlicense", ("UnlicenseFree",)),
    ("Unlicense", ("UnlicenseNotice",)),
    ("BSL-1.0", ("BoostNotice", "BoostGrant")),
    ("BSL-1.0", ("BoostGrant",)),
    ("BSL-1.0", ("BoostNotice",)),
    ("EPL-2.0", ("EplNotice",)),
    ("CC0-1.0", ("Cc0Notice",)),
    ("CC-BY-NC-SA-4.0", ("CcByNcSaNotice",)),
    ("CC-BY-NC-4.0", ("CcByNcNotice",)),
    ("CC-BY-SA-4.0", ("CcBySaNotice",)),
    ("CC-BY-ND-4.0", ("CcByNdNotice",)),
    ("CC-BY-4.0", ("CcByNotice",)),
    ("Proprietary", ("AllRights",)),
)
#: Every known sentence holds one of these, so texts without any need no closer look. Each is inside one word, as words
#: of a raw text may be any white space and marks apart.
HINTS = "licens|permission|copyright|redistribut|warranty|reserved|software|governing|mozilla"
SPLIT = r"[.!?]+[\x20\x09-\x0D]+|[\x0A\x0D][^A-Za-z0-9\x0A\x0D]*[\x0A\x0D]"
#: A sentence that isn't known is cut further: after semicolons and colons, at line ends and before list marks.
_MARK = r"[^A-Za-z0-9\x0A\x0D]*[0-9A-Za-z]{1,2}[.)](?=[\x20\x09-\x0D])"
PIECE = rf"(?:[;:][\x20\x09-\x0D]+|[\x0A\x0D]+)(?:{_MARK})?|^{_MARK}"


def normal(s: str) -> str:
    """As the expressions below do it: ASCII letters, digits and dots inside words, single spaces."""
    s = re.sub(r"[^a-z0-9.]+", " ", s.lower())
    return re.sub(r"\.+( |$)", r"\1", re.sub(r"(^| )\.+", r"\1", s)).strip(" ")


def known() -> dict[str, str]:
    """Identifier by normalised sentence. A sentence that the splitter would cut is known by its longest piece."""
    out = {}
    for name, texts in SENTENCES.items():
        for t in texts:
            out[normal(max(re.split(SPLIT, t), key=len))] = name
    assert all(re.search(HINTS, s) for s in out)
    return out


def rule_pattern(rule: tuple[str, ...]) -> str:
    """Over identifiers written as <A><B>: those of the rule in order, others between."""
    return "(?:<[A-Za-z0-9]+>)*?".join(f"<{x}>" for x in rule)


def pieces_pattern(ids: dict[str, str]) -> str:
    """Over normalised pieces, one on each line: known sentences made of one or more whole pieces, the longest first."""
    return "(?:^|(?<=\n))(?:" + "|".join(re.escape(s).replace("\\ ", "[ \n]") for s in sorted(ids, key=lambda s: (-len(s), s))) + ")(?=\n|$)"


def _normal(c: Column) -> Column:
    c = F.regexp_replace(F.lower(c), r"[^a-z0-9.]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(^| )\.+", "$1"), r"\.+( |$)", "$1"))


def scan(docs: DataFrame) -> DataFrame:
    """For every row of docs: doc_id, sentences (identifiers in order, comma-joined), licenses (comma-joined, in order
    of the rules, each once), unmatched (identifiers that no rule used).

    Whole texts are cut at sentence ends and lines without letters; a sentence that isn't known as it stands, over line
    ends, is cut at semicolons, colons, line ends and list marks too, and known sentences are found in what consecutive
    pieces make up. Null, empty and other texts without a known sentence have empty lists; equal rows get equal rows; an empty
    table gives none; other columns are ignored.
    """
    ids = known()
    pattern = pieces_pattern(ids)
    lookup = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    sentences = F.split("text", SPLIT, -1)

    def named(s: Column) -> Column:
        whole = _normal(s)
        pieces = F.array_join(F.filter(F.transform(F.split(s, PIECE, -1), _normal), lambda x: x != ""), "\n")
        found = F.transform(F.regexp_extract_all(pieces, F.lit(pattern), 0), lambda x: F.translate(x, "\n", " "))
        return F.when(whole.isin(*ids), F.array(whole)).otherwise(found)

    hit = F.when(F.lower("text").rlike(HINTS), F.flatten(F.transform(sentences, named)))
    cut = only(docs, "doc_id", "text").select("doc_id", F.coalesce(hit, F.array().cast("array<string>")).alias("_found"))
    cut = cut.select("doc_id", F.transform("_found", lambda s: F.element_at(lookup, s)).alias("_ids"))
    written_as = F.concat_ws("", F.transform("_ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(rule_pattern(rule)).alias("pattern")) for name, rule in RULES])
    start = F.struct(written_as.alias("rest"), F.array().cast("array<string>").alias("names"))

    def apply(so_far: Column, rule: Column) -> Column:
        """The rule uses up what it matches; then its licence is found."""
        names = F.when(F.regexp_like(so_far["rest"], rule["pattern"]), F.array_union(so_far["names"], F.array(rule["name"]))).otherwise(so_far["names"])
        return F.struct(F.regexp_replace(so_far["rest"], rule["pattern"], F.lit("")).alias("rest"), names.alias("names"))

    none = F.struct(F.lit("").alias("rest"), F.array().cast("array<string>").alias("names"))
    out = cut.withColumn("_at", F.when(F.size("_ids") > 0, F.aggregate(rules, start, apply)).otherwise(none))
    return out.select(
        "doc_id",
        F.concat_ws(",", "_ids").alias("sentences"),
        F.concat_ws(",", "_at.names").alias("licenses"),
        F.regexp_count("_at.rest", F.lit("<")).cast("long").alias("unmatched"),
    )


def op4_sentence_rule_licenses(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same scan in SQL, one row for each sentence or run of pieces that is known, then one step for each rule."""
    norm = lambda c: rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9.]+', ' ', 'g'), '(^| )\.+', '\1', 'g'), '\.+( |$)', '\1', 'g'))"
    rows = ", ".join(f"('{s}', '{i}')" for s, i in known().items())
    steps, prev = [], "seq"
    for k, (name, rule) in enumerate(RULES):
        p = rule_pattern(rule)
        steps.append(f"r{k} as (select doc_id, sentences, found || case when regexp_matches(rest, '{p}') and not list_contains(found, '{name}') then ['{name}'] else [] end as found, regexp_replace(rest, '{p}', '', 'g') as rest from {prev})")
        prev = f"r{k}"
    # without looking around: line ends are doubled, so that a mark may use up the one behind it, and each piece stands
    # between line ends of its own
    piece = PIECE.replace("(?=[\\x20\\x09-\\x0D])", "[\\x20\\x09-\\x0D]")
    made = "\n(?:" + "|".join(re.escape(x).replace("\\ ", "(?: |\n\n)") for x in sorted(known(), key=lambda x: (-len(x), x))) + ")\n"
    split = f"regexp_split_to_array(regexp_replace(s, '[\\x0A\\x0D]', chr(10) || chr(10), 'g'), '{piece}')"
    return rf"""
with known(sentence, id) as (values {rows}),
cut as (select doc_id, unnest(regexp_split_to_array(text, '{SPLIT}')) as s, generate_subscripts(regexp_split_to_array(text, '{SPLIT}'), 1) as i
  from (select doc_id, lower(text) as text from documents) where regexp_matches(text, '{HINTS}')),
whole as (select doc_id, i, s, {norm("s")} as n from cut),
pieced as (select doc_id, i, array_to_string(list_transform(list_filter(list_transform({split}, lambda x: {norm("x")}), lambda x: x <> ''), lambda x: chr(10) || x || chr(10)), '') as s from whole where n not in (select sentence from known)),
found as (select doc_id, i, 1 as j, n as l from whole union all
  select doc_id, i, generate_subscripts(x, 1), unnest(x) from (select doc_id, i, regexp_extract_all(s, '{made}') as x from pieced)),
named as (select doc_id, i, j, id from found join known on sentence = trim(replace(l, chr(10) || chr(10), ' '), chr(10))),
per as (select doc_id, string_agg(id, ',' order by i, j) as sentences, string_agg('<' || id || '>', '' order by i, j) as rest from named group by doc_id),
seq as (select d.doc_id, coalesce(sentences, '') as sentences, cast([] as varchar[]) as found, coalesce(rest, '') as rest from documents d left join per on per.doc_id = d.doc_id),
{", ".join(steps)}
select doc_id, sentences, array_to_string(found, ',') as licenses, cast(length(rest) - length(replace(rest, '<', '')) as bigint) as unmatched from {prev}
"""


SQL = _sql()
