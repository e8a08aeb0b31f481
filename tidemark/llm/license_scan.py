"""Licence recognition by sentence rules. Native: SQL functions only, no shuffle.

A text is cut into sentences, at blank lines and at marks before white space.
Lines of a sentence are normalised (ASCII lower case, runs of other characters
than a-z and 0-9, comment marks among them, become one space), joined, and looked
up in a fixed table of licence sentences. A title may stand above a sentence
without a blank line, so the longest row of a sentence's last lines that is known
counts, and each line before it is looked up alone. The identifiers found, in
order, are matched against ordered rules: a rule is a row of identifiers, longer
rules come first, and what a rule has matched is taken out, so that the parts of
a full licence don't also count as a notice. Every row is judged on its own, so
no key can be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "mit-title": "The MIT License",
    "mit-title-mit": "MIT License",
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-is-licensed": "This project is licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "apache-licensed": "Licensed under the Apache License, Version 2.0",
    "apache-licensed-the": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-may-not": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl-redistribute-3": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-redistribute-2": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    "lgpl-redistribute-3": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-redistribute-3": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "version-2-later": "either version 2 of the License, or (at your option) any later version",
    "version-2.1-later": "either version 2.1 of the License, or (at your option) any later version",
    "version-3-later": "either version 3 of the License, or (at your option) any later version",
    "gpl-free": "This program is free software",
    "lgpl-free": "This library is free software",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-merchantability": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "bsd-use": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-nc-licensed": "Licensed under CC BY-NC 4.0",
    "cc-by-licensed": "Licensed under CC BY 4.0",
    "cc-by-sa-licensed": "Licensed under CC BY-SA 4.0",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "apache-title": "Apache License",
    "apache-title-version": "Version 2.0, January 2004",
    "boost-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "boost-distributed": "Distributed under the Boost Software License, Version 1.0",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "bsd-governed": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "isc-title": "ISC License",
    "cc0-title": "CC0 1.0 Universal",
    "cc0-dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "epl-available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "mpl-title": "Mozilla Public License Version 2.0",
    "gpl-title": "GNU GENERAL PUBLIC LICENSE",
    "lgpl-title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "title-version-2": "Version 2, June 1991",
    "title-version-3": "Version 3, 29 June 2007",
    "agpl-title-version-3": "Version 3, 19 November 2007",
    "lgpl-title-version-2.1": "Version 2.1, February 1999",
}

# Licence, and the identifiers that name it in this order.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("Apache-2.0", ["apache-licensed-the", "apache-may-not", "apache-copy", "apache-unless", "apache-see"]),
    ("BSD-3-Clause", ["bsd-use", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-use", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-redistribute-3"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-redistribute-2"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-redistribute", "version-2-later"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-redistribute", "version-3-later"]),
    ("LGPL-2.1-or-later", ["lgpl-free", "lgpl-redistribute", "version-2.1-later"]),
    ("AGPL-3.0-or-later", ["gpl-free", "agpl-redistribute-3"]),
    ("GPL-2.0-or-later", ["gpl-redistribute", "version-2-later"]),
    ("GPL-3.0-or-later", ["gpl-redistribute", "version-3-later"]),
    ("LGPL-2.1-or-later", ["lgpl-redistribute", "version-2.1-later"]),
    ("LGPL-3.0-or-later", ["lgpl-redistribute", "version-3-later"]),
    ("AGPL-3.0-or-later", ["agpl-redistribute", "version-3-later"]),
    ("GPL-2.0-only", ["gpl-title", "title-version-2"]),
    ("GPL-3.0-only", ["gpl-title", "title-version-3"]),
    ("LGPL-2.1-only", ["lgpl-title", "lgpl-title-version-2.1"]),
    ("LGPL-3.0-only", ["lgpl-title", "title-version-3"]),
    ("AGPL-3.0-only", ["agpl-title", "agpl-title-version-3"]),
    ("Apache-2.0", ["apache-title", "apache-title-version"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("ISC", ["isc-title", "isc-grant", "isc-as-is"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("MIT", ["mit-title"]),
    ("MIT", ["mit-title-mit"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-is-licensed"]),
    ("MIT", ["mit-grant"]),
    ("ISC", ["isc-grant"]),
    ("Apache-2.0", ["apache-licensed-the"]),
    ("Apache-2.0", ["apache-licensed"]),
    ("GPL-3.0-only", ["gpl3-work"]),
    ("GPL-3.0-or-later", ["gpl-redistribute-3"]),
    ("GPL-2.0-or-later", ["gpl-redistribute-2"]),
    ("LGPL-3.0-or-later", ["lgpl-redistribute-3"]),
    ("AGPL-3.0-or-later", ["agpl-redistribute-3"]),
    ("MPL-2.0", ["mpl-subject"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-licensed"]),
    ("CC-BY-4.0", ["cc-by-licensed"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-licensed"]),
    ("CC-BY-4.0", ["cc-by-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-work"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-work"]),
    ("Unlicense", ["unlicense"]),
    ("BSL-1.0", ["boost-title"]),
    ("BSL-1.0", ["boost-distributed"]),
    ("BSL-1.0", ["boost-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("BSD-3-Clause", ["bsd-governed"]),
    ("CC0-1.0", ["cc0-title"]),
    ("CC0-1.0", ["cc0-dedicated"]),
    ("EPL-2.0", ["epl-available"]),
    ("MPL-2.0", ["mpl-title"]),
]

# Licences that a line "SPDX-License-Identifier: <licence>" may name.
SPDX = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0",
    "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
]
SENTENCES |= {f"spdx-{x}": f"SPDX-License-Identifier {x}" for x in SPDX}
RULES += [(x, [f"spdx-{x}"]) for x in SPDX]

# A dot after a lone "v" and the colon of an SPDX line end no sentence; patterns are fit for Java and RE2.
JOINED = [(r"\b([vV])\.[ \t]+", "v "), (r"(?i)spdx-license-identifier:[ \t]*", "SPDX-License-Identifier ")]
BREAK = r"[.!?;:]+[ \t\r\n\f\v]+|[.!?;:]+$|\r?\n[^A-Za-z0-9\n]*\r?\n"
LINE = r"[\r\n]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(sentence: str) -> str:
    """What ``normalised`` makes of a sentence, in Python."""
    import re

    for pattern, by in JOINED:
        sentence = re.sub(pattern, by, sentence)
    return re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(" ")


KNOWN = {normal(text): name for name, text in SENTENCES.items()}
#: Words of the longest sentence; a row of more lines with words can't be one.
LONGEST = max(len(x.split(" ")) for x in KNOWN)


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9]+", " "))


def _pattern(ids: list[str]) -> str:
    return "".join(f"|{x}|" for x in ids)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the licence sentences and the licences found.

    ``sentence_ids`` and ``licenses`` are arrays, empty if nothing is found (as
    for null and empty texts); ``first_sentence`` is the place of the first
    licence sentence, null if there is none. A licence is named once for each
    rule that matched, in the order of the rules, without repeats. Repeated
    rows, null ids, long texts and other columns need no care: each row is
    judged alone. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    for pattern, by in JOINED:
        text = F.regexp_replace(text, pattern, by)
    lines = lambda s: F.filter(F.transform(F.split(s, LINE), normalised), lambda x: x != "")
    table = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    # a map is searched in sequence, a set of literals is hashed: only what is known is looked up
    known = lambda x: F.when(x.isin(list(KNOWN)), F.try_element_at(table, x))
    rules = F.array(*[F.struct(F.lit(_pattern(ids)).alias("ids"), F.lit(name).alias("name")) for name, ids in RULES])
    start = F.struct(F.col("_sequence").alias("rest"), F.array().cast("array<string>").alias("found"))
    found = F.aggregate(
        rules,
        start,
        lambda state, rule: F.when(
            F.contains(state["rest"], rule["ids"]),
            F.struct(
                F.replace(state["rest"], rule["ids"], F.lit("#")).alias("rest"),
                F.concat(state["found"], F.array(rule["name"])).alias("found"),
            ),
        ).otherwise(state),
        lambda state: F.array_distinct(state["found"]),
    )
    def names(own: Column) -> Column:
        """Identifiers of a sentence with these lines."""
        n = F.size(own)
        rows = F.transform(
            F.sequence(F.greatest(F.lit(1), n - LONGEST + 1), F.greatest(F.lit(1), n)),
            lambda i: F.struct(i.alias("at"), known(F.array_join(F.slice(own, i, F.greatest(n, F.lit(1))), " ")).alias("name")),
        )
        best = F.try_element_at(F.filter(rows, lambda x: x["name"].isNotNull()), F.lit(1))
        before = F.slice(own, F.lit(1), F.coalesce(best["at"] - 1, n))
        alone = F.transform(before, known)
        return F.filter(F.concat(alone, F.array(best["name"])), lambda x: x.isNotNull())

    cut = docs.select(F.col(id_col).alias("doc_id"), F.transform(F.split(text, BREAK, -1), lines).alias("_lines"))
    hits = cut.select("doc_id", F.transform("_lines", names).alias("_names"))
    placed = F.transform("_names", lambda x, i: F.transform(x, lambda name: F.struct(name.alias("name"), i.alias("place"))))
    hits = hits.select("doc_id", F.flatten(placed).alias("_hits"))
    return (
        hits.select("doc_id", F.col("_hits.name").alias("sentence_ids"), F.try_element_at("_hits", F.lit(1)).getField("place").cast("long").alias("first_sentence"))
        .withColumn("_sequence", F.array_join(F.transform("sentence_ids", lambda x: F.concat(F.lit("|"), x, F.lit("|"))), ""))
        .withColumn("licenses", F.when(F.size("sentence_ids") == 0, F.array().cast("array<string>")).otherwise(found))
        .drop("_sequence")
    )


def sql(table: str = "documents") -> str:
    """The digest of ``scan`` (lists joined by commas) in DuckDB's SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    joined = lambda x: f"regexp_replace(regexp_replace({x}, {quoted(JOINED[0][0])}, {quoted(JOINED[0][1])}, 'g'), {quoted(JOINED[1][0])}, {quoted(JOINED[1][1])}, 'g')"
    norm = lambda x: f"trim(regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    table_rows = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in SENTENCES.items())
    ctes, found = [], []
    for k, (name, ids) in enumerate(RULES):
        pattern = quoted(_pattern(ids))
        ctes.append(f"s{k + 1} AS (SELECT *, replace(r{k}, {pattern}, '#') AS r{k + 1}, contains(r{k}, {pattern}) AS f{k} FROM s{k})")
        found.append(f"CASE WHEN f{k} THEN {quoted(name)} END")
    last = len(RULES)
    return f"""
        WITH given(id, raw) AS (VALUES {table_rows}),
        known AS (SELECT map(list({norm(joined("raw"))} ORDER BY id), list(id ORDER BY id)) AS m FROM given),
        split AS (
            SELECT doc_id, list_transform(string_split_regex({joined("coalesce(text, '')")}, {quoted(BREAK)}),
                lambda s: list_filter(list_transform(string_split_regex(s, {quoted(LINE)}), lambda l: {norm("l")}), lambda l: l <> '')) AS sentences
            FROM {table}),
        named AS (
            SELECT doc_id, m, list_transform(sentences, lambda own: [own, [
                coalesce(list_filter(range(greatest(1, len(own) - {LONGEST - 1}), len(own) + 1),
                    lambda i: m[array_to_string(own[i:], ' ')] IS NOT NULL)[1], len(own) + 1)::VARCHAR]]) AS cut FROM split, known),
        hits AS (
            SELECT doc_id, list_transform(cut, lambda c: list_filter(
                list_transform(c[1][:(c[2][1]::INT - 1)], lambda l: m[l]) || [m[array_to_string(c[1][(c[2][1]::INT):], ' ')]], lambda x: x IS NOT NULL)) AS names FROM named),
        kept AS (
            SELECT doc_id, flatten(names) AS ids,
                   list_filter(list_transform(names, lambda x, i: CASE WHEN len(x) > 0 THEN i - 1 END), lambda i: i IS NOT NULL) AS places
            FROM hits),
        s0 AS (
            SELECT doc_id, ids, places, array_to_string(list_transform(ids, lambda x: '|' || x || '|'), '') AS r0 FROM kept),
        {", ".join(ctes)},
        judged AS (
            SELECT doc_id, ids, places, list_filter([{", ".join(found)}], lambda x: x IS NOT NULL) AS found FROM s{last})
        SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentence_ids,
               array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ',') AS licenses,
               CAST(places[1] AS BIGINT) AS first_sentence
        FROM judged"""
