"""Licence scan by sentence rules, in DataFrame functions only.

A text is cut into sentences, the normalised sentences are mapped to the
identifiers of known licence sentences, and the sequence of identifiers is
matched against ordered rules. All of it is array expressions on one row:
no join, no shuffle, so sources and copies can't make a hot task.

Sentences and rules are parameters (``Rulebook``). The default covers notices
("licensed under the ..." and the like) of the licences in ``NAMES``, SPDX
lines with one identifier of ``SPDX``, the texts of MIT, BSD (two and three
clauses) and ISC, and the usual file headers of Apache-2.0, GPL, LGPL, AGPL,
MPL-2.0 and EPL-2.0. SPDX expressions (AND, OR, WITH), other licences and
reworded sentences are not recognised.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised licence sentences (lower case; letters, digits, '.', '+' and '-' kept; final '.' dropped).
SENTENCES = {
    1: "released under the mit license",
    2: "licensed under the mit license",
    3: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
       "documentation files the software to deal in the software without restriction including without limitation "
       "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
       "permit persons to whom the software is furnished to do so subject to the following conditions",
    4: "the above copyright notice and this permission notice shall be included in all copies or substantial "
       "portions of the software",
    5: "the software is provided as is without warranty of any kind express or implied including but not limited to "
       "the warranties of merchantability fitness for a particular purpose and noninfringement",
    6: "in no event shall the authors or copyright holders be liable for any claim damages or other liability "
       "whether in an action of contract tort or otherwise arising from out of or in connection with the software "
       "or the use or other dealings in the software",
    10: "licensed under the apache license version 2.0",
    11: "licensed under the apache license version 2.0 the license",
    12: "you may not use this file except in compliance with the license",
    13: "unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    14: "see the license for the specific language governing permissions and limitations under the license",
    20: "this work is licensed under the gnu general public license version 2",
    21: "this work is licensed under the gnu general public license version 3",
    22: "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 2 of the license or at your "
        "option any later version",
    23: "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version 3 of the license or at your "
        "option any later version",
    24: "this program is distributed in the hope that it will be useful but without any warranty without even the "
        "implied warranty of merchantability or fitness for a particular purpose",
    25: "see the gnu general public license for more details",
    26: "you should have received a copy of the gnu general public license along with this program",
    30: "licensed under cc by 4.0",
    31: "licensed under cc by-sa 4.0",
    32: "licensed under cc by-nc 4.0",
    33: "licensed under cc by-nc-sa 4.0",
    34: "licensed under cc0 1.0",
    40: "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
    41: "this is free and unencumbered software released into the public domain",
    42: "redistributions of source code must retain the above copyright notice this list of conditions and the following "
        "disclaimer",
    43: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution",
    44: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission",
    50: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation",
    51: "either version 2 of the license or at your option any later version",
    52: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation either version 3 of the license or at your option any later version",
    53: "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published "
        "by the free software foundation",
    54: "either version 2.1 of the license or at your option any later version",
    55: "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published "
        "by the free software foundation either version 3 of the license or at your option any later version",
    56: "you can redistribute it and or modify it under the terms of the gnu affero general public license as published "
        "by the free software foundation either version 3 of the license or at your option any later version",
    60: "this source code form is subject to the terms of the mozilla public license v",
    61: "this program and the accompanying materials are made available under the terms of the eclipse public license "
        "2.0 which is available at https www.eclipse.org legal epl-2.0",
    62: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
}
# Rule name, licence, ordered sentences.
RULES = [
    ("mit-release", "MIT", (1,)),
    ("mit-notice", "MIT", (2,)),
    ("mit-text", "MIT", (3, 4, 5, 6)),
    ("mit-grant", "MIT", (3, 4)),
    ("apache-release", "Apache-2.0", (10,)),
    ("apache-header", "Apache-2.0", (11, 12, 13, 14)),
    ("apache-short-header", "Apache-2.0", (11, 12)),
    ("gpl2-notice", "GPL-2.0", (20,)),
    ("gpl3-notice", "GPL-3.0", (21,)),
    ("gpl2-header", "GPL-2.0-or-later", (22, 24, 25)),
    ("gpl3-header", "GPL-3.0-or-later", (23, 24, 25)),
    ("gpl3-full-header", "GPL-3.0-or-later", (23, 24, 25, 26)),
    ("cc-by", "CC-BY-4.0", (30,)),
    ("cc-by-sa", "CC-BY-SA-4.0", (31,)),
    ("cc-by-nc", "CC-BY-NC-4.0", (32,)),
    ("cc-by-nc-sa", "CC-BY-NC-SA-4.0", (33,)),
    ("cc0", "CC0-1.0", (34,)),
    ("bsd-conditions", "BSD", (40,)),
    ("unlicense", "Unlicense", (41,)),
    ("bsd2-text", "BSD-2-Clause", (40, 42, 43)),
    ("bsd3-text", "BSD-3-Clause", (40, 42, 43, 44)),
    ("gpl2-split-header", "GPL-2.0-or-later", (50, 51)),
    ("gpl3-split-header", "GPL-3.0-or-later", (52,)),
    ("lgpl21-header", "LGPL-2.1-or-later", (53, 54)),
    ("lgpl3-header", "LGPL-3.0-or-later", (55,)),
    ("agpl3-header", "AGPL-3.0-or-later", (56,)),
    ("mpl2-header", "MPL-2.0", (60,)),
    ("epl2-header", "EPL-2.0", (61,)),
    ("isc-text", "ISC", (62,)),
]
# Names of licences in notices (normalised), and words of a notice before a name.
NAMES = [
    ("mit license", "MIT"),
    ("isc license", "ISC"),
    ("apache license 2.0", "Apache-2.0"),
    ("apache license version 2.0", "Apache-2.0"),
    ("bsd 2-clause license", "BSD-2-Clause"),
    ("bsd 3-clause license", "BSD-3-Clause"),
    ("mozilla public license 2.0", "MPL-2.0"),
    ("mozilla public license version 2.0", "MPL-2.0"),
    ("eclipse public license 2.0", "EPL-2.0"),
    ("gnu general public license version 2", "GPL-2.0"),
    ("gnu general public license version 3", "GPL-3.0"),
    ("gnu lesser general public license version 2.1", "LGPL-2.1"),
    ("gnu lesser general public license version 3", "LGPL-3.0"),
    ("gnu affero general public license version 3", "AGPL-3.0"),
]
NOTICES = ["licensed under the", "released under the", "distributed under the", "this project is licensed under the",
           "this software is licensed under the", "this work is licensed under the"]
# SPDX identifiers.
SPDX = ["MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "EPL-2.0", "GPL-2.0-only",
        "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
        "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense"]
#: Its colon ends no sentence.
SPDX_TAG = "SPDX-License-Identifier"
#: Every known sentence has one of these; other sentences are not normalised.
CUE = "[Ll][Ii][Cc][Ee][Nn][Ss][Ee]|[Cc][Cc]0|[Cc][Cc] [Bb][Yy]|[Ss][Oo][Ff][Tt][Ww][Aa][Rr][Ee]|[Pp][Rr][Oo][Gg]" \
      "[Rr][Aa][Mm]|[Rr][Ee][Dd][Ii][Ss][Tt][Rr][Ii][Bb][Uu][Tt]|[Ww][Aa][Rr][Rr][Aa][Nn][Tt]"
#: Sentence ends; a line end too (notices on one line), or only a blank line (texts wrapped over lines).
LINE_SPLIT = r"[.!?;:]+[\x20\x09-\x0D]+|[\x0A-\x0D]+"
WRAP_SPLIT = r"[.!?;:]+[\x20\x09-\x0D]+|\n[\x20\x09\x0D]*\n[\x20\x09-\x0D]*"


def _normalised(s: Column) -> Column:
    plain = F.translate(F.regexp_replace(s, r"[^A-Za-z0-9.+-]+", " "),
                        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(plain, r"^ +|[ .]+$", "")


@dataclass(frozen=True)
class Rulebook:
    """Known sentences (normalised sentence, identifier) and ordered rules (name, licence, identifiers).

    Several sentences may share an identifier. A sentence needs a match of
    ``CUE`` to be looked at, and so does the text that it stands in.
    """

    sentences: tuple[tuple[str, int], ...]
    rules: tuple[tuple[str, str, tuple[int, ...]], ...]

    def shadows(self, licence: str, ids: tuple[int, ...]) -> list[str]:
        """Longer rules of other licences that hold ``ids``, longest first: a BSD text of three clauses is not one of two."""
        return sorted({_joined(other) for _, x, other in self.rules
                       if x != licence and len(other) > len(ids) and _joined(ids) in _joined(other)}, key=lambda t: (-len(t), t))


def _joined(ids) -> str:
    return "|" + "|".join(map(str, ids)) + "|"


def default_rulebook() -> Rulebook:
    """The fixed sentences and rules, notices of all ``NAMES`` and SPDX lines."""
    known = {text: i for i, text in SENTENCES.items()}
    rules = list(RULES)
    for n, licence in enumerate(dict.fromkeys(x for _, x in NAMES)):
        for name in (name for name, x in NAMES if x == licence):
            for words in NOTICES:
                known.setdefault(f"{words} {name}", 100 + n)
        rules.append((f"notice-{licence}", licence, (100 + n,)))
    for n, licence in enumerate(SPDX):
        known[f"{SPDX_TAG.lower()} {licence.lower()}"] = 200 + n
        rules.append((f"spdx-{licence}", licence, (200 + n,)))
    return Rulebook(tuple(known.items()), tuple(rules))


def _identifiers(text: Column, split: str, book: Rulebook) -> Column:
    known = F.create_map(*[F.lit(x) for pair in book.sentences for x in pair])
    cued = F.filter(F.split(text, split), lambda s: s.rlike(CUE))
    return F.filter(F.transform(cued, lambda s: F.element_at(known, _normalised(s))), lambda i: i.isNotNull())


def _sequence(ids: Column) -> Column:
    return F.concat(F.lit("|"), F.array_join(ids.cast("array<string>"), "|"), F.lit("|"))


def _stands(sequence: Column, ids: tuple[int, ...], longer: list[str]) -> Column:
    for x in longer:
        sequence = F.replace(sequence, F.lit(x), F.lit("|"))
    return sequence.contains(_joined(ids))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  book: Rulebook | None = None) -> DataFrame:
    """(id_col, n_sentences, licenses, rules), one row per input row.

    A rule matches when its identifiers stand in order, with no other known
    licence sentence between them, in the sentences of the text (cut at line
    ends, or at blank lines only), outside of any longer rule of another
    licence that holds it. ``licenses``: distinct licences, sorted,
    and ``rules``: matched rules in their fixed order, both joined by commas.
    ``n_sentences``: known sentences, cut at line ends.

    Defined results: null, empty and other texts without a known sentence
    give 0 and empty strings; null ids pass; repeated rows are scanned
    alike; sentences that repeat count each time; extra columns are ignored;
    an empty table gives an empty result.
    """
    text = F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(SPDX_TAG + ":"), F.lit(SPDX_TAG))
    book = book or default_rulebook()
    matched = F.array_compact(F.array(*[
        F.when(_stands(F.col("_sa"), ids, longer) | _stands(F.col("_sb"), ids, longer),
               F.struct(F.lit(n).alias("rule"), F.lit(x).alias("license")))
        for n, x, ids in book.rules for longer in (book.shadows(x, ids),)]))
    d = docs.select(F.col(id_col).cast("long").alias(id_col), F.when(text.rlike(CUE), text).alias("_t"))
    d = d.withColumn("_a", F.when(F.col("_t").isNotNull(), _identifiers(F.col("_t"), LINE_SPLIT, book))) \
        .withColumn("_b", F.when(F.col("_t").isNotNull(), _identifiers(F.col("_t"), WRAP_SPLIT, book)))
    d = d.withColumn("_sa", _sequence(F.col("_a"))).withColumn("_sb", _sequence(F.col("_b")))
    d = d.withColumn("_m", F.when((F.size("_a") > 0) | (F.size("_b") > 0), matched))
    return d.select(
        id_col, F.coalesce(F.when(F.col("_a").isNotNull(), F.size("_a")), F.lit(0)).cast("long").alias("n_sentences"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform("_m", lambda r: r["license"]))), ","),
                   F.lit("")).alias("licenses"),
        F.coalesce(F.array_join(F.transform("_m", lambda r: r["rule"]), ","), F.lit("")).alias("rules"))


def oracle_sql() -> str:
    """The scan as DuckDB SQL, from the same fixed values."""
    book = default_rulebook()
    known = "MAP {" + ", ".join(f"'{s}': {i}" for s, i in book.sentences) + "}"

    def stands(column, ids, longer):
        for x in longer:
            column = f"replace({column}, '{x}', '|')"
        return f"contains({column}, '{_joined(ids)}')"

    rules = ", ".join(f"CASE WHEN {stands('sa', ids, longer)} OR {stands('sb', ids, longer)} "
                      f"THEN {{'rule': '{n}', 'license': '{x}'}} END"
                      for n, x, ids in book.rules for longer in (book.shadows(x, ids),))

    def ids(split):
        plain = "lower(regexp_replace(s, '[^A-Za-z0-9.+-]+', ' ', 'g'))"
        return (f"[i FOR i IN [{known}[regexp_replace({plain}, '^ +|[ .]+$', '', 'g')] "
                f"FOR s IN string_split_regex(t, '{split}') IF regexp_matches(s, '{CUE}')] IF i IS NOT NULL]")

    return f"""
WITH d AS (SELECT doc_id, replace(coalesce(text, ''), '{SPDX_TAG}:', '{SPDX_TAG}') AS t FROM documents),
s AS (SELECT doc_id, {ids(LINE_SPLIT)} AS a, {ids(WRAP_SPLIT)} AS b FROM d),
q AS (SELECT doc_id, len(a) AS n, '|' || array_to_string(a, '|') || '|' AS sa,
        '|' || array_to_string(b, '|') || '|' AS sb FROM s),
m AS (SELECT doc_id, n, [r FOR r IN [{rules}] IF r IS NOT NULL] AS m FROM q)
SELECT doc_id, n AS n_sentences, coalesce(array_to_string(list_sort(list_distinct([r.license FOR r IN m])), ','), '')
         AS licenses, coalesce(array_to_string([r.rule FOR r IN m], ','), '') AS rules FROM m
"""
