"""Licence scan by sentence rules.

A text is taken apart into sentences, each normalised to its bare words. Sentences that a table knows
become the identifiers of that table; all others vanish. Sentences of standard licence texts that run
on, or over several lines, in comments too, are found first and put on a line of their own. The identifiers, in order, are then matched
against rules: a licence is found where the sentences of its rule follow one another. Longer rules win
over shorter ones that they contain.

Everything is a DataFrame expression or an equi-join. Only normalised sentences that hold a word of
the table's trigger list leave the scan, and the table of known sentences is a constant of this
module.

Defined results: null, empty and licence-free texts have no licence and empty lists; texts are read
whole; repeated sentences count as often as they stand there; rows repeat as they come, null keys
stay null; extra columns are left alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known sentences, normalised, with their identifiers.
SENTENCES: dict[str, str] = {
    "licensed under the apache license version 2 0": "apache-2.0-short",
    "licensed under the apache license version 2 0 the license": "apache-2.0-grant",
    "you may not use this file except in compliance with the license": "apache-2.0-comply",
    "you may obtain a copy of the license at": "apache-2.0-copy",
    "http www apache org licenses license 2 0": "apache-2.0-url",
    "released under the mit license": "mit-short",
    "licensed under the mit license": "mit-short",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind": "as-is",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0-short",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0-short",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3.0-or-later-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2.0-or-later-grant",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-no-warranty",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0-short",
    "licensed under cc by 4 0": "cc-by-4.0-short",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0-short",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0-short",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0-short",
    "this is free and unencumbered software released into the public domain": "unlicense-short",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl-2.1-or-later-grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl-3.0-or-later-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl-3.0-or-later-grant",
    "this library is distributed in the hope that it will be useful but without any warranty": "lgpl-no-warranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software": "bsl-1.0-grant",
    "distributed under the boost software license version 1 0": "bsl-1.0-short",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0": "epl-2.0-grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0": "epl-2.0-grant",
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law": "cc0-1.0-deed",
    "the author has waived all copyright and related or neighboring rights to this work": "cc0-1.0-waiver",
    "gnu general public license version 2 june 1991": "gpl-2.0-title",
    "gnu general public license version 3 29 june 2007": "gpl-3.0-title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl-2.1-title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl-3.0-title",
    "gnu affero general public license version 3 19 november 2007": "agpl-3.0-title",
    "apache license version 2 0 january 2004": "apache-2.0-title",
    "boost software license version 1 0 august 17th 2003": "bsl-1.0-title",
}
# Names that files give in a line of their own.
NAMES = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0",
    "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
SENTENCES |= {f"spdx license identifier {re.sub('[^a-z0-9]+', ' ', name.lower())}": f"spdx-{name}" for name in NAMES}
# Rules, longest first where one contains another; identifiers must follow in this order.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["apache-2.0-grant", "apache-2.0-comply", "apache-2.0-copy", "apache-2.0-url"]),
    ("Apache-2.0", ["apache-2.0-grant"]),
    ("Apache-2.0", ["apache-2.0-short"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-short"]),
    ("GPL-3.0-or-later", ["gpl-3.0-or-later-grant", "gpl-no-warranty"]),
    ("GPL-3.0-or-later", ["gpl-3.0-or-later-grant"]),
    ("GPL-2.0-or-later", ["gpl-2.0-or-later-grant", "gpl-no-warranty"]),
    ("GPL-2.0-or-later", ["gpl-2.0-or-later-grant"]),
    ("GPL-3.0", ["gpl-3.0-short"]),
    ("GPL-2.0", ["gpl-2.0-short"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4.0-short"]),
    ("CC-BY-4.0", ["cc-by-4.0-short"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4.0-short"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MPL-2.0", ["mpl-2.0-short"]),
    ("Unlicense", ["unlicense-short"]),
    ("LGPL-2.1-or-later", ["lgpl-2.1-or-later-grant", "lgpl-no-warranty"]),
    ("LGPL-2.1-or-later", ["lgpl-2.1-or-later-grant"]),
    ("LGPL-3.0-or-later", ["lgpl-3.0-or-later-grant", "lgpl-no-warranty"]),
    ("LGPL-3.0-or-later", ["lgpl-3.0-or-later-grant"]),
    ("AGPL-3.0-or-later", ["agpl-3.0-or-later-grant", "gpl-no-warranty"]),
    ("AGPL-3.0-or-later", ["agpl-3.0-or-later-grant"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("ISC", ["isc-grant"]),
    ("Zlib", ["zlib-warranty", "zlib-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["bsl-1.0-title", "bsl-1.0-grant"]),
    ("BSL-1.0", ["bsl-1.0-grant"]),
    ("BSL-1.0", ["bsl-1.0-short"]),
    ("EPL-2.0", ["epl-2.0-grant"]),
    ("CC0-1.0", ["cc0-1.0-deed"]),
    ("CC0-1.0", ["cc0-1.0-waiver"]),
    ("GPL-2.0", ["gpl-2.0-title"]),
    ("GPL-3.0", ["gpl-3.0-title"]),
    ("LGPL-2.1", ["lgpl-2.1-title"]),
    ("LGPL-3.0", ["lgpl-3.0-title"]),
    ("AGPL-3.0", ["agpl-3.0-title"]),
    ("Apache-2.0", ["apache-2.0-title"]),
]
RULES += [(name, [f"spdx-{name}"]) for name in NAMES]
# Sentences of standard texts, as they run on, with the known sentence each stands for.
STANDARD: dict[str, str] = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is",
}
#: Known sentences of so many words run over lines in standard texts, and titles do.
LONG = 9
#: A sentence ends at a line end, or at a stop, semicolon or exclamation mark before a blank or the end.
SENTENCE_END = r"[.;!?]+(?:\s+|$)|\n+"
#: A line that breaks off within a sentence and the small letter that goes on with it.
WRAPPED = r"([a-z,])\n[ \t]*([a-z])"
#: Words of which every known sentence holds one: a sentence without them is not normalised at all.
TRIGGERS = ("licen", "permission", "copyright", "warranty", "redistribution", "unencumbered")


def sentences(text: Column) -> Column:
    """Normalised sentences of a text: small letters and digits, everything else a single blank."""
    raw = F.split(F.lower(F.regexp_replace(_unwrapped(text), WRAPPED, "$1 $2")), SENTENCE_END)
    telling = F.filter(raw, lambda s: _any(s))
    return F.transform(telling, lambda s: F.trim(F.regexp_replace(s, r"[^a-z0-9]+", " ")))


def _running_on() -> list[tuple[str, str]]:
    """Patterns of the sentences that run over lines, and what stands for each on a line of its own;
    between words are blanks, stops, quotes, line breaks and the marks of comments."""
    long = {s: i for s, i in SENTENCES.items() if len(s.split()) >= LONG or i.endswith("-title")}
    one_line = {i: s for s, i in long.items()}
    # As they stand in SENTENCES, those of a standard text are its beginning.
    sentences_ = {**STANDARD, **{s: i for s, i in long.items() if i not in ("mit-grant", "as-is")}}
    return [("[^a-z0-9]+".join(s.split()), one_line[i]) for s, i in sentences_.items()]


def _unwrapped(text: Column) -> Column:
    """The text with every long known sentence, whatever stands between its words, on one line."""
    out = text
    for pattern, sentence in _running_on():
        out = F.regexp_replace(out, f"(?i)(?<![a-z0-9]){pattern}(?![a-z0-9])", f"\n{sentence}\n")
    return F.when(_any(F.lower(text)), out).otherwise(text)


def _any(sentence: Column) -> Column:
    found = F.lit(False)
    for trigger in TRIGGERS:
        found = found | sentence.contains(trigger)
    return found


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    return F.filter(F.transform(sentences(text), lambda s: known[s]), lambda i: i.isNotNull())


def found_licenses(ids: Column) -> Column:
    """Licences whose rule occurs in a sequence of identifiers, sorted; longer rules take their part
    of the sequence first."""
    # Identifiers hold no blank or bar: a sequence is a text, a rule a part of it.
    sequence = F.concat(F.lit("|"), F.array_join(ids, "||"), F.lit("|"))
    names = []
    for name, rule in sorted(RULES, key=lambda r: -len(r[1])):
        pattern = "|" + "||".join(rule) + "|"
        names.append(F.when(F.contains(sequence, F.lit(pattern)), F.lit(name)))
        sequence = F.replace(sequence, F.lit(pattern), F.lit("|"))
    return F.array_sort(F.array_distinct(F.filter(F.array(*names), lambda n: n.isNotNull())))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, sentence_ids and licenses (arrays)."""
    rows = docs.select(F.col(key), F.coalesce(sentence_ids(F.coalesce(F.col(text), F.lit(""))), F.array().cast("array<string>")).alias("sentence_ids"))
    return rows.select(key, "sentence_ids", found_licenses(F.col("sentence_ids")).alias("licenses"))


def oracle(table: str = "documents") -> str:
    """The same in DuckDB, with lists joined by commas."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(s)}, {quoted(i)})" for s, i in SENTENCES.items())
    triggers = " OR ".join(f"contains(s, {quoted(t)})" for t in TRIGGERS)
    sequence, names = "sequence", []
    for name, rule in sorted(RULES, key=lambda r: -len(r[1])):
        pattern = quoted("|" + "||".join(rule) + "|")
        names.append(f"CASE WHEN contains({sequence}, {pattern}) THEN {quoted(name)} END")
        sequence = f"replace({sequence}, {pattern}, '|')"
    unwrapped = "t"
    for pattern, sentence in _running_on():
        unwrapped = f"regexp_replace({unwrapped}, '(?i)(^|[^a-z0-9]){pattern}([^a-z0-9]|$)', '\\1' || chr(10) || '{sentence}' || chr(10) || '\\2', 'g')"
    told = " OR ".join(f"contains(lower(t), {quoted(t)})" for t in TRIGGERS)
    return rf"""
    WITH texts AS (
        SELECT doc_id, CASE WHEN {told} THEN {unwrapped} ELSE t END AS text FROM (SELECT doc_id, coalesce(text, '') AS t FROM {table})
    ), split AS (
        SELECT row_number() OVER () AS r, doc_id,
               list_filter(string_split_regex(lower(regexp_replace(text, '([a-z,])\n[ \t]*([a-z])', '\1 \2', 'g')), '[.;!?]+(?:\s+|$)|\n+'), lambda s: {triggers}) AS raw
        FROM texts
    ), placed AS (
        SELECT r, unnest(raw) AS s, generate_subscripts(raw, 1) AS place FROM split
    ), known(sentence, id) AS (VALUES {known}),
    hits AS (
        SELECT r, list(id ORDER BY place) AS ids
        FROM placed JOIN known ON trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) = sentence GROUP BY r
    ), named AS (
        SELECT doc_id, coalesce(ids, []) AS ids, '|' || array_to_string(coalesce(ids, []), '||') || '|' AS sequence
        FROM split LEFT JOIN hits USING (r)
    )
    SELECT doc_id, array_to_string(ids, ',') AS sentence_ids,
           array_to_string(list_sort(list_distinct(list_filter([{", ".join(names)}], lambda n: n IS NOT NULL))), ',') AS licenses
    FROM named
    """
