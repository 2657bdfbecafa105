"""Licence scan by sentence rules, in built-in functions only: no shuffle, no Python.

A text is cut into sentences, each is normalised (case, punctuation and blanks) and looked up among known licence sentences;
the identifiers in text order are matched against ordered rules. A rule is a sequence of identifiers that must follow each
other, other text in between allowed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and the usual references to them, as they read after normalising.
SENTENCES = {
    "apache2_reference": "licensed under the apache license version 2 0",
    "apache2_file": "you may not use this file except in compliance with the license",
    "apache2_copy": "you may obtain a copy of the license at",
    "apache2_asis": "unless required by applicable law or agreed to in writing software distributed under the license is "
    "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit_reference": "released under the mit license",
    "mit_reference_2": "licensed under the mit license",
    "mit_title": "the mit license mit",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the software",
    "gpl3_reference": "this work is licensed under the gnu general public license version 3",
    "gpl3_title": "gnu general public license version 3",
    "gpl_share": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
    "general public license as published by the free software foundation either version 3 of the license or at your "
    "option any later version",
    "gpl_warranty": "this program is distributed in the hope that it will be useful but without any warranty without even "
    "the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_copy": "you should have received a copy of the gnu general public license along with this program",
    "cc_by_nc4_reference": "licensed under cc by nc 4 0",
    "cc_by4_reference": "licensed under cc by 4 0",
    "cc_by_sa4_reference": "licensed under cc by sa 4 0",
    "cc_by4_long": "this work is licensed under a creative commons attribution 4 0 international license",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided "
    "that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the "
    "following disclaimer",
    "bsd_endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission",
    "mpl2_reference": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is "
    "hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "public_domain": "this is free and unencumbered software released into the public domain",
}
# Licence, and the identifiers that must follow each other. More than one rule may name a licence.
RULES = (
    ("Apache-2.0", ("apache2_reference",)),
    ("Apache-2.0", ("apache2_file", "apache2_copy", "apache2_asis")),
    ("MIT", ("mit_reference",)),
    ("MIT", ("mit_reference_2",)),
    ("MIT", ("mit_title", "mit_notice")),
    ("GPL-3.0", ("gpl3_reference",)),
    ("GPL-3.0", ("gpl3_title", "gpl_share")),
    ("GPL-3.0-or-later", ("gpl_share", "gpl_warranty", "gpl_copy")),
    ("CC-BY-NC-4.0", ("cc_by_nc4_reference",)),
    ("CC-BY-4.0", ("cc_by4_reference",)),
    ("CC-BY-4.0", ("cc_by4_long",)),
    ("CC-BY-SA-4.0", ("cc_by_sa4_reference",)),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_endorse")),
    ("MPL-2.0", ("mpl2_reference",)),
    ("ISC", ("isc_grant",)),
    ("Unlicense", ("public_domain",)),
)
# Wordings of the notices themselves as they read between sentence ends, for ``wrapped`` texts, and the rules that only these fulfil.
WORDINGS = {
    "licensed under the apache license version 2 0 the license": "apache2_reference",
    "mit license": "mit_title",
    "the mit license": "mit_title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
    "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
    "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to "
    "do so subject to the following conditions": "mit_grant",
    "gnu general public license version 3 29 june 2007": "gpl3_title",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
    "foundation either version 3 of the license or at your option any later version": "gpl_share",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl_warranty",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "in this position and unchanged": "bsd_source",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2_reference",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided "
    "that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc_by_sa4_reference",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc_by_nc4_reference",
    "this code is licensed under the mit license": "mit_reference_2",
    "this project is licensed under the mit license": "mit_reference_2",
    "this software is licensed under the mit license": "mit_reference_2",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
    "foundation": "gpl_terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free "
    "software foundation": "gpl2_terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free "
    "software foundation": "lgpl_terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free "
    "software foundation either version 3 of the license or at your option any later version": "lgpl3_share",
    "either version 2 of the license or at your option any later version": "version2_or_later",
    "either version 2 1 of the license or at your option any later version": "version2_1_or_later",
    "either version 3 of the license or at your option any later version": "version3_or_later",
    "boost software license version 1 0 august 17th 2003": "bsl1_title",
    "distributed under the boost software license version 1 0": "bsl1_reference",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
    "redistribute it freely subject to the following restrictions": "zlib_grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is "
    "available at https www eclipse org legal epl 2 0": "epl2_reference",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software "
    "to the public domain worldwide": "cc0_dedication",
}
# Short names of licences as they stand behind ``SPDX-License-Identifier:``; each is a sentence and a rule of its own.
SHORT_NAMES = (
    "Apache-2.0", "MIT", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "Unlicense",
    "BSL-1.0", "Zlib", "EPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
)


def _short(name: str) -> tuple[str, str]:
    """The sentence of a short name as it reads after normalising, and its identifier."""
    words = re.sub("[^a-z0-9]+", " ", name.lower())
    return f"spdx license identifier {words}", "spdx_" + words.replace(" ", "_")


WORDINGS |= dict(map(_short, SHORT_NAMES))
WORDING_RULES = (
    ("MIT", ("mit_grant", "mit_notice")),
    ("GPL-2.0-only", ("gpl2_terms",)),
    ("GPL-2.0-or-later", ("gpl_terms", "version2_or_later")),
    ("GPL-3.0-or-later", ("gpl_terms", "version3_or_later")),
    ("LGPL-2.1-or-later", ("lgpl_terms", "version2_1_or_later")),
    ("LGPL-3.0-or-later", ("lgpl3_share",)),
    ("LGPL-3.0-or-later", ("lgpl_terms", "version3_or_later")),
    ("BSL-1.0", ("bsl1_title",)),
    ("BSL-1.0", ("bsl1_reference",)),
    ("Zlib", ("zlib_grant",)),
    ("EPL-2.0", ("epl2_reference",)),
    ("CC0-1.0", ("cc0_dedication",)),
    *((name, (_short(name)[1],)) for name in SHORT_NAMES),
)
# The part of a sentence that differs between notices, in normalised words, and what stands for it in SENTENCES.
VARYING = (r"neither the name of [a-z0-9 ]{1,200}? nor the names of its contributors ", "neither the name of the copyright holder nor the names of its contributors ")
# A sentence ends at a line end, or at . ! ? ; : before a blank. Lines of one sentence may be joined first, see ``joined``.
SENTENCE_END = r"[.!?;:]+[ \t\f\r]+|[.!?;:]*\s*\n\s*"
# A sentence without one of these words is in no rule; checked before the costly normalising.
ANCHORS = r"(?i)licen[cs]e|copyright|redistribut|general public|permission|public domain|warranty"


def normalised(sentence: Column) -> Column:
    """Lower case, ``&`` and punctuation to single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^a-z0-9]+", " "))


def rule_pattern(identifiers: tuple[str, ...]) -> str:
    """Regex for identifiers in this order, others allowed between, in a text like `` a b c ``."""
    return " " + r" (?:.* )?".join(identifiers) + " "


def rule_patterns(more: tuple = ()) -> dict[str, str]:
    """One regex per licence, in the order of its first rule."""
    patterns: dict[str, list[str]] = {}
    for name, ids in RULES + more:
        patterns.setdefault(name, []).append(rule_pattern(ids))
    return {name: "|".join(found) for name, found in patterns.items()}


def _wrapped_sentences(text: Column) -> Column:
    """Identifiers of known sentences that fill one or more whole lines, in text order.

    Lines are normalised one by one. A single line end is a blank; . ! ? ; : before a blank or line end, and a line without a
    letter or digit (as between the paragraphs of a comment), end a sentence and are two line ends here.
    """
    known = {words: name for name, words in SENTENCES.items()} | WORDINGS
    # the colon before a short name ends no sentence
    lines = F.regexp_replace(F.lower(text), r"(spdx-license-identifier)[ \t]{0,8}:", "$1 ")
    lines = F.regexp_replace(lines, r"(?<![.!?;:])[.!?;:]++(?:[ \t\f\r]*+\n|[ \t\f\r]++)", "\n\n")
    lines = F.regexp_replace(lines, r"\n(?:[^a-z0-9\n]*+\n)++", "\n\n")
    lines = F.trim(F.regexp_replace(F.regexp_replace(lines, r"[^a-z0-9\n]++", " "), r" ?\n ?", "\n"))
    # the longest first, and any line end inside
    patterns = [words.replace(" ", r"[ \n]") for words in sorted(known, key=len, reverse=True)]
    varying, usual = VARYING
    patterns += [
        (varying + words[len(usual) :]).replace("[a-z0-9 ]", "[a-z0-9@]").replace(" ", r"[ \n]").replace("[a-z0-9@]", r"(?:[a-z0-9]|[ \n](?!\n))")
        for words in known if words.startswith(usual)
    ]
    found = F.regexp_extract_all(lines, F.lit(r"(?<![^\n])(?:" + "|".join(patterns) + r")(?![^\n])"), F.lit(0))
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.transform(found, lambda s: F.try_element_at(names, F.regexp_replace(F.translate(s, "\n", " "), varying, usual)))


def find_licenses(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", joined: bool = False, wrapped: bool = False
) -> DataFrame:
    """One row per input row: ``id_column``, ``sentence_ids`` (identifiers in text order, blank between), ``licenses`` (names by
    rule order, each once, comma between), ``n_sentences`` (known ones).

    With ``wrapped`` a sentence is one line or several, up to an empty line, and ``WORDINGS`` count too. With ``joined`` a single line end is a blank and only an empty line ends a sentence, for texts wrapped at a fixed width.
    A NULL or empty text, or one without a known sentence, has empty texts and 0. Repeated rows stay rows of their own. An
    empty table gives an empty result. Other columns are not read. With ``wrapped`` very long texts are searched whole, in a time that grows
    with their length.
    """
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    if joined:
        text = F.regexp_replace(text, r"(?<!\n)[ \t\r]*\n[ \t]*(?!\s*\n)", " ")
    known = F.create_map(*[F.lit(x) for name, words in SENTENCES.items() for x in (words, name)])
    # a split has one entry more than there are ends; texts without an anchor are not split at all
    pieces = F.when(text.rlike(ANCHORS), F.filter(F.split(text, SENTENCE_END), lambda s: s.rlike(ANCHORS))).otherwise(
        F.array().cast("array<string>")
    )
    found = F.filter(F.transform(pieces, lambda s: F.try_element_at(known, normalised(s))), lambda i: i.isNotNull())
    if wrapped:
        found = F.when(text.rlike(ANCHORS), _wrapped_sentences(text)).otherwise(F.array().cast("array<string>"))
    rows = df.select(F.col(f"`{id_column}`").alias(id_column), found.alias("_found"))
    line = F.concat(F.lit(" "), F.array_join("_found", " "), F.lit(" "))
    names = [F.when(line.rlike(pattern), F.lit(name)) for name, pattern in rule_patterns(WORDING_RULES if wrapped else ()).items()]
    licenses = F.array_join(F.array(*names), ",")
    return rows.select(
        id_column, F.array_join("_found", " ").alias("sentence_ids"), licenses.alias("licenses"),
        F.size("_found").cast("long").alias("n_sentences"),
    )

