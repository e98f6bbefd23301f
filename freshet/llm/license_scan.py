"""Licence recognition: sentences to identifiers, identifier sequences to licences.

A text is cut at line ends and at ``. ! ?`` before white space or the end. What lies
between is normalised (A-Z lower-cased, runs of ASCII characters that are neither
letters nor digits turned into one space, trimmed, which takes comment marks off) and
looked up among known licence sentences, by itself or joined by spaces with the lines
after it up to the next sentence end or line without letters and digits: from the
first line on the longest known run is taken, then the search goes on behind it. What remains of a document is the sequence of known
identifiers in text order; the ordered rules are tried on it one after the other,
and what a rule matches is taken out, so that a longer rule earlier in the list
wins over its parts. All of this is one row's work: no shuffle, no join.

Defined cases: null or empty texts have no sentences and no licence; a sentence
counts if something is left of it; identifiers no rule uses are counted as
unmatched; repeated rows are answered once each; lines, not the sentences made of
them, are counted as ``n_sentences``.
"""

from __future__ import annotations

import re
import string
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import lower_ascii, only

ENDS = r"[.!?]+[ \t\r\n]+|[.!?]+\z|\n+"
#: Of these ends, those that no sentence goes over.
HARD_ENDS = r"[.!?]+[ \t\r\n]+|[.!?]+\z"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "apache2-line": ["Licensed under the Apache License, Version 2.0", "This work is licensed under the Apache License, Version 2.0", "Released under the Apache License 2.0"],
    "apache2-grant": ['Licensed under the Apache License, Version 2.0 (the "License")'],
    "apache2-compliance": ["you may not use this file except in compliance with the License"],
    "apache2-copy": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "apache2-url": ["http://www.apache.org/licenses/LICENSE-2.0"],
    "mit-line": ["Released under the MIT License", "Licensed under the MIT License", "This work is licensed under the MIT License"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "gpl3-line": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Released under the GNU General Public License v3.0"],
    "gpl2-line": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2"],
    "gpl3-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "mpl2-line": ["This Source Code Form is subject to the terms of the Mozilla Public License, v"],
    "version-2-0": ["2.0"],
    "lgpl3-line": ["This work is licensed under the GNU Lesser General Public License, version 3", "Licensed under the GNU Lesser General Public License, version 3"],
    "agpl3-line": ["This work is licensed under the GNU Affero General Public License, version 3", "Licensed under the GNU Affero General Public License, version 3"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "cc-by-line": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-line": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc-line": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "all-rights": ["All rights reserved"],
}
#: Licences by the sequences that state them; the first that fits takes its sentences.
RULES = (
    ("Apache-2.0", ("apache2-grant", "apache2-compliance", "apache2-copy", "apache2-url")),
    ("Apache-2.0", ("apache2-grant", "apache2-compliance", "apache2-copy")),
    ("Apache-2.0", ("apache2-grant",)),
    ("Apache-2.0", ("apache2-line",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-line",)),
    ("GPL-3.0-or-later", ("gpl3-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl3-free",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-3.0-only", ("gpl3-line",)),
    ("GPL-2.0-only", ("gpl2-line",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MPL-2.0", ("mpl2-line", "version-2-0")),
    ("LGPL-3.0-only", ("lgpl3-line",)),
    ("AGPL-3.0-only", ("agpl3-line",)),
    ("ISC", ("isc-grant",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-line",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-line",)),
    ("CC-BY-4.0", ("cc-by-line",)),
    ("all-rights-reserved", ("all-rights",)),
)


def normalised(sentence: str) -> str:
    """The normal form of a known sentence; ``sentences_of`` gives that of a text's."""
    lowered = sentence.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    return re.sub(GAPS, " ", lowered).strip()


def table_of(sentences: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Normal form to identifier. A known sentence is one: what a text's cuts would take apart (as the
    ``v.`` of a version) has an identifier for each part, and a rule that needs them in a row."""
    table = {}
    for name, texts in sentences.items():
        for text in texts:
            parts = [p for part in re.split(ENDS.replace(r"\z", r"\Z"), text) if (p := normalised(part))]
            if len(parts) != 1:
                raise ValueError(f"{name}: {text!r} is {len(parts)} sentences")
            table[parts[0]] = name
    return table


def lines_of(text: Column) -> Column:
    """The normalised lines, each ended by a line feed; an empty one stands where no sentence goes on."""
    chunks = F.split(lower_ascii(F.coalesce(text, F.lit(""))), HARD_ENDS)
    lines = lambda chunk: F.transform(F.split(chunk, "\n"), lambda s: F.trim(F.regexp_replace(s, GAPS, " ")))
    return F.array_join(F.transform(chunks, lambda c: F.array_join(lines(c), "\n")), "\n\n")


def pattern_of(known: Sequence[str]) -> str:
    """Whole lines that make up a known sentence, the longest first."""
    quoted = (r"[ \n]".join(re.escape(word) for word in k.split(" ")) for k in sorted(known, key=lambda k: (-len(k), k)))
    return r"(?<![^\n])(" + "|".join(quoted) + r")(?![^\n])"


def scan_licenses(
    documents: DataFrame,
    sentences: Mapping[str, Sequence[str]] = SENTENCES,
    rules: Sequence[tuple[str, Sequence[str]]] = RULES,
) -> DataFrame:
    """Per document: doc_id, n_sentences, n_known, n_unmatched, sentence_ids (text order) and
    licenses (rule order), both joined by commas and empty if there are none."""
    known = table_of(sentences)
    name_of = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    tagged = (
        only(documents, "doc_id", "text")
        .select("doc_id", lines_of(F.col("text")).alias("lines"))
        .select(
            "doc_id",
            F.size(F.filter(F.split("lines", "\n"), lambda s: s != "")).cast("long").alias("n_sentences"),
            F.regexp_extract_all("lines", F.lit(pattern_of(known)), 1).alias("hits"),
        )
        .select("doc_id", "n_sentences", F.transform("hits", lambda s: F.element_at(name_of, F.translate(s, "\n", " "))).alias("ids"))
        .withColumn("left0", F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), ""))
    )
    # a literal pattern per rule; what it matched becomes a mark that no later rule can span
    for k, (_, sequence) in enumerate(rules):
        pattern = "".join(f"<{name}>" for name in sequence)
        tagged = tagged.withColumn(f"left{k + 1}", F.replace(F.col(f"left{k}"), F.lit(pattern), F.lit("|")))
    found = [F.when(F.col(f"left{k}") != F.col(f"left{k + 1}"), F.lit(name)) for k, (name, _) in enumerate(rules)]
    rest = F.col(f"left{len(rules)}")
    return tagged.select(
        "doc_id",
        "n_sentences",
        F.size("ids").cast("long").alias("n_known"),
        (F.length(rest) - F.length(F.replace(rest, F.lit("<"), F.lit("")))).cast("long").alias("n_unmatched"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.array_distinct(F.array_compact(F.array(*found))), ",").alias("licenses"),
    )
