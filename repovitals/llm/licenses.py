"""Licence detection by ordered rules over sequences of known sentences.

A text is cut twice: into lines, and, line feeds being spaces, into sentences.
Each piece in normal form (lower case, runs of other characters than letters and
digits as one space) is looked up among the known sentences; one with a hole, where
a holder's name stands, is known by what comes before and after it. The identifiers
of those found, in order, are matched against the rules: a rule names a licence by a
sequence of identifiers that must follow one another, whatever unknown pieces stand
between them. Rules go from the longest to the shortest, and a match uses its
identifiers up, so that the clauses of one licence are not found again as a shorter
one. A text has every licence that either cut finds, but for those whose rule is
part of the rule of a licence that only the other cut found: lines that break a
sentence hide it from one cut.

Every known sentence holds a word of ANCHOR, so texts without one are not cut.
All of it is SQL functions over one scan; nothing is shuffled. Nulls: a null or
blank text has no licence. Every row gives a row, repeated rows too; other
columns are dropped. An empty table gives no rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of licences and of notices that name one, by identifier. HOLE stands for a name.
HOLE = "<name>"
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "bsd-head": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of <name> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-advertise": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "unlicense-domain": "This is free and unencumbered software released into the public domain, without any conditions on its licensing.",
    "unlicense-free": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means, without further permission.",
    "cc0-notice": "To the extent possible under law, <name> has waived all copyright and related or neighboring rights to this work.",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
}
#: Licences that a line of the form "SPDX-License-Identifier: X" names.
SPDX = ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
        "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-2.0",
        "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "BSL-1.0"]
SENTENCES |= {f"spdx-{name}": f"SPDX-License-Identifier: {name}" for name in SPDX}
#: Licence, and the sentences that name it, in order.
RULES = [
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-notice-2"]),
    ("MIT", ["mit-grant", "mit-keep"]),
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["apache-header", "apache-copy"]),
    ("Apache-2.0", ["apache-header", "apache-as-is"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("BSD-2-Clause", ["bsd-head", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-head", "bsd-source", "bsd-binary", "bsd-name"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl-header"]),
    ("MPL-2.0", ["mpl-header", "mpl-copy"]),
    ("BSD-4-Clause", ["bsd-head", "bsd-source", "bsd-binary", "bsd-advertise", "bsd-name"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-hope"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "lgpl-hope"]),
    ("AGPL-3.0-or-later", ["agpl-free", "gpl-hope"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("Unlicense", ["unlicense-domain"]),
    ("Unlicense", ["unlicense-domain", "unlicense-free"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("EPL-2.0", ["epl2-notice"]),
    ("BSL-1.0", ["bsl-grant"]),
]
RULES += [(name, [f"spdx-{name}"]) for name in SPDX]
ANCHOR = "(?i)licen[sc]e|licensing|copyright|warrant|redistribut|permi(?:ssion|tted)|advertising|compiled binary|mozilla"
#: Ends of sentences: a mark before white space. A number that a list begins with is no sentence of its own.
SENTENCE_END = "(?<=[.!?:])[\\s]+(?:[0-9*-]+[.)]?\\s+)?"


#: Ends of lines, with what a list begins the next one with.
LINE_END = "\\n\\s*(?:[0-9*-]+[.)]?\\s+)?"


def normal(text: str) -> str:
    """The normal form of a sentence, as the plan computes it."""
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).strip(" ")


def _normal(piece: Column) -> Column:
    lowered = F.translate(piece, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", " "))


class Known:
    """The known sentences of one cut: whole ones and those with a hole, and each rule as a run of identifiers.

    An identifier stands between angle brackets, so that one run's end is not another's beginning."""

    def __init__(self, pieces_of):
        self.whole: dict[str, str] = {}
        self.holed: list[tuple[str, str, str]] = []
        runs = {}
        for i, (name, text) in enumerate(SENTENCES.items()):
            runs[name] = ""
            for k, piece in enumerate(pieces := pieces_of(text)):
                own = f"{i}" if len(pieces) == 1 else f"{i}.{k}"
                if HOLE in piece:
                    before, after = (normal(x) for x in piece.split(HOLE))
                    self.holed.append((f"{before} ", f" {after}", own))
                else:
                    own = self.whole.setdefault(normal(piece), own)
                runs[name] += f"<{own}>"
        longest = sorted(range(len(RULES)), key=lambda n: (-len(RULES[n][1]), n))
        #: (run, licence), longest first; of equal length in the order of RULES.
        self.rules = [("".join(runs[name] for name in RULES[n][1]), RULES[n][0]) for n in longest if all(runs[name] for name in RULES[n][1])]


def _sentences(text: str) -> list[str]:
    """The pieces of a known sentence; none of a line that would fall into a label and a mere word."""
    if text.startswith("SPDX-"):
        return []
    return [x for x in re.split("(?<=[.!?:])\\s+", text) if normal(x)]


BY_LINE, BY_SENTENCE = Known(lambda text: [text]), Known(_sentences)


def parts() -> dict[str, list[str]]:
    """licence -> licences with a rule that holds one of its rules and more: what a cut that sees all would say instead."""
    inside = lambda a, b: len(a) < len(b) and any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    out: dict[str, list[str]] = {}
    for licence, rule in RULES:
        found = sorted({other for other, longer in RULES if other != licence and inside(rule, longer)})
        if found:
            out[licence] = sorted({*out.get(licence, []), *found})
    return out


def _identifiers(pieces: Column, known: Known) -> Column:
    """The identifiers of the known pieces, in order, as one text."""
    table = F.create_map(*(F.lit(x) for pair in known.whole.items() for x in pair))

    def one(piece: Column) -> Column:
        found = F.try_element_at(table, piece)
        for before, after, own in known.holed:
            found = F.coalesce(found, F.when(piece.startswith(before) & piece.endswith(after), F.lit(own)))
        return found

    found = F.filter(F.transform(F.transform(pieces, _normal), one), lambda i: i.isNotNull())
    return F.array_join(F.transform(found, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")


def _licences(ids: Column, known: Known) -> Column:
    """Licences that the rules find, longest rule first, each match replaced by its licence's mark."""
    for run, licence in known.rules:
        ids = F.replace(ids, F.lit(run), F.lit(f"{{{licence}}}"))
    return F.array_distinct(F.regexp_extract_all(ids, F.lit("\\{([^}]*)\\}"), F.lit(1)))


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, licenses, n_sentences) of every row of docs (doc_id, text): licences sorted and joined by commas; known sentences found."""
    text = F.col("text").cast("string")
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike(ANCHOR), text).alias("text"))
    sentences = F.split(F.regexp_replace("text", "\\n", " "), SENTENCE_END)
    ids = cut.select("doc_id", _identifiers(F.split("text", LINE_END), BY_LINE).alias("by_line"), _identifiers(sentences, BY_SENTENCE).alias("by_sentence"))
    found = ids.select("doc_id", "by_line", "by_sentence", _licences(F.col("by_line"), BY_LINE).alias("l"), _licences(F.col("by_sentence"), BY_SENTENCE).alias("s"))
    whole = parts()

    def without_parts(own: str, other: str) -> Column:
        """What one cut found, without parts of licences that the other found alone."""
        alone = F.array_except(other, own)
        part = lambda x: F.coalesce(*(F.when(x == name, F.arrays_overlap(alone, F.array(*map(F.lit, more)))) for name, more in whole.items()), F.lit(False))
        return F.filter(own, lambda x: ~part(x))

    names = F.array_sort(F.array_union(without_parts("l", "s"), without_parts("s", "l")))
    count = F.greatest(*(F.length(F.regexp_replace(c, "[^>]", "")) for c in ("by_line", "by_sentence")))
    return found.select("doc_id", F.coalesce(F.array_join(names, ","), F.lit("")).alias("licenses"), F.coalesce(count, F.lit(0)).cast("long").alias("n_sentences"))

