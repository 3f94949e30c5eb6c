"""License scans by sentence rules.

Texts are cut into sentences, normalised and looked up in a table of known licence sentences, each with an identifier.
The identifiers that a text has, in order, are matched against rules: each names a licence and the identifiers that
show it, which must come in that order, others in between allowed. The known notices are cut by the same expressions
as the texts, so a notice of several sentences is a sequence of identifiers. A rule that another rule contains doesn't
count where that one holds. A text is cut in two ways, by lines and by sentences that run over line ends, and each cut
is matched by itself; a notice on a line of its own is found in either.

All steps are DataFrame expressions. A rule is followed by a state that goes up with each identifier it waits for,
so time and memory are proportional to the text, however long it is. Texts without any anchor are passed over early,
if the book's rules each have a sentence that can't be written without one; any other book sees all texts. The tables
are fixed ones; only hits are shuffled.

Defined results: null and empty texts have no licence; rows that repeat whole give one result; a sentence that stands
twice counts twice; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import literal_table
from .textlines import row_key

#: Parts of normal sentences; in a text other characters than letters and digits can stand for the blanks.
ANCHORS = ("license", "licence", "copyright", "permission", "warrant", "redistribut", "reserved", "cc0", "gpl", "public domain", "licensed under", "released under", "distributed under", "available under")
SENTENCE_END = r"(?<=[.;:!?])[ \t\r]+|[\r]?\n"
FLOWING_END = r"(?<=[.;:!?])\s+|\n\s*\n"

# Names of licences, and the sentences that refer to one by name.
NAMES = {
    "MIT": ("MIT License", "MIT licence", "MIT"),
    "MIT-0": ("MIT No Attribution License", "MIT-0 license"),
    "Apache-2.0": ("Apache License, Version 2.0", 'Apache License, Version 2.0 (the "License")', "Apache License 2.0", "Apache License v2.0", "Apache 2.0 license", "Apache-2.0 license", "Apache Software License, Version 2.0"),
    "GPL-2.0": ("GNU General Public License version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPL v2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPL v3", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License version 2.1", "LGPL v2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License version 3", "LGPL v3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License version 3", "AGPL v3", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License version 2.0", "Mozilla Public License, v2.0", "MPL 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License - v 2.0", "Eclipse Public License version 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-clause BSD license", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-clause BSD license", "New BSD License", "Modified BSD License"),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License", "zlib/libpng license"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal license"),
}
NAMES |= {
    f"CC-{code}-{version}": (f"CC {code} {version}", f"CC {code}-{version}", f"Creative Commons {name} {version} {scope} License")
    for code, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
    for version, scope in (("4.0", "International"), ("3.0", "Unported"))
}
REFERENCES = (
    *(f"{verb} under {article}{{}}" for verb in ("licensed", "released", "distributed", "available") for article in ("", "the ", "a ")),
    *(f"this {subject} is {verb} under {article}{{}}" for subject in ("work", "project", "software", "code") for verb in ("licensed", "released", "distributed") for article in ("", "the ", "a ")),
)
#: These also show a licence by themselves, as titles.
TITLES = ("{}", "the {}")

# Notices of public licences. Alternatives of a notice differ in places.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS"'
NOTICES = {
    "mit-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    "mit-0-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    ),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "mit-warranty": (f"{_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "0bsd-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",),
    "isc-warranty": (f"{_AS_IS} AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "1) Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "2) Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "bsd-names": tuple(
        f"{mark}Neither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." for mark in ("", "3) ") for holder in ("the copyright holder", "the author", "the organization", "the University")
    ),
    "apache2-use": ("you may not use this file except in compliance with the License.",),
    "apache2-copy": ("You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    "mpl2-notice": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "epl2-notice": tuple(f"This program and the accompanying materials are made available under the terms of the Eclipse Public License {v} which {x}" for v in ("2.0", "v. 2.0", "v2.0") for x in ("is available at", "accompanies this distribution, and is available at")),
    "zlib-grant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
    "zlib-origin": ("The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",),
    "bsl-grant": (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "cc0-waiver": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    "reserved": ("All rights reserved.",),
    "spdx": ("SPDX-License-Identifier:",),
}

# Rules, as (licence, notices in order).
RULES = (
    ("MIT", ("mit-grant", "mit-notice")), ("MIT-0", ("mit-0-grant", "mit-warranty")), ("Apache-2.0", ("apache2-use", "apache2-copy")), ("MPL-2.0", ("mpl2-notice",)), ("EPL-2.0", ("epl2-notice",)),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")), ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")), ("ISC", ("isc-grant", "isc-warranty")), ("0BSD", ("0bsd-grant", "isc-warranty")),
    ("Zlib", ("zlib-grant", "zlib-origin")), ("BSL-1.0", ("bsl-grant",)), ("Unlicense", ("unlicense",)), ("CC0-1.0", ("cc0-waiver",)), ("Proprietary", ("reserved",)),
)

# The GNU licences, and the notice that applies one.
GNU = (("GPL", "General Public License", ("2", "3")), ("LGPL", "Lesser General Public License", ("2.1", "3")), ("AGPL", "Affero General Public License", ("3",)))
_GNU_FREE = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}"


def gnu_notices() -> dict[str, tuple[str, ...]]:
    """By licence: its notices."""
    found: dict[str, tuple[str, ...]] = {}
    for code, name, versions in GNU:
        for v in versions:
            licence = f"{code}-{v if '.' in v else v + '.0'}"
            free = [_GNU_FREE.format(x, name) for x in ("program", "library", "software", "file")]
            found[f"{licence}-or-later"] = tuple(f"{x} as published by the Free Software Foundation{sep} either version {v} of the License, or (at your option) any later version." for x in free for sep in (",", ";"))
            found[f"{licence}-only"] = tuple(y for x in free for y in (f"{x} version {v} as published by the Free Software Foundation.", f"{x} as published by the Free Software Foundation{'; '}version {v} of the License."))
    return found


def plain(sentence: str) -> str:
    """What ``normal`` gives, for the known sentences."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def cut(notice: str) -> list[str]:
    """The sentences of a notice, normalised."""
    return [x for part in re.split(FLOWING_END, notice) if (x := plain(part))]


class Book:
    """Known sentences with their identifiers, and rules as sequences of identifiers."""

    def __init__(self, names=NAMES, notices=NOTICES, rules=RULES, gnu=None):
        self.ids: dict[str, str] = {}
        self.rules: list[tuple[str, tuple[str, ...]]] = []
        sequences = {name: self._learn(name, texts) for name, texts in notices.items()}
        for licence, parts in rules:
            for found in product(*(sequences[x] for x in parts)):
                self._rule(licence, sum(found, ()))
        for licence, texts in (gnu_notices() if gnu is None else gnu).items():
            for found in self._learn(licence, texts, own=True):
                self._rule(licence, found)
        for licence, own in names.items():
            refer = f"{licence}-ref".replace(".", "_")
            for name in own:
                forms = REFERENCES + (TITLES if "licen" in name.lower() else ())
                for form in forms:
                    # names with a full stop and a blank in them are more than one sentence
                    self._rule(licence, self._sequence(cut(form.format(name)), refer))
            if "spdx" in sequences:
                self._rule(licence, sequences["spdx"][0] + self._sequence(cut(licence), f"spdx-{licence}".replace(".", "_")))
        self.over = [[j for j, (_, b) in enumerate(self.rules) if len(b) > len(a) and _within(a, b)] for _, a in self.rules]

    def _sequence(self, sentences: list[str], name: str) -> tuple[str, ...]:
        if len(sentences) == 1:
            return (self.ids.setdefault(sentences[0], name),)
        return tuple(self.ids.setdefault(x, f"{name}-{i}") for i, x in enumerate(sentences))

    def _learn(self, name: str, texts: tuple[str, ...], own: bool = False) -> list[tuple[str, ...]]:
        """Sequences of a notice's alternatives; their sentences share identifiers, unless each is its ``own`` notice."""
        base = name.replace(".", "_")
        return list(dict.fromkeys(self._sequence(cut(x), f"{base}-{i}" if own else base) for i, x in enumerate(texts)))

    def anchored(self) -> bool:
        """Whether each rule has an identifier all of whose sentences hold an anchor."""
        bare = {k for x, k in self.ids.items() if not any(a in x for a in ANCHORS)}
        return all(set(ids) - bare for _, ids in self.rules)

    def _rule(self, licence: str, ids: tuple[str, ...]) -> None:
        if (licence, ids) not in self.rules:
            self.rules.append((licence, ids))


def _within(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    rest = iter(b)
    return all(x in rest for x in a)


BOOK = Book()


def normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def holding(ids: Column, book: Book) -> Column:
    """(rule, license) of the rules that a text's identifiers follow, less those that another of them contains."""
    strings = lambda xs: F.array(*map(F.lit, xs))
    table = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(name).alias("license"), strings(x).alias("ids"), (F.array(*map(F.lit, book.over[k])) if book.over[k] else F.array().cast("array<int>")).alias("over")) for k, (name, x) in enumerate(book.rules)])
    follows = lambda r: F.aggregate(ids, F.lit(0), lambda state, x: F.when(x == F.get(r["ids"], state), state + 1).otherwise(state)) == F.size(r["ids"])
    return F.filter(table, lambda r: F.array_contains(ids, F.get(r["ids"], F.lit(0))) & F.array_contains(ids, F.element_at(r["ids"], -1)) & follows(r))


def scan(docs: DataFrame, book: Book = BOOK) -> DataFrame:
    """doc_id, license, n_rules (rules of the licence that hold), n_sentences (known sentences in the text)."""
    spark = docs.sparkSession
    known = literal_table(spark, list(book.ids.items()), "sentence id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    if book.anchored():
        texts = texts.where(F.lower("text").rlike("|".join(a.replace(" ", "[^a-z0-9]+") for a in ANCHORS)))
    cuts = F.array(F.struct(F.lit(0).alias("cut"), F.split("text", SENTENCE_END).alias("parts")), F.struct(F.lit(1).alias("cut"), F.split("text", FLOWING_END).alias("parts")))
    parts = texts.select(row_key("doc_id", "text").alias("key"), "doc_id", F.explode(cuts).alias("c")).select("key", "doc_id", "c.cut", F.posexplode("c.parts").alias("pos", "part"))
    hits = parts.withColumn("sentence", normal(F.col("part"))).join(F.broadcast(known), "sentence")
    order = F.array_sort(F.collect_set(F.struct("pos", "id")))
    texts = hits.groupBy("key", "doc_id", "cut").agg(order.alias("hits")).withColumn("ids", F.transform("hits", lambda x: x["id"]))
    held = texts.select("key", "doc_id", F.size("hits").alias("n"), holding(F.col("ids"), book).alias("held"))
    rules = F.transform("held", lambda r: r["rule"])
    found = held.withColumn("rules", rules).select("key", "doc_id", "n", F.explode(F.filter("held", lambda r: ~F.arrays_overlap(r["over"], F.col("rules")))).alias("r"))
    by = found.groupBy("key", "doc_id", F.col("r.license").alias("license"), F.col("r.rule").alias("rule")).agg(F.max("n").alias("n"))
    return by.groupBy("key", "doc_id", "license").agg(F.count("*").alias("n_rules"), F.max("n").cast("long").alias("n_sentences")).drop("key")


def sql(book: Book = BOOK) -> str:
    """The same in SQL; the cuts' look-behind is written as a mark after each end, a rule as a regular expression over the identifiers between bars."""
    known = ", ".join(f"('{x}', '{k}')" for x, k in book.ids.items())
    pattern = lambda ids: r"(\|[^|]+)*".join(rf"\|{x}" for x in ids) + r"(\||$)"
    held = ", ".join(f"({k}, '{name}', '{pattern(ids)}', {book.over[k]}::INTEGER[])" for k, (name, ids) in enumerate(book.rules))
    return rf"""
WITH d AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id, text) k FROM documents),
t AS (SELECT row_number() OVER () rid, doc_id, text FROM d WHERE k = 1 AND text IS NOT NULL),
c AS (SELECT rid, 0 cut, string_split(regexp_replace(regexp_replace(text, '([.;:!?])[ \t\r]+', '\1' || chr(1), 'g'), '\r?\n', chr(1), 'g'), chr(1)) parts FROM t
 UNION ALL SELECT rid, 1, string_split(regexp_replace(regexp_replace(text, '([.;:!?])\s+', '\1' || chr(1), 'g'), '\n\s*\n', chr(1), 'g'), chr(1)) FROM t),
p AS (SELECT rid, cut, unnest(parts) part, generate_subscripts(parts, 1) pos FROM c),
known(sentence, id) AS (VALUES {known}),
h AS (SELECT rid, cut, pos, id FROM p JOIN known ON sentence = trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g'))),
s AS (SELECT rid, cut, count(*) n, '|' || string_agg(id, '|' ORDER BY pos) ids FROM h GROUP BY ALL),
rules(rule, license, pattern, over_) AS (VALUES {held}),
f AS (SELECT rid, cut, license, rule, over_, n FROM s JOIN rules ON regexp_matches(ids, pattern)),
a AS (SELECT rid, cut, list(rule) held FROM f GROUP BY ALL),
g AS (SELECT rid, license, rule, max(n) n FROM f JOIN a USING (rid, cut) WHERE NOT list_has_any(over_, held) GROUP BY ALL)
SELECT doc_id, license, count(*) n_rules, max(n) n_sentences FROM g JOIN t USING (rid) GROUP BY doc_id, rid, license
"""
