"""Licence scans by sentence rules.

A text is cut into sentences (at line ends, and at .!?;: before white space or the end), each normalised to
lower-case ASCII letters and digits with single spaces. Known licence sentences have identifiers; they may go over
line ends, but not over blank lines (without a letter or digit) or ends of sentences. Where two fit, the first and longer counts.
"Licensed under" stands for the usual forms of a notice (NOTICE), which may name several licences and go on after them ("see ..", "at your option").
Files' SPDX expressions are read too; a licence's title counts where nothing else is said. Known sentences are looked up in a tree of their words, so that
a text costs the same however many there are. The identifiers of a text, in order, are matched against ordered rules: a rule fits where its identifiers
follow one another among the known sentences, and takes them, so that later rules do not see them.

Null and empty texts have no sentences and no licence. Repeated rows are scanned alike; an empty table
gives no rows; other columns are kept, whatever their names, but for the four that are added (replaced if they exist).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lower_ascii, table, unused

# Normalised licence sentences and their identifiers, as the SQL has them; more are in KNOWN.
SENTENCES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied": "as-is",
    "licensed under the apache license version 2 0": "apache2",
    "licensed under the apache license version 2 0 the license": "apache2",
    "you may not use this file except in compliance with the license": "apache2-use",
    "this work is licensed under the gnu general public license version 3": "gpl3",
    "licensed under the gnu general public license version 3": "gpl3",
    "licensed under the gnu general public license version 2": "gpl2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "this work is dedicated to the public domain": "public-domain",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-terms",
    "all rights reserved": "reserved",
}
#: (licence, identifiers in order, restricted); earlier rules first. The SQL's; more are in ALL_RULES.
RULES = (
    ("Apache-2.0", ("apache2", "apache2-use"), False),
    ("MIT", ("mit-grant", "mit-notice", "as-is"), False),
    ("MIT", ("mit-grant", "mit-notice"), False),
    ("BSD", ("reserved", "bsd-terms"), False),
    ("BSD", ("bsd-terms",), False),
    ("MIT", ("mit",), False),
    ("Apache-2.0", ("apache2",), False),
    ("GPL-3.0", ("gpl3",), True),
    ("GPL-2.0", ("gpl2",), True),
    ("CC-BY-NC-4.0", ("cc-by-nc",), True),
    ("CC-BY-SA-4.0", ("cc-by-sa",), True),
    ("CC-BY-4.0", ("cc-by",), False),
    ("PUBLIC-DOMAIN", ("public-domain",), False),
    ("ALL-RIGHTS-RESERVED", ("reserved",), True),
)
_END, _LINE = "\x01", "\x02"
#: Before the licences that a file is marked with.
_MARK = f"spdx license identifier{_END}"

#: Names after "licensed under", without "the": identifier.
_NAMED = {
    "mit": "mit license|mit licence|mit|x11 license|expat license|mit x11 license",
    "apache2": "apache license version 2 0|apache license 2 0|apache license v2 0|apache license v2|apache 2 0 license|apache 2 license|apache 2 0|apache software license version 2 0",
    "bsd": "bsd license|bsd licence|bsd 2 clause license|bsd 3 clause license|2 clause bsd license|3 clause bsd license|new bsd license|simplified bsd license|modified bsd license|bsd style license|bsd 2 clause|bsd 3 clause",
    "isc": "isc license|isc licence|isc",
    "zlib": "zlib license|zlib libpng license|zlib",
    "boost": "boost software license version 1 0|boost software license 1 0",
    "unlicense": "unlicense",
    "mpl2": "mozilla public license version 2 0|mozilla public license 2 0|mozilla public license v2 0|mpl 2 0|mpl version 2 0",
    "cc0": "cc0 1 0|cc0|cc0 1 0 universal",
    "cc-by": "cc by 4 0|cc by 4 0 license|creative commons attribution 4 0 international license|creative commons attribution 4 0 license",
    "cc-by-sa": "cc by sa 4 0|cc by sa 4 0 license|creative commons attribution sharealike 4 0 international license|creative commons attribution share alike 4 0 international license",
    "cc-by-nc": "cc by nc 4 0|cc by nc 4 0 license|creative commons attribution noncommercial 4 0 international license|creative commons attribution non commercial 4 0 international license",
}
#: Identifiers after "SPDX-License-Identifier:", normalised.
_SPDX = {
    "mit": "mit|mit 0|x11", "apache2": "apache 2 0", "bsd": "bsd 2 clause|bsd 3 clause|0bsd|bsd 4 clause", "isc": "isc", "mpl2": "mpl 2 0|mpl 2 0 no copyleft exception", "cc0": "cc0 1 0",
    "unlicense": "unlicense", "zlib": "zlib", "boost": "bsl 1 0", "cc-by": "cc by 4 0", "cc-by-sa": "cc by sa 4 0", "cc-by-nc": "cc by nc 4 0",
}
_TEXTS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-as-is",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "apache license version 2 0 january 2004": "apache2",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2",
    "mozilla public license version 2 0": "mpl2",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this software is provided as is without any express or implied warranty": "zlib-as-is",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "boost software license version 1 0 august 17th 2003": "boost",
}
_GNU = (
    ("gpl2", "gnu general public license", "gpl", "2", ", june 1991"), ("gpl3", "gnu general public license", "gpl", "3", ", 29 june 2007"), ("lgpl21", "gnu lesser general public license", "lgpl", "2 1", ", february 1999"),
    ("lgpl3", "gnu lesser general public license", "lgpl", "3", ", 29 june 2007"), ("agpl3", "gnu affero general public license", "agpl", "3", ", 19 november 2007"),
)


def _known() -> dict[str, str]:
    out = SENTENCES | _TEXTS
    for table_, before in ((_NAMED, "licensed under "), (_SPDX, f"spdx license identifier{_END}")):
        out |= {before + name: i for i, names in table_.items() for name in names.split("|")}
    for i, name, short, v, date in _GNU:
        full = v if " " in v else f"{v} 0"
        forms = {f"{name} version {v}", f"{name} version {v} or later", f"{name} version {v} or any later version", f"{name} version {full}", f"{name} v{v}", f"{name} v{full}", f"{short} v{v}", f"{short}v{v}", f"{short} {v}", f"{short} {full}", f"{short} version {v}"}
        forms |= {f"{x} or later" for x in forms if " or " not in x}
        out |= {f"licensed under {x}": i for x in sorted(forms)}
        out |= {f"spdx license identifier{_END}{short} {full}{x}": i for x in ("", " only", " or later")}
        out[f"{name} version {v}{date.replace(',', '')}"] = i
        terms = f"you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation"
        out[terms] = f"{short}-terms"
        for later in (f"either version {v} of the license or at your option any later version", f"version {v} of the license", f"version {v}"):
            out[f"{terms} {later}"] = i
        out[f"either version {v} of the license or at your option any later version"] = f"version-{v.replace(' ', '.')}"
    return out


KNOWN = _known()
_FITTING = (
    *(rule for short, name, v in (("gpl", "GPL-2.0", "2"), ("gpl", "GPL-3.0", "3"), ("lgpl", "LGPL-2.1", "2.1"), ("lgpl", "LGPL-3.0", "3"), ("agpl", "AGPL-3.0", "3")) for rule in [(name, (f"{short}-terms", f"version-{v}"), True)]),
    *RULES[:-1],
    ("BSD", ("reserved", "bsd"), False), ("BSD", ("bsd",), False), ("ISC", ("isc-grant",), False), ("ISC", ("isc",), False), ("MPL-2.0", ("mpl2",), False), ("CC0-1.0", ("cc0",), False), ("PUBLIC-DOMAIN", ("unlicense",), False), ("ZLIB", ("zlib-grant",), False), ("ZLIB", ("zlib",), False), ("BSL-1.0", ("boost",), False),
    ("LGPL-2.1", ("lgpl21",), True), ("LGPL-3.0", ("lgpl3",), True), ("AGPL-3.0", ("agpl3",), True),
    RULES[-1],
)
#: Reserved rights before a licence are those that it grants.
ALL_RULES = (*(r for name, needed, strict in _FITTING[:-1] for r in ([] if needed[0] == "reserved" else [(name, ("reserved", *needed), strict)]) + [(name, needed, strict)]), _FITTING[-1])
#: How a notice may begin: "this project is licensed under the terms of the ..".
NOTICE = (
    r"(?:(?:(?:[a-z0-9]+ ){1,5}(?:is|are) )?(?:licensed|released|distributed|available|made available|provided|published) under (?:the terms of )?(?:the )?"
    r"|use of this source code is governed by (?:an? |the )?)"
)
#: A notice may go on: with one of these words after a name, or with other names after or and and.
_TAILS = "see|at|that|which|for|refer"
#: Titles, which count if a text begins with one and says nothing else: identifier.
TITLES = {"mit license": "mit", "apache license": "apache2", "isc license": "isc", "zlib license": "zlib", "boost software license": "boost", "mozilla public license": "mpl2", "bsd license": "bsd", "bsd 2 clause license": "bsd", "bsd 3 clause license": "bsd"}


def word_tree(sentences: list[str], gap: str, end: str) -> str:
    """A regular expression of the sentences, branched by words; a longer one is tried before one that it begins with."""
    tree: dict = {}
    for s in sentences:
        at = tree
        for word in s.split(" "):
            at = at.setdefault(word, {})
        at[""] = {}

    def shape(at: dict, first: bool) -> str:
        ways = [("" if first else gap) + word + shape(below, False) for word, below in sorted(at.items()) if word] + [end] * ("" in at)
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return shape(tree, True)


def scan(docs: DataFrame, text: str = "text", sentences: dict[str, str] = KNOWN, rules=ALL_RULES, titles: dict[str, str] = TITLES) -> DataFrame:
    """docs with n_sentences, sentence_ids (known ones, in order, joined by |), licenses (sorted, joined by |), restricted."""
    plain = F.translate(lower_ascii(F.coalesce(F.col(text), F.lit(""))), _LINE, " ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"[.!?;:]+([ \t\n\r\f]|\z)", _END), r"\r\n?|\n", _LINE)
    plain = F.regexp_replace(plain, rf"[^a-z0-9{_END}{_LINE}]+", " ")
    # ends and blank lines, then single line ends
    plain = F.regexp_replace(plain, rf"[ {_LINE}]*{_END}[ {_END}{_LINE}]*|[ {_LINE}]*{_LINE} *{_LINE}[ {_LINE}]*", _END)
    plain = F.concat(F.lit(_END), F.trim(F.regexp_replace(plain, rf" *{_LINE} *", _LINE)), F.lit(_END))
    short = {re.sub(rf"^{NOTICE}", "under ", s): i for s, i in sentences.items()}
    whole, gap, end = unused(docs, "plain"), f"[ {_LINE}]", f"(?=[{_END}{_LINE}])"
    notices, marked = [s.removeprefix("under ") for s in short if s.startswith("under ")], [s.removeprefix(_MARK) for s in short if s.startswith(_MARK)]
    others = [s for s in short if not s.startswith(("under ", _MARK))]
    word, also = "(?![a-z0-9])", f"{gap}(?:and{gap}or|or|and){gap}(?:the{gap})?"
    listed = lambda names, more: f"{names}{more}(?:{also}{names}{more})*"
    ways = []
    if notices:
        tail = f"(?=[{_END}{_LINE}]|{gap}(?:{_TAILS.replace(' ', gap)})(?:{gap}|[{_END}{_LINE}]))"
        ways.append(f"{NOTICE.replace(' ', gap)}(?:(?:either|both){gap}(?:of{gap})?(?:the{gap})?)?{listed(word_tree(notices, gap, word), '')}{tail}")
    if marked:
        ways.append(f"{_MARK.replace(' ', gap)}{listed(word_tree(marked, gap, word), f'(?:{gap}with(?:{gap}[a-z0-9]+){{1,5}}?)?')}{end}")
    ways += [word_tree(others, gap, end)] * bool(others)
    shape = rf"(?<=[{_END}{_LINE}])(?:{'|'.join(ways)})"
    known = F.create_map(*[F.lit(x) for pair in short.items() for x in pair])
    docs = docs.withColumn(whole, plain)
    found = F.regexp_extract_all(whole, F.lit(shape), F.lit(0)) if short else F.array().cast("array<string>")
    names = lambda s, words, before: F.transform(F.regexp_extract_all(s, F.lit(f"(?<![a-z0-9]){word_tree(words, ' ', '(?![a-z0-9])')}"), F.lit(0)), lambda n: known[F.concat(F.lit(before), n)])

    def ids_of(s):
        s = F.translate(s, _LINE, " ")
        out = F.when(F.startswith(s, F.lit(_MARK)), names(F.substring(s, len(_MARK) + 1, 1 << 20), marked, _MARK)) if marked else F
        if notices:
            out = out.when(s.rlike(f"^{NOTICE}"), names(F.regexp_replace(s, f"^{NOTICE}", ""), notices, "under "))
        return F.array(known[s]) if out is F else out.otherwise(F.array(known[s]))

    ids = F.flatten(F.transform(found, ids_of))
    if titles:
        title = F.create_map(*[F.lit(x) for pair in titles.items() for x in pair])
        alone = F.transform(F.regexp_extract_all(whole, F.lit(rf"(?<=^{_END}){word_tree(list(titles), gap, end)}"), F.lit(0)), lambda s: title[F.translate(s, _LINE, " ")])
        ids = F.when(F.size(found) > 0, ids).otherwise(alone)
    parts = F.filter(F.split(whole, f"[{_END}{_LINE}]"), lambda s: F.trim(s) != "")
    docs = docs.withColumns({"n_sentences": F.size(parts).cast("long"), "sentence_ids": F.array_join(ids, "|")}).drop(whole)
    # every identifier has bars of its own, so that a rule's can't overlap with a neighbour's
    left = F.when(F.col("sentence_ids") == "", F.lit("")).otherwise(F.concat(F.lit("|"), F.replace(F.col("sentence_ids"), F.lit("|"), F.lit("||")), F.lit("|")))
    names, restricted = [], F.lit(False)
    for name, needed, strict in rules:
        shape = "".join(f"|{x}|" for x in needed)
        hit = F.contains(left, F.lit(shape))
        names.append(F.when(hit, F.lit(name)))
        restricted = restricted | hit if strict else restricted
        left = F.replace(left, F.lit(shape), F.lit("#"))
    return docs.withColumns({"licenses": F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*names)))), "|"), "restricted": restricted})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_sentences", "sentence_ids", "licenses", "restricted")


def _sql() -> str:
    known = ", ".join(f"'{s}': '{i}'" for s, i in SENTENCES.items())
    steps, left = [], "s0"
    for i, (name, needed, strict) in enumerate(RULES, 1):
        shape = "".join(f"|{x}|" for x in needed)
        steps.append(f"r{i} AS (SELECT *, contains({left}, '{shape}') AS h{i}, replace({left}, '{shape}', '#') AS s{i} FROM r{i - 1})")
        left = f"s{i}"
    names = ", ".join(f"CASE WHEN h{i} THEN '{name}' END" for i, (name, _, _) in enumerate(RULES, 1))
    strict = " OR ".join(f"h{i}" for i, r in enumerate(RULES, 1) if r[2])
    return rf"""
WITH t AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.!?;:]+([ \t\n\r\f]|\z)|[\n\r]+', chr(1), 'g') AS t FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '[^a-z0-9\x01]+', ' ', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS parts FROM t),
k AS (SELECT doc_id, len(parts)::BIGINT AS n_sentences, coalesce(list_filter(list_transform(parts, lambda s: MAP {{{known}}}[s]), lambda x: x IS NOT NULL), []) AS ids FROM p),
r0 AS (SELECT doc_id, n_sentences, array_to_string(ids, '|') AS sentence_ids, array_to_string(list_transform(ids, lambda x: '|' || x || '|'), '') AS s0 FROM k),
{", ".join(steps)}
SELECT doc_id, n_sentences, sentence_ids, array_to_string(list_sort(list_distinct(list_filter([{names}], lambda x: x IS NOT NULL))), '|') AS licenses, ({strict}) AS restricted FROM r{len(RULES)}
"""


SQL = _sql()
