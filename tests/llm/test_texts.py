import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_id, licenses, lm_scoring, media_jpeg, ngram_join, token_counts
from tests.llm.helpers import SCHEMA, documents, frame, prose

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    rows = token_counts.count_tokens(frame(spark), VOCABULARY).collect()
    assert len(rows) == len(documents())
    texts = sorted((r[0] or -1, r[1] or "") for r in documents())
    for (_, t), r in zip(texts, sorted(rows, key=lambda r: r.doc_id or -1), strict=True):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 512)
    assert token_counts.count_tokens(frame(spark, []), VOCABULARY).count() == 0


def test_token_counts_of_odd_texts():
    from tokenizers import Tokenizer

    library, counter, r = Tokenizer.from_file(VOCABULARY), token_counts.Counter(VOCABULARY), random.Random(1)
    pieces = [" ", "\n", "a", "é", "1", "'s", "²", "\x1c", "\xa0", "<|endoftext|>", "-", "数", "\t", "Ⅷ", "\u2028"]
    texts = ["", "  ", "a  b", "a \nb", "a" * 3000, *("".join(r.choice([*pieces, chr(r.randrange(1, 0xD7FF))]) for _ in range(r.randrange(1, 30))) for _ in range(800))]
    assert [counter.count(t) for t in texts] == [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def test_media_round_trip(spark):
    rows = media_jpeg.store_texts(frame(spark), keep=True).collect()
    assert len(rows) == len(documents())
    made = {}
    for r in rows:
        image, blocks = media_jpeg.decode([bytes(r.media)])[0]
        payload = media_jpeg.payload_of(image, blocks)
        assert r.payload_bytes == len(payload) and len(payload) % 64 == 0 and len(payload) > 0
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        assert made.setdefault(payload, r.feature) == r.feature
    want = sorted((t or "").encode() + bytes(-len((t or "").encode()) % 64 or (0 if t else 64)) for t in (x[1] for x in documents()))
    assert sorted(hashlib.sha256(w).hexdigest() for w in want) == sorted(r.payload_sha256 for r in rows)
    assert media_jpeg.store_texts(frame(spark, [])).count() == 0


def test_thumbnail_pixel_is_the_first_byte_of_each_block():
    payload = bytes(range(256)) * 4
    image, blocks = media_jpeg.decode(media_jpeg.payloads_to_jpeg([payload]))[0]
    assert (image.width, image.height) == (128, 8)
    assert media_jpeg.thumbnail(image, blocks).tolist() == [list(payload[::64])]


def test_jpeg_of_three_components_and_long_intervals():
    """A 4:2:0 file written here block by block: markers, sampling and prediction across blocks."""
    import struct

    seg = media_jpeg._segment
    dc, ac = (dict((s, (c, k)) for s, c, k in media_jpeg.codes_of(*t)) for t in (media_jpeg.DC_TABLE, media_jpeg.AC_TABLE))
    lum = [[5, -7, 100, 3], [0, 0, -20, 9]]
    bits, before = "", [0, 0, 0]
    for mcu in lum:
        for c, values in ((0, mcu), (1, [1]), (2, [-1])):
            for v in values:
                d, before[c] = v - before[c], v
                n = abs(d).bit_length()
                code, k = dc[n]
                bits += f"{code:0{k}b}" + (f"{d if d > 0 else d + (1 << n) - 1:0{n}b}" if n else "") + f"{ac[0][0]:0{ac[0][1]}b}"
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    head = [b"\xff\xd8", seg(0xDB, b"\0" + bytes([8]) * 64), seg(0xC0, struct.pack(">BHHB", 8, 16, 32, 3) + b"\1\x22\0\2\x11\0\3\x11\0"), seg(0xC4, b"\0" + b"".join(media_jpeg.DC_TABLE)), seg(0xC4, b"\x10" + b"".join(media_jpeg.AC_TABLE))]
    file = b"".join(head) + seg(0xDA, b"\3\1\0\2\0\3\0\0\x3f\0") + scan + b"\xff\xd9"
    image, blocks = media_jpeg.decode([file])[0]
    assert media_jpeg.thumbnail(image, blocks).tolist() == [[133, 121, 128, 128], [228, 131, 108, 137]]


def test_jpeg_of_several_scans():
    """4:2:0 of 30 x 10 pixels, each component in a scan of its own, luminance second."""
    import struct

    seg = media_jpeg._segment
    dc, ac = (dict((s, (c, k)) for s, c, k in media_jpeg.codes_of(*t)) for t in (media_jpeg.DC_TABLE, media_jpeg.AC_TABLE))

    def scan(number, values):
        bits, before = "", 0
        for v in values:
            d, before = v - before, v
            n = abs(d).bit_length()
            code, k = dc[n]
            bits += f"{code:0{k}b}" + (f"{d if d > 0 else d + (1 << n) - 1:0{n}b}" if n else "") + f"{ac[0][0]:0{ac[0][1]}b}"
        bits += "1" * (-len(bits) % 8)
        return seg(0xDA, bytes([1, number, 0, 0, 0x3F, 0])) + int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")

    tables = seg(0xC4, b"\0" + b"".join(media_jpeg.DC_TABLE)) + seg(0xC4, b"\x10" + b"".join(media_jpeg.AC_TABLE))
    head = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([8]) * 64) + seg(0xC0, struct.pack(">BHHB", 8, 10, 30, 3) + b"\1\x22\0\2\x11\0\3\x11\0") + tables
    file = head + scan(2, [1, 1]) + tables + scan(1, [5, -7, 0, 0, 100, 3, -20, 9]) + scan(3, [-1, -1]) + b"\xff\xd9"
    image, blocks = media_jpeg.decode([file])[0]
    assert (image.width, image.height) == (30, 10)
    assert media_jpeg.thumbnail(image, blocks).tolist() == [[133, 121, 128, 128], [228, 131, 108, 137]]


def test_broken_files_give_nulls(spark):
    good = media_jpeg.payloads_to_jpeg([b"x" * 640])[0]
    rows = [(1, good), (2, good[:40]), (3, b""), (4, None), (5, good.replace(b"\xff\xc0", b"\xff\xc2")), (6, good[:-60])]
    frame_at = good.index(b"\xff\xc0")
    wide = good[: frame_at + 5] + b"\xff\xff\xff\xff" + good[frame_at + 9 :]  # says 65,535 by 65,535
    no_sampling = good[: frame_at + 11] + b"\0" + good[frame_at + 12 :]
    rows += [(7, wide), (8, wide.replace(b"\xff\xdd\0\4\0\1", b"\xff\xdd\0\4\0\0")), (9, no_sampling), (10, good.replace(b"\xff\xdb\0\x43", b"\xff\xee\0\x43")), (11, good.replace(b"\xff\xc4", b"\xff\xee"))]
    r = random.Random(3)
    for i in range(300):  # any byte changed anywhere: a result or null, and whole ones beside it stay
        at = r.randrange(len(good))
        rows.append((100 + i, good[:at] + bytes([r.randrange(256)]) + good[at + 1 :]))
    rows.append((500, good))
    got = {r.key: r for r in media_jpeg.describe(spark.createDataFrame(rows, "i long, f binary").coalesce(1), "i", "f").collect()}
    assert {k: v.width for k, v in got.items() if k < 100} == {1: 80} | dict.fromkeys(range(2, 12)) and len(got) == len(rows)
    assert got[500][1:] == got[1][1:] and got[1].thumbnail == b"x" * 10
    assert media_jpeg.describe(spark.createDataFrame([], "i long, f binary"), "i", "f").count() == 0


def test_images_of_any_tables_decode_together():
    files = media_jpeg.payloads_to_jpeg([bytes(range(64)) * n for n in (1, 3, 70)])
    alone = [media_jpeg.decode([f])[0] for f in files]
    for got, want in zip(media_jpeg.decode([files[2], files[0], b"broken", files[1]], strict=False), [alone[2], alone[0], None, alone[1]], strict=True):
        assert (got is None) == (want is None) and (got is None or (got[1] == want[1]).all())
    dc = media_jpeg.decode(files, whole=False)
    assert all((a[1][:, 0] == b[1][:, 0]).all() and a[1].shape[1] == 1 for a, b in zip(dc, alone, strict=True))
    with pytest.raises(ValueError):
        media_jpeg.decode([files[0], b"broken"])


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = ngram_join.words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parts = ngram_join.Union()
    for i, j in itertools.combinations(range(len(rows)), 2):
        o = len(sets[i] & sets[j])
        if o and 100 * o >= 80 * len(sets[i] | sets[j]):
            parts.join(i, j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[parts.root(i)] = min(d, ids.get(parts.root(i), d))
    return sorted(((d, len(sets[i]), ids.get(parts.root(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_ngram_join_against_brute_force(spark):
    base = prose(90, 11).split()
    rows = [(r[0], r[1]) for r in documents()]
    r = random.Random(5)
    long = dict(rows)[10].split()  # a very long text, a near copy, and one that is not quite
    rows += [(20, " ".join(long[:29_000])), (21, " ".join(long[: len(long) * 3 // 4]))]
    for i in range(60):  # a family around one text: some link to the hub only, some to none
        w = list(base)
        for _ in range(i % 7):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((100 + i, " ".join(w)))
    for i in range(40):  # a passage that many unrelated texts share
        rows.append((300 + i, prose(40, 100 + i) + " " + " ".join(base[:50])))
    docs = spark.createDataFrame([(d, t, None, None, 0, "x", 1, 2, 3, "y") for d, t in rows], SCHEMA)
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.join(docs).collect()), key=str)
    assert got == brute_components(rows)
    assert ngram_join.join(frame(spark, [])).count() == 0


def test_ngram_join_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 100)
    base = prose(60, 21).split()
    rows, r = [], random.Random(9)
    for i in range(24):
        w = list(base)
        for _ in range(1 + i % 4):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute_components(rows)


def test_prefix_bound_on_random_sets():
    """Sets that link share as many prefix tokens as the bound asks."""
    r, heavy = random.Random(3), np.arange(0, 400, 7)
    for _ in range(400):
        a = np.array(sorted(r.sample(range(400), r.randrange(1, 120))))
        drop = r.randrange(0, 1 + len(a) // 5)
        b = np.array(sorted(set(r.sample(a.tolist(), len(a) - drop)) | set(r.sample(range(400), r.randrange(0, 6)))))
        o = len(np.intersect1d(a, b))
        if 100 * o >= 80 * len(np.union1d(a, b)):
            shared = np.intersect1d(np.concatenate(ngram_join._prefix(a, heavy)), np.concatenate(ngram_join._prefix(b, heavy)))
            for n in (len(a), len(b)):
                assert len(shared) >= 1 + ngram_join.needed(n) // 10


LANGUAGES = {"en": "the of and that with ing", "de": "der und die nicht sch keit", "ru": "это и не что как"}


def labelled(n=60):
    r = random.Random(2)
    rows = []
    for i in range(n):
        name = list(LANGUAGES)[i % 3]
        rows.append((i, " ".join(r.choice(LANGUAGES[name].split()) for _ in range(30)), name, "s"))
    return rows


def test_language_id_held_out_and_edges(spark):
    rows = labelled() + [(1000, None, None, "s"), (1001, "12 !", "en", None), (1002, "", None, None), (None, "the of and", "en", "s"), (1003, "数据", None, None), (1003, "数据", None, None)]
    docs = spark.createDataFrame([(*r, 0, "k", 1, 2, 3, "w") for r in rows], SCHEMA)
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.words == "w"
        if r.doc_id is not None and r.doc_id < 1000:
            assert r.lang_pred == r.lang
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score) == ("und", 0)
        if r.doc_id == 1003:
            assert (r.lang_pred in LANGUAGES, r.score) == (True, 0)
    own = docs.withColumns({"lang_pred": F.lit("x"), "score": F.lit(7), "held_out": F.lit("y")})  # replaced, as the docstring says
    assert sorted(map(str, language_id.identify(own).select("doc_id", "lang_pred", "score", "held_out").collect())) == sorted(str(r) for r in language_id.identify(docs).select("doc_id", "lang_pred", "score", "held_out").collect())
    assert {r.lang_pred for r in language_id.identify(docs.where("doc_id >= 1000 and lang is null")).collect()} == {"und"}
    assert language_id.identify(frame(spark, [])).count() == 0


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(4)
    lengths = np.array([0, 5, 3, 1, 0, 6])
    scores = r.normal(size=(lengths.sum(), 3)).astype(np.float32)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    path = language_id.viterbi(scores, starts, lengths, 0.7)
    for s, n in zip(starts, lengths, strict=True):
        value = lambda p: sum(scores[s + i, c] for i, c in enumerate(p)) - 0.7 * sum(a != b for a, b in itertools.pairwise(p))  # noqa: B023, E731
        if n:
            assert value(path[s : s + n]) == pytest.approx(max(map(value, itertools.product(range(3), repeat=int(n)))), abs=1e-5)


def test_spans_of_mixed_text(spark):
    docs = spark.createDataFrame(labelled(), "doc_id long, text string, lang string, source string")
    model = language_id.learn(docs, F.lit(True), "doc_id", "text", "lang")
    text = " the of and that with the\ndie der nicht und keit der \x1f это и не "
    long = " ".join(["the of and that with"] * 6000 + ["die der nicht und keit"] * 6000)
    rows = [(1, text), (2, None), (3, "  "), (None, "12 34"), (4, long), (4, long)]
    got = {}
    for r in language_id.spans(spark.createDataFrame(rows, "doc_id long, text string"), model, penalty=4.0).collect():
        got.setdefault(r.doc_id, []).append([(s.lang, s.start, s.end) for s in r.spans])
    assert [(lang, text[a:z]) for lang, a, z in got[1][0]] == [("en", "the of and that with the"), ("de", "die der nicht und keit der"), ("ru", "это и не")]
    assert got[2] == [[]] and got[3] == [[]] and len(got[None][0]) == 1
    at = long.index("die")
    assert got[4] == [[("en", 0, at - 1), ("de", at, len(long))]] * 2


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."
    rows = [
        (1, "Some text.\nReleased under the MIT License.\nMore", "MIT", False), (2, "All rights reserved", "ALL-RIGHTS-RESERVED", True), (3, None, "", False), (4, "", "", False),
        (5, "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0!", "Apache-2.0|CC-BY-NC-4.0", True), (6, "the MIT License", "", False),
        (7, f"{mit}\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "MIT", False),
        (8, "All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "BSD", False), (8, "x " * 20000 + ". All rights reserved.", "ALL-RIGHTS-RESERVED", True),
    ]
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _, _ in rows], "doc_id long, text string, licenses string")
    got = licenses.scan(docs).collect()
    assert sorted((r.doc_id, r.licenses, r.restricted) for r in got) == sorted((i, x, y) for i, _, x, y in rows)
    assert licenses.scan(docs.where("false")).count() == 0


MIT_TEXT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD_TEXT = """Copyright (c) 2020, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
"""
LGPL_TEXT = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
"""


def test_licences_in_full(spark):
    rows = [
        (1, MIT_TEXT, "MIT", False, "mit-grant|mit-notice|as-is|mit-liability"), (2, MIT_TEXT.replace("\n", "\r\n# "), "MIT", False, "mit-grant|mit-notice|as-is|mit-liability"), (3, BSD_TEXT, "BSD", False, "reserved|bsd-terms|bsd-source"),
        (4, LGPL_TEXT, "LGPL-2.1", True, "lgpl-terms|version-2.1"), (5, "This file is licensed under the MIT License.", "MIT", False, "mit"), (6, "// SPDX-License-Identifier: AGPL-3.0-or-later\nint x;", "AGPL-3.0", True, "agpl3"),
        (7, "MIT\nISC\n\nMozilla", "", False, ""), (8, "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.", "MPL-2.0", False, "mpl2"),
        (9, "released under the\n\nMIT License", "", False, ""), (10, "we never saw it released under the MIT License", "", False, ""), (11, "x\x02y\nAll rights\nreserved", "ALL-RIGHTS-RESERVED", True, "reserved"),
        (12, "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC", False, "isc-grant"),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert [(i, got[i].licenses, got[i].restricted, got[i].sentence_ids) for i, *_ in rows] == [(i, *r) for i, _, *r in rows]
    assert got[7].n_sentences == 3 and got[9].n_sentences == 2 and got[5].n_sentences == 1


def test_notices_that_go_on(spark):
    rows = [
        ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT", False, "mit"), ("Code is licensed under MIT.", "MIT", False, "mit"), ("MIT License", "MIT", False, "mit"), ("MIT License\n\nAll rights reserved.", "ALL-RIGHTS-RESERVED", True, "reserved"),
        ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "Apache-2.0|MIT", False, "apache2|mit"), ("// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;", "Apache-2.0|MIT", False, "mit|apache2"),
        ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "BSD", False, "bsd"), ("Copyright 2009 The Authors. All rights reserved.\nUse of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file.", "BSD", False, "reserved|bsd"),
        ("All rights reserved. Licensed under the MIT License.", "MIT", False, "reserved|mit"), ("Licensed under the MIT License. All rights reserved.", "ALL-RIGHTS-RESERVED|MIT", True, "mit|reserved"), ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause */", "BSD|GPL-2.0", True, "gpl2|bsd"),
        ("SPDX-License-Identifier: MIT AND Unknown-1.0", "", False, ""), ("x\nMIT License", "", False, ""), ("This is not licensed under the MIT License.", "", False, ""), ("The licensed under the MIT Licensee", "", False, ""), ("It is licensed under the GPL v2 or later, at your option", "GPL-2.0", True, "gpl2"), ("dual licensed under MITX", "", False, ""),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "doc_id int, text string")).collect()}
    assert [(t, got[i].licenses, got[i].restricted, got[i].sentence_ids) for i, (t, *_) in enumerate(rows)] == rows


ZLIB_TEXT = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
GPL_TEXT = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
UNLICENSE_TEXT = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software"
APACHE_TEXT = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at'


def brute_licences(text):
    """(number of sentences, identifiers, licences, restricted), by trying every run of lines in a dictionary."""
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").replace("\x02", " ")
    paragraphs = []
    for sentence in re.split(r"[.!?;:]+(?:[ \t\n\r\f]|\Z)", text):
        lines = [" ".join(re.findall("[a-z0-9]+", x)) for x in re.split(r"\r\n?|\n", sentence)]
        paragraphs.append([[]])
        for x in lines:
            if x:
                paragraphs[-1][-1].append(x)
            elif paragraphs[-1][-1]:
                paragraphs[-1].append([])
    groups = [g for p in paragraphs for g in p if g]
    notice = re.compile(licenses.NOTICE)
    known = {}
    for s, i in licenses.KNOWN.items():
        m = notice.match(s)
        known[f"under {s[m.end():]}" if m else s] = i
    ids, at = [], 0
    lines = [(g, x) for g, group in enumerate(groups) for x in group]
    while at < len(lines):
        for z in range(len(lines), at, -1):
            run = lines[at:z]
            joined = ""
            for j, (g, x) in enumerate(run):
                joined += ("" if not j else " " if run[j - 1][0] == g else "\x01") + x
            m = notice.match(joined)
            found = known.get(f"under {joined[m.end():]}" if m else f"-{joined}" if joined.startswith("under ") else joined)
            if found:
                ids.append(found)
                at = z - 1
                break
        at += 1
    names, strict, left = set(), False, list(ids)
    for name, needed, restricted in licenses.ALL_RULES:
        k = 0
        while k + len(needed) <= len(left):
            if tuple(left[k : k + len(needed)]) == needed:
                names.add(name)
                strict |= restricted
                left[k : k + len(needed)] = [None]
            k += 1
    return len(lines), "|".join(ids), "|".join(sorted(names)), strict


def test_licences_against_brute_force(spark):
    r = random.Random(6)
    full = [(ZLIB_TEXT, "ZLIB"), (GPL_TEXT, "GPL-3.0"), (UNLICENSE_TEXT, "PUBLIC-DOMAIN"), (APACHE_TEXT, "Apache-2.0"), (MIT_TEXT, "MIT"), (BSD_TEXT, "BSD"), (LGPL_TEXT, "LGPL-2.1")]
    sentences = [s.replace("\x01", ": ") for s in licenses.KNOWN]
    texts = [t for t, _ in full]
    for _ in range(150):
        words = []
        for _ in range(r.randrange(1, 7)):
            s = r.choice([r.choice(sentences), "this file is " + r.choice(sentences), "some prose of no matter", "the", r.choice(texts)])
            s = s if r.random() < 0.7 else s.upper()
            words.append("".join(r.choice(["\n", "\r\n", "\n# ", " "]) if c == " " and r.random() < 0.15 else c for c in s) + r.choice([". ", "\n\n", "\n", "; ", " ", ":\n"]))
        texts.append("".join(words))
    texts += [None, "", "\n \n", "..."]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, plain string, _parts string")
    found = licenses.scan(docs).collect()
    got = {x.doc_id: (x.n_sentences, x.sentence_ids, x.licenses, x.restricted) for x in found}
    assert {(x.plain, x._parts) for x in found} == {("a", "b")}
    for i, t in enumerate(texts):
        assert got[i] == brute_licences(t), t
    assert [got[i][2] for i in range(len(full))] == [name for _, name in full]


def test_pseudo_likelihood(spark):
    common = " ".join(["the cat sat on the mat"] * 40)
    rows = [(i, common, "en", "a") for i in range(40)] + [(100, prose(200, 8), "en", "a"), (101, None, None, None), (102, " \n", None, None), (None, "the cat", None, None), (103, "the cat sat on the mat", "en", "a"), (104, " The\tcat sat on  the mat\n", "en", "a")]
    docs = spark.createDataFrame([(*r, 0, "k", 1, 2, 3, "w") for r in rows], SCHEMA)
    found = lm_scoring.score_documents(docs).collect()
    got = {r.doc_id: r for r in found}
    assert got[101].n_tokens == 0 and got[101].pll == 0 and got[101].mean_pll is None and got[102].pll == 0
    assert got[103].mean_pll > got[100].mean_pll and got[100].n_tokens == 200 and got[103][1:] == got[104][1:]
    assert len({r.pll for r in found if r.doc_id is not None and r.doc_id < 40}) == 1
    assert lm_scoring.score_documents(frame(spark, [])).count() == 0


def brute_pll(words, w, counts, text):
    """By loops over tokens, pieces in dictionaries; counts: of all pieces of the corpus."""
    place = {p: i for i, p in enumerate(words.pieces.to_pylist())}
    tokens = (text or "").lower().split()
    rare = lambda t: 1024 - 16 + t.encode()[0] % 16
    ids = [1024] * 2 + [int(words.ids[place[t]]) if t in place else rare(t) for t in tokens] + [1024] * 2
    letters = np.exp(words.letters).reshape(257, 8, 257)
    softmax = lambda x: np.exp(x) / np.exp(x).sum()
    total = 0.0
    for i, t in enumerate(tokens, 2):
        h = np.tanh(w["bias"] + w["context"][0][ids[i - 2]] + w["context"][1][ids[i - 1]] + w["context"][2][ids[i + 1]] + w["context"][3][ids[i + 2]])
        h = np.append(h, 1).astype(np.float64)
        p = softmax(h @ w["classes"])[ids[i] // 32] * softmax(h @ w["words"][ids[i] // 32])[ids[i] % 32]
        if t in place:
            p *= np.exp(words.logs[place[t]])
        else:
            spelled, a, b = 1.0, 256, 256
            for x in [*t.encode(), 256]:
                spelled *= letters[b, a % 8, x]
                a, b = b, x
            k = ids[i] - 1008
            spelled /= np.exp(words.whole[k])
            p *= (counts[t] - 1 - words.discount) * words.unit[k] + words.free[k] * spelled if counts[t] > 1 else words.alone[k] * spelled
        total += np.log(p)
    return total


def test_scores_against_brute_force_whatever_the_partitions(spark):
    r = random.Random(4)
    texts = [prose(r.choice([0, 1, 3, 60, 300]), i, 700) + r.choice(["", " rare", " Rare é" + str(i)]) for i in range(60)]
    texts += [texts[5], texts[6].upper(), prose(9000, 77, 2000)]
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    runs = [sorted(map(tuple, lm_scoring.score_documents(docs.repartition(n)).collect()), key=str) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2]
    sums = lm_scoring.counted(docs)
    words = lm_scoring.vocabulary(sums)
    w = lm_scoring.train(lm_scoring.encode(docs, words))
    counts = {x.word: x.n for x in sums.collect()}
    brute = Counter(t for text in texts for t in text.lower().split())
    assert counts == brute
    want = sorted(((i if i % 7 else None, len(t.split()), brute_pll(words, w, brute, t)) for i, t in enumerate(texts)), key=str)
    for got, (doc, n, pll) in zip(sorted(((x[0], x[1], x[2]) for x in runs[0]), key=str), want, strict=True):
        assert (got[0], got[1]) == (doc, n) and got[2] == pytest.approx(pll, abs=2e-3 + 1e-6 * n)


def test_a_tokens_log_does_not_depend_on_the_rows_beside_it():
    r = np.random.default_rng(3)
    w = {k: (v + r.normal(size=v.shape) * 0.3).astype(np.float64) for k, v in lm_scoring.start().items()}
    texts = [r.integers(0, lm_scoring.VOCABULARY, n) for n in (1, 2, 40, 700, 40)]
    texts[4] = texts[2]

    def logs(some):
        ids, places = lm_scoring._spread(np.concatenate(some), np.array([len(t) for t in some]))
        return np.split(np.rint(lm_scoring.log_probabilities(w, ids, places) * lm_scoring.FRACTION), np.cumsum([len(t) for t in some])[:-1])

    alone, together, turned = [logs([t])[0] for t in texts], logs(texts), logs(texts[::-1])[::-1]
    assert all((a == b).all() and (a == c).all() for a, b, c in zip(alone, together, turned, strict=True))


def test_every_document_trains(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} alpha beta gamma " * 20) for i in range(12)], "doc_id long, text string")
    encoded = lm_scoring.cut(lm_scoring.encode(docs, lm_scoring.vocabulary(lm_scoring.counted(docs))))
    whole = lm_scoring.train(encoded)
    for i in range(12):  # each one changes the network
        assert any(np.abs(whole[k] - v).max() > 0 for k, v in lm_scoring.train(encoded.where(f"doc_id <> {i}")).items())
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 100)
    monkeypatch.setattr(lm_scoring, "FAN", 3)
    many = [lm_scoring.train(encoded.repartition(n)) for n in (1, 4)]
    assert all((many[0][k] == many[1][k]).all() for k in whole) and any(np.abs(whole[k] - many[0][k]).max() > 0 for k in whole)


def test_token_probabilities_sum_to_one():
    w = lm_scoring.start()
    for x in w.values():
        x += np.random.default_rng(0).normal(size=x.shape).astype(np.float32) * 0.3
    ids = np.array([1024, 1024, 5, 6, 7, 1024, 1024])
    total = 0.0
    for y in range(lm_scoring.VOCABULARY):
        ids[3] = y
        total += float(np.exp(lm_scoring.log_probabilities(w, ids, np.array([3]))[0]))
    assert total == pytest.approx(1, abs=1e-3)


def test_pieces_of_an_id_sum_to_one():
    """Known ones are sure, listed ones share an id by counts, and rare ones have what is counted and what is left, which goes to all byte strings."""
    known, listed = ["a", "ab"], [(w, n) for n, w in enumerate(("b", "bb", "c", "q\u00e9", "zz"), 20)]
    rare = {"aab": 3, "ba": 1, "bc": 1, "q": 2, "qz": 1}
    texts = pa.array(list(rare))
    kind, n = lm_scoring.spelled_ids(texts), np.array(list(rare.values()))
    tokens, types = np.bincount(kind, n, 16), np.bincount(kind, minlength=16)
    words = lm_scoring.words_of(known, listed, np.bincount(lm_scoring.cells_of(texts)[0], minlength=lm_scoring.CELLS), tokens, types, 3, 1)
    assert words.discount == pytest.approx(3 / 5) and (words.ids[:2] == [0, 1]).all() and (words.logs[:2] == 0).all()
    sums = Counter()
    for i, log in zip(words.ids[2:].tolist(), words.logs[2:], strict=True):
        sums[i] += np.exp(log)
    assert all(x == pytest.approx(1) for x in sums.values())
    letters = np.exp(words.letters).reshape(lm_scoring.END + 1, lm_scoring.BACK, lm_scoring.SYMBOLS)
    assert np.allclose(letters.sum(2), 1) and letters[lm_scoring.END, 0, lm_scoring.END] == 0
    first, own = letters[lm_scoring.END, 0], words.pieces
    spelled = np.exp(lm_scoring.spelled_logs(words.letters, own))
    for k in range(lm_scoring.SPELLED):
        mass = sum(first[x] for x in range(256) if x % lm_scoring.SPELLED == k) - spelled[lm_scoring.spelled_ids(own) == k].sum()
        assert np.exp(words.whole[k]) == pytest.approx(mass)
        mine = {w: m for w, m in rare.items() if w.encode()[0] % 16 == k}
        for w, m in mine.items():  # the rest of the corpus, without one token of w
            left = sum((n - (v == w) - words.discount) * words.unit[k] for v, n in mine.items() if n > (v == w))
            assert left + (words.free[k] if m > 1 else words.alone[k]) == pytest.approx(1)


def test_cells_of_words():
    cells, starts = lm_scoring.cells_of(pa.array(["x", "ab", "é", "abc"]).slice(1))
    assert starts.tolist() == [0, 3, 6] and len(cells) == 10
    assert [c % 257 for c in cells.tolist()] == [97, 98, 256, 0xC3, 0xA9, 256, 97, 98, 99, 256]
    assert [c // 257 for c in cells.tolist()] == [256 * 8, 97 * 8, 98 * 8 + 1, 256 * 8, 0xC3 * 8, 0xA9 * 8 + 3, 256 * 8, 97 * 8, 98 * 8 + 1, 99 * 8 + 2]


def test_junk_costs_more_than_words(spark):
    words = [f"{a}{b}o" for a in "bcdfglmnprst" for b in ("an", "er", "il", "ut")]
    many = [a + b for a in words for b in words][:1500]
    rows = [(i, " ".join(many)) for i in range(25)] + [(100, " ".join(many[1000:1200])), (101, " ".join(f"x{i * 7919 % 9973:04d}\u00f1qz{i}" for i in range(200))), (102, "zqxj"), (103, "zqxj" * 60)]
    r = random.Random(1)
    rows.append((104, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2000))))
    got = {r.doc_id: r for r in lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].mean_pll > got[101].mean_pll + 10 and got[102].pll > got[103].pll + 5
    assert got[104].n_tokens == 1 and -10_000 < got[104].pll < -2000  # the letters of one long piece, none of which is lost


def test_training_lowers_the_loss():
    r = np.random.default_rng(1)
    ids = np.concatenate(([1024] * 2, np.tile([3, 700, 41, 8], 300), [1024] * 2))
    at = np.arange(2, len(ids) - 2)
    w = lm_scoring.start()
    sums = {k: np.full_like(v, 1e-4) for k, v in w.items()}
    before = lm_scoring.log_probabilities(w, ids, at).mean()
    for _ in range(20):
        lm_scoring.train_step(w, sums, ids, r.permutation(at)[:256])
    assert lm_scoring.log_probabilities(w, ids, at).mean() > before + 3
