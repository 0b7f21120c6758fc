import math
import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import lexical_search, spelling
from tests.llm.helpers import SCHEMA, frame, prose

LONG = "longer" * 25

# --- spelling variants


def brute_words(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            found[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def edits(a, b):
    """Whether one edit makes a of b, by a table of distances."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1] == 1


def brute_variants(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and edits(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def tuples(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def misspelled(r, word):
    i, c = r.randrange(len(word)), r.choice("abcé×ÿ")
    return r.choice([word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :], word[:i] + c + word[i:], word + c])


@pytest.mark.parametrize("sizes", [(4_000, 50_000, 250_000), (3, 4, 5)])
def test_spelling_variants_against_brute_force(spark, monkeypatch, sizes):
    """With small shards every cell is split, so that parts meet blocks."""
    for name, size in zip(("USUAL", "OWNERS", "SCANNED"), sizes, strict=True):
        monkeypatch.setattr(spelling, name, size)
    r = random.Random(5)
    stems = ["abcabc", "aaaaaa", "aaaaaaa", "abcabcabc", "straße", "Éclairs", "counterpart", "counterpoint", "ab" * 9]
    words = stems + [misspelled(r, r.choice(stems)) for _ in range(60)]
    words += [misspelled(r, r.choice(words)) for _ in range(60)]
    rows = []
    for i in range(300):
        rows.append((i if i % 5 else None, " ".join(r.choice(words[: 1 + r.randrange(len(words))]) for _ in range(r.randrange(0, 60))) + r.choice(["", "Āx", "数abcabc", "  ", "WORD-word_word"])))
    rows += [(7, rows[7][1]), (8, None), (9, ""), (None, " ".join(words * 3)), (11, " ".join([LONG, LONG + "s", LONG[:70] + LONG[71:], LONG[:3] + "x" + LONG[4:], LONG[5:]])), *[(20, LONG + " " + LONG[:70] + LONG[71:] + " " + LONG + "s " + LONG[:3] + "x" + LONG[4:])] * 4]
    docs = spark.createDataFrame([(*x, "clash", 1, 2, "clash") for x in rows], "doc_id long, text string, word string, n long, root long, form string")
    want = brute_words(rows)
    got = {x.word: x.n for x in spelling.counted(docs).collect()}
    assert got == want and len(want) > 60
    assert tuples(spelling.variants(docs)) == brute_variants(want)


def test_spelling_variants_of_hot_halves(spark):
    """A third of all words share a half, and all rests differ."""
    r = random.Random(6)
    words = {"prefix" + "".join(r.choice("abcd") for _ in range(r.choice([5, 6, 7]))): r.randrange(5, 900) for _ in range(600)} | {"".join(r.choice("ab") for _ in range(r.randrange(6, 12))): r.randrange(5, 900) for _ in range(300)}
    got = tuples(spelling.grouped(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute_variants(words)


def test_long_chains_of_forms(spark):
    word, words = "chains", {}
    for i in range(13):
        words[word + "abcdefghijklm"[:i]] = 5 * 5**i
    got = {r.word: r.root for r in spelling.grouped(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"chainsabcdefghijkl"}


def test_a_word_as_long_as_a_text(spark):
    text = " ".join(["ab" * 200_000] * 5 + ["ab" * 200_000 + "c"] * 5)
    got = tuples(spelling.variants(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert sorted((len(w), f, n, near) for w, f, _, n, near, _ in got) == [(400_000, None, 5, 1), (400_001, None, 5, 1)]


def test_spelling_variants_of_nothing(spark):
    out = spelling.variants(frame(spark, []))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, ""), (3, "a bc 12")], "doc_id long, text string")).count() == 0


# --- lexical search


def brute_search(docs, items, k=10):
    words = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    split = [(d, Counter(w), len(w)) for d, t in docs if (w := words(t))]
    N, L = len(split), sum(n for _, _, n in split)
    df = Counter(t for _, c, _ in split for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in split:
            m = 100 - 90 + (90 * n * N) // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(words(text)) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize(("pairs", "block"), [(2_000_000, 2_000), (50, 2)])
def test_lexical_search_against_brute_force(spark, monkeypatch, pairs, block):
    monkeypatch.setattr(lexical_search, "PAIRS", pairs)
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    r = random.Random(8)
    rows = [(i if i % 9 else None, prose(r.choice([0, 1, 5, 40, 200]), i, 120) + r.choice(["", " É É é", " W3 x_y", "\x00 ", " the " * 50])) for i in range(150)]
    same = prose(30, 999, 120)
    rows += [(1000 + r.randrange(40), same) for _ in range(60)] + [(3, None), (4, ""), (5, "!!"), (6, prose(20_000, 6, 300))]
    items = [(1, same), (2, prose(8, 2, 120)), (2, prose(8, 2, 120)), (None, "the É x_y"), (4, None), (5, ""), (6, "absent"), (7, prose(2_000, 9, 120)), (8, "the the W3")]
    docs = spark.createDataFrame([(*x, "clash", 1, "clash") for x in rows], "doc_id long, text string, item long, score long, terms string".replace("item long", "item string"))
    bench = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, doc_id long")
    got = lexical_search.ranked(docs.repartition(5), bench)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == brute_search(rows, items)
    assert Counter(map(tuple, lexical_search.ranked(docs, bench, k=3).collect())) == brute_search(rows, items, 3)


def test_bytes_bound_scores_from_above(spark):
    """The first level never says less than the second."""
    docs = spark.createDataFrame([(i, prose(50 + 40 * i, i, 60)) for i in range(20)], "doc_id long, text string")
    index = lexical_search.build(docs, [f"w{i}".encode() for i in range(60)])
    rows = index.rows.collect()
    assert len(rows) == 20 and index.n_docs == 20
    for r in rows:
        for tf, byte in zip(r["counts"], r["bytes"], strict=True):
            x = (1_000_000_000 * tf) // (1000 * tf + 8 * r.m)
            assert 0 < byte <= 123 and (byte - 1) * lexical_search.UNIT < x <= byte * lexical_search.UNIT


def test_lexical_search_of_nothing(spark):
    empty, some = frame(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.ranked(empty, some).count() == 0
    assert lexical_search.ranked(frame(spark), some.limit(0)).count() == 0
    assert SCHEMA and lexical_search.ranked(frame(spark), spark.createDataFrame([(1, None)], "item_id long, text string")).count() == 0
