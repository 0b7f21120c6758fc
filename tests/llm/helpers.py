"""Documents with every edge: nulls, empty and long texts, ties, repeated rows, a column of clashing name."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, size long, id long, words string"


def prose(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def documents():
    base = prose(120, 1)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", "b"), (4, base.upper().replace("W", "w"), "en", None), (5, None, "en", "a"), (6, "", None, "b"), (7, "   \n\t", "de", "b"),
        (8, "one two", "de", "a"), (9, "one\ttwo", "de", "a"), (10, prose(30_000, 2), "en", "a"), (11, "12 34 !!", None, "c"), (None, prose(40, 3), None, None), (12, prose(80, 4), "fr", "c"),
        (12, prose(80, 4), "fr", "c"), (13, "é ü ñ <|endoftext|> \u00a0x\x00y", "fr", "c"), (14, prose(200, 5), "en", "c"), (15, "Ж я", "ru", "c"),
    ]
    return [(*r, len(r[1] or ""), "clash", 7, 8, 9, "clash") for r in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
