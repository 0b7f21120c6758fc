"""Spelling variants: words one edit apart, found by Aho-Corasick automata of their halves.

A word of L code points is cut into a head of L // 2 and a tail. If two words differ by one inserted, deleted or replaced code point, the edit leaves
one half of the first whole, and the second then begins with that head or ends with that tail. So:

* words are dealt to shards by their first three code points for heads and their last three for tails (a half has three at least); the words that hold a half
  meet its owner in one shard. Counts by shard are known, and a shard of more than OWNERS words or SCANNED ones is a grid: its halves are dealt to parts,
  the words that are scanned to blocks, and each part meets each block once. No task holds more than OWNERS halves, whatever share of all words a
  shard has, and nothing is left out.
* each cell of the grid is one automaton over its halves. All its words are scanned; a half that is met counts only where it must lie (heads at 0, tails at the end),
  and only for words whose length differs by one at most. What is left of both words is then compared: owners are kept by what is left of them with one
  code point deleted, so that a half that very many words share costs look-ups, not pairs.
* a pair that both halves give is counted by its head. Only each word's number of near words and its best one leave a task.

A word's form is its near word of largest n (ties: smallest in code-point order) if that is FACTOR times the word's n or more; forms are followed by
doubling, in as many joins as the largest count allows (n grows FACTOR times at each step).

Null and empty texts have no words. doc_id null counts as an empty string before the colon. Repeated rows count as often as they occur. Very long texts
are read whole. Empty tables give an empty result. Other columns are not touched.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, lean, release, small, table

SHORTEST, OFTEN, FACTOR = 6, 5, 5
#: One run in so many loses a code point, by a checksum: planted misspellings.
PLANTED = 199
#: Halves of a shard, were they spread evenly; of one automaton at most; words that are scanned with it; code points that place a half in a shard.
USUAL, OWNERS, SCANNED, PLACE = 4_000, 50_000, 250_000, 3
#: Halves of about so many code points are looked up, not scanned for, and rests of more are compared one by one.
LONG = 64
#: Different words counted together before they are given on; words of an answer's batch.
HELD, BATCH = 300_000, 10_000

#: By Latin-1 code: letters stay, A-Z are lower-cased, all else is a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs_of(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, in Latin-1. What Latin-1 lacks is no letter here."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def planted(run: bytes, checksum: int) -> bytes:
    """run, without a code point if the checksum of `<doc_id>:<run>` says so. checksum: of `<doc_id>:`."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), checksum)
    at = h % len(run)
    return run if h % PLANTED else run[:at] + run[at + 1 :]


def counted(docs: DataFrame, doc: str = "doc_id", text: str = "text", shortest: int = SHORTEST, often: int = OFTEN) -> DataFrame:
    """(word, n) of the words of at least `shortest` code points and `often` occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                if not (t := t.as_py()):
                    continue
                checksum = zlib.crc32(f"{d.as_py() or ''}:".encode())
                for run, n in Counter(w for w in runs_of(t) if len(w) >= shortest).items():
                    if len(run := planted(run, checksum)) >= shortest:
                        held[run] += n
                if len(held) >= HELD:
                    yield given()
        if held:
            yield given()

    rows = docs.select(F.col(doc).cast("string"), text).mapInArrow(lean(count), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


# --- near words


def deleted(word: str) -> list[tuple[int, str]]:
    """Each place, and the word without the code point there."""
    return [(i, word[:i] + word[i + 1 :]) for i in range(len(word))]


def one_edit(a: str, b: str) -> bool:
    """Whether a and b, which differ, differ by one edit."""
    if len(a) > len(b):
        a, b = b, a
    same, other = 0, len(a) + 1  # so many first code points are the same, so many are not
    while other - same > 1:
        mid = (same + other) // 2
        same, other = (mid, other) if a[same:mid] == b[same:mid] else (same, mid)
    return len(b) - len(a) <= 1 and a[same + (len(a) == len(b)) :] == b[same + 1 :]


class Rests:
    """What is left of the owners of one half."""

    def __init__(self) -> None:
        self.own: dict[str, tuple[str, int]] = {}
        self.cut: dict[tuple[int, str], list[str]] | None = None

    def near(self, rest: str) -> Iterator[tuple[str, int]]:
        """(word, n) of owners whose rest differs by exactly one edit."""
        if len(rest) > LONG:  # so long that they share a half of that length with few others, and one by one takes less room
            yield from (w for r, w in self.own.items() if r != rest and one_edit(r, rest))
            return
        if self.cut is None:  # the index is made when a word first asks
            self.cut = {}
            for r in self.own:
                for key in deleted(r) if len(r) <= LONG + 1 else ():
                    self.cut.setdefault(key, []).append(r)
        mine = deleted(rest)
        for r in {r for _, r in mine}:  # one code point fewer
            if r in self.own:
                yield self.own[r]
        found = {r for key in mine for r in self.cut.get(key, ()) if r != rest}  # another in one place
        for i in range(len(rest) + 1):  # one more
            found.update(self.cut.get((i, rest), ()))
        yield from map(self.own.__getitem__, found)


class Cell:
    """An automaton of halves, of words that were added, and the words near others."""

    def __init__(self, tails: bool) -> None:
        self.tails, self.halves, self.automaton = tails, {}, None

    def add(self, word: str, n: int) -> None:
        half = len(word) // 2
        own, rest = (word[half:], word[:half]) if self.tails else (word[:half], word[half:])
        self.halves.setdefault(own, Rests()).own[rest] = word, n

    def looked_up(self, word: str) -> Iterator[tuple[int, str]]:
        """(last place, half) of halves of words about as long that lie where they must: for words so long that an automaton meets too much on its way."""
        size = len(word)
        for n in {(size + d + self.tails) // 2 for d in (-1, 0, 1)}:
            half = word[size - n :] if self.tails else word[:n]
            if half in self.halves:
                yield (size if self.tails else n) - 1, half

    def near(self, word: str) -> tuple[int, int, str | None]:
        """(how many, the largest n, its word: smallest if several have that n). Of words whose head `word` begins with, tails count nothing."""
        if not self.halves:
            return 0, 0, None
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for half in self.halves:
                if len(half) <= LONG + 1:
                    self.automaton.add_word(half, half)
            self.automaton.make_automaton()
        number, best, size = 0, (0, ""), len(word)
        for end, half in self.automaton.iter(word) if size <= 2 * LONG and len(self.automaton) else self.looked_up(word):
            at = end + 1 - len(half)
            if at if not self.tails else end + 1 < size:  # a head lies at the start, a tail at the end
                continue
            long = 2 * len(half) - self.tails  # an owner has this many code points, or one beside it
            if not -2 <= long - size <= 1:
                continue
            for owner, n in self.halves[half].near(word[:at] if self.tails else word[end + 1 :]):
                if self.tails and word.startswith(owner[: len(owner) // 2]):
                    continue
                number += 1
                best = min(best, (-n, owner))
        return number, -best[0], best[1] or None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tails, shard, part, block, scanned, word, n), sorted: of each cell, owners come before the words that are scanned."""
    key = cell = None
    out: list[tuple] = []
    names = ["word", "n_near", "best_n", "best"]
    schema = pa.schema(list(zip(names, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)))

    def given() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        out.clear()
        return made

    for batch in batches:
        for *now, scanned, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != key:
                key, cell = now, Cell(now[0])
            if not scanned:
                cell.add(word, n)
            elif (found := cell.near(word))[0]:
                out.append((word, *found))
                if len(out) >= BATCH:
                    yield given()
    if out:
        yield given()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best, best_n) of all words (word, n), which are distinct and of four code points or more: best has the largest n of near ones."""
    total = words.count()
    shards = max(1, -(-total // USUAL))
    ends = [(False, F.col("word").substr(F.lit(1), F.lit(PLACE))), (True, F.expr(f"right(word, {PLACE})"))]
    dealt = words.select("word", "n", F.xxhash64("word").alias("h"), F.explode(F.array(*(F.struct(F.lit(t).alias("tails"), F.pmod(F.hash(place), F.lit(shards)).alias("shard")) for t, place in ends))).alias("s")).select("word", "n", "h", "s.*")
    sizes = dealt.groupBy("tails", "shard").count().select("tails", "shard", F.ceil(F.col("count") / OWNERS).alias("parts"), F.ceil(F.col("count") / SCANNED).alias("blocks"))
    dealt = dealt.join(small(sizes), ["tails", "shard"])
    part, block = F.pmod("h", "parts"), F.pmod(F.shiftright("h", 20), F.col("blocks"))
    each = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    owners = dealt.select("tails", "shard", part.alias("part"), F.explode(each(F.col("blocks"))).alias("block"), F.lit(False).alias("scanned"), "word", "n")
    scanned = dealt.select("tails", "shard", F.explode(each(F.col("parts"))).alias("part"), block.alias("block"), F.lit(True).alias("scanned"), "word", "n")
    cell = ["tails", "shard", "part", "block"]
    rows = owners.unionByName(scanned).repartition(*cell).sortWithinPartitions(*cell, "scanned")
    found = rows.mapInArrow(lean(_scan), "word string, n_near long, best_n long, best string")
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    found = none.unionByName(found.withColumn("n", F.lit(None).cast("long")))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))))
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n"))


def grouped(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words (word, n)."""
    own = F.col("best_n") >= factor * F.col("n")
    near = cut(near_words(words).select("word", "n", "n_near", F.when(own, F.col("best")).alias("form"), F.when(own, F.col("best_n")).alias("form_n")))
    forms = near.where("form is not null").select("word", F.col("form").alias("root"))
    # n grows factor times a step, from 1 at least
    steps = int(math.log(max(2, near.agg(F.max("n")).first()[0] or 0), factor)) + 1
    done = 1
    while done < steps:
        held = cut(forms)
        release(forms)
        nexts = held.select(F.col("word").alias("root"), F.col("root").alias("further"))
        forms, done = held.join(nexts, "root", "left").select("word", F.coalesce("further", "root").alias("root")), 2 * done
    return near.join(forms, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of all texts."""
    return grouped(cut(counted(docs, doc, text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
