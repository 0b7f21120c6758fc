"""Language identification of mixed-language text.

Words (pieces between white space, their letters lower-cased) have a score per learned language: the sum of log
probabilities of their character n-grams and of the whole word. The script of a word, by code point
range, leaves as candidates only languages that were learned with that script. A Viterbi path over the
words, paying PENALTY for each change of language, labels spans; the language with most letters is the
text's, and its share of letters the score.

Counts are learned from labelled documents. If a language has more than SAMPLE of them, a fixed share is drawn by
a hash of the document's number so that about SAMPLE remain: a documented bound on the fit, while
documents are counted over the whole table. Counts are kept in BUCKETS hashed cells per language, so
what comes to the driver and goes to the workers is bounded by the number of languages.

Texts that are null or have no letter are ``und`` with score 0. Letters of a script no language was learned with count
for no language; if nothing else is there, the most frequent language is given with score 0. Ties go to the first language by
code point. With no labelled document every text is ``und``. Repeated rows, very long texts (whole) and other
columns do no harm.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tessera.llm.common import lean, table

SAMPLE, BUCKETS, PENALTY, MEMO = 1500, 1 << 16, 12.0, 200_000
NGRAMS = (2, 3, 4)
UNKNOWN = "und"

# First code points of script ranges and the scripts' names.
SCRIPTS = (
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Indic"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Han"), (0xFB00, "Other"), (0x20000, "Han"), (0x30000, "Other"),
)
_STARTS = [s for s, _ in SCRIPTS]
_LETTERS = re.compile(r"[^\W\d_]+")


def script_of(letters: str) -> str:
    """Of most letters; the first on a tie."""
    if letters.isascii() or max(letters) < "\u0370":
        return "Latin"
    found = Counter(SCRIPTS[bisect_right(_STARTS, ord(c)) - 1][1] for c in letters)
    return found.most_common(1)[0][0]


def letters_of(piece: str) -> str:
    if piece.isalpha():
        return piece.lower()
    return "".join(x for x in _LETTERS.findall(piece) if any(map(str.isalpha, x))).lower()


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def cells_of(words: list[str], buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Cells of each character's n-grams, one array for each n (buckets where the word ends before), with the words'
    starts in them; the whole words' cells."""
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    text = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(text)) - np.repeat(starts, lengths)
    left = np.repeat(lengths, lengths) - place
    powers = np.cumprod(np.full(int(lengths.max()), _P, np.uint64))
    grams, h = [], np.zeros(len(text), np.uint64)
    padded = np.concatenate((text, np.zeros(max(NGRAMS), np.uint64)))
    for n in range(1, max(NGRAMS) + 1):
        h = h * _P + padded[n - 1 : n - 1 + len(text)]
        if n in NGRAMS:
            grams.append(np.where(left >= n, _mixed(h + np.uint64(n)) % np.uint64(buckets), np.uint64(buckets)).astype(np.int64))
    whole = np.add.reduceat(text * powers[place], starts)
    return [*grams, starts], (_mixed(whole) % np.uint64(buckets)).astype(np.int64)


_P = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Model:
    """weights: (cell, language) log probabilities; scripts: the languages learned with each."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: dict[str, np.ndarray], usual: int):
        self.languages, self.usual = languages, usual
        c = counts + 0.5
        self.weights = np.log(c / c.sum(0)).astype(np.float32) if languages else np.zeros((len(counts), 0), np.float32)
        self.weights = np.vstack((self.weights, np.zeros((1, len(languages)), np.float32)))  # the cell of no n-gram
        self.scripts = {s: n >= 0.001 * max(1, n.max()) for s, n in scripts.items()}
        self.none = np.zeros(len(languages), bool)

    def candidates(self, word: str) -> np.ndarray:
        """Languages that were learned with the word's script."""
        return self.scripts.get(script_of(word), self.none) if word else self.none

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(scores by word and language, 0 for the best; whether the word has candidates). Without any, all are 0."""
        (*grams, starts), whole = cells_of(words, len(self.weights) - 1)
        scores = self.weights[whole]
        for cells in grams:
            scores = scores + np.add.reduceat(self.weights[cells], starts)
        seen = np.array([self.candidates(w) for w in words])
        known = seen.any(1)
        scores = np.where(seen, scores, -np.inf)
        scores = np.maximum(scores - np.where(known, scores.max(1), 0)[:, None], -1e4)
        return np.where(known[:, None], scores, 0).astype(np.float32), known


def learn(docs: DataFrame, usable: Column, doc: str, text: str, lang: str, sample: int = SAMPLE, buckets: int = BUCKETS) -> Model:
    """From rows where usable holds and lang and text are there."""
    rows = docs.where(usable & F.col(lang).isNotNull()).select(F.col(doc).alias("doc"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((buckets, 0)), {}, 0)
    limit = F.lit(0)
    for name in languages:
        limit = F.when(F.col("lang") == name, F.lit(min(10**6, math.ceil(sample / sizes[name] * 10**6)))).otherwise(limit)
    rows = rows.where(F.pmod(F.xxhash64("doc"), F.lit(10**6)) < limit).where("text is not null").select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[str, np.ndarray] = {}
        scripts: Counter = Counter()
        for batch in batches:
            pieces: dict[str, Counter] = {}
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces.setdefault(name, Counter()).update(t.split())
            for name, found in pieces.items():
                own = cells.setdefault(name, np.zeros(buckets, np.int64))
                words: Counter = Counter()
                for piece, n in found.items():
                    words[letters_of(piece)] += n
                del words[""]
                if not words:
                    continue
                (*grams, starts), whole = cells_of(list(words), buckets)
                times = np.array(list(words.values()), np.int64)
                np.add.at(own, whole, times)
                by_letter = np.repeat(times, np.diff(np.append(starts, len(grams[0]))))
                for g in grams:
                    own += np.bincount(g, by_letter, buckets + 1)[:-1].astype(np.int64)
                for word, n in words.items():
                    scripts[name, script_of(word)] += n
        for name, own in cells.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array([""] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], ["lang", "script", "cell", "n"])
        if scripts:
            (names, kinds), n = zip(*scripts, strict=True), list(scripts.values())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(kinds, pa.string()), pa.array([-1] * len(n), pa.int64()), pa.array(n, pa.int64())], ["lang", "script", "cell", "n"])

    place = {name: i for i, name in enumerate(languages)}
    counts = np.zeros((buckets, len(languages)))
    scripts: dict[str, np.ndarray] = {}
    sums = rows.mapInArrow(lean(counted), "lang string, script string, cell long, n long").groupBy("lang", "script", "cell").agg(F.sum("n").alias("n"))
    for batch in sums.toArrow().to_batches():  # a cell per bucket and language at most
        kinds, cells, n = batch["script"].to_pylist(), batch["cell"].to_numpy(), batch["n"].to_numpy()
        at = pc.index_in(batch["lang"], pa.array(languages)).to_numpy()
        own = cells >= 0
        np.add.at(counts, (cells[own], at[own]), n[own])
        for i in np.flatnonzero(~own):
            scripts.setdefault(kinds[i], np.zeros(len(languages)))[at[i]] += n[i]
    return Model(languages, counts, scripts, place[max(languages, key=lambda x: (sizes[x], -place[x]))])


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best path of each text, over its words' rows of scores; texts are stepped together, a word at a time."""
    path = np.zeros(len(scores), np.int32)
    if not len(scores):
        return path
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    n_at = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # texts longer than step t
    came = np.full(scores.shape, -1, np.int16)  # -1: from the same language
    best = np.zeros((n_at[0], scores.shape[1]), np.float64)
    for t, n in enumerate(n_at):
        b = best[:n]
        if t:
            top = b.argmax(1)
            switch = b[np.arange(n), top][:, None] - penalty
            moved = switch > b
            came[starts[:n] + t] = np.where(moved, top[:, None], -1)
            np.maximum(b, switch, out=b)
        b += scores[starts[:n] + t]
    now = best.argmax(1).astype(np.int32)
    for t in range(len(n_at) - 1, -1, -1):
        n = n_at[t]
        at = starts[:n] + t
        path[at] = now[:n]
        back = came[at, now[:n]]
        now[:n] = np.where(back >= 0, back, now[:n])
    return path


class _Pieces(dict):
    """Numbers of pieces; new ones wait with their letters."""

    def __init__(self):
        self.waiting: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.waiting.append(letters_of(piece))
        return n


class Labeller:
    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self.reset()

    def reset(self) -> None:
        self.ids = _Pieces()
        self.scores, self.sizes, self.known = np.zeros((0, len(self.model.languages)), np.float32), np.zeros(0, np.int64), np.zeros(0, bool)

    def paths(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word ids, texts' starts, their lengths, languages by word)."""
        if len(self.ids) > MEMO:
            self.reset()
        ids = [np.array(list(map(self.ids.__getitem__, t.split())), np.int64) for t in texts]
        lengths = np.array([len(x) for x in ids], np.int64)
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        if new := self.ids.waiting:
            scores, known = self.model.score(new)
            self.scores, self.known = np.concatenate((self.scores, scores)), np.concatenate((self.known, known))
            self.sizes = np.concatenate((self.sizes, np.array([len(w) for w in new], np.int64)))
            self.ids.waiting = []
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64) if len(lengths) else lengths
        return ids, starts, lengths, viterbi(self.scores[ids], starts, lengths, self.penalty)

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        languages = self.model.languages
        if not languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        ids, starts, lengths, path = self.paths([t or "" for t in texts])
        size = self.sizes[ids]
        counted = np.where(self.known[ids], size, 0)
        text = np.repeat(np.arange(len(texts)), lengths)
        by = np.bincount(text * len(languages) + path, counted, len(texts) * len(languages)).reshape(len(texts), -1)
        every = np.bincount(text, size, len(texts))
        names, shares = [], []
        for i, t in enumerate(texts):
            if not every[i]:
                names.append(languages[self.model.usual] if has_letter(t) else UNKNOWN)
                shares.append(0.0)
            elif not by[i].any():
                names.append(languages[self.model.usual])
                shares.append(0.0)
            else:
                top = int(by[i].argmax())
                names.append(languages[top])
                shares.append(float(by[i][top] / every[i]))
        return names, shares

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(language, start, end) of each stretch of words of one language, in characters of the text."""
        out: list[tuple[str, int, int]] = []
        if not self.model.languages:
            return out
        _, _, _, path = self.paths([text])
        for word, p in zip(re.finditer(r"\S+", text), path, strict=True):
            name = self.model.languages[p]
            if out and out[-1][0] == name:
                out[-1] = name, out[-1][1], word.end()
            else:
                out.append((name, word.start(), word.end()))
        return out


def _batches(texts: pa.Array, most: int = 2_000_000) -> Iterator[slice]:
    """Runs of texts of about so many bytes, longer ones alone."""
    sizes, at, size = pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield slice(at, i)
            at, size = i, 0
        size += n
    yield slice(at, len(sizes))


def predict(docs: DataFrame, model: Model, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """docs with lang_pred and score (replaced if there); the text is the only input."""
    docs = docs.drop("lang_pred", "score") if text not in ("lang_pred", "score") else docs
    schema = docs.schema
    at = schema.fieldNames().index(text)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model, penalty)
        for batch in batches:
            texts, names, shares = batch.column(at), [], []
            for part in _batches(texts):
                a, b = labeller.label(texts[part.start : part.stop].to_pylist())
                names += a
                shares += b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(shares, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(lean(labelled), StructType([*schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def spans(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """(doc_id, spans): the stretches of one language of each text, lang, start and end in characters; none for null texts and texts without words."""
    docs = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model, penalty)
        for batch in batches:
            found = [[dict(zip(("lang", "start", "end"), s, strict=True)) for s in labeller.spans(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, item)], ["doc_id", "spans"])

    return docs.mapInArrow(lean(labelled), f"doc_id {kind}, spans array<struct<lang:string,start:int,end:int>>")


def held_out(doc: str = "doc_id") -> Column:
    """A null doc_id is neither held out nor learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def identify(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with held_out, lang_pred and score, learned from its own labelled rows that aren't held out."""
    model = learn(docs, ~held_out(doc) & F.col(doc).isNotNull(), doc, text, lang)
    return predict(docs.withColumn("held_out", held_out(doc)), model, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs, ~held_out() & F.col("doc_id").isNotNull(), "doc_id", "text", "lang")
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
