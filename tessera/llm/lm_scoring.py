"""Document scores by masked pseudo-likelihood.

A small network predicts every token from the SIDE tokens before and the SIDE after it: each position has
its own embedding table, their sum passes through tanh, and the token's probability is that of its class times that
within the class. A document's score is the sum of its tokens' log probabilities given both sides.

Tokens are pieces between white space, lower-cased, and counted over all documents. The most frequent ones have ids of
their own in the network, which gives others the probability of one of OTHERS ids, so that its size, and what goes to the
driver and the workers, is bounded. The token's own probability within such an id comes from the whole corpus:

* pieces that occur OFTEN times or more (LISTED of them at most) share ids by a hash, by their counts;
* all others share ids by their first byte. What counts is the rest of the corpus, without the token itself, by absolute
  discounting: a piece that occurs n times there has (n - d) / N of its id, and what is left goes to all byte strings that are
  not listed, each byte given the two before it (the second of them by 8 classes). Counts are joined, so nothing about
  rare pieces is bounded or kept on one machine. A piece that no other text has costs as its letters say.

So the probabilities of all byte strings sum to one. Every document trains the network in every round. Documents are dealt to
shards by a hash of doc_id and text and put in order within them; each shard trains a copy, and the copies are averaged by
tokens, slice by slice, in a tree of FAN at a time. The number of shards follows the number of tokens, so neither scores nor
network depend on how the table is partitioned.

Null and empty texts have no tokens and score 0 (mean null). Equal texts score alike: the network is applied in float64 and each token's log is
rounded to a whole number of FRACTIONs before any are added; scores are rounded to 4 digits. With no
tokens at all the network is untrained. Very long texts are scored whole, in steps of STEP tokens. Repeated rows train as often
as they occur and are scored each; null doc_ids, empty tables and other columns do no harm.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, lean, release, table

CLASSES, HIDDEN, SIDE, OTHERS = 32, 24, 2, 64
VOCABULARY = CLASSES * CLASSES
#: Ids of others: SPELLED of rare pieces, by their first byte; what is left is of listed ones.
SPELLED, LISTED, OFTEN = 16, 1 << 16, 20
#: Of bytes: END stands after the last, and before the first; contexts are the byte before and 8 classes of the one before that.
END, SYMBOLS, BACK = 256, 257, 8
CELLS = (END + 1) * BACK * SYMBOLS
ROUNDS, BATCH, RATE = 1, 4096, 0.1
#: Tokens of a shard, unless there would be more than SHARDS; tokens that are shuffled together.
SHARD_TOKENS, SHARDS, CHUNK = 2_000_000, 1 << 14, 1 << 16
#: Tokens scored at once; characters of texts split at once; copies averaged at once, in so many slices.
STEP, CHARS, FAN, SLICES = 1 << 13, 8_000_000, 64, 32
#: Log probabilities are summed as integers of this fraction, in any order.
FRACTION = 1 << 30
NAMES = ("context", "bias", "classes", "words")


# --- words


def pieces_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the pieces of all texts, their number by text)"""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    sizes, flat = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64), lists.flatten()
    some = pc.binary_length(flat).to_numpy() > 0  # white space at an end leaves an empty piece
    if not some.all():
        sizes, flat = np.bincount(np.repeat(np.arange(len(sizes)), sizes), some, len(sizes)).astype(np.int64), flat.filter(pa.array(some))
    return flat, sizes


def runs(sizes: pa.Array, most: int) -> Iterator[slice]:
    """Runs of rows of about so much together, longer rows alone."""
    at = held = 0
    for i, n in enumerate(pc.fill_null(sizes, 0).to_pylist()):
        if held and held + n > most:
            yield slice(at, i)
            at, held = i, 0
        held += n
    if len(sizes):
        yield slice(at, len(sizes))


@dataclass
class Words:
    """pieces: known, then listed ones; ids and logs: the network's ids of them and log P(piece | id). letters: log P(byte | context).
    Of rare pieces by SPELLED id: whole, log P(any of them) by bytes; unit, 1 / N, a token left out; free, what discounting leaves; alone, what it leaves
    without a piece that occurs once. discount: d."""

    pieces: pa.Array
    ids: np.ndarray
    logs: np.ndarray
    letters: np.ndarray
    whole: np.ndarray
    unit: np.ndarray
    free: np.ndarray
    alone: np.ndarray
    discount: float


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all words, where each starts, and the end)"""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def spelled_ids(words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.int64)
    data, at = _bytes(words)
    return data[at[:-1]].astype(np.int64) % SPELLED


def cells_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(context * SYMBOLS + byte for all bytes and ENDs, where each word starts). Words are not empty."""
    data, at = _bytes(words)
    x = np.insert(data.astype(np.int64), at[1:], END)
    b = np.concatenate(([END], x[:-1]))
    a = np.concatenate(([END], b[:-1]))
    a[b == END] = END
    return (b * BACK + a % BACK) * SYMBOLS + x, at[:-1] + np.arange(len(words))


def spelling(counts: np.ndarray) -> np.ndarray:
    """log P(byte | context) from counts by cell: of two bytes before, mixed with that of one, mixed with one for all."""
    two = counts.astype(np.float64).reshape(END + 1, BACK, SYMBOLS)
    possible = np.ones((END + 1, 1, SYMBOLS))
    possible[END, 0, END] = 0  # no piece is empty
    even = possible / possible.sum(2, keepdims=True)
    one = two.sum(1, keepdims=True)
    one = (one + 4 * even) / (one.sum(2, keepdims=True) + 4)
    with np.errstate(divide="ignore"):
        return np.log((two + 4 * one) / (two.sum(2, keepdims=True) + 4)).reshape(-1)


def spelled_logs(letters: np.ndarray, words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.zeros(0)
    cells, starts = cells_of(words)
    return np.add.reduceat(letters[cells], starts)


def words_of(known: list[str], listed: list[tuple[str, int]], counts: np.ndarray, tokens: np.ndarray, types: np.ndarray, once: int, twice: int) -> Words:
    """counts: of rare pieces' bytes, by cell; tokens, types: of rare pieces, by SPELLED id; once, twice: how many of them occur so often."""
    shared = [VOCABULARY - OTHERS + zlib.crc32(w.encode()) % (OTHERS - SPELLED) for w, _ in listed]
    n = Counter()
    for i, (_, times) in zip(shared, listed, strict=True):
        n[i] += times
    own = pa.array(known + [w for w, _ in listed], pa.string())
    logs = np.array([0.0] * len(known) + [math.log(times / n[i]) for i, (_, times) in zip(shared, listed, strict=True)])
    letters = spelling(counts)
    first = np.exp(letters.reshape(END + 1, BACK, SYMBOLS)[END, END % BACK, :END])
    whole = first.reshape(-1, SPELLED).sum(0) - np.bincount(spelled_ids(own), np.exp(spelled_logs(letters, own)), SPELLED)
    d = min(0.9, max(0.1, once / max(1, once + 2 * twice)))
    rest = np.maximum(tokens - 1, 1).astype(np.float64)
    alone = np.where(tokens > 1, d * (types - 1) / rest, 1.0)
    return Words(own, np.array([*range(len(known)), *shared], np.int64), logs, letters, np.log(np.maximum(whole, 1e-300)), 1 / rest, d * types / rest, alone, d)


def counted(docs: DataFrame) -> DataFrame:
    """(word, n) of all pieces."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for part in runs(pc.binary_length(texts), CHARS):
                found = pc.value_counts(pieces_of(texts[part.start : part.stop])[0])
                yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["word", "n"])

    return cut(docs.select("text").mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))


def vocabulary(sums: DataFrame) -> Words:
    """Known pieces are the most frequent, by count, then code points."""
    first = VOCABULARY - OTHERS
    often = sums.orderBy(F.desc("n"), "word").limit(first + LISTED).toArrow()  # bounded by the network's size and LISTED
    often = list(zip(often["word"].to_pylist(), often["n"].to_pylist(), strict=True))
    known, listed = [w for w, _ in often[:first]], [(w, n) for w, n in often[first:] if n >= OFTEN]
    own = pa.array(known + [w for w, _ in listed], pa.string())

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts by cell, then tokens and types by SPELLED id, then pieces that occur once and twice."""
        counts = np.zeros(CELLS + 2 * SPELLED + 2, np.int64)
        for batch in batches:
            batch = batch.filter(pc.is_null(pc.index_in(batch.column(0), own)))
            if len(batch):
                n, kind = batch.column(1).to_numpy(), spelled_ids(batch.column(0))
                counts[:CELLS] += np.bincount(cells_of(batch.column(0))[0], minlength=CELLS)
                np.add.at(counts, CELLS + kind, n)
                counts[CELLS + SPELLED : -2] += np.bincount(kind, minlength=SPELLED)
                counts[-2:] += np.count_nonzero(n == 1), np.count_nonzero(n == 2)
        at = np.flatnonzero(counts)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["cell", "n"])

    found = sums.mapInArrow(lean(spelled), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most as many rows as cells
    counts = np.zeros(CELLS + 2 * SPELLED + 2, np.int64)
    counts[np.array(found["cell"], np.int64)] = np.array(found["n"], np.int64)
    return words_of(known, listed, counts[:CELLS], counts[CELLS : CELLS + SPELLED], counts[CELLS + SPELLED : -2], int(counts[-2]), int(counts[-1]))


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)


def encode(docs: DataFrame, words: Words) -> DataFrame:
    """(uid, doc_id, h, n_tokens, ids, own, rare), one row per row of docs (doc_id, text). uid: differs by row; h: a hash of doc_id and text; own: the
    sum of logs of listed pieces; rare: each other piece, its SPELLED id, and the log of what its letters give it there."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for whole in batches:
            for part in runs(pc.binary_length(whole.column(1)), CHARS):
                batch = whole.slice(part.start, part.stop - part.start)
                pieces, sizes = pieces_of(batch.column(1))
                doc = np.repeat(np.arange(len(batch)), sizes)
                place = pc.fill_null(pc.index_in(pieces, words.pieces), -1).to_numpy()
                rare = place < 0
                texts = pieces.filter(pa.array(rare))
                group = spelled_ids(texts)
                ids = np.empty(len(place), np.int16)
                ids[~rare], ids[rare] = words.ids[place[~rare]], VOCABULARY - SPELLED + group
                own = np.bincount(doc[~rare], words.logs[place[~rare]], len(batch))
                spelled = spelled_logs(words.letters, texts) - words.whole[group]
                items = pa.StructArray.from_arrays([texts, pa.array(group, pa.int8()), pa.array(spelled)], ["word", "k", "log"])
                h = [xxhash.xxh3_64_intdigest(f"{d}\0{t}".encode()) >> 1 for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                columns = [
                    pa.array(np.arange(uid, uid + len(batch))), batch.column(0), pa.array(h, pa.int64()), pa.array(sizes), _lists(sizes, pa.array(ids)), pa.array(own),
                    _lists(np.bincount(doc[rare], minlength=len(batch)), items),
                ]
                uid += len(batch)
                yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "h", "n_tokens", "ids", "own", "rare"])

    return docs.select("doc_id", "text").mapInArrow(lean(encoded), f"uid long, doc_id {kind}, h long, n_tokens long, ids array<short>, own double, rare array<struct<word:string,k:tinyint,log:double>>")


def rare_logs(encoded: DataFrame, sums: DataFrame, words: Words) -> DataFrame:
    """(uid, rare_log) in FRACTIONs: a piece that is counted once needs no partner in the join."""
    of = lambda values: F.get(F.array(*map(F.lit, values.tolist())), F.col("k").cast("int"))
    some = encoded.select("uid", F.explode("rare").alias("r")).select("uid", "r.*").join(sums.where("n > 1"), "word", "left")
    counted_ = F.log((F.col("n") - 1 - words.discount) * of(words.unit) + of(words.free) * F.exp("log"))
    log = F.when(F.col("n") > 1, counted_).otherwise(F.log(of(words.alone)) + F.col("log"))  # letters of a long piece alone would vanish without their log
    return some.select("uid", F.round(log * FRACTION).cast("long").alias("log")).groupBy("uid").agg(F.sum("log").alias("rare_log"))


# --- the network


def start() -> dict[str, np.ndarray]:
    r = np.random.default_rng(1)
    return {
        "context": (r.standard_normal((2 * SIDE, VOCABULARY + 1, HIDDEN)) * 0.1).astype(np.float32),
        "bias": np.zeros(HIDDEN, np.float32),
        "classes": np.zeros((HIDDEN + 1, CLASSES), np.float32),
        "words": np.zeros((CLASSES, HIDDEN + 1, CLASSES), np.float32),
    }


#: Logits are cut to this on either side, so that no sum of their exponents overflows or vanishes.
CUT = 80.0


def _around(ids: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    return [ids.take(at + d) for d in (*range(-SIDE, 0), *range(1, SIDE + 1))]


def _hidden(w: dict, around: list[np.ndarray]) -> np.ndarray:
    """With a last column of ones."""
    h = w["context"][0].take(around[0], 0)
    for j in range(1, 2 * SIDE):
        h += w["context"][j].take(around[j], 0)
    h += w["bias"]
    np.tanh(h, out=h)
    out = np.ones((len(h), HIDDEN + 1), h.dtype)
    out[:, :-1] = h
    return out


def _exp(x: np.ndarray) -> np.ndarray:
    """In place."""
    return np.exp(np.clip(x, -CUT, CUT, out=x), out=x)


def _chosen_log(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row's softmax, the log at y. x changes."""
    own = np.clip(x.reshape(-1).take(np.arange(len(x)) * CLASSES + y), -CUT, CUT)
    return own - np.log(_exp(x).sum(1))


def _by_token(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, slice]]]:
    """(order of the places by their tokens, those tokens, where each class lies in that order)."""
    y = ids.take(at)
    order = np.argsort(y.astype(np.int16), kind="stable")
    y = y[order]
    ends = np.searchsorted(y, np.arange(CLASSES + 1) * CLASSES)
    return order, y, [(k, slice(ends[k], ends[k + 1])) for k in range(CLASSES) if ends[k] < ends[k + 1]]


def _within(w: dict, h: np.ndarray, spans: list[tuple[int, slice]]) -> np.ndarray:
    out = np.empty((len(h), CLASSES), h.dtype)
    for k, own in spans:
        np.matmul(h[own], w["words"][k], out=out[own])
    return out


def log_probabilities(w: dict, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the tokens at these places, given the others around them. w in float64, for products whose last digits depend on the rows beside them."""
    order, y, spans = _by_token(ids, at)
    h = _hidden(w, _around(ids, at[order]))
    out = np.empty(len(y), w["bias"].dtype)
    out[order] = _chosen_log(h @ w["classes"], y // CLASSES) + _chosen_log(_within(w, h, spans), y % CLASSES)
    return out


_ONES = np.ones((CLASSES, 1), np.float32)
_CELLS = np.arange((VOCABULARY + 1) * HIDDEN).reshape(VOCABULARY + 1, HIDDEN)


def _error(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The softmax of each row, less 1 at y, in place."""
    _exp(x)
    x /= x @ _ONES
    x.reshape(-1)[np.arange(len(x)) * CLASSES + y] -= 1
    return x


def train_step(w: dict, sums: dict, ids: np.ndarray, at: np.ndarray) -> None:
    """One AdaGrad step on these places; w and sums change."""
    order, y, spans = _by_token(ids, at)
    around, n = _around(ids, at[order]), np.float32(len(at))
    h = _hidden(w, around)
    g = _error(h @ w["classes"], y // CLASSES)
    back, grads = g @ w["classes"][:-1].T, {"classes": h.T @ g, "words": np.zeros_like(w["words"])}
    g = _error(_within(w, h, spans), y % CLASSES)
    for k, own in spans:
        np.matmul(h[own].T, g[own], out=grads["words"][k])
        back[own] += g[own] @ w["words"][k, :-1].T
    h = h[:, :-1]
    back -= back * h * h
    grads["bias"], flat = back.sum(0), back.reshape(-1)
    grads["context"] = np.stack([np.bincount(_CELLS.take(j, 0).reshape(-1), flat, _CELLS.size).reshape(_CELLS.shape) for j in around])
    for name, gr in grads.items():
        gr = np.multiply(gr, 1 / n, dtype=np.float32, casting="same_kind")
        step = gr * gr
        sums[name] += step
        np.sqrt(sums[name], out=step)
        gr *= RATE
        gr /= step
        w[name] -= gr


def _places(sizes: np.ndarray) -> np.ndarray:
    """Of all tokens, blanks left out."""
    return np.arange(int(sizes.sum())) + SIDE + np.repeat(np.arange(len(sizes)) * SIDE, sizes)


def _spread(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids with SIDE blanks before and after each document, places of the tokens)."""
    places = _places(sizes)
    ids = np.full(len(flat) + SIDE * (len(sizes) + 1), VOCABULARY, np.int64)
    ids[places] = flat
    return ids, places


def _flat(w: dict) -> np.ndarray:
    return np.concatenate([w[k].reshape(-1) for k in NAMES])


def _unflat(v: np.ndarray) -> dict:
    out, at = {}, 0
    for k, x in start().items():
        out[k] = v[at : at + x.size].reshape(x.shape).astype(np.float32)
        at += x.size
    return out


class Copy:
    """A copy of the network that trains on documents as they come."""

    def __init__(self, w: dict):
        self.w = {k: v.copy() for k, v in w.items()}
        self.sums = {k: np.full_like(v, 1e-4) for k, v in w.items()}
        self.held, self.sizes, self.size, self.tokens = [], [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.sizes.append(len(ids))
        self.size += len(ids)
        if self.size >= CHUNK:
            self.flush()

    def flush(self) -> None:
        if self.size:
            ids, places = _spread(np.concatenate(self.held), np.array(self.sizes))
            places = np.random.default_rng(self.tokens).permutation(places)
            for i in range(0, len(places), BATCH):
                train_step(self.w, self.sums, ids, places[i : i + BATCH])
            self.tokens += self.size
            self.held, self.sizes, self.size = [], [], 0


_COPY = "part long, slice int, tokens double, v array<float>"


def _copies(rows: DataFrame, now: dict) -> DataFrame:
    """(part, slice, tokens, v) of each shard's copy; rows: (shard, ids), those of a shard one after another."""

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(shard: int, copy: Copy):
            copy.flush()
            slices = [pa.array(s) for s in np.array_split(_flat(copy.w), SLICES)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(s) for s in slices]), pa.int32()), pa.concat_arrays(slices))
            return pa.RecordBatch.from_arrays([pa.array([shard] * SLICES, pa.int64()), pa.array(range(SLICES), pa.int32()), pa.array([float(copy.tokens)] * SLICES), lists], ["part", "slice", "tokens", "v"])

        shard = copy = None
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != shard:
                    if copy:
                        yield done(shard, copy)
                    shard, copy = k, Copy(now)
                copy.add(ids.values.to_numpy())
        if copy:
            yield done(shard, copy)

    return rows.mapInArrow(lean(trained), _COPY)


def _average(rows: pa.Table) -> pa.Table:
    """Of one slice of some copies, by tokens, in the order of their parts."""
    rows = rows.sort_by("part").combine_chunks()
    tokens = rows["tokens"].to_numpy()
    v = rows["v"].chunk(0).flatten().to_numpy().reshape(len(tokens), -1).astype(np.float64)
    mean = ((tokens @ v) / tokens.sum()).astype(np.float32)
    return pa.table({"part": pa.array([rows["part"][0].as_py() // FAN]), "slice": rows["slice"].chunk(0)[:1], "tokens": [tokens.sum()], "v": pa.ListArray.from_arrays(pa.array([0, len(mean)], pa.int32()), pa.array(mean))})


def train(encoded: DataFrame, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """encoded: (h, n_tokens, ids)."""
    w = start()
    tokens = encoded.agg(F.sum("n_tokens")).first()[0] or 0
    if not tokens:
        return w
    shards = min(SHARDS, -(-tokens // SHARD_TOKENS))
    rows = encoded.where("n_tokens > 0").select(F.pmod("h", F.lit(shards)).alias("shard"), "h", "ids")
    rows = rows.repartition(int(shards), "shard").sortWithinPartitions("shard", "h").select("shard", "ids")
    for _ in range(rounds):
        copies, n = cut(_copies(rows, w)), shards
        while n > 1:
            before, copies, n = copies, cut(copies.groupBy("slice", F.expr(f"part div {FAN}").alias("g")).applyInArrow(_average, _COPY)), -(-n // FAN)
            release(before)
        w = _unflat(np.concatenate(copies.select("slice", "v").toArrow().sort_by("slice")["v"].to_numpy()))  # SLICES rows, the network
        release(copies)
    return w


def network_logs(encoded: DataFrame, w: dict[str, np.ndarray]) -> DataFrame:
    """(uid, doc_id, n_tokens, log): the sum of the ids' log probabilities, and of own, in FRACTIONs. Each token's log is rounded before it is added, so
    that neither the order nor the rows that are scored together count."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    w = {k: v.astype(np.float64) for k, v in w.items()}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in runs(whole.column(2), 1 << 20):
                batch = whole.slice(part.start, part.stop - part.start)
                n = batch.column(2).to_numpy()
                ids, places = _spread(batch.column(3).flatten().to_numpy(), n)
                logs = np.zeros(len(places) + 1, np.int64)
                for i in range(0, len(places), STEP):
                    logs[i + 1 : i + 1 + STEP] = np.rint(log_probabilities(w, ids, places[i : i + STEP]) * FRACTION)
                ends = np.cumsum(n)
                logs = np.cumsum(logs)
                sums = logs[ends] - logs[ends - n] + np.rint(batch.column(4).to_numpy() * FRACTION).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums)], ["uid", "doc_id", "n_tokens", "log"])

    return encoded.select("uid", "doc_id", "n_tokens", "ids", "own").mapInArrow(lean(scored), f"uid long, doc_id {kind}, n_tokens long, log long")


def score_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, pll, mean_pll), one row per row of docs."""
    docs = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    sums = counted(docs)
    words = vocabulary(sums)
    encoded = cut(encode(docs, words))
    w = train(encoded, rounds)
    out = network_logs(encoded, w).join(rare_logs(encoded, sums, words), "uid", "left")
    out = out.select("doc_id", "n_tokens", F.round((F.col("log") + F.coalesce("rare_log", F.lit(0))) / FRACTION, 4).alias("pll"))
    return out.withColumn("mean_pll", F.when(F.col("n_tokens") > 0, F.round(F.col("pll") / F.col("n_tokens"), 4)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
