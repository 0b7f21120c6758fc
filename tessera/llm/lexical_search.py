"""Ranked lexical search over a two-level quantised index.

A term's part of a document's score is its weight times an impact, a whole number below 1,000,000. The index has a row per document with both levels:

* bytes: impacts in units of UNIT, rounded upward, so that the weighted sum of bytes is an upper bound of the document's score;
* counts: tf of each term and the document's m, from which scores are exact in whole numbers.

A search reads the index once for a block of items. In each task, bounds of a block of documents for all items are one weighted count; the documents of highest
bounds are scored exactly, which gives a lower bound of the item's kth score; then every document whose bound reaches it is scored exactly. The kth
score met so far in a task is a lower bound for all documents, so each task gives k rows an item at most, and those of all tasks are ranked.

The index holds the terms of the items that are searched for, of every document; N, L and df are over all documents. Items are dealt to blocks of BLOCK, or
fewer if their texts are long: a block's terms go to every task, and each block reads the documents once. Nothing else is held on the driver.

Null and empty texts have no terms: such documents count for nothing and such items have no rows. Repeated items are ranked each. Repeated rows of documents
are ranked each; equal scores go by ascending doc_id, null last. Very long texts are read whole. Empty tables give no rows. Other columns do no harm.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, lean, table

TOP = 10
#: Impacts, below 1,000,000, in so many bytes' steps of 8,192: up to 123.
UNIT = 1 << 13
#: Items of a block, and bytes of their texts; pairs of a document's term and an item that are added at once, and of a document's term and a pair that is scored.
BLOCK, BLOCK_BYTES, PAIRS = 2_000, 16_000_000, 2_000_000

#: Digits, letters and all bytes of characters beyond ASCII stay, A-Z are lower-cased, all else is a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERMS).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


@dataclass
class Index:
    """rows: (doc_id, m, terms, bytes, counts) of documents that have a term of the vocabulary. weights: by term."""

    rows: DataFrame
    weights: np.ndarray
    n_docs: int
    n_terms: int


def counts(docs: DataFrame, vocabulary: list[bytes], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts) of all documents that have terms; terms: places in the vocabulary."""
    place = {t: i for i, t in enumerate(vocabulary)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, n, ends, terms, tfs = [], [], [0], [], []
            for i, t in enumerate(batch.column(1)):
                if words := terms_of(t.as_py()):
                    found = Counter(map(place.get, words))
                    found.pop(None, None)
                    own.append(i)
                    n.append(len(words))
                    terms += found
                    tfs += found.values()
                    ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(count), f"doc_id {kind}, n long, terms array<int>, counts array<int>")


def build(docs: DataFrame, vocabulary: list[bytes], doc: str = "doc_id", text: str = "text") -> Index:
    rows = cut(counts(docs, vocabulary, doc, text))
    n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    found = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()  # as many rows as the vocabulary has terms
    df[found["t"].to_numpy()] = found["df"].to_numpy()
    m = F.lit(10) + F.expr(f"(90 * n * {n_docs}L) div {max(1, n_terms)}L")
    impact = lambda tf: F.call_function("div", F.lit(1_000_000_000).cast("long") * tf, 1000 * tf.cast("long") + 8 * F.col("m"))
    byte = lambda tf: F.call_function("div", impact(tf) + (UNIT - 1), F.lit(UNIT)).cast("tinyint")
    rows = rows.where(F.size("terms") > 0).select("doc_id", m.cast("long").alias("m"), "terms", "counts").withColumn("bytes", F.transform("counts", byte))
    return Index(rows, np.array([weight(n_docs, x) for x in df.tolist()], np.int64), n_docs, n_terms)


@dataclass
class Best:
    """The k best of each item so far."""

    k: int
    n_items: int
    item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    doc: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    none: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        item, score, doc, none = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc), (self.none, none)))
        order = np.lexsort((doc, none, -score, item))
        order = order[score[order] > 0]
        starts = np.searchsorted(item[order], np.arange(self.n_items))
        order = order[np.arange(len(order)) - starts[item[order]] < self.k]
        self.item, self.score, self.doc, self.none = item[order], score[order], doc[order], none[order]

    def least(self) -> np.ndarray:
        """By item, the kth score, or 1 if there are fewer."""
        held = np.bincount(self.item, minlength=self.n_items)
        out = np.ones(self.n_items, np.int64)
        full = held >= self.k
        out[full] = self.score[np.cumsum(held)[full] - 1]
        return out


def _expand(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which run, place) of all places of runs."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - (np.cumsum(sizes) - sizes)[which] + starts[which]


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return lists.flatten().to_numpy().astype(np.int64), np.asarray(lists.value_lengths()).astype(np.int64)


def best_of(index: Index, items: list[list[int]], k: int = TOP) -> DataFrame:
    """(item, doc_id, score): the k best of each task for each item, a list of different terms."""
    weights, n_items = index.weights, len(items)
    sizes = np.array([len(t) for t in items], np.int64)
    item_terms = np.concatenate([np.array(t, np.int64) for t in items]) if items else np.zeros(0, np.int64)
    of_term = np.argsort(item_terms, kind="stable")
    by_term = np.repeat(np.arange(n_items), sizes)[of_term]  # items of a term, one term after another
    first = np.searchsorted(item_terms[of_term], np.arange(len(weights) + 1))
    known = np.sort(np.repeat(np.arange(n_items), sizes) * len(weights) + item_terms)  # (item, term)

    def exact(doc: np.ndarray, item: np.ndarray, ends: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Scores of pairs of a document and an item."""
        out, done = np.zeros(len(doc), np.int64), np.cumsum(lengths[doc])
        at = 0
        while at < len(doc):
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, "right")))
            d = doc[at:to]
            which, place = _expand(ends[d] - lengths[d], lengths[d])
            key = item[at:to][which] * len(weights) + terms[place]
            is_known = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
            which, place = which[is_known], place[is_known]
            sums = np.concatenate(([0], np.cumsum(weights[terms[place]] * impacts(tfs[place], m[d[which]]))))
            own = np.searchsorted(which, np.arange(to - at + 1))
            out[at:to] = sums[own[1:]] - sums[own[:-1]]
            at = to
        return out

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, n_items)
        for batch in batches:
            ids = batch.column(0)
            none, ids = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy().astype(np.int64)
            m = batch.column(1).to_numpy()
            terms, lengths = _flat(batch.column(2))
            tfs, units = batch.column(3).flatten().to_numpy().astype(np.int64), batch.column(4).flatten().to_numpy().astype(np.int64)
            ends = np.cumsum(lengths)
            items_of = first[terms + 1] - first[terms]  # of each posting
            pairs = np.cumsum(np.concatenate(([0], items_of)))[np.concatenate(([0], ends))]
            at = 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(pairs, pairs[at] + PAIRS, "right")) - 1)
                to = min(to, at + max(1, PAIRS // max(1, n_items)))
                own = slice(ends[at] - lengths[at], ends[to - 1])
                which, place = _expand(first[terms[own]], items_of[own])
                row = np.repeat(np.arange(to - at), lengths[at:to])
                bound = np.bincount(row[which] * n_items + by_term[place], (weights[terms[own]] * units[own])[which], (to - at) * n_items)
                bound = bound.astype(np.int64).reshape(to - at, n_items) * UNIT
                scored = np.zeros(bound.shape, bool)
                high = np.argpartition(-bound, k - 1, 0)[:k] if to - at > k else np.repeat(np.arange(to - at)[:, None], n_items, 1)
                scored[high, np.arange(n_items)] = True
                for chosen in (scored, None):  # those of highest bounds, then all whose bounds reach what these give
                    d, i = np.nonzero((chosen if chosen is not None else ~scored) & (bound >= best.least()))
                    best.add(i, exact(d + at, i, ends, lengths, terms, tfs, m), ids[d + at], none[d + at])
                at = to
        yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.doc, mask=best.none), pa.array(best.score)], ["item", "doc_id", "score"])

    return index.rows.select(F.col("doc_id").cast("long"), "m", "terms", "counts", "bytes").mapInArrow(lean(search), "item long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of each item. doc: a column of whole numbers."""
    spark = docs.sparkSession
    kind = items.schema[item].dataType.simpleString()
    items = items.select(F.col(item).alias("item_id"), F.col(item_text).alias("text"))
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK), -(-size // BLOCK_BYTES))
    items = cut(items.repartition(blocks).withColumn("block", F.spark_partition_id()))
    found = []
    for b in range(blocks):
        own = items.where(F.col("block") == b).select("item_id", "text").collect()  # a block is bounded
        terms = [sorted(set(terms_of(t))) for _, t in own]
        vocabulary = sorted(set().union(*terms))
        place = {t: i for i, t in enumerate(vocabulary)}
        best = best_of(build(docs, vocabulary, doc, text), [[place[t] for t in ts] for ts in terms], k)
        ids = spark.createDataFrame([(i, x[0]) for i, x in enumerate(own)], f"item long, item_id {kind}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found.append(best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, {_SPLIT} AS t FROM documents),
dn AS (SELECT u, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM dn),
p AS (SELECT u, term, count(*) AS tf FROM (SELECT u, unnest(t) AS term FROM d) GROUP BY u, term),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, s),
i AS (SELECT row_number() OVER () AS k, item_id, {_SPLIT} AS t FROM benchmark),
q AS (SELECT DISTINCT k, item_id, term FROM (SELECT k, item_id, unnest(t) AS term FROM i)),
x AS (
  SELECT q.k, q.item_id, dn.u, dn.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * dn.n * s.n_docs) // s.n_terms)))) AS BIGINT) AS score
  FROM q JOIN w ON q.term = w.term JOIN p ON p.term = q.term JOIN dn ON dn.u = p.u, s
  GROUP BY q.k, q.item_id, dn.u, dn.doc_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= {TOP}
"""
