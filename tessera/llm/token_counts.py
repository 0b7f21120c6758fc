"""Token counts of a byte-level BPE vocabulary, without identifiers.

A text is split into pretokens; a pretoken starts as one symbol per UTF-8 byte in a doubly linked list, and a
heap of adjacent pairs gives up the pair of lowest rank (leftmost first) until none is left. Each merge takes
one symbol away, so the count is symbols minus merges. Counts of pretokens and of space-separated pieces are
remembered up to MEMO entries each in a Python worker; when full, the memory starts anew, so it is bounded
whatever the corpus. Special tokens' strings inside a text count one each, as the library's default has it.

Null and empty texts have 0 bytes and 0 tokens. Very long pretokens take n log n steps. Repeated rows count
alike; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lean, table

MEMO = 600_000
LIMIT = 512

# Fixed value: how byte-level BPE splits a text. White space is Unicode's, as in the library.
_SPACE = r"\p{White_Space}"
PRETOKENS = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|{_SPACE}+(?![^{_SPACE}])|{_SPACE}+"
)


def byte_letters() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable ones for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(0x100 + n)
    return [letters[b] for b in range(256)]


class Merger:
    """Counts what is left of a pretoken after all merges."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.start = [ids[c] for c in byte_letters()]
        self.rank = {}
        for n, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.rank[ids[a], ids[b]] = n, ids[a + b]
        self.special = [t["content"] for t in spec["added_tokens"]]

    def left(self, pretoken: str) -> int:
        symbols = [self.start[b] for b in pretoken.encode()]
        n, rank = len(symbols), self.rank
        if n == 1:
            return 1
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if found := rank.get((symbols[i], symbols[i + 1])):
                heap.append((found[0], i, found[1], symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if found := rank.get((new, symbols[k])):
                    heapq.heappush(heap, (found[0], i, found[1], new, symbols[k]))
            if (h := before[i]) >= 0 and (found := rank.get((symbols[h], new))):
                heapq.heappush(heap, (found[0], h, found[1], symbols[h], new))
        return n - merges


class _Whole(Exception):
    """A piece that cannot be counted apart from its neighbours."""


class _Pretokens(dict):
    def __init__(self, merger: Merger):
        self.merger = merger

    def __missing__(self, pretoken: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        n = self[pretoken] = self.merger.left(pretoken)
        return n


class _Pieces(dict):
    """Counts of `` piece``. A space before a non-space always starts a pretoken, so that pieces count apart."""

    def __init__(self, pretokens: _Pretokens):
        self.pretokens = pretokens

    def __missing__(self, piece: str) -> int:
        if not piece or _BLANK.match(piece):
            raise _Whole
        n = sum(map(self.pretokens.__getitem__, PRETOKENS.findall(" " + piece)))
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = n
        return n


_BLANK = regex.compile(_SPACE)


class Counter:
    def __init__(self, vocabulary: str):
        merger = Merger(vocabulary)
        self.pretokens = _Pretokens(merger)
        self.pieces = _Pieces(self.pretokens)
        self.special = re.compile("|".join(map(re.escape, sorted(merger.special, key=len, reverse=True)))) if merger.special else None

    def plain(self, text: str) -> int:
        first, *rest = text.split(" ")
        try:
            return sum(map(self.pieces.__getitem__, rest)) + sum(map(self.pretokens.__getitem__, PRETOKENS.findall(first)))
        except _Whole:
            return sum(map(self.pretokens.__getitem__, PRETOKENS.findall(text)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)


def count_tokens(docs: DataFrame, vocabulary: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit). vocabulary: a tokenizer's .json that every executor has at this path."""
    docs = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(vocabulary)
            texts = batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            counts = [counter.count(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = docs.mapInArrow(lean(counted), f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
