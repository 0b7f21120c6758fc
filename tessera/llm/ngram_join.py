"""Exact n-gram Jaccard self-join by a token-group matrix.

A document's set has its distinct shingles of WIDTH words as 64-bit hashes. Texts of the same words are one
class, which is joined once. Let P(x) be the first |x| - ceil(0.8 |x|) + K(|x|) tokens of a set in one fixed order
for all, K(n) = 1 + n / 10. Two sets that link share at least K of the smaller one's size tokens of their P, since the first
common tokens in the order lie in both. The order puts tokens that many documents have (counted over all documents;
at most HEAVY of them are kept) last, others by hash; any order gives the same links.

1. Tokens of P that one class alone has drop out. A class with too few left has no link.
2. Each class left goes to a group: that of the most frequent token of its P. The token-group matrix has, for each token
   and group, how many members' P have it.
3. A class queries a group if at least as many of its P's tokens are in the group's union as a link needs: the bound on overlap.
   Of two groups only the later is queried. Classes without enough in common with the others of their group, that query none and are in none that is queried, have no link.
4. Members are compared with the hub, a member whose tokens are the group's most frequent ones. Members linked to it are
   one component already and are not compared with one another, so that a large group of near copies costs its size.
   What is left of the members, and the visiting queries, are compared with all members of the groups they qualify
   for, in blocks of about BLOCK members or BLOCK_TOKENS tokens, whichever are fewer, by as many queries; each block bounds a
   query by its own token union first and then counts exact overlaps. No pair leaves a block but those that join components.
5. Links form components by star contraction.

Memory per task is bounded by a block (and by the longest text). A group of near copies that do not link to its hub takes time
by the square of their number; nothing is dropped or capped. Shingles are equal if their 64-bit hashes are, which is
all that "exact" leaves open. Tokens of more than a small share of the documents are among the frequent ones, so that what is
counted by token in a window is none of them.

Null and empty texts (no words) have no shingle and are alone. With fewer than WIDTH words the sequence is one
shingle. Rows of equal doc_id are judged by their texts. Empty tables and other columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, lean, release, small, table

WIDTH, PERCENT = 5, 80
#: Tokens put last in the order, at most, and how many documents they are in at least.
HEAVY, OFTEN = 1 << 16, 64
BLOCK, BLOCK_TOKENS, CHUNK, MEMO = 1024, 1 << 20, 1_000_000, 200_000
#: Hubs are broadcast if their sets have so many tokens together at most (32 MB), else joined.
HUB_TOKENS = 4_000_000

_P = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """bytes know only the ASCII letters and white space."""
    return text.encode().lower().split() if text else []


def tokens_of(words: list[bytes], hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    if not words:
        return np.zeros(0, np.int64)
    h = np.array(list(map(hashes.__getitem__, words)), np.uint64)
    width = min(WIDTH, len(words))
    s = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        s = s * _P + h[i : i + len(s)]
        s ^= s >> np.uint64(29)
    s = (s ^ (s >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique((s ^ (s >> np.uint64(32))).view(np.int64))


def _key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


class _Seen(set):
    """Keys that a task has had; forgets them all when there are many, which costs only repeats."""

    def new(self, key: bytes) -> bool:
        if key in self:
            return False
        if len(self) >= 1_000_000:
            self.clear()
        self.add(key)
        return True


def needed(n: int | np.ndarray):
    """ceil(0.8 n)"""
    return (n * PERCENT + 99) // 100


def _prefix(tokens: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(tokens)
    most = n - needed(n) + 1 + n // 10
    last = np.isin(tokens, heavy, assume_unique=True) if len(heavy) else np.zeros(n, bool)
    light = tokens[~last][:most]
    return light, tokens[last][: most - len(light)]


#: Shared tokens of P that a link needs at least, of a set of n.
_BOUND = f"1 + ((n * {PERCENT} + 99) div 100) div 10"


def frequent_tokens(docs: DataFrame) -> np.ndarray:
    """Tokens that most documents have, over all documents: those that a task meets at least twice among CHUNK tokens
    are summed, so that one of any fixed share is found."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, held, size = _Hashes(), _Seen(), [], 0

        def flush():
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            often = n > 1
            return pa.RecordBatch.from_arrays([pa.array(tokens[often]), pa.array(n[often].astype(np.int64))], ["token", "n"])

        for batch in batches:
            for t in batch.column(0):
                words = words_of(t.as_py())
                if words and seen.new(_key(words)):
                    held.append(tokens_of(words, hashes))
                    size += len(held[-1])
                if size >= CHUNK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    sums = docs.select("text").mapInArrow(lean(counted), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    return np.sort(sums.orderBy(F.desc("n"), "token").limit(HEAVY).select("token").toArrow()["token"].to_numpy())


def prefixes(docs: DataFrame, heavy: np.ndarray) -> DataFrame:
    """(doc_id, n, key, light, heavy and a mark that docs may have) by row; no tokens where the task has had the text before."""
    kind, marked = docs.schema["doc_id"].dataType.simpleString(), "mark" in docs.columns

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sizes, seen = _Hashes(), {}, _Seen()
        for batch in batches:
            rows = []
            for t in batch.column(1):
                words = words_of(t.as_py())
                if not words:
                    rows.append((0, None, None, None))
                    continue
                key = _key(words)
                if seen.new(key):
                    if not len(seen) - 1:
                        sizes.clear()
                    tokens = tokens_of(words, hashes)
                    sizes[key] = len(tokens)
                    rows.append((len(tokens), key, *_prefix(tokens, heavy)))
                else:
                    rows.append((sizes[key], key, None, None))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            types = pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())
            made_of = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))] + ([batch.column(2)] if marked else [])
            yield pa.RecordBatch.from_arrays(made_of, ["doc_id", "n", "key", "light", "heavy"] + ["mark"] * marked)

    return docs.mapInArrow(lean(made), f"doc_id {kind}, n long, key binary, light array<long>, heavy array<long>" + ", mark string" * marked)


def whole_sets(docs: DataFrame) -> DataFrame:
    """(key, tokens) by row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            keys, sets = [], []
            for t in batch.column(0):  # words of one text at a time
                words = words_of(t.as_py())
                keys.append(_key(words))
                sets.append(tokens_of(words, hashes))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["key", "tokens"])

    return docs.select("text").mapInArrow(lean(made), "key binary, tokens array<long>")


class Union:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, a: int) -> int:
        up = self.up
        while (b := up.get(a, a)) != a:
            up[a] = up.get(b, b)
            a = b
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def open_block(rows: pa.Table) -> pa.Table:
    """Rows of one block: members, with the hub they are linked to if any, and queries. Gives links that join components."""
    query = np.array(rows["query"])
    ids, sizes = np.array(rows["id"]), np.array(rows["n"])
    sets = rows["tokens"].combine_chunks()
    sets = sets.combine_chunks() if isinstance(sets, pa.ChunkedArray) else sets
    offsets, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
    members = np.flatnonzero(~query)
    held = np.concatenate([flat[offsets[m] : offsets[m + 1]] for m in members]) if len(members) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(members)), np.diff(offsets)[members])
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    parts, out = Union(), []
    for i, hub in zip(ids[members].tolist(), rows["hub"].take(pa.array(members)).to_pylist(), strict=True):
        if hub is not None:
            parts.join(i, hub)
    for q in np.flatnonzero(query):
        n = int(sizes[q])
        own = flat[offsets[q] : offsets[q + 1]]
        a, z = np.searchsorted(held, own, "left"), np.searchsorted(held, own, "right")
        count = z - a
        if np.count_nonzero(count) < needed(n):
            continue  # the union of the block does not hold enough of the query
        ends = np.cumsum(count)
        places = np.arange(ends[-1]) + np.repeat(a - ends + count, count)
        overlap = np.bincount(owner[places], minlength=len(members))
        for m in np.flatnonzero(100 * overlap >= PERCENT * (n + sizes[members] - overlap)):
            b, c = int(ids[q]), int(ids[members[m]])
            if b != c and parts.join(b, c):
                out.append((b, c))
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """(id, root), the least id of each component, for all ids that have a link; links: (a, b)."""
    e = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        before, e = e, cut(large.join(first, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(first.select("u", F.col("m").alias("v"))).distinct())
        release(before)


def mark_of(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def join(docs: DataFrame, doc: str = "doc_id", text: str = "text", marked: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of docs. marked: also the text's md5 as mark, and root, which no two components
    share, as they may share their least doc_id (null where a text has no words)."""
    docs = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), *[mark_of(F.col(text)).alias("mark")] * marked)
    rows = cut(prefixes(docs, frequent_tokens(docs)))
    tokens = [F.first(c, ignorenulls=True).alias(c) for c in ("light", "heavy")]
    classes = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), *tokens)
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))

    light = classes.select("id", "n", F.explode("light").alias("token")).withColumn("df", F.expr("count(*) over (partition by token)")).where("df > 1")
    heavy = classes.select("id", "n", F.explode("heavy").alias("token"))
    often = heavy.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")  # HEAVY rows at most
    shared = cut(light.unionByName(heavy.join(F.broadcast(often), "token").select("id", "n", "token", "df")))

    enough = shared.groupBy("id").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(F.expr(f"c >= {_BOUND}")).select("id")
    live = shared.join(small(cut(enough)), "id", "left_semi").groupBy("id").agg(F.first("n").alias("n"), F.max(F.struct("df", "token")).alias("top"), F.sum("df").alias("pop"))
    live = cut(live.select("id", "n", F.col("top.token").alias("home"), (F.col("pop") / F.col("n")).alias("score")))

    of_live = shared.select("id", "token").join(small(live.select("id", "n", "home")), "id")
    matrix = cut(of_live.groupBy("token", F.col("home").alias("group")).agg(F.count("*").alias("members")))
    seen = of_live.join(matrix, "token").where("group > home or group = home and members > 1").groupBy("id", "home", "group").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    seen = cut(seen.where(F.expr(f"c >= {_BOUND}")).select("id", "home", "group", "n"))
    visits = seen.where("group <> home").select("id", "group", "n")
    # whoever has enough in common with no group, its own without itself included, and is in none that is queried, has no link
    needed_ids = seen.select("id").unionByName(live.join(small(visits.select(F.col("group").alias("home")).distinct()), "home", "left_semi").select("id")).distinct()
    live = live.join(small(cut(needed_ids)), "id", "left_semi")
    live = cut(live.join(classes.select("id", "key", "rep"), "id"))

    wanted = live.select(F.col("rep").alias("w")).distinct()
    chosen = docs.join(small(wanted), docs.doc_id.eqNullSafe(F.col("w")), "left_semi")
    sets = whole_sets(chosen).groupBy("key").agg(F.first("tokens").alias("tokens"))
    sets = cut(sets.join(small(live), "key").select("id", "n", "home", "tokens"))

    groups = live.groupBy("home").agg(F.max(F.struct("score", (-F.col("id")).alias("minus"))).alias("h"), F.count("*").alias("members")).where("members > 1")
    hubs = sets.select(F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("tokens").alias("hub_tokens")).join(small(cut(groups.select("home", (-F.col("h.minus")).alias("hub")))), "hub")
    hubs = cut(hubs)
    hubs = F.broadcast(hubs) if (hubs.agg(F.sum("hub_n")).first()[0] or 0) <= HUB_TOKENS else hubs
    overlap = F.size(F.array_intersect("tokens", "hub_tokens"))
    starred = sets.join(hubs, "home").withColumn("o", F.when(F.col("id") == F.col("hub"), F.col("n")).when(F.least("n", "hub_n") * 100 < F.greatest("n", "hub_n") * PERCENT, F.lit(0)).otherwise(overlap))
    starred = cut(starred.select("id", F.col("home").alias("group"), "n", F.when(F.expr(f"100 * o >= {PERCENT} * (n + hub_n - o)"), F.col("hub")).alias("hub")))

    asked = cut(starred.where("hub is null").select("id", "group", "n").unionByName(visits))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS))
    shape = live.groupBy(F.col("home").alias("group")).agg(blocks.alias("mb")).join(asked.groupBy("group").agg(blocks.alias("qb")), "group")
    shape, asked = small(cut(shape)), asked.select("id", "group")
    nothing = F.lit(None).cast("long").alias("hub")
    members = sets.withColumnRenamed("home", "group").join(shape, "group").join(small(starred.select("id", "hub")), "id", "left")
    members = members.select("group", F.expr("pmod(xxhash64(id), mb)").alias("mblock"), F.explode(F.expr("sequence(0L, qb - 1)")).alias("qblock"), F.lit(False).alias("query"), "id", "n", "hub", "tokens")
    queries = sets.select("id", "n", "tokens").join(small(asked), "id").join(shape, "group")
    queries = queries.select("group", F.explode(F.expr("sequence(0L, mb - 1)")).alias("mblock"), F.expr("pmod(xxhash64(id), qb)").alias("qblock"), F.lit(True).alias("query"), "id", "n", nothing, "tokens")
    found = members.unionByName(queries).groupBy("group", "mblock", "qblock").applyInArrow(open_block, "a long, b long")

    star = starred.where("hub is not null and hub <> id").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    roots = components(star.unionByName(found))
    named = roots.join(classes.select("id", "rep"), "id")
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    of_class = classes.select("id", "key", "rep").join(roots, "id", "left").join(least, "root", "left").select(F.col("key").alias("k"), F.coalesce("component", "rep").alias("component"), F.coalesce("root", "id").alias("root"))
    also = ["mark", "root"] * marked
    out = rows.select("doc_id", "n", "key", *also[:1]).join(of_class, F.col("key") == F.col("k"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), *also)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
