"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of WINDOW words (all its words if it has fewer). A window is a set of
positioned shingles of SHINGLE words (all its words if it has fewer). As a window must occur whole, its
necessary prefix is one shingle: the one that is rarest in the corpus, counted over all documents. Document
positions are joined to windows on that shingle only; the start it implies must lie in the document (the
positional bound) with room for the window's length (the length bound); then the words are compared one by one.

Documents are read once. A bit filter of the benchmark's shingles, whose size is bounded by MAX_BITS, leaves
few positions, each kept with the words around it; what the filter passes wrongly, the join drops. The
benchmark itself is joined, and broadcast only if its counted rows allow.

Null and empty texts have no words and are not hit; null item texts have no windows; items may repeat. Rows
with equal doc_id and different texts are judged apart. Empty tables and other columns do no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, lower_ascii, small, table
from tessera.llm.url_filter import Level

WINDOW, SHINGLE = 10, 5
#: Bits of the filter for each shingle of the benchmark, and at most.
BITS_PER_KEY, MAX_BITS = 64, 1 << 26
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    w = F.split(F.concat(F.lit(" "), lower_ascii(F.coalesce(text, F.lit(""))), F.lit(" ")), _GAPS)  # the first and the last are empty
    return F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0)))


def _hash(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i if i else at) for i in range(k)])


def _shingle(k: int):
    return lambda i: _hash(F.col("w"), i, k)


def _around(k: int):
    """A place with the words around it, so that any window through it can be compared."""

    def place(i: Column) -> Column:
        first = F.greatest(i - (WINDOW - 1), F.lit(0))
        return F.struct(i.alias("pos"), F.lit(k).alias("k"), _hash(F.col("w"), i, k).alias("sh"), first.alias("from"), F.slice("w", first + 1, F.lit(2 * WINDOW - 1)).alias("around"))

    return place


def windows_of(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, win, len, k, shingles): a window's words joined by spaces, and its shingles' hashes by offset."""
    w = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("w")).where("size(w) > 0")
    w = w.select("item", "w", F.explode(F.expr(f"sequence(0, greatest(size(w) - {WINDOW}, 0))")).alias("at"))
    w = w.select("item", F.slice("w", F.col("at") + 1, F.lit(WINDOW)).alias("w"))
    w = w.select("item", F.array_join("w", " ").alias("win"), F.size("w").alias("len"), F.least(F.size("w"), F.lit(SHINGLE)).alias("k"), "w").distinct()
    by_k = F.lit(None).cast("array<bigint>")
    for k in range(1, SHINGLE + 1):
        by_k = F.when(F.col("k") == k, F.transform(F.expr(f"sequence(0, size(w) - {k})"), _shingle(k))).otherwise(by_k)
    return w.select("item", "win", "len", "k", by_k.alias("shingles"))


def _passes(bits: Level, k: int):
    return lambda i: bits.passes(_hash(F.col("w"), i, k))


def _filter(shingles: DataFrame, n: int) -> Level:
    bits = min(MAX_BITS, max(1024, math.ceil(n * BITS_PER_KEY / 64) * 64))
    level = Level(7, bits, 2, ())
    rows = shingles.select(F.explode(F.array(*level.positions(F.col("sh")))).alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    words = [0] * (bits // 64)
    for w, b in rows.groupBy("w").agg(F.bit_or("b").alias("b")).collect():  # a row for each 64 bits at most
        words[w] = b
    return Level(7, bits, 2, tuple(words))


def find(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated), one row per row of docs; key is the text's md5, null if null."""
    bench = cut(windows_of(items, item, item_text))
    wins = cut(bench.select("win", "len", "k", "shingles").distinct())
    by_offset = wins.select("win", "len", "k", F.posexplode("shingles").alias("offset", "sh"))
    shingles = by_offset.select("sh").distinct()
    n = shingles.count()
    ks = sorted(r.k for r in wins.select("k").distinct().collect())
    bits = _filter(shingles, n)

    found = F.array().cast("array<struct<pos:int,k:int,sh:bigint,from:int,around:array<string>>>")
    for k in ks:
        places = F.expr(f"if(n_words < {k}, cast(array() as array<int>), sequence(0, n_words - {k}))")
        found = F.concat(found, F.transform(F.filter(places, _passes(bits, k)), _around(k)))
    d = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    d = d.select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"), words_of(F.col("text")).alias("w")).withColumn("n_words", F.size("w"))
    d = cut(d.select("doc_id", "key", "n_words", found.alias("found")))

    places = d.where("size(found) > 0").select("doc_id", "key", "n_words", F.explode("found").alias("f")).select("doc_id", "key", "n_words", "f.*")
    often = places.groupBy("sh").agg(F.count("*").alias("often"))
    rarest = (
        by_offset.join(often, "sh", "left").groupBy("win", "len", "k").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "offset", "sh")).alias("r"))
        .where("r.often > 0").select("win", "len", "k", "r.offset", "r.sh")
    )
    start = F.col("pos") - F.col("offset")
    hits = (
        places.join(small(cut(rarest)), ["sh", "k"]).withColumn("start", start)
        .where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))
        .where(F.array_join(F.slice("around", F.col("start") - F.col("from") + 1, F.col("len")), " ") == F.col("win"))
        .select("doc_id", "key", "start", "len", "win")
    )
    hits = cut(hits)
    spans = hits.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end")))).alias("spans"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")),
    )["n"]
    spans = spans.select("doc_id", "key", covered.alias("n_hit"))
    per_item = hits.select("doc_id", "key", "win").distinct().join(bench.select("win", "item"), "win").select("doc_id", "key", "item").distinct()
    per_item = per_item.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    hit = spans.join(per_item, spans.doc_id.eqNullSafe(per_item.doc_id) & (spans.key == per_item.key)).select(spans.doc_id.alias("h_doc"), spans.key.alias("h_key"), "n_hit", "items")

    near = d.where("size(found) > 0").select("doc_id", "key", "n_words")
    near = near.join(hit, F.col("doc_id").eqNullSafe(F.col("h_doc")) & (F.col("key") == F.col("h_key")), "left").drop("h_doc", "h_key")
    rest = d.where("size(found) = 0").select("doc_id", "key", "n_words", F.lit(None).cast("int").alias("n_hit"), F.lit(None).cast("array<string>").alias("items"))
    out = near.unionByName(rest)
    names = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "key", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item, array_to_string(w[p:p + 9], ' ') AS win, least(len(w), 10) AS n FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(p) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM wins),
runs AS (SELECT i, p, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM (SELECT i, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT i, p, item, runs.n FROM runs JOIN wins ON runs.win = wins.win AND runs.n = wins.n),
per AS (SELECT i, count(DISTINCT x) AS n_hit FROM hits, unnest(range(p, p + n)) AS t(x) GROUP BY i),
its AS (SELECT i, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT i, item FROM hits) GROUP BY i)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (i) LEFT JOIN its USING (i)
"""
