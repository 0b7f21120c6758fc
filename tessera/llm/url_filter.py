"""URL filters by a Bloom filter cascade.

Rules are (host, path) keys. The keys that a url could match (its host's suffixes with as many labels as
some rule has, each with its path's prefixes as long as some rule's) are the key universe of the corpus.
Level 1 is a Bloom filter of the listed keys; level 2 one of the universe's keys that level 1 passes
wrongly; level 3 one of the listed keys that level 2 passes wrongly; and so on until none is left. For
any key of the universe the first level that rejects it, or the parity of the last, tells exactly whether
it is listed, without a join. A url's keys are one array, and each filter is one literal that all of them are tested
against. The literals' size follows the number of listed keys. Of more than ``most`` (MAX_KEYS) the cascade is a table:
keys are parted by hash, some PART_KEYS to a part, each part has its own filters of all levels in one row of some 30 KB, and urls'
keys are tested against the row of their part. The result is the same, and no list is too long.

Rules are a list or a DataFrame with action, host and path; a null path is empty, and a rule with null or empty host fits nothing, as one
with an action but block and allow does. Only the rules' shapes (pairs of a number of labels and a length of path) come to the driver.

A null url, or one without ``://``, has empty host and path and fits no rule. Urls that no rule fits are
allowed: the method finds them unlisted. If a key is listed to block and to allow, allow wins. Repeated rows
are judged alike; an empty table gives no rows; other columns stay, but for those of the names that are added.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, lower_ascii, release, table, unused

#: Keys at most that a cascade's filter encodes: it then has about 5 MB.
MAX_KEYS = 1_000_000
#: Listed keys of a part of a cascade that is a table, on average.
PART_KEYS = 4_096

#: (action, host, path) of the query.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


@dataclass(frozen=True)
class Level:
    """A Bloom filter of ``bits`` bits and ``hashes`` hash functions; words has 64 bits in each, or is the name of the column that has them (null: an empty filter)."""

    seed: int
    bits: int
    hashes: int
    words: tuple[int, ...] | str

    @classmethod
    def of(cls, n: int, seed: int, rate: float, words: tuple[int, ...] | str = ()) -> Level:
        """For n keys, of others of which it passes a share of rate."""
        bits = max(64, math.ceil(n * math.log2(1 / rate) / math.log(2) / 64) * 64)
        return cls(seed, bits, max(1, round(math.log2(1 / rate))), words)

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.seed * 64 + i), key), F.lit(self.bits)) for i in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        if isinstance(self.words, str):
            words = F.col(self.words)
        else:
            words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded to one literal
        has = lambda p: F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
        return F.coalesce(F.forall(F.array(*self.positions(key)), has), F.lit(False))


def _level(keys: DataFrame, n: int, seed: int, rate: float) -> Level:
    """Encodes the n rows of ``key``. What comes to the driver is the filter: a word for each 64 bits at most."""
    level = Level.of(n, seed, rate)
    set_bits = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("p"))
    mask = set_bits.select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    words = [0] * (level.bits // 64)
    for w, b in mask.groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        words[w] = b
    return Level(seed, level.bits, level.hashes, tuple(words))


def build_cascade(universe: DataFrame, listed: DataFrame, most: int = MAX_KEYS) -> list[Level] | None:
    """universe, listed: a column ``key``. universe may repeat keys and is only filtered by level 1. None if a level had more than most keys."""
    listed = cut(listed.where("key is not null").distinct())
    n = listed.count()
    if not n or n > most:
        return None if n else []
    rate = min(0.5, max(1e-9, n / max(1, universe.count())))
    levels = [_level(listed, n, 1, rate)]
    wrong = cut(universe.where(levels[0].passes(F.col("key"))).distinct().join(listed, "key", "left_anti"))
    encoded, others = listed, wrong
    while n_others := others.count():
        if n_others > 8 * most:
            return None
        levels.append(_level(others, n_others, len(levels) + 1, 0.5))
        encoded, others = others, cut(encoded.where(levels[-1].passes(F.col("key"))))
    return levels


def is_listed(levels: list[Level], key: Column) -> Column:
    """Exact for keys of the universe that the cascade was built over."""
    out = F.lit(len(levels) % 2 == 1)
    for i, level in reversed(list(enumerate(levels))):
        out = F.when(~level.passes(key), F.lit(i % 2 == 1)).otherwise(out)
    return out


@dataclass(frozen=True)
class Parted:
    """A cascade as a table: filters has a row per part, with the words of all levels."""

    levels: tuple[Level, ...]
    parts: int
    filters: DataFrame

    def listed(self, keys: DataFrame, key: str) -> DataFrame:
        """keys' rows whose key is listed; exact for keys of the universe. A part that many rows meet may be split, as the filters' side is small."""
        return keys.join(self.filters, (_part(F.col(key), self.parts) == F.col("_part")) & is_listed(list(self.levels), F.col(key)), "left_semi")


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), key), F.lit(parts))


def _words(level: Level, keys: DataFrame, parts: int) -> DataFrame:
    """(_part, words): a row for each part that keys fall into."""
    keys = keys.select(_part(F.col("key"), parts).alias("_part"), "key")
    bits = keys.select("_part", F.explode(F.array(*level.positions(F.col("key")))).alias("p"))
    bits = bits.select("_part", F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    none = keys.select("_part").distinct().select("_part", F.explode(F.sequence(F.lit(0), F.lit(level.bits // 64 - 1)).cast("array<bigint>")).alias("w"), F.lit(0).cast("bigint").alias("b"))
    words = bits.unionByName(none).groupBy("_part", "w").agg(F.bit_or("b").alias("b"))
    return words.groupBy("_part").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words"))


def parted_cascade(universe: DataFrame, listed: DataFrame, per: int = PART_KEYS) -> Parted:
    """As build_cascade, for listed keys of any number: each level is built for all parts at once, and nothing but counts comes to the driver."""
    listed = cut(listed.where("key is not null").distinct())
    n = listed.count()
    parts = max(1, math.ceil(n / per))
    levels, tables = [], []

    def passed(n_encoded: int, encoded: DataFrame, others: DataFrame, rate: float) -> DataFrame:
        level = Level.of(math.ceil(n_encoded / parts), len(levels) + 1, rate, f"_words{len(levels) + 1}")
        levels.append(level)
        tables.append(cut(_words(level, encoded, parts)))
        filters = tables[-1].withColumnRenamed("words", level.words)
        return others.join(filters, (_part(F.col("key"), parts) == F.col("_part")) & level.passes(F.col("key")), "left_semi")

    wrong = passed(n, listed, universe, min(0.5, max(1e-9, n / max(1, universe.count()))))
    encoded, others = listed, cut(wrong.distinct().join(listed, "key", "left_anti"))
    while n_others := others.count():
        encoded, others = others, cut(passed(n_others, others, encoded, 0.5))
    rows = reduce(DataFrame.unionByName, [t.withColumn("level", F.lit(i)) for i, t in enumerate(tables)])
    filters = rows.groupBy("_part").agg(*[F.first(F.when(F.col("level") == i, F.col("words")), True).alias(level.words) for i, level in enumerate(levels)])
    out = Parted(tuple(levels), parts, cut(filters))
    release(listed, *tables)
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return lower_ascii(part(1)), part(2)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, url: str = "url", most: int = MAX_KEYS) -> DataFrame:
    """pages with host, path, rule and verdict; columns of these names are replaced. rules: (action, host, path)."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    pages = pages.withColumns({"host": host, "path": path})
    if not isinstance(rules, DataFrame):
        rules = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([{"action": a, "host": h, "path": p} for a, h, p in rules])), "array<struct<action:string,host:string,path:string>>")))
    rules = rules.select("action", "host", F.coalesce("path", F.lit("")).alias("path")).where("host <> '' and action in ('block', 'allow')")
    labels = lambda h: F.length(h) - F.length(F.translate(h, ".", "")) + 1
    shapes = sorted(map(tuple, rules.select(labels(F.col("host")), F.length("path")).distinct().collect()))
    if not shapes:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    listed = rules.select("action", F.concat("host", "path").alias("key"))
    fit = F.filter(F.from_json(F.lit(json.dumps([{"n": n, "k": k} for n, k in shapes])), "array<struct<n:int,k:int>>"), lambda s: (labels(F.col("host")) >= s["n"]) & (F.length("path") >= s["k"]) & (F.col("host") != ""))
    suffix = lambda s: F.call_function("substring_index", F.col("host"), F.lit("."), -s["n"])
    keys = F.transform(fit, lambda s: F.struct((F.length(suffix(s)) + s["k"]).alias("chars"), s["n"].alias("labels"), F.concat(suffix(s), F.substring(F.col("path"), F.lit(1), s["k"])).alias("key")))
    universe = pages.select(F.explode(keys).alias("k")).select("k.key")
    of_action = {action: listed.where(F.col("action") == action) for action in ("block", "allow")}
    cascades = {action: build_cascade(universe, own, most) for action, own in of_action.items()}
    best, of_page = unused(pages, "best"), unused(pages, "keys")
    found = lambda k, action: F.struct(k["chars"].alias("chars"), k["labels"].alias("labels"), F.lit(action == "allow").alias("allow"), k["key"].alias("key"))
    pages = pages.withColumn(of_page, keys)
    literal = {action: levels for action, levels in cascades.items() if levels}
    of = lambda action, levels: F.transform(F.filter(of_page, lambda k: is_listed(levels, k["key"])), lambda k: found(k, action))
    hits = [of(action, levels) for action, levels in literal.items()]
    if None in cascades.values():
        row = unused(pages, "row")
        pages = pages.withColumn(row, F.monotonically_increasing_id())
        asked = pages.select(F.col(row).alias("row"), F.explode(of_page).alias("k")).select("row", "k", "k.key")
        tables = {action: parted_cascade(universe, of_action[action]) for action, levels in cascades.items() if levels is None}
        far = reduce(DataFrame.unionByName, [table.listed(asked, "key").select("row", found(F.col("k"), action).alias("f")) for action, table in tables.items()])
        far_best = unused(pages, "far")
        far = far.groupBy("row").agg(F.max("f").alias(far_best)).withColumnRenamed("row", row)
        pages = pages.join(far, row, "left")
        pages = pages.withColumn(best, F.greatest(far_best, F.array_max(F.concat(*hits))) if hits else F.col(far_best)).drop(row, far_best)
    else:
        pages = pages.withColumn(best, F.array_max(F.concat(*hits)))
    return pages.withColumns({"rule": F.col(best)["key"], "verdict": F.when(~F.col(best)["allow"], "block").otherwise("allow")}).drop(best, of_page)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, list(RULES)).select("page_id", "host", "path", "rule", "verdict")


#: Has net/de/ to block, which the contract (and RULES) allows: verdicts of urls whose longest rule is net/de/ differ.
SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, row_number() OVER () AS i FROM pages),
rules(action, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT i, arg_max(h || rules.p, length(h || rules.p)) AS rule, arg_max(action, length(h || rules.p)) AS action
      FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN m USING (i)
"""
