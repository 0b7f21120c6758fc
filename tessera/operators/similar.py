"""All pairs of names whose similarity reaches a floor, found by an index, never by comparing all with all.

A ratio of t between strings of a and b characters needs t * (a + b) / 2 characters in common, counted with repeats. So both have their characters numbered by
occurrence and put in order, rarest first: the first few that they share lie within short prefixes of both. Each string gives a key for every combination of
DEPTH characters of its prefix, once for each band of lengths a partner may have; strings meet on equal keys, and bit masks, the count of common characters and
the count of common bigrams leave few for the sequence ratio itself. Names also meet by their sorted tokens' string in the same way, and by a Jaccard index
of tokens through prefixes of rarest tokens. What comes out is exact for any floor above 0; a lower floor only makes prefixes longer.

Rows grow with names and, at a low floor, with lengths; a combination that very many names share is one key, which Spark's adaptive join splits between tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.similarity import FLOOR, similarity_of
from tessera.plans.tables import cut, release

#: Length bands are 2 ** (1 / BANDS) wide.
BANDS = 8
#: Rarity of characters is counted in so many classes by hash, which is all that reaches the driver; it decides the order, not what is found.
CLASSES = 4096
#: Characters of a key for strings whose lengths add up to no more than this; one where they add up to more.
DEPTH = ((80, 3), (200, 2))
_SPACE = r"(?U)[\s\x1C-\x1F]+"
_SLACK = 1e-9


def _tokens(name: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_remove(F.split(name, _SPACE), "")))


def _numbered(values: Column) -> Column:
    """Distinct longs: each value with the number of its occurrence."""
    times = lambda v: F.size(F.filter(values, lambda x: x == v))
    return F.flatten(F.transform(F.array_distinct(values), lambda v: F.transform(F.sequence(F.lit(1), times(v)), lambda i: v * (1 << 20) + i)))


def _band(length: Column) -> Column:
    return F.floor(F.log2(length) * BANDS).cast("int")


def _least(band: Column) -> Column:
    """No length of the band is less."""
    return F.greatest(F.ceil(F.pow(F.lit(2.0), band / BANDS) - 1e-6), F.lit(1))


def _needed(a: Column, b: Column, floor: float) -> Column:
    return F.ceil((a + b) * (floor / 2) - _SLACK).cast("int")


def _forms(names: DataFrame) -> DataFrame:
    """(name, form): the name and its sorted tokens, where they differ."""
    return names.select("name", F.explode(F.array_distinct(F.array(F.col("name"), F.array_join(_tokens(F.col("name")), " ")))).alias("form")).where("form <> ''")


def _features(forms: DataFrame) -> DataFrame:
    """(form, id, n, chars, grams) of distinct forms; longs stand for characters and bigrams by code points."""
    codes = F.transform(F.split("form", ""), lambda c: F.ascii(c).cast("long"))
    rows = forms.select("form").distinct().withColumn("codes", codes).withColumn("n", F.size("codes"))
    grams = F.when(F.col("n") > 1, F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: F.get("codes", i - 1) * (1 << 21) + F.get("codes", i))).otherwise(F.array().cast("array<bigint>"))
    return rows.select("form", F.xxhash64("form").alias("id"), "n", _numbered(F.col("codes")).alias("chars"), _numbered(grams).alias("grams"))


def _class(x: Column) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(CLASSES)).cast("int")


def _rarity(*sides: DataFrame) -> Column:
    """An array of each class's place by frequency, rarest first."""
    seen = [s.select(F.explode("chars").alias("c")) for s in sides]
    both = seen[0].unionByName(seen[1])
    counts = {r.k: r.n for r in both.groupBy(_class(F.col("c")).alias("k")).agg(F.count("*").alias("n")).collect()}  # CLASSES rows at most
    place = {k: i for i, k in enumerate(sorted(range(CLASSES), key=lambda k: (counts.get(k, 0), k)))}
    return F.split(F.lit(" ".join(str(place[k]) for k in range(CLASSES))), " ").cast("array<int>")


def _ordered(features: DataFrame, rarity: Column) -> DataFrame:
    placed = F.array_sort(F.transform("chars", lambda c: F.struct(F.get(rarity, _class(c)).alias("place"), c.alias("c"))))
    mask = lambda part: F.aggregate("chars", F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(_bit(c, part)))
    # a row becomes hundreds of keys: rows are spread over all tasks first, however few bytes they are
    spread = features.repartition(int(features.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    return spread.withColumn("chars", F.transform(placed, lambda x: x["c"])).withColumns({"m0": mask(0), "m1": mask(1)})


def _bit(c: Column, part: int) -> Column:
    """A bit of the part's mask, or none: 128 classes over two masks."""
    k = F.pmod(F.xxhash64(c), F.lit(128)).cast("int")
    inside = F.floor(k / 64) == part
    return F.when(inside, F.call_function("shiftleft", F.lit(1).cast("long"), k % 64)).otherwise(F.lit(0).cast("long"))


def _combinations(prefix: Column, deep: Column, cell: Column) -> Column:
    rest = lambda i: F.slice(prefix, i + 2, F.size(prefix))
    one = F.transform(prefix, lambda x: F.xxhash64(cell, x))
    two = F.flatten(F.transform(prefix, lambda x, i: F.transform(rest(i), lambda y: F.xxhash64(cell, x, y))))
    # the third comes after the second: places are counted within the prefix
    three = F.flatten(F.flatten(F.transform(prefix, lambda x, i: F.transform(rest(i), lambda y, j: F.transform(F.slice(prefix, i + j + 3, F.size(prefix)), lambda z: F.xxhash64(cell, x, y, z))))))
    return F.when(deep == 1, one).when(deep == 2, two).otherwise(three)


def _keys(side: DataFrame, floor: float, left: bool) -> DataFrame:
    """(key, id, n, m0, m1)"""
    n = F.col("n")
    partners = F.sequence(_band(F.greatest(F.ceil(n * (floor / (2 - floor)) - _SLACK), F.lit(1))), _band(F.floor(n * ((2 - floor) / floor) + _SLACK)))
    rows = side.withColumn("own", _band(n)).withColumn("other", F.explode(partners))
    both = _least(F.col("own")) + _least(F.col("other"))
    deep = F.lit(1)
    for most, depth in reversed(DEPTH):
        deep = F.when(both <= most, depth).otherwise(deep)
    deep = F.least(deep, _needed(_least(F.col("own")), _least(F.col("other")), floor))
    rows = rows.withColumn("deep", deep)
    prefix = F.slice("chars", F.lit(1), F.least(n, n - _needed(n, _least(F.col("other")), floor).cast("int") + F.col("deep")))
    rows = rows.withColumn("prefix", prefix)
    cell = F.struct("own", "other") if left else F.struct(F.col("other").alias("own"), F.col("own").alias("other"))
    return rows.withColumn("cell", F.xxhash64(cell)).select(F.explode(_combinations(F.col("prefix"), F.col("deep"), F.col("cell"))).alias("key"), "id", "n", "m0", "m1")


def _by_characters(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """(left_form, right_form) that may have a ratio of floor, from features."""
    rarity = _rarity(left, right)
    l, r = _ordered(left, rarity), _ordered(right, rarity)
    a = _keys(l, floor, True).toDF("key", "l_id", "l_n", "l_m0", "l_m1")
    b = _keys(r, floor, False).toDF("key", "r_id", "r_n", "r_m0", "r_m1")
    lacks = lambda x, y: sum(F.bit_count(F.col(f"{x}_m{i}").bitwiseAND(F.bitwise_not(f"{y}_m{i}"))) for i in (0, 1))
    need = _needed(F.col("l_n"), F.col("r_n"), floor)
    met = a.join(b, "key").where((lacks("l", "r") <= F.col("l_n") - need) & (lacks("r", "l") <= F.col("r_n") - need)).select("l_id", "r_id").distinct()
    named = lambda side, p: side.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "form", "n", "chars", "grams")])
    pairs = met.join(named(left, "l"), "l_id").join(named(right, "r"), "r_id")
    common = lambda what: F.size(F.array_intersect(f"l_{what}", f"r_{what}"))
    # blocks of equal characters are parted by characters that have no partner; each block has one bigram less than characters
    return pairs.where((common("chars") >= need) & (common("grams") >= 3 * need - 1 - F.col("l_n") - F.col("r_n"))).select(F.col("l_form").alias("left_form"), F.col("r_form").alias("right_form"))


def _by_tokens(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """(left_name, right_name) whose tokens' Jaccard index is floor or more."""
    rows = lambda names: names.select("name", F.explode(_tokens(F.col("name"))).alias("token"))
    l, r = rows(left), rows(right)
    seen = l.unionByName(r).groupBy("token").agg(F.count("*").alias("seen"))

    def side(tokens: DataFrame, p: str) -> DataFrame:
        ranked = tokens.join(seen, "token").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("seen", "token"))).alias("t"))
        n = F.size("t")
        short = F.slice("t", F.lit(1), n - F.ceil(n * floor - _SLACK).cast("int") + 1)
        return ranked.select(F.col("name").alias(f"{p}_name"), F.transform("t", lambda x: x["token"]).alias(f"{p}_t"), F.explode(short).alias("key")).withColumn("key", F.col("key.token"))

    common = F.array_intersect("left_t", "right_t")
    alike = F.size(common) >= (F.size("left_t") + F.size("right_t") - F.size(common)) * floor - _SLACK
    return side(l, "left").join(side(r, "right"), "key").where(alike & (F.get(common, F.lit(0)) == F.col("key"))).select("left_name", "right_name")


def similar_names(left: DataFrame, right: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(left_name, right_name, similarity) of all pairs of distinct names, one of each side, whose similarity is floor or more; floor is above 0 and at most 1.

    left and right: a column `name`, others are left alone; names that are null or have nothing but space are like no name, repeated ones count once. The similarity
    is `tessera.functions.similarity`'s, sequence ratio (left first), Jaccard index and sorted tokens; equal names have 1. Tables of no rows give none."""
    if not 0 < floor <= 1 or math.isnan(floor):
        raise ValueError("A floor is above 0 and at most 1.")
    names = [cut(side.select(F.col("name").cast("string").alias("name")).where(F.size(_tokens(F.col("name"))) > 0).distinct()) for side in (left, right)]
    forms = [_forms(n) for n in names]
    features = [cut(_features(f)) for f in forms]
    by = lambda side, p: side.select(F.col("name").alias(f"{p}_name"), F.col("form").alias(f"{p}_form"))
    near = _by_characters(*features, floor).join(by(forms[0], "left"), "left_form").join(by(forms[1], "right"), "right_form").select("left_name", "right_name")
    pairs = near.unionByName(_by_tokens(*names, floor)).distinct()
    found = cut(pairs.withColumn("similarity", similarity_of(F.col("left_name"), F.col("right_name"))).where(F.col("similarity") >= floor))
    release(*names, *features)
    return found
