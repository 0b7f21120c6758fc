"""Joins by date: the last row at or before a day, and periods that hold on it, over tables of any size.

Both go by what happened up to a day. Days are points of a key's timeline, each asked for once however many rows ask; what happens on a day is one row per key and day.
Both are put in order in chunks of CHUNK days, and each chunk gets from those before it what they leave, a row per key and chunk. So a key or a day that
a third of all rows have is a few rows of few chunks, no task sorts more than a chunk, and nothing is compared in pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.temporal import ENDED, scope

#: Days of a chunk.
CHUNK = 64


def _timeline(points: DataFrame, events: DataFrame, keys: list[str], carried, running, before) -> DataFrame:
    """(keys, day, value) of points (keys, day). events: (keys, day, x), one for each. carried: an aggregate of x over a chunk; running and before: what a window of rows
    says of x and of earlier chunks' carried ones."""
    chunk = F.floor(F.unix_date("day") / CHUNK).alias("chunk")
    asked = points.select(*keys, "day", chunk, F.lit(None).cast(events.schema["x"].dataType).alias("x"), F.lit(1).alias("asked"))
    told = events.select(*keys, "day", chunk, "x", F.lit(0).alias("asked"))
    within = Window.partitionBy(*keys, "chunk").orderBy("day", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = asked.unionByName(told).withColumn("own", running(within)).where("asked = 1").select(*keys, "day", "chunk", "own")
    left = told.groupBy(*keys, "chunk").agg(carried.alias("c"))
    # a chunk's row of what it leaves comes after the row that asks for what was left before it
    wanted = points.select(*keys, chunk).distinct().select(*keys, "chunk", F.lit(None).cast(left.schema["c"].dataType).alias("c"), F.lit(0).alias("told"))
    over = Window.partitionBy(*keys).orderBy("chunk", "told").rowsBetween(Window.unboundedPreceding, -1)
    earlier = wanted.unionByName(left.withColumn("told", F.lit(1))).withColumn("c", before(over)).where("told = 0").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("chunk").alias("_chunk"), "c")
    same = F.col("chunk") == F.col("_chunk")
    for k in keys:
        same &= F.col(k) == F.col(f"_{k}")
    return inside.join(earlier, same, "left").select(*keys, "day", "own", "c")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], day: str, since: str, values: list[str]) -> DataFrame:
    """left with `values` of right's row of the same keys with the latest `since` at or before left's `day`; of several with that `since`, the one of largest values.
    Nulls where there is none. A null key or day finds nothing; rows of right without a key or `since` are not found. left's rows stay as many as they are."""
    own = [f"_k{i}" for i in range(len(keys))]
    named = lambda df, d, *more: df.select(*[F.col(k).alias(n) for k, n in zip(keys, own, strict=True)], F.col(d).cast("date").alias("day"), *more).dropna(subset=[*own, "day"])
    events = named(right, since, F.struct(F.col(since).alias("at"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)]).alias("x")).groupBy(*own, "day").agg(F.max("x").alias("x"))
    points = named(left, day).distinct()
    line = _timeline(points, events, own, F.max("x"), lambda w: F.last("x", True).over(w), lambda w: F.last("c", True).over(w))
    found = line.select(*[F.col(n).alias(f"{n}_") for n in own], F.col("day").alias("_day"), F.coalesce("own", "c").alias("_x"))
    same = F.col(day).cast("date") == F.col("_day")
    for k, n in zip(keys, own, strict=True):
        same &= F.col(k) == F.col(f"{n}_")
    rest = [c for c in left.columns if c not in values]
    return left.join(found, same, "left").select(*rest, *[F.col(f"_x.v{i}").alias(v) for i, v in enumerate(values)])


def held(left: DataFrame, periods: DataFrame, keys: list[str], day: str, start: str = "valid_from", end: str = "valid_to", status: str = "status") -> DataFrame:
    """left with (dated, undated, holding): how many of its keys' periods have a date that counts, have none, and hold on its day (null without one).
    periods: one row each; closed intervals, open where a bound is null. One that has ended without an end date has no date that counts."""
    own = [f"_k{i}" for i in range(len(keys))]
    counts = (F.col(start).isNotNull() | F.col(end).isNotNull()) & ~(F.upper(F.coalesce(status, F.lit(""))).isin(*ENDED) & F.col(end).isNull())
    p = periods.select(*[F.col(k).alias(n) for k, n in zip(keys, own, strict=True)], F.col(start).alias("s"), F.col(end).alias("e"), counts.alias("counts")).dropna(subset=own)
    sums = p.groupBy(*own).agg(F.count_if("counts").alias("dated"), F.count_if(~F.col("counts")).alias("undated"), F.count_if(F.col("counts") & F.col("s").isNull()).alias("open"))
    # a period that ends before it starts never holds
    p = p.where(F.col("counts") & (F.col("s").isNull() | F.col("e").isNull() | (F.col("s") <= F.col("e"))))
    turns = p.select(*own, F.explode(F.array(F.struct(F.col("s").alias("day"), F.lit(1).alias("n")), F.struct(F.date_add("e", 1).alias("day"), F.lit(-1).alias("n")))).alias("t")).select(*own, "t.*").dropna(subset=["day"])
    events = turns.groupBy(*own, "day").agg(F.sum("n").alias("x"))
    points = left.select(*[F.col(k).alias(n) for k, n in zip(keys, own, strict=True)], F.col(day).cast("date").alias("day")).dropna().distinct()
    line = _timeline(points, events, own, F.sum("x"), lambda w: F.sum("x").over(w), lambda w: F.sum("c").over(w))
    line = line.select(*[F.col(n).alias(f"{n}_") for n in own], F.col("day").alias("_day"), (F.coalesce("own", F.lit(0)) + F.coalesce("c", F.lit(0))).alias("_n"))
    sums = sums.select(*[F.col(n).alias(f"{n}__") for n in own], "dated", "undated", "open")
    by = lambda suffix: [F.col(k) == F.col(f"{n}{suffix}") for k, n in zip(keys, own, strict=True)]
    out = left.join(sums, by("__"), "left").join(line, [*by("_"), F.col(day).cast("date") == F.col("_day")], "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(*left.columns, count("dated").alias("dated"), count("undated").alias("undated"), F.when(F.col(day).isNotNull(), count("open") + count("_n")).alias("holding"))


def status_of(day: Column, dated: Column, undated: Column, holding: Column, every: bool = False) -> Column:
    """struct(status, valid) of what `held` counts. every: all periods must hold, else one is enough."""
    false, true = dated > holding, holding > 0
    status = F.when(day.isNull(), "not_requested").when(dated + undated == 0, "not_verified")
    if every:
        status = status.when(false, "invalid").when(true & (undated == 0), "verified").when(true, "partial").otherwise("not_verified")
    else:
        status = status.when(true, "verified").when(false & (undated == 0), "invalid").when(false, "partial").otherwise("not_verified")
    return scope(status)
