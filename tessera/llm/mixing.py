"""Mixing sources to target weights by Pareto order sampling.

Words are shared among sources by weight (WEIGHTS in turn over the sources by code point, null last), SHARE
times all words in total; no source gets more than MOST times its size, and the excess is shared again by
weight until none does. Of each source every document gets target / size whole copies for certain; the rest of the words
is a sample with unequal probabilities: a document's inclusion probability is proportional to its size, min(1, size / t), with t
such that the words to be expected are the rest. Documents of t words or more are certain. Documents are ranked by
q = (u / (1 - u)) / (p / (1 - p)), their random odds over their inclusion odds, u uniform in (0, 1) by a hash of seed, doc_id
and text, and taken in that order until the rest is reached. The size of the sample is fixed in words: of the document on
the border the mix takes what is still missing, its first words, so a source's words meet its target but for rounding.

No source is sorted in one task: words are first summed by source and by BINS bins of q / (1 + q), certain documents apart;
only the bin that holds the border is put in order. t comes from the documents counted by source and size, as many rows as
there are different sizes. Sources are joined by their own rows, broadcast if counted small.

Null texts and texts without words have size 0 and nothing is taken. Null sources are one source. Rows of equal doc_id and
text have one u and follow one another. An empty table gives no rows. Same rows and seed, same mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, small, table

WEIGHTS, SHARE, MOST, SEED = (3.0, 1.0, 2.0), 1.5, 2, "mix-1"
#: Bins of the order; the border bin of a source holds about 1 in so many of its documents.
BINS = 1 << 16
#: Bins that are first looked at together, so that no task orders more than BINS / STEP or STEP sums of a source.
STEP = 1 << 8
_SPACE = 16**13


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source, so one task orders them."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    s = s.withColumn("most", (F.col("source_size") * most).cast("double"))
    # with the sources in order of most / weight, the level is what is left per weight after the first few are full
    before = Window.orderBy(F.col("most") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumns({
        "left": F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    s = s.withColumn("level", F.min(F.when(F.col("left") / F.col("open") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("place"), (F.col("left") / F.col("open")).alias("level")))).over(everything)["level"])
    return s.select("source", "source_size", F.when(F.col("level").isNull() | (F.col("level") * F.col("weight") > F.col("most")), F.col("most")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def _levels(d: DataFrame, by: DataFrame) -> DataFrame:
    """by (s, rest, ..) with rate, 1 / t of each source: a document of size n has the inclusion probability min(1, rate * n)."""
    sizes = d.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    number = lambda e: F.expr(e).cast("decimal(38,0)")
    sizes = sizes.join(small(by.select("s", "rest").where("rest > 0")), sizes.source.eqNullSafe(F.col("s"))).drop("s")
    smaller = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    larger = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    # if all sizes above this one are certain, the others' rate is what is left over the sum of their squares; the first that is no more than certain itself fits
    left = F.col("rest").cast("decimal(38,0)") - F.coalesce(F.sum(number("size * n")).over(larger), F.lit(0).cast("decimal(38,0)"))
    sizes = sizes.withColumn("rate", left.cast("double") / F.sum(number("cast(size as decimal(19,0)) * cast(size * n as decimal(19,0))")).over(smaller).cast("double"))
    fits = sizes.where(F.col("rate") * F.col("size") <= 1).groupBy(F.col("source").alias("r_source")).agg(F.max_by("rate", "size").alias("rate"))
    return by.join(fits, by.s.eqNullSafe(F.col("r_source")), "left").drop("r_source")


def _border(rows: DataFrame, bins: str, before) -> DataFrame:
    """(b_source, b_<bins>, b_before): the first bin by which a source's rest is reached, and the words before it. before: what earlier bins hold."""
    words = rows.groupBy("source", bins).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), before.alias("start"))
    words = words.withColumn("b_before", F.sum("words").over(Window.partitionBy("source").orderBy(bins)) - F.col("words") + F.col("start"))
    reached = words.where((F.col(bins) >= 0) & (F.col("b_before") < F.col("rest")) & (F.col("b_before") + F.col("words") >= F.col("rest")))
    first = reached.groupBy(F.col("source").alias("b_source")).agg(F.min(F.struct(bins, "b_before")).alias("b"))
    return cut(first.select("b_source", F.col(f"b.{bins}").alias(f"b_{bins}"), "b.b_before"))


def mix(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, inclusion, taken), one row per row of docs. inclusion: the probability of one copy beyond the certain ones."""
    said = F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    u = (F.conv(F.substring(F.md5(said.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(_SPACE)
    d = cut(docs.select(
        F.col(doc).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"), u.alias("u"),
    ))
    by = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    by = by.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    by = cut(by.withColumn("rest", F.round("target").cast("long") - F.col("copies") * F.col("source_size")).withColumnRenamed("source", "s"))
    by = cut(_levels(d, by))

    def ranked_by(params):
        rows = d.join(small(params), d.source.eqNullSafe(params.s)).drop("s").withColumn("p", F.least(F.lit(1.0), F.coalesce(F.col("rate") * F.col("size"), F.lit(0.0))))
        q = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p"))
        rows = rows.withColumn("q", F.when(F.col("p") > 0, q))
        return rows.withColumn("bin", F.when(F.col("p") == 1, F.lit(-STEP)).when(F.col("p") > 0, F.floor(F.col("q") / (1 + F.col("q")) * BINS)).otherwise(F.lit(BINS)))

    ranked = ranked_by(by)
    coarse = _border(ranked.withColumn("wide", F.floor(F.col("bin") / STEP)), "wide", F.lit(0)).withColumnRenamed("b_before", "before")
    inside = ranked.join(small(coarse), ranked.source.eqNullSafe(coarse.b_source)).where(F.floor(F.col("bin") / STEP) == F.col("b_wide")).drop("b_source", "b_wide")
    border = _border(inside, "bin", F.first("before")).withColumnRenamed("b_before", "before")

    both = by.join(border, by.s.eqNullSafe(border.b_source), "left").drop("b_source")
    ranked = ranked_by(cut(both))
    inner = Window.partitionBy("source").orderBy("q", "doc_id", "size")
    at = ranked.where(F.col("bin") == F.col("b_bin")).withColumn("n", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, -1)))
    at = at.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.coalesce("n", F.lit(0))))).drop("n")
    off = ranked.where(~F.coalesce(F.col("bin") == F.col("b_bin"), F.lit(False))).withColumn("extra", F.when((F.col("p") == 1) | (F.col("bin") < F.col("b_bin")), F.col("size")).otherwise(F.lit(0)))
    out = at.unionByName(off)
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("p").alias("inclusion"), (F.col("copies") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source", "inclusion")


def sql(docs: str = "documents") -> str:
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT)::DOUBLE + 0.5) / {_SPACE}.0::DOUBLE AS u FROM {docs}),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
s1 AS (SELECT *, ([{", ".join(f"{w}::DOUBLE" for w in WEIGHTS)}])[place % {len(WEIGHTS)} + 1] AS weight, (source_size * {MOST})::DOUBLE AS most FROM s0),
s2 AS (SELECT *, sum(source_size) OVER ()::DOUBLE * {SHARE}::DOUBLE - coalesce(sum(most) OVER w, 0) AS lft, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS opn FROM s1
       WINDOW w AS (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(lft / opn, (most / weight, place)) AS level FROM s2 WHERE lft / opn * weight <= most),
s3 AS (SELECT source, source_size, CASE WHEN level IS NULL OR level * weight > most THEN most ELSE level * weight END AS target FROM s2, l),
s4 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM s3),
s5 AS (SELECT *, floor(target + 0.5)::BIGINT - copies * source_size AS rest FROM s4),
z AS (SELECT source, size, count(*)::HUGEINT AS n FROM d WHERE size > 0 GROUP BY source, size),
z1 AS (SELECT z.source, size, (rest - coalesce(sum(size * n) OVER (PARTITION BY z.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(size::HUGEINT * size * n) OVER (PARTITION BY z.source ORDER BY size ROWS UNBOUNDED PRECEDING))::DOUBLE AS rate FROM z JOIN s5 ON z.source IS NOT DISTINCT FROM s5.source WHERE rest > 0),
z2 AS (SELECT source, arg_max(rate, size) AS rate FROM z1 WHERE rate * size <= 1 GROUP BY source),
s6 AS (SELECT s5.*, rate FROM s5 LEFT JOIN z2 ON s5.source IS NOT DISTINCT FROM z2.source),
r0 AS (SELECT d.*, source_size, target, copies, rest, least(1.0::DOUBLE, coalesce(rate * size, 0)) AS p FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
r AS (SELECT *, CASE WHEN p = 0 THEN 'inf'::DOUBLE ELSE (u / (1 - u)) * ((1 - p) / p) END AS q FROM r0)
SELECT doc_id, size, source_size, target,
  copies * size + greatest(0, least(size, rest - coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS taken FROM r
"""


SQL = sql()
