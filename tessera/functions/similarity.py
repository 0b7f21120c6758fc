"""Name similarity: the best of the sequence ratio, the tokens' Jaccard index and the sorted tokens' ratio.

The ratio is Ratcliff and Obershelp's, which has no built-in form and depends on the order of its arguments, so one
Arrow function computes it, on distinct pairs of different names only. Equal names are 1 without it. Pairs whose lengths
and tokens rule out FLOOR are 0: below it no decision looks at the value.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: The least similarity that any decision uses.
FLOOR = 0.75


def similarity(left: str | None, right: str | None) -> float:
    if not left or not right or left == right:
        return float(bool(left) and left == right)
    a, b = set(left.split()), set(right.split())
    shared = len(a & b) / len(a | b) if a | b else 0.0
    ordered = SequenceMatcher(None, " ".join(sorted(a)), " ".join(sorted(b))).ratio()
    return max(SequenceMatcher(None, left, right).ratio(), shared, ordered)


def token_jaccard(left: Column, right: Column) -> Column:
    a, b = F.array_distinct(F.split(left, " ")), F.array_distinct(F.split(right, " "))
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)), F.lit(0.0))


def may_reach(left: Column, right: Column, floor: float = FLOOR) -> Column:
    """Whether lengths let a ratio reach the floor: matches are no longer than the shorter, here or among distinct sorted tokens."""
    def bound(a, b):
        return 2 * F.least(F.length(a), F.length(b)) >= floor * (F.length(a) + F.length(b))

    ordered = lambda c: F.array_join(F.array_distinct(F.split(c, " ")), " ")
    return bound(left, right) | bound(ordered(left), ordered(right)) | (token_jaccard(left, right) >= floor)


@F.pandas_udf(DoubleType())
def similarity_of(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([similarity(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


def with_similarity(pairs: DataFrame, left: str, right: str, name: str = "similarity") -> DataFrame:
    """pairs with a similarity; it is computed once for each distinct pair of different names that may reach FLOOR."""
    a, b = F.col(left), F.col(right)
    differ = pairs.where((a != b) & may_reach(a, b)).select(a.alias("_a"), b.alias("_b")).distinct()
    values = differ.select("_a", "_b", similarity_of("_a", "_b").alias("_s"))
    joined = pairs.join(values, (a == F.col("_a")) & (b == F.col("_b")), "left")
    return joined.withColumn(name, F.when(a == b, 1.0).otherwise(F.coalesce("_s", F.lit(0.0)))).drop("_a", "_b", "_s")
