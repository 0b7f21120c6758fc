"""Closed date intervals with open ends, in three-valued logic: true, false, or null for not known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIOD = "struct<period_type:string,valid_from:date,valid_to:date,status:string,provider:string>"
PERIODS = f"array<{PERIOD}>"
# States that end a period without saying when.
ENDED = ("INACTIVE", "ANNULLED", "RETIRED", "DELISTED")


def within(day: Column, start: Column, end: Column) -> Column:
    """Closed, open where a bound is null; null without a day."""
    return (start.isNull() | (day >= start)) & (end.isNull() | (day <= end))


def valid_on_date(day: Column, start: Column, end: Column) -> Column:
    """Null without a day or without any bound."""
    return F.when(day.isNotNull() & (start.isNotNull() | end.isNotNull()), within(day, start, end))


def applies(day: Column, start: Column, end: Column) -> Column:
    """Whether a rule holds: undated rules always do, dated ones never for undated records."""
    return F.when(day.isNull(), start.isNull() & end.isNull()).otherwise(within(day, start, end))


def overlap(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Of closed intervals; a null bound is infinite."""
    low, high = F.to_date(F.lit("0001-01-01")), F.to_date(F.lit("9999-12-31"))
    return F.greatest(F.coalesce(a_from, low), F.coalesce(b_from, low)) <= F.least(F.coalesce(a_to, high), F.coalesce(b_to, high))


def period_valid(p: Column, day: Column) -> Column:
    ended = F.upper(F.coalesce(p["status"], F.lit(""))).isin(*ENDED) & p["valid_to"].isNull()
    return F.when(~ended, valid_on_date(day, p["valid_from"], p["valid_to"]))


def evaluate_periods(periods: Column, day: Column, every: bool = False) -> Column:
    """struct(status, valid). every: all periods must hold, else one is enough."""
    none = F.coalesce(F.size(periods), F.lit(0)) <= 0
    values = F.transform(periods, lambda p: period_valid(p, day))
    some_true, some_false = F.exists(values, lambda v: v.eqNullSafe(F.lit(True))), F.exists(values, lambda v: v.eqNullSafe(F.lit(False)))
    undated = F.exists(values, lambda v: v.isNull())
    status = F.when(day.isNull(), "not_requested").when(none, "not_verified")
    if every:
        status = status.when(some_false, "invalid").when(some_true & ~undated, "verified").when(some_true, "partial").otherwise("not_verified")
    else:
        status = status.when(some_true, "verified").when(some_false & ~undated, "invalid").when(some_false, "partial").otherwise("not_verified")
    return scope(status)


def told(periods: Column) -> Column:
    """struct(known, valid_from, valid_to, several): what status_on needs of periods that are asked for many days. known: one period, with dates and not ended without one; several: the periods, where there is more than one."""
    one, ended = F.get(periods, F.lit(0)), lambda p: F.upper(F.coalesce(p["status"], F.lit(""))).isin(*ENDED) & p["valid_to"].isNull()
    known = (F.size(periods) == 1) & ~ended(one) & (one["valid_from"].isNotNull() | one["valid_to"].isNotNull())
    return F.struct(F.coalesce(known, F.lit(False)).alias("known"), one["valid_from"].alias("valid_from"), one["valid_to"].alias("valid_to"), F.when(F.size(periods) > 1, periods).alias("several"))


def status_on(told: Column, day: Column) -> Column:
    """The status that evaluate_periods gives on a day, from what told says of the periods."""
    held = within(day, told["valid_from"], told["valid_to"])
    return F.when(day.isNull(), "not_requested").when(told["known"], F.when(held, "verified").otherwise("invalid")).when(told["several"].isNull(), "not_verified").otherwise(evaluate_periods(told["several"], day)["status"])


def scope(status: Column) -> Column:
    return F.struct(status.alias("status"), F.when(status == "verified", True).when(status == "invalid", False).alias("valid"))


def not_applicable() -> Column:
    return scope(F.lit("not_applicable"))


def all_edges(statuses: Column, day: Column) -> Column:
    """A chain of edges from each edge's status: every one must hold. Null or no edges: not applicable."""
    none = F.coalesce(F.size(statuses), F.lit(0)) <= 0
    has = lambda *s: F.exists(statuses, lambda x: x.isin(*s))
    return scope(
        F.when(day.isNull(), "not_requested").when(none, "not_applicable").when(has("invalid"), "invalid")
        .when(F.forall(statuses, lambda x: x == "verified"), "verified").when(has("verified"), "partial").otherwise("not_verified")
    )


def combine(day: Column, entity: Column, *others: Column) -> Column:
    """Overall scope: the entity's, and others that apply."""
    used = [(F.lit(True), entity["valid"]), *((o["status"] != "not_applicable", o["valid"]) for o in others)]
    false = reduce(Column.__or__, (u & v.eqNullSafe(F.lit(False)) for u, v in used))
    true = reduce(Column.__or__, (u & v.eqNullSafe(F.lit(True)) for u, v in used))
    every = reduce(Column.__and__, (~u | v.eqNullSafe(F.lit(True)) for u, v in used))
    return scope(F.when(day.isNull(), "not_requested").when(false, "invalid").when(every, "verified").when(true, "partial").otherwise("not_verified"))


def policy_action(status: Column, require_verified: bool = False, unknown: str = "allow_with_warning") -> Column:
    """allow, allow_with_warning, review or reject. Contradicted dates are always reviewed."""
    if unknown not in ("allow_with_warning", "review", "reject"):
        raise ValueError(f"unknown behaviour {unknown!r}")
    doubtful = "reject" if unknown == "reject" else "review" if require_verified or unknown == "review" else "allow_with_warning"
    return F.when(status == "invalid", "review").when(status.isin("not_requested", "not_verified", "partial"), doubtful).otherwise("allow")
