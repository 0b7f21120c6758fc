"""Security masters: rows of any columns to entities with their names, periods, listing and parent; checks of the whole master."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import normalize as N
from tessera.functions.temporal import PERIODS
from tessera.operators.blocking import IDENTIFIERS

_JSON = "array<struct<" + ",".join(f"{n}:string" for n in ("periodType", "period_type", "relationshipType", "type", "validFrom", "valid_from", "startDate", "validTo", "valid_to", "endDate", "status", "provider")) + ">>"

#: What a master's columns let its provider claim.
_CAPABILITIES = {
    "security_lookup": {"ticker", "figi", "isin", "cusip"}, "lei": {"lei"}, "current_relationships": {"parent_entity_id", "parent_name"},
    "entity_effective_dates": {"valid_from", "valid_to", "entity_valid_from", "entity_valid_to", "entity_periods"},
    "security_effective_dates": {"security_valid_from", "security_valid_to", "listing_valid_from", "listing_valid_to", "security_periods"},
    "relationship_effective_dates": {"relationship_valid_from", "relationship_valid_to", "relationship_periods"}, "share_class_data": {"share_class"},
}


#: Columns that a master may have.
COLUMNS = (
    "internal_entity_id", "internal_security_id", "canonical_name", "entity_type", *IDENTIFIERS, "domain", "country", "address_line1", "address", "city", "state", "region", "postal_code", "aliases", "share_class", "valid_from", "valid_to", "entity_valid_from",
    "entity_valid_to", "entity_status", "entity_periods", "security_valid_from", "security_valid_to", "listing_valid_from", "listing_valid_to", "security_status", "listing_status", "security_periods", "parent_entity_id", "parent_name", "parent_entity_type",
    "relationship_type", "relationship_valid_from", "relationship_valid_to", "relationship_status", "relationship_periods",
)


def capabilities(columns: list[str]) -> set[str]:
    return {"entity_lookup"} | {name for name, needed in _CAPABILITIES.items() if needed & set(columns)}


def periods_of(text: Column, provider: str) -> Column:
    """Periods from JSON, an array or one object, in any of the usual spellings; null if there are none."""
    value = F.from_json(F.when(F.trim(text).startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text), _JSON)
    made = F.transform(
        value,
        lambda p: F.struct(
            F.coalesce(p["periodType"], p["period_type"], p["relationshipType"], p["type"]).alias("period_type"), N.parse_date(F.coalesce(p["validFrom"], p["valid_from"], p["startDate"])).alias("valid_from"),
            N.parse_date(F.coalesce(p["validTo"], p["valid_to"], p["endDate"])).alias("valid_to"), p["status"].alias("status"), F.coalesce(p["provider"], F.lit(provider)).alias("provider"),
        ),
    )
    return F.when(F.size(made) > 0, made).cast(PERIODS)


def one_period(kind: Column, start: Column, end: Column, status: Column, provider: str, when: Column) -> Column:
    made = F.array(F.struct(kind.alias("period_type"), start.alias("valid_from"), end.alias("valid_to"), status.alias("status"), F.lit(provider).alias("provider")))
    return F.when(when, made).otherwise(F.array()).cast(PERIODS)


#: What a listing says of itself, by the column that it stands for; other names of it.
_LISTING = {"internal_security_id": ("internal_security_id", "securityId"), **{f: (f,) for f in ("figi", "isin", "cusip", "ticker", "exchange", "share_class")}}


def listed_rows(rows: DataFrame, order: str = "ord") -> DataFrame:
    """A row for each of an entity's ``listings`` (an array of objects, or its JSON), whose values count before the row's own; rows without any stay. Orders keep
    their order: each becomes 2 ** 20 times itself, and the place of the listing."""
    kind = f"array<struct<{','.join(f'{n}:string' for names in _LISTING.values() for n in names)}>>"
    given = F.col("listings") if rows.schema["listings"].dataType.simpleString() == "string" else F.to_json("listings")
    rows = rows.withColumn("listings", F.from_json(given, kind)).select("*", F.posexplode_outer("listings").alias("_place", "_listing")).drop("listings")
    rows = rows.withColumn(order, F.col(order).cast("bigint") * (1 << 20) + F.coalesce("_place", F.lit(0)))
    own = {c: F.coalesce(*[F.col(f"_listing.{n}") for n in names], F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")) for c, names in _LISTING.items()}
    return rows.withColumns(own).drop("_place", "_listing")


def load(rows: DataFrame, provider: str = "master", order: str = "ord") -> DataFrame:
    """Entities, one per row of the master, or per listing of its rows, in the schema that resolution works with. order: a column with the load order."""
    rows = listed_rows(rows, order) if "listings" in rows.columns else rows
    have = set(rows.columns)
    # text first, so that what is made of a column does not repeat how it was read
    rows = rows.select(F.col(order).cast("bigint").alias("_ord"), *(F.when(F.col(n).cast("string") != "", F.col(n).cast("string")).alias(n) for n in COLUMNS if n in have))

    def text(*names: str) -> Column:
        found = [F.col(n) for n in names if n in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    number = F.col("_ord")
    own_id = F.coalesce(text("internal_entity_id"), F.concat(F.lit(f"{provider}:"), number.cast("string")))
    aliases = F.filter(F.transform(F.split(F.coalesce(text("aliases"), F.lit("")), r"\|"), lambda a: F.trim(a)), lambda a: a != "")
    e_from, e_to, e_status = N.parse_date(text("entity_valid_from", "valid_from")), N.parse_date(text("entity_valid_to", "valid_to")), text("entity_status")
    s_from, s_to, s_status = N.parse_date(text("security_valid_from", "listing_valid_from")), N.parse_date(text("security_valid_to", "listing_valid_to")), text("security_status", "listing_status")
    r_from, r_to, r_status = N.parse_date(text("relationship_valid_from")), N.parse_date(text("relationship_valid_to")), text("relationship_status")
    any_of = lambda *cs: F.coalesce(*[c.cast("string") for c in cs]).isNotNull()
    kind = F.coalesce(text("relationship_type"), F.lit("subsidiary_of"))
    listed = any_of(*[text(c) for c in ("internal_security_id", "ticker", "exchange", "figi", "isin", "cusip", "share_class")])
    out = rows.select(
        number.alias("ord"), F.lit(provider).alias("provider"), own_id.alias("entity_id"), F.coalesce(text("canonical_name"), F.lit("")).alias("canonical_name"), F.coalesce(text("entity_type"), F.lit("issuer")).alias("entity_type"),
        N.normalize_domain(text("domain")).alias("domain"), N.normalize_country(text("country")).alias("country"), N.normalize_address(text("address_line1", "address")).alias("address"),
        N.normalize_locality(text("city")).alias("city"), N.normalize_subdivision(text("state", "region")).alias("state"), N.normalize_postal_code(text("postal_code")).alias("postal"),
        *(N.normalize_identifier(text(f), f).alias(f) for f in IDENTIFIERS), aliases.alias("aliases"),
        F.array_distinct(F.array_compact(F.concat(F.array(N.normalize_name(text("canonical_name"))), F.transform(aliases, N.normalize_name)))).alias("names"),
        F.coalesce(periods_of(text("entity_periods"), provider), one_period(F.lit("entity_existence"), e_from, e_to, e_status, provider, any_of(e_from, e_to, e_status))).alias("entity_periods"),
        listed.alias("listed"), text("internal_security_id").alias("internal_security_id"), text("share_class").alias("share_class"),
        F.coalesce(periods_of(text("security_periods"), provider), one_period(F.lit("security_listing"), s_from, s_to, s_status, provider, listed & any_of(s_from, s_to, s_status))).alias("security_periods"),
        text("parent_entity_id").alias("parent_id"), text("parent_name").alias("parent_name"), F.coalesce(text("parent_entity_type"), F.lit("legal_entity")).alias("parent_type"), kind.alias("relationship_type"), r_from.alias("relationship_from"),
        r_to.alias("relationship_to"), F.coalesce(r_status, F.lit("ACTIVE")).alias("relationship_status"),
        F.coalesce(periods_of(text("relationship_periods"), provider), one_period(kind, r_from, r_to, F.coalesce(r_status, F.lit("ACTIVE")), provider, any_of(r_from, r_to, r_status))).alias("relationship_periods"),
    )
    return out


def security_id(entity_id: Column, provider: Column) -> Column:
    """The listing's own id, or its FIGI, or a digest of entity and identifiers."""
    print_ = F.concat_ws("|", entity_id, *[F.coalesce(F.col(f), F.lit("")) for f in ("figi", "isin", "cusip", "ticker", "exchange")])
    return F.coalesce("internal_security_id", "figi", F.concat(provider, F.lit(":security:"), F.substring(F.sha2(print_, 256), 1, 16)))


def securities(master: DataFrame) -> DataFrame:
    """Listings as instruments of their own: (ord, provider, security_id, issuer_id, security_name, identifiers..)."""
    name = F.concat("canonical_name", F.lit(" "), F.coalesce("ticker", F.lit("security")))
    return master.where("listed").select("ord", "provider", security_id(F.col("entity_id"), F.col("provider")).alias("security_id"), F.col("entity_id").alias("issuer_id"), name.alias("security_name"), "figi", "isin", "cusip", "ticker", "exchange", "share_class", "security_periods")


def edges(master: DataFrame) -> DataFrame:
    """Parents that the master names, the last row of each entity, with the parent's name and type from the master where it is there."""
    last = lambda c: Window.partitionBy(c).orderBy(F.desc("ord"))
    one = master.withColumn("_n", F.row_number().over(last("entity_id"))).where("_n = 1")
    known = one.select(F.col("entity_id").alias("k_id"), F.col("canonical_name").alias("k_name"), F.col("entity_type").alias("k_type"))
    e = one.where("parent_id is not null or parent_name is not null")
    to = F.coalesce("parent_id", F.concat("provider", F.lit(":name:"), F.coalesce(N.normalize_name(F.col("parent_name")), F.lit("unknown"))))
    e = e.withColumn("to_id", to).join(known, F.col("to_id") == F.col("k_id"), "left")
    return e.select(
        "provider", F.col("entity_id").alias("from_id"), "to_id", F.coalesce("k_name", "parent_name", "to_id").alias("to_name"), F.coalesce("k_type", "parent_type").alias("to_type"), F.col("relationship_type").alias("type"),
        F.when(F.contains(F.upper("relationship_type"), F.lit("ULTIMATE")), "ultimate").otherwise("direct").alias("level"), F.col("relationship_status").alias("status"), F.col("relationship_from").alias("valid_from"),
        F.col("relationship_to").alias("valid_to"), F.col("relationship_periods").alias("periods"), F.lit(None).cast("string").alias("trust"), F.lit(False).alias("open_holds"), F.lit(None).cast("string").alias("relationship_id"),
    )


def issues(master: DataFrame) -> DataFrame:
    """(code, subject, n) of what makes a master unusable: names that are missing, one id with different data, repeated listings,
    repeated rows without a listing, identifiers that several rows share, periods that end before they start."""
    key = F.coalesce("internal_security_id", "figi", "isin", "cusip", F.concat_ws("|", "entity_id", F.coalesce("ticker", F.lit("")), F.coalesce("exchange", F.lit(""))))

    def report(code: str, df: DataFrame, subject: str, n) -> DataFrame:
        return df.select(F.lit(code).alias("code"), F.col(subject).alias("subject"), n.cast("long").alias("n"))

    signature = F.struct(N.normalize_name(F.col("canonical_name")), "entity_type", "cik", "lei")
    out = report("missing_name", master.where("canonical_name = ''"), "entity_id", F.lit(1))
    by_id = master.groupBy("entity_id").agg(F.count_distinct(F.to_json(signature)).alias("n"), F.count_if(~F.col("listed")).alias("alone"))
    out = out.unionByName(report("conflicting_entity", by_id.where("n > 1"), "entity_id", F.col("n"))).unionByName(report("duplicate_entity_row", by_id.where("alone > 1"), "entity_id", F.col("alone")))
    keys = master.where("listed").groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    out = out.unionByName(report("duplicate_security", keys, "key", F.col("n")))
    for f in ("figi", "isin", "cusip"):
        shared = master.where(F.col(f).isNotNull()).groupBy(f).agg(F.count("*").alias("n")).where("n > 1")
        out = out.unionByName(report(f"duplicate_{f}", shared, f, F.col("n")))
    shared = master.where("lei is not null").groupBy("lei").agg(F.count_distinct("entity_id").alias("n")).where("n > 1")
    out = out.unionByName(report("duplicate_lei", shared, "lei", F.col("n")))
    for c in ("entity_periods", "security_periods", "relationship_periods"):
        bad = master.where(F.exists(c, lambda p: p["valid_from"] > p["valid_to"]))
        out = out.unionByName(report(f"invalid_{c}", bad, "entity_id", F.lit(1)))
    return out
