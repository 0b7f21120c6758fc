"""Snapshots of remote providers' answers, (provider, query_type, cache_key, value, fetched_at), and what is read from them.

Remote services are not called from a plan: their answers, JSON text, are tables like any other. Each reader makes rows in a master's
columns, which master.load normalises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.temporal import PERIODS
from tessera.functions import normalize as N


def latest(snapshot: DataFrame, now: Column | None = None, ttl_seconds: int | None = None) -> DataFrame:
    """The newest answer to each request; with now and ttl_seconds, only if it is no older."""
    w = Window.partitionBy("provider", "query_type", "cache_key").orderBy(F.desc("fetched_at"), F.desc(F.xxhash64(*[c for c in snapshot.columns if c != "fetched_at"])))  # of answers of one time, the same one in every run
    out = snapshot.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    if ttl_seconds is not None:
        out = out.where(F.unix_timestamp(F.current_timestamp() if now is None else now) - F.unix_timestamp("fetched_at") <= ttl_seconds)
    return out


def put(snapshot: DataFrame, answers: DataFrame) -> DataFrame:
    """snapshot with newer answers in place of older ones."""
    return latest(snapshot.unionByName(answers))


def clear(snapshot: DataFrame, provider: str | None = None) -> DataFrame:
    return snapshot.where(F.col("provider") != provider) if provider else snapshot.where("false")


def stats(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("provider").agg(F.count("*").alias("entries"), F.min("fetched_at").alias("oldest"), F.max("fetched_at").alias("newest"))


_NAME = "struct<name:string>"
_ENTITY = f"struct<legalName:{_NAME},otherNames:array<{_NAME}>,legalAddress:struct<addressLines:array<string>,city:string,region:string,country:string,postalCode:string>,status:string,creationDate:string,expirationDate:string,expiration:struct<date:string>>"
_LEI = f"array<struct<id:string,attributes:struct<lei:string,entity:{_ENTITY}>>>"


def _data(value: Column) -> Column:
    """The list under ``data``, also where a single object is there."""
    data = F.get_json_object(value, "$.data")
    return F.when(data.startswith("{"), F.concat(F.lit("["), data, F.lit("]"))).otherwise(data)


def gleif_entities(answers: DataFrame) -> DataFrame:
    """From lei-record answers. A registration is no beginning of an entity: only its own dates count, and an end only if it is over."""
    r = answers.select(F.explode(F.from_json(_data(F.col("value")), _LEI)).alias("r")).select(F.coalesce("r.attributes.lei", "r.id").alias("lei"), "r.attributes.entity.*")
    over = F.col("status").isin("INACTIVE", "ANNULLED")
    return r.select(
        F.concat(F.lit("gleif:"), "lei").alias("internal_entity_id"), F.coalesce("legalName.name", "lei").alias("canonical_name"), F.lit("legal_entity").alias("entity_type"), "lei", F.col("legalAddress.country").alias("country"),
        F.get("legalAddress.addressLines", F.lit(0)).alias("address_line1"), F.col("legalAddress.city").alias("city"), F.col("legalAddress.region").alias("region"), F.col("legalAddress.postalCode").alias("postal_code"),
        F.array_join(F.transform("otherNames", lambda x: x["name"]), "|").alias("aliases"), F.substring("creationDate", 1, 10).alias("entity_valid_from"), F.when(over, F.substring(F.coalesce("expirationDate", "expiration.date"), 1, 10)).alias("entity_valid_to"),
        F.when(F.col("creationDate").isNotNull() | over, F.col("status")).alias("entity_status"),
    ).distinct()


_NODE, _PERIOD = "struct<id:string,nodeId:string>", "struct<periodType:string,type:string,startDate:string,endDate:string>"
_RELATION = f"struct<startNode:{_NODE},endNode:{_NODE},relationshipPeriods:array<{_PERIOD}>,periods:array<{_PERIOD}>,relationshipType:string,type:string,relationshipStatus:string,status:string>"


def gleif_edges(answers: DataFrame) -> DataFrame:
    """From relationship answers (query_type direct-parent or ultimate-parent, cache_key the child's LEI), in a master's edge columns."""
    kind = f"array<struct<id:string,attributes:struct<relationship:{_RELATION},registration:struct<status:string>>>>"
    r = answers.select(F.col("cache_key").alias("child"), F.when(F.contains("query_type", F.lit("ultimate")), "ultimate").otherwise("direct").alias("level"), F.explode(F.from_json(_data(F.col("value")), kind)).alias("r"))
    x = F.col("r.attributes.relationship")
    periods = F.coalesce(x["relationshipPeriods"], x["periods"])
    chosen = F.coalesce(F.get(F.filter(periods, lambda p: F.coalesce(p["periodType"], p["type"]) == "RELATIONSHIP_PERIOD"), F.lit(0)), F.get(periods, F.lit(0)))
    own = lambda n, default=None: F.concat(F.lit("gleif:"), F.regexp_replace(F.coalesce(x[n]["id"], x[n]["nodeId"], default if default is not None else F.lit(None)), "^gleif:", ""))
    type_ = F.coalesce(x["relationshipType"], x["type"], F.when(F.col("level") == "ultimate", "IS_ULTIMATELY_CONSOLIDATED_BY").otherwise("IS_DIRECTLY_CONSOLIDATED_BY"))
    status = F.coalesce(x["relationshipStatus"], x["status"], F.col("r.attributes.registration.status"), F.lit("ACTIVE"))
    e = r.select(F.lit("gleif").alias("provider"), own("startNode", F.col("child")).alias("from_id"), own("endNode").alias("to_id"), type_.alias("type"), "level", status.alias("status"), N.parse_date(chosen["startDate"]).alias("valid_from"), N.parse_date(chosen["endDate"]).alias("valid_to"))
    period = F.when(F.coalesce("valid_from", "valid_to").isNotNull(), F.array(F.struct(F.lit("RELATIONSHIP_PERIOD").alias("period_type"), "valid_from", "valid_to", "status", "provider"))).otherwise(F.array()).cast(PERIODS)
    return e.select("provider", "from_id", "to_id", F.col("to_id").alias("to_name"), F.lit("legal_entity").alias("to_type"), "type", "level", "status", "valid_from", "valid_to", period.alias("periods"), F.lit(None).cast("string").alias("trust"), F.lit(False).alias("open_holds"), F.lit(None).cast("string").alias("relationship_id"))


def gleif_exceptions(answers: DataFrame) -> DataFrame:
    """Why a parent was not reported: (entity_id, level, category, reason)."""
    kind = "array<struct<id:string,attributes:struct<exception:struct<category:string,exceptionCategory:string,reason:string,exceptionReason:string>>>>"
    r = answers.select("cache_key", F.when(F.contains("query_type", F.lit("ultimate")), "ultimate").otherwise("direct").alias("level"), F.explode(F.from_json(_data(F.col("value")), kind)).alias("r"))
    x = F.col("r.attributes.exception")
    return r.select(F.concat(F.lit("gleif:"), "cache_key").alias("entity_id"), "level", F.coalesce(x["category"], x["exceptionCategory"]).alias("category"), F.coalesce(x["reason"], x["exceptionReason"]).alias("reason"))


def sec_index(answers: DataFrame) -> DataFrame:
    """From the company index, whose rows are lists under ``fields``."""
    parsed = answers.select(F.from_json("value", "struct<fields:array<string>,data:array<array<string>>>").alias("v"))
    fields = F.coalesce("v.fields", F.array(*map(F.lit, ("cik", "name", "ticker", "exchange"))))
    r = parsed.select(fields.alias("f"), F.explode("v.data").alias("d")).select(F.map_from_arrays("f", "d").alias("m"))
    cik = F.lpad(F.col("m")["cik"], 10, "0")
    return r.select(F.concat(F.lit("sec:"), cik).alias("internal_entity_id"), F.coalesce(F.col("m")["name"], cik).alias("canonical_name"), F.lit("issuer").alias("entity_type"), cik.alias("cik"), F.lit("US").alias("country"), F.col("m")["ticker"].alias("ticker"), F.col("m")["exchange"].alias("exchange"))


def sec_submissions(answers: DataFrame) -> DataFrame:
    """From submissions: one row per listing, tickers and exchanges side by side."""
    kind = f"struct<cik:string,name:string,tickers:array<string>,exchanges:array<string>,formerNames:array<{_NAME}>>"
    r = answers.select(F.from_json("value", kind).alias("v")).select("v.*")
    both = F.arrays_zip(F.col("tickers").alias("ticker"), F.col("exchanges").alias("exchange"))
    pairs = F.filter(both, lambda p: p["ticker"].isNotNull() & p["exchange"].isNotNull())
    cik = F.lpad("cik", 10, "0")
    return r.select(cik.alias("cik"), F.col("name"), F.array_join(F.transform("formerNames", lambda x: x["name"]), "|").alias("aliases"), F.explode_outer(pairs).alias("l")).select(
        F.concat(F.lit("sec:"), "cik").alias("internal_entity_id"), F.coalesce("name", "cik").alias("canonical_name"), F.lit("issuer").alias("entity_type"), "cik", F.lit("US").alias("country"), "aliases", F.col("l.ticker").alias("ticker"), F.col("l.exchange").alias("exchange"),
    )


#: Letters that names which contain one another are joined on.
GRAM = 3


def _pieces(name: str, k: int) -> Column:
    places = F.sequence(F.lit(1), F.length(name) - k + 1)
    return F.when(F.length(name) >= k, F.transform(places, lambda i: F.substring(F.col(name), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def containment(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(i, o): names of inner that stand inside names of outer. An inner name is joined on the one of its pieces of GRAM letters (or itself, if it has fewer) that
    fewest outer names have; one with a piece that none has is nowhere."""
    i, o = (x.select(F.col(x.columns[0]).alias(n)).where(F.col(n) != "").distinct() for x, n in ((inner, "i"), (outer, "o")))
    held = o.select("o", F.explode(F.array_distinct(F.concat(*[_pieces("o", k) for k in range(1, GRAM + 1)]))).alias("g"))
    own = F.array_distinct(F.when(F.length("i") >= GRAM, _pieces("i", GRAM)).otherwise(F.array("i")))
    asked = i.select("i", F.explode(own).alias("g"), F.size(own).alias("size"))
    often = held.groupBy("g").agg(F.count("*").alias("n"))
    rarest = asked.join(often, "g").groupBy("i", "size").agg(F.count("*").alias("found"), F.min_by("g", F.struct("n", "g")).alias("g")).where("found = size").select("i", "g")
    return rarest.join(held, "g").where(F.contains("o", F.col("i"))).select("i", "o")


def sec_name_matches(records: DataFrame, index: DataFrame) -> DataFrame:
    """(record_id, internal_entity_id, kind, overlap): by ticker (0), equal name (1), or one name inside the other (2), ranked by shared words."""
    r, x = records.select("record_id", F.col("name").alias("r_name"), F.col("ticker").alias("r_ticker")), index.select("internal_entity_id", N.normalize_name(F.col("canonical_name")).alias("x_name"), N.normalize_identifier(F.col("ticker")).alias("x_ticker"))
    out = r.join(x, r.r_ticker == x.x_ticker).select("record_id", "internal_entity_id", F.lit(0).alias("kind"), F.lit(1.0).alias("overlap"))
    inside = containment(r.select("r_name"), x.select("x_name")).select(F.col("i").alias("r_name"), F.col("o").alias("x_name"))
    around = containment(x.select("x_name"), r.select("r_name")).select(F.col("o").alias("r_name"), F.col("i").alias("x_name"))
    pairs = inside.unionByName(around).distinct()
    a, b = F.array_distinct(F.split("r_name", " ")), F.array_distinct(F.split("x_name", " "))
    share = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    same = F.col("r_name") == F.col("x_name")
    pairs = pairs.withColumns({"kind": F.when(same, 1).otherwise(2), "overlap": F.when(same, 1.0).otherwise(share)})
    found = r.join(pairs, "r_name").join(x, "x_name").select("record_id", "internal_entity_id", "kind", "overlap")
    return out.unionByName(found).groupBy("record_id", "internal_entity_id").agg(F.min("kind").alias("kind"), F.max_by("overlap", -F.col("kind")).alias("overlap"))


# Exchange codes of the mapping service by market identifier.
FIGI_CODES = {"XNAS": "US", "XNYS": "US", "ARCX": "US", "XASE": "US"}


def figi_job(r: DataFrame) -> DataFrame:
    """(record_id, cache_key) of records with something to map: figi, isin, cusip, or a ticker with its exchange."""
    code = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in FIGI_CODES.items() for x in p]), F.col("exchange")), F.col("exchange"), F.lit(""))
    key = F.coalesce(F.concat(F.lit("ID_BB_GLOBAL:"), "figi"), F.concat(F.lit("ID_ISIN:"), "isin"), F.concat(F.lit("ID_CUSIP:"), "cusip"), F.concat(F.lit("TICKER:"), F.col("ticker"), F.lit(":"), code))
    return r.select("record_id", key.alias("cache_key")).where("cache_key is not null")


def figi_entities(answers: DataFrame) -> DataFrame:
    """From mapping answers (cache_key as figi_job makes it): an instrument per row, with the identifier that was asked for."""
    item = "array<struct<figi:string,name:string,securityDescription:string,ticker:string,exchCode:string,shareClassFIGI:string,compositeFIGI:string,securityType:string>>"
    r = answers.select("cache_key", F.explode(F.from_json(_data(F.col("value")), item)).alias("d")).select("cache_key", "d.*")
    asked = lambda kind: F.when(F.col("cache_key").startswith(f"{kind}:"), F.substring_index("cache_key", ":", -1))
    key = F.coalesce("shareClassFIGI", "compositeFIGI", "figi", F.substring(F.sha2(F.to_json(F.struct("name", "ticker", "exchCode")), 256), 1, 16))
    return r.select(
        F.concat(F.lit("openfigi:"), key).alias("internal_entity_id"), F.col("figi").alias("internal_security_id"), F.coalesce("name", "securityDescription", key).alias("canonical_name"), F.lit("issuer").alias("entity_type"), F.coalesce(asked("ID_BB_GLOBAL"), "figi").alias("figi"),
        asked("ID_ISIN").alias("isin"), asked("ID_CUSIP").alias("cusip"), "ticker", F.col("exchCode").alias("exchange"), F.col("shareClassFIGI").alias("share_class"),
    ).distinct()
