"""Resolution again, of what changed.

A run leaves its results and fingerprints beside them: of each record with the rule that decides it, of each block of each source's
index (its rows in load order), of edges, exceptions and identities. The next run resolves again

* records that are new, changed, or decided by another rule,
* records of which a key's block changed: what a record's candidates are depends on nothing else of a source,
* records whose entity is below a changed edge, exception or identity,

and keeps the others' results. All are found by joins on keys; nothing but counts comes to the driver. With other settings, sources' names,
trust, capabilities or errors, all records are resolved again. The results equal those of a full run, whatever changed.

Records' ids are unique (files.preflight). Records that are gone are gone from the results. A folder is complete when its ``meta`` is there;
the old folder is only read, so a run that fails is run again.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import rules
from tessera.operators.blocking import PROBED, index
from tessera.plans.resolve import _EDGE, Settings, Source, _edges_of, prepare, resolve
from tessera.plans.tables import cut

_ABOUT = "kind string, id string, print string"


@dataclass(frozen=True)
class Run:
    results: DataFrame
    #: Ids of records that were resolved.
    touched: DataFrame


def row_print(df: DataFrame, *columns: str) -> Column:
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in columns or sorted(df.columns)])))


def record_prints(records: DataFrame, forced: list[rules.Rule]) -> DataFrame:
    """(record_id, print, and the canonical columns that blocks are looked up by): a print is of all that a record says and of the rule that decides it."""
    ready = rules.decided(prepare(records), forced)
    said = F.array(*[F.lit(hashlib.md5(json.dumps(dataclasses.asdict(r), sort_keys=True, default=str).encode()).hexdigest()) for r in forced]).cast("array<string>")
    ready = ready.withColumn("_said", F.get(said, F.col("rule")))
    return ready.withColumn("print", row_print(ready)).select("record_id", "print", "name", "domain", *PROBED)


def _keys(prints: DataFrame) -> DataFrame:
    """(record_id, block, key) of all blocks that a record or a probe of it may ask for."""
    key = lambda block, c: F.struct(F.lit(block).alias("block"), c.alias("key"))
    asked = F.concat(
        F.array(key("name", F.col("name")), key("domain", F.col("domain")), *(key("identifier", F.col(f)) for f in PROBED)),
        F.transform(F.coalesce(F.split("name", " "), F.array().cast("array<string>")), lambda t: key("token", t)),
    )
    return prints.select("record_id", F.explode(F.array_distinct(asked)).alias("k")).select("record_id", "k.block", "k.key").where("key is not null")


def _blocks(source: Source, limit: int) -> DataFrame:
    """(source, block, key, print): a block's print is of its rows, of which there are at most limit, in load order."""
    rows = source.entities.select("ord", row_print(source.entities).alias("row"))
    whole = index(source.entities, limit).join(rows, "ord").groupBy("block", "key").agg(F.array_sort(F.collect_list(F.struct("ord", "row"))).alias("rows"))
    return whole.select(F.lit(source.name).alias("source"), "block", "key", F.md5(F.to_json("rows")).alias("print"))


def _union(tables: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, tables, spark.createDataFrame([], schema))


def _about(spark: SparkSession, sources: list[Source], forced: list[rules.Rule]) -> tuple[DataFrame, DataFrame]:
    """(kind, id, print) of what is said of an entity beside its blocks, and links (id, below): what is said of id tells on those below it."""
    edges = [(s.name, s.edges) for s in sources if s.edges is not None]
    if given := [e for r in forced if r.action == "match" for e in _edges_of(r)]:
        edges.append(("rules", spark.createDataFrame(given, _EDGE)))
    kept = [(s.name, s.entities) for s in sources if s.entities is not None]
    said = [e.select(F.lit(f"edge of {name}").alias("kind"), F.col("from_id").alias("id"), row_print(e).alias("print")) for name, e in edges]
    said += [s.exceptions.select(F.lit(f"exception of {s.name}").alias("kind"), F.col("entity_id").alias("id"), row_print(s.exceptions).alias("print")) for s in sources if s.exceptions is not None]
    links = [e.select(F.col("to_id").alias("id"), F.col("from_id").alias("below")) for _, e in edges]
    if edges and len(kept) > 1:  # entities of several sources are one node where they share an identifier
        for name, e in kept:
            said.append(e.select(F.lit(f"identity in {name}").alias("kind"), F.col("entity_id").alias("id"), row_print(e, "entity_id", "lei", "cik").alias("print")))
            for f in ("lei", "cik"):
                one = e.where(F.col(f).isNotNull()).select(F.col("entity_id").alias("id"), F.concat(F.lit(f"{f}:"), F.col(f)).alias("below"))
                links += [one, one.select(F.col("below").alias("id"), F.col("id").alias("below"))]
    return _union(said, spark, _ABOUT).distinct(), _union(links, spark, "id string, below string").where("id is not null and below is not null").distinct()


def _differ(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Values of by whose rows are not the same in both."""
    both = old.select(*by, "print", F.lit(-1).alias("n")).unionByName(new.select(*by, "print", F.lit(1).alias("n")))
    return both.groupBy(*by, "print").agg(F.sum("n").alias("n")).where("n <> 0").select(*by).distinct()


def _below(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """seeds (id) and all that links lead to. A round per hop, each over what the last one found."""
    reached = frontier = cut(seeds.distinct())
    while not frontier.isEmpty():
        frontier = cut(frontier.join(links, "id").select(F.col("below").alias("id")).distinct().join(reached, "id", "left_anti"))
        reached = reached.unionByName(frontier)
    return reached


def _digest(sources: list[Source], settings: Settings) -> str:
    what = [dataclasses.asdict(settings), [(s.name, s.trust, sorted(s.capabilities), s.error, s.entities is None, s.edges is None, s.exceptions is None) for s in sources]]
    return hashlib.sha256(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()


def resolve_changes(records: DataFrame, sources: list[Source], new: str, old: str | None = None, settings: Settings = Settings(), forced: list[rules.Rule] | None = None) -> Run:
    """Results as resolve gives them, and which records were resolved for them. new: the folder that the run leaves; old: that of the run before, if there is one."""
    spark, forced = records.sparkSession, forced or []
    digest = _digest(sources, settings)

    def kept(table: DataFrame, name: str) -> DataFrame:
        table.write.mode("overwrite").parquet(f"{new}/{name}")
        return spark.read.parquet(f"{new}/{name}")

    before = lambda name: spark.read.parquet(f"{old}/{name}")
    sound = [s for s in sources if not s.error]
    prints = kept(record_prints(records, forced), "records")
    blocks = kept(_union([_blocks(s, settings.config.max_candidates) for s in sound if s.entities is not None], spark, "source string, block string, key string, print string"), "blocks")
    about, links = _about(spark, sound, forced)
    about, links = kept(about, "about"), kept(links, "links")

    if old is None or before("meta").first().digest != digest:
        touched = kept(prints.select("record_id"), "touched")
        results = kept(resolve(records, sources, settings, forced), "results")
    else:
        past = before("results")
        changed = prints.select("record_id", "print").join(before("records").select("record_id", "print"), ["record_id", "print"], "left_anti").select("record_id")
        told = _differ(before("blocks"), blocks, ["source", "block", "key"]).select("block", "key").distinct()
        asking = _keys(prints).join(told, ["block", "key"], "left_semi").select("record_id")
        below = _below(_differ(before("about"), about, ["kind", "id"]).select("id"), links.unionByName(before("links")).distinct())
        under = past.join(below, past["entity_id"] == below["id"], "left_semi").select("record_id").join(prints, "record_id", "left_semi")
        touched = kept(changed.unionByName(asking).unionByName(under).distinct(), "touched")
        same = past.join(prints.select("record_id"), "record_id", "left_semi").join(touched, "record_id", "left_anti")
        if not touched.isEmpty():
            fresh = resolve(records.withColumn("record_id", F.col("record_id").cast("string")).join(touched, "record_id", "left_semi"), sources, settings, forced)
            same = fresh.unionByName(same.select(*fresh.columns))
        results = kept(same, "results")
    kept(spark.createDataFrame([(digest,)], "digest string"), "meta")
    return Run(results, touched)
