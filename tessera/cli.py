"""Command line: ``python -m tessera COMMAND``. Each command is a plan over files; results are folders that Spark writes.

preview, validate, resolve, export, migrate, relationships (validate, inspect), rules, override, generate, evaluate
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluate, generate, graph, rules, scoring
from tessera.plans import resolve, results
from tessera.plans.tables import clear, cut
from tessera.sources import files, master, relationships, sinks


def _document(path: str | None) -> dict | list | None:
    if not path:
        return None
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError("YAML documents need PyYAML.") from e
    return yaml.safe_load(text)


def _records(spark: SparkSession, a) -> DataFrame:
    rows = files.read(spark, a.input)
    files.check_fields(rows)
    mapping, pattern, _ = files.load_mapping(_document(a.mapping), rows.columns)
    records = files.apply_mapping(files.numbered(rows, "_row"), mapping, a.input.rstrip("/").rpartition("/")[2], "_row", pattern)
    files.preflight(records)
    return records


def _sources(spark: SparkSession, a) -> list[resolve.Source]:
    out = []
    if a.master:
        rows = files.numbered(files.read(spark, a.master), "_ord")
        m = cut(master.load(rows, "master", "_ord"))
        if bad := master.issues(m).limit(5).collect():
            raise ValueError(f"The master has faults: {[tuple(b) for b in bad]}")
        out.append(resolve.Source("master", m, cut(master.edges(m)), a.trust, frozenset(master.capabilities(rows.columns))))
    if a.relationships:
        p = cut(relationships.parse(files.numbered(files.read(spark, a.relationships), "_row"), _document(a.relationship_mapping), row="_row"))
        if bad := relationships.validate(p).where("severity = 'error'").limit(5).collect():
            raise ValueError(f"The relationship master has faults: {[tuple(b) for b in bad]}")
        out.append(resolve.Source(relationships.NAME, edges=cut(relationships.edges(p)), trust="authoritative", capabilities=frozenset({"relationship_effective_dates"})))
    return out


def preview(spark, a):
    rows = files.read(spark, a.input)
    return {"files": [r.asDict() for r in files.facts(spark, a.input).limit(100).collect()], "columns": [r.asDict() for r in files.profile(rows).collect()], "sample": [r.asDict() for r in rows.limit(a.sample).collect()], "mapping": files.suggest_mapping(rows.columns)}


def validate(spark, a):
    return {"valid": True, "records": _records(spark, a).count()}


def run(spark, a):
    policies, temporal = scoring.policies_from(_document(a.policies))
    temporal |= {"require_verified_for_auto_match": True} if a.strict else {}
    settings = resolve.Settings(scoring.Config(max_candidates=a.limit, mapping_version=a.mapping_version, relationship_max_depth=a.depth), policies, resolve.Temporal(**temporal))
    forced = rules.overrides_of(rules.read_overrides(a.overrides) if os.path.isfile(a.overrides) else rules.shared_overrides(spark, a.overrides)) if a.overrides else []
    forced += rules.rules_of(_document(a.rules)) if a.rules else []
    out = cut(results.v2(resolve.resolve(_records(spark, a), _sources(spark, a), settings, forced), a.mapping_version))
    sinks.write(out, a.output, a.overwrite)
    return {"records": out.count(), "decisions": {r.final_decision: r["count"] for r in out.groupBy("final_decision").count().collect()}}


def export(spark, a):
    sinks.export(spark.read.parquet(a.input), a.output, a.status, overwrite=a.overwrite)
    return {"output": a.output}


def migrate(spark, a):
    sinks.write(results.from_legacy(files.read(spark, a.input)), a.output, a.overwrite)
    return {"output": a.output}


def check_relationships(spark, a):
    p = cut(relationships.parse(files.numbered(files.read(spark, a.input), "_row"), _document(a.mapping), row="_row"))
    found = cut(relationships.validate(p))
    counts = {f"{r.severity}:{r.code}": r["count"] for r in found.groupBy("severity", "code").count().collect()}
    first = [r.asDict() for r in found.orderBy("row", "code").limit(a.show).collect()]  # the rest: --output
    if a.output:
        sinks.write(found, a.output, a.overwrite)
    return {"valid": not any(k.startswith("error:") for k in counts), "rows": p.count(), "counts": counts, "issues": first}


def inspect(spark, a):
    p = relationships.parse(files.numbered(files.read(spark, a.input), "_row"), _document(a.mapping), row="_row")
    edges = graph.ready(relationships.edges(p), "authoritative", True)
    return {"entity": a.entity, "date": a.date, "parents": [r.asDict() for r in graph.inspect(edges, a.entity, a.date).select("to_id", "type", "relationship_id", "valid_from", "valid_to", "trust").collect()]}


def make(spark, a):
    m = cut(master.load(files.numbered(files.read(spark, a.input), "_ord"), "master", "_ord"))
    sinks.write(generate.generate(m, a.count, a.seed), a.output, a.overwrite)
    return {"output": a.output}


def judge(spark, a):
    r, truth = spark.read.parquet(a.input), files.read(spark, a.truth)
    ids = lambda part: F.concat(F.array(f"{part}.canonical_id"), F.transform(f"{part}.alternatives", lambda x: x["entity_id" if part == "entity" else "security_id"]))
    r = r.select("record_id", F.col("legacy_status").alias("status"), F.col("entity.match_score").alias("confidence"), F.col("entity.match_pathway").alias("pathway"), ids("entity").alias("ranked_ids"), ids("security").alias("ranked_security_ids"), F.col("public_parent.direct_parent_id").alias("direct_parent_id"), F.col("temporal.overall.internal_status").alias("overall_status"), F.transform("entity.evidence", lambda e: e["type"]).alias("evidence_types"))
    j = cut(evaluate.judged(r, truth))
    head, kinds = evaluate.headline(j).first().asDict(), [x.asDict() for x in evaluate.by_category(j).orderBy("category").collect()]
    if a.html:
        with open(a.html, "w", encoding="utf-8") as f:
            f.write(evaluate.report(head, kinds))
    return {**head, "by_category": kinds}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tessera", description=__doc__)
    commands = p.add_subparsers(required=True)

    def command(name, f, *options):
        c = commands.add_parser(name)
        c.set_defaults(run=f)
        for o in options:
            c.add_argument(*o[0], **o[1])

    arg = lambda *n, **k: (n, k)
    source, out, over, mapping = arg("input"), arg("--output", required=True), arg("--overwrite", action="store_true"), arg("--mapping")
    command("preview", preview, source, arg("--sample", type=int, default=5))
    command("validate", validate, source, mapping)
    command("resolve", run, source, mapping, arg("--master"), arg("--trust", default="supporting", choices=list(relationships.TRUST)), arg("--relationships"), arg("--relationship-mapping"), arg("--rules"), arg("--overrides"), arg("--policies"), arg("--strict", action="store_true"),
            arg("--limit", type=int, default=20), arg("--depth", type=int, default=8), arg("--mapping-version", default="v1"), out, over)
    command("export", export, source, arg("--status", action="append"), out, over)
    command("migrate", migrate, source, out, over)
    command("relationships", check_relationships, source, mapping, arg("--show", type=int, default=1000), arg("--output"), over)
    command("inspect", inspect, source, mapping, arg("--entity", required=True), arg("--date"))
    command("rules", lambda spark, a: {"valid": True, "rules": len(rules.rules_of(_document(a.input)))}, source)
    command("override", lambda spark, a: rules.add_override(spark, a.log, _document(a.input)) if a.shared else rules.append_override(a.log, _document(a.input)), source, arg("--log", required=True), arg("--shared", action="store_true"))
    command("generate", make, source, arg("--count", type=int, default=1000), arg("--seed", type=int, default=1), out, over)
    command("evaluate", judge, source, arg("--truth", required=True), arg("--html"))
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    try:
        print(json.dumps(a.run(spark or SparkSession.builder.appName("tessera").getOrCreate(), a), indent=2, default=str))
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    finally:
        clear()
    return 0
