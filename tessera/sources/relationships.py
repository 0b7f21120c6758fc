"""Relationship masters: a table of child, parent, type and period, checked as a whole, as edges of the parent graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import normalize as N
from tessera.functions.temporal import PERIODS
from tessera.plans.tables import cut

# Relationship types, those of which a child has one at a time, and those that make cycles.
EXCLUSIVE = ("subsidiary_of", "owned_by", "brand_of", "division_of")
CYCLIC = (*EXCLUSIVE, "operated_by", "ultimate_parent_of")
TYPES = (*CYCLIC, "minority_owned_by", "formerly_owned_by")
TRUST = ("experimental", "supporting", "authoritative")
FIELDS = ("relationship_id", "child_entity_id", "parent_entity_id", "relationship_type", "valid_from", "valid_to", "ownership_percentage", "source", "source_record_id", "trust_level", "is_direct")
REQUIRED = FIELDS[:4]
NAME = "customer_relationship_master"
#: Keys that are broadcast, once counted.
SMALL = 100_000


def mapping_of(raw: dict[str, str] | None) -> dict[str, str]:
    """canonical to source column, from a mapping in either direction."""
    raw = raw or {f: f for f in FIELDS}
    if set(raw) <= set(FIELDS):
        out = dict(raw)
    elif set(raw.values()) <= set(FIELDS):
        out = {v: k for k, v in raw.items()}
    else:
        raise ValueError(f"A mapping is of the fields {', '.join(FIELDS)}, and names others: {', '.join(sorted((set(raw) | set(raw.values())) - set(FIELDS)))}")
    if len(set(out.values())) < len(out):
        raise ValueError("Two fields are mapped to one column.")
    return out


def mapping_issues(mapping: dict[str, str], columns: list[str]) -> list[str]:
    """What a mapping lacks, as codes."""
    out = [f"missing_mapping:{f}" for f in REQUIRED if f not in mapping]
    return out + [f"missing_source_column:{f}" for f, c in mapping.items() if f in REQUIRED and c not in columns]


def parse(rows: DataFrame, mapping: dict[str, str] | None = None, trust: str = "authoritative", row: str = "row") -> DataFrame:
    """Typed columns beside the raw ones that checks look at: (row, FIELDS.., raw_*)."""
    mapping = {f: c for f, c in mapping_of(mapping).items() if c in rows.columns}
    text = lambda f: F.when(F.trim(F.col(mapping[f]).cast("string")) != "", F.trim(F.col(mapping[f]).cast("string"))) if f in mapping else F.lit(None).cast("string")
    kind, direct = F.lower(text("relationship_type")), F.lower(text("is_direct"))
    kind = F.when(kind.isin(*TYPES), kind)
    share = text("ownership_percentage").try_cast("double")
    level = F.lower(F.coalesce(text("trust_level"), F.lit(trust)))
    return rows.select(
        F.col(row).cast("long").alias("row"), text("relationship_id").alias("relationship_id"), text("child_entity_id").alias("child_entity_id"), text("parent_entity_id").alias("parent_entity_id"), kind.alias("relationship_type"),
        N.parse_date(text("valid_from")).alias("valid_from"), N.parse_date(text("valid_to")).alias("valid_to"), F.when(share.between(0, 100), share).alias("ownership_percentage"), text("source").alias("source"),
        text("source_record_id").alias("source_record_id"), F.when(level.isin(*TRUST), level).otherwise(trust).alias("trust_level"),
        F.when(direct.isin("true", "1", "yes", "y"), True).when(direct.isin("false", "0", "no", "n"), False).otherwise(F.when(direct.isNull(), ~kind.eqNullSafe(F.lit("ultimate_parent_of"))).otherwise(True)).alias("is_direct"),
        text("valid_from").alias("raw_from"), text("valid_to").alias("raw_to"), text("ownership_percentage").alias("raw_share"), level.alias("raw_trust"), direct.alias("raw_direct"),
    )


def row_issues(parsed: DataFrame) -> DataFrame:
    """(row, code, field) of rows on their own."""
    c = F.col
    bad = lambda code, field, when: F.when(when, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field")))
    dated = (c("raw_from").isNotNull() & c("valid_from").isNull()) | (c("raw_to").isNotNull() & c("valid_to").isNull()) | (c("valid_from") > c("valid_to"))
    found = [
        *(bad("missing_identifier", f, c(f).isNull()) for f in REQUIRED[:3]), bad("self_reference", "parent_entity_id", c("child_entity_id") == c("parent_entity_id")),
        bad("invalid_relationship_type", "relationship_type", c("relationship_type").isNull()), bad("invalid_period", "valid_to", dated),
        bad("invalid_ownership_percentage", "ownership_percentage", c("raw_share").isNotNull() & c("ownership_percentage").isNull()),
        bad("minority_control_conflict", "ownership_percentage", (c("relationship_type") == "minority_owned_by") & (c("ownership_percentage") >= 50)),
        bad("invalid_trust_level", "trust_level", ~c("raw_trust").isin(*TRUST)), bad("invalid_is_direct", "is_direct", ~c("raw_direct").isin("true", "1", "yes", "y", "false", "0", "no", "n")),
    ]
    return parsed.select("row", F.explode(F.array_compact(F.array(*found))).alias("i")).select("row", "i.code", "i.field")


def usable(parsed: DataFrame) -> DataFrame:
    return parsed.dropna(subset=list(REQUIRED))


def duplicate_ids(rows: DataFrame) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("relationship_id"))
    return rows.withColumn("_n", n).where("_n > 1").select("row", F.lit("duplicate_relationship_id").alias("code"), F.lit("relationship_id").alias("field"))


#: Rows of a key that are compared in pairs; of more, intervals are cut into blocks. Days of the calendar are less than 2 ** LEVELS.
FEW, LEVELS = 64, 22


def _blocks(start: Column, end: Column) -> Column:
    """The fewest blocks of 2 ** level days, each beginning at a multiple of that, that make up [start, end]: array of struct(level, block)."""

    def level(k: Column) -> Column:
        low = F.call_function("shiftright", start + F.call_function("shiftleft", F.lit(1), k) - 1, k)
        high = F.call_function("shiftright", end + 1, k)
        of = lambda block, odd: F.when((low < high) & (odd % 2 == 1), F.struct(k.alias("level"), block.alias("block")))
        return F.array(of(low, low), of(high - 1, high))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), level)))


def interval_pairs(rows: DataFrame, keys: list[str], start: str, end: str, order: str, few: int = FEW) -> DataFrame:
    """(l_*, r_*) of all columns but keys, with keys: each pair of a key's rows whose closed intervals overlap once, the one of lower order left. An open end is
    infinite; an interval that ends before it starts overlaps none. order: differs by row.

    Two intervals overlap where the later start lies in the other one. Each start is a point, in one block at each level; each interval is a few blocks apart from each
    other; so point and interval meet in one block or none, and a key of very many rows costs what it gives, not its square. Keys of few rows are joined."""
    low, high = F.to_date(F.lit("0001-01-01")), F.to_date(F.lit("9999-12-31"))
    days = lambda c, default: F.date_diff(F.coalesce(c, default), low)
    others = [c for c in rows.columns if c not in keys]
    rows = rows.withColumns({"_s": days(F.col(start), low), "_e": days(F.col(end), high)}).where("_s <= _e")
    side = lambda rows, s, *more: rows.select(*keys, *(F.col(c).alias(f"{s}_{c}") for c in [*others, "_s", "_e"]), *more)
    named = [*keys, *(f"{s}_{c}" for s in "lr" for c in others)]

    many = cut(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > few).select(*keys))
    n = many.count()
    hint = F.broadcast if n <= SMALL else (lambda df: df)
    light = rows.join(hint(many), keys, "left_anti") if n else rows
    light = side(light, "l").join(side(light, "r"), keys).where((F.col(f"l_{order}") < F.col(f"r_{order}")) & (F.col("l__s") <= F.col("r__e")) & (F.col("r__s") <= F.col("l__e"))).select(*named)
    if not n:
        return light
    heavy = rows.join(hint(many), keys, "left_semi")
    point = F.explode(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", F.col("_s"), k).alias("block"))))
    points = side(heavy.withColumn("_at", point), "r", F.col("_at.level").alias("_level"), F.col("_at.block").alias("_block"))
    intervals = side(heavy.withColumn("_at", F.explode(_blocks(F.col("_s"), F.col("_e")))), "l", F.col("_at.level").alias("_level"), F.col("_at.block").alias("_block"))
    met = intervals.join(points, [*keys, "_level", "_block"]).where((F.col("l__s") < F.col("r__s")) | (F.col(f"l_{order}") < F.col(f"r_{order}")))
    turned = F.col(f"l_{order}") > F.col(f"r_{order}")
    swap = [F.when(turned, F.col(f"{b}_{c}")).otherwise(F.col(f"{a}_{c}")).alias(f"{a}_{c}") for a, b in ("lr", "rl") for c in others]
    return light.unionByName(met.select(*keys, *swap))


def overlaps(rows: DataFrame, few: int = FEW) -> DataFrame:
    """(row, code, field, other): two issues for each pair of a child's rows whose periods overlap and that say the same, or name different exclusive parents.
    Rows are joined on all that a pair must share, and by their periods."""
    periods = cut(rows.select("row", "child_entity_id", "parent_entity_id", "relationship_type", "valid_from", "valid_to"))
    pairs = lambda rows, keys: interval_pairs(rows, keys, "valid_from", "valid_to", "row", few)
    same = pairs(periods, ["child_entity_id", "parent_entity_id", "relationship_type"]).withColumn("code", F.lit("duplicate_active_relationship"))
    exclusive = pairs(periods.where(F.col("relationship_type").isin(*EXCLUSIVE)).drop("relationship_type"), ["child_entity_id"])
    exclusive = exclusive.where(F.col("l_parent_entity_id") != F.col("r_parent_entity_id")).withColumn("code", F.lit("overlapping_parent_periods"))
    found = same.select("code", "l_row", "r_row").unionByName(exclusive.select("code", "l_row", "r_row"))
    each = F.explode(F.array(F.struct(F.col("l_row").alias("row"), F.col("r_row").alias("other")), F.struct(F.col("r_row").alias("row"), F.col("l_row").alias("other"))))
    return found.select("code", each.alias("b")).select("b.row", "code", F.lit(None).cast("string").alias("field"), "b.other")


# --- cycles


def _ends(steps: DataFrame) -> DataFrame:
    """(way, v, end) from (way, v, to), one step for each v: where it leads when no step goes on, null if it goes round for ever. Steps are doubled. Of a line that is
    longer, some end in each round; when none does, what is left goes round."""
    going, ended, left = steps.select("way", "v", F.col("to").alias("end")), [], -1
    onward = going
    while left:
        step = cut(going.join(onward.select("way", F.col("v").alias("end"), F.col("end").alias("next")), ["way", "end"], "left").select("way", "v", "end", "next"))
        ended.append(step.where("next is null").select("way", "v", "end"))
        going = step.where("next is not null").select("way", "v", F.col("next").alias("end"))
        before, left = left, going.count()
        if left == before:
            break
        onward = reduce(DataFrame.unionByName, ended, going)
    return reduce(DataFrame.unionByName, ended, going.select("way", "v", F.lit(None).cast("string").alias("end")))


def _compressed(e: DataFrame) -> DataFrame | None:
    """Each edge (row, c, p) as one between places where lines meet, null ends are of rings; None if lines meet everywhere."""
    both = cut(e.select("c", "p").distinct())
    single = lambda own, other: both.groupBy(F.col(own).alias("v")).agg(F.count("*").alias("n"), F.min(other).alias(other)).where("n = 1").drop("n")
    inner = single("c", "p").join(single("p", "c"), "v")
    steps = cut(inner.select("v", F.explode(F.array(F.struct(F.lit("p").alias("way"), F.col("p").alias("to")), F.struct(F.lit("c").alias("way"), F.col("c").alias("to")))).alias("s")).select("s.way", "v", "s.to"))
    if steps.isEmpty():
        return None
    ends = cut(_ends(steps))
    for way in ("c", "p"):
        own = ends.where(F.col("way") == way).select(F.col("v").alias(way), "end", F.lit(True).alias("on"))
        e = e.join(own, way, "left").withColumn(way, F.when(F.col("on"), F.col("end")).otherwise(F.col(way))).drop("end", "on")
    return cut(e.select("row", "c", "p"))


def _inside_components(pairs: DataFrame) -> DataFrame:
    """The pairs (c, p), c other than p, that lie inside a strongly connected component. Each node gets the least of the nodes that lead to it and the least of those
    it leads to, in an order that differs by round. Nodes of a component get the same two. If both are one node, it leads there and back; other pairs of equal nodes go on to the
    next round, pairs of different ones are in no component. A round has a row per node and edge."""
    found, turn = [], 0
    while True:
        two = cut(pairs.select(F.explode(F.array(F.struct(F.lit(0).alias("way"), "c", "p"), F.struct(F.lit(1).alias("way"), F.col("p").alias("c"), F.col("c").alias("p")))).alias("s")).select("s.*"))
        label = F.concat(F.hex(F.xxhash64("v", F.lit(turn))), F.lit(":"), "v")
        nodes = two.select("way", F.col("c").alias("v")).union(two.select("way", "p")).distinct().withColumn("label", label)
        while True:
            met = nodes.select("way", "v", "label", F.col("label").alias("own")).unionByName(
                two.join(nodes.withColumnRenamed("v", "c"), ["way", "c"]).select("way", F.col("p").alias("v"), "label", F.lit(None).cast("string").alias("own"))
            )
            step = cut(met.groupBy("way", "v").agg(F.min("label").alias("label"), F.max("own").alias("own")))
            nodes = step.select("way", "v", "label")
            if step.where("label < own").isEmpty():
                break
        labels = nodes.groupBy("v").agg(F.max(F.when(F.col("way") == 0, F.col("label"))).alias("before"), F.max(F.when(F.col("way") == 1, F.col("label"))).alias("after"))
        of = lambda end: labels.select(F.col("v").alias(end), F.col("before").alias(f"{end}_before"), F.col("after").alias(f"{end}_after"))
        same = cut(pairs.join(of("c"), "c").join(of("p"), "p").where("c_before = p_before and c_after = p_after").select("c", "p", (F.col("c_before") == F.col("c_after")).alias("inside")))
        found.append(same.where("inside").select("c", "p"))
        pairs, turn = same.where("not inside").select("c", "p"), turn + 1
        if pairs.isEmpty():
            return reduce(DataFrame.unionByName, found)


def cycles(rows: DataFrame) -> DataFrame:
    """Every row on a cycle, by strongly connected components. Edges that begin or end nowhere are taken off, as long as that takes many; then runs of entities with one child
    and one parent become one edge; and so on in turns, which leaves nothing of any tree and a loop of any ring, in a number of rounds that grows with the
    logarithm of their size. What is left, where lines meet, is labelled."""
    e = cut(rows.where(F.col("relationship_type").isin(*CYCLIC)).select("row", F.col("child_entity_id").alias("c"), F.col("parent_entity_id").alias("p")))
    found, n = [e.where("c = p").select("row")], e.count()
    while n:
        between = e.select(F.col("p").alias("c")).intersect(e.select("c"))  # what some edge leads to, and another from
        e = cut(e.where("c <> p").join(between, "c", "left_semi").join(between.select(F.col("c").alias("p")), "p", "left_semi"))
        before, n = n, e.count()
        if n > 0.9 * before:
            if not (met := _compressed(e)):
                if n == before:
                    break
                continue
            found.append(met.where("c is null or p is null or c = p").select("row"))
            e = met.where("c is not null and p is not null")
    if n:
        inside = _inside_components(cut(e.select("c", "p").distinct()))
        found.append(e.join(inside, ["c", "p"], "left_semi").select("row"))
    return reduce(DataFrame.unionByName, found).select("row", F.lit("parent_cycle").alias("code"), F.lit(None).cast("string").alias("field"))


def unknown_references(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Warnings for ids that are not among entities (entity_id)."""
    both = rows.select("row", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("entity_id")) for f in REQUIRED[1:3]])).alias("x")).select("row", "x.*")
    return both.join(entities.select("entity_id").distinct(), "entity_id", "left_anti").select("row", F.lit("unknown_entity_reference").alias("code"), "field")


def validate(parsed: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(row, code, field, severity) of a whole table."""
    rows = usable(parsed)
    out = row_issues(parsed).unionByName(duplicate_ids(rows)).unionByName(overlaps(rows).drop("other")).unionByName(cycles(rows)).withColumn("severity", F.lit("error"))
    if entities is not None:
        out = out.unionByName(unknown_references(rows, entities).withColumn("severity", F.lit("warning")))
    return out


def edges(parsed: DataFrame, provider: str = NAME) -> DataFrame:
    """In the schema of a master's edges. An undated relationship holds on every date."""
    rows = usable(parsed)
    period = F.array(F.struct(F.col("relationship_type").alias("period_type"), "valid_from", "valid_to", F.lit("ACTIVE").alias("status"), F.lit(provider).alias("provider"))).cast(PERIODS)
    return rows.select(
        F.lit(provider).alias("provider"), F.col("child_entity_id").alias("from_id"), F.col("parent_entity_id").alias("to_id"), F.col("parent_entity_id").alias("to_name"), F.lit("legal_entity").alias("to_type"),
        F.col("relationship_type").alias("type"), F.when(F.col("is_direct"), "direct").otherwise("ultimate").alias("level"), F.lit("ACTIVE").alias("status"), "valid_from", "valid_to", period.alias("periods"), F.col("trust_level").alias("trust"),
        F.lit(True).alias("open_holds"), "relationship_id",
    )
