import datetime
import hashlib
import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import normalize as N
from tessera.functions import temporal as T
from tessera.functions.similarity import may_reach, similarity, with_similarity
from tessera.operators import blocking, evaluate, generate, graph, periods, reconcile, rules, scoring, similar
from tessera.plans import resolve as plan
from tessera.plans import results
from tessera.plans.tables import cut
from tessera.sources import files, master, profiles, relationships, sinks, snapshots


def one(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string").orderBy("i").select(f(F.col("c"))).collect()]


def day(s):
    return datetime.date.fromisoformat(s) if s else None


# --- normalisers


def test_names(spark):
    given = ["THE PROCTER & GAMBLE COMPANY", "Holdings", "Company", "AT&T Inc.", "Société Générale SA", "ﬁne ß Straße", "éa Group", "Ａcme Ltd Co", None, "", "Acme  Widgets"]
    assert one(spark, N.normalize_name, *given) == ["the procter and gamble", None, None, "at and t", "societe generale", "fine ss strasse", "ea", "acme", None, None, "acme widgets"]


def test_domains(spark):
    given = ["https://www.microsoft.com/en-us/?x=1", "www.bbc.co.uk", "localhost", "//x.com", "http://u:p@A.B.example.COM:80/x", "a b.com", "x.com.", None, "1http://x.com"]
    assert one(spark, N.normalize_domain, *given) == ["microsoft.com", "bbc.co.uk", None, None, "example.com", None, "x.com", None, None]


def test_identifiers_and_places(spark):
    assert one(spark, lambda c: N.normalize_identifier(c, "cik"), "789019", "N/A", "12345678901", "ab-1", "NA") == ["0000789019", None, "12345678901", "AB1", None]
    assert one(spark, N.normalize_exchange, "NASDAQ", "NasdaqGS", "XNAS", "other x", "!") == ["XNAS", "XNAS", "XNAS", "OTHERX", None]
    assert one(spark, N.normalize_country, "United States", "USA", "us", "U.S.", "uk", "de", "Ruritania", "ZZ") == ["US", "US", "US", "US", "GB", "DE", None, None]
    assert one(spark, N.normalize_address, "One Microsoft Way", "1 Microsoft Wy", "10 Main St.") == ["1 microsoft way", "1 microsoft way", "10 main street"]
    assert one(spark, N.normalize_locality, "!!", "New  York", "") == ["", "new york", None]
    assert one(spark, N.normalize_subdivision, "Washington", "!!", "bavaria") == ["wa", None, "bavaria"]
    assert one(spark, N.normalize_postal_code, "ab-1 2", "--") == ["AB12", None]


def test_dates(spark):
    assert one(spark, N.parse_date, "2025-01-05", "2025-1-5", "20250105", "2025-01-05T10:00", "2025-02-30", None) == [day("2025-01-05"), None, day("2025-01-05"), day("2025-01-05"), None, None]
    weeks = [f"{y}-W{w:02}" for y in (2015, 2020, 2021, 2024, 2026) for w in (0, 1, 2, 30, 52, 53, 54)]
    short = [*weeks, *(f"{w}-{d}" for w in weeks for d in (0, 1, 4, 7, 8)), *(f"{w}{d}".replace("-", "") for w in weeks for d in (1, 7)), *(w.replace("-", "") for w in weeks), "20240229", "20230229", "2025-W017", "2025W01-7", "20250105\n", "2025-W01 ", "202501", "2025010"]

    def python(x):
        try:
            return datetime.date.fromisoformat(x)
        except ValueError:
            return None

    assert one(spark, N.parse_date, *short) == [python(x) for x in short]
    assert one(spark, lambda c: N.parse_date(c, "%d-%m-%Y"), "03-04-2025", "x") == [day("2025-04-03"), None]


# --- dates


def scopes(spark, periods, when, every=False):
    rows = [(day(when), [("p", day(a), day(b), s, "x") for a, b, s in periods])]
    df = spark.createDataFrame(rows, f"day date, periods {T.PERIODS}")
    r = df.select(T.evaluate_periods(F.col("periods"), F.col("day"), every).alias("r")).first().r
    return r.status, r.valid


def test_period_scopes(spark):
    two = [("2010-01-01", "2015-12-31", None), ("2020-01-01", None, None)]
    assert scopes(spark, two, "2022-01-01") == ("verified", True)
    assert scopes(spark, two, "2022-01-01", every=True) == ("invalid", False)
    assert scopes(spark, two, "2017-01-01") == ("invalid", False)
    assert scopes(spark, [("2010-01-01", None, "delisted")], "2022-01-01") == ("not_verified", None)
    assert scopes(spark, [*two, (None, None, None)], "2017-01-01") == ("partial", None)
    assert scopes(spark, two, None) == ("not_requested", None)
    assert scopes(spark, [], "2022-01-01") == ("not_verified", None)


def test_policy_actions(spark):
    df = spark.createDataFrame([("invalid",), ("partial",), ("verified",)], "s string")
    assert [tuple(r) for r in df.select(T.policy_action(F.col("s")), T.policy_action(F.col("s"), True), T.policy_action(F.col("s"), unknown="reject")).collect()] == [("review",) * 3, ("allow_with_warning", "review", "reject"), ("allow",) * 3]
    with pytest.raises(ValueError):
        T.policy_action(F.col("s"), unknown="maybe")


# --- similarity


def test_similarity(spark):
    pairs = [("acme widgets", "acme widget"), ("widgets acme", "acme widgets"), ("a", "b"), ("global x", "global x"), ("microsoft", "micorsoft"), ("ab cd ef", "ab cd"), ("x" * 300, "x" * 299 + "y")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)] + [(9, None, "a")], "i int, a string, b string")
    got = {r.i: r.similarity for r in with_similarity(df, "a", "b").collect()}
    for i, (a, b) in enumerate(pairs):
        want = similarity(a, b)
        assert got[i] == pytest.approx(want) or (want < 0.75 and got[i] == 0)
    assert got[9] == 0 and got[1] == 1.0
    assert similarity("ab", "ba") == max(SequenceMatcher(None, "ab", "ba").ratio(), 0)


def test_the_bound_drops_no_similar_pair(spark):
    words = ["acme", "tools", "inc", "global", "x", "widgetry"]
    import itertools

    names = [" ".join(p) for n in (1, 2, 3) for p in itertools.permutations(words, n)][:120]
    pairs = [(a, b) for a in names[::5] for b in names[::7]]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("may", may_reach(F.col("a"), F.col("b")))
    assert all(r.may for r in df.collect() if similarity(r.a, r.b) >= 0.75)


# --- blocking


MASTER = "ord long, internal_entity_id string, internal_security_id string, canonical_name string, entity_type string, ticker string, exchange string, figi string, cik string, lei string, domain string, country string, aliases string, parent_entity_id string, entity_valid_from string, security_valid_from string"
ROWS = [
    (1, "e1", "s1", "Acme Widgets Inc", "issuer", "ACM", "NASDAQ", "FIGI1", "123", None, "acme.com", "US", "Acme", None, "2000-01-01", "2001-01-01"),
    (2, "e2", None, "Acme Tools LLC", "subsidiary", None, None, None, "124", None, "acmetools.com", "US", "", "e1", "2005-01-01", None),
    (3, "e3", "s3", "Globex Corporation", "issuer", "GLX", "NYSE", "FIGI3", "125", "LEI3", "globex.com", "DE", "Globex Holdings|GX", None, None, None),
    (4, "e4", "s4", "Initech", "issuer", "DUP", "NYSE", None, "126", None, "initech.com", "US", None, None, None, None),
    (5, "e5", "s5", "Umbrella", "issuer", "DUP", "LSE", None, "127", None, "umbrella.com", "GB", None, None, None, None),
]


@pytest.fixture(scope="module")
def entities(spark):
    return master.load(spark.createDataFrame(ROWS, MASTER), "master").cache()


def search_scan(records: DataFrame, master: DataFrame, limit: int = 20) -> DataFrame:
    """What blocking finds, by comparing every record with every row."""
    m = master.select("ord", F.col("domain").alias("m_domain"), "names", blocking._keys(*map(F.col, blocking.IDENTIFIERS)).alias("ids"))
    r = records.select("record_id", "domain", "name", blocking._keys(*map(F.col, blocking.PROBED)).alias("needles"))
    first = F.split("name", " ")[0]
    priority = F.when(F.arrays_overlap("needles", "ids"), 0).when(F.col("domain") == F.col("m_domain"), 1).when(F.array_contains("names", F.col("name")), 2)
    token = F.exists("names", lambda n: F.array_contains(F.split(n, " "), first))
    pairs = r.crossJoin(m).withColumn("priority", F.coalesce(priority, F.when(token, F.lit(3)))).where("priority is not null")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("record_id").orderBy("priority", "ord")))
    return ranked.where(F.col("rank") <= limit).select("record_id", "ord", "priority", "rank")


def test_blocking_finds_what_a_scan_finds(spark):
    rows = [(i, f"e{i}", None, f"Common Word{i % 9} Firm{i}", "issuer", f"T{i}", None, None, str(i + 1), None, f"d{i % 7}.com", "US", f"Alias {i % 5}", None, None, None) for i in range(60)]
    m = master.load(spark.createDataFrame(rows, MASTER), "master")
    r = [(str(i), n, d, c) for i, (n, d, c) in enumerate([("Common", None, None), ("Common Word3 Firm3", None, None), (None, "d3.com", None), (None, None, "7"), ("Alias 2", None, None), ("Zebra Firm9", None, None), ("Common Word1", "d1.com", "12"), ("T5", None, None)])]
    records = plan.prepare(spark.createDataFrame(r, "record_id string, entity_name string, domain string, cik string"))
    limit = 200
    got = {(x.record_id, x.ord): x.priority for x in blocking.search(records, blocking.index(m, limit), limit).collect()}
    scan = {(x.record_id, x.ord): x.priority for x in search_scan(records, m, limit).collect()}
    assert scan.items() <= got.items() and len(scan) > 100
    few = blocking.search(records, blocking.index(m, 5), 5).where("record_id = '0'").orderBy("rank").collect()
    assert [x.ord for x in few] == [0, 1, 2, 3, 4]  # a frequent token gives the first rows in load order


def test_probes(spark):
    rows = [("a", "N", "1", "L"), ("b", None, "1", None), ("c", "N", None, None), ("d", "N", "1", None)]
    p = blocking.conflict_probes(plan.prepare(spark.createDataFrame(rows, "record_id string, entity_name string, cik string, lei string"))).collect()
    assert sorted((x.owner_id, x.record_id.split("::")[-1]) for x in p) == [("a", "cik"), ("a", "lei"), ("a", "name"), ("d", "cik"), ("d", "name")]


# --- decisions


def test_policies():
    p = scoring.default_policies()
    assert p["exact_cik"].allow_auto_match and not p["exact_name"].allow_auto_match and p["ticker_and_exchange"].require_active_security and p["ticker_only"].review_minimum_score == 0
    own, temporal = scoring.policies_from({"decision_policies": {"exact_name": {"allow_auto_match": True}}, "temporal": {"unknown_behavior": "review"}})
    assert own["exact_name"].allow_auto_match and temporal == {"unknown_behavior": "review"}
    for bad in ({"nope": {}}, {"exact_cik": {"x": 1}}, {"decision_policies": {}, "x": 1}, {"exact_cik": {"minimum_match_score": 0.5}}, {"exact_cik": {"allow_auto_match": "yes"}}):
        with pytest.raises(ValueError):
            scoring.policies_from(bad)
    with pytest.raises(ValueError):
        scoring.Config(relationship_max_depth=33)


def test_decide_at_its_bounds(spark):
    df = spark.createDataFrame([("exact_cik", 0.97999), ("exact_cik", 0.98), ("exact_cik", 0.79), ("exact_name", 1.0), (None, 0.85)], "p string, s double")
    assert [r[0] for r in df.select(scoring.decide(F.col("p"), F.col("s"))).collect()] == ["review_required", "matched", "unmatched", "review_required", "review_required"]
    t = spark.createDataFrame([(True,), (False,)], "a boolean")
    assert [r[0] for r in t.select(scoring.decide(F.lit("ticker_and_exchange"), F.lit(0.99), active=F.col("a"))).collect()] == ["matched", "review_required"]


def test_rule_documents():
    ok = {"id": "a", "conditions": {"country": "US"}, "result": {"entity": {"entity_id": "1"}}}
    assert [r.source for r in rules.rules_of([{**ok, "id": "low", "priority": 1}, {**ok, "id": "off", "enabled": False}, {**ok, "id": "high", "priority": 900}])] == ["rule:high", "rule:low"]
    for bad in ([{**ok, "id": ""}], [ok, ok], [{"id": "x", "conditions": {}}], [{**ok, "valid_from": "2020-01-02", "valid_to": "2020-01-01"}], [ok, {**ok, "id": "b", "result": {"entity": {"entity_id": "2"}}}]):
        with pytest.raises(ValueError):
            rules.rules_of(bad)
    with pytest.raises(ValueError):
        rules.check_override({"pattern": {"cik": "1"}, "action": "match"})


def test_many_rules_decide_as_few_do(spark):
    """The join gives what the compiled plan gives, for every clause, nulls and dates."""
    r = random.Random(8)
    names, sites, ids = ["Acme Inc", "ACME", "Globex & Co", "Nobody"], ["acme.com", "www.acme.com/x", "globex.com"], ["1", "2", None]
    clauses = [
        lambda: ("entity_name", {"exact": r.choice(names)}), lambda: ("entity_name", {"normalized_exact": r.choice(names)}), lambda: ("brand_name", {"normalized_exact_any": r.sample(names, 2)}), lambda: ("domain", {"domain": r.choice(sites)}), lambda: ("country", {"country": r.choice(["Germany", "us"])}),
        lambda: ("country", {"exact_any": ["DE", "US"]}), lambda: ("cik", {"exact": r.choice(ids)}), lambda: ("cik", r.choice(ids)), lambda: ("city", {"exact": None}), lambda: ("entity_name", {"exact": "Acme Inc", "normalized_exact": "acme"}),
    ]
    many = []
    for i in range(90):
        conditions = dict(r.choice(clauses)() for _ in range(r.choice([1, 1, 2, 3])))
        many.append({"id": str(i), "priority": r.randrange(1000), "conditions": conditions if i != 40 else {}, "result": {"entity": {"entity_id": str(i)}}, "action": "match"} | ({"valid_from": "2020-01-01"} if i % 3 == 0 or i == 40 else {}) | ({"valid_to": "2021-01-01"} if i % 5 == 0 else {}))
    own = rules.rules_of(many)
    rows = [(str(i), r.choice([*names, None]), r.choice([*sites, None]), r.choice(ids), r.choice(["DE", "USA", None]), r.choice(["2019-06-01", "2020-06-01", None])) for i in range(150)]
    records = plan.prepare(spark.createDataFrame(rows, "record_id string, entity_name string, domain string, cik string, country string, observation_date string"))
    a, b = ({x.record_id: x.rule for x in rules.decided(records, own, few).collect()} for few in (10**6, 0))
    assert a == b and len({*a.values()}) > 5
    with pytest.raises(ValueError):
        rules.decided(records, rules.rules_of([{"id": "x", "conditions": {"cik": {"like": "1"}}, "result": {}}]), 0)


def test_override_log(tmp_path):
    path = str(tmp_path / "o.jsonl")
    rules.append_override(path, {"pattern": {"cik": "1"}, "action": "unmatched", "reviewer": "a", "reason": "old"})
    rules.append_override(path, {"pattern": {"cik": "1"}, "action": "ambiguous", "reviewer": "b", "reason": "new"})
    log = rules.read_overrides(path)
    assert all(x["created_at"] for x in log) and [r.reason for r in rules.overrides_of(log)] == ["new", "old"]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{')
    with pytest.raises(ValueError, match="line 2"):
        rules.read_overrides(str(tmp_path / "bad.jsonl"))


def test_a_log_that_machines_share(spark, tmp_path):
    folder, item = str(tmp_path / "log"), {"pattern": {"cik": "1"}, "action": "unmatched", "reviewer": "a"}
    for when, reason in (("2024-01-02T00:00:00", "new"), ("2024-01-01T00:00:00", "old")):
        rules.add_override(spark, folder, {**item, "reason": reason, "created_at": when})
    assert [o["reason"] for o in rules.shared_overrides(spark, folder)] == ["old", "new"] and rules.overrides_of(rules.shared_overrides(spark, folder))[0].reason == "new"


def test_listings_become_rows(spark):
    kind = "array<struct<ticker:string,exchange:string,securityId:string>>"
    rows = [(1, "e1", "Example Corp", "EX", [("EXA", "NYSE", "s:a"), ("EXB", "NASDAQ", None)]), (2, "e2", "Plain", "PL", None), (3, "e3", "None", None, [])]
    df = spark.createDataFrame(rows, f"ord long, internal_entity_id string, canonical_name string, ticker string, listings {kind}")
    for given in (df, df.withColumn("listings", F.to_json("listings"))):
        m = master.load(given, "m")
        assert sorted((r.ord >> 20, r.ord % 2**20, r.ticker or "", r.exchange or "", r.listed) for r in m.collect()) == [(1, 0, "EXA", "XNYS", True), (1, 1, "EXB", "XNAS", True), (2, 0, "PL", "", True), (3, 0, "", "", False)]
        assert {r.security_id for r in master.securities(m).where("issuer_id = 'e1'").collect()} > {"s:a"}


# --- reconciliation


def entity(**x):
    base = dict.fromkeys([f.name for f in reconcile.ENTITY])
    return base | {"entity_id": "e", "provider": "p", "rank": 3, "sources": ["p"], "names": ["acme"], "aliases": [], "canonical_name": "Acme", "entity_periods": []} | x


def test_merging_entities():
    same = reconcile.same_entity
    assert not same(entity(cik="1"), entity(cik="2"))
    assert same(entity(cik="1"), entity(cik="1", provider="q"))
    assert not same(entity(cik="1"), entity(cik="1", entity_id="f"))
    assert not same(entity(cik="1"), entity(cik="1", provider="q", names=["zebra"]))
    assert same(entity(cik="1"), entity(lei="2", provider="q")) and not same(entity(cik="1"), entity(provider="q"))
    assert same(entity(ticker="T"), entity(ticker="T", provider="q")) and same(entity(domain="d"), entity(domain="d"))
    a, b = entity(rank=4, provider="x", sources=["x"], city="c"), entity(rank=2, provider="y", sources=["y"], entity_id="best")
    for pair in ((a, b), (b, a)):
        m = reconcile.merge_entities(*pair)
        assert (m["entity_id"], m["sources"], m["city"]) == ("best", ["y", "x"], "c")


def test_merging_securities():
    s = lambda **x: dict.fromkeys([f.name for f in reconcile.SECURITY]) | {"issuer_id": "i", "rank": 3, "sources": ["p"], "security_periods": []} | x
    same = reconcile.same_security
    assert same(s(figi="1"), s(figi="1")) and not same(s(figi="1"), s(figi="2")) and same(s(ticker="T", exchange="US"), s(ticker="T", exchange="XNAS")) and not same(s(ticker="T", exchange="A"), s(ticker="T", exchange="B"))
    assert not same(s(ticker="T"), s(ticker="T", issuer_id="j", issuer_name="zebra"))


# --- the whole plan


RECORDS = "record_id string, entity_name string, brand_name string, domain string, ticker string, exchange string, cik string, lei string, observation_date string"
GIVEN = [
    ("match", "Acme Widgets", None, "acme.com", "ACM", "NASDAQ", None, None, "2020-01-01"), ("subsidiary", "Acme Tools", None, None, None, None, "124", None, "2020-01-01"), ("alias", "GX", None, None, None, None, None, None, None),
    ("unknown", "Nobody Knows", None, None, None, None, None, None, "2020-01-01"), ("crossed", "Globex", None, None, None, None, "123", None, "2020-01-01"), ("brand", None, "Globex", "globex.com", None, None, None, None, None),
    ("two-ids", None, None, None, None, None, "123", "LEI3", None), ("early", "Acme Widgets", None, "acme.com", None, None, None, None, "1990-01-01"), ("shared", None, None, None, "DUP", None, None, None, None), ("undated-listing", "Globex", None, "globex.com", "GLX", "NYSE", None, None, "2020-01-01"),
    ("ruled", "Ruled Ltd", None, None, None, None, None, None, "2020-01-01"), ("vague", "Vague", None, None, None, None, None, None, None),
]
FORCED = [
    {"id": "r1", "version": "7", "conditions": {"entity_name": {"normalized_exact": "ruled"}}, "result": {"entity": {"entity_id": "x", "canonical_name": "Ex", "entity_type": "issuer"}, "valid_from": "1980-01-01", "public_parent": {"entityId": "top", "canonicalName": "Top"}}},
    {"id": "r2", "action": "ambiguous", "conditions": {"entity_name": "Vague"}, "result": {}},
]


@pytest.fixture(scope="module")
def resolved(spark, entities):
    source = plan.Source("master", entities, master.edges(entities), "supporting", frozenset(master.capabilities(MASTER.replace(" string", "").replace(" long", "").split(", "))))
    return plan.resolve(spark.createDataFrame(GIVEN, RECORDS), [source], forced=rules.rules_of(FORCED)).cache()


def test_resolution(resolved):
    got = {r.record_id: r for r in resolved.collect()}
    short = {k: (r.status, r.entity_status, r.entity_id, r.pathway, r.parent_status, r.security_status, r.overall_scope.status) for k, r in got.items()}
    assert short["match"] == ("matched", "matched", "e1", "ticker_and_exchange", "not_applicable", "matched", "verified")
    assert short["subsidiary"][:6] == ("review_required", "matched", "e2", "exact_cik", "candidate", "not_applicable") and got["subsidiary"].parent_id == "e1"
    assert short["alias"][:4] == ("review_required", "review_required", "e3", "exact_name") and got["alias"].confidence == 0.82
    assert short["unknown"][:3] == ("unmatched", "unmatched", None)
    assert short["crossed"][1:3] == ("review_required", "e1") and "exact_name_identifier_conflict" in [e.type for e in got["crossed"].evidence]
    assert short["brand"][3] == "brand_inference" and short["brand"][0] == "review_required"
    assert "identifier_conflict" in [e.type for e in got["two-ids"].evidence] and short["two-ids"][0] == "review_required"
    assert short["early"][0] == "review_required" and short["early"][6] == "invalid"
    assert short["shared"][5] == "review_required" and len(got["shared"].security_ranked) == 2
    assert short["undated-listing"][:2] == ("review_required", "matched") and short["undated-listing"][5] == "review_required"
    assert short["ruled"][:4] == ("matched", "matched", "x", "customer_rule") and got["ruled"].decision_source == "rule:r1" and got["ruled"].decision_version == "7"
    assert got["ruled"].parent_status == "verified" and got["ruled"].parent_id == "top"
    assert short["vague"][0] == "review_required" and got["vague"].decision_source == "rule:r2"


def test_fuzzy_names_against_brute_force(spark):
    """Names with faults, scored by difflib over every row that shares a word: the whole path from blocking to confidence and pathway."""
    r = random.Random(10)
    words = ["acme", "widget", "global", "tools", "north", "energy", "foods", "marine", "atlas", "paper"]
    masters = sorted({" ".join(r.sample(words, r.choice([2, 3]))) for _ in range(60)})
    m = master.load(spark.createDataFrame([(i, f"e{i}", None, n, "legal_entity", None, None, None, None, None, None, None, None, None, None, None) for i, n in enumerate(masters)], MASTER), "m")
    asked = []
    for n in r.sample(masters, 25):
        at = r.randrange(1, len(n) - 1)
        asked += [n, n[:at] + n[at + 1 :], f"{n} {r.choice(words)}", " ".join(reversed(n.split()))]
    records = spark.createDataFrame([(str(i), n) for i, n in enumerate(asked)], "record_id string, entity_name string")
    got = {x.record_id: x for x in plan.resolve(records, [plan.Source("m", m)], plan.Settings(scoring.Config(max_candidates=200))).collect()}
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    kinds = set()
    for i, n in enumerate(asked):
        own, best = set(n.split()), (0.0, 0.0, -1)
        for k, other in enumerate(masters):
            its = set(other.split())
            if n.split()[0] in its or (n not in masters and own & its):
                alike = 1.0 if n == other else max(ratio(n, other), len(own & its) / len(own | its), ratio(" ".join(sorted(own)), " ".join(sorted(its))))
                points = 50 if n == other else 35 * alike if alike >= 0.75 else 0
                score = round(min(max(points / 100, 0.82 if n == other else 0), 1.0 if n == other else 0.89), 4)
                best = max(best, (score, alike if points else 0.0, -k))
        x = got[str(i)]
        assert x.confidence == pytest.approx(best[0], abs=1e-4)
        want = "exact_name" if best[1] == 1.0 else "fuzzy_name_only" if best[1] else "unknown"
        assert x.pathway == want or best[0] == 0
        kinds.add(want)
    assert kinds == {"exact_name", "fuzzy_name_only", "unknown"}


def test_components_and_exports(spark, resolved, tmp_path):
    v2 = results.v2(resolved).cache()
    got = {r.record_id: r for r in v2.collect()}
    assert got["match"].final_decision == "entity_and_security_matched" and got["unknown"].final_decision == "unmatched" and got["early"].final_decision == "temporal_verification_required"
    assert got["subsidiary"].final_decision == "entity_matched_parent_candidate" and got["crossed"].final_decision == "ambiguous" and got["crossed"].entity.canonical_id is None and got["crossed"].review_reasons
    assert {r.record_id for r in results.with_decision(v2, ["matched"]).collect()} == {r for r, x in got.items() if x.final_decision in results.GROUPS["matched"]}
    assert results.legacy(v2).count() == len(GIVEN)
    sinks.write(v2, str(tmp_path / "out.parquet"))
    with pytest.raises(Exception, match="already exists"):
        sinks.write(v2, str(tmp_path / "out.parquet"))
    sinks.write(v2, str(tmp_path / "out.parquet"), overwrite=True)
    assert spark.read.parquet(str(tmp_path / "out.parquet")).count() == len(GIVEN)
    sinks.export(v2, str(tmp_path / "out.csv"), source=spark.createDataFrame([("match", "=1+1")], "record_id string, note string"))
    assert [r.note for r in spark.read.csv(str(tmp_path / "out.csv"), header=True).collect()] == ["'=1+1"]
    sinks.write(v2, str(tmp_path / "out.jsonl"))
    with pytest.raises(ValueError):
        sinks.write(v2, str(tmp_path / "out.xlsx"))
    assert evaluate.job_metrics(v2).where("metric = 'final_decision'").agg(F.sum("records")).first()[0] == len(GIVEN)


def test_sources_that_fail_or_may_not_claim(spark, entities):
    rows = spark.createDataFrame([("a", "Acme Widgets", "acme.com", "2020-01-01", "ACM", "NASDAQ"), ("b", "Nobody", None, None, None, None)], "record_id string, entity_name string, domain string, observation_date string, ticker string, exchange string")
    undated = plan.Source("master", entities, None, "supporting", frozenset({"entity_lookup"}))
    got = {r.record_id: r for r in plan.resolve(rows, [undated, plan.Source("down", error="timeout")]).collect()}
    assert got["a"].overall_scope.status == "not_verified" and {"provider_capability_rejected", "provider_disagreement"} <= {e.type for e in got["a"].evidence} and got["b"].status == "unmatched"
    assert "provider_capability_rejected" in {e.type for e in got["a"].security_evidence}
    got = results.v2(plan.resolve(rows, [plan.Source("down", error="timeout")])).collect()
    assert {r.final_decision for r in got} == {"provider_error"}


def test_one_entity_of_two_sources_has_one_node(spark, entities):
    """A second source knows e3 by its LEI under another id, with a parent; a third fails; a fourth says why a parent is missing."""
    rows = [(1, "x:3", None, "Globex Corporation", "issuer", None, None, None, None, "LEI3", "globex.com", "DE", None, "x:top", None, None), (2, "x:top", None, "Globex Top", "legal_entity", None, None, None, None, "LEI9", None, None, None, None, None, None)]
    other = master.load(spark.createDataFrame(rows, MASTER), "x")
    e = graph.identities(entities.select("provider", "entity_id", "lei", "cik", F.lit(2).alias("rank")).unionByName(other.select("provider", "entity_id", "lei", "cik", F.lit(3).alias("rank"))))
    assert {(r.provider, r.entity_id): r.node for r in e.where("provider = 'x'").collect()} == {("x", "x:3"): "e3", ("x", "x:top"): "x:top"}
    chain = spark.createDataFrame([(p, f"{p}{i}", f"L{i}" if i else None, f"C{i}", 1) for i in range(3) for p in "abc"] + [("d", "d", "L1", "C2", 1)], "provider string, entity_id string, lei string, cik string, rank int")
    assert {(r.node, r.entity_id) for r in graph.identities(chain).collect()} == {("a0", f"{p}0") for p in "abc"} | {("a1", f"{p}{i}") for p in "abc" for i in (1, 2)} | {("a1", "d")}
    missing = spark.createDataFrame([("e1", "direct", "NO_LEI", "NATURAL_PERSONS")], "entity_id string, level string, category string, reason string")
    good = plan.Source.open("master", lambda: {"entities": entities, "edges": master.edges(entities), "exceptions": missing}, "authoritative", frozenset({"entity_lookup"}))
    bad = plan.Source.open("down", lambda: {"entities": entities.select(F.raise_error(F.lit("no answer")).alias("x"))})
    sources = [good, plan.Source.open("x", lambda: {"entities": other, "edges": master.edges(other)}, "supporting", frozenset({"entity_lookup"})), bad]
    assert [(r.name, r.healthy, r.entities) for r in plan.source_health(spark, sources).collect()] == [("master", True, 5), ("x", True, 2), ("down", False, None)] and "no answer" in bad.error
    rows = spark.createDataFrame([("a", "Globex", "125", "LEI3"), ("b", "Acme Widgets", "123", None)], "record_id string, entity_name string, cik string, lei string")
    got = {r.record_id: r for r in plan.resolve(rows, sources).collect()}
    assert (got["a"].entity_id, got["a"].parent_id, got["a"].parent_status) == ("e3", "x:top", "candidate")
    assert got["b"].relationship_status == "not_reported" and {"relationship_reporting_exception", "relationship_resolution_error"} <= {x.type for x in got["b"].parent_evidence}
    assert "provider_disagreement" in {x.type for x in got["b"].evidence}


def test_old_rows_migrate_with_care(spark):
    e = lambda t, d: (t, None, None, 1.0, None, None, d)
    rows = [("a", "matched", ("e", "E"), ("p", "P"), "s", [e("security_identifier_match", "figi")]), ("b", "matched", ("e", "E"), (None, None), "s", [e("name_similarity", None)]), ("c", "unmatched", (None, None), (None, None), None, [])]
    df = spark.createDataFrame(rows, f"recordId string, status string, matchedEntity struct<entityId:string,canonicalName:string>, publicParent struct<entityId:string,canonicalName:string>, securityId string, evidence {scoring.EVIDENCE}")
    got = {r.record_id: (r.entity_status, r.parent_status, r.security_status, r.final_decision) for r in results.from_legacy(df).collect()}
    assert got == {"a": ("verified", "candidate", "verified", "entity_matched_parent_candidate"), "b": ("verified", "unknown", "candidate", "review_required"), "c": ("unknown", "unknown", "not_applicable", "unmatched")}


# --- parents


def test_acquisition(spark):
    rows = [(1, "r1", "brand", "old", "brand_of", None, "2015-12-31"), (2, "r2", "brand", "new", "brand_of", "2016-01-01", None), (3, "r3", "new", "top", "subsidiary_of", None, None), (4, "r4", "top", "ring", "owned_by", None, None), (5, "r5", "ring", "top", "owned_by", None, None)]
    p = relationships.parse(spark.createDataFrame(rows, "row long, relationship_id string, child_entity_id string, parent_entity_id string, relationship_type string, valid_from string, valid_to string"))
    assert {(r.row, r.code) for r in relationships.validate(p).collect()} == {(4, "parent_cycle"), (5, "parent_cycle")}
    edges = graph.ready(relationships.edges(p), "authoritative", True)
    s = spark.createDataFrame([("brand", day("2010-06-01")), ("brand", day("2020-06-01")), ("nobody", None)], "subject string, day date").withColumn("subject_type", F.lit("legal_entity"))
    got = {(r.subject, str(r.day)): (r.parent_status, r.chain.ids, r.chain.cycle) for r in graph.resolve_parents(s, edges).collect()}
    assert got["brand", "2010-06-01"] == ("verified", ["brand", "old"], False)
    assert got["brand", "2020-06-01"] == ("verified", ["brand", "new", "top", "ring"], True)
    assert got["nobody", "None"][0] == "unknown"
    short = graph.resolve_parents(s, edges, 1).where("day = '2020-06-01'").first()
    assert short.chain.ids == ["brand", "new"] and short.relationship_status == "partial"


def _edges(spark, of):
    """(subject, direct) from subject: [(from, to, rank, trust, type)]."""
    rows = [(k, e) for k, es in of.items() for e in sorted(es, key=lambda e: (e[2], e[4], e[1]))]
    df = spark.createDataFrame([(k, i, *e, "source") for i, (k, e) in enumerate(rows)], "subject string, i int, from_id string, to_id string, rank int, trust string, type string, source string")
    return df.groupBy("subject").agg(F.sort_array(F.collect_list(F.struct("i", "from_id", "to_id", "rank", "trust", "type", "source"))).alias("direct"))


def test_parents_of_graphs_equal_those_of_all_paths(spark):
    r = random.Random(41)
    of = {}
    for k in range(120):
        n, way = r.randrange(2, 8), r.random() < 0.7
        pairs = {(r.randrange(n), r.randrange(n)) for _ in range(r.randrange(1, 12))}
        pairs = {(min(p), max(p)) for p in pairs if p[0] != p[1]} if way else {p for p in pairs if p[0] != p[1]}  # most lead one way
        of[f"{k}:0"] = [(f"{k}:{a}", f"{k}:{b}", r.randrange(2, 5), r.choice(["authoritative", "supporting"]), r.choice(["BRAND", "owned_by"])) for a, b in pairs] or [("x", "y", 2, "supporting", "owned_by")]
    df = _edges(spark, of)
    for depth in (2, 8):
        d, k = F.col("direct"), F.col("subject")
        got = df.select(graph.best_parents(d, k, depth).alias("a"), graph.parents(graph.paths(d, k, depth)).alias("b"), graph.acyclic(d, depth).alias("one_way")).collect()
        assert all(x.a == x.b for x in got) and 20 < sum(x.one_way for x in got) < 120


def test_a_tower_of_diamonds_has_one_parent(spark):
    """2 to the 20th paths."""
    name = lambda i: "s" if i == 0 else f"n{i}"
    edges = [e for i in range(20) for side in "lr" for e in ((name(i), f"{side}{i}", 2, "authoritative", "owned_by"), (f"{side}{i}", name(i + 1), 3 if side == "l" else 2, "authoritative", "owned_by"))]
    x = _edges(spark, {"s": edges}).select(graph.best_parents(F.col("direct"), F.col("subject"), 40).alias("p")).first().p
    assert [(p.parent_id, p.direct_id, p.unverified, p.rank) for p in x] == [("n20", "l0", 0, 2)]  # the first step is the least of those that lead there equally well


def test_records_that_share_nothing_are_folded_by_expressions(spark):
    """The same as the fold in Python gives, of candidates of all kinds."""
    from pyspark.sql.pandas.types import from_arrow_type

    r = random.Random(43)
    pick = lambda p, i: r.choice([None, f"{p}{i}", f"{p}{r.randrange(3)}"])
    rows = []
    for k in range(150):
        for o in range(r.randrange(1, 4)):
            e = dict.fromkeys(f.name for f in reconcile.ENTITY) | {"entity_id": f"e{k}.{o}", "provider": r.choice("pq"), "rank": r.randrange(2, 5), "sources": ["p"], "names": [f"name {r.randrange(50)}"], "aliases": [], "entity_periods": [], **{f: pick(f, o + 10) for f in ("cik", "lei", "ticker", "domain")}}
            s = [dict.fromkeys(f.name for f in reconcile.SECURITY) | {"security_id": f"s{k}.{o}.{i}", "issuer_id": r.choice([f"e{k}.{o}", f"e{k}.0", "other"]), "issuer_cik": e["cik"], "issuer_name": r.choice([None, e["names"][0]]), "rank": 2, "sources": ["p"], "security_periods": [], **{f: pick(f, o * 5 + i + 10) for f in ("figi", "ticker", "exchange")}} for i in range(r.randrange(0, 3))]
            rows.append((str(k), o, e, s))
    kind = f"record_id string, ordinal int, entity {from_arrow_type(reconcile.ENTITY).simpleString()}, securities array<{from_arrow_type(reconcile.SECURITY).simpleString()}>"
    df = spark.createDataFrame([(k, o, tuple(e.values()), [tuple(x.values()) for x in s]) for k, o, e, s in rows], kind)
    got = {x.record_id: x.asDict(True) for x in reconcile.reconcile(df).collect()}
    apart = {x.record_id for x in reconcile.grouped(df).where("apart").collect()}
    assert 15 < len(apart) < 140 and len(got) == 150
    for k in got:
        assert got[k] == reconcile._merged([{"record_id": k, "entity": e, "securities": s} for i, _, e, s in rows if i == k]), k


def test_cycles_against_brute_force(spark):
    """Long rings, rings that lines lead to and from, meeting rings, and random graphs."""
    r = random.Random(12)
    graphs = [[(i, (i + 1) % 90) for i in range(90)] + [(100 + i, 101 + i) for i in range(30)] + [(130, 0), (5, 200), (200, 201)], [(0, 0), (1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 3), (5, 5)]]
    graphs += [[(r.randrange(n), r.randrange(n)) for _ in range(m)] for n, m in ((6, 8), (12, 14), (25, 30), (30, 33))]
    rows, want = [], set()
    for g, edges in enumerate(graphs):
        reach = {v: {p for c, p in edges if c == v} for v in {x for e in edges for x in e}}
        for k in list(reach):
            for v in reach:
                if k in reach[v]:
                    reach[v] = reach[v] | reach[k]
        for c, p in edges:
            if c in reach[p]:
                want.add(len(rows))
            rows.append((len(rows), str(len(rows)), f"{g}:{c}", f"{g}:{p}", "owned_by"))
    df = spark.createDataFrame(rows, "row long, relationship_id string, child_entity_id string, parent_entity_id string, relationship_type string")
    assert sorted(x.row for x in relationships.cycles(relationships.usable(relationships.parse(df))).collect()) == sorted(want)


def test_long_rings_and_lines(spark):
    """A ring of 100,000, a line of 100,000 that leads to it, a tree, and two rings of 1,500 that meet: rows stay linear and rounds few."""
    i = F.col("id")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    n, m = 100_000, 1_500
    edges = spark.range(n).select(name("r", i).alias("c"), name("r", (i + 1) % n).alias("p"), F.lit(True).alias("on"))
    edges = edges.union(spark.range(n).select(name("l", i), F.when(i < n - 1, name("l", i + 1)).otherwise(F.lit("r5")), F.lit(False))).union(spark.range(1, 2_000).select(name("t", i), name("t", i.cast("long") / 2 - (i % 2) / 2), F.lit(False)))
    for k in "ab":
        edges = edges.union(spark.range(m).select(F.when(i == 0, F.lit("both")).otherwise(name(k, i)), F.when(i == m - 1, F.lit("both")).otherwise(name(k, i + 1)), F.lit(True)))
    rows = edges.select(F.monotonically_increasing_id().alias("row"), F.lit("x").alias("relationship_id"), F.col("c").alias("child_entity_id"), F.col("p").alias("parent_entity_id"), F.lit("owned_by").alias("relationship_type"), "on")
    rows = cut(rows)
    found = relationships.cycles(rows).select("row").distinct()
    assert found.count() == n + 2 * m and found.join(rows.where("not on"), "row").isEmpty()


def test_overlaps_against_brute_force(spark):
    """All ways of open, equal, touching and inverted periods; keys of few and of many rows."""
    r = random.Random(13)
    date = lambda: None if r.random() < 0.15 else datetime.date(2000, 1, 1) + datetime.timedelta(r.choice([0, 1, 31, 32, 63, 64, 1000, r.randrange(1200)]))
    rows = [(k, r.choice("aab"), date(), date(), "x") for k in range(160)]
    df = spark.createDataFrame(rows, "row long, key string, f date, t date, note string")
    low, high = datetime.date(1, 1, 1), datetime.date(9999, 12, 31)
    want = {(a[1], a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and max(a[2] or low, b[2] or low) <= min(a[3] or high, b[3] or high)}
    assert len(want) > 500
    for few in (0, 60, 10**6):
        got = [(x.key, x.l_row, x.r_row) for x in relationships.interval_pairs(df, ["key"], "f", "t", "row", few).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_child_of_very_many_periods_costs_its_output(spark):
    """50,000 periods of one child, of which ten overlap the next: no pairs are made but those."""
    i = F.col("id")
    start = lambda i: F.date_add(F.lit("1700-01-01").cast("date"), (i % 50_000).cast("int") * 2)
    rows = spark.range(50_000).select(i.alias("row"), F.lit("k").alias("key"), start(i).alias("f"), F.date_add(start(i), F.when(i % 5_000 == 7, 2).otherwise(1)).alias("t"))
    plan = relationships.interval_pairs(cut(rows), ["key"], "f", "t", "row")
    assert sorted((x.l_row, x.r_row) for x in plan.collect()) == [(k, k + 1) for k in range(7, 50_000, 5_000)]


def test_bad_relationships(spark):
    rows = [(1, None, "a", "b", "owned_by", "x", None, "1"), (2, "r", "a", "a", "none", None, None, "101"), (3, "s", "a", "b", "minority_owned_by", None, None, "60"), (4, "t", "a", "c", "owned_by", None, None, None), (5, "t", "a", "d", "owned_by", None, None, None)]
    p = relationships.parse(spark.createDataFrame(rows, "row long, relationship_id string, child_entity_id string, parent_entity_id string, relationship_type string, valid_from string, valid_to string, ownership_percentage string"))
    codes = {r.code for r in relationships.validate(p, spark.createDataFrame([("a",)], "entity_id string")).collect()}
    assert codes >= {"missing_identifier", "invalid_period", "self_reference", "invalid_relationship_type", "invalid_ownership_percentage", "minority_control_conflict", "duplicate_relationship_id", "overlapping_parent_periods", "unknown_entity_reference"}
    assert relationships.mapping_of({"kid": "child_entity_id"}) == {"child_entity_id": "kid"}
    with pytest.raises(ValueError):
        relationships.mapping_of({"kid": "nothing"})


def test_master_faults(spark):
    bad = [(1, "e", "s", "A", "issuer", None, None, "F", None, "L", None, None, None, None, "2020-01-02", None), (2, "e", "s", "B", "issuer", None, None, "F", None, None, None, None, None, None, None, None), (3, "f", None, "", "issuer", None, None, None, None, "L", None, None, None, None, None, None), (4, "f", None, "", "issuer", None, None, None, None, None, None, None, None, None, None, None)]
    codes = {r.code for r in master.issues(master.load(spark.createDataFrame(bad, MASTER), "m")).collect()}
    assert codes == {"missing_name", "conflicting_entity", "duplicate_security", "duplicate_figi", "duplicate_lei", "duplicate_entity_row"}


# --- files


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿source_id;merchant_name;event_dt\n1;Acmé;2020-01-01\n2;;x\n".encode())
    rows = files.read(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["source_id", "merchant_name", "event_dt"] and rows.count() == 2
    assert {r.column: r.null_rate for r in files.profile(rows).collect()} == {"source_id": 0, "merchant_name": 0.5, "event_dt": 0}
    mapping, pattern, _ = files.load_mapping(None, rows.columns)
    assert mapping == {"source_id": "recordId", "merchant_name": "entityName", "event_dt": "observationDate"} and pattern is None
    r = files.apply_mapping(rows.withColumn("row", F.col("source_id").cast("long")), mapping, "a.csv", "row")
    with pytest.raises(files.IngestionError, match="for a date"):
        files.preflight(r)
    (tmp_path / "b.json").write_text(json.dumps({"records": [{"a": 1}, {"b": "x"}]}))
    (tmp_path / "c.jsonl").write_text('{"a": 1}\n\n{"b": "x"}\n')
    (tmp_path / "d.json").write_text(json.dumps([{"a": 1}, {"b": "x"}]))
    for name in ("b.json", "c.jsonl", "d.json"):
        assert {tuple(x) for x in files.read(spark, str(tmp_path / name)).select("a", "b").collect()} == {(1, None), (None, "x")}
    for name, text in (("e.csv", "a,a\n1,2\n"), ("f.csv", "a,\n1,2\n"), ("g.csv", "a,b\n1,2\n3\n"), ("h.csv", "a,b\n1,2,3\n"), ("i.csv", ""), ("j.csv", 'a,b,c\n1,2,3\n"x,y",z\n'), ("k.csv", 'a,b,c\n1,2,3\n"x\ny",z\n')):
        (tmp_path / name).write_text(text)
        with pytest.raises(files.IngestionError):
            files.read(spark, str(tmp_path / name))
    for name in "gjk":
        with pytest.raises(files.IngestionError, match="Data row 2 "):
            files.read(spark, str(tmp_path / f"{name}.csv"))
    with pytest.raises(files.IngestionError):
        files.read(spark, str(tmp_path / "x.xlsx"))


def test_encodings_and_separators(spark, tmp_path):
    """Of large files too, whose letters beyond ASCII come early, late, or at the first block's end."""
    many = "".join(f"{i};plain\n" for i in range(9000))
    edge = "id;name\n" + "x" * ((1 << 16) - 9) + "é;b\n"  # é lies over the end of the first block
    cases = {"early": ("id;name\n0;Société\n1;€ Ž\n" + many, "cp1252"), "late": ("id;name\n" + many + "0;Société\n", "cp1252"), "utf": ("id;name\n0;Société\n" + many, "utf-8"), "late_utf": ("id;name\n" + many + "0;Société\n", "utf-8"), "edge": (edge, "utf-8")}
    cases["both"] = ("id;name\n5;" + "\u00c3\u00a9" + "\n" + many + "0;Société\n", "cp1252")  # its first letters look like UTF-8
    for name, (text, encoding) in cases.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode(encoding))
        assert files.sniff(spark, str(tmp_path / f"{name}.csv")) == ("windows-1252" if encoding == "cp1252" else "utf-8", ";"), name
        if name != "edge":
            assert files.read(spark, str(tmp_path / f"{name}.csv")).where("id = '0' and name = 'Société'").count() == 1
    assert files.read(spark, str(tmp_path / "early.csv")).where("name = '€ Ž'").count() == 1
    (tmp_path / "bad.csv").write_bytes(b"a,b\n\x81,\xff\n")
    with pytest.raises(files.IngestionError):
        files.read(spark, str(tmp_path / "bad.csv"))
    assert [files.separator_of(t) for t in ("a,b\n1,2", "a\tb,c\td\n1\t2\t3", "a;b\n1,5;2,5", "a|b", "alone", '"a;b;c",d\n1,2')] == [",", "\t", ";", "|", ",", ","]
    (tmp_path / "quoted.csv").write_text('id,name\n1,"two\nlines"\n2,b\n')
    assert [r.name for r in files.read(spark, str(tmp_path / "quoted.csv")).orderBy("id").collect()] == ["two\nlines", "b"]
    facts = files.facts(spark, str(tmp_path / "quoted.csv")).first()
    assert facts.length == 26 and facts.sha256 == hashlib.sha256((tmp_path / "quoted.csv").read_bytes()).hexdigest() and files.facts(spark, str(tmp_path / "quoted.csv"), 5).first().sha256 is None


def test_cells_over_lines_in_splits_equal_the_csv_module(spark, tmp_path):
    """Records of every size over the ends of splits, doubled and stray quotes, both line ends, both encodings; read by several tasks."""
    import csv

    r = random.Random(31)
    cells = ["", "plain", "two\nlines", 'says ""hi""', "a;b", "\n\n", 'end"', "é", "x" * 300, "many\n" * 40, '"', "\r\nback"]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, size in enumerate((700, 3000, 64_000)):
            encoding, end = ("utf-8", "\n") if k % 2 else ("cp1252", "\r\n")
            with open(tmp_path / f"q{k}.csv", "w", encoding=encoding, newline="") as f:
                w = csv.writer(f, delimiter=";", lineterminator=end)
                w.writerow(["a", "b\nb", "c"])
                for i in range(400):
                    w.writerow([i, r.choice(cells), r.choice(cells)])
                f.write(f'400;in"ner;5" pipe{end}{end}401;"q"r;{end}402;"last\n";z')
            with open(tmp_path / f"q{k}.csv", encoding=encoding, newline="") as f:
                want = [[c or None for c in row] for row in csv.reader(f, delimiter=";") if row][1:]
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            got = files.read(spark, str(tmp_path / f"q{k}.csv"))
            assert got.columns == ["a", "b\nb", "c"] and (size > 3000 or got.rdd.getNumPartitions() > 4)
            assert [list(x) for x in files.numbered(got, "row").orderBy("row").select("a", "`b\nb`", "c").collect()] == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_rows_are_numbered_without_gaps(spark):
    rows = spark.range(100, numPartitions=7).where("id % 3 <> 0 and id not between 20 and 45")
    got = [(r.id, r.n) for r in files.numbered(rows, "n").orderBy("n").collect()]
    assert [n for _, n in got] == list(range(1, len(got) + 1)) and [i for i, _ in got] == sorted(i for i, _ in got)
    assert files.numbered(rows.where("false"), "n").count() == 0


def test_results_replace_others_only_when_complete(spark, tmp_path):
    path, rows = str(tmp_path / "r.json"), spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    sinks.write(rows, path)
    read = lambda: json.loads("".join(x.read_text() for x in sorted((tmp_path / "r.json").glob("part-*"))))
    assert read() == [{"i": 1, "s": "a"}, {"i": 2, "s": None}]
    broken = rows.select(F.raise_error(F.lit("no")).cast("int").alias("i"))
    with pytest.raises(Exception, match="no"):
        sinks.write(broken, path, overwrite=True)
    assert len(read()) == 2 and [x.name for x in tmp_path.iterdir()] == ["r.json"]
    sinks.write(rows.where("false"), path, overwrite=True)
    assert read() == [] and [x.name for x in tmp_path.iterdir()] == ["r.json"]
    sinks.write(rows, str(tmp_path / "r.csv"))
    assert all(x.read_bytes().startswith(b"\xef\xbb\xbfi,s") for x in (tmp_path / "r.csv").glob("part-*")) and spark.read.csv(str(tmp_path / "r.csv"), header=True).columns == ["i", "s"]


def test_mappings():
    assert len(files.mapping_faults({"x": "nothing", "a": "country", "b": "country"}, ["a", "b"])) == 4
    for bad in ({}, {"x": "entityName"}, {"a": "nothing"}, {"a": "domain", "b": "domain"}, {"a": "country"}):
        with pytest.raises(files.IngestionError):
            files.validate_mapping(bad, ["a", "b"])
    files.validate_mapping({"a": "entityName", "b": "ignore"}, ["a"])


# --- evaluation, snapshots, cases


def test_evaluation(spark):
    r = spark.createDataFrame([("1", "matched", 0.9, ["a"], 1.0), ("2", "unmatched", 0.2, [], 2.0), ("3", "unmatched", 0.1, [], 3.0), ("4", "unmatched", 0.0, ["x"], 4.0)], "record_id string, status string, confidence double, ranked_ids array<string>, duration_ms double")
    t = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None), ("4", None)], "record_id string, expected_entity_id string")
    j = evaluate.judged(r, t)
    h = evaluate.headline(j).first()
    assert (h.unmatched_precision, h.negative_recall, h.false_rejection_rate, h.top_1_accuracy) == (0.6667, 1.0, 0.5, 0.5)
    x = j.agg(*evaluate.latency()).first()
    assert (x.median_ms, x.p95_ms) == (2.5, 4.0)
    with pytest.raises(ValueError):
        evaluate.judged(r, t.where("record_id <> '4'"))
    assert "<table>" in evaluate.report(h.asDict(), [{"a": 1}])


def test_snapshots(spark):
    lei = {"data": [{"id": "L1", "attributes": {"lei": "L1", "entity": {"legalName": {"name": "Acme GmbH"}, "otherNames": [{"name": "AG"}], "legalAddress": {"country": "DE", "city": "Ulm", "addressLines": ["1 St"]}, "status": "ACTIVE", "creationDate": "2001-02-03T00:00:00Z"}}}]}
    up = {"data": {"id": "x", "attributes": {"relationship": {"startNode": {"id": "L1"}, "endNode": {"id": "L2"}, "relationshipPeriods": [{"periodType": "OTHER", "startDate": "1990-01-01"}, {"periodType": "RELATIONSHIP_PERIOD", "startDate": "2010-01-01T00:00:00Z"}]}}}}
    sub = {"cik": "42", "name": "Sub Inc", "tickers": ["A", "B"], "exchanges": ["NYSE", "Nasdaq"], "formerNames": [{"name": "Old"}]}
    index = {"fields": ["cik", "name", "ticker", "exchange"], "data": [[42, "Sub Inc", "A", "NYSE"], [43, "Subway Holdings", "S", "NYSE"]]}
    figi = {"data": [{"figi": "BBG1", "name": "SUB", "ticker": "A", "exchCode": "US", "shareClassFIGI": "SC"}]}
    a = lambda v, t="q", k="L1": spark.createDataFrame([("p", t, k, json.dumps(v))], "provider string, query_type string, cache_key string, value string")
    e = master.load(snapshots.gleif_entities(a(lei)).withColumn("ord", F.lit(1)), "gleif").first()
    assert (e.entity_id, e.names, e.country, e.lei, e.entity_periods[0].valid_from) == ("gleif:L1", ["acme"], "DE", "L1", day("2001-02-03"))
    edge = snapshots.gleif_edges(a(up, "direct-parent")).first()
    assert (edge.from_id, edge.to_id, edge.valid_from, edge.level, edge.type) == ("gleif:L1", "gleif:L2", day("2010-01-01"), "direct", "IS_DIRECTLY_CONSOLIDATED_BY")
    assert sorted((r.ticker, r.exchange, r.cik) for r in snapshots.sec_submissions(a(sub)).collect()) == [("A", "NYSE", "0000000042"), ("B", "Nasdaq", "0000000042")]
    found = snapshots.sec_name_matches(plan.prepare(spark.createDataFrame([("1", "Sub", None), ("2", "x", "S")], "record_id string, entity_name string, ticker string")), snapshots.sec_index(a(index))).collect()
    assert sorted((r.record_id, r.internal_entity_id[-2:], r.kind) for r in found) == [("1", "42", 1), ("1", "43", 2), ("2", "43", 0)]
    short = snapshots.sec_name_matches(plan.prepare(spark.createDataFrame([("1", "ge"), ("2", "x y"), ("3", "b")], "record_id string, entity_name string")), spark.createDataFrame([("a", "GE Capital", None), ("b", "Bridge", None), ("c", "Y", None), ("d", "Zzz", None)], "internal_entity_id string, canonical_name string, ticker string")).collect()
    assert sorted((r.record_id, r.internal_entity_id, r.kind) for r in short) == [("1", "a", 2), ("1", "b", 2), ("2", "c", 2), ("3", "b", 2)]
    f = snapshots.figi_entities(a(figi, k="ID_ISIN:US1")).first()
    assert (f.internal_entity_id, f.figi, f.isin) == ("openfigi:SC", "BBG1", "US1")


def test_names_inside_others(spark):
    r = random.Random(9)
    words = ["ge", "x", "capital", "bridge", "cap", "the", "com", "comma", "y"]
    a, b = ([" ".join(r.sample(words, r.choice([1, 1, 2, 3]))) for _ in range(60)] for _ in range(2))
    frame = lambda names: spark.createDataFrame([(n,) for n in [*names, None, ""]], "n string")
    got = sorted((x.i, x.o) for x in snapshots.containment(frame(a), frame(b)).collect())
    assert got == sorted({(i, o) for i in a for o in b if i in o}) and len(got) > 50


def test_generated_cases(spark, entities):
    g = generate.generate(entities, 88, seed=3).collect()
    again = generate.generate(entities, 88, seed=3).collect()
    assert sorted(map(str, g)) == sorted(map(str, again)) and len(g) == 88 and {r.category for r in g} == {*generate.POSITIVE, *generate.NEGATIVE}
    assert all((r.expected_entity_id is not None) == (r.expected_match == "true") for r in g)
    assert one(spark, generate.single_typo, "Acme Widgets", "x", "Big Co") == ["Acme Wigdets", "x", "iBg Co"]
    assert one(spark, generate.remove_suffix, "Acme Inc.", "Inc") == ["Acme", "Inc"]


# --- joins by date


def test_as_of_against_brute_force(spark):
    """Rows on a chunk's borders, ties, nulls, and one key that most rows have."""
    r = random.Random(21)
    date = lambda: None if r.random() < 0.1 else datetime.date(1969, 9, 1) + datetime.timedelta(r.choice([0, 63, 64, 65, 127, 128, r.randrange(900)]))
    key = lambda: r.choice(["hot", "hot", "hot", "b", "c", None])
    left, right = [(i, key(), date(), "kept") for i in range(300)], [(key(), date(), r.choice("xyz"), r.choice([1, 2, None])) for _ in range(120)]
    got = periods.as_of(spark.createDataFrame(left, "id int, k string, d date, v string"), spark.createDataFrame(right, "k string, s date, v string, n int"), ["k"], "d", "s", ["v", "n"])
    assert got.columns == ["id", "k", "d", "v", "n"]
    for x in got.collect():
        may = [y for y in right if y[0] == x.k and x.k and x.d and y[1] and y[1] <= x.d]
        best = max(may, key=lambda y: (y[1], y[2], -1 if y[3] is None else y[3]), default=(None,) * 4)
        assert (x.v, x.n) == best[2:]
    assert got.count() == 300


def test_held_periods_against_arrays(spark):
    r = random.Random(22)
    date = lambda: None if r.random() < 0.3 else datetime.date(1999, 12, 1) + datetime.timedelta(r.choice([0, 1, 30, 31, 64, r.randrange(400)]))
    key = lambda: r.choice(["hot", "hot", "hot", "b", "c", "d"])
    rows = [("x", *(date(), date()), r.choice(["ACTIVE", "retired", None]), "p", k) for k in ["hot"] * 40 + ["b", "b", "c"]]
    p = spark.createDataFrame(rows, "period_type string, valid_from date, valid_to date, status string, provider string, k string")
    left = spark.createDataFrame([(i, key(), date()) for i in range(200)], "id int, k string, day date")
    listed = left.join(p.groupBy("k").agg(F.collect_list(F.struct(*p.columns[:-1])).alias("periods")), "k", "left")
    for every in (False, True):
        want = {x.id: x.s for x in listed.select("id", T.evaluate_periods(F.col("periods"), F.col("day"), every).alias("s")).collect()}
        got = periods.held(left, p, ["k"], "day").select("id", periods.status_of(*map(F.col, ("day", "dated", "undated", "holding")), every).alias("s"))
        assert {x.id: x.s for x in got.collect()} == want


def test_a_hot_key_is_few_rows_of_a_timeline(spark):
    """Two million rows that ask for one key, about few days, are those days when they meet the periods."""
    left = spark.range(2_000_000).select("id", F.lit(1).alias("k"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 500).cast("int")).alias("day"))
    right = spark.range(200_000).select(F.lit(1).alias("k"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 400).cast("int")).alias("since"), F.col("id").alias("v"))
    got = periods.as_of(left, right, ["k"], "day", "since", ["v"])
    assert got.agg(F.count("*").alias("n"), F.count("v").alias("v")).first()[:] == (2_000_000, 2_000_000)
    assert "BroadcastNestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


# --- all pairs of similar names


def test_similar_names_against_all_pairs(spark):
    """Every pair above a floor, whatever the floor, with equal, empty, repeated, long and short names, letters beyond ASCII, and tokens in another order."""
    r = random.Random(12)
    words = ["".join(r.choice("eeetaaonishrdlcumwfgypbvkxqjz019é") for _ in range(r.choice([1, 2, 3, 5, 8]))) for _ in range(40)]
    name = lambda: " ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 4])))

    def damaged(n):
        at = r.randrange(len(n))
        return r.choice([n[:at] + n[at + 1 :], n[:at] + r.choice("ab 😀") + n[at:], " ".join(reversed(n.split())), n + " " + r.choice(words)])

    left = [name() for _ in range(120)] + ["a", "aa", "x" * 300, "ab " * 70 + "c"]
    right = [damaged(r.choice(left)) for _ in range(120)] + left[:5] + ["a", "x" * 290, "ab " * 70]
    a = spark.createDataFrame([(n, i) for i, n in enumerate([*left, left[0], "", "  ", None])], "name string, left_name long")
    b = spark.createDataFrame([(n,) for n in [*right, "", None, right[0]]], "name string")
    kept = sorted({n for n in right if n.strip()})
    for floor in (0.6, 0.75, 0.9, 1.0):
        got = sorted(map(tuple, similar.similar_names(a, b, floor).collect()))
        assert got == sorted((x, y, s) for x in set(left) for y in kept if (s := similarity(x, y)) >= floor)
    assert similar.similar_names(a.limit(0), b).count() == 0
    with pytest.raises(ValueError):
        similar.similar_names(a, b, 0)


def test_similar_names_compare_no_side_with_all_of_the_other(spark):
    n = 3000
    side = lambda k: spark.range(n).select(F.md5(F.concat(F.lit(k), F.col("id").cast("string"))).alias("name"))
    features = [similar._features(similar._forms(side(k))) for k in "ab"]
    met = similar._by_characters(*features, 0.9)
    plan_text = met._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan_text and "NestedLoop" not in plan_text


# --- profiles in sketches


def test_sketches_merge_to_what_the_whole_table_gives(spark):
    r = random.Random(3)
    rows = [(f"s{i % 3}", "hot" if i % 3 else f"v{r.randrange(700)}", str(r.randrange(1000)) if i % 10 else None, "x" * (i % 50)) for i in range(6000)]
    t = spark.createDataFrame(rows, "source string, v string, x string, rows string")
    whole = {x.column: x for x in profiles.report(profiles.merge(profiles.sketch(t, ["source"])), 3).collect()}
    assert set(whole) == {"v", "x", "rows"}
    for at, c in ((1, "v"), (2, "x"), (3, "rows")):
        known = [x[at] for x in rows if x[at]]
        g = whole[c]
        assert (g["rows"], g.missing, g.shortest, g.longest) == (6000, 6000 - len(known), min(map(len, known)), max(map(len, known)))
        assert abs(g.distinct - len(set(known))) <= 0.07 * len(set(known))
        lengths = sorted(map(len, known))
        for q, got in zip((0.25, 0.5, 0.75), g.length_quantiles, strict=True):
            assert sum(n < got for n in lengths) <= (q + 0.05) * len(lengths) and sum(n <= got for n in lengths) >= (q - 0.05) * len(lengths)
    assert whole["v"].top[0].item == "hot" and abs(whole["v"].top[0]["count"] - 4000) <= 6000 / 768
    assert whole["x"].n_numbers == 5400 and 450 <= whole["x"].number_quantiles[1] <= 550 and whole["v"].number_quantiles is None
    by = {(x.source, x.column): x["rows"] for x in profiles.sketch(t, ["source"]).collect()}
    assert by["s0", "v"] == 2000 and len(by) == 9


def test_sketches_of_little(spark):
    t = spark.createDataFrame([(None, "", "a" * 5000), (None, "", "a" * 4999 + "b"), (None, "NaN", None)], "a string, b string, `c.d` string")
    got = {x.column: x for x in profiles.report(profiles.sketch(t)).collect()}
    assert (got["a"].missing, got["a"].distinct, got["a"].top, got["a"].length_quantiles, got["a"].longest) == (3, 0, [], None, None)
    assert (got["b"].missing, got["b"].n_numbers, got["b"].top[0].item) == (2, 0, "NaN")
    assert got["c.d"].distinct == 2 and len(got["c.d"].top) == 2 and max(len(x.item) for x in got["c.d"].top) < 300
    assert profiles.report(profiles.sketch(t.limit(0))).count() == 0
