"""A linkage problem over the test tables: customers are the master, orders the records, with names, domains and identifiers
that are right, wrong or missing by turns. The raw rows are SQL that both engines read; what is made of them is not shared: the tables
that the SQL for DuckDB looks values up in are its own, below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAME = "p.p_name || ' ' || cast({k} % 50 AS string) || CASE {k} % 4 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' GmbH' WHEN 2 THEN ' Holdings, Ltd.' ELSE '' END"

MASTER = f"""
SELECT c.c_custkey AS ord, 'entity:' || cast(c.c_custkey AS string) AS internal_entity_id, CASE WHEN c.c_custkey % 3 = 0 THEN 'sec:' || cast(c.c_custkey AS string) END AS internal_security_id,
  {NAME.format(k="c.c_custkey")} AS canonical_name, CASE WHEN c.c_custkey % 5 = 0 THEN 'issuer' ELSE 'legal_entity' END AS entity_type,
  CASE WHEN c.c_custkey % 3 = 0 THEN 'T' || cast(c.c_custkey AS string) END AS ticker, CASE WHEN c.c_custkey % 3 = 0 THEN CASE WHEN c.c_custkey % 2 = 0 THEN 'NasdaqGS' ELSE 'N.Y.S.E.' END END AS exchange,
  CASE WHEN c.c_custkey % 6 = 0 THEN 'FIGI' || cast(c.c_custkey AS string) END AS figi, cast(c.c_custkey + 1 AS string) AS cik, CASE WHEN c.c_custkey % 9 = 0 THEN 'lei-' || cast(c.c_custkey AS string) END AS lei,
  'https://www.c' || cast(c.c_custkey AS string) || '.com/about' AS domain, CASE c.c_nationkey % 4 WHEN 0 THEN 'Germany' WHEN 1 THEN 'us' WHEN 2 THEN 'uk' ELSE 'Nowhere' END AS country,
  'C' || cast(c.c_custkey AS string) || ' Co | ' || upper(p.p_name) || ' ' || cast(c.c_custkey % 50 AS string) AS aliases,
  CASE WHEN c.c_custkey >= 10 THEN 'entity:' || cast(cast(floor(c.c_custkey / 10) AS bigint) AS string) END AS parent_entity_id,
  CASE WHEN c.c_custkey % 7 <> 0 THEN cast(cast(o.first_day AS date) AS string) END AS entity_valid_from, CASE WHEN c.c_custkey % 11 = 0 THEN cast(cast(o.last_day AS date) AS string) END AS entity_valid_to,
  CASE WHEN c.c_custkey % 13 = 0 THEN 'INACTIVE' END AS entity_status
FROM {{customer}} c JOIN {{part}} p ON p.p_partkey = c.c_custkey % 64
LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM {{orders}} GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
"""

RECORDS = f"""
SELECT cast(o.o_orderkey AS string) AS record_id,
  CASE o.o_orderkey % 6 WHEN 1 THEN {NAME.format(k="o.o_custkey")} WHEN 2 THEN upper({NAME.format(k="o.o_custkey")}) || ' LLC' WHEN 3 THEN p.p_name || ' unknown' WHEN 4 THEN {NAME.format(k="o.o_custkey")}
    WHEN 5 THEN 'Zzz vendor ' || cast(o.o_orderkey % 13 AS string) END AS entity_name,
  CASE WHEN o.o_orderkey % 6 = 1 THEN 'WWW.C' || cast(o.o_custkey AS string) || '.com' END AS domain, CASE o.o_orderkey % 6 WHEN 0 THEN cast(o.o_custkey + 1 AS string) WHEN 4 THEN cast(o.o_custkey + 2 AS string) END AS cik,
  CASE WHEN o.o_orderkey % 12 = 1 AND o.o_custkey % 3 = 0 THEN 't' || cast(o.o_custkey AS string) END AS ticker, CASE WHEN o.o_orderkey % 24 = 1 THEN 'NASDAQ' END AS exchange,
  CASE WHEN o.o_orderkey % 10 = 4 THEN 'lei-' || cast(o.o_custkey AS string) END AS lei,
  CASE o.o_orderkey % 3 WHEN 0 THEN 'DE' WHEN 1 THEN 'USA' END AS country, CASE WHEN o.o_orderkey % 5 <> 0 THEN cast(o.o_orderdate AS date) END AS observation_date, 'entity:' || cast(o.o_custkey AS string) AS expected_entity_id
FROM {{orders}} o JOIN {{part}} p ON p.p_partkey = o.o_custkey % 64
"""

#: Names that end with legal suffixes.
SUFFIXED = """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Acme ' || {S} WHEN 1 THEN 'Acme ' || upper({S}) || ', ' || {S} || '.' WHEN 2 THEN {S} || ' Acme' ELSE {S} END AS v FROM {customer}
"""

#: A relationship table with every kind of fault: one row per order, children under parents as in the master, some turned round.
RELATIONSHIPS = """
SELECT o_orderkey AS row, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE 'r' || cast(CASE WHEN o_orderkey % 41 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS string) END AS relationship_id,
  'entity:' || cast(CASE WHEN o_orderkey % 211 = 0 THEN cast(floor(o_custkey / 10) AS bigint) ELSE o_custkey END AS string) AS child_entity_id,
  'entity:' || cast(CASE WHEN o_orderkey % 211 = 0 THEN o_custkey WHEN o_orderkey % 7 = 0 THEN cast(floor(o_custkey / 10) AS bigint) + 100000 ELSE cast(floor(o_custkey / 10) AS bigint) END AS string) AS parent_entity_id,
  CASE o_orderkey % 9 WHEN 0 THEN 'owned_by' WHEN 1 THEN 'Brand_Of' WHEN 2 THEN 'minority_owned_by' WHEN 3 THEN 'nonsense' WHEN 4 THEN 'formerly_owned_by' ELSE 'subsidiary_of' END AS relationship_type,
  CASE WHEN o_orderkey % 4 <> 0 THEN cast(cast(o_orderdate AS date) AS string) END AS valid_from, CASE WHEN o_orderkey % 3 = 0 THEN cast(cast(o_orderdate AS date) + cast(o_orderkey % 300 - 20 AS int) AS string) WHEN o_orderkey % 89 = 0 THEN '31.12.1999' END AS valid_to,
  CASE o_orderkey % 5 WHEN 0 THEN cast(o_orderkey % 120 AS string) WHEN 1 THEN 'half' END AS ownership_percentage, CASE o_orderkey % 17 WHEN 0 THEN 'supporting' WHEN 1 THEN 'solid' END AS trust_level, CASE o_orderkey % 19 WHEN 0 THEN 'no' WHEN 1 THEN 'perhaps' END AS is_direct
FROM {orders}
"""

TABLES = ("customer", "part", "orders", "lineitem", "documents", "pages", "events", "supplier", "nation")


def raw(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def duck(text: str) -> str:
    return text.format(**{t: t for t in TABLES})


def _suffixed() -> str:
    return SUFFIXED.replace("{S}", f"split_part('{'|'.join(SUFFIXES)}', '|', cast(floor(c_custkey / 4) % {len(SUFFIXES)} + 1 AS int))")


# --- DuckDB's forms of the normalisers, for text of ASCII and accented Latin letters

# Fixed values, for the SQL alone: legal suffixes, exchanges, country names, number and street words, subdivisions.
SUFFIXES = "inc incorporated corp corporation company co llc llp lp ltd limited plc gmbh ag sa sas bv nv pte pty holdings group".split()
EXCHANGE_CODES = {
    "NASDAQ": "XNAS", "NASDAQGS": "XNAS", "NASDAQGLOBALSELECT": "XNAS", "NASDAQGM": "XNAS", "NASDAQGLOBALMARKET": "XNAS", "NASDAQCM": "XNAS",
    "NASDAQCAPITALMARKET": "XNAS", "XNAS": "XNAS", "NYSE": "XNYS", "NEWYORKSTOCKEXCHANGE": "XNYS", "XNYS": "XNYS", "NYSEARCA": "ARCX",
    "ARCA": "ARCX", "ARCX": "ARCX", "NYSEAMERICAN": "XASE", "AMEX": "XASE", "XASE": "XASE", "LSE": "XLON",
    "LONDON": "XLON", "XLON": "XLON", "TSX": "XTSE", "XTSE": "XTSE", "TSXV": "XTSX", "XTSX": "XTSX",
    "EURONEXTPARIS": "XPAR", "XPAR": "XPAR", "EURONEXTAMSTERDAM": "XAMS", "XAMS": "XAMS", "XETRA": "XETR", "XETR": "XETR",
    "TOKYO": "XTKS", "XTKS": "XTKS", "ASX": "XASX", "XASX": "XASX", "SINGAPORE": "XSES", "XSES": "XSES",
    "HONGKONG": "XHKG", "XHKG": "XHKG",
}
COUNTRY_CODES = {
    "united states": "US", "usa": "US", "us": "US", "u.s.": "US", "united kingdom": "GB", "uk": "GB", "great britain": "GB", "britain": "GB",
    "england": "GB", "scotland": "GB", "wales": "GB", "northern ireland": "GB", "canada": "CA", "germany": "DE", "france": "FR", "japan": "JP",
    "australia": "AU", "netherlands": "NL", "singapore": "SG",
}
NUMBER_DIGITS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10",
}
STREET_WORDS = {
    "st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court",
    "pkwy": "parkway", "hwy": "highway", "wy": "way", "pl": "place",
}
STATE_CODES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct",
    "delaware": "de", "district of columbia": "dc", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il",
    "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md",
    "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne",
    "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd",
    "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd",
    "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv",
    "wisconsin": "wi", "wyoming": "wy", "alberta": "ab", "british columbia": "bc", "manitoba": "mb", "new brunswick": "nb", "newfoundland and labrador": "nl",
    "nova scotia": "ns", "ontario": "on", "prince edward island": "pe", "quebec": "qc", "saskatchewan": "sk",
}


SUFFIXED = _suffixed()


def name(x: str) -> str:
    return f"nullif(regexp_replace(array_to_string(regexp_extract_all(replace(lower(replace(strip_accents({x}), 'ß', 'ss')), '&', ' and '), '[a-z0-9]+'), ' '), '(?:(?:^| )(?:{'|'.join(SUFFIXES)}))+$', ''), '')"


def domain(x: str) -> str:
    v = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    host = f"lower(regexp_replace(regexp_replace(regexp_extract(CASE WHEN contains({v}, '://') THEN {v} ELSE '//' || {v} END, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1), '^.*@', ''), ':.*$', ''))"
    host = f"regexp_replace(rtrim({host}, '.'), '^www\\.', '')"
    return f"(SELECT CASE WHEN contains(h, '.') AND NOT contains(h, ' ') THEN array_to_string(list_slice(string_split(h, '.'), CASE WHEN len(string_split(h, '.')) > 2 AND string_split(h, '.')[-2] IN ('co', 'com', 'org', 'net') THEN -3 ELSE -2 END, -1), '.') END FROM (SELECT {host} AS h))"


def compact(x: str) -> str:
    return f"nullif(regexp_replace(upper({x}), '[^A-Z0-9]', '', 'g'), '')"


def null_token(x: str) -> str:
    return f"CASE WHEN lower(trim({x})) NOT IN ('-', 'n/a', 'na', 'none', 'null', 'unknown') THEN {x} END"


def identifier(x: str, kind: str = "") -> str:
    v = compact(null_token(x))
    if kind == "cik":
        return f"CASE WHEN regexp_full_match({v}, '[0-9]+') AND length({v}) < 10 THEN lpad({v}, 10, '0') ELSE {v} END"
    return exchange(v) if kind == "exchange" else v


def _lookup(values: dict, key: str) -> str:
    return f"MAP {{{', '.join(f"'{k}': '{v}'" for k, v in values.items())}}}[{key}]"


def exchange(x: str) -> str:
    return f"coalesce({_lookup(EXCHANGE_CODES, compact(x))}, {compact(x)})"


def country(x: str, codes: tuple[str, ...]) -> str:
    return f"coalesce({_lookup(COUNTRY_CODES, f'lower(trim({x}))')}, CASE WHEN upper(trim({x})) IN ({', '.join(f"'{c}'" for c in codes)}) THEN upper(trim({x})) END)"


#: The master and the records as candidates' columns, in DuckDB.
M = f"""
m AS (SELECT ord, internal_entity_id AS entity_id, {name("canonical_name")} AS cname, list_distinct(list_filter([{name("canonical_name")}, {name("split_part(aliases, '|', 1)")}, {name("split_part(aliases, '|', 2)")}], lambda x: x IS NOT NULL)) AS names,
  entity_type, {identifier("cik", "cik")} AS cik, {identifier("lei")} AS lei, {identifier("figi")} AS figi, {identifier("ticker")} AS ticker, {identifier("exchange", "exchange")} AS exchange, {domain("domain")} AS domain, {country("country", ("DE", "US", "GB"))} AS country,
  parent_entity_id AS parent_id, CAST(entity_valid_from AS DATE) AS vf, CAST(entity_valid_to AS DATE) AS vt, entity_status AS vs FROM ({duck(MASTER)}))"""
R = f"""
r AS (SELECT record_id, {name("entity_name")} AS name, entity_name, {domain("domain")} AS domain, {identifier("cik", "cik")} AS cik, {identifier("lei")} AS lei, {identifier("ticker")} AS ticker, {identifier("exchange", "exchange")} AS exchange,
  {country("country", ("DE", "US"))} AS country, observation_date AS day, expected_entity_id FROM ({duck(RECORDS)}))"""
#: The index of blocking keys, capped, and its probe.
BLOCKS = """
keys AS (SELECT DISTINCT * FROM (
    SELECT 'identifier' AS block, unnest([cik, lei, figi, ticker, exchange]) AS key, ord FROM m UNION ALL SELECT 'domain', domain, ord FROM m
    UNION ALL SELECT 'name', unnest(names), ord FROM m UNION ALL SELECT 'token', unnest(string_split(nm, ' ')), ord FROM (SELECT unnest(names) AS nm, ord FROM m)) WHERE key IS NOT NULL),
blocks AS (SELECT block, key, ord FROM keys QUALIFY row_number() OVER (PARTITION BY block, key ORDER BY ord) <= 20),
probes AS (SELECT record_id, 'identifier' AS block, unnest(list_distinct([cik, lei, ticker])) AS key, 0 AS priority FROM r UNION ALL SELECT record_id, 'domain', domain, 1 FROM r UNION ALL SELECT record_id, 'name', name, 2 FROM r),
primary_hits AS (SELECT record_id, ord, priority, 0 AS weak FROM probes JOIN blocks USING (block, key)),
hits AS (SELECT * FROM primary_hits UNION ALL SELECT record_id, ord, 3, 0 FROM r JOIN blocks ON block = 'token' AND key = split_part(name, ' ', 1)
    UNION ALL SELECT record_id, ord, 3, 1 FROM (SELECT record_id, unnest(list_slice(string_split(name, ' '), 2, -1)) AS key FROM r WHERE record_id NOT IN (SELECT record_id FROM primary_hits)) w JOIN blocks ON block = 'token' AND blocks.key = w.key),
best AS (SELECT record_id, ord, min(priority * 2 + weak) AS p FROM hits GROUP BY record_id, ord),
found AS (SELECT record_id, ord, (p // 2)::INT AS priority, (p % 2)::INT AS weak, row_number() OVER (PARTITION BY record_id ORDER BY p, ord)::INT AS rank FROM best QUALIFY rank <= 20)"""
#: Scores of the pairs found, with the tokens' Jaccard index as similarity.
SCORES = """
pairs AS (SELECT f.record_id, f.ord, r.name, r.domain AS rd, m.domain, r.cik AS rc, m.cik, r.lei AS rl, m.lei, r.country AS ry, m.country, r.day, m.entity_id, m.cname, m.names, r.expected_entity_id,
    coalesce(list_contains(m.names, r.name), false) AS exact,
    CASE WHEN r.name IS NULL THEN 0.0 ELSE list_max(list_transform(m.names, lambda n: len(list_intersect(string_split(n, ' '), string_split(r.name, ' ')))::DOUBLE / len(list_distinct(list_concat(string_split(n, ' '), string_split(r.name, ' ')))))) END AS sim,
    CASE WHEN r.day IS NULL THEN 'not_requested' WHEN m.vf IS NULL AND m.vt IS NULL THEN 'not_verified' WHEN upper(coalesce(m.vs, '')) IN ('INACTIVE', 'ANNULLED', 'RETIRED', 'DELISTED') AND m.vt IS NULL THEN 'not_verified'
      WHEN (m.vf IS NULL OR r.day >= m.vf) AND (m.vt IS NULL OR r.day <= m.vt) THEN 'verified' ELSE 'invalid' END AS scope
    FROM found f JOIN r USING (record_id) JOIN m USING (ord)),
points AS (SELECT *, CASE WHEN rc = cik THEN 100 WHEN rc <> cik THEN -100 ELSE 0 END + CASE WHEN rl = lei THEN 100 WHEN rl <> lei THEN -100 ELSE 0 END + CASE WHEN exact THEN 50 WHEN sim >= 0.75 THEN 35 * sim ELSE 0 END
    + CASE WHEN rd = domain THEN 45 ELSE 0 END + CASE WHEN ry = country THEN 10 WHEN ry <> country THEN -15 ELSE 0 END + CASE scope WHEN 'verified' THEN 15 WHEN 'invalid' THEN -40 ELSE 0 END AS raw FROM pairs),
scored AS (SELECT *, CASE WHEN (rc = cik) IS TRUE OR (rl = lei) IS TRUE THEN CASE WHEN scope <> 'invalid' AND NOT ((rc <> cik) IS TRUE OR (rl <> lei) IS TRUE) THEN 0.99 END END AS f1,
    CASE WHEN scope <> 'invalid' THEN CASE WHEN exact AND (rd = domain) IS TRUE THEN 0.99 WHEN exact THEN 0.82 WHEN (rd = domain) IS TRUE THEN 0.80 END END AS f2,
    CASE WHEN (rc = cik) IS TRUE THEN 'exact_cik' WHEN (rl = lei) IS TRUE THEN 'exact_lei' WHEN exact AND (rd = domain) IS TRUE THEN 'exact_name_and_domain' WHEN (rd = domain) IS TRUE THEN 'exact_domain' WHEN exact THEN 'exact_name'
      WHEN sim >= 0.75 AND (ry = country) IS TRUE THEN 'fuzzy_name_and_country' WHEN sim >= 0.75 THEN 'fuzzy_name_only' ELSE 'unknown' END AS pathway FROM points),
confident AS (SELECT *, round(CASE WHEN CASE WHEN exact THEN 1.0 ELSE sim END < 1 AND rc IS NULL AND rl IS NULL AND rd IS NULL THEN least(c, 0.89) ELSE c END, 4) AS confidence
    FROM (SELECT *, greatest(greatest(0.0, least(1.0, raw / 100.0)), coalesce(f1, f2, 0.0)) AS c FROM scored)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY confidence DESC, rank_in) AS place FROM (SELECT c.*, f.rank AS rank_in FROM confident c JOIN found f USING (record_id, ord))),
decided AS (SELECT *, ((rc <> cik) IS TRUE OR (rl <> lei) IS TRUE OR scope = 'invalid') AS conflict,
    CASE WHEN ((rc <> cik) IS TRUE OR (rl <> lei) IS TRUE OR scope = 'invalid') THEN 'review_required' WHEN pathway IN ('exact_cik', 'exact_lei', 'exact_name_and_domain') AND confidence >= 0.98 THEN 'matched' WHEN confidence >= 0.80 THEN 'review_required' ELSE 'unmatched' END AS status FROM ranked)"""


# --- a whole resolution by exact keys, which SQL can follow to its end

#: The master with dates for listings and relationships too.
DATED_MASTER = f"SELECT x.*, CASE WHEN ord % 5 <> 0 THEN entity_valid_from END AS security_valid_from, CASE WHEN ord % 2 = 0 THEN entity_valid_from END AS relationship_valid_from FROM ({MASTER}) x"
#: Records without names: keys of one entity, of two, or of none.
KEYED = """
SELECT 'rec:' || cast(c_custkey AS string) AS record_id, CASE WHEN c_custkey % 4 = 0 THEN cast(c_custkey + CASE WHEN c_custkey % 8 = 0 THEN 1 ELSE 2 END AS string) WHEN c_custkey % 97 = 1 THEN '99999999' END AS cik,
  CASE WHEN c_custkey % 9 = 0 AND c_custkey % 2 = 1 THEN 'lei-' || cast(c_custkey AS string) END AS lei, CASE WHEN c_custkey % 30 = 0 THEN 'FIGI' || cast(c_custkey AS string) WHEN c_custkey % 42 = 6 THEN 'FIGI' || cast(c_custkey + 6 AS string) END AS figi,
  CASE WHEN c_custkey % 6 = 3 THEN 'T' || cast(c_custkey AS string) END AS ticker, CASE WHEN c_custkey % 12 = 3 THEN CASE WHEN c_custkey % 24 = 3 THEN 'NYSE' ELSE 'LSE' END END AS exchange,
  CASE WHEN c_custkey % 3 = 0 THEN 'c' || cast(c_custkey AS string) || '.com' WHEN c_custkey % 5 = 1 THEN 'www.c' || cast(c_custkey - 1 AS string) || '.com' END AS domain,
  CASE c_nationkey % 5 WHEN 0 THEN 'DE' WHEN 1 THEN 'US' WHEN 2 THEN 'uk' END AS country, date_add(DATE '1993-01-01', cast(c_custkey * 7 % 1900 AS int)) AS observation_date
FROM {customer}
"""
RESOLVED = f"""WITH RECURSIVE m AS (SELECT ord, internal_entity_id AS entity_id, {name("canonical_name")} AS cname, entity_type, {identifier("cik", "cik")} AS cik, {identifier("lei")} AS lei, {identifier("figi")} AS figi, {identifier("ticker")} AS ticker,
    {identifier("exchange", "exchange")} AS exchange, {domain("domain")} AS domain, {country("country", ("DE", "US", "GB"))} AS country, parent_entity_id AS parent_id, CAST(entity_valid_from AS DATE) AS vf, CAST(entity_valid_to AS DATE) AS vt, entity_status AS vs,
    CAST(security_valid_from AS DATE) AS sf, CAST(relationship_valid_from AS DATE) AS rf, internal_security_id AS sid FROM ({duck(DATED_MASTER)})),
r AS (SELECT record_id, {identifier("cik", "cik")} AS cik, {identifier("lei")} AS lei, {identifier("figi")} AS figi, {identifier("ticker")} AS ticker, {identifier("exchange", "exchange")} AS exchange, {domain("domain")} AS domain,
    {country("country", ("DE", "US"))} AS country, observation_date AS day FROM ({duck(KEYED).replace("date_add(DATE '1993-01-01', cast(c_custkey * 7 % 1900 AS int))", "DATE '1993-01-01' + (c_custkey * 7 % 1900)::INT")})),
hits AS (SELECT record_id, ord, 0 AS p FROM r JOIN m ON r.cik = m.cik UNION ALL SELECT record_id, ord, 0 FROM r JOIN m ON r.lei = m.lei UNION ALL SELECT record_id, ord, 0 FROM r JOIN m ON r.figi = m.figi
    UNION ALL SELECT record_id, ord, 0 FROM r JOIN m ON r.ticker = m.ticker UNION ALL SELECT record_id, ord, 1 FROM r JOIN m ON r.domain = m.domain),
c AS (SELECT record_id, ord, row_number() OVER (PARTITION BY record_id ORDER BY min(p), ord) AS pos FROM hits GROUP BY record_id, ord),
p0 AS (SELECT c.*, m.entity_id, m.cname, m.entity_type, m.sid, r.day, r.figi AS r_figi, r.ticker AS r_ticker, r.exchange AS r_exchange, r.cik IS NULL AND r.lei IS NULL AND r.domain IS NULL AS bare,
    coalesce(r.cik = m.cik, false) AS cik_same, coalesce(r.lei = m.lei, false) AS lei_same, coalesce(r.cik <> m.cik, false) OR coalesce(r.lei <> m.lei, false) AS differs, coalesce(r.domain = m.domain, false) AS site,
    CASE WHEN r.cik = m.cik THEN 100 WHEN r.cik <> m.cik THEN -100 ELSE 0 END + CASE WHEN r.lei = m.lei THEN 100 WHEN r.lei <> m.lei THEN -100 ELSE 0 END + CASE WHEN r.country = m.country THEN 10 WHEN r.country <> m.country THEN -15 ELSE 0 END AS keyed,
    coalesce(r.figi = m.figi, false) AS figi_same, coalesce(r.figi <> m.figi, false) AS figi_differs, coalesce(r.ticker = m.ticker, false) AS traded, coalesce(r.exchange = m.exchange, false) AS there,
    CASE WHEN vf IS NULL AND vt IS NULL OR upper(vs) = 'INACTIVE' AND vt IS NULL THEN 'not_verified' WHEN (vf IS NULL OR day >= vf) AND (vt IS NULL OR day <= vt) THEN 'verified' ELSE 'invalid' END AS scope,
    CASE WHEN sf IS NULL THEN 'not_verified' WHEN day >= sf THEN 'verified' ELSE 'invalid' END AS s_scope FROM c JOIN m USING (ord) JOIN r USING (record_id)),
p1 AS (SELECT *, greatest(0.0, least(1.0, (keyed + CASE WHEN site THEN 45 ELSE 0 END + CASE scope WHEN 'verified' THEN 15 WHEN 'invalid' THEN -40 ELSE 0 END) / 100.0)) AS raw,
    CASE WHEN scope = 'invalid' THEN 0.0 WHEN (cik_same OR lei_same) AND NOT differs THEN 0.99 WHEN site THEN 0.80 ELSE 0.0 END AS least_ FROM p0),
p2 AS (SELECT *, round(CASE WHEN bare THEN least(greatest(raw, least_), 0.89) ELSE greatest(raw, least_) END, 4)::DOUBLE AS conf0 FROM p1),
listed AS (SELECT *, figi_differs OR s_scope = 'invalid' AS unclean, CASE WHEN figi_same THEN 100 WHEN figi_differs THEN -100 ELSE 0 END + CASE WHEN traded AND there THEN 80 WHEN traded THEN 40 ELSE 0 END + CASE s_scope WHEN 'verified' THEN 10 WHEN 'invalid' THEN -60 ELSE 0 END AS points,
    CASE WHEN figi_same THEN 'exact_figi' WHEN traded AND there THEN 'ticker_and_exchange' WHEN traded THEN 'ticker_only' ELSE 'unknown' END AS s_path FROM p2 WHERE sid IS NOT NULL),
first0 AS (SELECT *, greatest(0.0, least(1.0, points / 100.0)) AS s_raw FROM listed),
first1 AS (SELECT *, round(CASE WHEN figi_same AND NOT unclean THEN greatest(s_raw, 0.99) WHEN traded AND r_exchange IS NULL THEN least(s_raw, 0.79) ELSE s_raw END, 4)::DOUBLE AS s_conf FROM first0),
first2 AS (SELECT *, row_number() OVER w AS place, lead(s_conf) OVER w AS next_conf, lead(entity_id) OVER w AS next_issuer FROM first1 WINDOW w AS (PARTITION BY record_id ORDER BY s_conf DESC, pos)),
lift AS (SELECT record_id, entity_id, s_path AS lift_path FROM first2 WHERE place = 1 AND (figi_same OR traded AND there) AND NOT (coalesce(next_conf >= s_conf - 0.02::DOUBLE, false) AND next_issuer <> entity_id)),
q0 AS (SELECT p2.*, CASE WHEN lift_path IS NOT NULL THEN greatest(conf0, 0.99::DOUBLE) ELSE conf0 END AS conf,
    CASE WHEN cik_same THEN 'exact_cik' WHEN lei_same THEN 'exact_lei' WHEN lift_path IN ('exact_figi', 'ticker_and_exchange') THEN lift_path WHEN site THEN 'exact_domain' ELSE 'unknown' END AS path FROM p2 LEFT JOIN lift USING (record_id, entity_id)),
q1 AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY conf DESC, pos) AS place FROM q0),
strong AS (SELECT record_id, count(DISTINCT coalesce(cname, entity_id)) > 1 AS crossed FROM p2 WHERE cik_same OR lei_same OR figi_same AND sid IS NOT NULL GROUP BY record_id),
b0 AS (SELECT q1.*, coalesce(crossed, false) AS crossed FROM q1 LEFT JOIN strong USING (record_id) WHERE place = 1),
b1 AS (SELECT *, CASE WHEN crossed OR scope = 'invalid' OR differs THEN 'review_required' WHEN path IN ('exact_cik', 'exact_lei', 'exact_figi', 'ticker_and_exchange') AND conf >= 0.98 THEN 'matched' WHEN conf >= 0.80 THEN 'review_required' ELSE 'unmatched' END AS e_status FROM b0),
up AS (SELECT record_id, day, ord AS at, 0 AS hop, NULL::VARCHAR AS to_id, NULL::VARCHAR AS edge FROM b1 WHERE e_status <> 'unmatched'
    UNION ALL SELECT record_id, day, n.ord, hop + 1, m.parent_id, CASE WHEN m.rf IS NULL THEN 'not_verified' ELSE 'verified' END FROM up JOIN m ON m.ord = up.at JOIN m n ON n.entity_id = m.parent_id WHERE m.rf IS NULL OR up.day >= m.rf),
chain AS (SELECT record_id, max(hop) AS hops, arg_max(to_id, hop) AS top, bool_and(edge = 'verified') AS every_, bool_or(edge = 'verified') AS some_ FROM up GROUP BY record_id),
b2 AS (SELECT b1.*, hops, m.parent_id IS NOT NULL AS has_edge, CASE WHEN hops > 0 THEN top END AS parent_id, CASE WHEN e_status = 'unmatched' THEN 'unknown' WHEN hops > 0 THEN 'candidate' WHEN b1.entity_type = 'issuer' THEN 'not_applicable' ELSE 'unknown' END AS p_status,
    CASE WHEN e_status = 'unmatched' THEN 'not_applicable' WHEN hops > 0 THEN CASE WHEN every_ THEN 'verified' WHEN some_ THEN 'partial' ELSE 'not_verified' END WHEN m.parent_id IS NOT NULL THEN 'invalid' ELSE 'not_applicable' END AS r_scope
    FROM b1 JOIN m USING (ord) LEFT JOIN chain USING (record_id)),
s0 AS (SELECT f.*, b1.entity_id = f.entity_id AND b1.e_status <> 'unmatched' AS linked FROM listed f JOIN b1 USING (record_id)),
s1 AS (SELECT *, greatest(0.0, least(1.0, (points + CASE WHEN linked THEN 20 ELSE 0 END) / 100.0)) AS s_raw FROM s0),
s2 AS (SELECT *, round(CASE WHEN (figi_same OR traded AND there AND linked) AND NOT unclean THEN greatest(s_raw, 0.99) WHEN traded AND r_exchange IS NULL THEN least(s_raw, 0.79) ELSE s_raw END, 4)::DOUBLE AS s_conf FROM s1),
s3 AS (SELECT *, row_number() OVER w AS s_place, lead(s_conf) OVER w AS next_conf, lead(sid) OVER w AS next_sid FROM s2 WINDOW w AS (PARTITION BY record_id ORDER BY s_conf DESC, pos)),
s4 AS (SELECT record_id, sid AS best_sid, figi_differs AS figi_off, s_path, s_conf, s_scope AS best_scope, unclean, coalesce(next_conf >= s_conf - 0.02::DOUBLE AND next_sid <> sid, false) AS close_ FROM s3 WHERE s_place = 1),
a0 AS (SELECT r.record_id, b2.* EXCLUDE (record_id, sid, s_scope), s4.* EXCLUDE (record_id), coalesce(r.ticker, r.figi) IS NOT NULL AS asked, coalesce(e_status, 'unmatched') AS es, coalesce(e_status, 'unmatched') <> 'unmatched' AS chosen FROM r LEFT JOIN b2 USING (record_id) LEFT JOIN s4 USING (record_id)),
a1 AS (SELECT *, CASE WHEN NOT asked THEN 'not_applicable' WHEN best_sid IS NULL THEN 'unmatched' WHEN unclean OR close_ THEN 'review_required' WHEN s_path = 'exact_figi' AND s_conf >= 0.98 OR s_path = 'ticker_and_exchange' AND s_conf >= 0.98 AND best_scope = 'verified' THEN 'matched'
    WHEN s_conf >= 0.80 OR s_path = 'ticker_only' OR s_path = 'ticker_and_exchange' AND best_scope <> 'verified' THEN 'review_required' ELSE 'unmatched' END AS ss, CASE WHEN asked AND best_sid IS NOT NULL THEN best_scope ELSE 'not_applicable' END AS sx, coalesce(r_scope, 'not_applicable') AS rx, coalesce(scope, 'not_verified') AS ex FROM a0),
a2 AS (SELECT *, CASE WHEN NOT chosen THEN 'not_verified' WHEN 'invalid' IN (ex, sx, rx) THEN 'invalid' WHEN ex = 'verified' AND sx IN ('verified', 'not_applicable') AND rx IN ('verified', 'not_applicable') THEN 'verified' WHEN 'verified' IN (ex, sx, rx) THEN 'partial' ELSE 'not_verified' END AS ox,
    CASE WHEN es = 'matched' THEN 'verified' WHEN es = 'review_required' AND crossed THEN 'ambiguous' WHEN es = 'review_required' THEN 'candidate' ELSE 'unknown' END AS e, coalesce(p_status, 'unknown') AS p,
    CASE WHEN ss = 'not_applicable' AND entity_type = 'issuer' AND chosen THEN 'unknown' WHEN ss = 'matched' THEN 'verified' WHEN ss = 'review_required' AND close_ THEN 'ambiguous' WHEN ss = 'review_required' THEN 'candidate' WHEN ss = 'not_applicable' THEN 'not_applicable' ELSE 'unknown' END AS s FROM a1),
final AS (SELECT record_id, e AS entity_status, CASE WHEN e IN ('verified', 'candidate') THEN entity_id END AS entity_id, coalesce(conf, 0) AS entity_match_score, coalesce(path, 'unknown') AS entity_match_pathway, p AS parent_status, CASE WHEN p = 'candidate' THEN parent_id END AS parent_id,
    s AS security_status, CASE WHEN s IN ('verified', 'candidate') THEN best_sid END AS security_id, {{t}},
    CASE WHEN NOT chosen THEN 'not_resolved' WHEN has_edge THEN 'resolved' ELSE 'not_available' END AS relationship_status, coalesce(crossed, false) AS crossed, asked AND coalesce(figi_off, false) AS figi_off,
    CASE WHEN ox = 'invalid' THEN 'temporal_verification_required' WHEN e = 'unknown' THEN 'unmatched' WHEN 'ambiguous' IN (e, s) THEN 'ambiguous' WHEN e <> 'verified' THEN 'review_required' WHEN p = 'candidate' THEN 'entity_matched_parent_candidate' WHEN s = 'candidate' THEN 'review_required'
      WHEN s = 'verified' THEN 'entity_and_security_matched' WHEN s = 'not_applicable' THEN 'private_entity' ELSE 'entity_matched_security_unknown' END AS final_decision FROM a2)""".replace(
    "{t}", ", ".join(f"CASE {c} WHEN 'verified' THEN 'verified' WHEN 'invalid' THEN 'contradicted' WHEN 'not_applicable' THEN 'not_applicable' ELSE 'unknown' END AS {n}" for c, n in (("ex", "entity_temporal_status"), ("rx", "relationship_temporal_status"), ("sx", "security_temporal_status"), ("ox", "temporal_status")))
)


# --- candidates of two sources, one of either for each record

_SIDE = """SELECT k, '{side}:' || cast(k AS string) AS entity_id, {name} AS name, {cik} AS cik, {lei} AS lei, {domain} AS domain, {ticker} AS ticker, {country} AS country, {rank} AS rank, {figi} AS figi, {s_ticker} AS s_ticker, {s_exchange} AS s_exchange
FROM (SELECT cast(c_custkey AS bigint) AS k, cast(c_custkey AS string) AS t FROM {{customer}}) c"""
TWO_SOURCES = {
    "a": _SIDE.format(
        side="a", name="'alpha ' || t", cik="CASE WHEN k % 2 = 0 THEN 'c' || t END", lei="CASE WHEN k % 3 = 0 THEN 'l' || t END", domain="CASE WHEN k % 5 < 3 THEN 'd' || t END", ticker="CASE WHEN k % 4 = 1 THEN 't' || t END", country="CASE WHEN k % 7 = 0 THEN 'US' END", rank="2",
        figi="CASE WHEN k % 2 = 0 THEN 'f' || t END", s_ticker="CASE WHEN k % 5 <> 4 THEN 's' || t END", s_exchange="CASE k % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'NYSE' END",
    ),
    "b": _SIDE.format(
        side="b", name="CASE WHEN k % 11 < 7 THEN 'alpha ' || t ELSE 'qqq www' END", cik="CASE WHEN k % 12 IN (0, 2, 6) THEN 'c' || t WHEN k % 12 IN (4, 5) THEN 'x' || t END", lei="CASE WHEN k % 9 = 0 THEN 'l' || t WHEN k % 9 IN (3, 4) THEN 'm' || t END",
        domain="CASE WHEN k % 10 IN (0, 1, 7) THEN 'd' || t WHEN k % 10 IN (2, 3) THEN 'e' || t END", ticker="CASE WHEN k % 8 = 1 THEN 't' || t WHEN k % 8 = 2 THEN 'u' || t END", country="CASE WHEN k % 14 < 9 THEN 'DE' END", rank="CASE WHEN k % 13 = 0 THEN 1 ELSE 3 END",
        figi="CASE WHEN k % 8 = 0 THEN 'f' || t WHEN k % 8 = 2 THEN 'g' || t END", s_ticker="CASE WHEN k % 10 < 6 THEN 's' || t END", s_exchange="CASE k % 4 WHEN 1 THEN 'LSE' WHEN 2 THEN 'NYSE' END",
    ),
}
TWO_MERGED = f"""WITH a AS ({duck(TWO_SOURCES["a"])}), b AS ({duck(TWO_SOURCES["b"])}),
j AS (SELECT a.k, a, b, coalesce(a.cik <> b.cik, false) OR coalesce(a.lei <> b.lei, false) AS quarrel, coalesce(a.cik = b.cik, false) OR coalesce(a.lei = b.lei, false) AS shared, a.name = b.name AS named, coalesce(a.ticker = b.ticker, false) OR coalesce(a.domain = b.domain, false) AS beside,
  coalesce(a.cik, a.lei) IS NOT NULL AND coalesce(b.cik, b.lei) IS NOT NULL AS known, a.rank <= b.rank AS first FROM a JOIN b USING (k)),
w AS (SELECT *, NOT quarrel AND named AND (shared OR known OR beside) AS one, CASE WHEN first THEN a ELSE b END AS x, CASE WHEN first THEN b ELSE a END AS y, coalesce(a.figi = b.figi, false) AS listed,
  coalesce(a.s_ticker = b.s_ticker, false) AS traded, coalesce(a.cik = b.cik, false) OR coalesce(a.lei = b.lei, false) OR named AS issuer FROM j),
v AS (SELECT *, coalesce(a.figi = b.figi, true) AND (listed OR traded AND issuer AND (a.s_exchange IS NULL OR b.s_exchange IS NULL OR a.s_exchange = b.s_exchange OR a.s_exchange = 'US' OR b.s_exchange = 'US')) AS one_listing FROM w),
entities AS (SELECT CAST(k AS VARCHAR) AS record_id, x.entity_id AS entity_id, left(x.entity_id, 1) || '+' || left(y.entity_id, 1) AS sources, coalesce(x.cik, y.cik) AS cik, coalesce(x.lei, y.lei) AS lei, coalesce(x.ticker, y.ticker) AS ticker, coalesce(x.domain, y.domain) AS domain, coalesce(x.country, y.country) AS country, CAST(1 AS BIGINT) AS n_aliases FROM v WHERE one
  UNION ALL SELECT CAST(k AS VARCHAR), a.entity_id, 'a', a.cik, a.lei, a.ticker, a.domain, a.country, 0 FROM v WHERE NOT one UNION ALL SELECT CAST(k AS VARCHAR), b.entity_id, 'b', b.cik, b.lei, b.ticker, b.domain, b.country, 0 FROM v WHERE NOT one),
listings AS (SELECT k, one, x.entity_id AS merged, 's:' || x.entity_id AS security_id, x.entity_id AS issuer_id, left(x.entity_id, 1) || '+' || left(y.entity_id, 1) AS sources, coalesce(x.figi, y.figi) AS figi, coalesce(x.s_ticker, y.s_ticker) AS ticker, coalesce(x.s_exchange, y.s_exchange) AS exchange FROM v WHERE one_listing
  UNION ALL SELECT k, one, x.entity_id, 's:' || a.entity_id, a.entity_id, 'a', a.figi, a.s_ticker, a.s_exchange FROM v WHERE NOT one_listing UNION ALL SELECT k, one, x.entity_id, 's:' || b.entity_id, b.entity_id, 'b', b.figi, b.s_ticker, b.s_exchange FROM v WHERE NOT one_listing),
securities AS (SELECT CAST(k AS VARCHAR) AS record_id, security_id, CASE WHEN one THEN merged ELSE issuer_id END AS issuer_id, sources, figi, ticker, exchange FROM listings),
touching AS (SELECT k, shared OR named OR beside OR listed OR traded AS shares FROM v)"""


# --- generated cases

_POSITIVE = ["exact_name", "case_and_punctuation", "legal_suffix_removed", "alias", "domain_only", "ticker_exchange", "strong_identifier", "single_typo", "cik_only", "figi_only", "ticker_only", "conflicting_identifier", "swapped_words", "added_division", "conflicting_country", "historical_date"]
_NEGATIVE = ["fictional_company", "insufficient_information", "invalid_ticker", "generic_name", "lookalike_name", "private_company"]
_POSITIVE_SQL, _NEGATIVE_SQL = (f"[{', '.join(repr(x) for x in kinds)}]" for kinds in (_POSITIVE, _NEGATIVE))
_DRAW = "CAST('0x' || substr(md5('1:{what}:' || i), 1, 13) AS BIGINT)"
GENERATED = rf"""
WITH src AS (SELECT ord, canonical_name AS k, list_filter(list_transform(string_split(coalesce(aliases, ''), '|'), lambda x: trim(x)), lambda x: x <> '') AS al, internal_security_id AS sid FROM ({duck(MASTER)})), {M},
g AS (SELECT i, i % 4 <> 3 AS pos, CASE WHEN i % 4 <> 3 THEN i - i // 4 ELSE i // 4 END AS turn FROM range(4000) AS t(i)),
c AS (SELECT i, pos, CASE WHEN pos THEN {_POSITIVE_SQL}[(turn % 16 + 1)::INT] ELSE {_NEGATIVE_SQL}[(turn % 6 + 1)::INT] END AS c,
    CASE WHEN pos THEN (SELECT min(ord) FROM src) + {_DRAW.format(what="entity")} % (SELECT count(*) FROM src) END AS ord FROM g),
j AS (SELECT c.i, c.pos, c.c, src.k, src.al, src.sid, m.* EXCLUDE (ord), regexp_replace(regexp_replace(src.k, '(?i)\b(?:incorporated|corporation|company|limited|holdings|group|inc|corp|co|llc|ltd|plc)\.?$', ''), '^[ ,.]+|[ ,.]+$', '', 'g') AS bare,
    regexp_split_to_array(src.k, '\s+') AS w FROM c LEFT JOIN src USING (ord) LEFT JOIN m USING (ord)),
n AS (SELECT *, CASE WHEN bare <> '' THEN bare ELSE k END AS short, CASE WHEN length(w[-1]) < 4 AND len(w) > 1 THEN 1 ELSE len(w) END AS at_, pos AND c NOT IN ('exact_name', 'domain_only', 'ticker_exchange', 'ticker_only') AS has_ids,
    pos AND c NOT IN ('exact_name', 'domain_only', 'cik_only', 'figi_only', 'strong_identifier') AS traded FROM j)
SELECT 'bench-' || lpad(i::VARCHAR, 9, '0') AS record_id,
  CASE WHEN c IN ('domain_only', 'ticker_exchange', 'ticker_only', 'cik_only', 'figi_only') THEN NULL WHEN c = 'case_and_punctuation' THEN regexp_replace(replace(upper(k), 'AND', '&'), '\s+', '  ', 'g') || '.' WHEN c = 'legal_suffix_removed' THEN short
    WHEN c = 'alias' THEN coalesce(al[({_DRAW.format(what="alias")} % greatest(len(al), 1) + 1)::INT], short)
    WHEN c = 'single_typo' THEN array_to_string(list_transform(w, lambda x, p: CASE WHEN p = at_ AND length(x) >= 2 THEN substr(x, 1, greatest(length(x) // 2 - 1, 0)) || substr(x, greatest(length(x) // 2 - 1, 0) + 2, 1) || substr(x, greatest(length(x) // 2 - 1, 0) + 1, 1) || substr(x, greatest(length(x) // 2 - 1, 0) + 3) ELSE x END), ' ')
    WHEN c = 'swapped_words' THEN array_to_string(list_reverse(w), ' ') WHEN c = 'added_division' THEN k || ' ' || ['Machine Works', 'Lending Desk', 'Nordic Region'][({_DRAW.format(what="division")} % 3 + 1)::INT] WHEN c = 'strong_identifier' THEN CASE WHEN coalesce(cik, lei, figi) IS NULL THEN k END WHEN pos THEN k
    WHEN c = 'fictional_company' THEN 'Quillmere Invented Works ' || i || ' LLC' WHEN c = 'insufficient_information' THEN ['Company', 'Holdings'][(i % 2 + 1)::INT] WHEN c = 'generic_name' THEN ['United Trading Group', 'Central Bank'][(i % 2 + 1)::INT]
    WHEN c = 'lookalike_name' THEN 'Lookalike Bakery ' || i WHEN c = 'private_company' THEN 'Dunlow Private Estate ' || i END AS entity_name,
  CASE WHEN c IN ('domain_only', 'conflicting_identifier') THEN domain WHEN c = 'fictional_company' THEN 'quillmere-invented-' || i || '.example' WHEN c = 'private_company' THEN 'dunlow-estate-' || i || '.example' END AS domain,
  CASE WHEN c = 'invalid_ticker' THEN 'ZZ' || lpad((i % 1000)::VARCHAR, 3, '0') WHEN traded THEN ticker END AS ticker, CASE WHEN c = 'invalid_ticker' THEN 'NASDAQ' WHEN traded AND c <> 'ticker_only' THEN exchange END AS exchange,
  CASE WHEN c = 'conflicting_identifier' THEN lpad(({_DRAW.format(what="cik")} % 1000000000)::VARCHAR, 10, '9') WHEN has_ids AND c <> 'figi_only' THEN cik END AS cik, CASE WHEN has_ids AND c NOT IN ('cik_only', 'figi_only') AND (c <> 'strong_identifier' OR cik IS NULL) THEN lei END AS lei,
  CASE WHEN has_ids AND c <> 'cik_only' AND (c <> 'strong_identifier' OR coalesce(cik, lei) IS NULL) THEN figi END AS figi, NULL::VARCHAR AS isin, NULL::VARCHAR AS cusip,
  CASE WHEN c = 'conflicting_country' THEN CASE WHEN country = 'GB' THEN 'US' ELSE 'GB' END WHEN pos THEN country ELSE 'US' END AS country, CASE WHEN c = 'historical_date' THEN '1900-01-01' ELSE '2025-01-01' END AS observation_date, c AS category, entity_id AS expected_entity_id,
  parent_id AS expected_parent_entity_id, CASE WHEN pos THEN sid END AS expected_security_id, pos::VARCHAR AS expected_match FROM n
"""


# --- name similarity for DuckDB, over pairs (a, b) of names of less than 200 characters


def may_reach(a: str, b: str, ta: str, tb: str, floor: float) -> str:
    """Whether lengths of the names or of their distinct tokens, or the tokens' Jaccard index, let a similarity reach the floor."""
    fit = lambda x, y: f"2 * least(length({x}), length({y})) >= {floor} * (length({x}) + length({y}))"
    joined = [f"array_to_string({t}, ' ')" for t in (ta, tb)]
    return f"({fit(a, b)} OR {fit(*joined)} OR len(list_intersect({ta}, {tb})) >= {floor} * len(list_distinct(list_concat({ta}, {tb}))))"


def similarities(pairs: str, floor: float) -> str:
    """CTEs up to similarities(a, b, similarity) of distinct pairs: the tokens' Jaccard index, and the ratios of the names and of their sorted tokens. A ratio is counted only where lengths and counts
    of characters let it reach the floor; a segment is parted at its longest common piece, the first of those in a and then in b."""
    tokens = lambda c: f"list_sort(list_distinct(string_split({c}, ' ')))"
    times = lambda c: f"length({c}) - length(replace({c}, ch, ''))"
    return f"""WITH RECURSIVE pairs AS (SELECT DISTINCT a, b, {tokens("a")} AS ta, {tokens("b")} AS tb FROM ({pairs})),
forms AS (SELECT a, b, 'whole' AS form, a AS x, b AS y FROM pairs UNION ALL SELECT a, b, 'sorted', array_to_string(ta, ' '), array_to_string(tb, ' ') FROM pairs),
able AS (SELECT * FROM forms WHERE 2 * least(length(x), length(y)) >= {floor} * (length(x) + length(y))
  AND 2 * list_sum(list_transform(list_distinct(string_split(x, '')), lambda ch: least({times("x")}, {times("y")}))) >= {floor} * (length(x) + length(y))),
segments AS (SELECT a, b, form, x, y, 0 AS n, 0 AS i, 0 AS j, length(x) + length(y) AS size, TRUE AS whole FROM able
  UNION ALL SELECT a, b, form, x, y, n, n * 1000 - best, CASE WHEN n > 0 THEN instr(y, substr(x, n * 1000 - best, n)) ELSE 0 END, size, FALSE FROM (
    SELECT *, CAST(floor((best + 999) / 1000) AS INT) AS n FROM (
      SELECT a, b, form, x, y, size, coalesce(list_max(flatten(list_transform(range(1, length(x) + 1), lambda i: list_transform(range(1, length(x) - i + 2), lambda n: CASE WHEN contains(y, substr(x, i, n)) THEN n * 1000 - i ELSE 0 END)))), 0) AS best FROM (
        SELECT a, b, form, size, CASE WHEN whole OR part = 0 THEN CASE WHEN whole THEN x ELSE left(x, i - 1) END ELSE substr(x, i + n) END AS x, CASE WHEN whole OR part = 0 THEN CASE WHEN whole THEN y ELSE left(y, j - 1) END ELSE substr(y, j + n) END AS y
        FROM segments, (VALUES (0), (1)) AS parts(part) WHERE (whole AND part = 0) OR n > 0) WHERE x <> '' AND y <> ''))),
ratios AS (SELECT a, b, max(ratio) AS ratio FROM (SELECT a, b, form, 2.0 * sum(n) / any_value(size) AS ratio FROM segments GROUP BY a, b, form) GROUP BY a, b),
similarities AS (SELECT p.a, p.b, greatest(CAST(len(list_intersect(ta, tb)) AS DOUBLE) / len(list_distinct(list_concat(ta, tb))), coalesce(r.ratio, 0)) AS similarity FROM pairs p LEFT JOIN ratios r ON r.a = p.a AND r.b = p.b)
"""
