import hashlib
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat, decontaminate, mixing, ngram_join, url_filter
from tests.llm.helpers import SCHEMA, documents, frame, prose

# --- chat


def test_chat_round_trip_of_any_text(spark):
    r = random.Random(1)
    bits = ["<", "|", "\\", "<|", "<\\|", "<|im_end|>", "<|im_start|>", "<|im_sep|>", "<|im_cut|>", "a", "\n", "é", "$1", ""]
    rows = []
    for c in range(60):
        for t in range(r.randrange(1, 7)):
            rows.append((c, t * r.choice([1, 200]), r.choice(["user", "assistant", "assistant", None, "<|im_sep|>"]), r.choice([None, "".join(r.choice(bits) for _ in range(8))])))
    rows += [(7, 0, "user", "same"), (7, 0, "user", "same"), (None, None, None, None), (None, 3, "assistant", "x" * 100_000)]
    back = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).cache()
    got = {x.conv_id: x for x in chat.digests(back).collect()}
    for x in back.collect():
        for t in x.turns:
            assert re.sub(r"<\\(\\*)\|", r"<\1|", x.formatted[t.start : t.end]) == t.text and t.loss == (t.role == "assistant")
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        said = "".join(f"{role}\n{x}\n" for _, role, x in turns)
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_a_very_long_conversation_costs_its_turns(spark):
    """Places are right over the ends of runs, and time is not that of the turns' square."""
    import time

    took = []
    for n in (300, 50_000, 100_000):  # the first compiles
        turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t<|"), F.col("id").cast("string")).alias("text"))
        began = time.time()
        x = chat.read_back(chat.format_conversations(turns)).first()
        took.append(time.time() - began)
        assert len(x.turns) == n and all(x.formatted[t.start : t.end] == f"t<\\|{i}" for i, t in enumerate(x.turns))
    assert took[2] < 2.5 * took[1] + 3


def test_chat_merges_turns_of_one_role(spark):
    rows = [(1, 0, "user", "a", 1), (1, 1, "user", "b", 1), (1, 500, "user", "c", 1), (1, 501, "assistant", "<|im_end|>", 1)]
    f = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chunk int")).first().formatted
    assert f == "<|im_start|>user<|im_sep|>a<|im_cut|>b<|im_cut|>c<|im_end|>\n<|im_start|>assistant<|im_sep|><\\|im_end|><|im_end|>\n"
    ties = [(1, 0, "<|", "x"), (1, 0, "<a", "y"), (1, 0, "<a", "b")]
    f = chat.read_back(chat.format_conversations(spark.createDataFrame(ties, "conv_id long, turn long, role string, text string"))).first()
    assert [(t.role, t.text) for t in f.turns] == sorted((r, t) for _, _, r, t in ties)
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# --- urls


def brute_url(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, action = max(fits, default=(0, None, "allow"))
    return host, path, rule, action


def test_urls_against_brute_force(spark):
    r = random.Random(2)
    hosts = ["example.com", "a.example.com", "xexample.com", "EXAMPLE.net", "b.c.example.net", "org", "w.org", "com", "", "É.com", "a..com"]
    urls = [f"{r.choice(['http', 'HTTPS', ''])}{r.choice(['://', ':/', '://'])}{r.choice(hosts)}{r.choice(['', '/', '/en/', '/en/7', '/en/71', '/de/8?x=/en/', '/es/#a', '?q', '/EN/7', '/en'])}" for _ in range(500)]
    urls += [None, "", "://", "x://y://com/en/", "http://com/en/\nx"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.filter_urls(pages, list(url_filter.RULES)).collect()}
    assert got == {i: brute_url(u, url_filter.RULES) for i, u in enumerate(urls)}
    joined = url_filter.filter_urls(pages.withColumns({"best": F.lit(1), "keys": F.lit(2), "row": F.lit(3)}), list(url_filter.RULES), most=1)
    assert {"best", "keys", "row"} <= set(joined.columns) and {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in joined.collect()} == got
    many = [(r.choice(["block", "allow"]), r.choice(["com", "example.com", "org", "example.net", "a.example.com"]), f"/{r.choice(['en', 'de', 'es'])}/{i % 90}"[: r.randrange(1, 8)]) for i in range(400)]
    many = [*{(h, p): (a, h, p) for a, h, p in many}.values()]
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.filter_urls(pages, many).collect()}
    assert got == {i: brute_url(u, many) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(pages.where("false"), list(url_filter.RULES)).count() == 0
    assert {x.verdict for x in url_filter.filter_urls(pages, []).collect()} == {"allow"}


def test_query_judges_by_the_rules_of_its_contract(spark, tmp_path):
    """The contract's list is written out here, so that a rule's word in RULES is tested too."""
    contract = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    hosts = ["com", "x.com", "example.com", "a.example.com", "net", "x.net", "example.net", "a.example.net", "xexample.net", "org", "x.org", "info"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/en/", "/en/71", "/en/8", "/de/", "/de/7", "/de/81", "/de/x?/en/", "/es/", "/de")] + [None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.query(spark, str(tmp_path)).collect()}
    assert got == {i: brute_url(u, contract) for i, u in enumerate(urls)}
    assert {(rule, verdict) for _, _, rule, verdict in got.values()} == {("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), (None, "allow")}


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(20000).selectExpr("concat('k', id) as key")
    listed = spark.range(0, 20000, 37).selectExpr("concat('k', id) as key")
    levels = url_filter.build_cascade(keys, listed)
    assert len(levels) > 1
    assert url_filter.build_cascade(keys, listed, 500) is None and url_filter.build_cascade(keys, listed.where("false")) == []
    assert {x.key for x in keys.where(url_filter.is_listed(levels, F.col("key"))).collect()} == {f"k{i}" for i in range(0, 20000, 37)}


def test_parted_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(20000).selectExpr("concat('k', id) as key")
    listed = spark.range(0, 30000, 7).selectExpr("concat('k', id) as key")
    asked = keys.union(keys.where("key = 'k7'").selectExpr("explode(sequence(1, 3000)) as i", "key").select("key"))  # a hot key
    for per in (100, 1_000_000):
        table = url_filter.parted_cascade(asked, listed.union(listed.limit(5)), per)
        assert table.parts == (43 if per == 100 else 1) and len(table.levels) > 2 and table.filters.count() == table.parts
        got = [x.key for x in table.listed(asked, "key").collect()]
        assert len(got) == len(set(got)) + 3000 and set(got) == {f"k{i}" for i in range(0, 20000, 7)}


def test_rules_as_a_table_of_any_length(spark):
    rules = spark.range(3000).selectExpr("case when id % 3 = 0 then 'allow' else 'block' end as action", "concat('h', id, '.com') as host", "case when id % 2 = 0 then '/a' end as path", "id as extra")
    rules = rules.union(spark.createDataFrame([("block", None, "/a", 1), ("other", "h9000.com", "", 1), (None, "h9001.com", "", 1), ("block", "", "", 1), ("block", "h1.com", "", 1)], "action string, host string, path string, extra long"))
    urls = [f"http://{w}h{i}.com{p}" for i in [*range(0, 3000, 101), 9000, 9001] for w in ("", "www.", "x") for p in ("", "/a/b", "/b")] + [None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    plain = [(x.action, x.host, x.path or "") for x in rules.collect() if x.host and x.action in ("block", "allow")]
    want = {i: brute_url(u, plain) for i, u in enumerate(urls)}
    for most in (1, 1500, 1_000_000):
        got = url_filter.filter_urls(pages, rules, most=most)
        assert {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in got.collect()} == want
    assert {x.verdict for x in url_filter.filter_urls(pages, rules.where("false")).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.where("false"), rules, most=1).count() == 0


# --- decontamination


def brute_windows(texts, items):
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or "")) if w]
    windows = []
    for i, t in items:
        w = cut(t)
        windows += [(str(i), w[k : k + 10]) for k in range(max(1, len(w) - 9))] if w else []
    out = []
    for t in texts:
        w, hit, names = cut(t), set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit |= set(range(k, k + len(x)))
                    names.add(i)
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination_against_brute_force(spark):
    passage = prose(25, 31)
    w = passage.split()
    items = [(1, passage), (2, passage), (10, "Only three words"), (3, None), (4, ""), (5, "solo"), (6, " ".join(w[:9])), (7, " ".join(w[5:15]).upper())]
    texts = [
        None, "", "  ", passage, "x " + " ".join(w[:10]) + " y", " ".join(w[:9]) + " z", " ".join(w[1:10]), "only, three-words! only three words", "a solo b solo", "z " + passage + " " + passage,
        " ".join(w[:14] + ["cut"] + w[14:]), "three words only", prose(5000, 32) + " " + " ".join(w[3:15]) + " " + prose(50, 33), " ".join(w[:10] + w[:10]),
    ]
    docs = spark.createDataFrame([(i % 12, t, None, None, 0, "k", 1, 2, 3, "w") for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, win string")
    got = sorted((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontaminate.find(docs, bench).collect())
    assert got == sorted((i % 12, *b) for i, b in enumerate(brute_windows(texts, items)))
    assert decontaminate.find(frame(spark, []), bench).count() == 0
    assert {x.n_hit for x in decontaminate.find(docs, bench.where("false")).collect()} == {0}


# --- mixing


def test_mix_meets_its_targets(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 50, 400])), None, r.choice(["b", "a", "a", None, "Ω"])) for i in range(600)] + [(5, None, None, "a"), (7, "x y", None, "a"), (7, "x y", None, "a"), (None, "x y z", None, None)]
    docs = spark.createDataFrame([(*x, 0, "k", 1, 2, 3, "w") for x in rows], SCHEMA)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    taken, size, target = {}, {}, {}
    for x in got:
        assert 0 <= x.taken <= 2 * x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
        size[x.source], target[x.source] = x.source_size, x.target
    total = sum(size.values())
    assert sum(target.values()) == pytest.approx(1.5 * total)
    for s in size:
        assert target[s] <= 2 * size[s] + 1e-6 and abs(taken[s] - target[s]) <= 1
    weights = dict(zip(["a", "b", "Ω", None], (3, 1, 2, 3), strict=True))
    level = max(target[s] / weights[s] for s in size)
    for s in size:
        assert target[s] == pytest.approx(min(2 * size[s], level * weights[s])) or target[s] == pytest.approx(2 * size[s])
    assert mixing.mix(frame(spark, [])).count() == 0
    assert {x.taken for x in mixing.mix(frame(spark).where("text is null")).collect()} == {0}


def brute_mix(rows):
    """(doc_id, source, size, taken) of (doc_id, text, source), by sorting."""
    rows = [(d, t, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in rows]
    sources = sorted({s for _, _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(x[3] for x in rows if x[2] == s) for s in sources}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    total, full = mixing.SHARE * sum(size.values()), set()
    while True:
        level = (total - sum(2 * size[s] for s in full)) / (sum(weight[s] for s in sources if s not in full) or 1)
        over = {s for s in sources if s not in full and level * weight[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    out = []
    for s in sources:
        target = 2.0 * size[s] if s in full else level * weight[s]
        own = [x for x in rows if x[2] == s]
        copies = int(target // size[s]) if size[s] else 0
        rest = math.floor(target + 0.5) - copies * size[s]
        certain, rate = 0, 0.0
        for n in sorted({x[3] for x in own if x[3]}, reverse=True) if rest > 0 else []:
            rate = (rest - certain) / sum(x[3] ** 2 for x in own if x[3] <= n)
            if rate * n <= 1:
                break
            certain += n * sum(x[3] == n for x in own)
        ranked = []
        for d, t, _, n in own:
            u = (int(hashlib.md5(f"{mixing.SEED}:{'' if d is None else d}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
            p = min(1.0, rate * n)
            ranked.append((u / (1 - u) * ((1 - p) / p) if p else math.inf, (d is not None, d or 0), n, d))
        for _, _, n, d in sorted(ranked):
            extra = max(0, min(n, rest))
            rest -= extra
            out.append((str(d), str(s), n, copies * n + extra))
    return out


def test_mix_against_brute_force(spark):
    r = random.Random(11)
    rows = [(r.choice([None, *range(500)]), " ".join(["w"] * r.choice([0, 1, 5, 50, 400, 7000])) + f" {i}", r.choice("aaaaabbc") if i % 9 else None) for i in range(400)]
    for given in (rows, [(1, "x " * 50, "a"), (2, "x", "b")]):
        got = mixing.mix(spark.createDataFrame(given, "doc_id long, text string, source string")).collect()
        assert sorted((str(x.doc_id), str(x.source), x.size, x.taken) for x in got) == sorted(brute_mix(given))


def test_inclusion_follows_size(spark):
    """Over many sources of the same sizes a document is taken as often as its inclusion probability says, longer ones more often."""
    sources, sizes = 40, [2, 5, 5, 10, 20, 40, 80, 300] * 4
    docs = spark.createDataFrame([(k * 100 + i, " ".join(["w"] * n), f"s{k}") for k in range(sources) for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    shares = {}
    for x in mixing.mix(docs, weights=(1.0,), share=0.9).collect():
        shares.setdefault((x.size, x.inclusion), []).append(x.taken / x.size)
    assert len(shares) == 7 and {p for n, p in shares if n == 300} == {1.0}
    for (_, p), taken in shares.items():
        assert abs(sum(taken) / len(taken) - p) < 0.1


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    rows = [x for x in documents() if x[0] != 10] + [(200, "lead " + prose(12, 50) + " tail", "en", "a", 0, "k", 1, 2, 3, "w")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(12, 50))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, str(tmp_path)))
        assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        after.append(sorted((x.doc_id or -1) for x in docs.select("doc_id").collect()))
    assert after == [[-1, 1, 2, 3, 4, 8, 9, 12, 12, 13, 14, 15, 200], [-1, 1, 8, 12, 13, 14, 15, 200], [-1, 1, 8, 12, 13, 14, 15]]
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert mixed and all(x.taken > 0 and (x.doc_id or -1) in after[-1] for x in mixed)


def test_one_row_of_each_component_stays(spark):
    x, a = prose(100, 60), prose(100, 61)
    x2, x3 = x + " one", x + " more"
    rows = [(3, x), (5, a), (5, x2), (5, x2), (None, x3), (7, prose(100, 62)), (7, prose(100, 62)), (8, ""), (8, ""), (9, "")]
    y = prose(100, 63)
    rows += [(6, y + " one"), (6, y), (None, prose(100, 64)), (None, prose(100, 64) + " two"), (None, prose(100, 65))]
    docs = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, source string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    ids = sorted(str(i) for i, _ in got)
    assert ids == ["3", "5", "6", "7", "8", "8", "9", "None", "None"] and (5, a) in got and (5, x2) not in got
    assert sum(t.startswith(prose(100, 64)) for _, t in got) == 1 and (None, prose(100, 65)) in got


#: Names that operators use inside, and those of what they add.
CLASHING = "gone often h_doc h_key score lang_pred held_out mark root key m k n c0 c1 c2 stays none words contaminated size taken bin q doc light heavy uid"


def test_stages_against_brute_force_with_clashing_columns(spark, tmp_path):
    """Each stage on its own input: shared and null doc_ids, repeated rows with different sources, columns named like those inside."""
    r, passage = random.Random(7), prose(30, 70)
    en = "the of and that with ing they have".split()
    texts = [" ".join(r.choice(en) + str(r.randrange(500)) for _ in range(60)) for _ in range(14)]
    rows = [(r.choice([None, 1, 2, 3, 4, 5]), t) for t in texts for _ in range(2)]
    rows += [(r.choice([None, 1, 6, 7]), f"{texts[i]} more{j}") for i in range(6) for j in range(3)]
    rows += [(8, None), (None, None), (9, ""), (9, "12 ??"), (10, f"a {passage} b"), (None, f"b {' '.join(passage.split()[3:13])}"), (11, " ".join(passage.split()[:9]))]
    names = CLASHING.split()
    rows = [(d, t, None if i % 3 else "en", r.choice(["a", "b", None]), *[f"{n}{i}" for n in names]) for i, (d, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names)
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    shown = lambda rows: sorted(map(repr, map(tuple, rows)))

    left = [x for x in rows if x[1] and any(c.isalpha() for c in x[1])]
    assert shown(corpus_pipeline.identify_language(spark, docs, str(tmp_path)).collect()) == shown(left)

    by_json = lambda x: json.dumps({k: v for k, v in zip(["c%d" % i for i in range(len(x))], x, strict=True) if v is not None}, separators=(",", ":"))
    parts, sets = ngram_join.Union(), []
    for x in left:
        w = x[1].lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    for i in range(len(left)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parts.join(i, j)
    groups = {}
    for i, x in enumerate(left):
        groups.setdefault(parts.root(i), []).append(x)
    one = [min(g, key=lambda x: (x[0] is None, x[0] or 0, hashlib.md5(x[1].encode()).hexdigest(), by_json(x))) for g in groups.values()]
    docs = spark.createDataFrame(left, schema)
    assert shown(corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()) == shown(one) and len(one) < len(left)

    clean = [x for x, h in zip(one, brute_windows([x[1] for x in one], [(1, passage)]), strict=True) if not h[-1]]
    docs = spark.createDataFrame(one, schema)
    assert shown(corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()) == shown(clean) and len(clean) == len(one) - 2

    mixed = corpus_pipeline.mix_sources(spark, spark.createDataFrame(clean, schema), str(tmp_path)).collect()
    want = brute_mix([(x[0], x[1], x[3]) for x in clean])
    assert sorted((str(x.doc_id), str(x.source), x.size, x.taken) for x in mixed) == sorted(w for w in want if w[-1] > 0)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nothing_is_swallowed():
    assert ngram_join.needed(10) == 8 and ngram_join.needed(11) == 9
