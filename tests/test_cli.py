import json

import pytest

from tessera.cli import main

MASTER = "internal_entity_id,internal_security_id,canonical_name,ticker,exchange,cik,domain,country,entity_valid_from,security_valid_from\ne1,s1,Acme Widgets Inc,ACM,NASDAQ,123,acme.com,US,2000-01-01,2001-01-01\ne2,s2,Globex Corp,GLX,NYSE,124,globex.com,DE,2000-01-01,2001-01-01\n"
RECORDS = "record_id,company_name,website,symbol,exchange,event_date\n1,ACME WIDGETS,acme.com,ACM,NASDAQ,2020-01-01\n2,Nobody,,,,2020-01-01\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "m.csv").write_text(MASTER)
    (tmp_path / "r.csv").write_text(RECORDS)
    (tmp_path / "rules.json").write_text(json.dumps([{"id": "n", "conditions": {"entity_name": "Nobody"}, "action": "unmatched", "result": {}}]))
    (tmp_path / "rel.csv").write_text("relationship_id,child_entity_id,parent_entity_id,relationship_type,valid_from\nr,e2,e1,owned_by,2010-01-01\n")
    return tmp_path


def test_commands(spark, folder, capsys):
    go = lambda *a: (main([x.replace("@", f"{folder}/") for x in a], spark), capsys.readouterr().out)
    assert json.loads(go("preview", "@r.csv")[1])["mapping"]["symbol"] == "ticker"
    assert json.loads(go("validate", "@r.csv")[1]) == {"valid": True, "records": 2}
    code, out = go("resolve", "@r.csv", "--master", "@m.csv", "--rules", "@rules.json", "--relationships", "@rel.csv", "--output", "@out.parquet")
    assert code == 0 and json.loads(out)["decisions"] == {"entity_and_security_matched": 1, "unmatched": 1}
    assert go("export", "@out.parquet", "--status", "matched", "--output", "@flat.csv")[0] == 0
    assert [r.record_id for r in spark.read.csv(str(folder / "flat.csv"), header=True).collect()] == ["1"]
    assert json.loads(go("inspect", "@rel.csv", "--entity", "e2", "--date", "2020-01-01")[1])["parents"][0]["to_id"] == "e1"
    assert json.loads(go("relationships", "@rel.csv")[1])["valid"] and json.loads(go("rules", "@rules.json")[1])["rules"] == 1
    (folder / "truth.csv").write_text("record_id,expected_entity_id\n1,e1\n2,\n")
    assert json.loads(go("evaluate", "@out.parquet", "--truth", "@truth.csv", "--html", "@x.html")[1])["decision_accuracy"] == 1.0
    assert go("generate", "@m.csv", "--count", "44", "--output", "@g.jsonl")[0] == 0 and spark.read.json(str(folder / "g.jsonl")).count() == 44
    (folder / "bad.csv").write_text("a,a\n1,2\n")
    assert go("validate", "@bad.csv")[0] == 2
