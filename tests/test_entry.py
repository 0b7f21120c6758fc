import os
import subprocess
import sys

import duckdb
import pytest
from pyspark import cloudpickle

import __spark_entry__ as entry
from tessera import queries as Q
from tessera.functions.similarity import similarity

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and Q.FLAGSHIP in Q.QUERIES


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["norm_name", "norm_suffixes", "norm_places", "norm_identifiers", "resolve_by_keys", "profile_records", "block_candidates", "entity_scores", "final_decision_counts", "period_scopes", "relationship_cycles", "parent_paths", "eval_by_pathway"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "pages", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a, b = Q.QUERIES[name](spark, SF).toPandas(), con.execute(Q.ORACLE_SQL[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = lambda d: sorted(tuple("" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in d[columns].itertuples(index=False))
    assert rows(a) == rows(b) and len(a)


def test_workers_need_no_package_on_their_path(tmp_path):
    call = "import pickle, sys; print(pickle.load(sys.stdin.buffer)('acme one', 'one acme'))"
    said = subprocess.run([sys.executable, "-I", "-c", call], input=cloudpickle.dumps(similarity), cwd=tmp_path, capture_output=True, check=True)
    assert said.stdout.strip() == b"1.0"
