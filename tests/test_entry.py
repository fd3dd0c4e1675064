import importlib
import sys

import pytest


def test_every_oracle_has_its_query_and_the_flagship_runs(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert entry.entry(spark).count() > 0


def test_entry_imports_without_the_training_data_part(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "prismgraph.llm", None)
    again = importlib.reload(entry)
    assert again.queries() and not any(n.startswith("op") for n in again.queries()) and "pipeline" not in again.queries()
    monkeypatch.undo()
    importlib.reload(entry)


def _duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ["bucket_order_all", "overlap_order", "diff_conversation", "infer_order", "claims_bucket_order", "view_geography", "exact_conversation", "closure_customers"])
def test_queries_match_sql(spark, name):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    con = _duck(sf)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(str([dict(zip(columns, r))[c] for c in sorted(columns)]) for r in cursor.fetchall())
    df = entry.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(str([r[c] for c in sorted(columns)]) for r in df.collect()) == want
