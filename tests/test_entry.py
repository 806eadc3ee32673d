"""The entry point: names agree, and graph queries give what their SQL gives."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__

DATA = Path("/root/testdata/sf0.001")


def test_names():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    if __spark_entry__.HAS_LLM:
        assert all(any(q.startswith(f"op{n}_") for q in queries) for n in range(1, 11)) and "pipeline" in queries
    else:
        assert not any(q.startswith("op") for q in queries)


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", ["degrees", "edge_blocks", "preorder_euler", "certificate", "component_stats", "gen_rmat", "file_text_header", "file_mesh", "file_binary_adjacency"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = __spark_entry__.queries()[name](spark, str(DATA))
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(want)
