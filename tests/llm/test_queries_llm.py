"""Queries with SQL against that SQL on the small driver tables."""

import os

import duckdb
import pytest

from lotledger.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not mounted")
@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, result.fetchall())) == sorted(repr(tuple(r[n] for n in names)) for r in got.collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not mounted")
@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES])
def test_query_without_sql_covers_its_table(spark, name):
    """One row a document (or k a query), with the contract's columns first; their values are held
    against brute force in the operators' own tests."""
    got = queries.QUERIES[name](spark, SF)
    rows = got.collect()
    if name.startswith("op6"):
        assert got.columns == ["query_id", "rank", "vec_id", "score"] and len(rows) == 25 * 20
    else:
        ids = sorted(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
        assert sorted(r["doc_id"] for r in rows) == ids
