"""Every registered query against its SQL on the same tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from sigillum.plans import catalog

TESTDATA = Path("/root/testdata")
SCALES = ["sf0.001", "sf0.01", "sf0.1"]


def sql_rows(sf_dir, sql):
    con = duckdb.connect()
    for table in sf_dir.glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    relation = con.execute(sql)
    names = [column[0] for column in relation.description]
    return sorted(names), rows_by_name(names, relation.fetchall())


def rows_by_name(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("scale", SCALES)
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, name, scale):
    sf_dir = TESTDATA / scale
    result = contract.queries()[name](spark, str(sf_dir))
    names, expected = sql_rows(sf_dir, contract.oracle_sql()[name])
    assert sorted(result.columns) == names
    actual = rows_by_name(result.columns, [tuple(row) for row in result.collect()])
    assert expected
    assert actual == expected


def test_every_query_of_the_library_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry(spark):
    assert {row.status for row in contract.entry(spark).collect()} == {
        "OK", "MISMATCH", "MISSING", "UNLISTED", "CONFLICT", "NO_DIGEST",
    }


def test_planted_faults_are_all_found(spark):
    summary = contract.queries()["integrity_summary"](spark, str(TESTDATA / "sf0.01"))
    assert {row.status: row.n for row in summary.collect()} == {
        "OK": 185, "MISMATCH": 25, "MISSING": 30, "UNLISTED": 25, "CONFLICT": 5, "NO_DIGEST": 5,
    }
