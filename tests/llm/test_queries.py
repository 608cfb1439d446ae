"""The registered corpus queries: SQL twins where there are any, plans, contracts."""

from __future__ import annotations

from collections import Counter
from glob import glob
from os.path import basename

import duckdb
import pytest

import __spark_entry__ as registered
from trackwake.llm import oracles, queries

SMALL = "/root/testdata/sf0.001"
NATIVE = ("op1_quality_rules", "op3_source_mix", "op10_secret_scan")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob(f"{SMALL}/*.parquet"):
        table = basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return connection


def test_all_are_registered():
    assert set(queries.queries()) | {"pipeline"} <= set(registered.queries())
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 14))
    assert set(oracles.oracle_sql()) <= set(registered.oracle_sql())


@pytest.mark.parametrize("name", oracles.oracle_sql())
def test_query_equals_its_twin(spark, database, name):
    cursor = database.execute(oracles.oracle_sql()[name])
    names = [column[0] for column in cursor.description]
    theirs = Counter(cursor.fetchall())
    result = queries.queries()[name](spark, SMALL)
    assert sorted(result.columns) == sorted(names)
    assert Counter(tuple(r) for r in result.select(*names).collect()) == theirs


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans(spark, name):
    plan = queries.queries()[name](spark, SMALL)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian"))
