"""Every registered query against its SQL counterpart, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="driver tables are not present")
SLOW = {"stream_detect", "stream_detect_late"}  # compared with the batch rules in test_plans


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in SF.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        return (None if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n not in SLOW])
def test_query(spark, db, name):
    frame = entry.queries()[name](spark, str(SF))
    result = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert canonical([tuple(r) for r in frame.collect()], frame.columns) == canonical(result.fetchall(), columns)
