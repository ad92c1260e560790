import math

import duckdb
import pytest

import __spark_entry__ as entry
from pageloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if hasattr(value, "timestamp"):
        return str(value)[:26].replace("+00:00", "")
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def database():
    import glob
    import os

    base = duckdb.connect()
    base.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        base.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return base


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, database, name):
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(columns).collect())
    if name in catalog.oracle_sql():
        relation = database.sql(catalog.oracle_sql()[name])
        assert sorted(relation.columns) == columns
        assert rows == sorted(tuple(map(plain, r)) for r in relation.select(", ".join(f'"{x}"' for x in columns)).fetchall())


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["id", "status", "rank", "chunk_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
