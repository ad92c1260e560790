import glob
import os

import duckdb
import pytest

from pageloom.llm import queries
from tests.test_registry import plain

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    base = duckdb.connect()
    base.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        base.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return base


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, database, name):
    df = queries.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    relation = database.sql(queries.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    rows = sorted(tuple(map(plain, r)) for r in df.select(columns).collect())
    assert rows and rows == sorted(tuple(map(plain, r)) for r in relation.select(", ".join(f'"{x}"' for x in columns)).fetchall())


def test_other_queries_keep_every_row(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name in ("p6_ids", "p8_statistics"):
        assert queries.queries()[name](spark, FOLDER).count() == documents
    dealt = queries.queries()["p3_splits"](spark, FOLDER)
    assert dealt.count() == spark.read.parquet(f"{FOLDER}/questions.parquet").count() and dealt.where("split is null").count() == 0
    forest = queries.queries()["p3_forest"](spark, FOLDER)
    assert forest.count() > 0 and forest.columns == ["id", "page", "group"]
