"""Every registered query of the core beside its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from compare import rows_of
from ravelin.plans import catalog

SF = Path("/root/testdata/sf0.001")
QUERIES = {name: f for module in catalog.MODULES for name, f in module.queries().items()}
SQL = {name: sql for module in catalog.MODULES for name, sql in module.oracle_sql().items()}


@pytest.fixture(scope="module")
def db():
    if not SF.exists():
        pytest.skip("no test tables here")
    connection = duckdb.connect()
    for path in SF.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, str(SF))
    mine = pd.DataFrame([r.asDict() for r in got.collect()], columns=got.columns)
    result = db.execute(SQL[name])
    theirs = pd.DataFrame(result.fetchall(), columns=[c[0] for c in result.description])
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows_of(mine) == rows_of(theirs)


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
def test_failing_pages_are_in_the_web(spark):
    from ravelin.plans import search_queries as q

    web = q.faulty_web(spark, str(SF))
    assert web.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    pages = q._crawled(spark, str(SF), max_pages=q.CRAWL_PAGES).pages
    assert {"status 404", "content type application/pdf"} <= {r.err for r in pages.select("err").collect()}
