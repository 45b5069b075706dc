"""Every catalogue query against its SQL on the smallest tables."""

import duckdb
import pytest

from structlens import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def _rows(rows):
    clean = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(clean, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, db, name):
    df = catalog.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    want = db.execute(f"SELECT {', '.join(cols)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert _rows(df.select(*cols).collect()) == _rows(want)


def test_every_query_has_sql_but_the_empty_one():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"diagnostics"}
