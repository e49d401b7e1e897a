"""Every registered query of the log engine against its SQL."""

import duckdb
import pytest

from logloom.queries import ORACLE, QUERIES

SIZES = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module", params=SIZES)
def duck(request):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{request.param}/{t}.parquet'")
    return request.param, c


def plain(value):
    return round(value, 6) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    sf_dir, sql = duck
    ours = QUERIES[name](spark, sf_dir)
    theirs = sql.sql(ORACLE[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda got, names: sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in got)
    assert rows(ours.collect(), ours.columns) == rows(theirs.fetchall(), theirs.columns)


def test_generated_rows(spark):
    assert [tuple(r) for r in QUERIES["generate_round_trip"](spark, SIZES[0]).collect()] == [("ok", 5000)]
