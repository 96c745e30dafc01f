"""Every registered query of the city library against its SQL on the smallest tables."""

import duckdb
import pytest

from cityjobs.jobs.all_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET memory_limit = '4GB'")
    con.sql("SET max_temp_directory_size = '100MB'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, float):
            return int(v) if v == int(v) else round(v, 5)
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((str([plain(r[i]) for i in order]) for r in data))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == rows(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
