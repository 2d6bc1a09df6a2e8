"""Every registered query of the library against its oracle SQL on DuckDB, at the smallest scale."""

import datetime
import decimal
from collections import Counter

import duckdb
import pytest

from ledgerlark import plans

#: Families that need more rows than the smallest scale has.
SPARSE = {"X34_suppressed_names", "W4_strongest_windows", "W3_insider_clusters", "J13_unfiled_periods", "C19_C20_window_detail", "A14_period_returns", "W15_F15_curated_clusters", "SC8_embedded_inner", "C11_cluster_gains"}


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return str(v)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_oracle(spark, sf_dir, duck, name):
    df = plans.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert rows or name in SPARSE
    if name in plans.SQL:
        found = duck.execute(plans.SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert rows == Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_every_query_is_known():
    assert set(plans.SQL) <= set(plans.QUERIES) and len(plans.QUERIES) > 150
