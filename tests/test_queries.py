"""Every query with SQL against DuckDB on the smallest tables."""

from decimal import Decimal

import duckdb
import pytest

from verdance.plans import coverage_queries, matching_queries, more_queries, policy_queries, serving_queries, source_queries  # noqa: F401
from verdance.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, (float, Decimal)):
        return f"{float(value):.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    with duckdb.connect() as db:
        for t in TABLES:
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        result = db.sql(SQL[name])
        assert sorted(result.columns) == columns
        places = [result.columns.index(c) for c in columns]
        want = sorted(tuple(plain(row[i]) for i in places) for row in result.fetchall())
    assert got == want


def test_entry_has_stable_schema(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["request_id", "factor_id", "status", "calc_status", "emissions"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
