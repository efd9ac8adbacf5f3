"""Every registered query against its SQL on the smallest tables, and the contract of the entry module."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tidemill.plans import registry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, bool) or type(value).__name__ in ("bool", "bool_"):
        return str(float(value))
    try:
        return f"{float(value):.7g}"
    except (TypeError, ValueError):
        return str(value)[:19].replace(" 00:00:00", "").replace("T00:00:00", "")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    got = rows(registry.QUERIES[name](spark, sf_dir).toPandas())
    want = rows(duck.execute(registry.ORACLE_SQL[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    # ten codes are too few for a cross-section of twenty
    assert registry.QUERIES[name](spark, sf_dir).count() > 0 or name == "ic_significance"


def test_entry(spark):
    shares = __spark_entry__.entry(spark).toPandas()
    assert len(shares) > 0 and (shares.groupby("code").share.sum().round(6) == 1).all()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
