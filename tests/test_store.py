"""Lists of codes: what has no name, and names that CSV has to quote."""

from tidemill.sources import store


def test_a_list_keeps_null_and_empty_names_apart(spark, tmp_path):
    path = f"file://{tmp_path}/list"
    rows = [("1", "one"), ("2", None), ("3", ""), ("4", 'a "b", c'), ("5", " d "), ("6", "e\nf"), ("7", "g\\"), ("8", '\\"h')]
    spark.createDataFrame(rows + rows, "code string, name string").write.options(**store.LIST).csv(path)
    assert sorted(map(tuple, store.read_list(spark, path).collect())) == rows


def test_a_list_without_names(spark, tmp_path):
    (tmp_path / "list.csv").write_text("code\n000001.SZ\n600519.SH\n")
    found = store.read_list(spark, f"file://{tmp_path}/list.csv")
    assert found.dtypes == [("code", "string"), ("name", "string")]
    assert sorted(map(tuple, found.collect())) == [("000001.SZ", None), ("600519.SH", None)]


def test_the_list_query_equals_its_sql_with_null_apart_from_empty(spark, sf_dir):
    import duckdb

    import __spark_entry__

    db = duckdb.connect()
    for t in ("supplier", "nation", "lineitem", "events", "orders", "customer", "part", "region"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = db.execute(__spark_entry__.oracle_sql()["stock_list"]).fetchall()
    got = [tuple(r) for r in __spark_entry__.queries()["stock_list"](spark, sf_dir).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
