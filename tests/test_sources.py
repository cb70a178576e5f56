"""Extract, sources and integrity operators on small frames."""

import datetime as dt
import logging

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import integrity as I
from ledgerlake.sources import extract as X


SETTINGS = {"host": "db", "user": "u", "password": "secret", "database": "erp1"}


def test_connection_options_pick_the_backtick_dialect(spark):
    opts = X.jdbc_options(SETTINGS)
    assert "secret" not in opts["url"] and opts["password"] == "secret" and opts["fetchsize"] == "50000"
    dialect = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(opts["url"])
    assert dialect.quoteIdentifier("posting_date") == "`posting_date`"
    for name in SETTINGS:
        with pytest.raises(ValueError, match=name):
            X.jdbc_options({k: v for k, v in SETTINGS.items() if k != name})


def test_splits_of_a_database_read():
    days = X.RangeSplit("posting_date", dt.date(2026, 1, 1), dt.date(2026, 7, 1), 12).options()
    assert days == {"partitionColumn": "posting_date", "lowerBound": "2026-01-01", "upperBound": "2026-07-01",
                    "numPartitions": "12"}
    import duckdb
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT DATE '2026-01-01' + CAST(i AS INT) AS d FROM range(400) r(i) "
                "UNION ALL SELECT NULL")
    cuts = X.day_predicates("d", [dt.date(2026, 7, 1), dt.date(2026, 3, 1), dt.date(2025, 1, 1)])
    counts = [con.execute(f"SELECT count(*) FROM t WHERE {p}".replace("`", '"')).fetchone()[0] for p in cuts]
    assert len(cuts) == 4 and sum(counts) == 401
    assert X.day_predicates("d", []) == ["1 = 1"]


def test_bound_parameters_are_literals():
    text = "SELECT ':a', `x:a`, :a, :b FROM t WHERE d >= :d AND n = :n AND s = :nothing"
    got = X.bind(text, {"a": "O'Neil \\ x", "b": 3, "d": dt.date(2026, 7, 1), "n": 1.5, "nothing": None})
    assert got == ("SELECT ':a', `x:a`, 'O''Neil \\\\ x', 3 FROM t WHERE d >= '2026-07-01' AND n = 1.5 AND s = NULL")
    with pytest.raises(KeyError):
        X.bind("SELECT :missing", {})


def test_an_empty_rerun_empties_its_day_and_versions_are_read_once(spark):
    root = X.scratch_path(spark, "t_versions")
    schema = "name string, modified timestamp_ntz, v int"
    at = lambda d: dt.datetime(2026, 7, d)
    for day, rows in (("2026-07-01", [("A", at(1), 1), ("B", at(1), 1), (None, at(1), 0)]), ("2026-07-02", [("A", at(2), 2)]),
                      ("2026-07-03", [("C", at(3), 3)])):
        X.extract_partition(X.frame_source({"tabX Y": spark.createDataFrame(rows, schema)}), "tabX Y", root, ds=day)
    latest = X.parquet_source(spark, root)("tabX Y")
    assert latest.columns == ["name", "modified", "v"]
    assert sorted((r["name"] or "", r["v"]) for r in latest.collect()) == [("", 0), ("A", 2), ("B", 1), ("C", 3)]
    assert [r["v"] for r in X.parquet_source(spark, root, ds="2026-07-01")("tabX Y").where("name = 'A'").collect()] == [1]
    empty = spark.createDataFrame([], schema)
    res = X.extract_partition(X.frame_source({"tabX Y": empty}), "tabX Y", root, ds="2026-07-03")
    assert res.rows == 0
    assert X.parquet_source(spark, root)("tabX Y").where("name = 'C'").count() == 0
    assert X.parquet_source(spark, root)("tabX Y").count() == 3


def test_partition_rerun_replaces_only_its_day(spark):
    root = X.scratch_path(spark, "t_partition")
    day1 = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    day2 = spark.createDataFrame([(3, "c")], "k int, v string")
    X.extract_partition(X.frame_source({"tabX Y": day1}), "tabX Y", root, ds="2026-07-01")
    X.extract_partition(X.frame_source({"tabX Y": day2}), "tabX Y", root, ds="2026-07-02")
    again = spark.createDataFrame([(9, "z")], "k int, v string")
    res = X.extract_partition(X.frame_source({"tabX Y": again}), "tabX Y", root, ds="2026-07-01")
    assert res.path.endswith("tabx_y/ds=2026-07-01") and res.rows == 1
    back = spark.read.option("basePath", f"{root}/tabx_y").parquet(f"{root}/tabx_y")
    got = sorted((r["k"], str(r["ds"])) for r in back.collect())
    assert got == [(3, "2026-07-02"), (9, "2026-07-01")]


def test_extract_counts_rows_and_warns_on_empty(spark, caplog):
    df = spark.range(10).withColumn("modified", F.lit("2026-07-01 00:00:00").cast("timestamp_ntz"))
    res = X.extract_query(df, X.scratch_path(spark, "t_count"))
    assert res.rows == 10 and spark.read.parquet(res.path).count() == 10
    with caplog.at_level(logging.WARNING):
        empty = X.extract_query(df.where("id < 0"), X.scratch_path(spark, "t_empty"))
    assert empty.rows == 0 and "no rows" in caplog.text
    inc = X.extract_table(X.frame_source({"t": df}), "t", X.scratch_path(spark, "t_inc"),
                          where=X.incremental_filter("2026-07-02"), columns=["id"])
    assert inc.rows == 0


def test_scan_query_with_quoted_table_and_parameters(spark):
    src = X.frame_source({"tabSales Invoice": spark.createDataFrame([("A", 1), ("B", 2)], "name string, docstatus int")})
    out = X.scan_query(spark, src, ["tabSales Invoice"], "SELECT name FROM `tabSales Invoice` WHERE docstatus = :d",
                       args={"d": 1})
    assert [r[0] for r in out.collect()] == ["A"]


def test_scan_queries_do_not_touch_the_session_views(spark):
    spark.range(3).createOrReplaceTempView("tabItem")
    src = X.frame_source({"tabItem": spark.createDataFrame([("A", 1), ("B", 2)], "name string, qty int")})
    one = X.scan_query(spark, src, ["tabItem"], "SELECT tabItem.name, '{x}' AS b FROM tabItem WHERE qty < :q", args={"q": 2})
    two = X.scan_query(spark, src, ["tabItem"], " with a as (SELECT max(qty) AS q FROM `tabItem`) SELECT q FROM a")
    assert [tuple(r) for r in one.collect()] == [("A", "{x}")] and two.first()[0] == 2
    assert spark.table("tabItem").columns == ["id"]


def test_check_pk_fk_columns(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "x" * 151)], "k int, s string")
    assert sorted((r["k"], r["rows"]) for r in I.check_pk(df, ["k"]).collect() if r["k"] is not None) == [(1, 2)]
    assert I.check_pk(df, ["k"]).where("k IS NULL").count() == 1
    parent = spark.createDataFrame([(1,)], "k int")
    assert sorted(r["k"] for r in I.check_fk(df, "k", parent, "k").collect()) == [2]
    cols = {r["column_name"]: (r["null_violations"], r["length_violations"]) for r in I.check_columns(df, ["k"]).collect()}
    assert cols == {"k": (1, 0), "s": (0, 1)}


def test_defaults_and_upsert_stamps(spark):
    old, now = dt.datetime(2020, 1, 1), dt.datetime(2026, 1, 1)
    ts = lambda x: F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz")
    cur = I.apply_defaults(spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "c", 3.0)], "k int, n string, p double"),
                           {"p": 0.0}, ts(old))
    assert sorted(r["p"] for r in cur.collect()) == [0.0, 1.0, 3.0]
    inc = spark.createDataFrame([(1, "a", 1.0), (2, "b", 5.0), (4, "d", 4.0)], "k int, n string, p double")
    out = {r["k"]: r for r in I.upsert_stamp(cur, inc, ["k"], ts(now)).collect()}
    assert out[1]["updated_at"] == old and out[1]["created_at"] == old          # unchanged
    assert out[2]["updated_at"] == now and out[2]["p"] == 5.0                  # changed
    assert out[3]["updated_at"] == old and out[3]["n"] == "c"                  # not in the batch: kept
    assert out[4]["created_at"] == now and out[4]["updated_at"] == now         # new


def test_upsert_keeps_columns_and_settles_repeated_keys(spark):
    old, now = dt.datetime(2020, 1, 1), dt.datetime(2026, 1, 1)
    ts = lambda x: F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz")
    cur = I.apply_defaults(spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (None, "n", 0.0)],
                                                 "k int, n string, price double"), {}, ts(old))
    inc = spark.createDataFrame([(1, "z", 5, "x"), (1, "m", 9, "y"), (3, "c", 1, "w"), (3, "c", 1, "w"), (None, "n", 1, "v")],
                                "k int, n string, seq int, extra string")
    out = I.upsert_stamp(cur, inc, ["k"], ts(now), latest_by=["seq"])
    got = {r["k"]: r for r in out.collect()}
    assert out.count() == 4 and set(out.columns) == {"k", "n", "price", "extra", "created_at", "updated_at"}
    assert (got[1]["n"], got[1]["price"], got[1]["extra"], got[1]["updated_at"]) == ("m", 1.0, "y", now)
    assert (got[2]["n"], got[2]["price"], got[2]["updated_at"]) == ("b", 2.0, old)
    assert (got[3]["n"], got[3]["price"], got[3]["created_at"]) == ("c", None, now)
    assert got[None]["price"] == 0.0 and got[None]["created_at"] == old
    same = I.upsert_stamp(cur, inc.select("k", "n"), ["k"], ts(now))
    assert {r["k"]: r["n"] for r in same.collect()} == {1: "z", 2: "b", 3: "c", None: "n"}


def test_assign_keys_splits_a_repeated_natural_key(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(3000)] + [("zz", 0)], "name string, i int").repartition(4)
    out = I.assign_keys(rows, ["name"], "id", partitions=6)
    assert sorted(r["id"] for r in out.collect()) == list(range(1, 3002))
    parts = out.where("name = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1


def test_assign_keys_dense_and_after_existing(spark):
    names = spark.createDataFrame([(f"n{i:05d}",) for i in range(2000)], "name string").repartition(5)
    existing = spark.createDataFrame([(100,), (7,)], "id bigint")
    out = I.assign_keys(names, ["name"], "id", existing=existing, partitions=6).collect()
    got = sorted((r["id"], r["name"]) for r in out)
    assert [g[0] for g in got] == list(range(101, 2101))
    assert [g[1] for g in got] == sorted(g[1] for g in got)   # keys follow the natural-key order


def test_apply_schema_types(spark, views_small):
    df = I.apply_schema(views_small["customers"], I.CUSTOMER_MODEL["customers"])
    assert [f.dataType.simpleString() for f in df.schema.fields] == \
        ["int", "string", "string", "string", "string", "timestamp_ntz", "timestamp_ntz"]


def test_a_rewritten_table_is_read_anew(spark, tmp_path):
    from ledgerlake.sources.fixtures import read_parquet
    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path)
    assert read_parquet(spark, path).count() == read_parquet(spark, path).count() == 3
    spark.createDataFrame([("a", 1)], "s string, n int").write.mode("overwrite").parquet(path)
    again = read_parquet(spark, path)
    assert again.columns == ["s", "n"] and again.count() == 1
