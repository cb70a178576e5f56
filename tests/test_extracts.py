"""Chunked scans, high-water pulls, schema reconciliation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType

from ledgerlake.sources import chunks as K
from ledgerlake.sources import extract as X
from ledgerlake.sources import highwater as H
from ledgerlake.sources import reconcile as C


# ---------------------------------------------------------------- chunks

def held(df, predicates):
    """How many predicates hold each row."""
    total = sum((F.when(F.expr(p), 1).otherwise(0) for p in predicates), F.lit(0))
    return sorted(r[0] for r in df.select(total).distinct().collect())


KEYS = {
    "skewed int": ("int", [7] * 700 + list(range(300)) + [None] * 90),
    "all equal": ("bigint", [5] * 400),
    "all null": ("int", [None] * 50),
    "empty": ("int", []),
    "dates": ("date", ["1998-01-01"] * 300 + [f"1998-02-{d:02}" for d in range(1, 29)] * 9 + [None] * 40),
    "timestamps": ("timestamp_ntz", [f"1998-01-01 00:{m:02}:{s:02}" for m in range(20) for s in range(0, 60, 7)] + [None]),
    "doubles": ("double", ["NaN", "Infinity", "-Infinity", "-0.0", "0.0", "1e300", None] + [str(i / 7) for i in range(400)]),
    "decimals": ("decimal(18,4)", [str(i) + ".0001" for i in range(-200, 200)] * 2),
    "text": ("string", ["a", "A", "é", "", "it's", None, "\\", "日本"] * 60 + ["hot"] * 500),
}


@pytest.mark.parametrize("tie", [None, "t"])
@pytest.mark.parametrize("kind", sorted(KEYS))
@pytest.mark.parametrize("n", [1, 2, 13])
def test_chunks_are_disjoint_and_complete(spark, kind, n, tie):
    sql, values = KEYS[kind]
    rows = [(None if v is None else str(v), f"t{i % 50}" if i % 11 else None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, t string").selectExpr(f"CAST(k AS {sql}) AS k", "t")
    predicates = K.key_predicates(df, "k", n, tie)
    assert held(df, predicates) in ([1], [])
    # also when the split points come from other rows than those that are read
    other = K.key_predicates(df.limit(3), "k", n, tie)
    assert held(df, other) in ([1], [])


def test_a_hot_value_is_split_by_the_second_column(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 2000, 5).otherwise(F.col("id")).cast("int").alias("k"),
                                  F.concat(F.lit("n"), "id").alias("name"))
    plain = [c.count() for c in K.scan_chunks(df, K.key_predicates(df, "k", 10))]
    split = [c.count() for c in K.scan_chunks(df, K.key_predicates(df, "k", 10, tie="name"))]
    assert sum(plain) == sum(split) == 4000
    assert max(plain) == 2000 and max(split) < 700


def test_chunks_follow_the_rows(spark):
    df = spark.range(10_000).select((F.col("id") * F.col("id")).alias("k"))       # very uneven values
    sizes = [c.count() for c in K.scan_chunks(df, K.key_predicates(df, "k", 8))]
    assert sizes[0] == 0 and all(1100 < s < 1400 for s in sizes[1:])
    numbered = K.scan_chunked(df, "k", chunk_rows=1250).groupBy("chunk").count().collect()
    assert sorted(r["count"] for r in numbered) == sorted(s for s in sizes if s)


def test_predicates_reach_the_scan(spark, tmp_path):
    spark.range(100).select("id", F.date_add(F.lit(dt.date(1998, 1, 1)), F.col("id").cast("int")).alias("d")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for chunk in list(K.scan_chunks(df, K.key_predicates(df, "d", 4)))[1:]:
        assert "PushedFilters: [IsNotNull(d)" in chunk._jdf.queryExecution().executedPlan().toString()


def test_sample_query_and_bad_arguments(spark):
    assert K.sample_query("tabGL Entry", ["posting_date"], 0.5) == (
        "SELECT `posting_date` FROM `tabGL Entry` WHERE RAND(20260713) < 0.5")
    with pytest.raises(ValueError):
        K.sample_query("t", ["c"], 0)
    with pytest.raises(ValueError):
        K.key_predicates(spark.range(3), "id", 0)
    with pytest.raises(TypeError):
        K.key_predicates(spark.range(3).select(F.array("id").alias("a")), "a", 2)
    assert K.chunk_count(0) == 1 and K.chunk_count(50_001) == 2


class FakeReader:
    """Records what a JDBC read is asked for (no database runs here)."""

    def __init__(self, df):
        self.df, self.asked, self.read = df, {}, self

    def format(self, name):
        self.asked["format"] = name
        return self

    def options(self, **kw):
        self.asked.update(kw)
        return self

    def option(self, k, v):
        self.asked[k] = v
        return self

    def load(self):
        return self.df

    def jdbc(self, url, table, predicates, properties):
        self.asked |= {"jdbc": url, "table": table, "predicates": predicates, "properties": properties}
        return self.df


def test_jdbc_reads_ask_for_what_they_should(spark):
    settings = {"host": "h", "database": "d", "user": "u", "password": "p"}
    reader = FakeReader(spark.range(1000).selectExpr("CAST(id AS INT) AS id", "concat('n', id) AS name"))
    K.jdbc_chunked(reader, settings, "tabGL Entry", "id", 4, share=0.1)
    assert reader.asked["query"] == "SELECT `id` FROM `tabGL Entry` WHERE RAND(20260713) < 0.1"
    assert reader.asked["table"] == "`tabGL Entry`" and len(reader.asked["predicates"]) == 5
    assert held(reader.df, reader.asked["predicates"]) == [1]
    assert "url" not in reader.asked["properties"] and reader.asked["properties"]["password"] == "p"
    X.scan_query_jdbc(reader, settings, "SELECT a FROM t WHERE d >= :day AND x = ':day'", {"day": dt.date(2026, 7, 1)})
    assert reader.asked["query"] == "SELECT a FROM t WHERE d >= '2026-07-01' AND x = ':day'"


# ---------------------------------------------------------------- high water

def frame(spark, rows):
    return spark.createDataFrame([(k, v, None if m is None else dt.datetime.fromisoformat(m)) for k, v, m in rows],
                                 "name string, v int, modified timestamp_ntz")


def source(df):
    return X.frame_source({"tabGL Entry": df})


def content(spark, root):
    return sorted((r["name"], r["v"]) for r in H.read(spark, root, "tabGL Entry").collect() if r["name"] is not None)


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "pulls")


def test_pulls_follow_the_mark(spark, root):
    day1 = frame(spark, [("a", 1, "2026-01-01 10:00:00"), ("b", 1, "2026-01-02 10:00:00")])
    first = H.pull(spark, source(day1), "tabGL Entry", root)
    assert (first.low, first.high, first.rows) == (None, dt.datetime(2026, 1, 2, 10), 2)
    day2 = frame(spark, [("a", 1, "2026-01-01 10:00:00"), ("b", 2, "2026-01-02 10:00:00"), ("c", 1, "2026-01-03 00:00:00.5")])
    second = H.pull(spark, source(day2), "tabGL Entry", root)
    assert (second.low, second.high, second.rows) == (dt.datetime(2026, 1, 2, 10), dt.datetime(2026, 1, 3, 0, 0, 0, 500000), 2)
    assert content(spark, root) == [("a", 1), ("b", 2), ("c", 1)]
    again = H.pull(spark, source(day2), "tabGL Entry", root)
    assert again.rows == 1 and again.high == second.high
    assert content(spark, root) == [("a", 1), ("b", 2), ("c", 1)]
    assert [tuple(r) for r in H.committed(spark, root, "tabGL Entry").orderBy("seq").select("seq", "rows").collect()] == [(1, 2), (2, 2), (3, 1)]


def test_an_interrupted_pull_leaves_no_trace(spark, root):
    with pytest.raises(FileNotFoundError):
        H.read(spark, root, "tabGL Entry")
    day1 = frame(spark, [("a", 1, "2026-01-01 10:00:00")])
    H.copy_rows(source(day1), "tabGL Entry", root, None)                  # broke off before its commit
    with pytest.raises(FileNotFoundError):
        H.read(spark, root, "tabGL Entry")
    H.pull(spark, source(day1), "tabGL Entry", root)
    wrong = frame(spark, [("a", 99, "2026-01-09 10:00:00"), ("z", 99, "2026-01-09 10:00:00")])
    H.copy_rows(source(wrong), "tabGL Entry", root, None, seq=2)
    assert content(spark, root) == [("a", 1)] and H.mark(spark, root, "tabGL Entry") == (1, dt.datetime(2026, 1, 1, 10))


def test_late_rows_come_with_the_overlap(spark, root):
    H.pull(spark, source(frame(spark, [("a", 1, "2026-01-05 00:00:00")])), "tabGL Entry", root)
    later = frame(spark, [("a", 1, "2026-01-05 00:00:00"), ("late", 1, "2026-01-04 12:00:00"), ("old", 1, "2026-01-01 00:00:00")])
    H.pull(spark, source(later), "tabGL Entry", root, overlap=dt.timedelta(days=1))
    assert content(spark, root) == [("a", 1), ("late", 1)]                # older than the overlap: not seen
    H.pull(spark, source(later), "tabGL Entry", root, overlap=dt.timedelta(days=10))
    assert content(spark, root) == [("a", 1), ("late", 1), ("old", 1)]


def test_rows_without_key_or_time_and_empty_pulls(spark, root):
    rows = [(None, 1, "2026-01-05 00:00:00"), (None, 1, "2026-01-05 00:00:00"), (None, 2, None), ("n", 5, None)]
    for _ in range(3):
        H.pull(spark, source(frame(spark, rows)), "tabGL Entry", root)
    every = H.read(spark, root, "tabGL Entry").collect()
    assert sorted((r["name"] or "", r["v"]) for r in every) == [("", 1), ("", 1), ("", 2), ("n", 5)]
    none = frame(spark, rows).limit(0)
    assert H.pull(spark, source(none), "tabGL Entry", root).high == dt.datetime(2026, 1, 5)
    assert H.read(spark, root, "tabGL Entry").count() == 4


def test_first_pull_may_be_empty(spark, root):
    none = frame(spark, [("a", 1, None)]).limit(0)
    assert H.pull(spark, source(none), "tabGL Entry", root).high is None
    H.pull(spark, source(frame(spark, [("a", 1, "2026-01-01 00:00:00")])), "tabGL Entry", root)
    assert content(spark, root) == [("a", 1)]


def test_columns_may_be_added(spark, root):
    H.pull(spark, source(frame(spark, [("a", 1, "2026-01-01 00:00:00")])), "tabGL Entry", root)
    wider = frame(spark, [("b", 2, "2026-01-02 00:00:00")]).withColumn("note", F.lit("x"))
    H.pull(spark, source(wider), "tabGL Entry", root)
    assert sorted((r["name"], r["note"] or "") for r in H.read(spark, root, "tabGL Entry").collect()) == [("a", ""), ("b", "x")]


def test_day_extracts_keep_rows_without_key_outside_the_window(spark, tmp_path):
    df = spark.createDataFrame([(None, 1), (None, 1), ("a", 1)], "name string, v int").withColumn("modified", F.lit("2026-01-01"))
    src = source(df)
    for ds in ("2026-01-01", "2026-01-02"):
        X.extract_partition(src, "tabGL Entry", str(tmp_path), ds=ds)
    back = X.parquet_source(spark, str(tmp_path))("tabGL Entry")
    assert back.count() == 5 and "ds" not in back.columns
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(name" in plan[plan.index("Window"):]


# ---------------------------------------------------------------- schemas

@pytest.mark.parametrize("a, b, both", [
    ("int", "int", "int"), ("smallint", "bigint", "bigint"), ("int", "double", "double"), ("bigint", "double", "string"),
    ("int", "decimal(6,4)", "decimal(14,4)"), ("decimal(18,2)", "decimal(10,6)", "decimal(22,6)"),
    ("decimal(38,0)", "decimal(38,10)", "string"), ("float", "double", "double"), ("date", "timestamp_ntz", "timestamp_ntz"),
    ("date", "timestamp", "timestamp"), ("timestamp", "timestamp_ntz", "string"), ("string", "int", "string"),
    ("boolean", "int", "string"), ("void", "int", "int"), ("void", "void", "string"), ("decimal(12,2)", "double", "double")])
def test_common_types(spark, a, b, both):
    schemas = [spark.sql(f"SELECT CAST(NULL AS {t}) AS x" if t != "void" else "SELECT NULL AS x").schema for t in (a, b)]
    for order in (schemas, schemas[::-1]):
        assert C.common_schema(order)["x"].dataType.simpleString() == both


def test_common_schema_matches_names_without_case(spark):
    one = spark.sql("SELECT 1 AS Name, 2 AS b").schema
    two = spark.sql("SELECT 'x' AS name, 3L AS c").schema
    assert C.common_schema([one, two]).simpleString() == "struct<Name:string,b:int,c:bigint>"


@pytest.mark.parametrize("value, source_type, target, fits", [
    ("12", "string", "bigint", True), ("012", "string", "bigint", True), ("12x", "string", "bigint", False),
    ("", "string", "bigint", False), ("2026-02-30", "string", "date", False), ("1.5", "double", "bigint", False),
    ("2.0", "double", "bigint", True), ("9007199254740993", "bigint", "double", False), ("300", "int", "tinyint", False),
    ("1.23456", "decimal(10,5)", "decimal(10,2)", False), ("1.20000", "decimal(10,5)", "decimal(10,2)", True),
    ("2026-01-01 00:00:00", "timestamp_ntz", "date", True), ("2026-01-01 01:00:00", "timestamp_ntz", "date", False),
    ("NaN", "double", "bigint", False), ("5", "int", "string", True)])
def test_losing_casts_are_rejected(spark, value, source_type, target, fits):
    df = spark.sql(f"SELECT CAST('{value}' AS {source_type}) AS x, 1 AS k")
    schema = StructType([StructField("x", spark.sql(f"SELECT CAST(NULL AS {target}) AS x").schema["x"].dataType),
                         StructField("k", LongType())])
    out = C.conform(df, schema)
    assert out.rows.count() == fits and out.rejects.count() == (not fits)
    if not fits:
        row = out.rejects.first()
        assert row["column"] == "x" and row["target"] == target and '"k":1' in row["row"]


def test_nulls_fit_missing_columns_are_null_and_two_losses_make_two_rejects(spark):
    df = spark.createDataFrame([(None, None), ("a", "b"), ("1", "2026-01-01")], "x string, d string")
    schema = StructType([StructField("x", LongType()), StructField("d", DateType()), StructField("new", LongType())])
    out = C.conform(df, schema)
    assert sorted(map(str, map(tuple, out.rows.collect()))) == sorted(map(str, [(None, None, None), (1, dt.date(2026, 1, 1), None)]))
    assert sorted((r["column"], r["value"]) for r in out.rejects.collect()) == [("d", "b"), ("x", "a")]
