"""Extract, source and integrity queries (S2-S18) with their oracles.

Extract keys write to a fresh folder under ``spark.checkpoint.dir`` (the
cluster's shared folder) and return the data read back, so the oracle
checks the round trip.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType

from ledgerlake.operators import integrity as I
from ledgerlake.operators import model_checks as M
from ledgerlake.plans.registry import END, START, register, sql_date
from ledgerlake.sources import chunks as K
from ledgerlake.sources import extract as X
from ledgerlake.sources import highwater as H
from ledgerlake.sources import reconcile as C
from ledgerlake.sources.fixtures import ErpViews

LOAD_TS = dt.datetime(2026, 1, 1)
OLD_TS = dt.datetime(1995, 1, 1)
INCREMENTAL_DS = "1998-07-01"


def _ts(x: dt.datetime):
    # wall-clock literal built from text: independent of the session time zone
    return F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz")


def _sql_ts(x: dt.datetime) -> str:
    return f"TIMESTAMP '{x.isoformat(sep=' ')}'"


def _erp_source(v: ErpViews) -> X.TableSource:
    return lambda table: v[table]


def _orders_with_modified(v: ErpViews):
    """The incremental-pull fixture: orders with ``o_orderdate`` as ``modified``."""
    return v.raw("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                  F.col("o_orderdate").alias("modified"))


_ORDERS_MODIFIED = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate AS modified FROM orders"


def q(key: str, sql: str | None):
    def deco(f):
        register(key, sql)(lambda spark, sf_dir, _f=f: _f(ErpViews(spark, sf_dir)))
        return f
    return deco


_SI_QUERY = "SELECT name, posting_date, customer, base_grand_total FROM `tabSales Invoice` WHERE docstatus = 1"


@q("scan_query", """SELECT name, posting_date, customer, base_grand_total FROM "tabSales Invoice" WHERE docstatus = 1""")
def scan_query(v):
    return X.scan_query(v.spark, _erp_source(v), ["tabSales Invoice"], _SI_QUERY)


@q("scan_query_params", f"""SELECT name, posting_date, customer, base_grand_total FROM "tabSales Invoice"
WHERE docstatus = 1 AND posting_date BETWEEN {sql_date(START)} AND {sql_date(END)}""")
def scan_query_params(v):
    text = ("SELECT name, posting_date, customer, base_grand_total FROM `tabSales Invoice` "
            "WHERE docstatus = :docstatus AND posting_date BETWEEN :start AND :end")
    return X.scan_query(v.spark, _erp_source(v), ["tabSales Invoice"], text,
                        args={"docstatus": 1, "start": START, "end": END})


@q("extract_query", """SELECT name, posting_date, customer, base_grand_total FROM "tabSales Invoice" WHERE docstatus = 1""")
def extract_query(v):
    df = X.scan_query(v.spark, _erp_source(v), ["tabSales Invoice"], _SI_QUERY)
    res = X.extract_query(df, X.scratch_path(v.spark, "extract_query"))
    return v.spark.read.parquet(res.path)


@q("extract_table", """SELECT * FROM "tabPurchase Invoice" """)
def extract_table(v):
    res = X.extract_table(_erp_source(v), "tabPurchase Invoice", X.scratch_path(v.spark, "extract_table"))
    return v.spark.read.parquet(res.path)


@q("extract_columns", """SELECT name, customer_name, transaction_date, status FROM "tabSales Order" """)
def extract_columns(v):
    res = X.extract_table(_erp_source(v), "tabSales Order", X.scratch_path(v.spark, "extract_columns"),
                          columns=["name", "customer_name", "transaction_date", "status"])
    return v.spark.read.parquet(res.path)


@q("extract_where", """SELECT * FROM "tabGL Entry" WHERE is_cancelled = 0 AND voucher_type = 'Journal Entry'""")
def extract_where(v):
    res = X.extract_table(_erp_source(v), "tabGL Entry", X.scratch_path(v.spark, "extract_where"),
                          where="is_cancelled = 0 AND voucher_type = 'Journal Entry'")
    return v.spark.read.parquet(res.path)


@q("extract_incremental", f"""SELECT * FROM ({_ORDERS_MODIFIED}) o WHERE modified >= TIMESTAMP '{INCREMENTAL_DS} 00:00:00'""")
def extract_incremental(v):
    src = X.frame_source({"orders": _orders_with_modified(v)})
    res = X.extract_table(src, "orders", X.scratch_path(v.spark, "extract_incremental"),
                          where=X.incremental_filter(INCREMENTAL_DS))
    return v.spark.read.parquet(res.path)


@q("extract_partition", f"""SELECT * FROM ({_ORDERS_MODIFIED}) o WHERE modified >= TIMESTAMP '{INCREMENTAL_DS} 00:00:00'""")
def extract_partition(v):
    src = X.frame_source({"tabSales Order": _orders_with_modified(v)})
    root = X.scratch_path(v.spark, "extract_partition")
    # the same day twice: the second run replaces the first, nothing doubles
    for _ in range(2):
        res = X.extract_partition(src, "tabSales Order", root, ds=INCREMENTAL_DS,
                                  where=X.incremental_filter(INCREMENTAL_DS))
    return v.spark.read.parquet(res.path)


@q("extract_row_count", """SELECT COUNT(*) AS rows, COUNT(*) AS observed_rows FROM "tabSales Order Item" """)
def extract_row_count(v):
    res = X.extract_table(_erp_source(v), "tabSales Order Item", X.scratch_path(v.spark, "extract_row_count"))
    return v.spark.read.parquet(res.path).agg(F.count(F.lit(1)).alias("rows"),
                                              F.lit(res.rows).cast("bigint").alias("observed_rows"))


_CUST_SCHEMA_SQL = """SELECT CAST(customer_id AS INTEGER) AS customer_id, customer_name, phone_number, email_address, country,
  CAST(created_at AS TIMESTAMP) AS created_at, CAST(updated_at AS TIMESTAMP) AS updated_at FROM customers"""


@q("apply_schema", _CUST_SCHEMA_SQL)
def apply_schema(v):
    return I.apply_schema(v["customers"], I.CUSTOMER_MODEL["customers"])


@q("check_pk", """SELECT name, COUNT(*) AS rows FROM "tabGL Entry" GROUP BY name HAVING COUNT(*) > 1 OR name IS NULL""")
def check_pk(v):
    return I.check_pk(v.gl_entry, ["name"])


@q("check_fk", """SELECT ph.* FROM purchase_history ph
WHERE ph.channel_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM channels c WHERE c.channel_id = ph.channel_id)""")
def check_fk(v):
    return I.check_fk(v["purchase_history"], "channel_id", v["channels"], "channel_id")


_COLS = ["customer_id", "customer_name", "phone_number", "email_address", "country", "created_at", "updated_at"]


@q("check_columns", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, "
    + ("COUNT(*) FILTER (WHERE customer_id IS NULL)" if c == "customer_id" else "COUNT(*) FILTER (WHERE FALSE)")
    + " AS null_violations, "
    + (f"COUNT(*) FILTER (WHERE length({c}) > 150)" if c in ("customer_name", "phone_number", "email_address", "country")
       else "COUNT(*) FILTER (WHERE FALSE)")
    + f" AS length_violations FROM ({_CUST_SCHEMA_SQL}) t" for c in _COLS))
def check_columns(v):
    return I.check_columns(I.apply_schema(v["customers"], I.CUSTOMER_MODEL["customers"]), not_null=["customer_id"])


@q("apply_defaults", f"""SELECT customer_id, product_sku, channel_id, quantity, COALESCE(discount, 0.0) AS discount, order_date,
  {_sql_ts(LOAD_TS)} AS created_at, {_sql_ts(LOAD_TS)} AS updated_at FROM purchase_history""")
def apply_defaults(v):
    return I.apply_defaults(v["purchase_history"], I.DEFAULTS["purchase_history"], _ts(LOAD_TS))


# A batch with changed, unchanged, new (negative) and absent keys, two rows for the small sizes,
# and without the product's name.
_INCOMING = """SELECT product_sku, max_by(unit_price, seq) AS unit_price FROM (
  SELECT CASE WHEN p_size = 7 THEN -p_partkey ELSE p_partkey END AS product_sku, 0 AS seq,
    CASE WHEN p_size > 25 THEN p_retailprice + 1 ELSE p_retailprice END AS unit_price FROM part WHERE p_size <> 9
  UNION ALL SELECT p_partkey, 1, p_retailprice + 2 FROM part WHERE p_size < 5) b GROUP BY product_sku"""


@q("upsert_stamp", f"""WITH cur AS (SELECT product_sku, product_name, unit_price FROM products), inc AS ({_INCOMING})
SELECT COALESCE(c.product_sku, i.product_sku) AS product_sku,
  c.product_name,
  CASE WHEN i.product_sku IS NOT NULL THEN i.unit_price ELSE c.unit_price END AS unit_price,
  CASE WHEN c.product_sku IS NOT NULL THEN {_sql_ts(OLD_TS)} ELSE {_sql_ts(LOAD_TS)} END AS created_at,
  CASE WHEN i.product_sku IS NOT NULL AND (c.product_sku IS NULL OR i.unit_price IS DISTINCT FROM c.unit_price) THEN {_sql_ts(LOAD_TS)} ELSE {_sql_ts(OLD_TS)} END AS updated_at
FROM cur c FULL OUTER JOIN inc i ON c.product_sku = i.product_sku""")
def upsert_stamp(v):
    current = I.apply_defaults(v["products"], {}, _ts(OLD_TS))
    part = v.raw("part")
    sku, size, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    incoming = part.where(size != 9).select(
        F.when(size == 7, -sku).otherwise(sku).alias("product_sku"), F.lit(0).alias("seq"),
        F.when(size > 25, price + 1).otherwise(price).alias("unit_price")).unionByName(
            part.where(size < 5).select(sku.alias("product_sku"), F.lit(1).alias("seq"), (price + 2).alias("unit_price")))
    return I.upsert_stamp(current, incoming, ["product_sku"], _ts(LOAD_TS), latest_by=["seq"])


@q("assign_keys", """SELECT ROW_NUMBER() OVER (ORDER BY customer_name) AS customer_id, customer_name FROM customers""")
def assign_keys(v):
    return I.assign_keys(v["customers"].select("customer_name"), ["customer_name"], "customer_id")



# ---------------------------------------------------------------- S2: chunked scans

@q("scan_chunked", """SELECT name, posting_date, debit, credit FROM "tabGL Entry" """)
def scan_chunked(v):
    """Every chunk read by itself, as parallel connections would, and put together again."""
    gl = v.gl_entry.select("name", "posting_date", "debit", "credit")
    predicates = K.key_predicates(gl, "posting_date", 4, tie="name")
    return reduce(DataFrame.unionByName, K.scan_chunks(gl, predicates))


@q("scan_chunked_text", """SELECT name, customer, base_grand_total FROM "tabSales Invoice" """)
def scan_chunked_text(v):
    si = v.sales_invoice.select("name", "customer", "base_grand_total")
    return K.scan_chunked(si, "customer", chunk_rows=5_000).drop("chunk")


# ---------------------------------------------------------------- S8, S9: pulls with a high-water table

_LATER = dt.datetime(2001, 12, 31)
_STATES = {   # what the source shows at three times: some rows late, then all, then some changed
    "first": "modified < TIMESTAMP '1996-01-01 00:00:00' AND NOT (modified >= TIMESTAMP '1995-12-01 00:00:00' AND o_orderkey % 3 = 0)",
    "second": "modified < TIMESTAMP '1998-01-01 00:00:00'",
}


@q("extract_highwater", f"""SELECT o_orderkey, o_custkey, o_totalprice,
  CASE WHEN o_orderkey % 10 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 10 = 0 THEN {_sql_ts(_LATER)} ELSE modified END AS modified FROM ({_ORDERS_MODIFIED}) o""")
def extract_highwater(v):
    """Pulls of a table that grows, shows rows late and changes; one pull breaks off, one is repeated."""
    root = X.scratch_path(v.spark, "extract_highwater")
    orders, key = _orders_with_modified(v), F.col("o_orderkey") % 10 == 0
    changed = (orders.withColumn("o_orderstatus", F.when(key, "U").otherwise(F.col("o_orderstatus")))
               .withColumn("modified", F.when(key, _ts(_LATER)).otherwise(F.col("modified").cast("timestamp_ntz"))))
    states = [X.frame_source({"tabSales Order": df}) for df in (
        orders.where(_STATES["first"]), orders.where(_STATES["second"]), changed)]
    overlap = dt.timedelta(days=31)

    def pull(source):
        return H.pull(v.spark, source, "tabSales Order", root, overlap=overlap)
    pull(states[0])
    _, high = H.mark(v.spark, root, "tabSales Order")
    H.copy_rows(states[1], "tabSales Order", root, high - overlap)      # breaks off before its commit
    for source in (states[1], states[2], states[2]):
        pull(source)
    return H.read(v.spark, root, "tabSales Order", key="o_orderkey")


# ---------------------------------------------------------------- S10: compression

@q("extract_compression", """SELECT name, 'zstd' AS codec FROM "tabSales Order" """)
def extract_compression(v):
    res = X.extract_table(_erp_source(v), "tabSales Order", X.scratch_path(v.spark, "extract_compression"),
                          columns=["name"], compression="zstd")
    return v.spark.read.parquet(res.path).select("name", F.regexp_extract(
        F.input_file_name(), r"\.(\w+)\.parquet$", 1).alias("codec"))


# ---------------------------------------------------------------- S12: one schema for drifting days

_DAYS = ("""SELECT o_orderkey AS order_id, o_totalprice AS total, CAST(o_orderdate AS DATE) AS day FROM {orders}
  WHERE o_orderkey % 2 = 0""",
         """SELECT CASE WHEN o_orderkey % 7 = 0 THEN concat('SO-', CAST(o_orderkey AS {text})) ELSE CAST(o_orderkey AS {text}) END AS order_id,
  CAST(floor(o_totalprice) AS BIGINT) AS total, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 6 HOUR ELSE o_orderdate END AS day,
  o_orderpriority AS note FROM {orders} WHERE o_orderkey % 2 = 1""")
_DAY_SQL = ", ".join(f"d{i} AS ({t.format(orders='orders', text='VARCHAR')})" for i, t in enumerate(_DAYS, 1))
_ORDER_SCHEMA = StructType([StructField("order_id", LongType()), StructField("total", DoubleType()),
                            StructField("day", DateType()), StructField("note", StringType())])
_FITS = "order_id NOT LIKE 'SO-%' AND day = CAST(CAST(day AS DATE) AS TIMESTAMP)"


def _days(v) -> list[DataFrame]:
    days = [v.spark.sql(t.replace("{text}", "STRING"), orders=v.raw("orders")) for t in _DAYS]
    return [days[0], days[1].withColumn("day", F.col("day").cast("timestamp_ntz"))]


@q("reconcile_rows", f"""WITH {_DAY_SQL} SELECT order_id, total, day, CAST(NULL AS VARCHAR) AS note FROM d1
UNION ALL SELECT CAST(order_id AS BIGINT), CAST(total AS DOUBLE), CAST(day AS DATE), note FROM d2 WHERE {_FITS}""")
def reconcile_rows(v):
    return C.conform_days(_days(v), _ORDER_SCHEMA).rows


@q("reconcile_rejects", f"""WITH {_DAY_SQL}
SELECT order_id, 'order_id' AS column_name, order_id AS value, 'bigint' AS target FROM d2 WHERE order_id LIKE 'SO-%'
UNION ALL SELECT order_id, 'day', strftime(day, '%Y-%m-%d %H:%M:%S'), 'date' FROM d2 WHERE day <> CAST(CAST(day AS DATE) AS TIMESTAMP)""")
def reconcile_rejects(v):
    rejects = C.conform_days(_days(v), _ORDER_SCHEMA).rejects
    return rejects.select(F.get_json_object("row", "$.order_id").alias("order_id"), F.col("column").alias("column_name"),
                          "value", "target")


@q("reconcile_common", f"""WITH {_DAY_SQL} SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(total AS VARCHAR) <> '' AS has_total,
  CAST(day AS TIMESTAMP) AS day, CAST(NULL AS VARCHAR) AS note FROM d1
UNION ALL SELECT order_id, CAST(total AS VARCHAR) <> '', day, note FROM d2""")
def reconcile_common(v):
    rows = C.conform_days(_days(v)).rows
    return rows.select("order_id", (F.col("total").cast("string") != "").alias("has_total"), "day", "note")


# ---------------------------------------------------------------- S13-S16: the whole model

for _table in ("products", "channels", "purchase_history", "visit_history"):
    def _typed(table):
        have = {"products": ("product_sku", "product_name", "unit_price"), "channels": ("channel_id", "channel_name"),
                "purchase_history": ("customer_id", "product_sku", "channel_id", "quantity", "discount", "order_date"),
                "visit_history": ("customer_id", "channel_id", "visit_timestamp", "bounce_timestamp")}[table]
        names = {"int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP"}
        columns = ", ".join(f"CAST({f.name if f.name in have else 'NULL'} AS {names[f.dataType.simpleString()]}) AS {f.name}"
                            for f in I.CUSTOMER_MODEL[table].fields)
        q(f"apply_schema_{table}", f"SELECT {columns} FROM {table}")(
            lambda v: I.apply_schema(v[table], I.CUSTOMER_MODEL[table]))
    _typed(_table)

# The model's tables with violations of every constraint.
_PLANTED = {
    "customers": """SELECT CASE WHEN customer_id % 77 = 0 THEN NULL ELSE customer_id END AS customer_id,
  CASE WHEN customer_id % 91 = 0 THEN repeat('x', 200) ELSE customer_name END AS customer_name, phone_number,
  CASE WHEN customer_id % 17 = 0 THEN repeat('é', 150) ELSE email_address END AS email_address,
  CASE WHEN customer_id % 13 = 0 THEN repeat('y', 151) ELSE country END AS country, created_at, updated_at FROM {customers}
  UNION ALL SELECT customer_id, customer_name, phone_number, email_address, country, created_at, updated_at FROM {customers}
  WHERE customer_id % 50 = 0""",
    "products": """SELECT product_sku, product_name, unit_price FROM {products}
  UNION ALL SELECT product_sku, repeat('z', 151), unit_price FROM {products} WHERE product_sku % 60 = 0""",
    "channels": """SELECT channel_id, channel_name FROM {channels} WHERE channel_id <> 4
  UNION ALL SELECT channel_id, channel_name FROM {channels} WHERE channel_id = 3""",
    "purchase_history": """SELECT CASE WHEN customer_id % 37 = 0 THEN customer_id + 1000000 WHEN customer_id % 41 = 0 THEN NULL ELSE customer_id END AS customer_id,
  CASE WHEN product_sku % 97 = 0 THEN -product_sku ELSE product_sku END AS product_sku, channel_id, quantity, discount,
  CASE WHEN product_sku % 29 = 0 THEN NULL ELSE order_date END AS order_date FROM {purchase_history}""",
    "visit_history": """SELECT CASE WHEN customer_id % 43 = 0 THEN -customer_id ELSE customer_id END AS customer_id, channel_id,
  CASE WHEN channel_id = 2 THEN NULL ELSE visit_timestamp END AS visit_timestamp, bounce_timestamp FROM {visit_history}""",
}


def _model_sql(prefix: str = "planted_") -> str:
    def row(table, constraint, column, value="CAST(NULL AS VARCHAR)"):
        return (f"SELECT '{table}' AS table_name, '{constraint}' AS \"constraint\", '{column}' AS column_name, "
                f"{value} AS value, COUNT(*) AS rows FROM {prefix}{table}")
    parts = []
    for table, (key,) in I.PRIMARY_KEYS.items():
        parts.append(row(table, "primary key", key, f"CAST({key} AS VARCHAR)")
                     + f" GROUP BY {key} HAVING COUNT(*) > 1 OR {key} IS NULL")
    for table, refs in I.FOREIGN_KEYS.items():
        for column, parent, parent_column in refs:
            parts.append(row(table, "foreign key", column, f"CAST({column} AS VARCHAR)") + f""" WHERE {column} IS NOT NULL AND NOT EXISTS
  (SELECT 1 FROM {prefix}{parent} p WHERE p.{parent_column} = {prefix}{table}.{column}) GROUP BY {column}""")
    for table, column in (("purchase_history", "order_date"), ("visit_history", "visit_timestamp")):
        parts.append(row(table, "not null", column) + f" WHERE {column} IS NULL HAVING COUNT(*) > 0")
    for table, column in (("customers", "customer_name"), ("customers", "phone_number"), ("customers", "email_address"),
                          ("customers", "country"), ("products", "product_name"), ("channels", "channel_name")):
        parts.append(row(table, "length", column) + f" WHERE length({column}) > 150 HAVING COUNT(*) > 0")
    planted = ", ".join(f"{prefix}{t} AS ({sql.format(**{t: t})})" for t, sql in _PLANTED.items())
    return (f"WITH {planted}\n" if prefix else "") + "\nUNION ALL ".join(parts)


@q("check_model", _model_sql())
def check_model(v):
    return M.check_model({t: v.spark.sql(sql, **{t: v[t]}) for t, sql in _PLANTED.items()})


@q("check_model_clean", _model_sql(""))
def check_model_clean(v):
    """The tables as they are."""
    return M.check_model({t: v[t] for t in I.CUSTOMER_MODEL})
