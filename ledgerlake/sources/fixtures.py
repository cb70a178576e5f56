"""ERP tables derived from the driver's test tables (FIXTURES.md section 2-3).

The ERP database itself is not available here, so every ERP table the
reports read is a derivation of the TPC-H-like test tables.  Each derivation
is one SQL template whose ``{table}`` holes name raw test tables.  Spark
fills the holes with DataFrames (``spark.sql(text, orders=df, ...)``), the
DuckDB oracle with its pre-registered views, so both engines start from
identical inputs.  In production these DataFrames are the extracted Parquet
of the real ERP tables (see ``sources.extract``) and nothing here is used.
"""

from __future__ import annotations

import re
import string
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

DERIVATIONS: dict[str, str] = {
    "tabSales Invoice": """
SELECT concat('SINV-', CAST(o.o_orderkey AS STRING)) AS name, concat('CUST-', CAST(o.o_custkey AS STRING)) AS customer, c.c_name AS customer_name, 'CO-1' AS company,
  CAST(o.o_orderdate AS DATE) AS posting_date, CAST(o.o_orderdate + INTERVAL 30 DAY AS DATE) AS due_date,
  CASE WHEN o.o_orderkey % 10 = 0 THEN 2 WHEN o.o_orderkey % 10 = 1 THEN 0 ELSE 1 END AS docstatus,
  CASE WHEN o.o_orderkey % 17 = 0 THEN 'Yes' ELSE 'No' END AS is_opening,
  CASE o.o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'Unpaid' ELSE CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE 'Return' END END AS status,
  o.o_totalprice AS base_grand_total, CASE WHEN o.o_orderkey % 4 = 0 THEN 0.0E0 ELSE o.o_totalprice * 0.16E0 END AS base_total_taxes_and_charges,
  CASE WHEN o.o_orderkey % 19 = 0 THEN 0.0E0 ELSE CAST(1 + o.o_orderkey % 50 AS DOUBLE) END AS total_qty,
  o.o_orderpriority AS tax_category, concat('PIN', CAST(o.o_custkey AS STRING)) AS tax_id, concat('EXP-', CAST(o.o_orderkey % 7 AS STRING)) AS export_series, concat('ETR-', CAST(o.o_orderkey AS STRING)) AS etr_invoice_number
  FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    "tabSales Invoice Item": """
SELECT concat('SINV-', CAST(l_orderkey AS STRING)) AS parent, CASE WHEN l_linestatus = 'F' THEN concat('DN-', CAST(l_orderkey AS STRING)) ELSE NULL END AS delivery_note,
  concat('ITEM-', CAST(l_partkey AS STRING)) AS item_code, p_name AS item_name, l_quantity AS qty, CAST(floor(l_extendedprice / l_quantity) AS DOUBLE) AS base_rate, l_extendedprice AS base_amount, l_quantity * 0.025E0 AS tonnes_input
  FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "tabDelivery Note": """
SELECT concat('DN-', CAST(o_orderkey AS STRING)) AS name, CASE o_orderkey % 3 WHEN 0 THEN 'KCA-100' WHEN 1 THEN '' ELSE NULL END AS company_vehicle,
  CASE o_orderkey % 4 WHEN 0 THEN 'KCB-200' WHEN 1 THEN '' ELSE NULL END AS customer_provided_vehicle, CASE o_orderkey % 5 WHEN 0 THEN 'KCC-300' WHEN 1 THEN '' ELSE NULL END AS transporter_vehicle_number FROM {orders}""",
    "tabCustomer": """
SELECT concat('CUST-', CAST(c_custkey AS STRING)) AS name, c_name AS customer_name FROM {customer}""",
    "tabSupplier": """
SELECT concat('SUP-', CAST(s_suppkey AS STRING)) AS name, s_name AS supplier_name FROM {supplier}""",
    "tabCompany": """
SELECT 'CO-1' AS name""",
    "tabSales Team": """
SELECT concat('CUST-', CAST(c_custkey AS STRING)) AS parent, c_mktsegment AS sales_person FROM {customer} WHERE c_custkey % 5 <> 4
  UNION ALL SELECT concat('CUST-', CAST(c_custkey AS STRING)), 'HOUSE ACCOUNT' FROM {customer} WHERE c_custkey % 7 = 0
  UNION ALL SELECT concat('SO-', CAST(o_orderkey AS STRING)), o_orderpriority FROM {orders} WHERE o_orderkey % 3 <> 2
  UNION ALL SELECT concat('SO-', CAST(o_orderkey AS STRING)), 'HOUSE ACCOUNT' FROM {orders} WHERE o_orderkey % 6 = 0""",
    "tabSales Order": """
SELECT concat('SO-', CAST(o_orderkey AS STRING)) AS name, c_name AS customer_name, o_orderdate AS creation, CAST(o_orderdate AS DATE) AS transaction_date, CAST(o_orderdate + INTERVAL 14 DAY AS DATE) AS delivery_date,
  CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 1 END AS docstatus, CAST((o_orderkey % 6) * 20 AS DOUBLE) AS per_delivered, CAST((o_orderkey % 5) * 25 AS DOUBLE) AS per_billed,
  CASE WHEN o_orderkey % 23 = 0 THEN 'On Hold' WHEN o_orderkey % 29 = 0 THEN 'Closed' WHEN o_orderkey % 31 = 0 THEN NULL ELSE 'To Deliver and Bill' END AS status,
  CASE WHEN o_custkey % 4 = 0 THEN 'USD' ELSE 'KES' END AS currency, CASE WHEN o_custkey % 4 = 0 THEN 130.0E0 ELSE 1.0E0 END AS conversion_rate FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "tabSales Order Item": """
SELECT concat('SO-', CAST(l_orderkey AS STRING)) AS parent, CASE WHEN l_partkey % 20 = 0 THEN 'SRV-001' ELSE concat('ITEM-', CAST(l_partkey AS STRING)) END AS item_code, p_name AS item_name,
  CASE WHEN l_partkey % 2 = 0 THEN 0.025E0 ELSE 0.05E0 END AS weight_per_unit, l_quantity * 20.0E0 AS qty, CASE l_returnflag WHEN 'R' THEN l_quantity * 20.0E0 WHEN 'A' THEN l_quantity * 4.0E0 ELSE 0.0E0 END AS delivered_qty,
  CAST(floor(l_extendedprice / l_quantity) AS DOUBLE) AS rate, CASE WHEN l_tax > 0.04E0 THEN 'Kenya Tax - NML' WHEN l_tax > 0.02E0 THEN 'Zero Rated' ELSE NULL END AS item_tax_template FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "tabPurchase Invoice": """
SELECT concat('PINV-', CAST(l_orderkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS name, concat('SUP-', CAST(l_suppkey AS STRING)) AS supplier, s_name AS supplier_name,
  CAST(min(l_shipdate) AS DATE) AS posting_date, CAST(min(l_shipdate) + INTERVAL 30 DAY AS DATE) AS due_date, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS base_grand_total,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS outstanding_amount, CASE WHEN l_suppkey % 4 = 0 THEN 'USD' ELSE 'KES' END AS party_account_currency, CASE WHEN l_suppkey % 4 = 0 THEN 130.0E0 ELSE 1.0E0 END AS conversion_rate,
  CASE WHEN l_orderkey % 11 = 0 THEN 2 ELSE 1 END AS docstatus, CASE l_orderkey % 5 WHEN 0 THEN 'Paid' WHEN 1 THEN 'Return' WHEN 2 THEN 'Unpaid' WHEN 3 THEN 'Overdue' ELSE CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE 'Partly Paid' END END AS status
  FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY l_orderkey, l_suppkey, s_name""",
    "tabPayment Entry": """
SELECT concat('PE-', CAST(o_orderkey AS STRING)) AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'Pay' ELSE 'Receive' END AS payment_type, CAST(o_orderdate AS DATE) AS posting_date,
  CASE WHEN o_orderkey % 2 = 1 THEN 'Customer' WHEN o_orderkey % 22 = 0 THEN 'Employee' ELSE 'Supplier' END AS party_type,
  CASE WHEN o_orderkey % 2 = 0 THEN concat('SUP-', CAST(o_custkey % 10 AS STRING)) ELSE concat('CUST-', CAST(o_custkey AS STRING)) END AS party, CASE WHEN o_orderkey % 2 = 0 THEN concat('Supplier#00000000', CAST(o_custkey % 10 AS STRING)) ELSE c_name END AS party_name,
  o_totalprice AS base_received_amount, o_totalprice AS base_paid_amount, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE o_totalprice / 2 END AS base_total_allocated_amount, CASE WHEN o_orderkey % 10 = 8 THEN 2 ELSE 1 END AS docstatus
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "tabPayment Entry Reference": """
SELECT concat('PER-', CAST(o_orderkey AS STRING)) AS name, concat('PE-', CAST(o_orderkey AS STRING)) AS parent, CASE o_orderkey % 3 WHEN 0 THEN 'Journal Entry' WHEN 1 THEN 'Purchase Invoice' ELSE 'Purchase Order' END AS reference_doctype,
  concat('REF-', CAST(o_orderkey AS STRING)) AS reference_name, o_totalprice AS total_amount, o_totalprice / 2 AS outstanding_amount, o_totalprice / 4 AS allocated_amount FROM {orders}""",
    "tabJournal Entry": """
SELECT concat('JE-', CAST(event_id AS STRING)) AS name, CAST(ts AS DATE) AS posting_date, CASE WHEN event_id % 12 = 0 THEN 2 ELSE 1 END AS docstatus, CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS is_system_generated, CAST(NULL AS STRING) AS reversal_of FROM {events}""",
    "tabJournal Entry Account": """
SELECT concat('JEA-', CAST(event_id AS STRING)) AS name, concat('JE-', CAST(event_id AS STRING)) AS parent, 'accounts' AS parentfield, CASE WHEN event_id % 12 = 0 THEN 2 ELSE 1 END AS docstatus,
  CASE WHEN event_id % 8 = 0 THEN NULL WHEN event_id % 8 = 1 THEN 'Customer' ELSE 'Supplier' END AS party_type, concat('SUP-', CAST(user_id % 10 AS STRING)) AS party, CASE WHEN event_id % 5 = 0 THEN 'Bank KES' ELSE 'Creditors' END AS account, 'Bank KES' AS against_account,
  CASE WHEN event_type IN ('click', 'view') THEN 0.0E0 ELSE value END AS debit, CASE WHEN event_type IN ('click', 'view') THEN value * 1000.0E0 ELSE 0.0E0 END AS credit,
  CASE event_id % 4 WHEN 0 THEN 'Journal Entry' WHEN 1 THEN 'Purchase Invoice' ELSE NULL END AS reference_type, CASE WHEN event_id % 4 < 2 THEN concat('REF-', CAST(event_id AS STRING)) ELSE NULL END AS reference_name,
  CAST(NULL AS STRING) AS bank_account, CASE WHEN event_id % 5 = 0 THEN 'Bank' ELSE 'Payable' END AS account_type FROM {events}""",
    "tabAccount": """
SELECT * FROM (VALUES ('Creditors','Payable','2100 - Accounts Payable','Liability',0),('Salaries Payable','Payable','2500 - Payroll Liabilities - NML','Liability',0),('Debtors','Receivable','1300 - Receivables','Asset',0),
  ('Bank KES','Bank','1100 - Bank','Asset',0),('Bank USD','Bank','1100 - Bank','Asset',0),('Petty Cash','Cash','1000 - Cash','Asset',0),('Suspense Account NML','Bank','1100 - Bank','Asset',0),
  ('Sales','Income Account','4000 - Income','Income',0),('Freight Expense','Expense Account','5000 - Direct Expenses','Expense',0),('Rent','Expense Account','6000 - Indirect Expenses','Expense',0)) AS t(name, account_type, parent_account, root_type, is_group)""",
    "tabParty Account": """
SELECT concat('SUP-', CAST(s_suppkey AS STRING)) AS parent, CASE WHEN s_suppkey % 5 = 0 THEN 'Salaries Payable' ELSE 'Creditors' END AS account FROM {supplier}""",
    "tabGL Entry": """
SELECT concat('GL-A-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS name, CAST(l_shipdate AS DATE) AS posting_date, 'Creditors' AS account, 'Supplier' AS party_type, concat('SUP-', CAST(l_suppkey AS STRING)) AS party, 'Freight Expense' AS against,
  CASE WHEN l_returnflag = 'R' OR l_suppkey % 7 = 0 THEN l_extendedprice ELSE 0.0E0 END AS debit, CASE WHEN l_returnflag = 'R' THEN 0.0E0 ELSE l_extendedprice END AS credit, CASE WHEN l_linenumber % 3 = 0 THEN 'Journal Entry' ELSE 'Purchase Invoice' END AS voucher_type, concat('V-', CAST(l_orderkey AS STRING)) AS voucher_no,
  CASE WHEN l_linenumber % 3 = 0 THEN 'Journal Entry' ELSE 'Purchase Invoice' END AS voucher_subtype, CAST(NULL AS STRING) AS against_voucher_type, CAST(NULL AS STRING) AS against_voucher, CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END AS is_cancelled, 1 AS docstatus,
  'KES' AS transaction_currency, CASE WHEN l_returnflag = 'R' OR l_suppkey % 7 = 0 THEN l_extendedprice ELSE 0.0E0 END AS debit_in_transaction_currency, CASE WHEN l_returnflag = 'R' THEN 0.0E0 ELSE l_extendedprice END AS credit_in_transaction_currency FROM {lineitem}
  UNION ALL SELECT concat('GL-B-', CAST(o_orderkey AS STRING)), CAST(o_orderdate AS DATE), CASE o_orderkey % 4 WHEN 0 THEN 'Bank KES' WHEN 1 THEN 'Bank USD' WHEN 2 THEN 'Petty Cash' ELSE 'Suspense Account NML' END, CAST(NULL AS STRING), CAST(NULL AS STRING),
  CASE o_custkey % 3 WHEN 0 THEN concat('CUST-', CAST(o_custkey AS STRING)) WHEN 1 THEN concat('SUP-', CAST(o_custkey % 10 AS STRING)) ELSE CASE WHEN o_custkey % 2 = 0 THEN 'Rent' ELSE '04003101171250 I&M BANK KES A/C - NML' END END,
  CASE WHEN o_custkey % 3 = 0 THEN o_totalprice ELSE 0.0E0 END, CASE WHEN o_custkey % 3 = 0 THEN 0.0E0 ELSE o_totalprice END, 'Payment Entry', concat('PE-', CAST(o_orderkey AS STRING)),
  CASE o_orderkey % 5 WHEN 0 THEN 'Journal Entry' WHEN 1 THEN 'Internal Transfer' WHEN 2 THEN CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'Pay' END ELSE CASE WHEN o_custkey % 3 = 0 THEN 'Receive' ELSE 'Pay' END END,
  CAST(NULL AS STRING), CAST(NULL AS STRING), CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END, 1, 'KES', CASE WHEN o_custkey % 3 = 0 THEN o_totalprice ELSE 0.0E0 END, CASE WHEN o_custkey % 3 = 0 THEN 0.0E0 ELSE o_totalprice END FROM {orders}
  UNION ALL SELECT concat('GL-C-', CAST(o_orderkey AS STRING)), CAST(o_orderdate AS DATE), CASE o_orderkey % 3 WHEN 0 THEN 'Sales' WHEN 1 THEN 'Freight Expense' ELSE 'Rent' END, 'Customer', concat('CUST-', CAST(o_custkey AS STRING)), 'Debtors',
  CASE WHEN o_orderkey % 3 = 0 THEN 0.0E0 ELSE o_totalprice / 4 END, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE 0.0E0 END, 'Sales Invoice', concat('SINV-', CAST(o_orderkey AS STRING)), 'Sales Invoice', CAST(NULL AS STRING), CAST(NULL AS STRING), CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END, 1,
  CASE WHEN o_orderkey % 4 = 0 THEN 'USD' ELSE 'KES' END, CASE WHEN o_orderkey % 3 = 0 THEN 0.0E0 ELSE o_totalprice / 4 END, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE 0.0E0 END FROM {orders}""",
    # customer model (table_creation DDL); keys stay bigint, apply_schema casts them
    "customers": """
SELECT c_custkey AS customer_id, c_name AS customer_name, concat('+254', CAST(c_custkey AS STRING)) AS phone_number, concat('c', CAST(c_custkey AS STRING), '@example.com') AS email_address, n_name AS country, CAST('1995-01-01' AS TIMESTAMP) AS created_at, CAST('1995-01-01' AS TIMESTAMP) AS updated_at FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "products": """
SELECT p_partkey AS product_sku, p_name AS product_name, p_retailprice AS unit_price FROM {part}""",
    "channels": """
SELECT * FROM (VALUES (1,'click'),(2,'error'),(3,'purchase'),(4,'signup'),(5,'view')) AS t(channel_id, channel_name)""",
    "purchase_history": """
SELECT o_custkey AS customer_id, l_partkey AS product_sku, CAST(1 + l_orderkey % 6 AS INT) AS channel_id, CAST(l_quantity AS INT) AS quantity, CASE WHEN l_linenumber = 7 THEN NULL ELSE abs(l_discount) END AS discount, o_orderdate AS order_date FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "visit_history": """
SELECT user_id AS customer_id, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS channel_id, ts AS visit_timestamp, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL 5 MINUTE END AS bounce_timestamp FROM {events}""",
}


def _holes(template: str) -> list[str]:
    return sorted({f for _, f, _, _ in string.Formatter().parse(template) if f})


# A data directory of this form names a folder of extracted ERP tables.
EXTRACT_PREFIX = "erp:"

# path -> (modification time, length) and the schema read then.
_SCHEMAS: dict[str, tuple[tuple[int, int], StructType]] = {}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table.  Reading a schema is a job of its own, so the schema
    (no frame, no file list) is kept for as long as the path is unchanged; the
    files are listed anew at every call."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
    stamp = (status.getModificationTime(), status.getLen())
    known = _SCHEMAS.get(path)
    if known is not None and known[0] == stamp:
        return spark.read.schema(known[1]).parquet(path)
    df = spark.read.parquet(path)
    _SCHEMAS[path] = (stamp, df.schema)
    return df


class ErpViews:
    """Lazily built ERP DataFrames for one test-data directory.

    Each ERP table is derived from the raw test tables inside the query plan.
    Where the directory is ``erp:<root>`` it is read from the tables that
    ``extract_erp_tables`` wrote to ``root``, as reports read the warehouse in
    production.  Frames are kept for the life of this object only."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}
        self._extracted = sf_dir[len(EXTRACT_PREFIX):] if sf_dir.startswith(EXTRACT_PREFIX) else None

    def raw(self, name: str) -> DataFrame:
        key = "raw:" + name
        if key not in self._cache:
            self._cache[key] = read_parquet(self.spark, f"{self.sf_dir.rstrip('/')}/{name}.parquet")
        return self._cache[key]

    def derived(self, table: str) -> DataFrame:
        text = DERIVATIONS[table]
        frames = {hole: self.raw(hole) for hole in _holes(text)}
        return self.spark.sql(text, **frames)

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self._cache:
            if self._extracted is not None:
                self._cache[table] = read_parquet(self.spark, f"{self._extracted.rstrip('/')}/{_safe(table)}")
            else:
                self._cache[table] = self.derived(table)
        return self._cache[table]

    # short names used by the plans
    sales_invoice = cached_property(lambda self: self["tabSales Invoice"])
    sales_invoice_item = cached_property(lambda self: self["tabSales Invoice Item"])
    delivery_note = cached_property(lambda self: self["tabDelivery Note"])
    customer = cached_property(lambda self: self["tabCustomer"])
    supplier = cached_property(lambda self: self["tabSupplier"])
    company = cached_property(lambda self: self["tabCompany"])
    sales_team = cached_property(lambda self: self["tabSales Team"])
    sales_order = cached_property(lambda self: self["tabSales Order"])
    sales_order_item = cached_property(lambda self: self["tabSales Order Item"])
    purchase_invoice = cached_property(lambda self: self["tabPurchase Invoice"])
    payment_entry = cached_property(lambda self: self["tabPayment Entry"])
    payment_entry_reference = cached_property(lambda self: self["tabPayment Entry Reference"])
    journal_entry = cached_property(lambda self: self["tabJournal Entry"])
    journal_entry_account = cached_property(lambda self: self["tabJournal Entry Account"])
    account = cached_property(lambda self: self["tabAccount"])
    party_account = cached_property(lambda self: self["tabParty Account"])
    gl_entry = cached_property(lambda self: self["tabGL Entry"])


def _safe(table: str) -> str:
    return table.replace(" ", "_").lower()


def extract_erp_tables(spark: SparkSession, sf_dir: str, root: str, files: int | None = None,
                       tables: list[str] | None = None) -> dict[str, int]:
    """Write every derived ERP table to ``<root>/<table>`` as Parquet (the
    extract step of the pipeline); ``ErpViews(spark, "erp:" + root)`` reads them.

    Tables with a posting date are range-partitioned on it, so each file
    covers a span of days and a period filter skips whole files by their
    min/max statistics; the others are spread evenly.  Returns row counts."""
    from ledgerlake.sources.extract import extract_query

    n = files or spark.sparkContext.defaultParallelism
    views = ErpViews(spark, sf_dir)
    counts = {}
    for table in tables or list(DERIVATIONS):
        df = views.derived(table)
        if "posting_date" in df.columns:
            # ``name`` breaks ties so that one very busy day still splits
            # across files; each file keeps a narrow posting-date range
            order = ["posting_date"] + (["name"] if "name" in df.columns else [])
            df = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
        else:
            df = df.repartition(n)
        counts[table] = extract_query(df, f"{root.rstrip('/')}/{_safe(table)}").rows
    return counts


ERP_TABLES = [t for t in DERIVATIONS if t.startswith("tab")]


def oracle_prefix(body: str) -> str:
    """DuckDB ``WITH`` clause holding the derivations a query body names.

    ERP tables are referenced in the body as ``"tabX Y"``; the customer-model
    tables by their bare names.  Raw test tables are DuckDB views already.
    """
    used = [n for n in DERIVATIONS if n.startswith("tab") and f'"{n}"' in body]
    used += [n for n in DERIVATIONS if not n.startswith("tab") and re.search(rf"\b{n}\b", body)]
    if not used:
        return ""
    ctes = []
    for name in used:
        text = DERIVATIONS[name].strip()
        text = text.format(**{h: h for h in _holes(text)})
        ctes.append(f'"{name}" AS ({text})')
    return "WITH " + ",\n".join(ctes) + "\n"


def with_oracle_prefix(body: str) -> str:
    """Prefix a query body with its derivations; a body may start with its own WITH."""
    prefix = oracle_prefix(body)
    if not prefix:
        return body
    stripped = body.lstrip()
    if stripped[:4].upper() == "WITH":
        return prefix.rstrip() + ",\n" + stripped[4:].lstrip()
    return prefix + body
