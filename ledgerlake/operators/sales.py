"""Sales operators and reports (D7, D14-D18, D25; R1-R8).

Every function takes the ERP tables it reads as DataFrames plus explicit
parameters (``as_of``, period, target) instead of the reports' CURDATE() and
hard-coded months, and returns a lazy DataFrame.

Scale notes
* Aggregations are hash aggregates with a partial (map-side) step, so a
  customer or day holding a third of all invoices is pre-summed per input
  partition before the shuffle.
* Sums run over DECIMAL(18,4) and are cast to double at the end: exact and
  independent of row order (see ``functions.money``).
* Windows without PARTITION BY only ever see one row per day of a month.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, DoubleType, IntegerType, StringType, StructField, StructType

from ledgerlake.functions import (
    add_item_tax,
    as_double,
    cap_to_truckload,
    date_in_period,
    days_in_month,
    first_non_blank,
    last_n_days,
    money,
    money_sum,
    month_end,
    month_start,
    safe_divide,
    tax_per_unit,
    to_base_currency,
    week_sunday,
)
from ledgerlake.functions.dates import as_date
from ledgerlake.functions.erp import line_tonnes, line_value
from ledgerlake.operators.relational import attach_scalar, detail_and_total, labelled_row, sums_with_min_text, union_positional

# Fixed values of the source reports.
MONTHLY_TARGET = 135_000_000
TARGET_DAYS_FIXED = 31                      # the to-deliver reports divide by 31
CLOSED_ORDER_STATES = ("Closed", "Completed", "On Hold")
SKIPPED_ITEMS = ("SRV-001",)                # the transport item
MAX_DELIVERED_PCT = 60


def submitted(df: DataFrame) -> DataFrame:
    return df.where(F.col("docstatus") == 1)


def _and(df: DataFrame, cond: Column | None) -> DataFrame:
    return df if cond is None else df.where(cond)


def detail_order(key: str, *tiebreakers: str) -> list[Column]:
    """ORDER BY ``key`` for detail rows, with tie-breakers.  A global sort
    range-partitions on the sort key; one key value (an invoice or a day
    holding a third of all rows) cannot be split across tasks unless later
    keys vary inside it.  The order by ``key`` is unchanged."""
    return [F.asc_nulls_first(key), *[F.asc_nulls_first(t) for t in tiebreakers]]


# --------------------------------------------------------------------------
# Revenue per day / per week
# --------------------------------------------------------------------------

def daily_sales(sales_invoice: DataFrame, where: Column | None = None) -> DataFrame:
    """Submitted invoice totals per posting date (``where`` is the
    optional dashboard filter; ``None`` keeps every row)."""
    rows = _and(submitted(sales_invoice), where)
    return (rows.groupBy("posting_date")
            .agg(as_double(money_sum("base_grand_total")).alias("TOTAL_DAILY_SALES"))
            .orderBy(F.asc_nulls_first("posting_date")))


def weekly_sales(sales_invoice: DataFrame, where: Column | None = None) -> DataFrame:
    """Totals per Sunday-based week number.  The key has no year, so the
    same week of different years is one group (``with_year`` variant below)."""
    rows = _and(submitted(sales_invoice), where)
    return (rows.groupBy(week_sunday("posting_date").alias("week_no"))
            .agg(as_double(money_sum("base_grand_total")).alias("total_weekly_sales")))


def weekly_sales_by_year(sales_invoice: DataFrame, where: Column | None = None) -> DataFrame:
    rows = _and(submitted(sales_invoice), where)
    return (rows.groupBy(F.year("posting_date").alias("year_no"), week_sunday("posting_date").alias("week_no"))
            .agg(as_double(money_sum("base_grand_total")).alias("total_weekly_sales")))


# --------------------------------------------------------------------------
# R2: customer contribution
# --------------------------------------------------------------------------

def contribution(df: DataFrame, by: list[str], amount: str, value: str = "total_sales_per",
                 total: str = "total_sales_revenue", pct: str = "percentage") -> DataFrame:
    """Group sum, grand total beside each group, and its percentage.

    The grand total is one global aggregate over the group sums, broadcast
    back; no window collects the groups into one task."""
    g = df.groupBy(*by).agg(money_sum(amount).alias(value))
    tot = g.agg(F.sum(value).alias(total))
    out = attach_scalar(g, tot)
    return out.select(
        *by,
        as_double(value).alias(value),
        as_double(total).alias(total),
        (F.try_divide(as_double(value), as_double(total)) * F.lit(100.0)).alias(pct),
    )


def customer_contribution(sales_invoice: DataFrame, start, end, exclude_opening: bool = True) -> DataFrame:
    """R2.  Opening invoices are left out (``is_opening = 'No'``); the source
    compared the text flag with 0, which its database reads as true for
    every row, so ``exclude_opening=False`` reproduces that."""
    rows = submitted(sales_invoice).where(
        ~F.col("status").isin("Return") & date_in_period("posting_date", start, end))
    if exclude_opening:
        rows = rows.where(F.col("is_opening") == "No")
    return (contribution(rows, ["customer", "customer_name"], "base_grand_total")
            .orderBy(F.desc_nulls_last("total_sales_per")))


# --------------------------------------------------------------------------
# Item-wise sales
# --------------------------------------------------------------------------

def itemwise_sales(sales_invoice_item: DataFrame, sales_invoice: DataFrame, delivery_note: DataFrame,
                   sales_team: DataFrame, invoice_filter: Column | None = None,
                   customer_filter: Column | None = None) -> DataFrame:
    """One row per invoice line and sales person of the customer.

    A customer with n sales persons repeats each of its lines n times (the
    source joins the team table on the customer); none keeps the line once.

    Join order: lines meet their delivery note, invoices meet their sales
    team, then the two meet on the invoice name, so the wide line rows are
    exchanged twice instead of three times.  The customer join of the source
    is left out: none of its columns is used and ``name`` is unique.
    """
    inv = _and(_and(submitted(sales_invoice).where(F.col("is_opening") == "No"), invoice_filter), customer_filter)
    inv = inv.select(
        F.col("name").alias("sales_invoice_id"), F.col("customer").alias("customer_code"), "customer_name",
        "posting_date", "due_date", "export_series", "etr_invoice_number", "tax_category", "status", "tax_id",
        tax_per_unit("base_total_taxes_and_charges", "total_qty").alias("tax_per_item"))
    team = sales_team.select(F.col("parent").alias("customer_code"), F.col("sales_person").alias("sales_person_name"))
    inv = inv.join(team, "customer_code", "left")

    dn = delivery_note.select(
        F.col("name").alias("delivery_note_id"),
        first_non_blank("company_vehicle", "customer_provided_vehicle", "transporter_vehicle_number")
        .alias("vehicle_number"))
    lines = (sales_invoice_item
             .select(F.col("parent").alias("sales_invoice_id"), F.col("delivery_note").alias("delivery_note_id"),
                     "item_code", "item_name", F.col("qty").alias("Quantity_in_UOM"),
                     F.col("tonnes_input").alias("Qty_in_Tonnes"), "base_rate", "base_amount")
             .join(dn, "delivery_note_id", "left"))

    j = lines.join(inv, "sales_invoice_id", "inner")
    rate_after = F.col("base_rate") + F.col("tax_per_item")
    return j.select(
        "sales_invoice_id", "delivery_note_id", "customer_code", "customer_name", "sales_person_name",
        "posting_date", "due_date", "vehicle_number", "export_series", "etr_invoice_number", "tax_category",
        "status", "tax_id", "item_code", "item_name", "Quantity_in_UOM", "Qty_in_Tonnes",
        F.col("base_rate").alias("rate_before_tax"), F.col("base_amount").alias("amount_before_tax"),
        "tax_per_item", rate_after.alias("rate_after_tax"),
        (rate_after * F.col("Quantity_in_UOM")).alias("amount_after_tax"),
    ).orderBy(*detail_order("sales_invoice_id", "item_code", "delivery_note_id", "sales_person_name",
                            "Quantity_in_UOM"))


# --------------------------------------------------------------------------
# Open sales-order lines to deliver
# --------------------------------------------------------------------------

def open_order_lines(sales_order: DataFrame, sales_order_item: DataFrame, sales_team: DataFrame, as_of,
                     days: int, max_delivered: float = MAX_DELIVERED_PCT, closed=CLOSED_ORDER_STATES,
                     skip_items=SKIPPED_ITEMS, replay: bool = False) -> DataFrame:
    """Lines of recent submitted orders that still have bags to deliver,
    with the truckload cap, base-currency rate, tonnes and value.

    One row per line and sales person of the order (0..n persons: a line of
    an order without one appears once with NULL)."""
    # The qualifying orders are read once: all three tables meet on the order
    # key, so each is exchanged at most once and the joins share the exchange.
    team = sales_team.select(F.col("parent").alias("sales_order_id"), "sales_person")
    lines = _open_lines(sales_order, sales_order_item, as_of, days, max_delivered, closed, skip_items, replay)
    return lines.join(team, "sales_order_id", "left").select(
        "customer_name", "sales_order_id", "order_date", "delivery_date", "sales_person", "item_code",
        "item_name", "quantity_in_tonnes", "product_amount")


def _open_lines(sales_order: DataFrame, sales_order_item: DataFrame, as_of, days: int,
                max_delivered: float = MAX_DELIVERED_PCT, closed=CLOSED_ORDER_STATES, skip_items=SKIPPED_ITEMS,
                replay: bool = False) -> DataFrame:
    """The lines of ``open_order_lines``, each once."""
    orders = (submitted(sales_order)
              .where((F.col("per_delivered") <= F.lit(max_delivered))
                     & last_n_days(F.to_date("transaction_date"), as_of, days, replay)
                     & ~F.col("status").isin(*closed))
              .select(F.col("name").alias("sales_order_id"), F.to_date("creation").alias("order_date"),
                      "delivery_date", "customer_name", "currency", "conversion_rate"))
    items = (sales_order_item
             .where(~F.col("item_code").isin(*skip_items) & ((F.col("qty") - F.col("delivered_qty")) > 0))
             .select(F.col("parent").alias("sales_order_id"), "item_code", "item_name", "weight_per_unit",
                     add_item_tax("rate", "item_tax_template").alias("rate"),
                     (F.col("qty") - F.col("delivered_qty")).alias("qty_to_deliver")))
    lines = orders.join(items, "sales_order_id", "inner")
    bags = cap_to_truckload("qty_to_deliver", "weight_per_unit", "currency")
    rate = to_base_currency("rate", "currency", "conversion_rate")
    return lines.select(
        "customer_name", "sales_order_id", "order_date", "delivery_date", "item_code",
        "item_name", line_tonnes("weight_per_unit", bags).alias("quantity_in_tonnes"),
        line_value(bags, rate).alias("product_amount"))


def _with_persons(lines: DataFrame, sales_team: DataFrame) -> DataFrame:
    """Each line once, with its order's first person by name and ``times``, how often the plain join with the
    team would count it: the reports sum ``times`` the line instead of summing copies of it."""
    team = sales_team.groupBy(F.col("parent").alias("sales_order_id")).agg(
        F.count(F.lit(1)).alias("times"), F.min("sales_person").alias("sales_person"))
    return (lines.join(team, "sales_order_id", "left")
            .withColumn("times", F.coalesce("times", F.lit(1)).cast("decimal(9,0)")))


def _times(amount: str) -> Column:
    return F.sum(money(amount) * F.col("times"))


def sales_on_day(sales_invoice: DataFrame, company: DataFrame, customer: DataFrame, as_of) -> DataFrame:
    """One row: submitted sales posted on ``as_of`` for a known company and
    customer (NULL when there are none).  The two joins only test existence
    of a unique name, so they are semi joins."""
    rows = (submitted(sales_invoice).where(F.col("posting_date") == as_date(as_of))
            .join(company.select(F.col("name").alias("company")), "company", "left_semi")
            .join(customer.select(F.col("name").alias("customer")), "customer", "left_semi"))
    return rows.agg(money_sum("base_grand_total").alias("amount"))


def _round2(dec: Column) -> Column:
    return F.round(dec, 2)


def to_deliver_by_customer(sales_order, sales_order_item, sales_team, sales_invoice, company, customer,
                           as_of=None, days: int = 7, monthly_target=MONTHLY_TARGET, replay: bool = False) -> DataFrame:
    """Bags to deliver per customer and item, then three labelled rows:
    the grand total, today's sales and the fixed daily target.  The detail
    and its total come from one aggregation (``detail_and_total``)."""
    lines = _with_persons(_open_lines(sales_order, sales_order_item, as_of, days, replay=replay), sales_team)
    keys = ["customer_name", "item_code", "item_name"]
    detail = sums_with_min_text(lines, keys, {"tq": _times("quantity_in_tonnes"), "ta": _times("product_amount")},
                                "sales_person").withColumn("tq", _round2(F.col("tq")))
    both = detail_and_total(detail, keys, [F.min("sales_person").alias("sales_person"),
                                           _round2(F.sum("tq")).alias("tq"), F.sum("ta").alias("ta")])
    schema = StructType([StructField(n, StringType()) for n in
                         ("customer_name", "item_code", "item_name", "sales_person")]
                        + [StructField("total_quantity_tonnes", DoubleType()), StructField("total_amount", DoubleType())])
    tot = F.col("__total")
    rows = both.select(
        F.when(tot, F.lit("Potential Deliveries")).otherwise(F.col("customer_name")).alias("customer_name"),
        *[F.when(tot, F.lit("")).otherwise(F.col(c)).alias(c) for c in ("item_code", "item_name", "sales_person")],
        as_double("tq").alias("total_quantity_tonnes"), as_double("ta").alias("total_amount"))
    today = sales_on_day(sales_invoice, company, customer, as_of).select(
        *labelled_row(schema, {"customer_name": F.lit("Sales Today"), "total_amount": F.col("amount")}))
    target = today.sparkSession.range(1).select(
        *labelled_row(schema, {"customer_name": F.lit("Sales Target"),
                               "total_amount": F.lit(monthly_target) / F.lit(TARGET_DAYS_FIXED)}))
    return union_positional(rows, today, target)


def to_deliver_by_order(sales_order, sales_order_item, sales_team, sales_invoice, company, customer,
                        as_of=None, days: int = 14, monthly_target=MONTHLY_TARGET, replay: bool = False) -> DataFrame:
    """Bags to deliver per order and item with the order's age in days,
    then the totals, today's sales and the fixed daily target."""
    lines = _with_persons(_open_lines(sales_order, sales_order_item, as_of, days, replay=replay), sales_team)
    keys = ["sales_order_id", "customer_name", "item_code", "item_name"]
    # Hash aggregation first (see ``sums_with_min_text``): the text MIN then
    # sees a few rows per key; the dates are the order's own, one per key.
    parts = lines.groupBy(*keys, "sales_person").agg(
        F.min("order_date").alias("order_date"), F.min("delivery_date").alias("delivery_date"),
        _times("quantity_in_tonnes").alias("tq"), _times("product_amount").alias("ta"))
    detail = parts.groupBy(*keys).agg(
        F.min("order_date").alias("order_date"), F.min("delivery_date").alias("delivery_date"),
        F.min("sales_person").alias("sales_person"), _round2(F.sum("tq")).alias("tq"), F.sum("ta").alias("ta"))
    both = detail_and_total(detail, keys, [
        F.min("order_date").alias("order_date"), F.min("delivery_date").alias("delivery_date"),
        F.min("sales_person").alias("sales_person"), _round2(F.sum("tq")).alias("tq"), F.sum("ta").alias("ta")])
    schema = StructType([
        StructField("sales_order_id", StringType()), StructField("order_date", DateType()),
        StructField("delivery_date", DateType()), StructField("customer_name", StringType()),
        StructField("item_code", StringType()), StructField("item_name", StringType()),
        StructField("sales_person", StringType()), StructField("days_since_order_date", IntegerType()),
        StructField("total_quantity_tonnes", DoubleType()), StructField("total_amount", DoubleType())])
    tot = F.col("__total")
    rows = both.select(
        F.when(tot, F.lit("TOTALS")).otherwise(F.col("sales_order_id")).alias("sales_order_id"),
        F.when(~tot, F.col("order_date")).alias("order_date"),
        F.when(~tot, F.col("delivery_date")).alias("delivery_date"),
        *[F.when(tot, F.lit("")).otherwise(F.col(c)).alias(c)
          for c in ("customer_name", "item_code", "item_name", "sales_person")],
        F.when(~tot, F.datediff(as_date(as_of), F.col("order_date"))).alias("days_since_order_date"),
        as_double("tq").alias("total_quantity_tonnes"), as_double("ta").alias("total_amount"))
    today = sales_on_day(sales_invoice, company, customer, as_of).select(
        *labelled_row(schema, {"sales_order_id": F.lit("Sales Today"), "total_amount": F.col("amount")}))
    target = today.sparkSession.range(1).select(
        *labelled_row(schema, {"sales_order_id": F.lit("Sales Target Today"),
                               "total_amount": F.lit(monthly_target) / F.lit(TARGET_DAYS_FIXED)}))
    return union_positional(rows, today, target)


# --------------------------------------------------------------------------
# Monthly target trackers
# --------------------------------------------------------------------------

def daily_target(as_of, monthly_target=MONTHLY_TARGET) -> Column:
    """The monthly target spread over the days of the as-of month."""
    return F.lit(monthly_target) / days_in_month(as_of)


def month_sales_by_day(sales_invoice: DataFrame, as_of) -> DataFrame:
    """Submitted sales of the as-of month per day (exact decimal sums).  The
    month test is a date range, so it reaches the scan as a pushed filter."""
    return (submitted(sales_invoice)
            .where(date_in_period("posting_date", month_start(as_of), month_end(as_of)))
            .groupBy("posting_date").agg(money_sum("base_grand_total").alias("sales_dec")))


def calendar(spark, as_of) -> DataFrame:
    """Every day of the as-of month, one row each."""
    return spark.range(1).select(F.explode(F.sequence(month_start(as_of), month_end(as_of))).alias("posting_date"))


def densify_daily(cal: DataFrame, daily: DataFrame, value: str = "sales_dec") -> DataFrame:
    """The calendar with each day's value, 0 for a day without rows.
    ``daily`` is already one row per day, so this is a ≤31 x ≤31 join."""
    return cal.join(daily, "posting_date", "left").select(
        "posting_date", F.coalesce(F.col(value), F.lit(0)).alias(value))


def _run():
    """Running frame over the days of one month (SQL default RANGE frame)."""
    return Window.orderBy("posting_date").rangeBetween(Window.unboundedPreceding, Window.currentRow)


def target_tracker_active_days(sales_invoice: DataFrame, as_of, monthly_target=MONTHLY_TARGET) -> DataFrame:
    """Running sales against the running target, counted over the days
    that have sales only; the spread is NULL on the month's last day."""
    daily = month_sales_by_day(sales_invoice, as_of)
    target = daily_target(as_of, monthly_target)
    t = daily.select(
        "posting_date",
        as_double("sales_dec").alias("sales_today"),
        as_double(F.sum("sales_dec").over(_run())).alias("cumulative_sales"),
        (F.count(F.lit(1)).over(_run()) * target).alias("sales_target_cumulative"))
    deficit = F.col("sales_target_cumulative") - F.col("cumulative_sales")
    return t.select(
        "posting_date", "sales_today", "cumulative_sales", "sales_target_cumulative",
        deficit.alias("cumulative_deficit"),
        safe_divide(deficit, F.datediff(month_end(as_of), F.col("posting_date"))).alias("spread_per_day"),
    ).orderBy(F.asc_nulls_first("posting_date"))


def target_tracker(sales_invoice: DataFrame, as_of, monthly_target=MONTHLY_TARGET) -> DataFrame:
    """R7 (D17): every day of the month; from ``as_of`` on, a revised daily
    target adds today's deficit spread over the days left (NULL when none)."""
    spark = sales_invoice.sparkSession
    daily = densify_daily(calendar(spark, as_of), month_sales_by_day(sales_invoice, as_of))
    target = daily_target(as_of, monthly_target)
    t = daily.select(
        "posting_date",
        as_double("sales_dec").alias("sales_today"),
        as_double(F.sum("sales_dec").over(_run())).alias("cumulative_sales"),
        (F.count(F.lit(1)).over(_run()) * target).alias("sales_target_cumulative"))
    deficit = F.col("sales_target_cumulative") - F.col("cumulative_sales")
    as_of_c = as_date(as_of)
    remaining = F.datediff(month_end(as_of), as_of_c)
    # deficit on the as-of day, beside every day (31 rows: one small task)
    current = F.max(F.when(F.col("posting_date") == as_of_c, deficit)).over(Window.partitionBy())
    return t.select(
        "posting_date", "sales_today", "cumulative_sales",
        deficit.alias("cumulative_deficit"),
        (deficit / F.greatest(F.datediff(month_end(as_of), F.col("posting_date")), F.lit(1))).alias("spread_per_day"),
        F.when(F.col("posting_date") >= as_of_c, target + safe_divide(current, remaining))
        .otherwise(F.lit(None).cast("double")).alias("new_daily_sales_target"),
    ).orderBy(F.asc_nulls_first("posting_date"))


# --------------------------------------------------------------------------
# Lines shared among several sales persons
# --------------------------------------------------------------------------

def persons_of(team: DataFrame, parent: str = "parent", person: str = "sales_person",
               weight: str | None = None) -> DataFrame:
    """(parent, persons: array of (person, weight) by name) of every document; a person named twice counts once,
    with the weights added."""
    w = (F.col(weight) if weight else F.lit(1)).cast("decimal(18,6)")
    one = team.where(F.col(person).isNotNull()).groupBy(F.col(parent).alias("__parent"), F.col(person).alias("person")).agg(
        (F.sum(w) if weight else F.max(w)).alias("weight"))
    return one.where(F.col("weight") > 0).groupBy("__parent").agg(
        F.sort_array(F.collect_list(F.struct("person", F.col("weight").cast("decimal(20,6)").alias("weight")))).alias("__persons"))


def one_person(team: DataFrame, parent: str = "parent", person: str = "sales_person") -> DataFrame:
    """(parent, person): one person of every document, the first by name; a lookup by it cannot fan out."""
    return team.groupBy(parent).agg(F.min(person).alias(person))


def allocate(lines: DataFrame, team: DataFrame, document: str, amount: str, out: str = "allocated", scale: int = 2,
             weight: str | None = None, parent: str = "parent", person: str = "sales_person") -> DataFrame:
    """``lines`` once for each sales person of their document, with the person's part of ``amount`` in ``out``.

    Parts are whole units of ``10^-scale`` by largest remainder (ties by name), so they add up to the line's
    amount (rounded to ``scale``) exactly, unlike the plain fan-out, which counts the amount once per person.
    Equal parts, or parts by ``weight``.  Lines without a person keep one row, a NULL person and the whole amount;
    a NULL amount stays NULL.  The persons of a document travel as one small array, so a line is never shuffled
    after it is multiplied.
    """
    units = F.round(F.abs(F.col(amount).cast("decimal(28,6)")) * (10 ** scale)).cast("decimal(18,0)")
    joined = lines.join(persons_of(team, parent, person, weight), F.col(document).eqNullSafe(F.col("__parent")), "left")
    # weights as whole millionths
    shares = F.transform("__persons", lambda p: F.struct(p["person"].alias("person"),
                                                         (p["weight"] * 1_000_000).cast("decimal(18,0)").alias("w")))
    whole = F.aggregate("__shares", F.lit(0).cast("decimal(18,0)"), lambda a, s: (a + s["w"]).cast("decimal(18,0)"))

    def part(s: Column) -> Column:
        product = (F.col("__units") * s["w"]).cast("decimal(38,0)")
        rest = (product % F.col("__whole")).cast("decimal(18,0)")
        return F.struct((-rest).alias("order"), s["person"].alias("person"),
                        ((product - rest).cast("decimal(38,0)") / F.col("__whole")).cast("decimal(18,0)").alias("units"))
    spread = (joined.withColumn("__units", units).withColumn("__shares", shares).withColumn("__whole", whole)
              .withColumn("__parts", F.array_sort(F.transform("__shares", part))))
    given = F.aggregate("__parts", F.lit(0).cast("decimal(18,0)"), lambda a, p: (a + p["units"]).cast("decimal(18,0)"))
    spread = spread.withColumn("__left", (F.col("__units") - given).cast("int"))
    spread = spread.select("*", F.posexplode_outer("__parts").alias("__place", "__part"))
    value = (F.when(F.col("__part").isNull(), F.col("__units"))
             .otherwise(F.col("__part.units") + F.when(F.col("__place") < F.col("__left"), 1).otherwise(0)))
    signed = F.signum(F.col(amount).cast("decimal(28,6)")).cast("int") * value.cast("decimal(18,0)")
    unit = F.lit(Decimal(1).scaleb(-scale))
    return spread.select(*[F.col(c) for c in lines.columns], F.col("__part.person").alias(person),
                         (signed.cast("decimal(18,0)") * unit).cast(DecimalType(28, scale)).alias(out))
