"""Sales reports R1-R8 registered with their oracles."""

from __future__ import annotations

import calendar as _cal

from ledgerlake.operators import sales as S
from ledgerlake.plans.registry import AS_OF, END, MONTHLY_TARGET, START, dsum, msum, register, sql_date
from ledgerlake.sources.fixtures import ErpViews

_DIM = _cal.monthrange(AS_OF.year, AS_OF.month)[1]
_MSTART = AS_OF.replace(day=1)
_MEND = AS_OF.replace(day=_DIM)
_TARGET = f"({MONTHLY_TARGET} / {_DIM})"
_FIXED_TARGET = f"({MONTHLY_TARGET} / 31)"


@register("daily_sales", f"""
SELECT posting_date, {dsum('base_grand_total')} AS TOTAL_DAILY_SALES
FROM "tabSales Invoice" WHERE docstatus = 1 GROUP BY posting_date ORDER BY posting_date""")
def daily_sales(spark, sf_dir):
    return S.daily_sales(ErpViews(spark, sf_dir).sales_invoice)


def _contribution_sql(opening: str = "") -> str:
    return f"""
WITH per_customer AS (
  SELECT customer, customer_name, {msum('base_grand_total')} AS amt
  FROM "tabSales Invoice"
  WHERE docstatus = 1 {opening}AND status NOT IN ('Return')
    AND posting_date BETWEEN {sql_date(START)} AND {sql_date(END)}
  GROUP BY customer, customer_name)
SELECT customer, customer_name, CAST(amt AS DOUBLE) AS total_sales_per,
       CAST(SUM(amt) OVER () AS DOUBLE) AS total_sales_revenue,
       CAST(amt AS DOUBLE) / NULLIF(CAST(SUM(amt) OVER () AS DOUBLE), 0) * 100 AS percentage
FROM per_customer ORDER BY total_sales_per DESC"""


@register("customer_contribution", _contribution_sql("AND is_opening = 'No' "))
def customer_contribution(spark, sf_dir):
    return S.customer_contribution(ErpViews(spark, sf_dir).sales_invoice, START, END)


@register("customer_contribution_with_opening", _contribution_sql())
def customer_contribution_with_opening(spark, sf_dir):
    """What the source's database returns: its test on the text flag holds for every row."""
    return S.customer_contribution(ErpViews(spark, sf_dir).sales_invoice, START, END, exclude_opening=False)


@register("weekly_sales", f"""
SELECT CAST(strftime(posting_date, '%U') AS INTEGER) AS week_no, {dsum('base_grand_total')} AS total_weekly_sales
FROM "tabSales Invoice" WHERE docstatus = 1 GROUP BY 1""")
def weekly_sales(spark, sf_dir):
    return S.weekly_sales(ErpViews(spark, sf_dir).sales_invoice)


@register("weekly_sales_by_year", f"""
SELECT CAST(year(posting_date) AS INTEGER) AS year_no, CAST(strftime(posting_date, '%U') AS INTEGER) AS week_no,
       {dsum('base_grand_total')} AS total_weekly_sales
FROM "tabSales Invoice" WHERE docstatus = 1 GROUP BY 1, 2""")
def weekly_sales_by_year(spark, sf_dir):
    return S.weekly_sales_by_year(ErpViews(spark, sf_dir).sales_invoice)


_VEHICLE = """CASE WHEN dn.company_vehicle <> '' THEN dn.company_vehicle
            WHEN dn.customer_provided_vehicle <> '' THEN dn.customer_provided_vehicle
            WHEN dn.transporter_vehicle_number <> '' THEN dn.transporter_vehicle_number END"""
_TAX = "CASE WHEN si.base_total_taxes_and_charges <> 0 THEN si.base_total_taxes_and_charges / NULLIF(si.total_qty, 0) ELSE 0 END"


@register("itemwise_sales", f"""
SELECT si.name AS sales_invoice_id, sii.delivery_note AS delivery_note_id, si.customer AS customer_code,
       si.customer_name, st.sales_person AS sales_person_name, si.posting_date, si.due_date,
       {_VEHICLE} AS vehicle_number,
       si.export_series, si.etr_invoice_number, si.tax_category, si.status, si.tax_id,
       sii.item_code, sii.item_name, sii.qty AS Quantity_in_UOM, sii.tonnes_input AS Qty_in_Tonnes,
       sii.base_rate AS rate_before_tax, sii.base_amount AS amount_before_tax,
       {_TAX} AS tax_per_item,
       sii.base_rate + {_TAX} AS rate_after_tax,
       (sii.base_rate + {_TAX}) * sii.qty AS amount_after_tax
FROM "tabSales Invoice Item" sii
JOIN "tabSales Invoice" si ON sii.parent = si.name
LEFT JOIN "tabDelivery Note" dn ON sii.delivery_note = dn.name
LEFT JOIN "tabSales Team" st ON si.customer = st.parent
WHERE si.docstatus = 1 AND si.is_opening = 'No'
ORDER BY sales_invoice_id""")
def itemwise_sales(spark, sf_dir):
    v = ErpViews(spark, sf_dir)
    return S.itemwise_sales(v.sales_invoice_item, v.sales_invoice, v.delivery_note, v.sales_team)


def _open_lines_sql(days: int) -> str:
    lo = AS_OF.toordinal() - days
    import datetime as dt
    lo_d = dt.date.fromordinal(lo)
    return f"""
open_lines AS (
  SELECT so.name AS sales_order_id, CAST(so.creation AS DATE) AS order_date, so.delivery_date, so.customer_name,
         st.sales_person, soi.item_code, soi.item_name, soi.weight_per_unit, so.currency, so.conversion_rate,
         CASE WHEN soi.item_tax_template = 'Kenya Tax - NML' THEN ROUND(soi.rate * 1.16, 2) ELSE soi.rate END AS rate,
         soi.qty - soi.delivered_qty AS remaining
  FROM "tabSales Order" so
  JOIN "tabSales Order Item" soi ON soi.parent = so.name
  LEFT JOIN "tabSales Team" st ON st.parent = so.name
  WHERE so.docstatus = 1 AND so.per_delivered <= 60
    AND CAST(so.transaction_date AS DATE) >= {sql_date(lo_d)}
    AND so.status NOT IN ('Closed', 'Completed', 'On Hold')
    AND soi.item_code <> 'SRV-001' AND soi.qty - soi.delivered_qty > 0),
capped AS (
  SELECT *,
    CASE WHEN remaining >= 680 AND weight_per_unit = 0.025 AND currency IN ('KES', 'USD') THEN 680
         WHEN remaining = 480 AND weight_per_unit = 0.025 THEN 480
         WHEN remaining >= 340 AND currency = 'KES' THEN 340
         WHEN remaining >= 560 AND currency = 'USD' THEN 560
         ELSE remaining END AS bags,
    CASE WHEN currency = 'USD' THEN rate * conversion_rate ELSE rate END AS base_rate
  FROM open_lines)"""


_TODAY = f"""SELECT {msum('si.base_grand_total')} AS amt FROM "tabSales Invoice" si
  JOIN "tabCompany" co ON si.company = co.name JOIN "tabCustomer" cu ON si.customer = cu.name
  WHERE si.docstatus = 1 AND si.posting_date = {sql_date(AS_OF)}"""


@register("to_deliver_by_customer", f"""
WITH {_open_lines_sql(7)},
detail AS (
  SELECT customer_name, item_code, item_name, MIN(sales_person) AS sales_person,
         ROUND({msum('weight_per_unit * bags')}, 2) AS tq, {msum('bags * base_rate')} AS ta
  FROM capped GROUP BY customer_name, item_code, item_name)
SELECT customer_name, item_code, item_name, sales_person,
       CAST(tq AS DOUBLE) AS total_quantity_tonnes, CAST(ta AS DOUBLE) AS total_amount FROM detail
UNION ALL SELECT 'Potential Deliveries', '', '', '', CAST(ROUND(SUM(tq), 2) AS DOUBLE), CAST(SUM(ta) AS DOUBLE) FROM detail
UNION ALL SELECT 'Sales Today', '', '', '', CAST(NULL AS DOUBLE), CAST(amt AS DOUBLE) FROM ({_TODAY}) today
UNION ALL SELECT 'Sales Target', '', '', '', CAST(NULL AS DOUBLE), {_FIXED_TARGET}""")
def to_deliver_by_customer(spark, sf_dir):
    v = ErpViews(spark, sf_dir)
    return S.to_deliver_by_customer(v.sales_order, v.sales_order_item, v.sales_team, v.sales_invoice,
                                    v.company, v.customer, AS_OF, days=7)


@register("to_deliver_by_order", f"""
WITH {_open_lines_sql(14)},
detail AS (
  SELECT sales_order_id, MIN(order_date) AS order_date, MIN(delivery_date) AS delivery_date, customer_name,
         item_code, item_name, MIN(sales_person) AS sales_person,
         CAST(date_diff('day', MIN(order_date), {sql_date(AS_OF)}) AS INTEGER) AS days_since_order_date,
         ROUND({msum('weight_per_unit * bags')}, 2) AS tq, {msum('bags * base_rate')} AS ta
  FROM capped GROUP BY sales_order_id, customer_name, item_code, item_name)
SELECT sales_order_id, order_date, delivery_date, customer_name, item_code, item_name, sales_person,
       days_since_order_date, CAST(tq AS DOUBLE) AS total_quantity_tonnes, CAST(ta AS DOUBLE) AS total_amount FROM detail
UNION ALL SELECT 'TOTALS', NULL, NULL, '', '', '', '', NULL, CAST(ROUND(SUM(tq), 2) AS DOUBLE), CAST(SUM(ta) AS DOUBLE) FROM detail
UNION ALL SELECT 'Sales Today', NULL, NULL, '', '', '', '', NULL, CAST(NULL AS DOUBLE), CAST(amt AS DOUBLE) FROM ({_TODAY}) today
UNION ALL SELECT 'Sales Target Today', NULL, NULL, '', '', '', '', NULL, CAST(NULL AS DOUBLE), {_FIXED_TARGET}""")
def to_deliver_by_order(spark, sf_dir):
    v = ErpViews(spark, sf_dir)
    return S.to_deliver_by_order(v.sales_order, v.sales_order_item, v.sales_team, v.sales_invoice,
                                 v.company, v.customer, AS_OF, days=14)


_MONTH_DAYS = f"""month_days AS (
  SELECT posting_date, {msum('base_grand_total')} AS amt FROM "tabSales Invoice"
  WHERE docstatus = 1 AND posting_date BETWEEN {sql_date(_MSTART)} AND {sql_date(_MEND)}
  GROUP BY posting_date)"""


@register("target_tracker_active_days", f"""
WITH {_MONTH_DAYS},
run AS (
  SELECT posting_date, CAST(amt AS DOUBLE) AS sales_today,
         CAST(SUM(amt) OVER (ORDER BY posting_date) AS DOUBLE) AS cumulative_sales,
         COUNT(*) OVER (ORDER BY posting_date) * {_TARGET} AS sales_target_cumulative
  FROM month_days)
SELECT posting_date, sales_today, cumulative_sales, sales_target_cumulative,
       sales_target_cumulative - cumulative_sales AS cumulative_deficit,
       (sales_target_cumulative - cumulative_sales)
         / NULLIF(CAST(date_diff('day', posting_date, {sql_date(_MEND)}) AS INTEGER), 0) AS spread_per_day
FROM run ORDER BY posting_date""")
def target_tracker_active_days(spark, sf_dir):
    return S.target_tracker_active_days(ErpViews(spark, sf_dir).sales_invoice, AS_OF, MONTHLY_TARGET)


@register("target_tracker", f"""
WITH {_MONTH_DAYS},
days AS (
  SELECT CAST(d AS DATE) AS posting_date
  FROM generate_series(CAST({sql_date(_MSTART)} AS TIMESTAMP), CAST({sql_date(_MEND)} AS TIMESTAMP), INTERVAL 1 DAY) g(d)),
dense AS (
  SELECT days.posting_date, COALESCE(month_days.amt, 0) AS amt
  FROM days LEFT JOIN month_days ON days.posting_date = month_days.posting_date),
run AS (
  SELECT posting_date, CAST(amt AS DOUBLE) AS sales_today,
         CAST(SUM(amt) OVER (ORDER BY posting_date) AS DOUBLE) AS cumulative_sales,
         COUNT(*) OVER (ORDER BY posting_date) * {_TARGET} AS stc
  FROM dense),
today AS (SELECT stc - cumulative_sales AS deficit FROM run WHERE posting_date = {sql_date(AS_OF)})
SELECT run.posting_date, run.sales_today, run.cumulative_sales, run.stc - run.cumulative_sales AS cumulative_deficit,
       (run.stc - run.cumulative_sales)
         / GREATEST(CAST(date_diff('day', run.posting_date, {sql_date(_MEND)}) AS INTEGER), 1) AS spread_per_day,
       CASE WHEN run.posting_date >= {sql_date(AS_OF)}
            THEN {_TARGET} + today.deficit / NULLIF({(_MEND - AS_OF).days}, 0) END AS new_daily_sales_target
FROM run, today ORDER BY run.posting_date""")
def target_tracker(spark, sf_dir):
    return S.target_tracker(ErpViews(spark, sf_dir).sales_invoice, AS_OF, MONTHLY_TARGET)
