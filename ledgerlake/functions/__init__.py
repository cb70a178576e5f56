"""Column -> Column helpers.  Everything here is a built-in Spark expression
(no UDF), so it stays inside whole-stage codegen."""

from ledgerlake.functions.dates import (  # noqa: F401
    date_in_period,
    days_in_month,
    last_n_days,
    month_end,
    month_start,
    week_sunday,
)
from ledgerlake.functions.erp import (  # noqa: F401
    TRUCKLOAD_RULES,
    add_item_tax,
    cap_to_truckload,
    first_non_blank,
    pay_category,
    safe_table_name,
    tax_per_unit,
    to_base_currency,
)
from ledgerlake.functions.money import (  # noqa: F401
    MONEY,
    as_double,
    exact_sum,
    money,
    money_round,
    money_sum,
    safe_divide,
)
from ledgerlake.functions.text import CASE_INSENSITIVE, binary_text, collated  # noqa: F401
