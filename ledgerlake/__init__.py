"""ledgerlake: ERP extract, integrity checks and sales/finance reports as
Spark DataFrame operators.  See README.md for the layout and design."""
