"""daybook: sales reports over an order book, as plain PySpark DataFrames.

Text files are loaded with explicit schemas, order dates written in mixed
formats are cleaned once into a month-partitioned fact, and as-of-date reports
are declared over that fact (or over its daily rollup) with built-in functions.
"""

from daybook.plans.dashboard import Dashboard

__all__ = ["Dashboard"]
