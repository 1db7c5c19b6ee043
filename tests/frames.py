"""Small tables for tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from daybook import Dashboard

SALES = ("order_no long, order_date date, user_id int, product_id int, amount decimal(10,2), "
         "discount_amount decimal(10,2), created_by int")
USERS = "user_id int, name string, user_role int"
PRODUCTS = "prod_id int, coverage_destinations string"
DESTINATIONS = "destination_id string, destination_name string, is_active int"


def date(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def sales(spark, *orders):
    """Orders given as (date, amount, creator, product); trailing parts may be left out."""
    rows = []
    for number, order in enumerate(orders, 1):
        day, amount, creator, product = (*order, None, None, None)[:4]
        rows.append((number, day and date(day), None, product,
                     None if amount is None else Decimal(str(amount)), None, creator))
    return spark.createDataFrame(rows, SALES)


def users(spark, *rows):
    return spark.createDataFrame(list(rows), USERS)


def dashboard(spark, orders, people=(), products=(), destinations=()) -> Dashboard:
    return Dashboard(
        orders,
        users(spark, *people),
        spark.createDataFrame(list(products), PRODUCTS),
        spark.createDataFrame([(*d, 1)[:3] for d in destinations], DESTINATIONS))


def rows(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]
