"""The reports of one set of tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators.anchor import as_of
from daybook.plans import reports
from daybook.schemas import MONTHLY_TARGET
from daybook.sinks.json_rows import charts_object, first_object, json_rows, write_array
from daybook.sources.stored import newest_month, read_sales

Date = dt.date | str | None


@dataclass(frozen=True)
class Dashboard:
    """Reports as of a ``date`` or the last order of a ``month`` (``YYYY-MM``);
    with neither, as of the latest order.

    ``sales`` are cleaned orders, a stored fact, or a (stored) rollup.
    """
    sales: DataFrame
    users: DataFrame | None = None
    products: DataFrame | None = None
    destinations: DataFrame | None = None
    #: The month of the latest order, where it is known without reading sales.
    newest: dt.date | None = None
    #: Rollups that the leaderboard and the destinations read instead of ``sales``.
    by_creator: DataFrame | None = None
    by_product: DataFrame | None = None

    @classmethod
    def rolled_up(cls, spark: SparkSession, folder: str, *tables: DataFrame) -> Dashboard:
        """Over the stored rollups in ``folder`` (see ``book.write_rollups``)."""
        users, products, destinations = (*tables, None, None, None)[:3]
        days, creators, sold = (read_sales(spark, f"{folder}/{name}") for name in ("days", "creators", "products"))
        return cls(days, users, products, destinations, newest_month(spark, f"{folder}/days"), creators, sold)

    @classmethod
    def stored(cls, spark: SparkSession, path: str, *tables: DataFrame) -> Dashboard:
        """Over the stored fact or rollup at ``path`` as it is now: its newest month comes
        from the folder's listing, so the latest day is found in that month alone."""
        users, products, destinations = (*tables, None, None, None)[:3]
        return cls(read_sales(spark, path), users, products, destinations, newest_month(spark, path))

    def today(self, date: Date = None, month: str | None = None) -> Column:
        return as_of(self.sales, date, month, self.newest)

    def summary(self, date: Date = None, month: str | None = None) -> DataFrame:
        return reports.summary(self.sales, self.today(date, month))

    def leaderboard(self, date: Date = None, month: str | None = None,
                    target: int = MONTHLY_TARGET) -> DataFrame:
        sales = self.sales if self.by_creator is None else self.by_creator
        return reports.leaderboard(sales, self.users, self.today(date, month), target)

    def top_destinations(self, date: Date = None, month: str | None = None,
                         limit: int | None = reports.TOP_DESTINATIONS) -> DataFrame:
        sales = self.sales if self.by_product is None else self.by_product
        return reports.top_destinations(
            sales, self.products, self.destinations, self.today(date, month), limit)

    def daily(self, date: Date = None, month: str | None = None) -> DataFrame:
        return reports.daily_trend(self.sales, self.today(date, month))

    def monthly(self, date: Date = None, month: str | None = None) -> DataFrame:
        return reports.monthly_trend(self.sales, self.today(date, month))

    def summary_json(self, date: Date = None, month: str | None = None) -> DataFrame:
        return first_object(self.summary(date, month))

    def leaderboard_json(self, date: Date = None, month: str | None = None) -> DataFrame:
        return json_rows(self.leaderboard(date, month))

    def write_leaderboard(self, path: str, date: Date = None, month: str | None = None) -> None:
        """The leaderboard as one JSON array of any length (see ``write_array``)."""
        write_array(self.leaderboard(date, month), path, [F.col("rank")])

    def destinations_json(self, date: Date = None, month: str | None = None) -> DataFrame:
        return json_rows(self.top_destinations(date, month))

    def charts_json(self, date: Date = None, month: str | None = None) -> DataFrame:
        return charts_object(self.daily(date, month), self.monthly(date, month))
