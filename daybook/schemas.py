"""The four tables: column order, types, text lengths, keys and header names."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import types as T

INT = T.IntegerType()
LONG = T.LongType()
TEXT = T.StringType()
MONEY = T.DecimalType(10, 2)

#: Amounts are summed at this type, so that totals do not depend on task order.
AMOUNT = T.DecimalType(18, 2)
#: What Spark makes of ``sum`` over ``AMOUNT``; every reported total has it.
TOTAL = T.DecimalType(28, 2)


@dataclass(frozen=True)
class Field:
    name: str
    type: T.DataType
    #: Longest text accepted, ``None`` for unbounded text and for other types.
    length: int | None = None


@dataclass(frozen=True)
class Table:
    name: str
    fields: tuple[Field, ...]
    key: str

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type) for f in self.fields])

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(f"{self.name} has no column {name}")

    def resolve(self, header: Iterable[str]) -> list[str]:
        """Canonical column names for a file's header, in the file's order."""
        resolved = [snake_case(h) for h in header]
        unknown = [h for h, r in zip(header, resolved) if r not in self.names]
        if unknown:
            raise ValueError(f"{self.name}: unknown columns in header: {unknown}")
        repeated = sorted({r for r in resolved if resolved.count(r) > 1})
        if repeated:
            raise ValueError(f"{self.name}: repeated columns in header: {repeated}")
        if self.key not in resolved:
            raise ValueError(f"{self.name}: header lacks the key {self.key}")
        return resolved

    def widen(self, **changes: T.DataType | int | None) -> Table:
        """The table with columns of a wider type or a longer text.

        A number sets a text column's length (``None`` lifts the limit); a type
        replaces the type. Narrowing is refused: stored rows might not fit.
        """
        fields = list(self.fields)
        for name, change in changes.items():
            old = self.field(name)
            if isinstance(change, T.DataType):
                if not _holds(change, old.type):
                    raise ValueError(f"{self.name}.{name}: {change.simpleString()} is narrower "
                                     f"than {old.type.simpleString()}")
                new = replace(old, type=change, length=None)
            else:
                if old.type != TEXT:
                    raise ValueError(f"{self.name}.{name} is not text")
                if change is not None and (old.length is None or change < old.length):
                    raise ValueError(f"{self.name}.{name}: length {change} is shorter than {old.length}")
                new = replace(old, length=change)
            fields[fields.index(old)] = new
        return replace(self, fields=tuple(fields))


def snake_case(header: str) -> str:
    """``coverageDestinations`` and ``coverage_destinations`` name one column."""
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", header.strip()).lower()


def _holds(new: T.DataType, old: T.DataType) -> bool:
    """Whether every value of ``old`` is also a value of ``new``."""
    if new == old or new == TEXT:
        return True
    whole_digits = {T.ByteType(): 3, T.ShortType(): 5, INT: 10, LONG: 19}
    order = list(whole_digits)
    if new in order and old in order:
        return order.index(new) > order.index(old)
    if isinstance(new, T.DecimalType):
        if old in whole_digits:
            return new.precision - new.scale >= whole_digits[old]
        if isinstance(old, T.DecimalType):
            return (new.scale >= old.scale
                    and new.precision - new.scale >= old.precision - old.scale)
    return False


# The columns, types and text lengths of the data model. The order
# number is widened to 64 bits; 32 bits end at two billion orders.

USERS = Table("users", (
    Field("user_id", INT),
    Field("name", TEXT, 100),
    Field("country_code", TEXT, 10),
    Field("mobile", TEXT, 20),
    Field("user_role", INT),
    Field("created_datetime", TEXT, 30),
), key="user_id")

PRODUCTS = Table("products", (
    Field("prod_id", INT),
    Field("add_on_id", TEXT, 100),
    Field("data_limit", INT),
    Field("sim_mode", INT),
    Field("fup_limit", INT),
    Field("operator_id", INT),
    Field("additional_note", TEXT),
    Field("amount", MONEY),
    Field("product_name", TEXT),
    Field("post_fup_speed", INT),
    Field("validity", INT),
    Field("coverage_destinations", TEXT),
    Field("allocated_destinations", TEXT),
), key="prod_id")

DESTINATIONS = Table("destinations", (
    Field("destination_id", TEXT, 20),
    Field("destination_type", INT),
    Field("destination_name", TEXT, 200),
    Field("flag_path", TEXT),
    Field("included_destinations", TEXT),
    Field("is_active", INT),
), key="destination_id")

ORDERS = Table("orders", (
    Field("order_no", LONG),
    Field("order_date_time", TEXT),
    Field("user_id", INT),
    Field("product_id", INT),
    Field("amount", MONEY),
    Field("discount_amount", MONEY),
    Field("created_by", INT),
), key="order_no")

TABLES = {t.name: t for t in (USERS, PRODUCTS, DESTINATIONS, ORDERS)}

#: ``users.user_role`` of a sales representative; 1 is a customer.
SALES_REP = 2
#: Orders a representative is asked to bring in per month.
MONTHLY_TARGET = 125
