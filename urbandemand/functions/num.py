"""Number semantics that differ from SQL's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_HEX = r"^0[xX][0-9a-fA-F]+$"


def round_half_up(x: Column) -> Column:
    """To the nearest integer, halves toward positive infinity."""
    return F.floor(x + F.lit(0.5))


def number(text: Column) -> Column:
    """A tag's number: null unless the whole trimmed text is one; blank is 0."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    hexa = F.conv(F.substring(t, 3, 64), 16, 10).cast("double")
    return F.when(t == "", F.lit(0.0)).when(t.rlike(_NUMBER), t.try_cast("double")).when(t.rlike(_HEX), hexa)


def at_least_one(text: Column) -> Column:
    """A tag's number, or 1 where it is smaller or none."""
    return F.greatest(F.coalesce(number(text), F.lit(1.0)), F.lit(1.0))


def ratio(x: Column, total: Column) -> Column:
    """x / total; null where total is 0."""
    return F.try_divide(x.cast("double"), total.cast("double"))


def leading_number(text: Column) -> Column:
    """The number a text begins with, 0 where there is none."""
    found = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(found.try_cast("double"), F.lit(0.0))
