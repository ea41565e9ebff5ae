"""Window functions over `partition` ordered by `order`; ranks count as BIGINT."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def over(partition: list, order: list):
    return Window.partitionBy(*partition).orderBy(*order)


def row_number(w) -> Column:
    return F.row_number().over(w).cast("bigint")


def rank(w) -> Column:
    return F.rank().over(w).cast("bigint")


def dense_rank(w) -> Column:
    return F.dense_rank().over(w).cast("bigint")


def percent_rank(w) -> Column:
    return F.percent_rank().over(w)


def cume_dist(w) -> Column:
    return F.cume_dist().over(w)


def ntile(n: int, w) -> Column:
    return F.ntile(n).over(w).cast("bigint")


def lag(x, n: int, w) -> Column:
    return F.lag(x, n).over(w)


def lead(x, n: int, w) -> Column:
    return F.lead(x, n).over(w)


def first_value(x, w) -> Column:
    return F.first_value(x).over(w)


def last_value(x, w) -> Column:
    """With the default frame: the value of the current row's last peer."""
    return F.last_value(x).over(w)


def nth_value(x, n: int, w) -> Column:
    return F.nth_value(x, n).over(w)
