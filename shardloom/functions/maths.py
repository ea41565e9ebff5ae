"""Math functions; texts count as their number, or 0 if they are none. NULL gives NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What PI() shows: six digits.
PI_SHOWN = 3.141593


def number(x: Column) -> Column:
    """A text as a double; what is no number is 0."""
    return F.when(x.isNotNull(), F.coalesce(x.try_cast("double"), F.lit(0.0)))


def abs_(x: Column) -> Column:
    return F.abs(number(x))


def ceil(x: Column) -> Column:
    return F.ceil(number(x))


def floor(x: Column) -> Column:
    return F.floor(number(x))


def round_(x: Column, d: int = 0) -> Column:
    return F.round(number(x).cast("decimal(38,15)"), d).cast("double")


def round_floor(x: Column, d: int = 0) -> Column:
    """Half always up: floor(x 10^d + 0.5) / 10^d."""
    return F.floor(number(x) * 10.0**d + 0.5) / F.lit(10.0**d)


def truncate(x: Column, d: int) -> Column:
    scaled = F.abs(number(x)).cast("decimal(38,15)").cast("double") * 10.0**d
    return F.signum(number(x)) * F.floor(F.round(scaled, 9)) / F.lit(10.0**d)


def mod(x: Column, y: Column) -> Column:
    return F.try_mod(x, y)


def mod_text(x: Column, y: Column) -> Column:
    """Of anything, through decimals; a zero divisor gives NULL."""
    dec = lambda c: F.when(c.isNotNull(), F.coalesce(c.try_cast("decimal(38,10)"), F.lit(0).cast("decimal(38,10)")))
    return F.try_mod(dec(x), dec(y)).cast("double")


def power(x: Column, y: Column) -> Column:
    got = F.pow(number(x), number(y))
    return F.when(F.abs(got) == math.inf, F.raise_error(F.lit("DOUBLE value is out of range"))).otherwise(got)


def sqrt(x: Column) -> Column:
    return F.when(number(x) >= 0, F.sqrt(number(x)))


def asin(x: Column) -> Column:
    return F.when(F.abs(number(x)) <= 1, F.asin(number(x)))


def acos(x: Column) -> Column:
    return F.when(F.abs(number(x)) <= 1, F.acos(number(x)))


def exp(x: Column) -> Column:
    return F.exp(number(x))


def sin(x: Column) -> Column:
    return F.sin(number(x))


def cos(x: Column) -> Column:
    return F.cos(number(x))


def tan(x: Column) -> Column:
    return F.tan(number(x))


def pi(shown: bool = True) -> Column:
    return F.lit(PI_SHOWN) if shown else F.pi()


def rand(seed: int | None = None) -> Column:
    return F.rand() if seed is None else F.rand(seed)


def int_div(x: Column, y: Column) -> Column:
    """DIV: truncates; a zero divisor gives NULL."""
    return F.try_divide(x.cast("decimal(38,10)"), y.cast("decimal(38,10)")).cast("bigint")
