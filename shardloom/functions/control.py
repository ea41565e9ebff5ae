"""IF, IFNULL, CASE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truth(c: Column, numeric: bool = False) -> Column:
    return c != 0 if numeric else c


def if_(c: Column, yes: Column, no: Column, numeric: bool = False) -> Column:
    """NULL and 0 choose `no`; a NULL `yes` is returned as it is."""
    return F.when(truth(c, numeric), yes).otherwise(no)


def ifnull(a: Column, b: Column) -> Column:
    return F.coalesce(a, b)


def case_when(*pairs: tuple[Column, Column], otherwise: Column | None = None) -> Column:
    out = F.when(*pairs[0])
    for cond, value in pairs[1:]:
        out = out.when(cond, value)
    return out if otherwise is None else out.otherwise(otherwise)


def case_of(x: Column, *pairs: tuple[Column, Column], otherwise: Column | None = None) -> Column:
    return case_when(*[(x == v, out) for v, out in pairs], otherwise=otherwise)
