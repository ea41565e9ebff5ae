"""String functions, by characters unless said otherwise. NULL gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = ("KiB", "MiB", "GiB", "TiB", "PiB", "EiB", "ZiB", "YiB")


def _count(n: Column) -> Column:
    """A length argument: truncated; a text that is no number is 0."""
    return F.when(n.isNotNull(), F.coalesce(n.try_cast("double"), F.lit(0.0)).cast("int"))


def concat(*parts: Column) -> Column:
    return F.concat(*[p.cast("string") for p in parts])


def concat_ws(sep: Column, *parts: Column) -> Column:
    """NULL parts are passed over; a NULL separator gives NULL."""
    kept = F.array_compact(F.array(*[p.cast("string") for p in parts]))
    return F.when(sep.isNotNull(), F.call_function("concat_ws", sep, kept))


def char_length(x: Column) -> Column:
    return F.char_length(x)


def length(x: Column) -> Column:
    """Bytes."""
    return F.octet_length(x)


def left(x: Column, n: Column) -> Column:
    return F.left(x.cast("string"), F.greatest(_count(n), F.lit(0)))


def right(x: Column, n: Column) -> Column:
    return F.right(x.cast("string"), F.greatest(_count(n), F.lit(0)))


def substring(x: Column, pos: Column, n: Column | None = None) -> Column:
    """From `pos` (from the end if negative); '' if `pos` is 0 or beyond the text."""
    x = x.cast("string")
    p = _count(pos)
    out = F.substring(x, p, F.char_length(x)) if n is None else F.substring(x, p, F.greatest(_count(n), F.lit(0)))
    return F.when((p == 0) | (F.abs(p) > F.char_length(x)), F.when(x.isNotNull(), F.lit(""))).otherwise(out)


def lpad(x: Column, n: Column, pad: Column) -> Column:
    """A negative length gives NULL; an empty pad cannot lengthen."""
    x, k, pad = x.cast("string"), _count(n), pad.cast("string")
    short = (F.char_length(pad) == 0) & (F.char_length(x) < k)
    return F.when(k >= 0, F.when(short, F.lit("")).otherwise(F.lpad(x, k, pad)))


def rpad(x: Column, n: Column, pad: Column) -> Column:
    """A negative length gives NULL; an empty pad gives ''."""
    x, k, pad = x.cast("string"), _count(n), pad.cast("string")
    return F.when(k >= 0, F.when((F.char_length(pad) == 0) & x.isNotNull(), F.lit("")).otherwise(F.rpad(x, k, pad)))


def ltrim(x: Column) -> Column:
    return F.ltrim(x)


def rtrim(x: Column) -> Column:
    return F.rtrim(x)


def upper(x: Column) -> Column:
    return F.upper(x)


def lower(x: Column) -> Column:
    return F.lower(x)


def repeat(x: Column, n: Column) -> Column:
    return F.repeat(x, F.greatest(_count(n), F.lit(0)))


def replace(x: Column, old: Column, new: Column) -> Column:
    return F.replace(x, old, new)


def reverse(x: Column) -> Column:
    return F.reverse(x.cast("string"))


def space(n: Column) -> Column:
    return F.repeat(F.lit(" "), F.greatest(_count(n), F.lit(0)))


def strcmp(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(a < b, -1).when(a > b, 1).otherwise(0).cast("int")


def md5(x: Column) -> Column:
    return F.md5(x.cast("string").cast("binary"))


def sha1(x: Column) -> Column:
    return F.sha1(x.cast("string").cast("binary"))


def format_bytes(x: Column, largest: str = "YiB") -> Column:
    """`N bytes` below 1024, else two digits of the largest fitting unit, none above `largest`."""
    v = x.cast("double")
    units = _UNITS[: _UNITS.index(largest) + 1]
    out = F.when(F.abs(v) < 1024, F.concat(v.cast("bigint").cast("string"), F.lit(" bytes")))
    for i, unit in enumerate(units):
        scaled = v / F.lit(1024.0 ** (i + 1))
        fits = F.abs(v) < 1024.0 ** (i + 2) if i < len(units) - 1 else F.lit(True)
        out = out.when(fits, F.concat(F.replace(F.format_number(scaled, 2), F.lit(","), F.lit("")), F.lit(f" {unit}")))
    return F.when(v.isNotNull(), out)
