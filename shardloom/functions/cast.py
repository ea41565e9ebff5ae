"""Casts with MySQL's rules for texts. Invalid texts give NULL, or the zero value in `text` form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: MySQL's names of character sets and Python's codecs for them.
CHARSETS = {"gbk": "gbk", "gb18030": "gb18030", "latin2": "iso8859_2", "latin5": "iso8859_9", "greek": "iso8859_7", "hebrew": "iso8859_8", "latin7": "iso8859_13", "ascii": "latin_1", "latin1": "latin_1", "ucs2": "utf_16_be", "unicode": "utf_16_be", "utf8": "utf_8", "utf8mb4": "utf_8"}


def _decimal(x: Column) -> Column:
    return F.when(x.isNotNull(), F.coalesce(x.try_cast("decimal(38,10)"), F.lit(0).cast("decimal(38,10)")))


def signed(x: Column) -> Column:
    return _decimal(x).cast("bigint")


def unsigned(x: Column) -> Column:
    """As DECIMAL(20,0); negative numbers wrap around 2^64."""
    whole = F.when(_decimal(x) >= 0, F.floor(_decimal(x))).otherwise(F.ceil(_decimal(x))).cast("decimal(28,0)")
    return F.when(whole < 0, whole + F.lit("18446744073709551616").cast("decimal(28,0)")).otherwise(whole).cast("decimal(20,0)")


def decimal(x: Column, precision: int = 10, scale: int = 0) -> Column:
    if precision < scale:
        raise ValueError("precision below scale")
    return F.round(_decimal(x), scale).cast(f"decimal({precision},{scale})")


def char(x: Column, n: int | None = None) -> Column:
    return x.cast("string") if n is None or n < 0 else F.left(x.cast("string"), F.lit(n))


def charset(x: Column, name: str) -> Column:
    """The text's bytes in a character set; characters it lacks become `?`."""
    codec = CHARSETS[name.lower()]
    if codec == "utf_8":
        return F.encode(F.trim(x), "UTF-8")
    if codec == "utf_16_be":
        return F.encode(x, "UTF-16BE")

    return encoder(codec)(x)


def encoder(codec: str):
    @F.pandas_udf("binary")
    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else v.encode(codec, "replace"))

    return encode


def _year(y: Column) -> Column:
    """One or two digits: 0-69 are 20xx, 70-99 are 19xx; more digits as they stand."""
    n = y.try_cast("int")
    return F.when(F.length(y) > 2, n).when(n < 70, n + 2000).otherwise(n + 1900)


def _digits_date(d: Column) -> tuple[Column, Column, Column]:
    """5 to 8 digits: the last four are month and day, the rest is the year."""
    n = F.length(d)
    return _year(F.substring(d, F.lit(1), n - 4)), F.substring(d, n - 3, F.lit(2)).try_cast("int"), F.substring(d, n - 1, F.lit(2)).try_cast("int")


def _date(y: Column, m: Column, d: Column) -> Column:
    text = F.format_string("%04d-%02d-%02d", y, m, d)
    return F.when((y >= 100) & (y <= 9999) & (m >= 1) & (d >= 1), text.try_cast("date"))


def date(x: Column) -> Column:
    """`Y-M-D` with any punctuation between, or `[YY]YYMMDD`; NULL if invalid."""
    s = F.trim(x)
    plain = F.split(s, r"[^0-9]")
    parts = _date(_year(plain[0]), F.get(plain, F.lit(1)).try_cast("int"), F.get(plain, F.lit(2)).try_cast("int"))
    return F.when(s.rlike(r"^\d{5,8}$"), _date(*_digits_date(s))).when(s.rlike(r"^\d{1,4}[^0-9\s]\d{1,2}[^0-9\s]\d{1,2}$"), parts)


def date_text(x: Column) -> Column:
    return F.when(x.isNotNull(), F.coalesce(date(x).cast("string"), F.lit("0000-00-00")))


def datetime(x: Column) -> Column:
    """A date, a space or `T`, `h:m:s` with any punctuation, or 11 to 14 digits; a fraction from .5 on adds a second. A date alone is its midnight."""
    s = F.trim(x)
    m = lambda i: F.regexp_extract(s, r"^(\d{1,4}[^0-9\s]\d{1,2}[^0-9\s]\d{1,2})[ T]+(\d{1,2})[^0-9\s](\d{1,2})[^0-9\s](\d{1,2})(?:\.(\d*))?$", i)
    k = lambda i: F.regexp_extract(s, r"^(\d{11,14})(?:\.(\d*))?$", i)
    digits = k(1)
    n = F.length(digits)
    lone = s.rlike(r"^\d{11,14}(\.\d*)?$")
    day = F.when(lone, _date(*_digits_date(F.substring(digits, F.lit(1), n - 6)))).otherwise(date(m(1)))
    piece = lambda i, back: F.when(lone, F.substring(digits, n - back, F.lit(2)).try_cast("int")).otherwise(m(i).try_cast("int"))
    hour, minute, second = piece(2, 5), piece(3, 3), piece(4, 1)
    fraction = F.when(lone, k(2)).otherwise(m(5))
    up = F.when(F.substring(fraction, 1, 1) >= "5", 1).otherwise(0)
    valid = day.isNotNull() & (hour <= 23) & (minute <= 59) & (second <= 59)
    total = hour * 3600 + minute * 60 + second + up
    full = F.when(valid, day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), total.cast("decimal(18,6)")))
    return F.coalesce(full, date(s).cast("timestamp_ntz"))


def datetime_text(x: Column) -> Column:
    return F.when(x.isNotNull(), F.coalesce(F.date_format(datetime(x), "yyyy-MM-dd HH:mm:ss"), F.lit("0000-00-00 00:00:00")))


def time_text(x: Column) -> Column:
    """`[D ]hhh[:mm[:ss]]`, or `hhhmmss` digits, signed; rounds by the first fraction digit; beyond 838 hours 838:59:59; invalid 00:00:00."""
    s = F.trim(x)
    g = lambda i: F.regexp_extract(s, r"^(-?)(?:(\d+) +)?(\d{1,3})(?::(\d+))?(?::(\d+))?(?:\.(\d*))?$", i)
    k = lambda i: F.regexp_extract(s, r"^(-?)(\d{1,7})(?:\.(\d*))?$", i)
    zero = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    lone = s.rlike(r"^-?\d{1,7}(\.\d*)?$")
    d = F.lpad(k(2), 7, "0")
    hour = F.when(lone, F.substring(d, 1, 3).try_cast("int")).otherwise(zero(g(2)) * 24 + zero(g(3)))
    minute = F.when(lone, F.substring(d, 4, 2).try_cast("int")).otherwise(zero(g(4)))
    second = F.when(lone, F.substring(d, 6, 2).try_cast("int")).otherwise(zero(g(5)))
    up = F.when(F.substring(F.when(lone, k(3)).otherwise(g(6)), 1, 1) >= "5", 1).otherwise(0)
    sign = F.when(F.when(lone, k(1)).otherwise(g(1)) == "-", "-").otherwise("")
    fits = s.rlike(r"^-?(\d+ +)?\d{1,3}(:\d+){0,2}(\.\d*)?$|^-?\d{1,7}(\.\d*)?$") & (minute <= 59) & (second <= 59)
    total = hour * 3600 + minute * 60 + second + up
    total = F.least(total, F.lit(838 * 3600 + 59 * 60 + 59))
    shown = F.concat(sign, F.format_string("%02d:%02d:%02d", F.floor(total / 3600), F.floor(total / 60) % 60, total % 60))
    return F.when(s.isNotNull(), F.when(fits, shown).otherwise(F.lit("00:00:00")))
