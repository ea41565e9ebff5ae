"""Column expressions and size-checked joins for the operators that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Whatever stands between words, before lower-casing.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of a side that may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def cased_words(text: Column) -> Column:
    """Runs of letters, digits and characters beyond ASCII, cased as they stand; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _BETWEEN), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the lower-cased text."""
    return cased_words(ascii_lower(text))


def loose_hashes(cased: Column) -> Column:
    """A hash of each word that is equal for words equal but for A-Z's case (and for some others: verify)."""
    return F.transform(cased, lambda w: F.xxhash64(F.lower(w)))


def grams(hashes: Column, k: int) -> Column:
    """Hashes of all runs of k; none if there are fewer than k."""
    if k == 1:
        return hashes
    n = F.size(hashes)
    rolled = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))
    return F.when(n >= k, rolled).otherwise(F.array().cast("array<bigint>"))


def fence(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once a row, whatever is built on it.

    Catalyst merges neighbouring projections and would compute an array again
    for each use, within a lambda for each element; it merges nothing into a
    generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with `right` broadcast if a count shows it to be within BROADCAST_ROWS, else by a shuffle."""
    small = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return left.join(F.broadcast(right) if small else right, on, how)
