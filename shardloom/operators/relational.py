"""Joins by a chosen physical strategy; all else is said in SQL or with DataFrame methods.

Semantics are those of the unsharded logical table: joins keep every match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

JOINS = {"inner", "left", "right", "cross", "full", "left_semi", "left_anti"}


def join(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner", strategy: str | None = None) -> DataFrame:
    """`strategy`: a Spark join hint (merge, shuffle_hash, …) for `right`; broadcasts are left to measured sizes."""
    if how not in JOINS:
        raise ValueError(f"unknown join type {how}")
    if strategy:
        right = right.hint(strategy)
    return left.crossJoin(right) if how == "cross" else left.join(right, on, how)
