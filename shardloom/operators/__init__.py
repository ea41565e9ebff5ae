"""Relational operators as functions from DataFrames to DataFrames."""

from .relational import join

__all__ = ["join"]
