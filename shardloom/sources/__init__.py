"""Sharded Parquet layouts."""

from .layout import ensure_functions, read_table, storage_root, with_shards, write_table

__all__ = ["ensure_functions", "read_table", "storage_root", "with_shards", "write_table"]
