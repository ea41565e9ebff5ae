"""From statement text to DataFrames."""

from .engine import Engine, FullScanDenied, Prepared

__all__ = ["Engine", "FullScanDenied", "Prepared"]
