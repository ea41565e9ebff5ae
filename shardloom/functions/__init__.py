"""Functions with MySQL's results, as Column expressions and as session SQL functions."""

from . import cast, control, maths, strings, window
from .sqlfunctions import register

__all__ = ["cast", "control", "maths", "register", "strings", "window"]
