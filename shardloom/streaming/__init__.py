"""Extension: Structured Streaming over `events` (the sharding model itself has no streams)."""

from .events import event_windows, sessions

__all__ = ["event_windows", "sessions"]
