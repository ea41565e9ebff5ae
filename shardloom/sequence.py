"""Sequences: snowflake ids and blocks from a stored counter."""

from __future__ import annotations

import fcntl
import json
import threading
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds, from the id layout's definition: 41 bits of time since this epoch, 10 of worker, 12 of step.
EPOCH_MS = 1533429240000
WORKER_BITS, STEP_BITS = 10, 12


class SequenceError(LookupError):
    pass


class Snowflake:
    def __init__(self, worker: int = 0, clock: Callable[[], int] | None = None):
        if not 0 <= worker < 1 << WORKER_BITS:
            raise ValueError("worker out of range")
        self.worker, self.clock = worker, clock or (lambda: time.time_ns() // 1_000_000)
        self.last, self.step, self.current = -1, 0, None
        self.lock = threading.Lock()

    def next(self) -> int:
        with self.lock:
            now = max(self.clock(), self.last)
            if now == self.last:
                self.step += 1
                if self.step >> STEP_BITS:  # this millisecond is used up
                    now, self.step = self.last + 1, 0
            else:
                self.step = 0
            self.last = now
            self.current = (now - EPOCH_MS) << (WORKER_BITS + STEP_BITS) | self.worker << STEP_BITS | self.step
            return self.current

    def block(self, n: int) -> list[int]:
        return [self.next() for _ in range(n)]

    def reserve(self, n: int) -> tuple[Callable[[Column], Column], int]:
        """n ids at once: a Column expression that makes the i-th (from 0), and the last one."""
        with self.lock:
            now, step = max(self.clock(), self.last), 0
            if now == self.last:
                step = self.step + 1
            end = step + n - 1
            self.last, self.step = now + (end >> STEP_BITS), end & (1 << STEP_BITS) - 1
            self.current = (self.last - EPOCH_MS) << (WORKER_BITS + STEP_BITS) | self.worker << STEP_BITS | self.step

            def make(i: Column) -> Column:
                k = i + F.lit(step)
                ms = F.lit(now - EPOCH_MS) + F.shiftright(k, STEP_BITS)
                return F.shiftleft(ms, WORKER_BITS + STEP_BITS) + F.lit(self.worker << STEP_BITS) + k.bitwiseAND(F.lit((1 << STEP_BITS) - 1))

            return make, self.current


class Group:
    """Blocks of `step` numbers from a counter kept in a JSON file (or in memory)."""

    def __init__(self, name: str, step: int = 10_000, path: str | None = None):
        self.name, self.step, self.path = name, step, Path(path) if path else None
        self.at = self.end = 0
        self.current: int | None = None
        self.lock = threading.Lock()
        self.stored = 0

    def _advance(self, n: int) -> int:
        """The stored counter, which moves on by n; a lock file keeps two drivers from taking the same numbers."""
        if not self.path:
            self.stored += n
            return self.stored - n
        with open(self.path.with_suffix(".lock"), "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            kept = json.loads(self.path.read_text()) if self.path.exists() else {}
            at = kept.get(self.name, 0)
            kept[self.name] = at + n
            temp = self.path.with_suffix(".tmp")
            temp.write_text(json.dumps(kept))
            temp.replace(self.path)
        return at

    def _take_block(self) -> None:
        self.at = self._advance(self.step)
        self.end = self.at + self.step

    def next(self) -> int:
        with self.lock:
            if self.at >= self.end:
                self._take_block()
            self.at += 1
            self.current = self.at
            return self.current

    def block(self, n: int) -> list[int]:
        return [self.next() for _ in range(n)]

    def reserve(self, n: int) -> tuple[Callable[[Column], Column], int]:
        """n numbers in a row, taken from the counter at once: a Column expression that makes the i-th (from 0), and the last one."""
        with self.lock:
            first = self._advance(n) + 1
            self.current = first + n - 1
            return (lambda i: i + F.lit(first)), self.current


class Sequences:
    """Kinds by name, and the sequences created of them."""

    def __init__(self) -> None:
        self.kinds: dict[str, Callable[..., Snowflake | Group]] = {"snowflake": lambda name, **o: Snowflake(**o), "group": lambda name, **o: Group(name, **o)}
        self.made: dict[str, tuple[str, Snowflake | Group]] = {}

    def register(self, kind: str, make: Callable[..., Snowflake | Group]) -> None:
        self.kinds[kind] = make

    def create(self, name: str, kind: str, **options):
        if kind not in self.kinds:
            raise SequenceError(f"unknown kind of sequence: {kind}")
        self.made[name.lower()] = (kind, self.kinds[kind](name, **options))
        return self.made[name.lower()][1]

    def get(self, name: str):
        if name.lower() not in self.made:
            raise SequenceError(f"no sequence {name}")
        return self.made[name.lower()][1]

    def next_value(self, name: str) -> int:
        return self.get(name).next()

    def current_value(self, name: str) -> int:
        got = self.get(name).current
        if got is None:
            raise SequenceError(f"sequence {name} has given no value yet")
        return got
