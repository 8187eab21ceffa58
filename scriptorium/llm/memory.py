"""Memory of Python workers, which live on between tasks: what a task has freed goes back to the system at its end."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: What a worker keeps from task to task, by name, and how it is let go.
kept: dict[str, Callable[[], None]] = {}


def trimmed(work: Callable[[Iterator], Iterator], keeps: str = "") -> Callable[[Iterator], Iterator]:
    """A mapInArrow function that releases memory when its task ends, and lets go at its start what only other tasks use."""

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        for name, let_go in kept.items():
            if name != keeps:
                let_go()
        try:
            yield from work(batches)
        finally:
            release()

    return run
