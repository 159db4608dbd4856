"""What a Python worker gives back at the end of a partition or a batch."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def give_back() -> None:
    """Return freed memory to the system: workers live on, beside the executor's heap, and the next stage's may need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of a partition's batches, that gives memory back when it has read them all."""

    @wraps(run)
    def made(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return made
