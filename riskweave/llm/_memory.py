"""Memory of a task's Python process. Spark reuses the processes, so what one task leaves behind adds to what the next one takes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

Batches = Iterator[pa.RecordBatch]


def release() -> None:
    """Gives freed memory back to the system: Arrow's pool, and the C library's heap where it can be trimmed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, for mapInArrow, releasing memory when its task ends."""

    def whole(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            release()

    return whole
