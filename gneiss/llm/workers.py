"""Memory of Python workers: Spark keeps idle ones, and what they hold counts as their executor's."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa


def give_back() -> None:
    """Return what a worker has freed to the system; Arrow's pool and the C library keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
