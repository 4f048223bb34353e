"""Memory of Python workers, which live on from stage to stage."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Return to the system what this worker has freed: else what an earlier stage used counts against a later one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return
