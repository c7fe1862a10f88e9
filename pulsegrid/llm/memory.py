"""Python workers give back what a task has used, so that idle ones stay small beside the JVM."""

from __future__ import annotations

import ctypes


def release_memory() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps its own rules
        pass


def released(work):
    """``work`` on batches of a task; when the task ends, its memory goes back to the system."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            release_memory()

    return run
