"""Memory of reused Python workers, given back when a task's rows are done."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

from strandloom.llm import words

Rows = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Returns what this process has freed to the machine."""
    words.forget_powers()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # absent outside glibc
    if trim is not None:
        trim(0)


def given_back(run: Callable[[Rows], Rows]) -> Callable[[Rows], Rows]:
    """``run``, after which the worker returns its freed memory to the machine.

    A worker serves many tasks of many stages, and the allocators below Python keep what one of
    them needed at its peak; on a shared executor the next stage would find less room.
    """
    @functools.wraps(run)
    def wrapped(batches: Rows) -> Rows:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
