"""Python workers outlive their tasks: what a task held is handed back when it ends."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


#: What modules remember between the tasks of a worker, by name.
memories: dict[str, dict] = {}


def forget(but: str = "") -> None:
    """Drop what other kinds of work remember; the same work goes on with what it has."""
    for name, memory in memories.items():
        if name != but:
            memory.clear()


def release() -> None:
    """Give unused memory back to the system, as far as the platform can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], remembers: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, a task over Arrow batches, that starts without what other work remembers (but for the memory it ``remembers``) and
    releases its own at the end, however it ends."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(remembers)
        try:
            yield from work(batches)
        finally:
            release()

    return run
