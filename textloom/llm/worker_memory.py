"""Memory of Python workers, which stay for later tasks and other queries."""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Callable, Iterator

import pyarrow as pa


@functools.cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):  # not glibc
        return None


def give_back() -> None:
    """Returns what was freed to the system: allocators keep it otherwise, each worker as much as its largest task took."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def gives_back(run: Callable) -> Callable:
    """`run`, a function of Python workers or a generator, that calls give_back() when it ends."""
    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def rows(*args) -> Iterator:
            try:
                yield from run(*args)
            finally:
                give_back()

        rows.__signature__ = inspect.signature(run)  # which Spark counts the arguments of
        return rows

    @functools.wraps(run)
    def whole(*args):
        try:
            return run(*args)
        finally:
            give_back()

    whole.__signature__ = inspect.signature(run)
    return whole
