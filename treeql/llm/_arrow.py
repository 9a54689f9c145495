"""Texts in Arrow batches, for the operators that read them in Python."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

from treeql.llm._common import runs


def text_runs(texts: pa.Array, most: int) -> Iterator[tuple[int, list[str | None]]]:
    """(index of the first, texts) of consecutive runs of about `most` bytes, so that a batch is never held as Python strings as a whole."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for a, b in runs(sizes, most):
        yield a, texts.slice(a, b - a).to_pylist()


def release() -> None:
    """Give freed memory back to the system: a Python worker stays, idle, while other stages need the room."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
