"""Memory of a Python worker that outlives one task: tokenizers and tables are loaded, and caches kept, once per worker."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable
from typing import Any

import pyarrow as pa


def remembered(name: str, make: Callable[[], Any]) -> Any:
    """The worker's object of that name, made on first use. Functions travel by value, so their own module's variables start anew in each task."""
    memory = sys.modules.setdefault("siftlane_worker_memory", types.ModuleType("siftlane_worker_memory")).__dict__
    if name not in memory:
        memory[name] = make()
    return memory[name]


def release() -> None:
    """Give freed memory back to the system: idle workers keep what they took, beside the executor's own."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
