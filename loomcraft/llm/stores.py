"""What a Python worker keeps from task to task.

A worker outlives the stages it works for. It keeps one thing at a time, an encoder with the words it has met or the scores of
words: asking for another lets go of what was there, so that a job of many stages needs no more memory than its largest.

What a slice of a batch needed and is free again stays with the allocators of C and of Arrow, several hundred MB a worker, while
the executor goes on with other stages; ``give_back`` hands it to the system."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa

_Kept = TypeVar("_Kept")


def kept(name: str, make: Callable[[], _Kept]) -> _Kept:
    """What this worker keeps under ``name``; made anew, and all else dropped, if that isn't there."""
    store = sys.modules.setdefault("_loomcraft_kept", types.ModuleType("_loomcraft_kept"))
    if getattr(store, "name", None) != name:
        store.held = None
        store.held, store.name = make(), name
    return store.held


def drop_kept() -> None:
    """Let go of what this worker keeps, for tasks that need memory for something else."""
    store = sys.modules.get("_loomcraft_kept")
    if store is not None and store.held is not None:
        store.held = store.name = None
        give_back()


def give_back() -> None:
    """Free memory goes from the allocators of this worker to the system. Other than glibc's keep theirs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
