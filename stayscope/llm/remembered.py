"""What a Python worker remembers between its tasks."""

from __future__ import annotations

import gc
from collections.abc import Callable

_held: dict[str, object] = {}


def remembered(name: str, make: Callable[[], object]) -> object:
    """The value of that name, made when a worker first needs it and kept for its later tasks.

    Workers serve the steps of a job one after another. What an earlier step remembered (ids of
    words, up to hundreds of megabytes) is released when a step with another name begins, so a
    worker never holds the memory of two.
    """
    if name not in _held:
        if _held:
            _held.clear()
            # Encoders refer to themselves, so only the collector frees them.
            gc.collect()
        _held[name] = make()
    return _held[name]
