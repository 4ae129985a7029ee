"""Models that a user plugs in: made once in a Python worker and kept for its later tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark import cloudpickle


def worker_model(factory: Callable[[], Callable], key: str) -> Callable[[], Callable]:
    """A function that, in a Python worker, gives ``factory()``'s model, made at its first call there.

    Models are kept in a module of the worker process by ``key`` and a digest of the factory, so two
    plug-ins under one key do not meet.
    """
    name = f"{key}-{hashlib.sha1(cloudpickle.dumps(factory)).hexdigest()}"

    def get() -> Callable:
        import sys
        import types
        kept = sys.modules.setdefault("mentionkit_worker_models", types.ModuleType("mentionkit_worker_models")).__dict__
        if name not in kept:
            kept[name] = factory()
        return kept[name]

    return get
