"""Providers that are loaded once in each worker process.

A model is not shipped with a plan: what travels is a factory, and the first
batch of a worker process calls it. Later batches, tasks and queries of that
process use what it gave. At most KEPT models stay loaded.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections import OrderedDict
from collections.abc import Callable

KEPT = 4


def _loaded() -> OrderedDict[str, Callable]:
    """The process's models. A reused worker imports this module anew for each task, so they are kept beside it."""
    place = sys.modules.setdefault("specweave_worker_state", types.ModuleType("specweave_worker_state"))
    return place.__dict__.setdefault("models", OrderedDict())


class Once:
    """A provider made by ``factory`` when a process first calls it.

    ``name`` tells models apart; plans that give the same name share one model.
    """

    def __init__(self, factory: Callable[[], Callable], name: str | None = None):
        self.factory, self.name = factory, name or uuid.uuid4().hex

    def __call__(self, *args):
        loaded = _loaded()
        if self.name not in loaded:
            loaded[self.name] = self.factory()
            while len(loaded) > KEPT:
                loaded.popitem(last=False)
        loaded.move_to_end(self.name)
        return loaded[self.name](*args)
