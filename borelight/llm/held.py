"""Objects that a Python process makes once and keeps over its tasks."""

from __future__ import annotations

import sys
from collections.abc import Callable


def held(key: tuple, make: Callable):
    """What `make` gave for `key` the first time in this process. Functions that are sent to tasks by value bring copies of
    their module's variables along, so the objects hang on the interpreter instead."""
    store = sys.__dict__.setdefault("_borelight_held", {})
    if key not in store:
        store[key] = make()
    return store[key]


def latest(key: tuple, name: str, make: Callable):
    """As `held`, but of one `key` only the object of the `name` asked for last is kept."""
    store = sys.__dict__.setdefault("_borelight_held", {})
    if store.get(key, (None,))[0] != name:
        store.pop(key, None)
        store[key] = (name, make())
    return store[key][1]
