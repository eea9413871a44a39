"""What a Python worker builds once and keeps between tasks: models, automata, word tables."""
from __future__ import annotations

import hashlib
import pickle
from collections import OrderedDict
from collections.abc import Callable
from typing import Any

KEPT = 1  # the last one: the stages of a job follow each other, and a worker's memory is small

_held: OrderedDict[str, Any] = OrderedDict()


def key_of(kind: str, *content: Any) -> str:
    """Names a state by what it is made from; computed on the driver, once per plan."""
    return f"{kind}:{hashlib.sha1(pickle.dumps(content, 5)).hexdigest()}"


def held(key: str, build: Callable[[], Any]) -> Any:
    """The worker's state of that name, built if it does not have it. An older state goes first."""
    if key not in _held:
        while len(_held) >= KEPT:
            _held.popitem(last=False)
        _held[key] = build()
    return _held[key]
