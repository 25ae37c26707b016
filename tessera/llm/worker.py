"""What a Python worker keeps between tasks: the tables of one operator at a time.

Workers outlive stages.  When another operator's task asks for its tables, the
former ones are let go, so that a pipeline needs the memory of its largest
stage and not of all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable

_held: dict[tuple[str, str], tuple[Hashable, object]] = {}


def held(operator: str, kind: str, name: Hashable, build: Callable[[], object]) -> object:
    """The object ``name`` of this kind, built if the worker does not hold it."""
    for key in [k for k in _held if k[0] != operator]:
        del _held[key]
    got = _held.get((operator, kind))
    if got is None or got[0] != name:
        _held.pop((operator, kind), None)
        got = _held[operator, kind] = (name, build())
    return got[1]


def forget() -> None:
    """Let everything go; for operators that need no tables."""
    _held.clear()
