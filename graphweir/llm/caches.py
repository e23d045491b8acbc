"""What a Python worker keeps between tasks: the state of one operator at a time.

Workers are reused, so a cache of words that one task has filled serves the next.  A
pipeline runs many operators through the same worker; the state of the one before is let go
when another asks, so that a worker never holds more than one bounded cache.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable

_HELD: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], object]):
    """The state made for ``key``; any other is dropped."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]
