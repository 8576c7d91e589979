"""A memo of bounded size for per-word results inside a Python worker."""

from __future__ import annotations

from collections.abc import Callable
from sys import getsizeof
from typing import Any

#: Bytes of a dictionary's slot and the objects' headers, about.
_SLOT = 110


class Memo(dict):
    """memo[key] gives make(key), kept for later. At most about 2 * size bytes are held: when the young half is full it becomes the old half, and what is still used moves back. A forgotten entry is made again, so results never depend on the size; an entry of more than a thousandth of the size is not kept."""

    def __init__(self, make: Callable[[Any], Any], size: int = 64 << 20):
        self.make, self.size, self.old, self.held = make, size, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        cost = getsizeof(key) + getsizeof(value) + _SLOT
        if cost * 1000 > self.size:
            return value
        if self.held + cost > self.size:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self.held += cost
        self[key] = value
        return value
