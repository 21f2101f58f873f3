"""A bounded per-worker memo for values computed once per distinct word."""

from __future__ import annotations


class Memo(dict):
    """``memo[key]`` computes a missing value with ``make`` and keeps it.

    Two generations bound the memory: when the young one is full it becomes the old one,
    and the old one is forgotten. Frequent keys survive by being copied back on use. Keys longer
    than ``longest`` are not kept, so memory is bounded in bytes as well: a long unbroken string
    is computed whenever it comes. Only speed depends on the bounds, never a result.
    """

    def __init__(self, make, limit: int = 100_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_LIVE: dict = {}


def per_worker(key, build):
    """An object that the Python worker keeps from task to task, built on first use.

    A worker serves one operator after another: asking for another key lets the last one go.
    """
    if key not in _LIVE:
        release()
        _LIVE[key] = build()
    return _LIVE[key]


def release() -> None:
    """Lets go what tasks of other operators left in this Python worker."""
    _LIVE.clear()
