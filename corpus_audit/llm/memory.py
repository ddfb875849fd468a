"""A bounded memory of computed values inside a worker."""

from __future__ import annotations

from collections.abc import Iterable


class Recent:
    """Values by key; what was not asked for while ``most`` further keys came in is forgotten.

    It holds up to twice ``most`` keys, and those of one call more.
    """

    def __init__(self, most: int):
        self.most, self.now, self.before = most, {}, {}

    def unknown(self, keys: set) -> set:
        """The keys that have to be computed and given to ``learn`` before all of ``keys`` can be read from ``now``."""
        if len(self.now) > self.most:
            self.now, self.before = {}, self.now
        absent = keys - self.now.keys()
        again = absent & self.before.keys()
        self.now.update((key, self.before[key]) for key in again)
        return absent - again

    def learn(self, found: Iterable[tuple]) -> None:
        self.now.update(found)
