"""What workers remember about words, one kind at a time."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import filterfalse


class Memo(dict):
    """A table of at most `limit` entries that starts anew when full.

    A worker runs the tasks of many operators; claim() empties the table that
    another one filled before, so that only one of them takes memory. missing()
    fills it in two generations: when half the entries are there they become the
    older ones, and those that are asked for again come back.
    """

    holder: Memo | None = None

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.older = limit, {}

    def claim(self) -> Memo:
        if Memo.holder is not self:
            if Memo.holder is not None:
                Memo.holder.clear()
                Memo.holder.older = {}
            Memo.holder = self
        return self

    def missing(self, keys: Iterable) -> list:
        """The keys that are not known, each once; the others are all in the table afterwards."""
        if len(self) > self.limit // 2:
            self.older = {}  # gone before the copy is made
            self.older = dict(self)
            self.clear()
        new = set(filterfalse(self.__contains__, keys))
        if self.older:
            back = new & self.older.keys()
            self.update((k, self.older[k]) for k in back)
            new -= back
        return list(new)

    def make_room(self, more: int = 1) -> None:
        if len(self) + more > self.limit:
            self.clear()
