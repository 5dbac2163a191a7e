"""Shared helpers: row keys, text columns and memos, and the stored tables of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from trustloom.functions.expr import held
from trustloom.sources.store import shared_dir, stored

__all__ = ["BLANK", "BLANK_CHARS", "NOT_BLANK", "SEPARATORS", "Memo", "held", "only", "row_key", "shared_dir", "stored", "tail"]

#: Word separators: space and the ASCII controls tab to carriage return.
BLANK = r"[\x20\x09-\x0D]"
NOT_BLANK = r"[^\x20\x09-\x0D]"
BLANK_CHARS = " \t\n\x0b\x0c\r"


def row_key(*columns: Column | str) -> Column:
    """128 bits by which rows are told apart: two hashes of ``columns``, null or not, that begin differently."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    parts = [x for c in cols for x in (c.isNull(), c)]
    return F.struct(*[F.xxhash64(F.lit(k), *parts).alias(name) for k, name in enumerate("ab")])


def tail(array: Column, n: int) -> Column:
    """``array`` without its first ``n`` elements.

    Zipping an array with its tail compares neighbours. A lambda that looked up
    the array by index instead would evaluate it anew for each element wherever
    the optimizer puts the array's expression in its place.
    """
    return F.slice(array, n + 1, F.greatest(F.size(array) - n, F.lit(0)))


#: Python's split() also cuts at these four, which are no white space in Unicode.
SEPARATORS = "\x1c\x1d\x1e\x1f"


class Memo(dict):
    """Memo of a function of strings with bounded memory, for use within a worker process.

    Two generations of at most ``size`` entries each: a full one becomes the old
    one, of which what is asked for again comes back. Strings over ``longest``
    characters aren't kept.
    """

    def __init__(self, of: Callable, size: int = 150_000, longest: int = 64) -> None:
        super().__init__()
        self.of, self.size, self.longest, self.old = of, size, longest, {}

    def __missing__(self, key: str):
        found = self.old.get(key)
        if found is None:
            found = self.of(key)
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


_SLOT: dict[tuple, object] = {}


def only(build: Callable, *key):
    """``build()``, made once for ``key`` in a worker process and kept until another key is asked for.

    A worker holds one such object with its memos, however many stages it
    serves one after the other: an index or a scorer isn't built anew for each
    task, and what an earlier stage has gathered makes room for the next.
    """
    if key not in _SLOT:
        _SLOT.clear()
        _SLOT[key] = build()
    return _SLOT[key]
