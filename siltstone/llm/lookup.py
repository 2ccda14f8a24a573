"""A vectorised open-addressing hash table from uint64 keys to row numbers, and slicing of texts into bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Rows:
    """Row number of each of the distinct keys; -1 for others."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys, dtype=np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = self._home(self.keys)
        while len(left):
            free = self.slots[at] < 0
            spot, first = np.unique(at[free], return_index=True)
            self.slots[spot] = left[free][first]
            stay = self.slots[at] != left
            left, at = left[stay], (at[stay] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64, copy=False)
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int32)
        at = self._home(keys)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            got = self.slots[at[todo]]
            out[todo] = got
            todo = todo[(got >= 0) & (self.keys[got] != keys[todo])]
        return out


def pieces(texts: list[bytes], most: int, overlap: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Groups of (text number, piece) of some `most` bytes.

    Every piece starts with `overlap` bytes of context: spaces for a text's first piece, else the bytes before it.
    """
    who: list[int] = []
    what: list[bytes] = []
    held = 0
    for i, t in enumerate(texts):
        for at in range(0, len(t), most):
            part = t[at - overlap : at + most] if at else b" " * overlap + t[:most]
            if held and held + len(part) > most:
                yield who, what
                who, what, held = [], [], 0
            who.append(i)
            what.append(part)
            held += len(part)
    if who:
        yield who, what
