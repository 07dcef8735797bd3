"""Per-word tables for text scorers: each distinct chunk of a text is worked out once per Python worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Chunks that a Python worker remembers, the longest that it does, and numbers for all of them: about 60 MB of numbers at most.
KNOWN, KNOWN_CHARS, KNOWN_NUMBERS = 300_000, 40, 15_000_000


class ChunkTable:
    """Rows of numbers for chunks (runs without white space), kept between batches; ``rows`` makes those not met before."""

    def __init__(self, width: int, rows: Callable[[list[str]], np.ndarray]):
        self.width, self.make = width, rows
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.values, self.size = np.zeros((1024, self.width), np.float32), 0

    def look_up(self, split: list[list[str]]) -> list[np.ndarray]:
        """The rows of the chunks of each text, in order."""
        needed = set().union(*split)
        if self.size > min(KNOWN, KNOWN_NUMBERS // self.width):
            self.clear()
        new = [c for c in needed if c not in self.at]
        if new:
            while self.size + len(new) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            self.values[self.size : self.size + len(new)] = self.make(new)
            self.at.update(zip(new, range(self.size, self.size + len(new)), strict=True))
            self.size += len(new)
        found = [self.values[np.fromiter(map(self.at.__getitem__, s), np.int64, len(s))] for s in split]
        for c in new:
            if len(c) > KNOWN_CHARS:  # its row stays unused until the table is cleared
                del self.at[c]
        return found


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of ``words`` in a row, and the number of the word of each."""
    data = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return data, np.repeat(np.arange(len(words)), [len(w) for w in words])


def hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the ``n`` characters from each position; the last ``n - 1`` positions have none."""
    h = np.full(max(0, len(data) - n + 1), n, np.uint64)
    for k in range(n):
        h = (h ^ data[k : len(data) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h
