"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with one space for each run of white space. An item of m characters may
occur with at most k = floor(``BUDGET`` m) edits. Cut into k + 1 pieces, at least one piece of every such occurrence is
exact; an Aho-Corasick automaton finds all exact pieces in one pass over the whole text, and Myers' bit-parallel
distance verifies the item around each hit.

Items go to the tasks in blocks of at most ``BLOCK_CHARS`` characters (the proven bound of a broadcast, unless a single
item is longer). A benchmark of one block is one pass over the documents. With more, each block's result is settled and its
broadcast destroyed before the next block is read: driver and workers hold one block at a time, and every block is one
more pass, over all documents for ``contaminated`` and over those still clean for ``clean``.

Defined cases: null and empty texts hold nothing; null and empty items, and items of white space, match nothing; an item under ``1 / BUDGET``
characters must occur exactly; of equal distances the leftmost occurrence counts; repeated rows each get their hits;
extra columns are kept and never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.llm.common import settle

BUDGET = 0.06
BLOCK_CHARS = 4_000_000
HITS = "array<struct<item_id:bigint,distance:int,start:bigint,end:bigint>>"


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def allowed(length: int) -> int:
    return int(BUDGET * length)


def pieces(item: str) -> Iterator[tuple[int, str]]:
    """The error budget plus one pieces of an item, with their offsets."""
    n = allowed(len(item)) + 1
    for k in range(n):
        begin, end = len(item) * k // n, len(item) * (k + 1) // n
        yield begin, item[begin:end]


def myers(masks: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """The least edits that turn a part of ``text`` into the item, and where the first such part ends."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, distance = full, 0, size
    best, at = size, 0
    for k, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | minus
        d0 = (((x & plus) + plus) ^ plus) | x
        up, down = minus | ~(d0 | plus) & full, plus & d0
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(d0 | up) & full, up & d0
        if distance < best:
            best, at = distance, k + 1
    return best, at


def masks_of(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << k
    return out


class Matcher:
    """One block of items: ``(item_id, text)`` in plain form."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = items
        self.ready = False

    def __reduce__(self) -> tuple:
        return Matcher, (self.items,)

    def prepare(self) -> None:
        spots: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item) in enumerate(self.items):
            for offset, piece in pieces(item):
                spots.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in spots.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()
        self.forward = [masks_of(item) for _, item in self.items]
        self.backward = [masks_of(item[::-1]) for _, item in self.items]
        self.ready = True

    def hits(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """Per item found: its id, the least distance, and where the leftmost such part stands in the plain text."""
        if not self.ready:
            self.prepare()
        if not self.items:
            return []
        text, best, seen = plain(text), {}, set()
        for last, (size, where) in self.automaton.iter(text):
            for k, offset in where:
                item = self.items[k][1]
                m, budget = len(item), allowed(len(item))
                # hits on neighbouring diagonals share a window that holds what any of them may need
                begin = last + 1 - size - offset
                cell = begin // (budget + 1) * (budget + 1)
                if (k, cell) in seen:
                    continue
                seen.add((k, cell))
                low, high = max(0, cell - budget), cell + m + 2 * budget + 1
                distance, end = myers(self.forward[k], m, text[low:high])
                if distance > budget:
                    continue
                end += low
                # the same match read backwards from its end gives its beginning
                _, size_of = myers(self.backward[k], m, text[max(0, end - m - budget) : end][::-1])
                found = (distance, end - size_of, end)
                if k not in best or found < best[k]:
                    best[k] = found
        return [(self.items[k][0], d, s, e) for k, (d, s, e) in sorted(best.items())]


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Matcher]:
    """The items in blocks of bounded size, read one after the other."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).toLocalIterator():
        item = plain(row["text"])
        if not item:
            continue
        if block and size + len(item) > BLOCK_CHARS:
            yield Matcher(block)
            block, size = [], 0
        block.append((row["item_id"], item))
        size += len(item)
    yield Matcher(block)


class Shared:
    """A block in the tasks, as long as it is needed."""

    def __init__(self, matcher: Matcher, docs: DataFrame):
        self.broadcast = docs.sparkSession.sparkContext.broadcast(matcher)

    def hits(self, text: Column) -> Column:
        """All items of the block that a text holds. Map only: documents are never shuffled."""
        shared = self.broadcast

        @F.pandas_udf(HITS)
        def found(texts: pd.Series) -> pd.Series:
            own = shared.value
            return pd.Series([[dict(zip(("item_id", "distance", "start", "end"), h, strict=True)) for h in own.hits(t)] for t in texts], dtype=object)

        return found(text.cast("string"))

    def done(self) -> None:
        self.broadcast.destroy()


def _block_by_block(docs: DataFrame, benchmark: DataFrame) -> Iterator[tuple[Shared, bool]]:
    """Each block, and whether it is the only one."""
    found = blocks(benchmark)
    first, second = next(found), next(found, None)
    yield Shared(first, docs), second is None
    if second is not None:
        for matcher in chain([second], found):
            yield Shared(matcher, docs), False


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document and item it holds: ``doc_id``, ``item_id``, ``distance``, ``start``, ``end``."""
    parts = []
    for block, only in _block_by_block(docs, benchmark):
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.explode(block.hits(F.col(text))).alias("hit")).select("doc_id", "hit.*")
        if only:
            return rows
        parts.append(settle(rows))
        block.done()
    return reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    for block, only in _block_by_block(docs, benchmark):
        left = docs.where(F.size(block.hits(F.col(text))) == 0)
        if only:
            return left
        docs = settle(left)
        block.done()
    return docs
