"""Document fingerprints: quartile bucket digests.

Every byte triplet of the UTF-8 text (adjacent bytes, and one with a gap) is hashed into one of 256 buckets. The
digest holds, for each bucket, in which quarter of all bucket counts its own count lies (2 bits), and a header with the
length on a log scale and the ratios of the quartiles. Two digests are compared by a bounded difference score.

Defined cases: a null text is an empty one; empty texts and texts under three bytes have a digest with no bucket
filled; equal texts have equal digests. Documents follow each other by ascending id (nulls first), then by text; after
the last comes the first; a table of one row follows itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from screenloom.llm.common import settle

BUCKETS = 256
#: A difference of this much, or more, is a likeness of 0; unrelated texts of a language differ by about 300.
FAR = 600
PIECE = 1 << 18


def counts(data: np.ndarray) -> np.ndarray:
    """How many triplets fall into each bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(0, len(data) - 2), PIECE):
        b = data[at : at + PIECE + 3].astype(np.uint32)
        near = (b[:-2] << 16 | b[1:-1] << 8 | b[2:])[:PIECE]
        total += np.bincount((near * np.uint32(2654435761)) >> 24, minlength=BUCKETS)
        if len(b) > 3:
            gap = (b[:-3] << 16 | b[1:-2] << 8 | b[3:])[:PIECE]
            total += np.bincount((gap * np.uint32(2246822519) + np.uint32(374761393)) >> 24, minlength=BUCKETS)
    return total


def digest(text: str | None) -> np.ndarray:
    """Three header bytes (length, two ratios) and a code from 0 to 3 for each bucket."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = counts(data)
    q = np.sort(n)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    head = [min(255, round(12 * math.log1p(len(data)))), *(int(15 * q[k] // q[2]) if q[2] else 0 for k in (0, 1))]
    return np.concatenate([np.array(head, np.uint8), (n[:, None] > q).sum(1).astype(np.uint8)])


def shown(d: np.ndarray) -> str:
    """Digest as lowercase hex: 2 digits a header byte, then 4 buckets a byte."""
    body = d[3:].reshape(-1, 4)
    return (d[:3].tobytes() + (body[:, 0] << 6 | body[:, 1] << 4 | body[:, 2] << 2 | body[:, 3]).astype(np.uint8).tobytes()).hex()


def read(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return np.concatenate([raw[:3], np.stack([raw[3:] >> s & 3 for s in (6, 4, 2, 0)], 1).ravel()])


def difference(a: np.ndarray, b: np.ndarray) -> int:
    """0 for equal digests. Codes at opposite ends count double; the header's bytes count by their distance."""
    d = np.abs(a.astype(np.int16) - b.astype(np.int16))
    return int(d.sum() + 3 * (d[3:] == 3).sum())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return max(0.0, 1.0 - difference(a, b) / FAR)


def edited(text: str, following: str) -> str:
    """The last half of the code points gives way to as many of the following document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(doc_id: int | None, text: str, following: str, own: np.ndarray, theirs: np.ndarray) -> tuple:
    new = edited(text, following)
    d = digest(new)
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), shown(own), shown(d), likeness(own, d), likeness(own, theirs)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The digest of each text alone: ``doc_id``, ``fingerprint``. Map only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fingerprint": [shown(digest(t)) for t in b["text"]]})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInPandas(run, "doc_id long, fingerprint string")


def compare_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against its half-edited self and against the next document, with the columns of ``COLUMNS``.

    One shuffle by ranges of the id puts neighbours side by side; only the two documents at the ends of each range
    travel once more, as rows, to meet their neighbours in the next one.
    """
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    kinds = COLUMNS + ", part int, edge string, edge_text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        last = None
        for b in batches:
            out = []
            ids = [None if pd.isna(i) else int(i) for i in b["doc_id"]]
            for i, t in zip(ids, b["text"], strict=True):
                d = digest(t)
                if last is None:
                    out.append((i, *[None] * 6, part, "first", t))
                else:
                    out.append((*compared(last[0], last[1], t, last[2], d), part, None, None))
                last = (i, t, d)
            yield pd.DataFrame(out, columns=[*names, "part", "edge", "edge_text"]).astype({"doc_id": "Int64", "n_chars": "Int64"})
        if last is not None:
            yield pd.DataFrame([(last[0], *[None] * 6, part, "last", last[1])], columns=[*names, "part", "edge", "edge_text"]).astype({"doc_id": "Int64", "n_chars": "Int64"})

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [compared(None if pd.isna(i) else int(i), t, f, digest(t), digest(f)) for i, t, f in zip(b["doc_id"], b["text"], b["following"], strict=True)]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "n_chars": "Int64"})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    by = ["doc_id", F.xxhash64("text")]
    inner = settle(rows.repartitionByRange(*by).sortWithinPartitions(*by, "text").mapInPandas(run, kinds))
    first = inner.where("edge = 'first'")
    parts = first.select("part")
    # one row for each range: which range comes next, and after the last the first
    order = W.orderBy("part")
    follows = parts.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("after"))
    pairs = inner.where("edge = 'last'").select("doc_id", F.col("edge_text").alias("text"), "part").join(follows, "part").join(first.select(F.col("part").alias("after"), F.col("edge_text").alias("following")), "after")
    return inner.where("edge is null").select(*names).unionByName(pairs.select("doc_id", "text", "following").mapInPandas(ends, COLUMNS))
