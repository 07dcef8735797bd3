"""Quality: histogram gradient-boosted trees over statistics of a document.

Each whole text becomes ``FEATURES``: sizes, shares of kinds of characters, repetition of words and lines, and how lines end.
Values are cut into at most ``BINS`` bins at the training rows' quantiles. Each round grows one tree of ``DEPTH`` levels,
level by level: histograms of the slopes of the logistic loss by node, feature and bin, and of their running sums the
split that gains most. The trees are complete, so a forest is three flat arrays (feature, limit, leaf value) and scoring
walks all trees of many rows at once, a level at a time.

Training takes at most ``MAX_DOCS`` labelled documents, chosen by a hash of id and text among those that are in the table:
the documented bound of the sample. Only their statistics come to the driver. Scoring reads every whole text.

Defined cases: a null text is an empty one, and empty texts are scored by their statistics (zeros); without labelled rows
every score is 0.5, and with labels of one class it is that class's smoothed share; a document with several labels is good
if all say so; several texts of one id are documents of their own, equal rows one; a null id has no label and is scored;
extra columns are never read; ties of a split go to the first feature and the least limit.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DOCS = 30_000
BINS, DEPTH, ROUNDS, RATE, RIDGE, LEAST = 64, 4, 120, 0.15, 2.0, 2.0
ACCEPT = 0.5
FEATURES = """chars words distinct_words mean_word long_words short_words upper_share digit_share mark_share other_share space_share
non_ascii_share lines mean_line distinct_lines ended_lines repeated_next most_common pipe_share upper_words unlettered_words marked_words
distinct_chars most_common_char""".split()
#: Kinds of characters.
LOWER, UPPER, DIGIT, SPACE, MARK, OTHER = range(6)
#: Marks of prose, and marks that may end a line.
MARKS, ENDS = ".,;:!?'\"()-", (".", "!", "?", ":", '"', "”", "»", "…")


def kinds() -> np.ndarray:
    """The kind of each character of the basic plane."""
    out = np.full(1 << 16, OTHER, np.uint8)
    for k in range(1 << 16):
        c = chr(k)
        if c.isalpha():
            out[k] = UPPER if c.isupper() else LOWER
        elif c.isspace():
            out[k] = SPACE
        elif c.isdigit():
            out[k] = DIGIT
        elif c in MARKS:
            out[k] = MARK
    return out


class Statistics:
    """The features of texts."""

    def __init__(self):
        self.kind = kinds()

    def of(self, text: str) -> list[float]:
        if not text:
            return [0.0] * len(FEATURES)
        data = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.minimum(data, (1 << 16) - 1)
        n, kind = len(data), self.kind[low]
        share = np.bincount(kind, minlength=6) / n
        common = np.bincount(low)
        words = text.split()
        w = max(1, len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
        distinct = set(words)
        lines = [x for x in map(str.strip, text.split("\n")) if x]
        m = max(1, len(lines))
        # a word's last character, of its distinct forms: what stands at the end of many words says how clean they are
        lettered, upper, marked = 0, 0, 0
        for x in words:
            if x.isupper() and len(x) > 1:
                upper += 1
            if x.isalpha():
                lettered += 1
            elif not x[-1].isalnum() and x[-1] not in MARKS:
                marked += 1
        return [
            np.log1p(n), np.log1p(len(words)), len(distinct) / w, float(sizes.mean()), float((sizes > 12).mean()), float((sizes < 3).mean()), share[UPPER], share[DIGIT], share[MARK], share[OTHER], share[SPACE],
            float((data > 127).mean()), np.log1p(len(lines)), np.log1p(len(text) / m), len(set(lines)) / m, sum(x.endswith(ENDS) for x in lines) / m, sum(map(eq, words, words[1:])) / w, self.most(words) / w,
            float((data == 124).mean()), upper / w, 1 - (lettered / w), marked / w, np.log1p(np.count_nonzero(common)), common.max() / n,
        ]

    @staticmethod
    def most(words: list[str]) -> int:
        """How often the most common word of more than three letters occurs."""
        times: dict[str, int] = {}
        for x in words:
            if len(x) > 3:
                times[x] = times.get(x, 0) + 1
        return max(times.values(), default=0)

    def table(self, texts: list[str]) -> np.ndarray:
        return np.array([self.of(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


class Forest:
    """Complete trees in flat arrays: node ``k`` of a tree has the children ``2k + 1`` and ``2k + 2``."""

    def __init__(self, start: float, feature: np.ndarray, limit: np.ndarray, value: np.ndarray):
        self.start, self.feature, self.limit, self.value = start, feature, limit, value
        self.trees, self.inner = feature.shape

    def logits(self, x: np.ndarray) -> np.ndarray:
        """All trees of all rows at once, a level at a time."""
        feature, limit = self.feature.reshape(-1), self.limit.reshape(-1)
        first = np.arange(self.trees) * self.inner
        node = np.zeros((len(x), self.trees), np.int64)
        row = np.arange(len(x))[:, None]
        for _ in range((self.inner + 1).bit_length() - 1):
            at = first + node
            node = 2 * node + 1 + (x[row, feature[at]] > limit[at])
        return self.start + self.value.reshape(-1)[np.arange(self.trees) * (self.inner + 1) + node - self.inner].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def binned(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The limits between the bins of each feature, and the bin of each value."""
    limits = []
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        if len(values) > BINS:
            values = np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
            limits.append(values)
        else:
            limits.append((values[1:] + values[:-1]) / 2)
    return limits, np.stack([np.searchsorted(limit, x[:, k]) for k, limit in enumerate(limits)], 1)


def grown(bins: np.ndarray, limits: list[np.ndarray], slope: np.ndarray, bend: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree: feature and limit of the inner nodes, values of the leaves, and the leaf of each row."""
    rows, width = bins.shape
    inner = (1 << DEPTH) - 1
    feature, limit, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(rows, np.int64)
    for level in range(DEPTH):
        nodes, first = 1 << level, (1 << level) - 1
        cell = (((node - first)[:, None] * width + np.arange(width)) * BINS + bins).reshape(-1)
        g, h = (np.bincount(cell, np.repeat(v, width), nodes * width * BINS).reshape(nodes, width, BINS) for v in (slope, bend))
        left_g, left_h = np.cumsum(g, 2), np.cumsum(h, 2)
        all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
        right_g, right_h = all_g - left_g, all_h - left_h
        gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - all_g**2 / (all_h + RIDGE)
        gain[(left_h < LEAST) | (right_h < LEAST)] = 0
        best = gain.reshape(nodes, -1).argmax(1)
        of, at = best // BINS, best % BINS
        for k in np.flatnonzero(gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9):
            # a node without a gain keeps an infinite limit: all its rows go left
            feature[first + k], limit[first + k] = of[k], limits[of[k]][at[k]]
        split = np.isfinite(limit[node])
        goes_right = split & (bins[np.arange(rows), feature[node]] > at[node - first])
        node = 2 * node + 1 + goes_right
    leaf = node - inner
    g, h = (np.bincount(leaf, v, inner + 1) for v in (slope, bend))
    return feature, limit, -RATE * g / (h + RIDGE), leaf


def train(x: np.ndarray, good: np.ndarray) -> Forest:
    """Boosted trees on rows of statistics. Without both classes the forest is empty."""
    n, ones = len(good), float(np.sum(good))
    start = float(np.log((ones + 1) / (n - ones + 1)))
    made: list[tuple[np.ndarray, ...]] = []
    if 0 < ones < n:
        limits, bins = binned(x)
        logit = np.full(n, start)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            feature, limit, value, leaf = grown(bins, limits, p - good, p * (1 - p))
            made.append((feature, limit, value))
            logit += value[leaf]
    inner = (1 << DEPTH) - 1
    feature, limit, value = (np.array([m[k] for m in made]).reshape(len(made), size) for k, size in enumerate((inner, inner, inner + 1)))
    return Forest(start, feature.astype(np.int64), limit, value)


def statistics(docs: DataFrame, text: str = "text") -> Column:
    """``FEATURES`` of a text, as an array column."""

    @F.pandas_udf("array<double>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series(list(statistics_of().table(texts.tolist())))

    return found(F.coalesce(F.col(text).cast("string"), F.lit("")))


_STATISTICS: list[Statistics] = []


def statistics_of() -> Statistics:
    """One for each Python worker."""
    if not _STATISTICS:
        _STATISTICS.append(Statistics())
    return _STATISTICS[0]


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows that no model of quality may learn from: crc32 of the id as text has remainder 1 by 3."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Forest:
    """Train on labelled documents that are not held out, within the bound of the sample."""
    key = F.col(doc_id).cast("long").alias("doc_id")
    marked = labels.select(key, F.col(label).cast("int").alias("good")).where(F.col("doc_id").isNotNull() & F.col("good").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.min("good").alias("good"))
    rows = docs.select(key, F.col(text).cast("string").alias("text")).withColumn("of", F.xxhash64("doc_id", "text"))
    # ids and hashes alone meet the labels; the texts chosen are found by a table of at most MAX_DOCS rows
    chosen = rows.select("doc_id", "of").distinct().join(marked, "doc_id").orderBy("of", "doc_id").limit(MAX_DOCS)
    found = rows.join(F.broadcast(chosen), ["doc_id", "of"]).select("doc_id", "of", "good", statistics(rows).alias("x"))
    known = sorted({(r["of"], r["doc_id"], int(r["good"] > 0), tuple(r["x"])) for r in found.collect()})
    return train(np.array([x for *_, x in known]).reshape(-1, len(FEATURES)), np.array([good for _, _, good, _ in known], float))


def score(forest: Forest, docs: DataFrame, text: str = "text") -> Column:
    """The probability that a text is good, as a column of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(statistics_of().table(texts.tolist())))

    return scored(F.coalesce(F.col(text).cast("string"), F.lit("")))
