"""Toxicity: bags of subwords, averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character 3- to 5-grams (with word marks) and itself, each with a hashed vector, so an unseen
spelling shares most of its vectors with the known one. Vectors are averaged into a linear softmax of two classes, over
a whole text and over each window of ``WINDOW`` words; vectors and softmax are trained together, first on whole texts and
on all their spans, then on the windows that score highest. A logistic curve fitted on the training texts turns what the
softmax says of the averaged text, and of its highest windows (a long text with one bad sentence is as toxic as the
sentence), into a probability; the number of windows tells chance from evidence.

Training takes at most ``MAX_DOCS`` labelled documents of 1 to ``MAX_CHARS`` characters, chosen by a hash of id and text
among those that are in the table: the documented bound of the sample. Each is used whole. Scoring reads every whole text.

Defined cases: null and empty texts, and texts without a letter or digit, have no evidence and score 0; without
labelled rows of both classes every score is 0; a document with several labels is toxic if one says so; several texts of
one id are documents of their own, equal rows one; ties cannot occur, as each row is scored alone; extra columns are kept
and never read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.llm.common import held_out
from screenloom.llm.words import ChunkTable, code_points, hashes

MAX_DOCS, MAX_CHARS = 3000, 20_000
BITS, DIM, WINDOW, TOP = 17, 8, 3, 3
REJECT = 0.3
#: Words whose subwords are made at once.
WORDS_AT_ONCE = 5000
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def bags(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the subwords of all chunks, and the chunk of each."""
    words = [f"<{EDGES.sub('', c)}>" for c in chunks]
    data, word = code_points(words)
    length = np.array([len(w) for w in words])
    starts = np.cumsum(length) - length
    buckets, owner = [], []
    for n in (3, 4, 5):
        h = hashes(data, n)
        inside = np.flatnonzero(word[: len(h)] == word[n - 1 :]) if len(h) else np.zeros(0, np.int64)
        buckets.append(h[inside] >> np.uint64(64 - BITS))
        owner.append(word[inside])
    whole = np.add.reduceat(np.concatenate([data * (np.arange(len(data)) - starts[word] + 1).astype(np.uint64) ** 3, [np.uint64(0)]]), starts) * np.uint64(0x9E3779B97F4A7C15)
    buckets.append(whole >> np.uint64(64 - BITS))
    owner.append(np.arange(len(words)))
    b, o = np.concatenate(buckets).astype(np.int64), np.concatenate(owner)
    kept = length[o] > 2  # chunks of punctuation alone have no features
    return b[kept], o[kept]


def windows(scores: np.ndarray) -> np.ndarray:
    """Means over ``WINDOW`` words in a row, or over all of a shorter text."""
    if len(scores) <= WINDOW:
        return scores.mean(keepdims=True) if len(scores) else np.zeros(1)
    c = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    return (c[WINDOW:] - c[:-WINDOW]) / WINDOW


def summary(scores: np.ndarray) -> tuple[float, float, float, float]:
    """The averaged text, the highest window, the mean of the highest ones, and the number of windows on a log scale."""
    w = windows(scores)
    top = np.sort(np.partition(w, -TOP)[-TOP:] if len(w) > TOP else w)
    return float(scores.mean()) if len(scores) else 0.0, float(top[-1]), float(top.mean()), float(np.log(len(w)))


class Model:
    """What scoring needs: a number per subword bucket, and the logistic curve over ``summary``."""

    def __init__(self, table: np.ndarray, curve: np.ndarray):
        self.table, self.curve = table.astype(np.float32), curve
        self.known = ChunkTable(2, self.rows)

    def __reduce__(self) -> tuple:
        return Model, (self.table, self.curve)

    def rows(self, chunks: list[str]) -> np.ndarray:
        """For each chunk: its logit, and 1 if it has subwords."""
        b, o = bags(chunks)
        n = np.bincount(o, minlength=len(chunks))
        return np.stack([np.bincount(o, weights=self.table[b], minlength=len(chunks)) / np.maximum(n, 1), n > 0], 1)

    def words(self, texts: list[str]) -> list[np.ndarray]:
        return [v[v[:, 1] > 0, 0] for v in self.known.look_up([t.lower().split() for t in texts])]

    def score(self, texts: list[str]) -> np.ndarray:
        found = self.words(texts)
        x = np.array([summary(s) for s in found]).reshape(-1, 4)
        return np.where([len(s) > 0 for s in found], 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -30, 30))), 0.0)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; the last coefficient is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
    return w


def train(texts: list[str], toxic: list[int], seed: int = 7) -> Model | None:
    """Vectors and softmax: on whole texts and all their spans with the text's label, then on the windows that score highest."""
    y = np.array(toxic, np.int64)
    if len(y) == 0 or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    # a text is held as the numbers of its words from the start: the driver that trains has little memory
    met: dict[str, int] = {}
    numbers = [np.array([met.setdefault(c, len(met)) for c in t.lower().split()], np.int64) for t in texts]
    vocabulary = sorted(met)
    place = np.zeros(len(met), np.int64)
    place[[met[c] for c in vocabulary]] = np.arange(len(met))
    parts = []
    for at in range(0, len(vocabulary), WORDS_AT_ONCE):
        b, o = bags(vocabulary[at : at + WORDS_AT_ONCE])
        order = np.argsort(o, kind="stable")
        parts.append((b[order].astype(np.int32), np.bincount(o, minlength=len(vocabulary[at : at + WORDS_AT_ONCE]))))
    b, size = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    first = np.cumsum(size) - size
    docs = [x[size[x] > 0] for x in (place[n] for n in numbers)]
    del met, vocabulary, numbers, parts
    vectors = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    softmax = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    # sums of squared slopes: each bucket and weight slows down by what it has moved (Adagrad), so that no step runs away
    squares, seen = np.full((DIM, 2), 1e-6, np.float32), np.full(1 << BITS, 1e-8, np.float32)

    def step(spans: list[np.ndarray], labels: np.ndarray, rate: float) -> None:
        """One minibatch: each span holds the words of a window; a word's vector is the mean of its subwords'."""
        words = np.concatenate(spans)
        span = np.repeat(np.arange(len(spans)), [len(s) for s in spans])
        share = (1 / np.bincount(span))[span]  # of a word in the mean of its span
        met, where = np.unique(words, return_inverse=True)
        n = size[met]
        at = np.repeat(first[met] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        ids, owner = b[at], np.repeat(np.arange(len(met)), n)
        word = np.add.reduceat(vectors[ids], np.cumsum(n) - n) / n[:, None]
        mean = np.stack([np.bincount(span, weights=word[where, d] * share, minlength=len(spans)) for d in range(DIM)], 1)
        z = mean @ softmax + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(spans)), labels] -= 1
        back = p @ softmax.T
        slope = mean.T @ p / len(spans)
        squares[:] += slope**2
        softmax[:] -= rate * slope / np.sqrt(squares)
        bias[:] -= rate * p.mean(0)
        to_word = np.stack([np.bincount(where, weights=back[span, d] * share) for d in range(DIM)], 1) / n[:, None]
        used, bucket = np.unique(ids, return_inverse=True)
        slopes = np.stack([np.bincount(bucket, weights=to_word[owner, d]) for d in range(DIM)], 1)
        seen[used] += (slopes**2).mean(1).astype(np.float32)
        vectors[used] -= (rate * slopes / np.sqrt(seen[used])[:, None]).astype(np.float32)

    def epoch(spans: list[np.ndarray], labels: np.ndarray, rate: float, batch: int = 512) -> None:
        for at in np.array_split(rng.permutation(len(spans)), max(1, len(spans) // batch)):
            step([spans[k] for k in at], labels[at], rate)

    def cut(doc: np.ndarray, width: int) -> list[np.ndarray]:
        """All spans of a text, each once: a line that is repeated a thousand times says no more than once."""
        spans = [doc[at : at + width] for at in range(0, max(1, len(doc) - width + 1), width)]
        return list({s.tobytes(): s for s in spans}.values())

    has = [k for k in range(len(docs)) if len(docs[k])]
    spans = [s for k in has for s in (docs[k], *cut(docs[k], 2 * WINDOW))]
    labels = np.repeat(y[has], [1 + len(cut(docs[k], 2 * WINDOW)) for k in has])
    epoch(spans, labels, 0.3)
    del spans, labels

    def per_bucket() -> np.ndarray:
        return vectors @ (softmax[:, 1] - softmax[:, 0])

    def per_word() -> np.ndarray:
        return np.bincount(np.repeat(np.arange(len(size)), size), weights=per_bucket()[b], minlength=len(size)) / np.maximum(size, 1)

    for rate in (0.2, 0.2, 0.15, 0.1, 0.1, 0.05):
        score, spans, labels = per_word(), [], []
        for k in has:
            w = windows(score[docs[k]])
            for at in np.argsort(-w, kind="stable")[:: max(1, WINDOW)][:2] if not y[k] else [int(w.argmax())]:
                spans.append(docs[k][at : at + WINDOW])
                labels.append(y[k])
        epoch(spans, np.array(labels), rate, 64)
    score = per_word()
    x = np.array([summary(score[d]) for d in docs])
    return Model(per_bucket(), logistic(x, y.astype(float)))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """Train on labelled documents that are not held out, within the bound of the sample."""
    key = F.col(doc_id).cast("long").alias("doc_id")
    marked = labels.select(key, F.col(label).cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(key, F.col(text).cast("string").alias("text")).where(F.length("text").between(1, MAX_CHARS)).withColumn("of", F.xxhash64("doc_id", "text"))
    # ids and hashes alone meet the labels; the texts chosen are fetched by a table of at most MAX_DOCS rows
    chosen = rows.select("doc_id", "of").distinct().join(marked, "doc_id").orderBy("of", "doc_id").limit(MAX_DOCS)
    found = rows.join(F.broadcast(chosen), ["doc_id", "of"]).groupBy("doc_id", "of").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    texts = sorted((r["doc_id"], r["text"], r["toxic"]) for r in found.collect())
    return train([t for _, t, _ in texts], [int(x > 0) for _, _, x in texts])


def score(model: Model | None, docs: DataFrame, text: str = "text") -> Column:
    """The probability that a text is toxic, as a column of ``docs``."""
    if model is None:
        return F.lit(0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        own, all_texts = shared.value, texts.tolist()
        parts = [own.score(all_texts[k : k + 200]) for k in range(0, len(all_texts), 200)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return scored(F.coalesce(F.col(text).cast("string"), F.lit("")))
