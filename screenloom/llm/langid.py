"""Language ID: interpolated Kneser-Ney character models, one per language.

A word is read with a space on either side; each character is predicted from the three before it. The highest order
uses counts, the lower ones continuation counts, each interpolated with the next lower and the lowest with a uniform
one. All n-grams of all languages stand in one sorted hash array per order, each with the languages that have it, and so do
their contexts; looking up is a binary search. A text's language is the one with the lowest cross-entropy per
character.

Every letter of a text counts, those beside digits too: runs of letters are cut at everything else. The score is the
share of the language found when all languages are weighed by their probability of ``SCORE_CHARS`` characters at the
text's mean: it says how clearly the text speaks for that language, however long it is.

A text is rejected if its strangeness lies beyond what training texts of that language, kept apart for this, show for as
many chunks: their median, plus ``MARGIN``, plus ``SPREAD`` standard errors. The strangeness is the mean over the text's
chunks (runs without white space) of their cross-entropy, so that each chunk counts once: a key or an address of forty
letters weighs as much as one word, while a text in an unknown script or of random letters is strange throughout.

Training takes, per language, at most ``MAX_DOCS`` documents of 1 to ``MAX_CHARS`` characters, chosen by a hash of
the id, and fewer where all languages together would have more than ``MAX_SAMPLE``: the documented bound of the sample. They are ranked among a share of the language's documents (by the same hash)
that holds about twice as many, so that no language is gathered to be ranked; should a share hold fewer, fewer are taken.
Prediction reads every whole text. A table with more than ``MAX_LANGUAGES`` languages is an error.

Defined cases: a null text and one without a letter are ``und`` with score 0 and rejected; rows without a language
teach nothing; without training rows every text is ``und``; equal scores go to the language first by name; repeated
rows get equal results; extra columns are kept and never read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from screenloom.llm.common import held_out
from screenloom.llm.words import ChunkTable, code_points, hashes

ORDER, DISCOUNT = 4, 0.75
#: Documents of a language and characters of each at most, and characters of all languages together.
MAX_DOCS, MAX_CHARS, MAX_SAMPLE = 300, 20_000, 60_000_000
MAX_LANGUAGES = 1000
#: Numbers of a table that is held with a column for each language: 40 MB.
MAX_DENSE = 5_000_000
MARGIN, SPREAD = 0.8, 6.0
SCORE_CHARS = 20
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def runs(text: str) -> list[str]:
    """Runs of letters of a lower-cased chunk; digits and signs cut them."""
    if text.isalpha():
        return [text]
    found = LETTERS.findall(text)
    return [w for r in found for w in ([r] if r.isalpha() else "".join(c if c.isalpha() else " " for c in r).split())]


def grams(words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order, the hashes of the n-grams that end at each predicted character and of their contexts, and the
    word of each.

    Words are padded so that every predicted character has a full context: ``ORDER - 1`` spaces, then one at the end.
    """
    pad = " " * (ORDER - 1)
    data, word = code_points([f"{pad}{w} " for w in words])
    ends = np.flatnonzero(word[: len(data) - ORDER + 1] == word[ORDER - 1 :]) + ORDER - 1 if len(data) else np.zeros(0, np.int64)
    all_grams = [hashes(data, n) for n in range(1, ORDER + 1)]
    contexts = [np.zeros(len(ends), np.uint64), *(all_grams[n - 2][ends - n + 1] for n in range(2, ORDER + 1))]
    return [all_grams[n - 1][ends - n + 1] for n in range(1, ORDER + 1)], contexts, word[ends]


class Tables:
    """Sorted hash arrays: n-grams and contexts of each order, with the languages that have them."""

    def __init__(self, languages: list[str], counts: list[Counter]):
        vocabularies = [(list(c), np.array(list(c.values()), np.float64)) for c in counts]
        per_language = []
        for words, n in vocabularies:
            by_order, contexts, word = grams(words)
            per_language.append((by_order, contexts, n[word] if len(words) else np.zeros(0)))
        self.alphabet = np.array([max(2, len(np.unique(g[0]))) + 1 for g, _, _ in per_language], np.float64)
        self.grams, self.contexts = [], []
        width = len(languages)
        for k in range(ORDER):
            parts, tops = [], []
            for column, (by_order, contexts, weight) in enumerate(per_language):
                high, context = by_order[k], contexts[k]
                if k == ORDER - 1:
                    g, first, inverse = np.unique(high, return_index=True, return_inverse=True)
                    n = np.bincount(inverse, weights=weight) if len(g) else np.zeros(0)
                else:  # continuation counts: how many different characters come before
                    _, once = np.unique(by_order[k + 1], return_index=True)
                    g, first, inverse = np.unique(high[once], return_index=True, return_inverse=True)
                    n, first = np.bincount(inverse).astype(np.float64) if len(g) else np.zeros(0), once[first]
                c, owner = np.unique(context[first], return_inverse=True)
                total = np.bincount(owner, weights=n) if len(c) else np.zeros(0)
                kinds = np.bincount(owner) if len(c) else np.zeros(0)
                parts.append((column, g, np.maximum(n - DISCOUNT, 0) / total[owner] if len(g) else n))
                tops.append((column, c, DISCOUNT * kinds / np.maximum(total, 1e-9)))
            self.grams.append(Sparse(parts, width, 0.0))
            self.contexts.append(Sparse(tops, width, 1.0))

    def log_p(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The logarithm of each predicted character's probability, by language, and the word of each."""
        by_order, contexts, word = grams(words)
        p = np.broadcast_to(1 / self.alphabet, (len(word), len(self.alphabet)))
        for k in range(ORDER):
            p = self.grams[k].found(by_order[k]) + self.contexts[k].found(contexts[k]) * p
        return np.log(p), word


class Sparse:
    """Sorted hashes, and for each the languages that have it with their values: as many numbers as there are such pairs."""

    def __init__(self, parts: list[tuple[int, np.ndarray, np.ndarray]], width: int, missing: float):
        hashed = np.concatenate([g for _, g, _ in parts])
        column = np.repeat(np.array([c for c, _, _ in parts], np.int32), [len(g) for _, g, _ in parts])
        order = np.argsort(hashed, kind="stable")
        self.column, self.value = column[order], np.concatenate([v for *_, v in parts])[order]
        self.keys, self.first, self.size = np.unique(hashed[order], return_index=True, return_counts=True)
        self.width, self.missing, self.dense = width, missing, None
        if len(self.keys) * width <= MAX_DENSE:
            # few languages: the same values as a table, which is looked up faster
            self.dense = np.full((len(self.keys), width), missing)
            self.dense[np.repeat(np.arange(len(self.keys)), self.size), self.column] = self.value

    def found(self, wanted: np.ndarray) -> np.ndarray:
        """The values of each wanted hash by language."""
        out = np.full((len(wanted), self.width), self.missing)
        if not len(self.keys):
            return out
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        if self.dense is not None:
            out = self.dense[at]
            out[self.keys[at] != wanted] = self.missing
            return out
        hit = np.flatnonzero(self.keys[at] == wanted)
        n = self.size[at[hit]]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(self.first[at[hit]], n) + inside
        out[np.repeat(hit, n), self.column[place]] = self.value[place]
        return out


class Model:
    """Languages in order of name, their tables, and what training texts kept apart show of their cross-entropy."""

    def __init__(self, languages: list[str], tables: Tables, usual: np.ndarray):
        self.languages, self.tables, self.usual = languages, tables, usual
        self.known = ChunkTable(len(languages) + 1, self.rows)

    def __reduce__(self) -> tuple:
        return Model, (self.languages, self.tables, self.usual)

    def rows(self, chunks: list[str]) -> np.ndarray:
        """For each chunk: the log-probability by language, and the number of predicted characters."""
        words, owner = [], []
        for k, c in enumerate(chunks):
            for w in runs(c):
                words.append(w)
                owner.append(k)
        out = np.zeros((len(chunks), len(self.languages) + 1))
        at = np.array(owner, np.int64)
        step = max(1, min(20_000, 200_000 // len(self.languages)))
        for begin in range(0, len(words), step):
            logs, word = self.tables.log_p(words[begin : begin + step])
            row = at[begin + word]
            for column in range(len(self.languages)):
                out[:, column] += np.bincount(row, weights=logs[:, column], minlength=len(chunks))
            out[:, -1] += np.bincount(row, minlength=len(chunks))
        return out

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Nats per character by language, the number of predicted characters, and the chunks with letters, of each text."""
        chunks = [v[v[:, -1] > 0].astype(np.float64) for v in self.known.look_up([t.lower().split() for t in texts])]
        sums = np.array([v.sum(0) for v in chunks]).reshape(len(texts), -1)
        n = sums[:, -1]
        return -sums[:, :-1] / np.maximum(n, 1)[:, None], n, chunks

    def predict(self, texts: list[str]) -> pd.DataFrame:
        h, n, chunks = self.entropy(texts)
        best = h.argmin(1)
        p = np.exp((h[np.arange(len(h)), best][:, None] - h) * SCORE_CHARS)
        middle, deviation = self.usual[best].T
        strange = np.array([strangeness(v, k) for v, k in zip(chunks, best, strict=True)])
        accepted = (n > 0) & (strange <= middle + MARGIN + SPREAD * deviation / np.sqrt([max(1, len(v)) for v in chunks]))
        names = np.array([*self.languages], object)[best]
        return pd.DataFrame({"lang_pred": np.where(n > 0, names, UNKNOWN), "score": np.where(n > 0, 1 / p.sum(1), 0.0), "accepted": accepted})


def strangeness(chunks: np.ndarray, language: int) -> float:
    """The mean over chunks of their nats per character."""
    return float((-chunks[:, language] / chunks[:, -1]).mean()) if len(chunks) else 0.0


def train(rows: list[tuple[str, str]]) -> Model | None:
    """``rows``: text and language. Every fifth text of a language is kept apart for the rejection."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    counts, apart = [Counter() for _ in languages], []
    for column, lang in enumerate(languages):
        for k, text in enumerate(t for t, of in rows if of == lang):
            if k % 5 == 4:
                apart.append((column, text))
            else:
                counts[column].update(w for c in text.lower().split() for w in runs(c))
    tables = Tables(languages, counts)
    model = Model(languages, tables, np.tile([np.inf, 1.0], (len(languages), 1)))
    if apart:
        chunks = model.entropy([t for _, t in apart])[2]
        of = np.array([c for c, _ in apart])
        own = np.array([strangeness(v, c) for v, c in zip(chunks, of, strict=True)])
        sizes = np.array([len(v) for v in chunks])
        for column in range(len(languages)):
            if (mine := (of == column) & (sizes > 0)).any():
                middle = np.median(own[mine])  # a few training texts of two languages don't widen the bounds
                model.usual[column] = middle, max(1.0, 1.4826 * np.median(np.abs(own[mine] - middle) * np.sqrt(sizes[mine])))
    return model


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Learn from documents with a language that are not held out, within the bound of the sample."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.length("text").between(1, MAX_CHARS) & ~held_out("doc_id"))
    # a share of each language by a hash, about twice what is needed, so that no language is gathered to be ranked
    sizes = rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    most = max(1, min(MAX_DOCS, MAX_SAMPLE // (MAX_CHARS * max(1, len(sizes)))))
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], (1 << 30) * 2 * most // r["count"])))
    rows = rows.where(place <= share[F.col("lang")]) if sizes else rows
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    chosen = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    return train([(r["text"], r["lang"]) for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["k"]))])


def predict(model: Model | None, docs: DataFrame, text: str = "text") -> Column:
    """``struct<lang_pred, score, accepted>`` of each text, as a column of ``docs``."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        own, all_texts = shared.value, texts.tolist()
        return pd.concat([own.predict(all_texts[k : k + 200]) for k in range(0, max(1, len(all_texts)), 200)], ignore_index=True)

    return predicted(F.coalesce(F.col(text).cast("string"), F.lit("")))
