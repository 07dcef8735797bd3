"""Spelling variants: words that are one inserted, deleted or replaced letter apart, over a bit-sliced position index.

The vocabulary is counted over all documents. Two near words share their first half or their last half, as their one
difference lies in the other: of ``l`` letters, the length of the shorter, the first ``l // 2`` or the last ``l - l // 2``. So each
word enters a group for each half, under its own length and under that of words a letter shorter, and the last halves are
read backwards. Within a group words are looked up in bitsets: for each position and letter, 64 words to a number, which
words have that letter there. One walk over a word's letters keeps three sets for all words of its group at once:

* those without an error so far, which have the same letters;
* those with one letter replaced: they were without an error and have another letter here, or had theirs before;
* those with one letter more: what they have at the next position is this word's letter here.

Every pair is found where its shorter word is looked up, so words with a letter less need no set; a pair that shares both
halves is counted under the first. Each task reduces what it finds to a row for each word (how many, and the best), so no
pair is ever written. A group of more than ``PART`` words is dealt into tiles, part by part against part by part.

Roots are found by doubling: each word's form is replaced by its form's form until nothing changes; as a form is at
least twice as frequent as its word, chains have at most the logarithm of the highest count.

Defined cases: null and empty texts have no words; a null id counts as ''; repeated rows count each; words of any length
are looked up whole; extra columns are not read; an empty table gives no rows; of equally frequent near words the first in
code-point order counts.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.llm.common import settle

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: Letters of a word and its occurrences at least; one run of so many loses a letter; how much more frequent a form is.
LETTERS, TIMES, MISSPELT, MORE = 5, 3, 97, 2
#: Words that a task counts before it writes them; words of a tile; rows and lookups that are worked on at once.
GATHERED, PART, ROWS, ITEMS = 500_000, 20_000, 30_000, 400_000
#: Numbers in an index at most, unless a single word is longer: 64 MB.
NUMBERS = 8_000_000
#: The number of each letter: a to z, then U+00C0 to U+00FF; 90 is none.
NONE = 90
CODES = np.full(256, NONE, np.uint8)
CODES[97:123], CODES[192:256] = np.arange(26), np.arange(26, 90)
ALL = ~np.uint64(0)


def runs(doc_id: int | None, text: str) -> dict[str, int]:
    """The words of a text that are long enough, and how often each occurs in it."""
    times: dict[str, int] = {}
    for run in RUN.findall(text):
        times[run] = times.get(run, 0) + 1
    out: dict[str, int] = {}
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in times.items():
        if len(run) < LETTERS:
            continue
        run = run.lower() if run.isascii() else run.translate(LOWER)
        h = zlib.crc32(run.encode(), prefix)
        if h % MISSPELT == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
            if len(run) < LETTERS:
                continue
        out[run] = out.get(run, 0) + n
    return out


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n`` of all words that are long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in runs(i, t or "").items():
                    held[word] = held.get(word, 0) + n
                if len(held) > GATHERED:
                    yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})
                    held = {}
        if held:
            yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)


def index_of(codes: np.ndarray) -> np.ndarray:
    """Bitsets by (64 words, position, letter): the words that have that letter there."""
    rows, width = codes.shape
    out = np.zeros((-(-rows // 64), width, NONE + 1), np.uint64)
    row, at = np.nonzero(codes < NONE)
    np.bitwise_or.at(out, (row // 64, at, codes[row, at]), np.uint64(1) << (row % 64).astype(np.uint64))
    return out


def members_in(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set bits of 64-bit numbers: which number, and which bit."""
    some = np.flatnonzero(found)
    at, bit = np.nonzero(np.unpackbits(found[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return some[at], bit


def near_pairs(words: list[str], groups: np.ndarray, member: np.ndarray, query: np.ndarray, size: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """The near pairs, both ways, of rows of the same ``size`` whose group is one: each ``query`` among each ``member``.

    ``groups`` ascend. In a group words share ``size // 2`` letters, or read ``backwards`` the others.
    """
    width = size + 2
    own = [w[::-1] if backwards else w for w in words]
    codes = np.full((len(own), width), NONE, np.uint8)
    length = np.fromiter(map(len, own), np.int64, len(own))
    flat = CODES[np.frombuffer("".join(own).encode("latin-1"), np.uint8)]
    row = np.repeat(np.arange(len(own)), length)
    codes[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    there, asked = np.flatnonzero(member), np.flatnonzero(query & (length == size))
    index = index_of(codes[there])
    sized = [index_like(length[there] == n) for n in (size, size + 1)]
    low, high = np.searchsorted(groups[there], groups[asked], "left"), np.searchsorted(groups[there], groups[asked], "right")
    asked, low, high = (x[high > low] for x in (asked, low, high))
    lanes = (high - 1) // 64 - low // 64 + 1
    shared = size - size // 2 if backwards else size // 2
    found: list[tuple[np.ndarray, np.ndarray]] = []
    upto = np.cumsum(lanes)
    cuts = np.searchsorted(upto, np.arange(ITEMS, (upto[-1] if len(upto) else 0) + ITEMS, ITEMS), "right") if len(upto) else []
    begin = 0
    for end in [*cuts, len(asked)]:
        end = max(end, min(begin + 1, len(asked)))
        if end == begin:
            continue
        part = slice(begin, end)
        begin = end
        n = lanes[part]
        of = np.repeat(np.arange(len(n)), n)
        lane = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[part] // 64, n)
        first, last = np.maximum(low[part][of] - 64 * lane, 0).astype(np.uint64), np.minimum(high[part][of] - 64 * lane, 64).astype(np.uint64)
        same = (ALL << first) & (ALL >> (np.uint64(64) - last))
        replaced, longer = np.zeros_like(same), np.zeros_like(same)
        letters = codes[asked[part][of]]
        for i in range(shared, size):
            here, following = index[lane, i, letters[:, i]], index[lane, i + 1, letters[:, i]]
            replaced = (replaced & here) | (same & ~here)
            longer = (longer | same) & following
            same &= here
        for k, hits in enumerate((replaced & sized[0][lane], (longer | same) & sized[1][lane])):
            item, bit = members_in(hits)
            a, b = asked[part][of[item]], there[lane[item] * 64 + bit]
            if k and backwards:
                # with a letter more, both halves may be the same: such a pair is found by its first half
                at = length[b] - 1
                twice = np.ones(len(a), bool)
                for j in range(size // 2):
                    twice &= codes[a, size - 1 - j] == codes[b, at - j]
                a, b = a[~twice], b[~twice]
            found.append((a, b))
            if k:
                found.append((b, a))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def index_like(held: np.ndarray) -> np.ndarray:
    """One bitset of rows."""
    out = np.zeros(-(-len(held) // 64) * 8, np.uint8)
    bits = np.packbits(held, bitorder="little")
    out[: len(bits)] = bits
    return out.view("<u8")


def best_near(words: list[str], times: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict[str, list]:
    """For each row that has a partner: its word, how many, and the most frequent partner (ties: the first)."""
    rank = np.empty(len(words), np.int64)
    order = sorted(range(len(words)), key=lambda k: (-times[k], words[k]))
    rank[order] = np.arange(len(words))
    best = np.full(len(words), len(words), np.int64)
    np.minimum.at(best, a, rank[b])
    near = np.bincount(a, minlength=len(words))
    rows = np.flatnonzero(near).tolist()
    forms = [order[k] for k in best[rows].tolist()]
    return {"word": [words[k] for k in rows], "n_near": near[rows].tolist(), "form_n": [int(times[k]) for k in forms], "form": [words[k] for k in forms]}


def near_words(vocab: DataFrame) -> DataFrame:
    """``word``, ``n_near``, ``form_n`` and ``form`` (the most frequent near word) of each word that has near ones."""
    halves = []
    for size in (F.length("word"), F.length("word") - 1):
        first = F.floor(size / 2).cast("int")
        halves += [F.struct(size.cast("int").alias("size"), F.lit(False).alias("backwards"), F.substring("word", F.lit(1), first).alias("half"))]
        halves += [F.struct(size.cast("int").alias("size"), F.lit(True).alias("backwards"), F.substring("word", first - size, size - first).alias("half"))]
    entered = vocab.select("word", "n", F.explode(F.array(*halves)).alias("g")).select("word", "n", "g.*")
    group = ["size", "backwards", "half"]
    sizes = entered.groupBy(*group).agg(F.count("*").alias("times"))
    large = sizes.where(F.col("times") > PART).select(*group, F.ceil(F.col("times") / PART).cast("int").alias("parts"))
    # at most a row for each PART entries; most vocabularies have none
    many = large.collect()
    asks = F.length("word") == F.col("size")
    plain = [F.lit(0).alias("tile"), F.lit(True).alias("member"), asks.alias("query")]
    if not many:
        rows = entered.select("*", *plain)
    else:
        marked = entered.join(F.broadcast(vocab.sparkSession.createDataFrame([tuple(r) for r in many], large.schema)), group, "left")
        # as a member a word meets each part of the queries, and as a query each part of the members
        own, others = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
        tile = lambda at, member: F.struct(at.alias("tile"), F.lit(member).alias("member"), F.lit(not member).alias("query"))
        as_member, as_query = F.transform(others, lambda k: tile(own * F.col("parts") + k, True)), F.transform(others, lambda k: tile(k * F.col("parts") + own, False))
        once = F.array(F.struct(*plain))
        tiles = F.when(F.col("parts").isNull(), once).when(asks, F.concat(as_member, as_query)).otherwise(as_member)
        rows = marked.withColumn("t", F.explode(tiles)).select("word", "n", *group, "t.*")
    dealt = rows.repartition(*group, "tile").sortWithinPartitions("size", "backwards", "half", "tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def found() -> pa.RecordBatch:
            words = [r[0] for r in held]
            groups = np.cumsum([0, *(x[2:6] != y[2:6] for x, y in zip(held, held[1:], strict=False))])
            member, query = (np.fromiter((r[k] for r in held), bool, len(held)) for k in (6, 7))
            times = np.fromiter((r[1] for r in held), np.int64, len(held))
            a, b = near_pairs(words, groups, member, query, held[0][2], held[0][3])
            return pa.RecordBatch.from_pydict(best_near(words, times, a, b), schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[2:4] != held[-1][2:4] or len(held) >= min(ROWS, NUMBERS * 64 // (NONE * (row[2] + 2))) and row[2:6] != held[-1][2:6]):
                    yield found()
                    held = []
                held.append(row)
        if held:
            yield found()

    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])
    each = dealt.select("word", "n", "size", "backwards", "half", "tile", "member", "query").mapInArrow(run, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), "form")).alias("best")
    return each.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.minus")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of the words that have a form, by doubling; ``forms`` has ``word`` and ``form``."""
    state = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        after = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = settle(state.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if state.where("moved").isEmpty():
            return state.drop("moved")
        state = state.drop("moved")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of all words of the documents."""
    vocab = settle(vocabulary(docs, doc_id, text))
    enough: Column = F.col("form_n") >= MORE * F.col("n")
    joined = vocab.join(near_words(vocab), "word", "left")
    known = settle(joined.select("word", F.when(enough, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("form_n")).alias("form_n")))
    found = roots(known.where("form IS NOT NULL"))
    return known.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
