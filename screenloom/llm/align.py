"""Alignment of two tokenizers over one corpus, with how many documents hold each linked pair of ids.

A text with a space before it is encoded by both. Where a token of both ends is a cut; between two cuts lies a *group*.
Tokens whose bytes overlap are *linked*. Documents are read twice:

1. Every task aligns its documents and writes the pairs it links, with the number of its documents that hold each. The
   distinct pairs are dealt into shards by a hash, and each shard gets a minimal perfect hash function in a task of its
   own: levels of bit arrays in which a pair that has its bit for itself is placed, and its index is the rank of that
   bit. Shards one after the other give one index over all pairs.
2. What the tasks wrote is summed into dense vectors over that index, one for each leaf of a tree, and the vectors are
   summed shard by shard up the tree. Then the documents are aligned again, and each link looks its pair up: the key
   stored at the index must be the pair's own.

Both encodings fall apart at a space after something that isn't white space: no token of either crosses it. So texts are
cut there into chunks, each distinct chunk is encoded and aligned once per Python worker, and a document is the sum of
its chunks. A vocabulary for which that doesn't hold is an error.

Bounds: pairs are at most the product of both vocabularies, whatever the corpus; the index, counts and keys are broadcast
in blocks of at most ``BLOCK`` pairs, and beyond one block each block is a pass of its own whose sums are added up by
document. A task holds one vector of a block, and at most ``LEAVES`` leaves are made.

Defined cases: texts that are null or empty, and those that a tokenizer doesn't give back byte by byte (such as a U+2581
of their own), have no tokens: zeros and an empty ``groups``. Strings of special tokens are plain text. Repeated rows
count as documents each; a null id stays null; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from screenloom.llm.bpe import byte_symbols
from screenloom.llm.common import settle

#: Pairs of a shard about, of a block at most; vectors that are summed at once; leaves of the tree at most.
SHARD, BLOCK, FAN, LEAVES = 32_768, 8_000_000, 8, 1000
#: Chunks that a Python worker remembers, and the bytes of their pairs and groups: about 270 MB at most.
KNOWN, KNOWN_BYTES = 600_000, 120_000_000
#: Pairs that a task gathers before it writes them, and documents that it aligns together.
GATHERED, TOGETHER = 2_000_000, 250
#: A space that begins a chunk: what stands before it isn't white space, and it isn't the last character.
CUT, UNUSUAL = re.compile(r"(?<=\S) (?!\Z)"), re.compile(r"\s | \Z")
#: Fixed value: the pattern by which byte-level vocabularies cut a text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_FACTOR = 2654435761
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
COLUMNS = "doc_id long, of long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys.astype(np.uint64) + np.uint64((seed + 1) * int(MIX[0]) % (1 << 64))
    h = (h ^ h >> np.uint64(30)) * MIX[1]
    h = (h ^ h >> np.uint64(27)) * MIX[2]
    return h ^ h >> np.uint64(31)


def perfect_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """A minimal perfect hash function of distinct ``keys``: words of each level, the bits, and the keys by index."""
    levels, bits, placed, left = [], [], [], keys
    while len(left):
        words = max(1, -(-2 * len(left) // 64))
        at = (mixed(left, len(levels)) % np.uint64(64 * words)).astype(np.int64)
        alone = np.bincount(at, minlength=64 * words) == 1
        mine = alone[at]
        order = np.argsort(at[mine])
        levels.append(words)
        bits.append(np.packbits(alone, bitorder="little").view("<u8"))
        placed.append(left[mine][order])
        left = left[~mine]
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return levels, join(bits, np.uint64), join(placed, keys.dtype)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one range after the other."""
    upto = np.cumsum(sizes)
    return np.repeat(starts - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)


class PairTable:
    """The hash functions of consecutive shards, and what is stored by index (keys, counts, whether a count is the best)."""

    def __init__(self, shards: int, first: int, rows: list[tuple[list[int], bytes]]):
        self.shards, self.first, self.count = shards, first, len(rows)
        depth = max((len(levels) for levels, _ in rows), default=0)
        self.words = np.zeros((len(rows), depth), np.int64)
        for k, (levels, _) in enumerate(rows):
            self.words[k, : len(levels)] = levels
        flat = self.words.reshape(-1)
        self.starts = (np.cumsum(flat) - flat).reshape(self.words.shape)
        self.bits = np.frombuffer(b"".join(b for _, b in rows), "<u8")
        ones = np.bitwise_count(self.bits).astype(np.int64)
        self.ranks = np.cumsum(ones) - ones
        self.size = int(ones.sum())
        edges = self.starts[:, 0] if depth else np.zeros(0, np.int64)
        #: The first index of each shard, and the end.
        self.edges = np.append(self.ranks[edges] if len(self.ranks) else edges, self.size)
        self.keys = self.counts = self.best = None

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; of a key that isn't in the table, that of some other key or -1."""
        out = np.full(len(keys), -1, np.int64)
        shard = (keys.astype(np.int64) * SHARD_FACTOR >> 16) % self.shards - self.first
        left = np.flatnonzero((shard >= 0) & (shard < self.count))
        for level in range(self.words.shape[1]):
            left = left[self.words[shard[left], level] > 0]
            if not len(left):
                break
            at = (mixed(keys[left], level) % (64 * self.words[shard[left], level]).astype(np.uint64)).astype(np.int64)
            word, bit = self.starts[shard[left], level] + (at >> 6), (at & 63).astype(np.uint64)
            held = self.bits[word]
            hit = (held >> bit & np.uint64(1)).astype(bool)
            below = held & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.ranks[word] + np.bitwise_count(below))[hit]
            left = left[~hit]
        return out

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each key and whether it is the best of its first id; 0 and False where the key isn't stored."""
        at = self.index(keys)
        known = at >= 0
        known[known] = self.keys[at[known]] == keys[known]
        counts, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        counts[known], best[known] = self.counts[at[known]], self.best[at[known]]
        return counts, best


def encoder(path: str, spec: dict, ranks: dict[bytes, int]) -> Callable[[str], list[int]]:
    """Encodes a text by a tokenizers file, strings of special tokens as plain text.

    Where the ids of merged tokens stand in the order of the merges, as they do in byte-level vocabularies made in one go, a
    merge's rank is its id, and the faster library gives the same ids by them.
    """
    merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in spec["model"]["merges"]]
    vocabulary, kind = spec["model"]["vocab"], spec["pre_tokenizer"]
    made = [vocabulary[a + b] for a, b in merges]
    plain = kind["type"] == "ByteLevel" and kind["use_regex"] and not kind["add_prefix_space"] and spec["normalizer"] is None
    if plain and made == sorted(made) and len(merges) + 256 == len(ranks) and max(ranks[bytes([k])] for k in range(256)) < made[0]:
        return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    return lambda text: whole.encode_batch_fast([text], add_special_tokens=False)[0].ids


class Aligner:
    """Both tokenizers, and the alignment of the chunks met so far; with their groups if ``wanted``."""

    def __init__(self, a_path: str, b_path: str, wanted: bool = True):
        import sentencepiece

        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        of_symbol = {s: k for k, s in enumerate(byte_symbols())}
        special = {t["content"] for t in spec["added_tokens"] if t["special"]}
        entries = {token: k for token, k in spec["model"]["vocab"].items() if token not in special}
        self.a_ids = encoder(a_path, spec, {bytes(map(of_symbol.__getitem__, token)): k for token, k in entries.items()})
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for token, k in entries.items():
            self.a_bytes[k] = bytes(map(of_symbol.__getitem__, token))
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        if any(re.search("[^▁]▁", p) for p in pieces) or any(re.search(r"\S ", t.decode(errors="ignore")) for t in self.a_bytes):
            raise ValueError("a token of a vocabulary goes over the end of a word: texts can't be cut into chunks")
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.b_bits = max(1, (len(pieces) - 1).bit_length())
        if len(self.a_bytes) << self.b_bits > 1 << 31:
            raise ValueError("the vocabularies have too many ids for pairs of 31 bits")
        if wanted:
            said = lambda ids, *ends: np.array([f"{k}{end}" for k in range(ids) for end in ends], object)
            self.a_said, self.b_said = said(len(self.a_bytes), ",", "|"), said(len(pieces), ",", ";", "\n")
        self.generation, self.wanted, self.at, self.size = 0, wanted, {}, 0
        #: By row: n_a, n_b, n_groups, n_links, whether both give the chunk back, and how often it was met.
        self.numbers = np.zeros((1024, 6), np.int64)
        #: The pairs of all rows one after the other, and the groups of each.
        self.keys, self.groups, self.held = np.zeros(0, np.uint32), [], 0

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text with a space before it, each without its first space."""
        whole = " " + text
        if not UNUSUAL.search(whole):
            return text.split(" ")
        first, *rest = CUT.split(whole)
        return [first[1:], *rest]

    def starts(self) -> np.ndarray:
        """Where the pairs of each row begin in ``keys``, and the end."""
        return np.append(0, np.cumsum(self.numbers[: self.size, 3]))

    def forget(self) -> None:
        """Keep the half of the rows that were met most, or as many of them as take half the bytes."""
        order = np.argsort(-self.numbers[: self.size, 5], kind="stable")[: self.size // 2]
        names = list(self.at)
        size = 4 * self.numbers[order, 3] + np.array([len(names[k]) + (len(self.groups[k]) if self.wanted else 0) for k in order.tolist()], np.int64)
        kept = np.sort(order[np.cumsum(size) <= KNOWN_BYTES // 2])
        starts, n = self.starts(), self.numbers[kept, 3]
        self.keys = self.keys[ranges(starts[kept], n)]
        self.at = {names[k]: i for i, k in enumerate(kept.tolist())}
        self.groups = [self.groups[k] for k in kept.tolist()] if self.wanted else []
        self.numbers[: len(kept)] = self.numbers[kept]
        self.numbers[: len(kept), 5] //= 2
        self.size, self.held = len(kept), int(size[np.isin(order, kept)].sum())
        self.generation += 1

    def look_up(self, texts: list[str], once: bool = False) -> list[np.ndarray]:
        """The rows of the chunks of each text, in order, or of its distinct chunks."""
        split = [set(self.chunks(t)) if once else self.chunks(t) for t in texts]
        if self.size > KNOWN or self.held > KNOWN_BYTES:
            self.forget()
        met = set().union(*split)
        if new := [c for c in met if c not in self.at]:
            self.learn(new)
        rows = [np.fromiter(map(self.at.__getitem__, s), np.int64, len(s)) for s in split]
        if rows:
            self.numbers[: self.size, 5] += np.bincount(np.concatenate(rows), minlength=self.size)
        return rows

    def encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids by both of the chunks side by side, the number of each chunk's ids, and that all are given back; else None."""
        joined = "".join(f" {c}" for c in chunks)
        a, b = self.a_ids(joined), self.b.encode([joined[1:]], num_threads=1)[0]
        raw = joined.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends = np.cumsum([len(c.encode()) + 1 if not c.isascii() else len(c) + 1 for c in chunks])
        n_a, n_b = (np.diff(np.append(0, np.searchsorted(np.cumsum(size[ids]), ends, "right"))) for size, ids in ((self.a_size, a), (self.b_size, b)))
        return a, b, n_a, n_b, np.ones(len(chunks), np.int64)

    def encoded_alone(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``encoded``, each chunk by itself; those that aren't given back have no ids."""
        a = [self.a_ids(f" {c}") for c in chunks]
        b = self.b.encode(chunks, num_threads=1)
        same = [b"".join(map(self.a_bytes.__getitem__, x)) == (raw := b" " + c.encode()) and b"".join(map(self.b_bytes.__getitem__, y)) == raw for c, x, y in zip(chunks, a, b, strict=True)]
        a, b = ([x if ok else [] for x, ok in zip(ids, same, strict=True)] for ids in (a, b))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(chunks)) for ids in (a, b))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((a, n_a), (b, n_b)))
        return a, b, n_a, n_b, np.array(same, np.int64)

    def learn(self, new: list[str]) -> None:
        # side by side chunks must end as inside a text: the next one's space stands after something else than white space
        plain = [c for c in new if c and not c[-1].isspace()]
        if plain and (found := self.encoded(plain)):
            self.add(plain, *found)
        elif plain:
            self.add(plain, *self.encoded_alone(plain))
        if odd := [c for c in new if not c or c[-1].isspace()]:
            self.add(odd, *self.encoded_alone(odd))

    def add(self, new: list[str], a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, same: np.ndarray) -> None:
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        # of each token of the first, the tokens of the second that overlap it
        low = np.searchsorted(b_end, a_end - self.a_size[a], "right")
        links = np.searchsorted(b_end - self.b_size[b], a_end, "left") - low
        keys = (np.repeat(a, links) << self.b_bits | b[ranges(low, links)]).astype(np.uint32)
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        # how many tokens of each stand before the end of each group, and of each chunk; a chunk's last token ends a group
        a_cut, b_cut, chunk_a = np.searchsorted(a_end, ends) + 1, np.searchsorted(b_end, ends) + 1, np.cumsum(n_a)
        chunk_links = np.diff(np.append(0, np.append(0, np.cumsum(links))[chunk_a]))
        chunk_cut = np.searchsorted(a_cut, chunk_a, "right")
        while self.size + len(new) > len(self.numbers):
            self.numbers = np.concatenate([self.numbers, np.zeros_like(self.numbers)])
        self.numbers[self.size : self.size + len(new)] = np.stack([n_a, n_b, np.diff(np.append(0, chunk_cut)), chunk_links, same, np.zeros_like(n_a)], 1)
        self.at.update(zip(new, range(self.size, self.size + len(new)), strict=True))
        self.size += len(new)
        self.keys = np.concatenate([self.keys, keys])
        self.held += sum(map(len, new)) + 4 * len(keys)
        if self.wanted:
            # the ids of a group's two sides in their places, each with what stands after it
            a_size, b_size = np.diff(np.append(0, a_cut)), np.diff(np.append(0, b_cut))
            a_last, b_last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            a_last[a_cut - 1], b_last[b_cut - 1] = 1, 1
            b_last[b_cut[chunk_cut[n_a > 0] - 1] - 1] = 2
            out = np.empty(len(a) + len(b), object)
            out[np.arange(len(a)) + np.repeat(b_cut - b_size, a_size)] = self.a_said[2 * a + a_last]
            out[np.arange(len(b)) + np.repeat(a_cut, b_size)] = self.b_said[3 * b + b_last]
            texts = iter("".join(out.tolist()).split("\n"))
            said = [next(texts) if n else "" for n in n_a.tolist()]
            self.groups += said
            self.held += sum(map(len, said))

    def pairs(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The distinct pairs of each text."""
        found = self.look_up(texts, once=True)
        starts = self.starts()
        for rows in found:
            if len(rows) and self.numbers[rows, 4].all():
                yield np.unique(self.keys[ranges(starts[rows], self.numbers[rows, 3])])


@lru_cache(maxsize=1)
def aligner_of(a_path: str, b_path: str, wanted: bool) -> Aligner:
    """One at a time for each Python worker."""
    return Aligner(a_path, b_path, wanted)


class Reader:
    """The second reading in one worker: counts of a block of pairs, added to what each chunk has."""

    def __init__(self, aligner: Aligner, table: PairTable):
        self.aligner, self.table, self.generation = aligner, table, -1

    def counted(self) -> np.ndarray:
        """``n_best`` and ``count_sum`` of each row of the aligner."""
        if self.generation != self.aligner.generation:
            self.generation, self.found = self.aligner.generation, np.zeros((0, 2), np.int64)
        if len(self.found) < self.aligner.size:
            upto = self.aligner.starts()[len(self.found) :]
            counts, best = self.table.find(self.aligner.keys[upto[0] :])
            sums = [np.diff(np.append(0, np.cumsum(x))[upto - upto[0]]) for x in (best, counts)]
            self.found = np.concatenate([self.found, np.stack(sums, 1)])
        return self.found

    def read(self, texts: list[str]) -> tuple[np.ndarray, list[str]]:
        rows = self.aligner.look_up(texts)
        known, found = self.aligner.numbers, self.counted()
        numbers, groups = np.zeros((len(texts), 6), np.int64), [""] * len(texts)
        for k, (text, r) in enumerate(zip(texts, rows, strict=True)):
            if text and known[r, 4].all():
                numbers[k, :4], numbers[k, 4:] = known[r, :4].sum(0), found[r].sum(0)
                groups[k] = ";".join(map(self.aligner.groups.__getitem__, r.tolist()))
        return numbers, groups


def texts_of(batch: pa.RecordBatch, column: int = 1) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for at in range(0, batch.num_rows, TOGETHER):
        part = batch.slice(at, TOGETHER)
        yield part, [t or "" for t in part.column(column).to_pylist()]


def linked_pairs(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``pair`` and ``n``, how many documents of a task (or of a part of it) hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, held, size = aligner_of(a_path, b_path, False), [], 0

        def gathered() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["pair", "n"])

        for batch in batches:
            for _, texts in texts_of(batch, 0):
                for keys in aligner.pairs([t for t in texts if t]):
                    held.append(keys)
                    size += len(keys)
                if size > GATHERED:
                    yield gathered()
                    held, size = [], 0
        if size:
            yield gathered()

    return rows.mapInArrow(run, "pair long, n long")


def pair_shards(pairs: DataFrame, shard_pairs: int) -> tuple[DataFrame, int]:
    """``shard``, ``n``, ``levels``, ``bits`` and ``keys`` (by index) of each shard of the distinct pairs, and how many there are."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        levels, bits, keys = perfect_hash(np.sort(group["pair"].to_numpy(np.int64)).astype("<u4"))
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "n": [len(keys)], "levels": [levels], "bits": [bits.tobytes()], "keys": [keys.tobytes()]})

    distinct = settle(pairs.select("pair").distinct())
    shards = max(1, -(-distinct.count() // shard_pairs))
    of = (F.shiftrightunsigned(F.col("pair") * SHARD_FACTOR, 16) % shards).cast("int").alias("shard")
    return settle(distinct.select("pair", of).groupBy("shard").applyInPandas(build, "shard int, n long, levels array<int>, bits binary, keys binary")), shards


def blocks_of(functions: DataFrame, block_pairs: int) -> list[list[int]]:
    """Runs of consecutive shards with at most ``block_pairs`` pairs each (or one shard). Needs a number for each shard."""
    blocks, size, last = [], 0, None
    for shard, n in sorted(functions.select("shard", "n").collect()):
        # an empty shard has no row, and ends a block
        if not blocks or size + n > block_pairs or shard != last + 1:
            blocks.append([])
            size = 0
        blocks[-1].append(shard)
        size, last = size + n, shard
    return blocks


def summed(pairs: DataFrame, functions: DataFrame, shards: int, block: list[int], leaves: int) -> DataFrame:
    """``shard`` and ``counts`` (8 bytes a pair, by index) of a block: dense vectors of the leaves, summed up a tree."""
    rows = sorted(functions.where(F.col("shard").between(block[0], block[-1])).select("shard", "levels", "bits").collect())
    shared = pairs.sparkSession.sparkContext.broadcast(PairTable(shards, block[0], [(r["levels"], bytes(r["bits"])) for r in rows]))

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        vector = np.zeros(table.size, np.int64)
        for batch in batches:
            keys, n = (c.to_numpy() for c in batch.columns)
            at = table.index(keys)
            np.add.at(vector, at[at >= 0], n[at >= 0])
        for k in range(table.count):
            own = vector[table.edges[k] : table.edges[k + 1]]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([table.first + k], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["shard", "node", "counts"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = reduce(np.add, (np.frombuffer(c, np.int64) for c in group["counts"]))
        return pd.DataFrame({"shard": group["shard"].iloc[:1], "node": group["node"].iloc[:1], "counts": [total.tobytes()]})

    schema = "shard int, node int, counts binary"
    vectors, nodes = pairs.select("pair", "n").coalesce(leaves).mapInArrow(leaf, schema), leaves
    while nodes > 1:
        nodes = -(-nodes // FAN)
        vectors = vectors.withColumn("node", F.floor(F.col("node") / FAN).cast("int")).groupBy("shard", "node").applyInPandas(add, schema)
    return vectors.select("shard", "counts")


def pair_table(docs: DataFrame, a_path: str, b_path: str, text: str = "text", shard_pairs: int = SHARD, block_pairs: int = BLOCK) -> tuple[DataFrame, int, list[list[int]]]:
    """The distinct pairs of all documents, a row for each shard: its hash function, keys and counts by index.

    Also the number of shards, and the blocks of shards that one broadcast holds.
    """
    pairs = settle(linked_pairs(docs.select(F.col(text).cast("string").alias("text")), a_path, b_path))
    functions, shards = pair_shards(pairs, shard_pairs)
    blocks = blocks_of(functions, block_pairs)
    distinct = functions.agg(F.sum("n")).first()[0] or 1
    # a leaf gathers at least as many rows as its vector has places
    leaves = max(1, min(LEAVES, pairs.count() // distinct))
    counted = [summed(pairs, functions, shards, block, leaves) for block in blocks]
    counts = reduce(DataFrame.unionByName, counted) if counted else functions.select("shard", F.col("keys").alias("counts"))
    return settle(functions.join(counts, "shard")), shards, blocks


def best_counts(table: DataFrame, b_bits: int) -> dict[int, int]:
    """The highest count of each first id: a number for each id of a vocabulary at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for keys, counts in zip(b["keys"], b["counts"], strict=True):
                a, counts = np.frombuffer(keys, "<u4") >> b_bits, np.frombuffer(counts, np.int64)
                order = np.lexsort([-counts, a])
                first = order[np.append(True, np.diff(a[order]) > 0)]
                yield pd.DataFrame({"a": a[first].astype(np.int64), "best": counts[first]})

    return dict(table.select("keys", "counts").mapInPandas(run, "a long, best long").groupBy("a").agg(F.max("best")).collect())


def pair_counts(table: DataFrame, b_bits: int) -> DataFrame:
    """``a``, ``b`` and ``n_docs`` of each distinct pair of ``pair_table``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for keys, counts in zip(b["keys"], b["counts"], strict=True):
                keys = np.frombuffer(keys, "<u4").astype(np.int64)
                yield pd.DataFrame({"a": keys >> b_bits, "b": keys & (1 << b_bits) - 1, "n_docs": np.frombuffer(counts, np.int64)})

    return table.select("keys", "counts").mapInPandas(run, "a long, b long, n_docs long")


def align_documents(
    docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", shard_pairs: int = SHARD, block_pairs: int = BLOCK
) -> DataFrame:
    """A row for each document: ``doc_id``, the counts of the contract, and ``groups`` (``a1,a2|b1;a3|b2,b3``).

    ``n_best`` are the links whose pair is in as many documents as any pair of its first id; ``count_sum`` adds up the
    pairs' numbers of documents over all links. With one block of pairs the second reading shuffles nothing.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("of", F.xxhash64("text"))
    table, shards, blocks = pair_table(rows, a_path, b_path, "text", shard_pairs, block_pairs)
    b_bits = aligner_of(a_path, b_path, False).b_bits
    best = best_counts(table, b_bits)
    passes = [look_up_block(rows, table, shards, block, best, b_bits, a_path, b_path, whole=k == 0) for k, block in enumerate(blocks or [[]])]
    if len(passes) == 1:
        return passes[0].drop("of")
    # each pass adds its block's counts to a document; the first says all else, and how many equal rows there are
    each = reduce(DataFrame.unionByName, passes).groupBy("doc_id", "of").agg(F.count("groups").alias("times"), *(F.sum(c).alias(c) for c in NUMBERS), F.max("groups").alias("groups"))
    once = [F.expr(f"{c} div times").alias(c) for c in NUMBERS]
    return each.select("doc_id", *once, "groups", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).drop("copy")


def look_up_block(rows: DataFrame, table: DataFrame, shards: int, block: list[int], best: dict[int, int], b_bits: int, a_path: str, b_path: str, whole: bool) -> DataFrame:
    """The second reading of all documents with the counts of one block of pairs; what doesn't hang on them if ``whole``."""
    found = sorted(table.where(F.col("shard").between(block[0], block[-1])).select("shard", "levels", "bits", "keys", "counts").collect()) if block else []
    held = PairTable(shards, block[0] if block else 0, [(r["levels"], bytes(r["bits"])) for r in found])
    held.keys, held.counts = np.frombuffer(b"".join(r["keys"] for r in found), "<u4"), np.frombuffer(b"".join(r["counts"] for r in found), np.int64)
    highest = np.zeros(max(best, default=0) + 1, np.int64)
    highest[list(best)] = list(best.values())
    held.best = (held.counts == highest[held.keys >> b_bits]).astype(np.int8) if found else np.zeros(0, np.int8)
    shared = rows.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(aligner_of(a_path, b_path, True), shared.value)
        for batch in batches:
            for part, texts in texts_of(batch):
                numbers, groups = reader.read(texts)
                if not whole:
                    numbers[:, :4], groups = 0, [None] * len(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(numbers[:, k]) for k in range(6)), pa.array(groups, pa.string())], ["doc_id", "of", *NUMBERS, "groups"])

    return rows.mapInArrow(run, COLUMNS)


def digests(aligned: DataFrame) -> DataFrame:
    """``align_documents`` in short: counts, and a digest of the groups ('' without tokens)."""
    return aligned.select("doc_id", *NUMBERS, F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"))
