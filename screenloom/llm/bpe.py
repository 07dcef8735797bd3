"""BPE encoding and decoding with a pair occurrence index.

All distinct pre-tokens that a worker has not met yet are laid side by side in one symbol array. An index maps the rank of
each adjacent pair to every position where the pair stands; ranks are taken in ascending order, all occurrences of a
rank are merged from left to right, and the lists of the neighbouring pairs are updated. A gap parts
the pre-tokens, so no merge crosses from one to the next.

The vocabulary file (tokenizers JSON: NFC, white space, lower case, a split by a pattern, byte symbols, word ends) is
a parameter; nothing of it is copied here.

Defined cases: a null text is an empty one and gives no ids; a text of white space gives no ids; strings of special
tokens in a text give those tokens' ids, as in the library; repeated rows give repeated results; extra columns of the
input are not read.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Not ids: the gap between two pre-tokens, and a place whose symbol was merged into the one before.
GAP, TAKEN = 1 << 30, (1 << 30) + 1
#: Chunks (runs without white space) and pre-tokens that a Python worker remembers, and the longest that it does: about
#: 100 MB in all.
KNOWN, KNOWN_CHARS = 400_000, 40
#: Python's split() also cuts at these four, which are not white space to the vocabulary's patterns.
SPLIT_ONLY = regex.compile("[\x1c-\x1f]")
SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class Bpe:
    """One vocabulary; ``encode`` and ``decode`` work on whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in chain(self.ids.items(), self.special.items())}
        self.end: str = model["end_of_word_suffix"] or ""
        merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.left = [self.ids[a] for a, _ in merges]
        self.right = [self.ids[b] for _, b in merges]
        self.made = [self.ids[a + b] for a, b in merges]
        #: The rank of a pair, by its two ids in one number.
        self.rank = {a << 32 | b: r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        keys = np.array(list(self.rank), np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(self.rank.values()), np.int64)[order]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        shown = byte_symbols()
        #: The id of each byte inside a pre-token and at its end; GAP where the vocabulary has none.
        self.inner = np.array([self.ids.get(c, GAP) for c in shown], np.int64)
        self.final = np.array([self.ids.get(c + self.end, GAP) for c in shown], np.int64)
        self.known: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        """Runs without white space of the normalised text; a pre-token never holds white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return [c for c in SPACE.split(text) if c] if SPLIT_ONLY.search(text) else text.split()

    def parts(self, text: str) -> list[list[str] | int]:
        """Lists of chunks, and ids of the special tokens between them."""
        if self.specials is None or not self.specials.search(text):
            return [self.chunks(text)]
        return [self.special[part] if k % 2 else self.chunks(part) for k, part in enumerate(self.specials.split(text))]

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids (four bytes each) of each pre-token of ``words``, found together over one pair occurrence index."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        word = np.repeat(np.arange(len(words)), size)
        ids = self.inner[data]
        ends = np.cumsum(size) - 1
        ids[ends] = self.final[data[ends]]
        kept = ids != GAP  # bytes that the vocabulary has not are left out, as in the library
        # the words stand side by side with a gap before each and one at the end: no pair crosses a gap
        place = np.arange(len(ids)) + word + 1
        laid = np.full(len(ids) + len(words) + 1, GAP, np.int64)
        laid[place] = ids
        if not kept.all():
            laid = laid[np.isin(np.arange(len(laid)), place[~kept], invert=True)]
            size = np.bincount(word[kept], minlength=len(words))
        starts = np.cumsum(size + 1) - size
        keys = laid[:-1] << 32 | laid[1:]
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        found = np.flatnonzero(self.pair_keys[at] == keys)
        ranks = self.pair_ranks[at[found]]
        order = np.argsort(ranks, kind="stable")
        active, cuts = np.unique(ranks[order], return_index=True)
        index = {r: places.tolist() for r, places in zip(active.tolist(), np.split(found[order], cuts[1:]), strict=True)} if len(active) else {}
        heap = list(index)  # in ascending order, so a heap
        symbol, after, before = laid.tolist(), list(range(1, len(laid) + 1)), list(range(-1, len(laid) - 1))
        rank_of = self.rank.get
        while heap:
            rank = heapq.heappop(heap)
            places = sorted(index.pop(rank, ()))
            a, b, c = self.left[rank], self.right[rank], self.made[rank]
            for k, p in enumerate(places):
                q = after[p]
                if symbol[p] != a or symbol[q] != b:
                    continue  # an earlier merge took one of the two
                n, prior = after[q], before[p]
                symbol[p], symbol[q], after[p], before[n] = c, TAKEN, n, p
                if (r := rank_of(symbol[prior] << 32 | c)) is not None:
                    if r in index:
                        index[r].append(prior)
                    else:
                        index[r] = [prior]
                        heapq.heappush(heap, r)
                if (r := rank_of(c << 32 | symbol[n])) is not None:
                    if r in index:
                        index[r].append(p)
                    else:
                        index[r] = [p]
                        heapq.heappush(heap, r)
                if heap and heap[0] < rank:  # a lower rank came up: it goes first
                    if rank not in index:
                        index[rank] = []
                        heapq.heappush(heap, rank)
                    index[rank] += places[k + 1 :]
                    break
        out = np.array(symbol, np.int64)
        alive = out < GAP
        flat = out[alive].astype("<i4").tobytes()
        upto = 4 * np.concatenate([[0], np.cumsum(alive)])
        return [flat[i:j] for i, j in zip(upto[starts].tolist(), upto[starts + size].tolist(), strict=True)]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text. Pre-tokens not met before are found together."""
        split = [self.parts(t or "") for t in texts]
        needed = set().union(*(part for parts in split for part in parts if not isinstance(part, int)))
        if len(self.known) > KNOWN:
            self.known = {c: self.known[c] for c in needed if c in self.known}
        known = self.known
        new = {c: self.pieces.findall(c) for c in needed if c not in known}
        pieces = [w for w in set(chain.from_iterable(new.values())) if w not in known]
        known.update(zip(pieces, self.learn(pieces), strict=True))
        known.update((c, b"".join(map(known.__getitem__, found))) for c, found in new.items())
        out = [np.frombuffer(b"".join([part.to_bytes(4, "little") if isinstance(part, int) else b"".join(map(known.__getitem__, part)) for part in parts]), "<i4") for parts in split]
        for c in {*new, *pieces}:
            if len(c) > KNOWN_CHARS:
                del known[c]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode without a decoder: the tokens with a space between."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def vocabulary_of(path: str) -> Bpe:
    """One for each Python worker: later tasks find the pre-tokens of earlier ones."""
    return Bpe(path)


def encode_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", decode: bool = True) -> DataFrame:
    """``doc_id``, ``ids`` and, if wanted, the text ``decoded`` from them, for every row. Map only: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary_of(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                rows = batch.slice(at, 250)
                ids = bpe.encode_all(rows.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                columns = {"doc_id": rows.column(0), "ids": lists}
                if decode:
                    columns["decoded"] = pa.array([bpe.decode(i) for i in ids], pa.string())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>" + (", decoded string" if decode else ""))


def digests(encoded: DataFrame) -> DataFrame:
    """``encode_documents`` in short: counts and digests."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
