"""Near-duplicates: a multi-index Hamming join over b-bit MinHash signatures, confirmed on full shingle sets.

Texts become sets of hashed word shingles; equal sets are one *class*, worked on once under an id of its own, whatever ids
its documents have (an id may stand for several texts, each in its class). A class's signature has
``CHUNKS * WIDTH`` positions of 16 bits. Two sets of similarity s differ in a position with probability 1 - s. By the
pigeonhole, signatures that differ in fewer than ``CHUNKS * (ERRORS + 1)`` positions have a chunk with at most
``ERRORS`` = 1 differing positions; so a chunk is entered once for each position left out (all its allowed errors), and
every pair under that distance meets under some key. At similarity 0.8 all 12 chunks have two errors or more with
probability 0.263^12, about 1e-7.

Links are confirmed on full sets, and what is wanted are the components, so pairs inside a key are not all written out:

1. Under each key, every class is held against one leader, the class that most others share keys with.
2. Keys whose classes are by then in one component are done. In the others, for each class outside the leader's
   component an exact bound says which classes can still be similar to it. Shingles that no other class in question has
   are in no intersection; the others are counted by segments of their hash, and two sets have at most the lesser count
   of each segment in common. What the bound leaves is confirmed on full sets as well. Nothing is capped or dropped.

Components come from alternating large-star and small-star steps.

Hot keys are split: classes, leaders and keys with more than a ``1 / MOST_HOT`` share of the rows that meet them are at
most ``MOST_HOT``, a table of proven size; what belongs to them is dealt into parts of that share.

Defined cases: a text with fewer words than a shingle is one shingle of all its words; null and empty texts and texts
of white space have an empty set, linked with nothing; a null id is linked with nothing and stays; repeated rows each
get their component; several texts under one id are linked each by its own words; extra columns are kept out of the way;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.llm.bloom import impossible, possible
from screenloom.llm.common import fresh, settle

CHUNKS, WIDTH, ERRORS = 12, 5, 1
POSITIONS = CHUNKS * WIDTH
#: Pairs whose signatures differ in more positions than this are not similar: at similarity 0.8 the probability of more is about 3e-6.
FAR = 28
#: Segments of the shingle hash for which a set's shingles are counted.
SEGMENTS = 64
#: Most keys that are taken for hot at a time, and the rows of a key that one part holds at least.
MOST_HOT, PART = 1000, 2000
KNOWN = 200_000
MULTIPLIERS = np.random.default_rng(2024).integers(1 << 62, 1 << 63, POSITIONS, dtype=np.uint64) | np.uint64(1)
MIX = np.random.default_rng(2025).integers(1 << 62, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


class Shingler:
    """Texts to sorted arrays of hashed shingles; word hashes are kept between texts."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def shingles(self, text: str | None) -> np.ndarray:
        found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z only, ASCII white space only
        if not found:
            return np.zeros(0, np.uint64)
        if len(self.known) > KNOWN:
            self.known.clear()
        known = self.known
        for w in set(found):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        width = min(self.words, len(h))
        out = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            out = (out ^ h[k : len(h) - width + 1 + k]) * MIX[k % len(MIX)]
            out ^= out >> np.uint64(31)
        return np.unique(out)


def signature(shingles: np.ndarray) -> bytes:
    """16 bits of the least value of each hash function."""
    least = np.full(POSITIONS, ~np.uint64(0))
    for at in range(0, len(shingles), 1024):
        least = np.minimum(least, (shingles[at : at + 1024, None] * MULTIPLIERS).min(0))
    least = (least ^ least >> np.uint64(29)) * MIX[0]
    return (least >> np.uint64(48)).astype("<u2").tobytes()


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id``, ``of`` (a hash of the text), ``n`` (set size), ``s1``, ``s2`` (a digest of the set), ``sig``. Map only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Shingler(words)
        for b in batches:
            rows = []
            for t in b["text"]:
                s = own.shingles(t)
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                rows.append((len(s), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), signature(s) if len(s) else b""))
            out = pd.DataFrame(rows, columns=["n", "s1", "s2", "sig"])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").values)
            out.insert(1, "of", b["of"].values)
            yield out

    return docs.mapInPandas(run, "doc_id long, of long, n long, s1 long, s2 long, sig binary")


def salted_join(rows: DataFrame, side: DataFrame, key: str, by: str, total: int) -> DataFrame:
    """``rows`` (``total`` of them) joined to ``side`` (a row per ``key``).

    Keys of more than ``total / MOST_HOT`` rows, at most ``MOST_HOT``, are hot: their rows are dealt by ``by`` into parts of about
    that many, and their row of ``side`` is copied once for each part, so there are at most twice ``MOST_HOT`` copies in all.
    """
    most = max(PART, total // MOST_HOT)
    counted = rows.groupBy(key).agg(F.count("*").alias("times")).where(F.col("times") > most)
    hot = [(r[key], -(-r["times"] // most)) for r in counted.collect()] if total > most else []
    if not hot:
        return rows.join(side, key)
    many = F.broadcast(rows.sparkSession.createDataFrame(hot, f"{key} long, parts int"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = rows.join(many, key, "left").withColumn("salt", F.pmod(F.xxhash64(by), parts).cast("int")).drop("parts")
    copied = side.join(many, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt.join(copied, [key, "salt"]).drop("salt")


def keys() -> list[Column]:
    """The keys of a signature: each chunk without one of its positions."""
    out = []
    for c in range(CHUNKS):
        for p in range(WIDTH):
            at = 2 * WIDTH * c
            out.append(F.expr(f"xxhash64({c * WIDTH + p}, substring(sig, {at + 1}, {2 * p}), substring(sig, {at + 2 * p + 3}, {2 * (WIDTH - 1 - p)}))"))
    return out


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``id``, ``n``, ``shingles`` (sorted, 8 bytes each) and ``counts`` by segment of the classes ``wanted``.

    ``wanted``: id, and ``low`` and ``of``, the document id and hash of a text of that class. A filter of bounded size
    keeps most other texts from being shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Shingler(words)
        for b in batches:
            s = [own.shingles(t) for t in b["text"]]
            counts = [np.bincount((x % np.uint64(SEGMENTS)).astype(np.int64), minlength=SEGMENTS).astype(np.int32) for x in s]
            yield pd.DataFrame({"id": b["id"], "n": [len(x) for x in s], "shingles": [x.astype("<u8").tobytes() for x in s], "counts": counts})

    own_key = F.xxhash64("doc_id", "of").alias("key")
    rows = possible(docs.select("doc_id", "of", "text", own_key), wanted.select(F.xxhash64("low", "of").alias("key")))
    texts = rows.join(wanted.select(F.col("low").alias("doc_id"), "of", "id"), ["doc_id", "of"]).groupBy("id").agg(F.min("text").alias("text"))
    return texts.mapInPandas(run, "id long, n long, shingles binary, counts array<int>")


def spread(sets: DataFrame) -> DataFrame:
    """A row ``id``, ``shingle`` for each member of each set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, x in zip(b["id"], b["shingles"], strict=True):
                x = np.frombuffer(x, "<i8")
                yield pd.DataFrame({"id": np.full(len(x), i), "shingle": x})

    return sets.select("id", "shingles").mapInPandas(run, "id long, shingle long")


def confirmed(pairs: DataFrame, sets: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["x"], b["y"], strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.loc[np.array(keep, bool), ["a", "b"]]

    def differing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b[c]), "<u2").reshape(-1, POSITIONS) for c in ("x", "y"))
            near = (x != y).sum(1) <= FAR
            small = (100 * np.minimum(b["n"], b["m"]) >= percent * np.maximum(b["n"], b["m"])).to_numpy()
            yield b.loc[near & small, ["a", "b"]]

    def joined(of: DataFrame, side: DataFrame, value: str, total: int) -> DataFrame:
        one = side.select(F.col("id").alias("a"), F.col("n"), F.col(value).alias("x"))
        other = side.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col(value).alias("y"))
        return salted_join(salted_join(of, one, "a", "b", total), other, "b", "a", total)

    near = settle(joined(pairs, signatures, "sig", pairs.count()).mapInPandas(differing, "a long, b long"))
    return joined(near, sets, "shingles", near.count()).mapInPandas(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (its least id) of all ends of ``links`` (``a``, ``b``), by large-star and small-star steps."""
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state, count = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = salted_join(both, least, "a", "b", 2 * count).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")  # no hot keys here: a row for each centre that a node has had
        edges = settle(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        state, count = now, now[0]


def class_links(reps: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (``a``, ``b``) between classes, enough to join all that are connected by similar pairs."""
    entered = reps.select("id", F.explode(F.array(*keys())).alias("key"))
    met = settle(entered.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("low"), F.max("id").alias("high")).where("size > 1"))
    # keys with two classes are a pair; those with more need their members
    members = settle(entered.join(met.where("size > 2").select("key", "size"), "key"))
    weight = members.groupBy("id").agg(F.sum("size").alias("weight"))
    members = settle(members.join(weight, "id").select("key", "id", "weight"))
    leaders = members.groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("leader"))
    stars = members.join(leaders, "key").where("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"))
    pairs = settle(met.where("size = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).unionByName(stars).distinct())
    involved = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = settle(shingle_sets(docs, reps.select("id", "low", "of").join(involved, "id", "left_semi"), words))
    links = settle(confirmed(pairs, sets, reps, percent))
    of = components(links)
    # keys that still have classes of several components
    placed = members.join(of, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low <> high").select("key", F.ceil(F.col("size") / PART).cast("int").alias("parts"))
    placed = placed.join(split, "key").join(leaders, "key")
    main = placed.where("id = leader").select("key", F.col("component").alias("main"))
    open_members = settle(placed.drop("leader").join(main, "key"))
    in_question = open_members.select("id").distinct()
    mine = sets.join(in_question, "id", "left_semi")
    lone_shingles = spread(mine).groupBy("shingle").agg(F.count("*").alias("times"), F.min("id").alias("id")).where("times = 1")
    own = lone_shingles.groupBy("id", F.pmod("shingle", F.lit(SEGMENTS)).alias("segment")).agg(F.count("*").cast("int").alias("times"))
    own = own.groupBy("id").agg(F.sum("times").alias("own"), F.map_from_entries(F.collect_list(F.struct("segment", "times"))).alias("by"))
    left = F.transform("counts", lambda c, k: c - F.coalesce(F.try_element_at("by", k.cast("long")), F.lit(0)))
    sizes = settle(mine.join(own, "id", "left").select("id", "n", F.coalesce("own", F.lit(0)).alias("own"), left.alias("counts")))
    known = open_members.join(sizes, "id")
    # partners of a class have between percent of its size and ``most`` shingles; classes are met by that on a log scale
    bin_of = lambda n: F.floor(F.log(n) / F.log(F.lit(1.1)))
    most = F.expr(f"(100 * (n - own) div {percent}) - own")
    least = F.expr(f"n * {percent} div 100")
    lone = known.where("component <> main").withColumn("most", most).where(F.col("most") >= F.greatest(F.lit(1), least))
    # a key of many classes is dealt into parts: each class meets one part of the others in a task
    lone = lone.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lone = lone.select("key", "part", F.col("id").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("own").alias("ua"), F.col("counts").alias("xa"), F.explode(F.sequence(bin_of(F.greatest(F.lit(1), least)), bin_of(F.col("most")))).alias("bin"))
    rest = known.select("key", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("own").alias("ub"), F.col("counts").alias("xb"), F.expr("component = main").alias("is_main"), bin_of(F.col("n")).alias("bin"))
    could = F.least(F.col("na") - F.col("ua"), F.col("nb") - F.col("ub")) * 100 >= F.greatest(F.col("na") + F.col("ub"), F.col("nb") + F.col("ua")) * percent
    common = F.aggregate(F.zip_with("xa", "xb", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    still = common * 100 >= (F.col("na") + F.col("nb") - common) * percent
    same = [F.col("l.key") == F.col("r.key"), F.col("l.part") == F.col("r.part"), F.col("l.bin") == F.col("r.bin"), F.col("ca") != F.col("cb"), F.col("is_main") | (F.col("a") < F.col("b")), could, still]
    more = lone.alias("l").join(rest.alias("r"), reduce(Column.__and__, same)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = settle(more.join(pairs, ["a", "b"], "left_anti"))
    return links.unionByName(settle(confirmed(more, sets, reps, percent)))


def judged(docs: DataFrame, words: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``of`` (a hash of the text), ``n_shingles``, ``component_id`` and ``component`` of each row.

    ``component_id`` is null for a null id. ``component`` is the component's own number, null where nothing is linked: with
    ids that stand for several texts two components may have the same least id.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("of", F.xxhash64("text"))
    sketches = settle(sketched(rows, words))
    same = ["s1", "s2", "n"]
    whole = sketches.where("n > 0 AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "of"))
    reps = whole.groupBy(*same).agg(first.alias("first"), F.first("sig").alias("sig"), F.count("*").alias("times"))
    # the number is made when the row is written, and is a fact from then on
    reps = settle(reps.select(*same, F.col("first.doc_id").alias("low"), F.col("first.of").alias("of"), "sig", "times", F.monotonically_increasing_id().alias("id")))
    of = components(class_links(reps.select("id", "n", "sig", "low", "of"), rows, words, percent))
    linked = settle(reps.join(of, "id").select(*same, "low", "times", "component"))
    least = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    placed = linked.join(least, "component").select(*same, "times", "component_id", "component")
    alone = reps.join(of, "id", "left_anti").select(*same, "times", F.col("low").alias("component_id"), F.col("id").alias("component"))
    placed = settle(placed.unionByName(alone))
    # the few classes of very many rows come to their rows; the others and their rows meet by the digest
    total = sketches.count()
    large = F.col("times") > max(PART, total // MOST_HOT)
    own = sketches.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "of", *same)
    big = F.broadcast(placed.where(large).drop("times"))
    met = own.join(big, same).unionByName(own.join(big, same, "left_anti").join(placed.where(~large).drop("times"), same))
    none = sketches.where("n = 0 OR doc_id IS NULL").select("doc_id", "of", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    return met.drop("s1", "s2").unionByName(none).select("doc_id", "of", F.col("n").alias("n_shingles"), "component_id", "component")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of each row; ``percent`` is the similarity by 100."""
    found = judged(docs, words, percent, doc_id, text).drop("of", "component")
    return found.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies, with all its columns: the least id, of that the text with the least hash.

    Of rows equal in id and text one stays (of those that differ in other columns, the first by its JSON). Rows with a null
    id all stay. A filter of bounded size tells which rows may go; only those are shuffled, to be held against those that do.
    """
    found = settle(judged(docs, words, percent, doc_id, text).where("doc_id IS NOT NULL"))
    texts = settle(found.groupBy("doc_id", "of").agg(F.first("component").alias("component"), F.count("*").alias("times")))
    winners = texts.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "of")).alias("first"))
    stays = texts.join(winners, "component", "left").withColumn("stays", F.coalesce((F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.of") == F.col("of")), F.lit(True)))
    name, hashed, both, twice = (fresh(docs.columns, c) for c in ("key", "of", "both", "times"))
    going = stays.where("NOT stays OR times > 1").select(F.col("doc_id").alias(name), F.col("of").alias(hashed), F.xxhash64("doc_id", "of").alias(both), F.col("stays").alias(twice))
    going = settle(going)
    marked = docs.withColumn(name, F.col(doc_id).cast("long")).withColumn(hashed, F.xxhash64(F.col(text).cast("string")))
    marked = marked.withColumn(both, F.when(F.col(name).isNotNull(), F.xxhash64(name, hashed)))
    doubtful = settle(possible(marked, going, both))
    exact = [name, hashed]
    repeated = doubtful.join(going.where(twice).select(*exact), exact)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    once = repeated.groupBy(*exact).agg(F.min_by(row, F.to_json(row)).alias(twice)).select(f"{twice}.*")
    return impossible(marked, going, both).select(*docs.columns).unionByName(doubtful.join(going.select(*exact), exact, "left_anti").select(*docs.columns)).unionByName(once)
