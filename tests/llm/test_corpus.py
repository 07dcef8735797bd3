"""The corpus operators: exact round trips, brute force, held-out accuracy, and odd tables."""

from __future__ import annotations

import hashlib
import itertools
import json
import random
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from screenloom.llm import bloom, bpe, chat, decontam, fingerprint, langid, neardup, shards, toxicity, urlfilter, warc
from screenloom.llm import queries as Q

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 4000
ODD = [(None, "a null id", "en", None, None), (1, None, None, "s", 0), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, LONG, "en", "s", len(LONG)), (5, "same words here again", "en", "s", 1), (5, "same words here again", "en", "s", 1), (6, "same words here again", "en", "t", 1), (7, "İ Σς ﬁ \x1c ½ 日本 👩‍👧 <|endoftext|> tail", None, "s", 9)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, equal rows, and extra columns with the operators' own names."""
    df = spark.createDataFrame(ODD, DOCS)
    for name in ("score", "kept", "key", "times", "id", "hit", "Block", "word", "n", "at", "shard", "component"):
        df = df.withColumn(name, F.lit("extra"))
    return df.cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]


# ---- 1 toxicity ----


@pytest.mark.parametrize(("size", "least"), [("sf0.01", 0.6), ("sf0.1", 0.9)])
def test_toxicity_held_out(spark, sf, size, least):
    """At sf0.01 the model has 37 toxic texts to learn from, and a third of the labels it is held against are on texts without a toxic word."""
    sf = sf.replace("sf0.001", size)
    out = Q.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in out)
    caught = sum(r["predicted"] for r in out if r["toxic"])
    assert len(out) > 90 and right / len(out) > 0.93 and caught / sum(r["toxic"] for r in out) > least


def test_toxicity_shares_subwords_and_odd_rows(odd, empty, spark):
    rng = random.Random(1)
    plain = [" ".join(rng.choices("the and of river stone house green walk over".split(), k=40)) for _ in range(150)]
    bad = [" ".join(rng.choices("the and of river stone house".split(), k=30)) + " wretchedfool " for _ in range(50)]
    model = toxicity.train([*plain, *bad], [0] * 150 + [1] * 50)
    s = model.score(["the river wretchedfol house", "the river and house of stone", "", "wretchedfool"])
    assert s[0] > 0.3 > s[1] and s[2] == 0 and s[3] > 0.9
    got = {(r["doc_id"], r["s"]) for r in odd.select("doc_id", toxicity.score(model, odd).alias("s")).collect()}
    assert all(0 <= x <= 1 for _, x in got) and (1, 0.0) in got and (3, 0.0) in got
    assert toxicity.train([], []) is None and toxicity.train(["a"], [0]) is None
    none = empty.select(toxicity.score(None, empty).alias("s"))
    assert none.count() == 0 and odd.select(toxicity.score(None, odd).alias("s")).first()["s"] == 0.0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(empty, labels) is None


def test_toxicity_scores_like_plain_loops():
    """Scores worked out word by word from the model's numbers alone."""
    rng = random.Random(3)
    words = "the and of river stone house green walk over naïve straße it's".split()
    plain = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(80)]
    model = toxicity.train([*plain, *(f"{t} wretchedfool" for t in plain[:30])], [0] * 80 + [1] * 30)
    mask = (1 << 64) - 1

    def bucket(gram):
        h = len(gram)
        for c in gram:
            h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 & mask
            h ^= h >> 29
        return h >> 64 - toxicity.BITS

    def logit(word):
        word = f"<{toxicity.EDGES.sub('', word)}>"
        grams = [bucket(word[k : k + n]) for n in (3, 4, 5) for k in range(len(word) - n + 1)]
        whole = sum(ord(c) * (k + 1) ** 3 for k, c in enumerate(word)) * 0x9E3779B97F4A7C15 & mask
        return np.mean([model.table[b] for b in [*grams, whole >> 64 - toxicity.BITS]]) if len(word) > 2 else None

    for text in [*plain[:20], "WRETCHEDFOOL, the house", "one", "--", "", "a wretchedfol " * 50]:
        x = [v for w in text.lower().split() if (v := logit(w)) is not None]
        n = toxicity.WINDOW
        windows = [np.mean(x[k : k + n]) for k in range(len(x) - n + 1)] if len(x) > n else [np.mean(x)] if x else []
        if x:
            top = sorted(windows)[-toxicity.TOP :]
            z = np.dot(model.curve, [np.mean(x), top[-1], np.mean(top), np.log(len(windows)), 1])
        want = 1 / (1 + np.exp(-z)) if x else 0.0
        assert model.score([text])[0] == pytest.approx(want, abs=1e-4)


def test_toxicity_sample_is_taken_among_documents_there(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_DOCS", 40)
    rows = [(k, f"plain words number {k}" if k % 2 else f"a wretchedfool speaks {k}") for k in range(0, 200)] + [(1, "another text of one"), (1, "another text of one"), (7, "x" * 30_000)]
    labels = [(k, 1 - k % 2) for k in range(-5000, 200)]
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic, **_: seen.append((texts, toxic)))
    toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts, toxic = seen[0]
    assert len(texts) == 40 == len(set(texts)) and set(texts) <= {t for _, t in rows} and all((y == 1) == ("fool" in t) for t, y in zip(texts, toxic, strict=True))


# ---- 2 fingerprints ----


def test_fingerprints_like_plain_counts():
    for text in ["", "ab", "abc", "some text of a few words, and some more of it", "ümläut 日本 " * 30, "a" * 500]:
        data, n = text.encode(), [0] * 256
        for k in range(len(data) - 2):
            n[((data[k] << 16 | data[k + 1] << 8 | data[k + 2]) * 2654435761 & 0xFFFFFFFF) >> 24] += 1
        for k in range(len(data) - 3):
            n[(((data[k] << 16 | data[k + 1] << 8 | data[k + 3]) * 2246822519 + 374761393) & 0xFFFFFFFF) >> 24] += 1
        q = [sorted(n)[k] for k in (63, 127, 191)]
        d = fingerprint.digest(text)
        assert d[3:].tolist() == [sum(x > y for y in q) for x in n]
        assert d[0] == min(255, round(12 * np.log1p(len(data)))) and d[1:3].tolist() == [15 * q[k] // q[2] if q[2] else 0 for k in (0, 1)]
        same = fingerprint.digest(text + "!")
        apart = sum(abs(int(a) - int(b)) for a, b in zip(d, same, strict=True)) + 3 * sum(abs(int(a) - int(b)) == 3 for a, b in zip(d[3:], same[3:], strict=True))
        assert fingerprint.likeness(d, same) == max(0.0, 1 - apart / fingerprint.FAR)


def test_fingerprints_follow_the_definition(docs, texts, spark, odd, empty):
    rows = {r["doc_id"]: r for r in fingerprint.compare_neighbours(docs.repartition(5)).collect()}
    assert len(rows) == len(texts)
    for (i, t), (_, f) in zip(texts, texts[1:] + texts[:1], strict=True):
        new = t[: len(t) - len(t) // 2] + f[: len(t) // 2]
        r = rows[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint.shown(fingerprint.digest(t)) and r["edited_fingerprint"] == fingerprint.shown(fingerprint.digest(new))
        assert 0 <= r["near_next"] <= 1 and r["near_edited"] == fingerprint.likeness(fingerprint.digest(t), fingerprint.digest(new))
    long = [r for r in rows.values() if r["n_chars"] > 400]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long]) + 0.1
    out = fingerprint.compare_neighbours(odd).collect()
    assert len(out) == len(ODD) and len({r["fingerprint"] for r in out if r["doc_id"] in (5, 6)}) == 1
    assert fingerprint.compare_neighbours(empty).count() == 0
    one = fingerprint.compare_neighbours(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()
    d = fingerprint.digest("some text of a few words")
    assert (fingerprint.read(fingerprint.shown(d)) == d).all() and fingerprint.fingerprints(odd).count() == len(ODD)


# ---- 3 near-duplicates ----


def brute(rows, words, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return {(i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)}


def test_near_duplicates_like_brute_force(docs, texts):
    for words in (4, 5):
        got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, words).collect()}
        assert got == brute(texts, words)


def test_near_duplicates_in_a_large_group_of_near_copies(spark):
    """Copies of one text with more and fewer edits, chains of copies, and texts around the limit."""
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(2000)]
    base = rng.choices(vocabulary, k=150)
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        t = list(base)
        for _ in range(rng.randint(0, 10)):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        rows.append((i, " ".join(t[: len(t) - rng.randint(0, 8)])))
    chain = rng.choices(vocabulary, k=120)
    for i in range(200, 240):
        chain[rng.randrange(len(chain))] = rng.choice(vocabulary)
        rows.append((i, " ".join(chain)))
    rows += [(i, " ".join(rng.choices(vocabulary, k=60))) for i in range(300, 340)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, 4).collect()}
    assert got == brute(rows, 4)


def test_near_duplicates_odd_rows(odd, empty):
    out = neardup.near_duplicates(odd).collect()
    assert len(out) == len(ODD)
    of = {r["doc_id"]: r for r in out}
    assert of[None]["component_id"] is None and of[None]["kept"] and of[6]["component_id"] == 5 and not of[6]["kept"]
    assert all(of[i]["n_shingles"] == 0 and of[i]["component_id"] == i and of[i]["kept"] for i in (1, 2, 3)) and of[5]["n_shingles"] == 1
    left = neardup.deduplicated(odd)
    assert left.columns == odd.columns and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect()) == [(False, i) for i in (1, 2, 3, 4, 5, 7)] + [(True, 0)]
    assert neardup.near_duplicates(empty).count() == 0 and neardup.deduplicated(empty).count() == 0


def test_components_of_a_star_and_of_chains(spark):
    """A star of 100,000 classes, whose centre's rows are dealt into parts, and chains."""
    star = spark.range(1, 100_001).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    chains = spark.range(200_000, 200_300).select(F.col("id").alias("a"), F.when(F.col("id") % 100 > 0, F.col("id") - 1).otherwise(F.col("id")).alias("b"))
    found = neardup.components(star.unionByName(chains)).groupBy("component").agg(F.count("*").alias("n")).collect()
    assert {r["component"]: r["n"] for r in found} == {0: 100_001, 200_000: 100, 200_100: 100, 200_200: 100}
    rows = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = neardup.salted_join(rows, rows.groupBy("a").agg(F.min("b").alias("m")), "a", "b", 200_000)
    assert joined.count() == 200_000 and joined.where("a = 0 AND m = 1").count() == 100_000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "salt" in plan


def test_near_duplicates_of_ids_with_several_texts(spark, monkeypatch):
    """Links are found by each text's own words; every group keeps one row, equal rows one, and hot keys are dealt."""
    monkeypatch.setattr(neardup, "PART", 3)
    monkeypatch.setattr(neardup, "MOST_HOT", 20)
    rng = random.Random(5)
    a, b, c = (" ".join(rng.choices([f"w{k}" for k in range(900)], k=60)) for _ in range(3))
    rows = [(1, a), (1, b), (5, b + " more"), (1, a), (6, c), (6, c + " tail"), (0, ""), (0, ""), (3, a + " end"), (9, None), (None, a), (None, a)]
    rows += [(20 + k, f"{c} x{k % 4}") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("note", F.monotonically_increasing_id())
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, 4).where("doc_id IS NOT NULL").collect())
    known = [r for r in rows if r[0] is not None]
    sets = [(i, t) for i, t in known if t]
    least = brute(sets, 4)
    assert got == sorted([(i, n, c) for k, (i, t) in enumerate(known) for n, c in [next((n, c) for j, n, c in least if j == i and n == max(0, len((t or "").split()) - 3)) if t else (0, i)]])
    left = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in neardup.deduplicated(df, 4).collect())
    assert left == sorted([(False, 0, a), (False, 0, a), (True, 0, ""), (True, 9, ""), *((True, 1, t) for t in (a, b)), next(x for x in left if x[:2] == (True, 6))])


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)]
    of = {r["id"]: r["component"] for r in neardup.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert of == {x: find(x) for p in pairs for x in p if p[0] != p[1]}


# ---- 4 chat ----


def test_chat_round_trip():
    rng = random.Random(4)
    parts = ["###", "</turn>", "\\", "\n", "### Assistant: ", "a", " ", '"', "#", "</turn>\n### User: x"]
    for _ in range(3000):
        text, role = "".join(rng.choices(parts, k=rng.randint(0, 8))), rng.choice(["user", "assistant", "system", "tool: x\n", "", None, "null", "System"])
        rendered, begin, end = chat.agreed(role, text)
        (got,) = chat.parse(rendered)
        assert got == (role, text, begin, end) and chat.unescaped(rendered[begin:end]) == text
    assert chat.agreed("user", "plain") == ("### User: plain\n</turn>\n", 10, 15)
    for broken in ("x", "### User: a", "### User: a</turn>\n", "### User: a\n</turn>", "### User: ### b\n</turn>\n"):
        with pytest.raises(chat.Malformed):
            chat.parse(broken)


def test_chat_odd_conversations(spark):
    rows = [(1, 1, "assistant", "b ### c"), (1, 0, "user", None), (None, 0, None, "x"), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (3, None, "tool", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("extra"))
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert out[1]["n_turns"] == 2 and out[1]["loss_chars"] == 7 and out[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nb ### c\n").hexdigest()
    assert out[2]["n_turns"] == 2 and out[2]["loss_chars"] == 0 and out[None]["n_turns"] == 1 and out[3]["formatted_chars"] == len(chat.agreed("tool", LONG)[0])
    whole = {r["conv_id"]: r for r in chat.conversation_texts(chat.format_turns(df)).collect()}
    text, mask = whole[1]["formatted"], whole[1]["loss"]
    assert [t[:2] for t in chat.parse(text)] == [("user", ""), ("assistant", "b ### c")]
    assert [chat.unescaped(text[m["begin"] : m["end"]]) for m in mask] == ["b ### c"] and [len(whole[k]["loss"]) for k in (2, 3)] == [2, 0]
    user = chat.format_turns(df, learned="user").where("conv_id = 1 AND turn = 0").first()
    assert [tuple(m) for m in user["loss"]] == [(10, 10)]
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


# ---- 5 BPE ----


def test_bpe_like_the_library(docs, texts, odd, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    strange = ["", "aaaaaaaaab", "It's WE'LL \x85a　b q᠎", "x" * 3000, *(t or "" for _, t, *_ in ODD)]
    own = bpe.Bpe(path)
    for t, ids in zip(strange, own.encode_all(strange), strict=True):
        e = library.encode(t, add_special_tokens=False)
        assert ids.tolist() == e.ids and own.decode(ids) == library.decode(e.ids, skip_special_tokens=False)
    rows = {r["doc_id"]: r for r in bpe.encode_documents(docs, path).collect()}
    for i, t in texts:
        e = library.encode(t, add_special_tokens=False)
        assert rows[i]["ids"] == e.ids and rows[i]["decoded"] == library.decode(e.ids, skip_special_tokens=False)
    out = bpe.digests(bpe.encode_documents(odd, path)).collect()
    assert len(out) == len(ODD) and {r["n_tokens"] for r in out if r["doc_id"] in (1, 2, 3)} == {0} and bpe.encode_documents(empty, path).count() == 0


# ---- 6 shards ----


def test_shards(spark, docs, odd, empty):
    rows = shards.kdtree_shards(docs, 8).collect()
    size, slots, by_text = {}, {}, {}
    for r in rows:
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        by_text.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in by_text.values())
    assert set(size) == set(range(8)) and max(size.values()) < 1.35 * min(size.values())
    for r, t in zip(sorted(rows, key=lambda r: r["doc_id"]), docs.orderBy("doc_id").collect(), strict=True):
        assert r["size"] == len(t["text"].encode()) + 16 and r["text_crc32"] == zlib.crc32(t["text"].encode())
    assert shards.kdtree_shards(odd, 5).count() == len(ODD) and shards.kdtree_shards(empty, 5).count() == 0
    copies = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "one text that is copied many times").otherwise(F.concat(F.lit("own text "), F.col("id").cast("string"))).alias("text"))
    held = [r["b"] for r in shards.kdtree_shards(copies, 10).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(held) == 10 and max(held) < 1.2 * min(held)


def test_shards_like_a_plain_tree(spark, docs, monkeypatch):
    """A k-d tree grown in plain loops over the same points: every document comes to the same shard."""
    monkeypatch.setattr(shards, "CLOSE", 0.0)
    count = 8
    rows = shards.measured(docs)
    n = rows.agg(F.sum("size").alias("bytes"), *(f(F.col("at")[d]).alias(f"{k}{d}") for d in range(4) for k, f in (("min", F.min), ("max", F.max)))).first()
    points = [(r["doc_id"], r["size"], r["at"]) for r in shards.coordinates(rows, [n[f"min{d}"] for d in range(4)], [n[f"max{d}"] for d in range(4)], []).collect()]
    want = {}

    def grow(some, first, give):
        if give == 1:
            want.update((i, first) for i, _, _ in some)
            return
        width = [max(at[d] for *_, at in some) // 2**shards.TIE_BITS - min(at[d] for *_, at in some) // 2**shards.TIE_BITS for d in range(4)]
        d = width.index(max(width))
        aim, sums = sum(size for _, size, _ in some) * (give // 2) / give, {}
        for _, size, at in some:
            sums[at[d]] = sums.get(at[d], 0) + size
        before = upto = 0
        for x in sorted(sums):
            before, upto = upto, upto + sums[x]
            if upto >= aim:
                break
        cut = x if upto - aim <= aim - before else x - 1
        grow([p for p in some if p[2][d] <= cut], first, give // 2)
        grow([p for p in some if p[2][d] > cut], first + give // 2, give - give // 2)

    grow(points, 0, count)
    assert {r["doc_id"]: r["shard"] for r in shards.kdtree_shards(docs, count).collect()} == want


# ---- 7 WARC ----


def test_warc_records_read_back(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    responses = warc.responses(pages).cache()
    made = warc.derivatives(responses).cache()
    sources = {r["record_id"]: r for r in responses.collect()}
    rows = made.collect()
    assert len(rows) == 2 * len(sources)
    for r in rows:
        h = {x["name"]: x["value"] for x in r["headers"]}
        source = sources[h["WARC-Refers-To"]]
        of = {x["name"]: x["value"] for x in source["headers"]}
        assert h["WARC-Target-URI"] == of["WARC-Target-URI"] and h["WARC-Source-Payload-Digest"] == of["WARC-Payload-Digest"] and h["WARC-Source-HTTP-Content-Type"] == "text/html; charset=utf-8"
        assert h["WARC-Block-Digest"] == warc.digest(bytes(r["block"]))
        if r["type"] == "conversion":
            text = bytes(r["block"]).decode()
            assert "<" not in text.replace("<3", "") and "track(" not in text
    data = b"".join(bytes(r["bytes"]) for r in warc.warc_bytes(made).collect())
    back = list(warc.parsed(data))
    assert [b["record_id"] for b in back] == [r["record_id"] for r in rows] and [b["block"] for b in back] == [bytes(r["block"]) for r in rows]
    with pytest.raises(ValueError, match="damaged"):
        list(warc.parsed(data.replace(b"title: ", b"titel: ", 1)))


def test_warc_odd_pages(spark):
    rows = [(None, None, None), (1, "http://a/\r\nX: y", ""), (1, "http://a/\r\nX: y", ""), (2, "u", "<p>a &amp; b<br>c<script>x</script><a href=/q>l</a>" + "<p>z" * 5000)]
    out = warc.derivatives(warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert len(out) == 8 and len({r["record_id"] for r in out}) == 8  # equal pages too have records of their own
    text = next(bytes(r["block"]).decode() for r in out if r["page_id"] == 2 and r["type"] == "conversion")
    assert text.startswith("a & b\nc l\nz\n")
    about = next(bytes(r["block"]).decode() for r in out if r["page_id"] == 2 and r["type"] == "metadata")
    assert "outlink: /q\r\n" in about
    assert warc.derivatives(warc.responses(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_warc_ids_do_not_depend_on_the_partitions(spark):
    single = spark.range(20_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a/"), "id").alias("url"), F.concat(F.lit("<p>"), "id").alias("html"))
    copies = single.limit(0)
    for k in range(3):
        copies = copies.unionByName(spark.range(20_000, 20_100).select(F.col("id").alias("page_id"), F.lit("http://b/").alias("url"), F.when(F.lit(k) < 2, "same").otherwise("other").alias("html")))
    blank = spark.createDataFrame([(None, None, None), (None, "", ""), (None, None, "")], "page_id long, url string, html string")
    pages = single.unionByName(copies).unionByName(blank)
    ids = [sorted((r["page_id"] or -1, r["record_id"]) for r in warc.responses(pages.repartition(n)).select("page_id", "record_id").collect()) for n in (3, 7)]
    assert ids[0] == ids[1] and len(ids[0]) == 20_303 == len({i for _, i in ids[0]})


class Reader(HTMLParser):
    """An independent reader: title, language, links and visible text of a well-formed page."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.title, self.lang, self.links, self.parts, self.inside = "", "", [], [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag in ("script", "style", "noscript", "template", "head", "title"):
            self.inside.append(tag)
        if tag == "html":
            self.lang = given.get("lang", "")
        if tag == "a" and "href" in given:
            self.links.append(given["href"])
        self.parts += ["\n"] if tag in warc.BREAKS and "head" not in self.inside else []

    def handle_endtag(self, tag):
        if tag in self.inside:
            self.inside.remove(tag)
        self.parts += ["\n"] if tag in warc.BREAKS and "head" not in self.inside else []

    def handle_data(self, data):
        if "title" in self.inside:
            self.title += data
        elif not self.inside:
            self.parts.append(data)


def test_warc_pages_like_another_reader(spark, sf):
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        page, other = warc.Page(r["html"]), Reader(r["html"])
        assert (page.title, page.lang, page.links) == (" ".join(other.title.split()), other.lang, other.links)
        assert page.text.split() == "".join(other.parts).split()


def test_warc_hostile_pages_take_little_time():
    for bad in ("<script", "<script>", "<", "<!--", "<title>", "<a href ", "</script ", "a<head>", "&", "<a href=x"):
        begin = time.monotonic()
        warc.Page(bad * 100_000)
        warc.Page(bad * 100_000 + "</title></head></script>-->")
        assert time.monotonic() - begin < 5, bad
    record = {"page_id": 1, "record_id": "<r>", "type": "response", "headers": [("WARC-Date", "a"), ("WARC-Date", "b"), ("WARC-Payload-Digest", "d")], "block": b"HTTP/1.1 200 OK\r\nA: 1\r\nA: 2\r\n\r\nx < y"}
    about, text = warc.derive(record)
    assert [v for n, v in text["headers"] if n in ("WARC-Date", "WARC-Source-HTTP-A")] == ["a", "b", "1", "2"] and text["block"] == b"x < y"


# ---- 8 decontamination ----


def distance(item, text):
    row = [0] * (len(text) + 1)
    for k, c in enumerate(item, 1):
        new = [k]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_decontamination_like_brute_force(spark):
    rng = random.Random(8)
    words = "alpha beta gamma delta river stone walking under bridge seven lamps".split()
    items = [(k, " ".join(rng.choices(words, k=rng.randint(3, 14)))) for k in range(12)] + [(90, ""), (91, None), (92, "  ")]
    rows = []
    for i in range(120):
        t = list(rng.choice(items[:12])[1])
        for _ in range(rng.randint(0, 6)):
            p = rng.randrange(len(t))
            t[p : p + 1] = rng.choice([[], ["z"], [t[p], "y"]])
        rows.append((i, f"Before {''.join(t)}\n after  it" if i % 3 else " ".join(rng.choices(words, k=20)).upper()))
    rows += [(500, None), (501, ""), (502, "x " * 3000), (None, items[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hit", F.lit("extra"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontam.contaminated(df, bench).collect()}
    want = set()
    for i, t in rows:
        for k, item in items:
            item, text = decontam.plain(item), decontam.plain(t)
            if item and (d := distance(item, text)) <= decontam.allowed(len(item)):
                want.add((i, k, d))
    assert got == want and len(got) > 40
    assert decontam.clean(df, bench).columns == df.columns
    assert {r["doc_id"] for r in decontam.clean(df, bench).collect()} == {i for i, _ in rows} - {i for i, _, _ in want}
    assert decontam.contaminated(df, bench.limit(0)).count() == 0 and decontam.contaminated(df.limit(0), bench).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 60)
    items = [(k, f"the item number {k} of a long benchmark") for k in range(7)]
    df = spark.createDataFrame([(k, f"see the item number {k} of a long benchmark here") for k in range(9)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, bench).where("distance = 0").collect()}
    assert len(list(decontam.blocks(bench))) == 7 and got == {(k, k) for k in range(7)}
    others = df.unionByName(spark.createDataFrame([(20, "nothing of it"), (21, None)], "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in decontam.clean(others, bench).collect()) == [20, 21]


def test_language_tables_hold_what_languages_have():
    """Ninety languages with words of their own: as many numbers as n-grams of each, and the same answers as one by one."""
    rng = random.Random(9)
    rows = []
    for k in range(90):
        letters = [chr(0x4E00 + 8 * k + i) for i in range(8)]
        rows += [(" ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(30)), f"l{k:02d}") for _ in range(6)]
    model = langid.train(rows)
    for table in (*model.tables.grams, *model.tables.contexts):
        assert len(table.value) == table.size.sum() == len(table.column) and len(table.value) <= 90 * 2000
        wanted = np.concatenate([table.keys[::7], np.array([1, 2], np.uint64)])
        dense = np.full((len(wanted), 90), table.missing)
        for row, key in enumerate(wanted):
            for at in np.flatnonzero(table.keys == key):
                for j in range(table.first[at], table.first[at] + table.size[at]):
                    dense[row, table.column[j]] = table.value[j]
        for held in (table.dense, None):
            table.dense = held
            assert (table.found(wanted) == dense).all()
    found = model.predict([t for t, _ in rows[::6]])
    assert list(found["lang_pred"]) == [lang for _, lang in rows[::6]]


# ---- 9 URL filter ----


def test_bloom_filter_loses_nothing(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    asked = spark.range(20000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), "id")
    passed = bloom.possible(asked, keys)
    assert passed.where("id < 5000").count() == 5000 and passed.count() < 5600
    assert bloom.impossible(asked, keys).count() == 20000 - passed.count()
    assert bloom.possible(asked, keys.limit(0)).count() == 0 and bloom.impossible(asked, keys.limit(0)).count() == 20000


def test_url_filter(spark):
    urls = [None, "no scheme", "http://A.Example.NET/en/x?q", "https://example.net", "http://sub.example.net/de/", "http://example.com/de/a", "http://notexample.com/de/", "http://x.org/fr/y#z", "http://x.org/en/", "http://user@www.Bad.com:80/p/", "http://bad.com/p", "http://bad.com/p/q", "http://net/", "a://b://c/d", "http://h?x/y"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(3, urls[3]), (None, urls[2])], "page_id long, url string").withColumn("host", F.lit("extra"))
    rules = spark.createDataFrame(Q.RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([("https://bad.com/p",), ("https://bad.com/p/",), (None,)], "url string")
    out = urlfilter.judge(pages, rules, listed).collect()
    of = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}
    assert len(out) == len(urls) + 2 and of[None] == of[2] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert of[0] == of[1] == ("", "", None, "allow") and of[3] == ("example.net", "", None, "allow") and of[4][2:] == ("net/", "block")
    assert of[5][2:] == ("example.com/de/", "block") and of[6][2:] == (None, "allow") and of[7][2:] == ("org/fr/", "allow") and of[8][2:] == (None, "allow")
    hostile = spark.createDataFrame([(1, "http://" + "a." * 200_000 + "net/x")], "page_id long, url string")
    assert urlfilter.judge(hostile, rules, listed).select("rule", "verdict").first() == ("net/", "block")
    assert [of[k][3] for k in (9, 10, 11)] == ["block", "block", "allow"] and of[12][2:] == ("net/", "block") and of[13][:2] == ("b:", "//c/d") and of[14][:2] == ("h", "")
    nothing = urlfilter.judge(pages, rules.limit(0), listed.limit(0)).collect()
    assert len(nothing) == len(out) and {r["verdict"] for r in nothing} == {"allow"} and urlfilter.judge(pages.limit(0), rules, listed).count() == 0


def test_url_list_hits_near_hits_and_false_positives(spark, monkeypatch):
    """A list of many hosts and paths; with a filter of one block everything passes it, and the join alone decides."""
    listed = [f"https://{h}/{p}" for h in ("shop.one.example", "two.example", "www.three.example:8080") for p in ("", "a", "a/b/", "Case")]
    hits = ["http://shop.one.example", "http://SHOP.one.example/a?x=1", "https://m.two.example/a/b", "http://user@three.example/Case#top", "ftp://three.example/"]
    near = ["http://one.example/a", "http://shop.one.example/a/c", "http://two.example/case", "http://two.example.org/a", "http://atwo.example/a", "http://three.example/a/b/c"]
    pages = spark.createDataFrame(list(enumerate([*hits, *near])), "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    for blocks, sent in ((1 << 18, 20_000_000), (1, 0)):
        monkeypatch.setattr(urlfilter, "MAX_SENT", sent)
        monkeypatch.setattr(bloom, "MAX_BLOCKS", blocks)
        monkeypatch.setattr(bloom, "_bits", lambda key, real=bloom._bits: real(key) if blocks > 1 else [F.lit(1).cast("long")] * 8)
        out = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages, rules, spark.createDataFrame([(u,) for u in listed], "url string")).collect()}
        assert [out[k] for k in range(len(out))] == ["block"] * len(hits) + ["allow"] * len(near)


def test_junk_hosts_of_every_family(spark, sf):
    names = {"casino-win", "free-bets", "ads-track", "spam-farm", "cheap-pills", "adult-x"}
    sf = sf.replace("sf0.001", "sf0.1")
    out = Q.op9_junk_hosts(spark, sf).collect()
    hyphened = {label for r in out for label in r["host"].split(".") if "-" in label}
    assert hyphened == names
    assert all((r["verdict"] == "block") == bool(names & set(r["host"].split("."))) for r in out if r["rule"] is None)
    assert {n for r in out for n in names & set(r["host"].split(".")) if r["rule"] is None} == names - {"adult-x"}  # those are under net/


# ---- 10 language ID ----


def test_language_id_held_out(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    out = Q.op10_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) / len(out) > 0.97 and sum(r["accepted"] for r in out) / len(out) > 0.99


def test_language_id_odd_rows(docs, odd, empty):
    model = langid.fit(docs)
    of = {}
    for r in odd.select("doc_id", langid.predict(model, odd).alias("p")).select("doc_id", "p.*").collect():
        of[r["doc_id"]] = r
    assert all(of[i]["lang_pred"] == "und" and of[i]["score"] == 0 and not of[i]["accepted"] for i in (1, 2, 3)) and of[4]["lang_pred"] in model.languages
    gibberish = model.predict(["qxzkj wvbnm qqqq zzzz xkcd jjjj kkkk xxzz qqxz " * 40, "123 ½ !!"])
    assert not gibberish["accepted"].any() and gibberish["lang_pred"][1] == "und"
    keyed = model.predict(['token = "06cf6f1ed6e2f11436ae2d0e28ac632b3cf81707" The and of that there.', "abc123"])
    assert keyed["accepted"][0] and keyed["lang_pred"][1] in model.languages
    assert langid.fit(empty) is None and empty.select(langid.predict(None, empty).alias("p")).count() == 0
    assert odd.select(langid.predict(None, odd)["lang_pred"].alias("p")).first()["p"] == "und"


def test_kneser_ney_like_plain_counts():
    """Cross-entropies worked out from counts in dictionaries, by the definition."""
    rng = random.Random(6)
    rows = [(" ".join("".join(rng.choices(a, k=rng.randint(1, 7))) for _ in range(40)), lang) for a, lang in (("abcdé", "x"), ("cdefß", "y")) for _ in range(8)]
    model = langid.train(rows)
    order, discount = langid.ORDER, langid.DISCOUNT

    def padded(text):
        return [" " * (order - 1) + w + " " for c in text.lower().split() for w in langid.runs(c)]

    for column, lang in enumerate(model.languages):
        mine = [t for t, of in rows if of == lang]
        top = {}
        for t in (t for k, t in enumerate(mine) if k % 5 != 4):
            for w in padded(t):
                for k in range(order - 1, len(w)):
                    top[w[k - order + 1 : k + 1]] = top.get(w[k - order + 1 : k + 1], 0) + 1
        counts = {order: top}
        for n in range(order - 1, 0, -1):  # how many different characters come before
            kinds = {}
            for g in counts[n + 1]:
                kinds.setdefault(g[1:], set()).add(g[0])
            counts[n] = {g: len(v) for g, v in kinds.items()}
        alphabet = max(2, len(counts[1])) + 1

        def p(gram, counts=counts, alphabet=alphabet):
            if not gram:
                return 1 / alphabet
            after = {g: c for g, c in counts[len(gram)].items() if g[:-1] == gram[:-1]}
            if not after:
                return p(gram[1:])
            total = sum(after.values())
            return max(after.get(gram, 0) - discount, 0) / total + discount * len(after) / total * p(gram[1:])

        for text in ["abc cab", "é1fe2", "ßß zz9", mine[0]]:
            words = padded(text)
            logs = [np.log(p(w[k - order + 1 : k + 1])) for w in words for k in range(order - 1, len(w))]
            h, n, _ = model.entropy([text])
            assert n[0] == len(logs) and h[0, column] == pytest.approx(-np.mean(logs), rel=1e-4)


def test_language_id_reads_letters_beside_digits(spark, monkeypatch):
    ja, en = "これは日本語の文章です。今日は天気がいいので散歩に行きました。", "the house by the river is green and the stone under the bridge is old"
    model = langid.train([(f"{ja} {ja[k % 20:]}", "ja") for k in range(20)] + [(f"{en} {en[k % 20:]}", "en") for k in range(20)])
    texts = [f"{ja}2024年の文章です。{ja} the house by the river is", "今日は2024ok", "今日は天気がいいので散歩2024 ok", "the house 2024 river", "12 34", "x9y8z7"]
    assert model.predict(texts)["lang_pred"].tolist()[:5] == ["ja", "ja", "ja", "en", "und"]
    long = model.predict([en, f"{en} " * 300])
    assert abs(long["score"][0] - long["score"][1]) < 1e-3 and long["accepted"].all()
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    many = spark.createDataFrame([(k, "some text", f"l{k}") for k in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        langid.fit(many)


# ---- queries and pipeline ----


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_as_sql(spark, sf, duck, name):
    from conftest import same_rows

    same_rows(Q.queries()[name](spark, sf), duck, Q.oracle_sql()[name])


def tables(tmp_path, spark, benchmark=(), labels=()):
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_pipeline_stages_on_odd_tables(spark, odd, empty, tmp_path):
    """Nulls, blank and long texts, equal rows, clashing columns, and empty tables, at every stage."""
    import corpus_pipeline as P

    stages = dict(P.STAGES)
    sf = tables(tmp_path, spark, [(1, "same words here again"), (2, None), (3, " ")])
    ids = lambda df: sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in df.select("doc_id").collect())
    every = [(False, 0), *((True, i) for i in (1, 2, 3, 4, 5, 5, 6, 7))]
    for name in list(stages)[:-1]:
        assert stages[name](spark, odd, sf).columns == odd.columns and stages[name](spark, empty, sf).count() == 0, name
    assert ids(stages["toxicity"](spark, odd, sf)) == every  # no labels, nothing to judge by
    assert ids(stages["near_dedup"](spark, odd, sf)) == [(False, 0), *((True, i) for i in (1, 2, 3, 4, 5, 7))]
    assert ids(stages["decontamination"](spark, odd, sf)) == [(False, 0), *((True, i) for i in (1, 2, 3, 4, 7))]
    unknown = odd.withColumn("lang", F.lit(None).cast("string"))
    assert ids(stages["language_id"](spark, unknown, sf)) == every
    judged = ids(stages["language_id"](spark, odd, sf))
    assert not {(True, 1), (True, 2), (True, 3)} & set(judged) and judged.count((True, 5)) in (0, 2)
    tokens = stages["bpe"](spark, odd, sf).collect()
    assert len(tokens) == len(ODD) and {r["n_tokens"] for r in tokens if r["doc_id"] in (1, 2)} == {0} and stages["bpe"](spark, empty, sf).count() == 0


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.columns]
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == seen[0] and after.exceptAll(docs).count() == 0, name
        after.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    rows = {r["doc_id"]: r["n_tokens"] for r in P.run(spark, sf).collect()}
    assert set(rows) == {r["doc_id"] for r in docs.collect()} and 100 < len(rows) < 200
    assert json.dumps(rows) and decontam.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
