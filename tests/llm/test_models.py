"""Cross-tokenizer alignment, quality and spelling variants: brute force, held-out accuracy, and odd tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

import public_tokenizers
from screenloom.llm import align, quality, variants
from screenloom.llm import queries as Q

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string"


def with_extra(df):
    for name in ("groups", "of", "word", "n", "half", "pair", "score", "x", "tile", "member"):
        df = df.withColumn(name, F.lit("extra"))
    return df


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0 if not isinstance(x, str) else x) for x in r))


# ---- 11 alignment ----

ODD = [
    (-1, None), (-2, ""), (-3, " "), (-4, "a  b \n c\t d  "), (-5, "x▁y z"), (-6, "<|endoftext|> </s> <0x0A>"), (-7, "日本語のテキスト 漢字"), (-8, "é ﬁ  x  y"), (-8, "é ﬁ  x  y"),
    (-9, "a\x00b \x1c c"), (None, "the end "), (-11, "w" * 5000), (-12, " lead"), (-13, "tail "), (-14, "🙂🙂 ok\r\n ok"), (-15, "don't it's 've  're \n\n x"), (-16, "the " * 20_000), (-17, "　 \xa0 a\xa0 b"),
]


def aligned_plainly(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    known = align.Aligner(A, B, False)
    found, times = [], Counter()
    for doc, text in docs:
        raw = f" {text or ''}".encode()
        a = first.encode(f" {text or ''}", add_special_tokens=False).ids
        b = second.encode([text or ""], num_threads=1)[0]
        if not text or b"".join(known.a_bytes[x] for x in a) != raw or b"".join(known.b_bytes[x] for x in b) != raw:
            found.append((doc, None))
            continue

        def spans(ids, of):
            ends = np.cumsum([len(of[x]) for x in ids])
            return [(int(e) - len(of[x]), int(e), x) for e, x in zip(ends, ids, strict=True)]

        left, right = spans(a, known.a_bytes), spans(b, known.b_bytes)
        links, k = [], 0
        for s, e, x in left:
            while right[k][1] <= s:
                k += 1
            j = k
            while j < len(right) and right[j][0] < e:
                links.append((x, right[j][2]))
                j += 1
        groups, p, q, ends = [], 0, 0, {e for _, e, _ in right}
        for k, (_, e, _) in enumerate(left):
            if e in ends:
                j = next(j for j in range(q, len(right)) if right[j][1] == e) + 1
                groups.append(f"{','.join(str(x[2]) for x in left[p : k + 1])}|{','.join(str(x[2]) for x in right[q:j])}")
                p, q = k + 1, j
        times.update(set(links))
        found.append((doc, (len(a), len(b), len(groups), links, ";".join(groups))))
    best = defaultdict(int)
    for (a, _), n in times.items():
        best[a] = max(best[a], n)
    return [(doc, 0, 0, 0, 0, 0, 0, "") if f is None else (doc, *f[:3], len(f[3]), sum(times[x] == best[x[0]] for x in f[3]), sum(times[x] for x in f[3]), f[4]) for doc, f in found], times


def test_alignment_like_plain_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id < 60").unionByName(spark.createDataFrame(ODD, DOCS))
    want, times = aligned_plainly([tuple(r) for r in docs.collect()])
    assert ordered(align.align_documents(with_extra(docs), A, B).collect()) == ordered(want)
    # several blocks of pairs, each a pass of its own
    assert ordered(align.align_documents(docs, A, B, shard_pairs=300, block_pairs=1000).collect()) == ordered(want)
    table, shards, blocks = align.pair_table(docs, A, B, shard_pairs=300, block_pairs=1000)
    assert shards > 5 and len(blocks) > 2
    found = {(r["a"], r["b"]): r["n_docs"] for r in align.pair_counts(table, align.Aligner(A, B, False).b_bits).collect()}
    assert found == dict(times)
    none = docs.where("false")
    assert align.align_documents(none, A, B).count() == 0 and align.align_documents(docs.where("text IS NULL"), A, B).count() == 1


def test_query_of_the_alignment(spark, sf):
    out = Q.op11_token_alignment(spark, sf)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() and all((r["groups_sha256"] == "") == (r["n_a"] == 0) for r in rows)


def test_perfect_hash_and_memory_of_chunks(monkeypatch):
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 31, 20_000)).astype("<u4")
    shard = (keys.astype(np.int64) * align.SHARD_FACTOR >> 16) % 3
    rows = [align.perfect_hash(keys[shard == k]) for k in range(3)]
    table = align.PairTable(3, 0, [(levels, bits.tobytes()) for levels, bits, _ in rows])
    assert sorted(table.index(keys)) == list(range(len(keys))) == list(range(table.size))
    table.keys, table.counts, table.best = np.concatenate([k for *_, k in rows]), np.arange(len(keys)), np.ones(len(keys), np.int8)
    assert (table.keys[table.index(keys)] == keys).all()
    others = np.setdiff1d(rng.integers(0, 1 << 31, 5000).astype("<u4"), keys)
    counts, best = table.find(others)
    assert not counts.any() and not best.any()
    # a worker that forgets chunks says the same
    texts = [" ".join(f"word{rng.integers(0, 400)}-{k}" for k in range(40)) for _ in range(60)]
    free, tight = align.Aligner(A, B), align.Aligner(A, B)
    want = align.Reader(free, table).read(texts)
    monkeypatch.setattr(align, "KNOWN", 300)
    reader = align.Reader(tight, table)
    got = [reader.read(texts[k : k + 7]) for k in range(0, 60, 7)]
    assert (np.concatenate([n for n, _ in got]) == want[0]).all() and [g for _, gs in got for g in gs] == want[1] and tight.generation > 1


# ---- 12 quality ----


@pytest.mark.parametrize(("size", "least"), [("sf0.01", 0.97), ("sf0.1", 0.99)])
def test_quality_held_out(spark, sf, size, least):
    sf = sf.replace("sf0.001", size)
    out = Q.op12_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out").collect()
    bad = [r for r in out if not r["quality"]]
    assert sum(r["predicted"] == r["quality"] for r in out) / len(out) > least and sum(not r["predicted"] for r in bad) / len(bad) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)


def test_forest_like_plain_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (400, len(quality.FEATURES)))
    x[:, 3] = np.round(x[:, 3])
    good = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    forest = quality.train(x, good)
    assert ((forest.score(x) >= 0.5) == good).mean() > 0.97
    for row in x[:40]:
        total = forest.start
        for feature, limit, value in zip(forest.feature, forest.limit, forest.value, strict=True):
            k = 0
            while k < forest.inner:
                k = 2 * k + 1 + int(row[feature[k]] > limit[k])
            total += value[k - forest.inner]
        assert forest.logits(row[None])[0] == pytest.approx(total)


def test_first_split_is_the_best_one():
    """The root of the first tree against all splits of all features, summed plainly."""
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(0, 1, (150, len(quality.FEATURES))), 1)
    good = (x[:, 5] + 0.3 * rng.normal(0, 1, 150) > 0.1).astype(float)
    limits, bins = quality.binned(x)
    p = np.full(150, good.mean())
    slope, bend = p - good, p * (1 - p)
    feature, limit, _, _ = quality.grown(bins, limits, slope, bend)

    def gain(f, cut):
        left = x[:, f] <= cut
        part = lambda m: slope[m].sum() ** 2 / (bend[m].sum() + quality.RIDGE)
        return part(left) + part(~left) if min(bend[left].sum(), bend[~left].sum()) >= quality.LEAST else 0

    best = max(gain(f, cut) for f in range(x.shape[1]) for cut in limits[f])
    assert gain(feature[0], limit[0]) == pytest.approx(best)


def test_quality_of_odd_rows(spark):
    rows = [(None, "a null id"), (1, None), (2, ""), (3, " \n\t "), (4, "lorem ipsum dolor " * 20_000), (5, "same"), (5, "same"), (6, "İ Σς \x1c 日本 👩‍👧 ퟿")]
    df = with_extra(spark.createDataFrame(rows, DOCS))
    labels = spark.createDataFrame([(k, k % 2) for k in range(2, 60)] + [(5, 1), (None, 1)], "doc_id long, quality int")
    forest = quality.fit(df, labels)
    got = df.select("doc_id", quality.score(forest, df).alias("score")).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
    scores = {r["doc_id"]: r["score"] for r in got}
    assert scores[1] == scores[2]
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(df, none).score(np.zeros((1, len(quality.FEATURES))))[0] == 0.5
    one = quality.fit(df, spark.createDataFrame([(k, 1) for k in range(9)], "doc_id long, quality int"))
    assert one.trees == 0 and one.score(np.zeros((1, len(quality.FEATURES))))[0] > 0.5
    assert df.where("false").select(quality.score(forest, df.where("false")).alias("s")).count() == 0


# ---- 13 spelling variants ----


def variants_plainly(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 5
    words = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    near = {w: [] for w in words}
    cut = defaultdict(set)
    for w in words:
        for k in range(len(w) + 1):
            cut[w[:k] + w[k + 1 :]].add(w)
        cut[w].add(w)

    def one_apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    for w in words:
        others = set().union(*(cut[w[:k] + w[k + 1 :]] for k in range(len(w))), cut[w]) - {w}
        near[w] = [o for o in others if one_apart(w, o)]
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def test_variants_like_brute_force(spark, sf, monkeypatch):
    odd = [(-1, None), (-2, ""), (None, "Straße straße STRASSE Étude étude etude " * 3), (-3, "hello hello hello hallo hallo hallo hallo hallo hallo helo " * 2), (-4, f"{'w' * 3000} {'w' * 3001} " * 3)]
    odd += [(-5 - k, " ".join("a" * 5 + chr(97 + x % 26) + chr(97 + x // 26 % 26) for x in range(300))) for k in range(4)] + [(7, "twice twice thrice " * 2)] * 2
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(odd, DOCS))
    want = variants_plainly([tuple(r) for r in docs.collect()])
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    found = lambda: sorted(tuple(r) for r in variants.spelling_variants(with_extra(docs)).select(*columns).collect())
    assert found() == want
    monkeypatch.setattr(variants, "PART", 40)  # large groups in tiles
    assert found() == want
    assert variants.spelling_variants(docs.where("false")).count() == 0


def test_variants_like_sql(spark, sf, duck):
    same_rows(Q.op13_spelling_variants(spark, sf), duck, Q.OP13_SQL)


def test_near_pairs_in_slices(monkeypatch):
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abc", k=rng.choice([6, 7]))) for _ in range(400)})
    monkeypatch.setattr(variants, "ITEMS", 100)
    for backwards in (False, True):
        for half in ("ab", "abc", "bca", "cc"):
            mine = [w for w in words if (w.endswith(half.ljust(3, "a")[:3]) if backwards else w.startswith(half.ljust(3, "a")[:3]))]
            a, b = variants.near_pairs(mine, np.zeros(len(mine), np.int64), np.ones(len(mine), bool), np.ones(len(mine), bool), 6, backwards) if mine else ([], [])
            got = sorted((mine[i], mine[j]) for i, j in zip(a, b, strict=True))
            assert len(got) == len(set(got))
            for x, y in got:
                assert min(len(x), len(y)) == 6 and x != y


def test_roots_of_long_chains(spark):
    forms = [(f"w{k}", f"w{k + 1}") for k in range(40)] + [(f"v{k}", "w39") for k in range(50)]
    found = {r["word"]: r["root"] for r in variants.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert set(found.values()) == {"w40"} and len(found) == 90
    assert variants.roots(spark.createDataFrame([], "word string, form string")).count() == 0
