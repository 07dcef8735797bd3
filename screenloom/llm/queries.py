"""The queries of this subpackage, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom.llm import align, bpe, chat, decontam, fingerprint, langid, neardup, quality, shards, toxicity, urlfilter, variants, warc
from screenloom.llm.common import held_out, small_batches, table


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return fingerprint.compare_neighbours(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at a similarity of 0.8 over sets of four-word shingles."""
    small_batches(spark)
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' '))) END AS s FROM words
), sized AS (SELECT doc_id, len(s) AS n FROM shingled),
flat AS (SELECT doc_id, unnest(s) AS shingle FROM shingled),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common_n FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * common_n >= 80 * (x.n + y.n - common_n)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sized UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN least USING (doc_id)
"""


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts look like the template's own marks."""
    small_batches(spark)
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(table(spark, sf_dir, "conversations").select(*own.columns).unionByName(own)))


OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), sized AS (SELECT *, length(role) + length(text) + len(regexp_extract_all(text, '###|</turn>')) + 15 AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.digests(bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), toxicity.score(model, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.REJECT).cast("int"))


def op6_kdtree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.kdtree_shards(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derivative records of all pages, in short: what they refer to, what they keep of the source, their digests."""
    small_batches(spark)
    records = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    header = lambda name: F.filter("headers", lambda h: h["name"] == name)[0]["value"]
    return records.select(
        "page_id", "record_id", "type", header("WARC-Refers-To").alias("refers_to"), header("WARC-Target-URI").alias("target_uri"),
        header("WARC-Source-Payload-Digest").alias("payload_digest"), header("WARC-Block-Digest").alias("block_digest"),
        header("Content-Type").alias("content_type"), F.octet_length("block").cast("long").alias("block_bytes"), F.sha2("block", 256).alias("block_sha256"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds; clean documents have none."""
    small_batches(spark)
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Names whose hosts' URLs are on the list that blocks where no rule fits.
LISTED_NAMES = "casino-win free-bets ads-track spam-farm cheap-pills adult-x".split()


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    names = spark.sql(f"SELECT * FROM VALUES {', '.join(f'({n!r})' for n in LISTED_NAMES)} AS t(name)")
    rules = ", ".join(map(str, RULES))
    return urlfilter.judge(pages, spark.sql(f"SELECT * FROM VALUES {rules} AS t(host, path, verdict)"), urlfilter.urls_under(pages, names))


OP9_SQL = r"""
WITH parts AS (
  SELECT page_id, coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') AS raw, coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '^(www|m)\.', '') || regexp_replace(path, '/+$', '') AS name
  FROM p
), listed AS (SELECT DISTINCT name FROM ruled WHERE list_has_any(string_split(host, '.'), ['casino-win', 'free-bets', 'ads-track', 'spam-farm', 'cheap-pills', 'adult-x']))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN name IN (SELECT name FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


#: Words that a host of junk pages has in its name, one family each.
JUNK_WORDS = "casino bets ads spam pills adult".split()


def op9_junk_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op9_url_filter`` with a list of all families of junk hosts, found by the words of their names."""
    pages = table(spark, sf_dir, "pages")
    words = spark.sql(f"SELECT * FROM VALUES {', '.join(f'({w!r})' for w in JUNK_WORDS)} AS t(word)")
    rules = ", ".join(map(str, RULES))
    return urlfilter.judge(pages, spark.sql(f"SELECT * FROM VALUES {rules} AS t(host, path, verdict)"), urlfilter.junk_urls(pages, words))


#: The same rows as those of ``op9_url_filter``: the words find the hosts that its list names.
JUNK_HOSTS_SQL = OP9_SQL


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(langid.fit(docs), docs)
    return docs.select("doc_id", held_out().alias("held_out"), found.alias("found")).select("doc_id", "held_out", "found.*")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align.digests(align.align_documents(table(spark, sf_dir, "documents"), *paths))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", quality.held_out().alias("held_out"), quality.score(forest, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.ACCEPT).cast("int"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


#: crc32 is a fold over the bytes with a table of 256 numbers, each made by eight shifts; near words share a form with one
#: letter taken out of one of them, or the same letter's place taken out of both.
OP13_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY k) AS t FROM (SELECT k, list_reduce(list_prepend(CAST(k AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(k))
), found AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS (SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [195, unicode(ch) - 64] END))),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1]))) AS h FROM counted, crc_table
), words AS (SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, k, word[:k - 1] || word[k + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM v)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM v a JOIN cut b ON a.word = b.rest
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word
), best AS (SELECT word, count(*) AS n_near, min(struct_pack(minus := -other_n, form := other)) AS b FROM near GROUP BY word),
known AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.minus >= 2 * v.n THEN b.form END AS form, CASE WHEN -b.minus >= 2 * v.n THEN -b.minus END AS form_n FROM v LEFT JOIN best USING (word)),
steps(word, root) AS (SELECT word, word FROM known WHERE form IS NULL UNION ALL SELECT k.word, s.root FROM steps s JOIN known k ON k.form = s.word)
SELECT word, form, root, n, n_near, form_n FROM known JOIN steps USING (word)
"""


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_fingerprint": op2_fingerprint,
        "op3_minhash_near_dedup": op3_minhash_near_dedup,
        "op4_chat_format": op4_chat_format,
        "op5_bpe": op5_bpe,
        "op6_kdtree_shards": op6_kdtree_shards,
        "op7_warc": op7_warc,
        "op8_decontamination": op8_decontamination,
        "op9_url_filter": op9_url_filter,
        "op9_junk_hosts": op9_junk_hosts,
        "op10_language_id": op10_language_id,
        "op11_token_alignment": op11_token_alignment,
        "op12_quality": op12_quality,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_minhash_near_dedup": OP3_SQL, "op4_chat_format": OP4_SQL, "op9_url_filter": OP9_SQL, "op9_junk_hosts": JUNK_HOSTS_SQL, "op13_spelling_variants": OP13_SQL}
