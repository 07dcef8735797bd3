"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join, in DataFrame operations alone.

Listed URLs are canonical: the lower-cased host without port, login or a leading ``www.`` or ``m.``, then the path
without a trailing slash, query or fragment. Their hashes fill a blocked Bloom filter of a bounded size (``bloom.py``),
which is broadcast; the exact hash join removes its false positives: against the list itself where it has at most
``MAX_SENT`` bytes, else after a shuffle of what passed.

Rules (host, path, verdict) fit a host and all its subdomains, and paths that start with theirs; the longest wins. They
go the same way: each URL offers the keys that could be rules for it (a suffix of its host of as many labels as some
rule has, with a prefix of its path as long as some rule's), the filter drops nearly all, the exact join decides.

Defined cases: a null URL and one without ``://`` have an empty host and path and are allowed; repeated URLs are judged
alike; a list or rule given twice counts once, of two verdicts for one rule ``block`` wins; empty lists block nothing; extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.llm.bloom import possible
from screenloom.llm.common import settle

#: Rules at most, and bytes of a list of URLs that is still sent to all pages.
MAX_RULES, MAX_SENT = 100_000, 20_000_000
PARTS = "://([^/?#]*)([^?#]*)"
AT = ["page_id", "host", "path"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#``; path: then up to ``?``, ``#``. Both empty without ``://``."""
    host = F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit(""))
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def bare_host(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":\d*$", ""), r"^(www|m)\.", "")


def canonical(host: Column, path: Column) -> Column:
    """What a listed URL is called."""
    return F.concat(bare_host(host), F.regexp_replace(path, "/+$", ""))


def urls_under(pages: DataFrame, names: DataFrame, url: str = "url") -> DataFrame:
    """``url`` of the pages whose host has one of ``names`` (``name``, a short list) as a label: a list for ``judge``."""
    labels = F.array_distinct(F.split(bare_host(host_and_path(F.col(url))[0]), r"\."))
    return pages.select(F.col(url).alias("url"), F.explode(labels).alias("name")).join(F.broadcast(names), "name", "left_semi").select("url")


def junk_urls(pages: DataFrame, words: DataFrame, url: str = "url") -> DataFrame:
    """``url`` of the pages on hosts with a label of several words joined by hyphens, one of them among ``words`` (``word``)."""
    labels = F.filter(F.split(bare_host(host_and_path(F.col(url))[0]), r"\."), lambda x: F.contains(x, F.lit("-")))
    said = pages.select(F.col(url).alias("url"), F.explode(F.flatten(F.transform(labels, lambda x: F.split(x, "-")))).alias("word"))
    return said.join(F.broadcast(words), "word", "left_semi").select("url")


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of each row.

    ``rules``: host, path, verdict (at most ``MAX_RULES``); ``listed``: url, the URLs to block where no rule fits.
    """
    given = rules.select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host IS NOT NULL")
    rules = given.groupBy(F.concat("host", "path").alias("key")).agg(F.max("verdict").alias("verdict"))
    bound = given.agg(F.count_distinct(F.concat("host", "path")), F.collect_set(F.length("path")), F.collect_set(F.size(F.split("host", r"\.")))).first()
    if bound[0] > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: list whole URLs instead")
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    # what could be a rule for the URL: suffixes of its host at a dot, with each beginning of its path that is as long as some rule's
    labels = F.split("host", r"\.")
    suffixes = F.array_compact(F.array(*(F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in sorted(bound[2])), F.lit(None).cast("string")))
    beginnings = F.array_compact(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(bound[1])), F.lit(None).cast("string")))
    offers = F.flatten(F.transform(suffixes, lambda s: F.transform(beginnings, lambda b: F.concat(s, b))))
    ruled = possible(rows.where("host <> ''").select(*AT, F.explode(offers).alias("key")), rules.select("key")).join(F.broadcast(rules), "key")
    ruled = ruled.select(*AT, F.struct(F.length("key").alias("size"), F.col("key"), F.col("verdict")).alias("rule"), F.lit(False).alias("listed"))
    names = settle(listed.select(canonical(*host_and_path(F.col("url"))).alias("key")).where("key <> ''").distinct())
    size = names.agg(F.coalesce(F.sum(F.octet_length("key") + 16), F.lit(0))).first()[0]
    # a short list goes to the pages, so that very many pages of one URL stay where they are; for a long one large keys are split
    exact = F.broadcast(names) if size <= MAX_SENT else names.hint("merge")
    blocked = possible(rows.where("host <> ''").withColumn("key", canonical(F.col("host"), F.col("path"))), names).join(exact, "key", "left_semi")
    marks = ruled.unionByName(blocked.select(*AT, F.lit(None).cast(ruled.schema["rule"].dataType).alias("rule"), F.lit(True).alias("listed")))
    marks = marks.groupBy(*AT).agg(F.max("rule").alias("best"), F.bool_or("listed").alias("listed"))
    same = reduce(Column.__and__, [F.col(f"p.{c}").eqNullSafe(F.col(f"m.{c}")) for c in AT])
    return rows.alias("p").join(marks.alias("m"), same, "left").select(
        *(F.col(f"p.{c}") for c in AT),
        F.col("m.best.key").alias("rule"),
        F.coalesce(F.col("m.best.verdict"), F.when(F.col("m.listed"), "block"), F.lit("allow")).alias("verdict"),
    )
