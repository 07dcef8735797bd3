"""WARC derivatives: linked metadata and plain-text conversion records of responses.

Each ``response`` record gives a ``metadata`` record (title, language, links and sizes) and a ``conversion`` record (the
plain text). Both name the response in ``WARC-Refers-To`` (and what the response itself refers to in
``WARC-Refers-To-Target-URI`` and ``-Date``, where it has them), keep its target URI, date, payload digest and HTTP
headers, and have block digests of their own, so that a reader can check every link and every byte.

Records are rows: ``record_id``, ``type``, ``headers`` (an ordered list) and ``block`` (bytes); ``serialised`` gives the
bytes of a record as a WARC 1.1 file has them, and ``parsed`` reads them again.

A page is read once from left to right, in time in proportion to its length whatever it holds: an end that was looked for
in vain is not looked for again.

Defined cases: a null page is an empty body; a body that isn't UTF-8 is read with replacement characters; null URLs are
empty target URIs; record ids are made from a page's id, URL and body, and copies of a page are numbered, so that repeated
rows have records of their own and ids never depend on how rows are dealt; of a source header that repeats, all are kept; a tag without ``>`` is text, a comment, script or style without an end is a tag like any other; extra columns
are not read; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.llm.bloom import impossible, possible

RECORD = "page_id long, record_id string, type string, headers array<struct<name:string,value:string>>, block binary"
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
BREAKS = {*"p div br li ul ol h1 h2 h3 h4 h5 h6 article section nav footer header table tr body title".split()}
#: Elements whose content is no text; what a head holds is looked at for the title.
DROPPED = {n: re.compile(rf"(?i)</{n}\s*>") for n in ("script", "style", "template", "noscript", "head", "title")}
LANG = re.compile(r"(?i)\blang\s*=\s*[\"']?([\w-]+)")
HREF = re.compile(r"(?i)\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
SPACES = re.compile(r"[^\S\n]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '\x1f'.join(parts))}>"


def clean(value: str) -> str:
    """A header's value has no line breaks."""
    return re.sub(r"[\r\n]+\s*", " ", value)


def response(page_id: int | None, url: str | None, body: str | None, place: int = 0) -> dict:
    """A page as the response record of a crawl: an HTTP head and the body. ``place`` tells equal pages apart."""
    url, payload = clean(url or ""), (body or "").encode("utf-8", "surrogatepass")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload
    return {
        "page_id": page_id, "record_id": identifier("response", str(page_id), url, digest(payload), *([str(place)] if place else [])), "type": "response", "block": block,
        "headers": [("WARC-Date", DATE), ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block))],
    }


def http_parts(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """The HTTP headers and the payload of a response's block."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return [(n.strip(), v.strip()) for n, _, v in (x.partition(":") for x in lines)], payload


class Page:
    """What a page shows and says about itself: ``text``, ``title``, ``lang`` and ``links``."""

    def __init__(self, page: str):
        self.title, self.lang, self.links = "", "", []
        self.text = self.read(page)

    def read(self, page: str) -> str:
        out: list[str] = []
        endless: set[str] = set()
        ends: dict[str, re.Match | None] = {}  # the next end of each element that was looked for
        at, shown_from, titled = 0, 0, False  # text before ``shown_from`` belongs to the head
        while (begin := page.find("<", at)) >= 0:
            if at >= shown_from:
                out.append(page[at:begin])
            if page.startswith("<!--", begin) and "<!--" not in endless:
                if (end := page.find("-->", begin + 4)) >= 0:
                    out.append(" ")
                    at = end + 3
                    continue
                endless.add("<!--")
            if (end := page.find(">", begin)) < 0:
                at = begin
                break
            tag, at = page[begin : end + 1], end + 1
            if not (named := NAME.match(tag)):
                continue
            name, opens = named[1].lower(), tag[1] != "/"
            if opens and name in DROPPED and name not in endless:
                close = ends.get(name)
                if close is None or close.start() < at:
                    close = DROPPED[name].search(page, at)
                    ends[name] = close
                if close is None:
                    endless.add(name)
                elif name == "head":
                    shown_from = max(shown_from, close.end())
                    out.append(" ")
                elif name != "title":
                    at = close.end()
                    out.append(" ")
                elif not titled:
                    self.title, titled = clean(" ".join(entities.unescape(page[at : close.start()]).split())), True
            if name in BREAKS and at >= shown_from:
                out.append("\n")
            if opens and name == "html" and not self.lang and (lang := LANG.search(tag)):
                self.lang = lang[1].lower()
            if opens and name == "a" and (link := HREF.search(tag)):
                self.links.append(entities.unescape(link[1] or link[2] or link[3] or ""))
        if at < len(page):
            out.append(page[max(at, shown_from) :])
        text = entities.unescape("".join(out))
        return "\n".join(x for x in (SPACES.sub(" ", line).strip() for line in text.split("\n")) if x)


#: Headers of a response that its derivatives repeat, before and after the link to it.
BEFORE, AFTER = ("WARC-Target-URI", "WARC-Date"), ("WARC-Refers-To-Target-URI", "WARC-Refers-To-Date")


def derive(record: dict) -> list[dict]:
    """The metadata and the conversion record of a response; other types have none."""
    if record["type"] != "response":
        return []
    http, payload = http_parts(record["block"])
    page = Page(payload.decode("utf-8", "replace"))
    given = lambda *names: [(n, v) for k in names for n, v in record["headers"] if n == k]
    source = [*given(*BEFORE), ("WARC-Refers-To", record["record_id"]), *given(*AFTER)]
    source += [("WARC-Source-Payload-Digest", v) for _, v in given("WARC-Payload-Digest")] or [("WARC-Source-Payload-Digest", digest(payload))]
    source += [(f"WARC-Source-HTTP-{n}", clean(v)) for n, v in http]
    text = page.text.encode("utf-8", "surrogatepass")
    fields = [("title", page.title), ("language", page.lang), ("payload-bytes", str(len(payload))), ("text-bytes", str(len(text)))]
    fields += [("outlink", clean(x)) for x in page.links]
    about = "".join(f"{n}: {v}\r\n" for n, v in fields).encode("utf-8", "surrogatepass")
    out = []
    for kind, content, block in (("metadata", "application/warc-fields", about), ("conversion", "text/plain; charset=utf-8", text)):
        headers = [*source, ("Content-Type", content), ("WARC-Block-Digest", digest(block))]
        if kind == "metadata":  # the two derivatives are linked with each other as well
            headers.append(("WARC-Concurrent-To", identifier("conversion", record["record_id"])))
        out.append({"page_id": record["page_id"], "record_id": identifier(kind, record["record_id"]), "type": kind, "headers": headers, "block": block})
    return out


def serialised(record: dict) -> bytes:
    """The record as it stands in a WARC file."""
    head = [("WARC-Type", record["type"]), ("WARC-Record-ID", record["record_id"]), *record["headers"], ("Content-Length", str(len(record["block"])))]
    return VERSION + b"\r\n" + "".join(f"{n}: {v}\r\n" for n, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + record["block"] + b"\r\n\r\n"


def parsed(data: bytes) -> Iterator[dict]:
    """The records of a WARC file's bytes; wrong lengths and digests are errors."""
    at = 0
    while at < len(data):
        gap = data.find(b"\r\n\r\n", at)
        head = data[at : max(gap, at)]
        first, *lines = head.split(b"\r\n")
        if first != VERSION:
            raise ValueError(f"no record begins at byte {at}")
        headers = [tuple(x.decode("utf-8", "surrogatepass").split(": ", 1)) for x in lines]
        known = dict(headers)
        begin = at + len(head) + 4
        end = begin + int(known["Content-Length"])
        block = data[begin:end]
        if data[end : end + 4] != b"\r\n\r\n" or known["WARC-Block-Digest"] != digest(block):
            raise ValueError(f"the record at byte {at} is damaged")
        yield {"record_id": known["WARC-Record-ID"], "type": known["WARC-Type"], "headers": [h for h in headers if h[0] not in ("WARC-Type", "WARC-Record-ID", "Content-Length")], "block": block}
        at = end + 4


def frame(records: Iterable[dict]) -> pd.DataFrame:
    rows = [(r["page_id"], r["record_id"], r["type"], [{"name": n, "value": v} for n, v in r["headers"]], r["block"]) for r in records]
    return pd.DataFrame(rows, columns=["page_id", "record_id", "type", "headers", "block"]).astype({"page_id": "Int64"})


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Pages as response records. Of equal pages the first has the plain id and the others are numbered, however rows are dealt.

    A look at hashes alone finds which pages may be repeated; only those are shuffled, and equal ones are counted before.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = zip(b["page_id"], b["url"], b["body"], b["place"], strict=True)
            yield frame(response(None if pd.isna(i) else int(i), u, t, int(p)) for i, u, t, p in rows)

    page = ["page_id", "url", "body"]
    # what has the same id is the same page: null and empty texts, and URLs that differ in line breaks
    url_, body_ = F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), r"[\r\n]+\s*", " "), F.coalesce(F.col(body).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), url_.alias("url"), body_.alias("body"))
    rows = rows.withColumn("key", F.xxhash64(*page))
    repeated = rows.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
    times = possible(rows, repeated).groupBy(*page).agg(F.count("*").alias("times"))
    copies = times.select(*page, F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("place"))
    return impossible(rows, repeated).select(*page, F.lit(0).cast("long").alias("place")).unionByName(copies).mapInPandas(run, RECORD)


def derivatives(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of response records. Map only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = zip(b["page_id"], b["record_id"], b["type"], b["headers"], b["block"], strict=True)
            yield frame(d for i, r, k, h, x in rows for d in derive({"page_id": None if pd.isna(i) else int(i), "record_id": r, "type": k, "headers": [(y["name"], y["value"]) for y in h], "block": bytes(x)}))

    return records.select("page_id", "record_id", "type", "headers", "block").mapInPandas(run, RECORD)


def warc_bytes(records: DataFrame) -> DataFrame:
    """``record_id`` and the ``bytes`` of each record, ready for a file of WARC records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = zip(b["record_id"], b["type"], b["headers"], b["block"], strict=True)
            yield pd.DataFrame({"record_id": b["record_id"], "bytes": [serialised({"record_id": r, "type": k, "headers": [(y["name"], y["value"]) for y in h], "block": bytes(x)}) for r, k, h, x in rows]})

    return records.select("record_id", "type", "headers", "block").mapInPandas(run, "record_id string, bytes binary")
