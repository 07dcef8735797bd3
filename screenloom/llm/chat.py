r"""Chat formatting with a grammar round trip.

A turn is rendered as ``### Role: text``, a newline, ``</turn>`` and a newline. The role is one of three titles, or any other role as a
JSON string (``null`` for none). In a text, a *mark* is ``###`` or ``</turn>``; with n backslashes in front it reads
back as n - 1 backslashes and the plain mark, and without any it belongs to the template. So every text has exactly one
escaped form. Each turn is rendered plainly first and parsed again; only where the parser doesn't give back the source,
its marks are escaped and the turn is parsed once more; a turn that still differs is an error, never written.

Turns are complete in themselves, so a conversation is the concatenation of its turns and the parse of it is the parse
of the turns in order.

The loss mask is a list of spans, in code points of the formatted text: those of what assistants say, as the parser found
them. What is learned is the formatted text under the mask, with the escapes taken back.

A conversation is read as a stream of its turns in one task, as its digest is sequential: memory is bounded by a turn,
time by the longest conversation. That holds for the rows without a conversation id as well, which form one.

Defined cases: null texts are empty; null turns sort first, ties by role, then text; rows with a null conversation id
form one conversation; repeated rows are turns of their own; extra columns are not read; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TITLES = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {v: k for k, v in TITLES.items()}
END = "</turn>"
MARK = re.compile(r"(\\*)(###|</turn>)")
HEADER = re.compile(r'### (System|User|Assistant|null|"(?:[^"\\]|\\.)*"): ')


class Malformed(ValueError):
    """The text doesn't follow the grammar."""


def header(role: str | None) -> str:
    return f"### {TITLES.get(role) or json.dumps(role, ensure_ascii=True)}: "


def escaped(text: str) -> str:
    """One more backslash in front of every mark."""
    return MARK.sub(r"\\\g<0>", text)


def unescaped(text: str) -> str:
    """One backslash less in front of every mark that has one."""
    return MARK.sub(lambda m: m[0][1:] if m[1] else m[0], text)


def render(role: str | None, text: str) -> str:
    return f"{header(role)}{text}\n{END}\n"


def parse(rendered: str) -> list[tuple[str | None, str, int, int]]:
    """The turns of a rendered conversation: role, text, and where the text stands in ``rendered``."""
    at, turns = 0, []
    while at < len(rendered):
        if not (head := HEADER.match(rendered, at)):
            raise Malformed(f"no turn begins at {at}")
        title, begin = head[1], head.end()
        role = ROLES[title] if title in ROLES else json.loads(title)
        text, done = [], begin
        for mark in MARK.finditer(rendered, begin):
            text.append(rendered[done : mark.start()])
            done = mark.end()
            if mark[1]:
                text.append(mark[0][1:])
            elif mark[2] != END:
                raise Malformed(f"a turn begins inside another at {mark.start()}")
            else:
                said = "".join(text)
                if not said.endswith("\n") or not rendered.startswith("\n", done):
                    raise Malformed(f"the end at {mark.start()} is not on a line of its own")
                turns.append((role, said[:-1], begin, mark.start() - 1))
                at = done + 1
                break
        else:
            raise Malformed(f"the turn at {at} has no end")
    return turns


def agreed(role: str | None, text: str) -> tuple[str, int, int]:
    """The rendered turn that reads back as exactly ``role`` and ``text``, and where the text stands in it."""
    for candidate in (text, escaped(text)):
        rendered = render(role, candidate)
        try:
            turns = parse(rendered)
        except Malformed:
            continue
        if [t[:2] for t in turns] == [(role, text)]:
            return rendered, turns[0][2], turns[0][3]
    raise Malformed(f"no form of this turn reads back: {text[:100]!r}")


MASK = "array<struct<begin:long,end:long>>"


def format_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: str = "assistant") -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text``, the turn ``formatted`` and its loss mask, row by row: no shuffle.

    ``loss`` holds the spans of ``formatted`` under the mask: the text of turns of the role ``learned``.
    """

    @F.pandas_udf(f"formatted string, loss {MASK}")
    def formatted(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        found = [(r, *agreed(None if r is None else r, t)) for r, t in zip(roles, texts, strict=True)]
        return pd.DataFrame({"formatted": [x for _, x, _, _ in found], "loss": [[{"begin": b, "end": e}] if r == learned else [] for r, _, b, e in found]}, dtype=object)

    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("_f", formatted("role", "text")).select("*", "_f.formatted", "_f.loss").drop("_f")


def conversation_texts(formatted: DataFrame) -> DataFrame:
    """One row per conversation of ``format_turns``: its whole ``formatted`` text and ``loss`` mask, for a training file."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "formatted", "loss")))
    gathered = formatted.groupBy("conv_id").agg(parts.alias("parts"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(MASK).alias("loss"))

    def shifted(done: Column, part: Column) -> Column:
        moved = F.transform(part["loss"], lambda s: F.struct((s["begin"] + done["at"]).alias("begin"), (s["end"] + done["at"]).alias("end")))
        return F.struct((done["at"] + F.length(part["formatted"])).alias("at"), F.concat(done["loss"], moved).alias("loss"))

    return gathered.select("conv_id", F.array_join(F.transform("parts", lambda p: p["formatted"]), "").alias("formatted"), F.aggregate("parts", start, shifted, lambda x: x["loss"]).alias("loss"))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold: counts and digests of the turns parsed again, and of the text under the mask.

    Turns are dealt by conversation and sorted inside the partitions; a conversation of any length is read as a stream
    of turns and never held at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        now, state = object(), None

        def close() -> None:
            if state is not None:
                n, turns, chars, loss, size = state
                out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for b in batches:
            for conv, rendered, loss in zip(b["conv_id"], b["formatted"], b["loss"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(rendered):
                    state[0] += 1
                    state[1].update(f"{'' if role is None else role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    said = unescaped(rendered[span["begin"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(rendered)
            if len(out) >= 1000:
                yield frame(out)
                out = []
        close()
        yield frame(out)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in DIGEST.split(", ")]).astype({"conv_id": "Int64"})

    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted", "loss").mapInPandas(run, DIGEST)
