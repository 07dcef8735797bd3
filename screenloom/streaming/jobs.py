"""Structured Streaming: evaluation as captures land, and the latest refs of each session, both with states by key."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from screenloom.operators import evaluate
from screenloom.sources.files import artifacts_of, read_captures
from screenloom.sources.texts import snapshot_nodes

FILES = "path string, modificationTime timestamp, length long, content binary"


def _evaluated(artifacts: DataFrame, checkpoint: str, evidence: DataFrame, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Scores of each run of which artifacts land.

    The state is a number for each piece of evidence of a run: how many nodes have met it so far. A file adds to all of its
    baseline's evidence, zeros as well, so a batch reads the files that have landed and gives all scores of their runs. The
    numbers belong to the evidence that a checkpoint began with; other evidence takes a checkpoint of its own.
    """
    keys, told = ["baseline_id", "run_id"], [c for c in evidence.columns if c != "baseline_id"]
    asked = evidence.groupBy(*evidence.columns).agg(F.count("*").alias("_copies"))
    asked = asked.groupBy("baseline_id").agg(F.collect_list(F.struct(*told, "_copies")).alias("_asked"))
    shots = artifacts.where("type = 'llm_input' AND schema_status = 'PASS'").select(*keys, snapshot_nodes(F.col("content")).alias("_nodes"))
    fits = lambda e: lambda n: ((e["role"] == "") | (n["role"] == e["role"])) & ((e["name"] == "") | (n["name"] == e["name"]))
    met = F.transform("_asked", lambda e: F.struct(e.alias("e"), F.size(F.filter(F.col("_nodes"), fits(e))).alias("n")))
    rows = shots.join(asked, "baseline_id").select(*keys, F.explode(met).alias("_x")).select(*keys, "_x.e.*", "_x.n")
    counts = rows.groupBy(*keys, *told, "_copies").agg(F.sum("n").alias("actual_count"))

    def batch(df: DataFrame, number: int) -> None:
        each = df.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).drop("_copies", "_copy")
        sink(evaluate.score_targets(evaluate.evaluate_counts(each)), number)

    return counts.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_evaluate(spark: SparkSession, root: str, checkpoint: str, evidence: DataFrame, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Scores of each run whose files land under ``root``, per batch to ``sink``; what landed before counts too.

    Runs in a session whose state store is RocksDB (``rocksdb``).
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(root)
    return _evaluated(artifacts_of(files), checkpoint, evidence, sink)


def stream_evaluate_table(spark: SparkSession, root: str, checkpoint: str, evidence: DataFrame, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """``stream_evaluate`` for captures that land in the table of ``write_captures`` at ``root``."""
    return _evaluated(read_captures(spark, root, stream=True), checkpoint, evidence, sink)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start meanwhile keep their state in RocksDB, which states with several values need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


REF = re.compile(r"\[ref=([nw]\d+)\].*?\[bounds=(\d+),(\d+),(\d+),(\d+)\]")
REFS = "session long, ts timestamp, refs array<struct<ref:string,left:int,top:int,right:int,bottom:int>>"


class LatestRefs(StatefulProcessor):
    """A session's state is its latest snapshot's time, one number, which goes when no snapshot came for ``idle_ms``."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "micros long", self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.latest.get()[0] if self.latest.exists() else None
        latest, refs = before, None
        for b in rows:
            for ts, text in zip(b["ts"], b["snapshot"], strict=True):
                micros = ts.value // 1000
                if latest is None or micros >= latest:
                    latest, refs = micros, [(m[1], *map(int, m.groups()[1:])) for m in REF.finditer(text or "")]
        if refs is not None:
            self.latest.update((latest,))
            names = ("ref", "left", "top", "right", "bottom")
            yield pd.DataFrame({"session": [key[0]], "ts": [pd.Timestamp(latest, unit="us")], "refs": [[dict(zip(names, r, strict=True)) for r in refs]]})

    def close(self) -> None:
        pass


def refs_of(snapshot: Column) -> Column:
    """The refs of a snapshot with their boxes, as in ``REFS``."""
    found = F.regexp_extract_all(F.coalesce(snapshot, F.lit("")), F.lit(f"(?d)({REF.pattern})"), 1)
    part = lambda line, k: F.regexp_extract(line, f"(?d){REF.pattern}", k)
    boxes = lambda line: (part(line, k + 2).cast("int").alias(name) for k, name in enumerate(("left", "top", "right", "bottom")))
    return F.transform(found, lambda line: F.struct(part(line, 1).alias("ref"), *boxes(line)))


def stream_ref_table(snapshots: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """``session, ts, refs``: a new snapshot (``session, ts, snapshot``) takes the place of all refs before it.

    ``refs`` are structs of a ref and its box. A session of which snapshots come gives its latest refs, once a batch; an older
    snapshot that comes late changes nothing. The state of a session is its latest time and refs, an aggregate of Spark.
    With ``idle_ms`` the state is the time alone and goes when no snapshot came for so long (of the clock), a late snapshot gives
    no row, and each session is a call of Python. That needs the RocksDB state store.
    """
    if idle_ms:
        return snapshots.groupBy("session").transformWithStateInPandas(LatestRefs(idle_ms), REFS, "Update", "ProcessingTime")
    # of one time the snapshot that comes later counts: ``max_by`` keeps the old value only where its time is greater
    latest = snapshots.select("session", "ts", refs_of(F.col("snapshot")).alias("refs")).groupBy("session").agg(F.max_by(F.struct("ts", "refs"), "ts").alias("_latest"))
    return latest.select("session", "_latest.ts", "_latest.refs")
