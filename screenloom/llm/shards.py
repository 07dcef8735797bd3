"""Sharding by k-d tree partitioning, in DataFrame operations alone.

Every text has a point of metadata (bytes, characters, lines, words; each a function of the text) and a weight in
bytes. The tree is grown level by level: each node that still has to give several shards is split along its widest
dimension at a weighted quantile, so that both sides get bytes in proportion to the shards they have to give, until a
node gives one shard. All splits of a level are found together by refining histograms of byte sums (``GRID`` cells a
node and pass), so what reaches the driver is bounded by shards times cells and no node is ever sorted or gathered.

On each dimension, points of equal value follow each other by a hash of the text, so equal texts stay in one shard. A
text whose copies together outweigh a shard (there are fewer such texts than shards) is dealt out by the hash of the
document's id instead: the law of equal bytes goes first.

Defined cases: a null text weighs the overhead only and counts as empty; fewer rows than shards leave shards empty;
repeated rows are rows of their own, each with a slot; an empty table gives no rows; extra columns are not read. A
dimension that has one value in a node has no width there and is split by the hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from screenloom.llm.common import settle

OVERHEAD = 16
GRID, PASSES = 512, 8
#: Bits of a coordinate that hold the value; the rest break ties.
VALUE_BITS, TIE_BITS = 22, 40
#: A split this close to its aim (as a share of a shard's bytes) is left as it is.
CLOSE = 0.002
SLOT_ROWS = 20_000


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What sharding needs to know of each document; the text goes no further."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(t) + OVERHEAD).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.xxhash64(t).alias("text_hash"),
        F.array(F.octet_length(t).cast("double"), F.length(t).cast("double"), lines.cast("double"), words.cast("double")).alias("at"),
    )


def coordinates(rows: DataFrame, least: list[float], most: list[float], heavy: list[int]) -> DataFrame:
    """One long per dimension: the value's place between the least and the greatest, on a log scale, then the tie's hash."""
    tie = F.col("text_hash")
    if heavy:
        tie = F.when(F.col("text_hash").isin(heavy), F.xxhash64("doc_id", "text_hash")).otherwise(tie)
    tie = F.shiftrightunsigned(tie, 64 - TIE_BITS)
    scale = (1 << VALUE_BITS) - 1

    def place(d: int) -> Column:
        low, high = least[d], most[d]
        share = F.log1p(F.col("at")[d] - low) / F.log1p(F.lit(high - low)) if high > low else F.lit(0.0)
        return F.shiftleft(F.floor(share * scale).cast("long"), TIE_BITS).bitwiseOR(tie)

    return rows.select("doc_id", "size", "text_crc32", "text_hash", F.array(*(place(d) for d in range(len(least)))).alias("at"))


def listed(spark: SparkSession, names: str, rows: list[tuple[int, ...]]) -> DataFrame:
    """A few rows of longs, at most one for each node, as a table to broadcast."""
    values = ", ".join("(" + ", ".join(f"{v}L" for v in r) + ")" for r in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t({names})"))


def grow(points: DataFrame, shards: int, target: float) -> DataFrame:
    """``points`` with the ``shard`` of each, the leaf of the tree that it comes to."""
    spark, dimensions = points.sparkSession, 4
    nodes: dict[int, tuple[int, int]] = {0: (0, shards)}  # the first shard that a node gives, and how many
    placed = points
    while opened := {n: v for n, v in nodes.items() if v[1] > 1}:
        here = placed.join(listed(spark, "node", [(n,) for n in opened]), "node")
        ends = [f(F.col("at")[d]).alias(f"{n}{d}") for d in range(dimensions) for n, f in (("min", F.min), ("max", F.max))]
        boxes = {r["node"]: r for r in here.groupBy("node").agg(F.sum("size").alias("bytes"), *ends).collect()}
        search = {}
        for n, box in boxes.items():
            d = max(range(dimensions), key=lambda k: (box[f"max{k}"] >> TIE_BITS) - (box[f"min{k}"] >> TIE_BITS))
            count = opened[n][1]
            search[n] = {"d": d, "low": box[f"min{d}"], "high": box[f"max{d}"], "below": 0, "aim": box["bytes"] * (count // 2) / count, "done": False}
        for _ in range(PASSES):
            wanted = {n: s for n, s in search.items() if not s["done"]}
            if not wanted:
                break
            for s in wanted.values():
                s["step"] = (s["high"] - s["low"]) // GRID + 1
            grid = listed(spark, "node, d, low, high, step", [(n, s["d"], s["low"], s["high"], s["step"]) for n, s in wanted.items()])
            cells = placed.join(grid, "node").select("node", "size", "low", "high", "step", F.expr("at[cast(d AS int)]").alias("x")).where("x BETWEEN low AND high")
            sums: dict[int, dict[int, Row]] = {}
            for r in cells.groupBy("node", F.expr("(x - low) div step").alias("cell")).agg(F.sum("size").alias("bytes"), F.min("x").alias("low"), F.max("x").alias("high")).collect():
                sums.setdefault(r["node"], {})[r["cell"]] = r
            for n, s in wanted.items():
                before = upto = s["below"]
                for c in sorted(sums[n]):
                    before, upto = upto, upto + sums[n][c]["bytes"]
                    if upto >= s["aim"]:
                        break
                begin, end = sums[n][c]["low"], sums[n][c]["high"]
                over, under = upto - s["aim"], s["aim"] - before
                s["cut"] = end if over <= under else begin - 1
                s["done"] = begin == end or min(over, under) <= CLOSE * target
                s["low"], s["high"], s["below"] = begin, end, before
        splits = []
        for n, (first, count) in opened.items():
            left, right = len(nodes), len(nodes) + 1
            nodes[left], nodes[right] = (first, count // 2), (first + count // 2, count - count // 2)
            nodes[n] = (first, 0)
            s = search.get(n, {"d": 0, "cut": 0})  # a node without rows
            splits.append((n, s["d"], s["cut"], left, right))
        side = F.expr("CASE WHEN left IS NULL THEN node WHEN at[cast(d AS int)] <= cut THEN left ELSE right END")
        # written once a level, so that no level works out those above it again
        placed = settle(placed.join(listed(spark, "node, d, cut, left, right", splits), "node", "left").select(*(c for c in points.columns if c != "node"), side.alias("node")))
    leaves = listed(spark, "node, shard", [(n, first) for n, (first, count) in nodes.items() if count == 1])
    return placed.join(leaves, "node").drop("node").withColumn("shard", F.col("shard").cast("int"))


def kdtree_shards(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and the gapless ``slot`` in it, for every row."""
    rows = settle(measured(docs, doc_id, text))
    dimensions = 4
    ends = [f(F.col("at")[d]).alias(f"{n}{d}") for d in range(dimensions) for n, f in (("min", F.min), ("max", F.max))]
    whole = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *ends).first()
    if not whole["n"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    target = whole["bytes"] / shards
    # fewer than ``shards`` texts can outweigh a shard: the list is bounded
    heavy = [r["text_hash"] for r in rows.groupBy("text_hash").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > target).select("text_hash").collect()]
    points = coordinates(rows, [whole[f"min{d}"] for d in range(dimensions)], [whole[f"max{d}"] for d in range(dimensions)], heavy)
    points = settle(points.withColumn("node", F.lit(0).cast("long")))  # written, so that it is a column to join on like any other
    placed = settle(grow(points, shards, target).drop("at"))
    # slots: numbered inside strips of a bounded size, each strip beginning where the one before it ends
    strips = max(1, -(-whole["n"] // (shards * SLOT_ROWS)))
    placed = placed.withColumn("strip", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(strips)).cast("int"))
    sizes = placed.groupBy("shard", "strip").agg(F.count("*").alias("n"))
    begins = sizes.select("shard", "strip", (F.sum("n").over(W.partitionBy("shard").orderBy("strip")) - F.col("n")).alias("begin"))
    inside = F.row_number().over(W.partitionBy("shard", "strip").orderBy("doc_id", "text_crc32", "size")) - 1
    return placed.withColumn("inside", inside).join(begins, ["shard", "strip"]).select("doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.col("inside")).alias("slot"))
