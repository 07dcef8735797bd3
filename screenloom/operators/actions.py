"""Actions on refs: where they point on the screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from screenloom.functions.geometry import half_up

#: Half of the way of a swipe, in pixels.
HALF_SWIPE = 200


def extract_ref_bounds(snapshots: DataFrame, key: list[str]) -> DataFrame:
    """``ref`` and its box for each line of a snapshot that has both; the last line of a ref counts."""
    rows = snapshots.select(*key, F.posexplode(F.split("snapshot", "\n")).alias("pos", "line"))
    box = [F.regexp_extract("line", r"\[bounds=(\d+),(\d+),(\d+),(\d+)\]", k + 1).cast("int").alias(s) for k, s in enumerate(("left", "top", "right", "bottom"))]
    found = rows.where(F.col("line").rlike(r"\[ref=[nw]\d+\]") & F.col("line").rlike(r"\[bounds=\d+,\d+,\d+,\d+\]"))
    found = found.select(*key, F.regexp_extract("line", r"\[ref=([nw]\d+)\]", 1).alias("ref"), "pos", F.struct(*box).alias("box"))
    return latest(found, [*key, "ref"], "pos", "box").select(*key, "ref", "box.*")


def latest(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """The last value of each key."""
    return df.groupBy(*key).agg(F.max_by(value, order).alias(value))


def center(left: Column, right: Column) -> Column:
    return (left + right) / 2.0


def resolve_refs(actions: DataFrame, bounds: DataFrame) -> DataFrame:
    """Actions (``session, action_id, ref``) with the point of their ref; web refs are scaled and moved first.

    ``bounds``: session, ref, box, and optionally scale, offset_x, offset_y.
    """
    b = bounds
    for name, default in (("scale", 1.0), ("offset_x", 0), ("offset_y", 0)):
        if name not in b.columns:
            b = b.withColumn(name, F.lit(default))
    j = actions.join(b, ["session", "ref"], "left")
    web = F.startswith("ref", F.lit("w"))

    def point(low: str, high: str, offset: str) -> Column:
        c = center(F.col(low), F.col(high))
        return half_up(F.when(web, c * F.col("scale") + F.col(offset)).otherwise(c)).cast("int")

    error = F.when(F.col("left").isNull(), F.concat(F.lit("Unknown ref: "), F.col("ref"), F.lit(". Capture UI first.")))
    return j.select("session", "action_id", "ref", point("left", "right", "offset_x").alias("x"), point("top", "bottom", "offset_y").alias("y"), error.alias("error"))


def captured_before(actions: DataFrame, captures: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """``actions`` with the ``capture_id`` of their session's newest capture at or before their ``ts``; null without one.

    Of captures of one time the one with the greatest id is the newest. Time is cut into slices, and only within a slice are
    captures and actions put in order; what was newest before a slice is found from one row a slice. So a session with very
    many actions is dealt over its slices.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    cut_ = lambda df: df.withColumn("_slice", F.floor(micros / (slice_seconds * 1_000_000)))
    moment = F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("capture_id").alias("id"))
    seen = cut_(captures).select("session", "_slice", moment.alias("_moment"))
    before = seen.groupBy("session", "_slice").agg(F.max("_moment").alias("_last"))
    # captures of a slice, actions of a slice, and a mark for each slice of either
    marks = before.unionByName(cut_(actions).select("session", "_slice", F.lit(None).cast(before.schema["_last"].dataType).alias("_last")).distinct())
    marks = marks.groupBy("session", "_slice").agg(F.max("_last").alias("_last"))
    earlier = W.partitionBy("session").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = marks.select("session", "_slice", F.max("_last").over(earlier).alias("_carried"))
    row = F.struct(*actions.columns)
    both = cut_(actions).select("session", "_slice", F.col("ts").cast("timestamp").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(seen.schema["_moment"].dataType).alias("_moment"), row.alias("_row"))
    both = both.unionByName(seen.select("session", "_slice", F.col("_moment.ts").alias("_at"), F.lit(0).alias("_kind"), "_moment", F.lit(None).cast(both.schema["_row"].dataType).alias("_row")))
    so_far = W.partitionBy("session", "_slice").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    met = both.withColumn("_inside", F.max("_moment").over(so_far)).where("_kind = 1").join(carried, ["session", "_slice"], "left")
    return met.select("_row.*", F.coalesce("_inside.id", "_carried.id").alias("capture_id"))


def resolve_refs_at(actions: DataFrame, captures: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """``resolve_refs`` over time: an action meets the refs of the newest capture before it, and no older ones.

    ``actions``: session, action_id, ref, ts; ``captures``: session, capture_id, ts, snapshot, and optionally scale, offset_x and
    offset_y of that capture's web view.
    """
    placed = captured_before(actions, captures, slice_seconds)
    own = [c for c in ("scale", "offset_x", "offset_y") if c in captures.columns]
    found = extract_ref_bounds(captures, ["capture_id"])
    if own:
        found = found.join(captures.select("capture_id", *own), "capture_id")
    # an action without a capture has a key of its own, so that such actions of a session aren't one hot key
    key = F.coalesce(F.col("capture_id").cast("string"), F.concat(F.lit("none "), F.col("action_id").cast("string")))
    resolved = resolve_refs(placed.select(key.alias("session"), F.struct("session", "action_id", "capture_id").alias("action_id"), "ref"), found.withColumn("session", F.col("capture_id").cast("string")).drop("capture_id"))
    return resolved.select("action_id.session", "action_id.action_id", "action_id.capture_id", "ref", "x", "y", "error")


def swipe_path(actions: DataFrame) -> DataFrame:
    """Start and end of a swipe in a ``direction`` around (``x``, ``y``)."""
    d = F.col("direction")
    dx = F.when(d == "left", HALF_SWIPE).when(d == "right", -HALF_SWIPE).otherwise(0)
    dy = F.when(d == "up", HALF_SWIPE).when(d == "down", -HALF_SWIPE).otherwise(0)
    x, y = F.col("x"), F.col("y")
    return actions.withColumns({"start_x": x + dx, "start_y": y + dy, "end_x": x - dx, "end_y": y - dy})
