"""Rectangles, letterboxes and overlaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenloom.schema import BOUNDS

_INTS = r"^\[(-?\d+),(-?\d+)\]\[(-?\d+),(-?\d+)\]$"
_FLOATS = r"\[\s*(-?[\d.]+),\s*(-?[\d.]+)\s*\],\s*\[\s*(-?[\d.]+),\s*(-?[\d.]+)\s*\]"
SIDES = ("left", "top", "right", "bottom")


def half_up(c: Column) -> Column:
    """Rounds .5 towards positive infinity, for negative values too."""
    return F.floor(c + 0.5)


def parse_bounds(c: Column) -> Column:
    """``[l,t][r,b]`` to a rectangle; anything else is null."""
    parts = [F.regexp_extract(c, _INTS, k + 1).cast("int").alias(s) for k, s in enumerate(SIDES)]
    return F.when(c.rlike(_INTS), F.struct(*parts)).cast(BOUNDS)


def parse_rect_float(c: Column) -> Column:
    """``[x, y],[x, y]`` with decimals to a rectangle of whole pixels, wherever it stands in the text."""
    parts = [half_up(F.regexp_extract(c, _FLOATS, k + 1).cast("double")).cast("int").alias(s) for k, s in enumerate(SIDES)]
    return F.when(c.rlike(_FLOATS), F.struct(*parts)).cast(BOUNDS)


def valid(b: Column) -> Column:
    """A rectangle with an area; false for none."""
    return F.coalesce((b["right"] > b["left"]) & (b["bottom"] > b["top"]), F.lit(False))


def halved(total: Column) -> Column:
    """Half of a whole number, cut towards zero."""
    return F.signum(total).cast("int") * F.floor(F.abs(total) / 2).cast("int")


def box_geometry(b: Column) -> Column:
    """Width, height, centre and validity of a rectangle."""
    return F.struct(
        (b["right"] - b["left"]).alias("width"),
        (b["bottom"] - b["top"]).alias("height"),
        halved(b["left"] + b["right"]).alias("center_x"),
        halved(b["top"] + b["bottom"]).alias("center_y"),
        valid(b).alias("valid"),
    )


def letterbox_params(width: Column, height: Column, side: int) -> Column:
    """How an image is fitted into a square: ratio, new size and the padding on either side."""
    ratio = F.least(F.lit(float(side)) / width, F.lit(float(side)) / height)
    new_w, new_h = (F.greatest(F.lit(1), half_up(x * ratio).cast("int")) for x in (width, height))
    return F.struct(ratio.alias("ratio"), new_w.alias("new_w"), new_h.alias("new_h"), ((side - new_w) / 2.0).alias("pad_x"), ((side - new_h) / 2.0).alias("pad_y"))


def unletterbox(box: list[Column], ratio: Column, pad_x: Column, pad_y: Column, width: Column, height: Column, side: int) -> list[Column]:
    """Corners in the square back to the image, clamped to it. A coordinate from 0 to 1.01 is a share of the square, each by itself."""
    scaled = [F.when(c.between(0, 1.01), c * side).otherwise(c) for c in box]
    out = []
    for k, c in enumerate(scaled):
        pad, most = (pad_x, width) if k % 2 == 0 else (pad_y, height)
        out.append(F.greatest(F.lit(0.0), F.least(most.cast("double"), (c - pad) / ratio)))
    return out


def clamp_thresholds(conf: Column, iou: Column) -> tuple[Column, Column]:
    """Thresholds within the bounds that a detector accepts."""
    return F.least(F.greatest(conf, F.lit(0.001)), F.lit(0.999)), F.least(F.greatest(iou, F.lit(0.05)), F.lit(0.95))


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2)."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: F.greatest(F.lit(0.0), x[2] - x[0]) * F.greatest(F.lit(0.0), x[3] - x[1])
    return w * h / (area(a) + area(b) - w * h + 1e-6)
