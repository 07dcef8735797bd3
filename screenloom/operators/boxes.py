"""Detections: decoding, overlaps, suppression, labels and crops."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from screenloom.functions.geometry import half_up, iou

CORNERS = ("x1", "y1", "x2", "y2")
#: Detector classes.
LABELS_EN = """BackgroundImage Bottom_Navigation Card CheckBox Checkbox CheckedTextView Drawer EditText Icon Image Map Modal
Multi_Tab PageIndicator Remember Spinner Switch Text TextButton Toolbar UpperTaskBar""".split()
LABELS_ZH = "背景图 底部导航 卡片 复选框 复选框 可选中文本 抽屉 输入框 图标 图片 地图 弹窗/模态 多标签 页面指示器 记住选项 下拉框 开关 文本 文字按钮 工具栏 顶栏".split()
#: Defaults of the detector.
CONFIDENCE, OVERLAP, MOST = 0.15, 0.45, 50


def label_classes(detections: DataFrame) -> DataFrame:
    """``label_en`` and ``label_zh`` of each class; others by their number."""
    known = F.col("class_id").between(0, len(LABELS_EN) - 1)
    at = lambda names: F.get(F.array(*map(F.lit, names)), F.col("class_id"))
    number = F.col("class_id").cast("string")
    return detections.withColumns({"label_en": F.when(known, at(LABELS_EN)).otherwise(F.concat(F.lit("Unknown#"), number)), "label_zh": F.when(known, at(LABELS_ZH)).otherwise(F.concat(F.lit("未知类别#"), number))})


def decode_detections(scores: DataFrame, confidence: float = CONFIDENCE, sigmoid: bool = False) -> DataFrame:
    """Anchors (``id``, ``values``: cx, cy, w, h, then a score per class) to boxes with the best class, the first of equals."""
    logits = F.slice("values", 5, F.size("values") - 4)
    best = F.array_max(logits)
    score = 1 / (1 + F.exp(-best)) if sigmoid else best
    v = F.col("values")
    out = scores.select(
        "id", (v[0] - v[2] / 2).alias("x1"), (v[1] - v[3] / 2).alias("y1"), (v[0] + v[2] / 2).alias("x2"), (v[1] + v[3] / 2).alias("y2"),
        score.alias("score"), (F.array_position(logits, best) - 1).cast("int").alias("class_id"),
    )
    return out.where(F.col("score") >= confidence)


#: Sides of cells in the finest grid and of the largest boxes in it; each further grid is so many times coarser.
CELL, LARGEST, COARSER = 128, 1024, 16


def _cells(df: DataFrame, least: float) -> DataFrame:
    """A row for each cell of a box (at most 100) in the grid of its size, its ``own``, and in those of boxes it may meet.

    Two boxes overlap by no more than the ratio of their longer sides: much larger ones are not asked for.
    """
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    level = lambda x: F.greatest(F.lit(0), F.ceil(F.log(F.greatest(x, F.lit(1.0)) / LARGEST) / math.log(COARSER))).cast("int")
    df = df.withColumn("_own", level(side)).withColumn("_grid", F.explode(F.sequence("_own", level(side / max(least, 1e-9)))))
    cell = CELL * F.pow(F.lit(float(COARSER)), "_grid")
    span = lambda low, high: F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))
    return df.withColumn("_cx", F.explode(span("x1", "x2"))).withColumn("_cy", F.explode(span("y1", "y2")))


def box_iou_pairs(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """``image``, ``a``, ``b``, ``iou`` of boxes (``image, id, x1, y1, x2, y2``) that overlap more than ``least``.

    Boxes meet in the cells of grids; a pair is taken in the grid of the larger one, in the cell of the upper left corner of
    what they share, once.
    """
    left = _cells(a.select("image", F.col("id").alias("a"), *CORNERS), least).alias("l")
    right = _cells(b.select("image", F.col("id").alias("b"), *CORNERS), least).alias("r")
    met = left.join(right, ["image", "_grid", "_cx", "_cy"]).where((F.col("l._own") == F.col("_grid")) | (F.col("r._own") == F.col("_grid")))
    one, two = [F.col(f"l.{c}") for c in CORNERS], [F.col(f"r.{c}") for c in CORNERS]
    cell = CELL * F.pow(F.lit(float(COARSER)), "_grid")
    first = (F.floor(F.greatest(one[0], two[0]) / cell) == F.col("_cx")) & (F.floor(F.greatest(one[1], two[1]) / cell) == F.col("_cy"))
    return met.where(first).select("image", "a", "b", iou(one, two).alias("iou")).where(F.col("iou") > least)


def nms(detections: DataFrame, overlap: float = OVERLAP, most: int = MOST) -> DataFrame:
    """Greedy suppression per image over all classes, the ``most`` best of each (``image, seq, score``, corners).

    An image's boxes are gathered in order of score, ties by ``seq``, and scanned once: a box is kept if no kept box
    overlaps it, until ``most`` are. One shuffle by image; an image has as many boxes as a detector gives it.
    """
    row = F.struct((-F.col("score")).alias("_order"), "seq", *(c for c in detections.columns if c not in ("image", "seq")))
    gathered = detections.groupBy("image").agg(F.sort_array(F.collect_list(row)).alias("_boxes"))
    none = F.filter("_boxes", lambda b: F.lit(False))

    def step(kept: Column, box: Column) -> Column:
        beaten = F.exists(kept, lambda k: iou([k[c] for c in CORNERS], [box[c] for c in CORNERS]) > overlap)
        return F.when((F.size(kept) >= most) | beaten, kept).otherwise(F.concat(kept, F.array(box)))

    kept = gathered.select("image", F.explode(F.aggregate("_boxes", none, step)).alias("_b"))
    return kept.select(*(F.col("image") if c == "image" else F.col(f"_b.{c}") for c in detections.columns))


def caption_crops(detections: DataFrame, images: DataFrame, captions: DataFrame) -> DataFrame:
    """Crops clamped to their image, empty ones dropped, with the caption or its error of the same index."""
    d = detections.join(images, "image")
    clamp = lambda c, high: F.greatest(F.lit(0), F.least(half_up(F.col(c)).cast("int"), F.col(high)))
    boxes = d.select("image", "index", clamp("x1", "width").alias("left"), clamp("y1", "height").alias("top"), clamp("x2", "width").alias("right"), clamp("y2", "height").alias("bottom"))
    boxes = boxes.where("right > left AND bottom > top")
    return boxes.join(captions, ["image", "index"], "left").withColumn("caption", F.coalesce("caption", "error", F.lit(""))).drop("error")


def dominant_webview(views: DataFrame, screens: DataFrame) -> DataFrame:
    """Per screen the web view with the largest visible area, the first of equals; more than half of the screen is a web page.

    ``views``: screen, position, corners; ``screens``: screen, width, height.
    """
    j = views.join(screens, "screen")
    side = lambda low, high, most: F.greatest(F.lit(0), F.least(F.col(high), F.col(most)) - F.greatest(F.col(low), F.lit(0)))
    area = (side("x1", "x2", "width") * side("y1", "y2", "height")).cast("double")
    j = j.withColumn("visible_area", area).where("visible_area > 0")
    best = j.withColumn("_k", F.row_number().over(W.partitionBy("screen").orderBy(F.desc("visible_area"), "position"))).where("_k = 1")
    coverage = F.col("visible_area") / (F.col("width") * F.col("height"))
    return best.select("screen", "position", "visible_area", coverage.alias("coverage"), screen_area_coverage(coverage).alias("is_web"))


def screen_area_coverage(coverage: Column) -> Column:
    return coverage > 0.5
