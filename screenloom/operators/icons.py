"""Icon recognition experiments: inputs, prompts, model output, matching and scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from screenloom.functions.geometry import half_up
from screenloom.functions.roles import first_of
from screenloom.functions.text import icon_norm

#: Groups of words for the same icon.
SYNONYMS = [
    "头像 个人 用户 人像 人头 profile avatar user",
    "电话 通话 拨号 听筒 phone call handset",
    "加号 添加 新增 加 plus add",
    "wifi wi-fi 无线 无线网络 网络 信号",
    "下拉 展开 向下 下箭头 箭头 chevron down",
    "搜索 放大镜 查找 search magnifier",
    "客服 耳机 耳麦 服务 headset support",
    "消息 聊天 气泡 会话 对话 chat message bubble",
    "勾选 勾 对号 待办 稍后 复选 check tick todo",
    "星标 星星 收藏 关注 star favorite",
    "静音 铃铛 免打扰 通知 bell mute silent",
    "邮件 信封 邮箱 mail email envelope",
    "通讯录 联系人 列表 名片 contact contacts addressbook",
    "业务 九宫格 网格 应用 宫格 grid apps workbench",
    "知识 文档 文件 书签 书本 资料 doc document file bookmark",
]
#: Short names of input modes.
MODE_NAMES = {"FULL_IMAGE": "FULL", "FULL_IMAGE_WITH_BOUNDS": "BOUNDS", "FULL_IMAGE_WITH_MARKED_BOUNDS": "MARKED", "FULL_IMAGE_WITH_BOUNDS_BATCHED": "BATCHED", "CROPPED_MONTAGE": "MONTAGE"}

_ENDING = (
    "Write every description in Simplified Chinese. Do not use English except the id and unknown.\n"
    "Use a very short label of 1 to 4 Chinese characters only.\n"
    "Do not write sentences, explanations, modifiers, or punctuation after the label.\n"
    "Use this exact format:\n<id>:<short Chinese label>\n\n"
)
_STOP = "Return exactly {count} lines and stop immediately after the last line.\nNo extra text."
#: Prompt templates; ``{targets}`` are the target lines, each with its line break.
PROMPTS = {
    "FULL_IMAGE": "You are given a full mobile app screenshot.\n\nIdentify the visible app icons that correspond to the target ids below.\n"
    "The target ids are labels for evaluation only. No coordinates are provided in this mode.\n\nTargets:\n{targets}\nOutput exactly one line per target id.\n" + _ENDING
    + "If you cannot confidently match a target id to a visible icon, output:\n<id>:unknown\n\n" + _STOP,
    "FULL_IMAGE_WITH_BOUNDS": "You are given one full mobile app screenshot and a list of target regions.\n\nCoordinate system:\n"
    "- Coordinates are pixel coordinates in the original screenshot.\n- The screenshot size is {width} pixels wide and {height} pixels high.\n"
    "- Valid x range is 0 to {width}. Valid y range is 0 to {height}.\n- The origin (0,0) is the top-left corner of the screenshot.\n"
    "- x increases from left to right. y increases from top to bottom.\n- A region is a rectangle: left edge x, top edge y, right edge x, bottom edge y.\n"
    "- Only inspect pixels inside each rectangle. Ignore all pixels outside that rectangle.\n\nEach target region is defined as:\n<id>=<left>,<top>,<right>,<bottom>\n\n"
    "Task:\nProcess the target regions one by one in the exact order listed below.\n"
    "For each id, look at only that rectangle and describe the icon or visual symbol inside it in short Chinese.\n"
    "Do not infer from nearby text, surrounding list items, or other regions.\n"
    "If a rectangle does not clearly contain an icon or visual symbol, output unknown.\n\nOutput exactly one line per target region.\n" + _ENDING + _STOP + "\n\nTarget regions:\n{targets}",
    "FULL_IMAGE_WITH_MARKED_BOUNDS": "You are given a mobile app screenshot with visible blue rectangles and id labels.\n\nTask:\n"
    "For each target id below, inspect only the icon or visual symbol inside the blue rectangle with that id label.\n"
    "Use the visible rectangle and label in the image. Do not use pixel coordinates.\nIgnore nearby text and UI outside the rectangle.\n"
    "If a rectangle does not clearly contain an icon or visual symbol, output unknown.\n\nTarget ids:\n{targets}\nOutput exactly one line per target id.\n" + _ENDING + _STOP,
    "CROPPED_MONTAGE": "You are given a montage image made from cropped mobile app icon regions.\n\nEach crop has a visible id label above it.\n"
    "Identify the icon inside each labeled crop.\n\nLabels:\n{targets}\nOutput exactly one line per label.\n" + _ENDING + "If a crop is unclear, output:\n<id>:unknown\n\n" + _STOP,
}
PROMPTS["FULL_IMAGE_WITH_BOUNDS_BATCHED"] = PROMPTS["FULL_IMAGE_WITH_BOUNDS"]


def in_set() -> WindowSpec:
    return W.partitionBy("testset_id").orderBy("position")


def label_targets(targets: DataFrame) -> DataFrame:
    """Labels ``1``, ``2`` ... in the order of the list."""
    return targets.withColumn("label", F.row_number().over(in_set()).cast("string"))


def batch_targets(targets: DataFrame, size: int) -> DataFrame:
    """Batch numbers from 1, of ``size`` targets (3 to 5, any other is 3)."""
    size = size if 3 <= size <= 5 else 3
    return targets.withColumn("batch", (F.floor((F.row_number().over(in_set()) - 1) / size) + 1).cast("int"))


def montage_layout(targets: DataFrame, columns: int = 3, cell: tuple[int, int] = (220, 190), label: int = 38, pad: int = 16) -> DataFrame:
    """Where each target's crop stands in the montage of its test set, and the size of that."""
    k = F.row_number().over(in_set()) - 1
    rows = F.ceil(F.count("*").over(W.partitionBy("testset_id")) / columns)
    width, height = cell[0] - 2 * pad, cell[1] - label - 2 * pad
    ok = F.coalesce((F.col("bounds.right") > F.col("bounds.left")) & (F.col("bounds.bottom") > F.col("bounds.top")), F.lit(False))
    w = F.when(ok, F.col("bounds.right") - F.col("bounds.left")).otherwise(width)
    h = F.when(ok, F.col("bounds.bottom") - F.col("bounds.top")).otherwise(height)
    out = targets.withColumn("_k", k).withColumn("_scale", F.least(F.lit(float(width)) / w, F.lit(float(height)) / h))
    out = out.withColumn("_w", F.greatest(F.lit(1), half_up(w * F.col("_scale")).cast("int"))).withColumn("_h", F.greatest(F.lit(1), half_up(h * F.col("_scale")).cast("int")))
    left = (F.col("_k") % columns) * cell[0] + pad + F.greatest(F.lit(0), F.floor((width - F.col("_w")) / 2))
    top = F.floor(F.col("_k") / columns) * cell[1] + label + pad + F.greatest(F.lit(0), F.floor((height - F.col("_h")) / 2))
    out = out.withColumns({"left": left.cast("int"), "top": top.cast("int"), "canvas_width": F.lit(columns * cell[0]), "canvas_height": F.greatest(F.lit(1), rows * cell[1]).cast("int")})
    return out.withColumn("right", F.col("left") + F.col("_w")).withColumn("bottom", F.col("top") + F.col("_h")).drop("_k", "_scale", "_w", "_h")


def build_prompts(targets: DataFrame, mode: str, images: DataFrame | None = None, key: tuple[str, ...] = ("testset_id",)) -> DataFrame:
    """``key``, ``n_targets`` and ``prompt``. With bounds, targets without an area are left out.

    ``images``: testset_id, width, height; where a size isn't given, or not above 0, the largest box tells it. Batches of
    targets have a prompt each with ``batch`` in the key.
    """
    if mode not in PROMPTS:
        raise ValueError(f"no prompt for the input mode {mode}")
    b = F.col("bounds")
    ok = F.coalesce((b["right"] > b["left"]) & (b["bottom"] > b["top"]), F.lit(False))
    line = F.concat("label", F.lit("\n"))
    counted = F.lit(True)
    if "{width}" in PROMPTS[mode]:
        line = F.concat("label", F.lit("="), F.concat_ws(",", b["left"], b["top"], b["right"], b["bottom"]), F.lit("\n"))
        counted = ok
    rows = targets.select(*key, "position", F.when(counted, line).alias("line"), F.when(ok, b["right"]).alias("right"), F.when(ok, b["bottom"]).alias("bottom"))
    found = rows.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("position", "line")))).alias("lines"),
        F.coalesce(F.max("right"), F.lit(0)).alias("width"),
        F.coalesce(F.max("bottom"), F.lit(0)).alias("height"),
    )
    if images is not None:
        sizes = images.select("testset_id", F.col("width").alias("_w"), F.col("height").alias("_h"))
        given_or = lambda own, largest: F.when(F.col(own) > 0, F.col(own)).otherwise(F.col(largest))
        found = found.join(sizes, "testset_id", "left").withColumns({"width": given_or("_w", "width"), "height": given_or("_h", "height")})
    given = {"{targets}": F.array_join(F.transform("lines", lambda x: x["line"]), ""), "{count}": F.size("lines").cast("string"), "{width}": F.col("width").cast("string"), "{height}": F.col("height").cast("string")}
    text = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), kv[1]), given.items(), F.lit(PROMPTS[mode]))
    return found.select(*key, F.size("lines").alias("n_targets"), text.alias("prompt"))


def parse_model_output(runs: DataFrame, key: list[str], raw: str = "raw_text") -> DataFrame:
    """``position``, ``id``, ``desc`` of each line ``id:desc``, without a fence around the text."""
    text = F.regexp_replace(F.trim(F.col(raw)), r"^```[a-zA-Z]*\s*", "")
    text = F.when(F.startswith(F.trim(F.col(raw)), F.lit("```")), F.regexp_replace(text, r"\s*```$", "")).otherwise(F.col(raw))
    rows = runs.select(*key, F.posexplode(F.split(F.trim(text), r"\r?\n")).alias("position", "line")).withColumn("line", F.trim("line"))
    mark = F.when(F.contains("line", F.lit(":")), F.lit(":")).otherwise(F.lit("："))
    at = F.expr("locate(CASE WHEN contains(line, ':') THEN ':' ELSE '：' END, line)")
    rows = rows.where(mark.isNotNull() & (at > 1)).select(*key, "position", F.trim(F.substring(F.col("line"), F.lit(1), at - 1)).alias("id"), F.trim(F.substring(F.col("line"), at + 1, F.length("line"))).alias("desc"))
    return rows.where("id <> '' AND desc <> ''")


def remap_output_labels(parsed: DataFrame, mappings: DataFrame, key: list[str]) -> DataFrame:
    """Labels of the model to target ids; of several mappings of a label the last counts."""
    last = mappings.where("label <> '' AND target_id <> ''").groupBy(*key, "label").agg(F.max_by("target_id", "position").alias("target_id"))
    j = parsed.join(last.withColumnRenamed("label", "id"), [*key, "id"], "left")
    return j.withColumn("id", F.coalesce("target_id", "id")).drop("target_id")


def _within(a: Column, b: Column) -> Column:
    """One of two normalised texts holds the other; empty ones don't count."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def matches(actual: Column, wanted: Column) -> Column:
    """Whether a description says one of the accepted words or a word of the same group; all are normalised by ``icon_norm``."""
    direct = F.exists(wanted, lambda w: _within(actual, w))

    def in_group(words: str) -> Column:
        # a description that holds a word of the group, if the target belongs to the group
        own = F.array(*(F.lit(w) for w in sorted({x.replace("-", "") for x in words.split()})))
        return F.exists(own, lambda k: _within(actual, k)) & F.exists(wanted, lambda w: F.exists(own, lambda k: _within(w, k)))

    return F.coalesce((actual != "") & (direct | reduce(Column.__or__, map(in_group, SYNONYMS))), F.lit(False))


def match_icons(parsed: DataFrame, targets: DataFrame, key: list[str]) -> DataFrame:
    """Each target with the first description of its id (in any case) and whether it matches."""
    first = parsed.groupBy(*key, F.lower("id").alias("_id")).agg(F.min_by("desc", "position").alias("desc"))
    j = targets.withColumn("_id", F.lower("target_id")).join(first, [*key, "_id"], "left").drop("_id")
    wanted = F.transform(F.concat(F.array("expected"), F.coalesce("acceptable", F.array().cast("array<string>"))), icon_norm)
    j = j.withColumn("desc", F.coalesce("desc", F.lit(""))).withColumn("_actual", icon_norm(F.col("desc"))).withColumn("_wanted", wanted)
    return j.withColumn("matched", matches(F.col("_actual"), F.col("_wanted"))).drop("_actual", "_wanted")


def match_summary(matched: DataFrame, key: list[str]) -> DataFrame:
    out = matched.groupBy(*key).agg(F.sum(F.col("matched").cast("int")).alias("matched"), F.count("*").alias("total"))
    return out.withColumn("percent", F.col("matched") * 100.0 / F.col("total"))


def manual_scores(targets: DataFrame, scores: DataFrame, key: list[str]) -> DataFrame:
    """Scores by hand; a target without one has a null score and an empty note."""
    return targets.join(scores, key, "left").withColumn("note", F.coalesce("note", F.lit("")))


def mode_leaderboard(runs: DataFrame) -> DataFrame:
    """Runs, latency and accuracy by ``mode`` and ``encoding``; unknown latencies (-1) don't count.

    ``runs``: mode, encoding, inference_ms, and how many of a run's targets were matched (``matched`` of ``total``).
    """
    known = F.when(F.col("inference_ms") >= 0, F.col("inference_ms"))
    out = runs.groupBy("mode", "encoding").agg(
        F.count("*").alias("runs"), F.count(known).alias("timed"), F.avg(known).alias("avg_ms"), F.min(known).alias("min_ms"), F.max(known).alias("max_ms"),
        F.coalesce(F.sum("matched"), F.lit(0)).alias("matched"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
    )
    return out.withColumn("percent", F.when(F.col("total") > 0, F.col("matched") * 100.0 / F.col("total")))


def batch_rollup(batches: DataFrame) -> DataFrame:
    """Batches (``run_id, batch, image, prepare_ms, inference_ms, raw_text, failed``) to their run."""
    known = lambda c: F.sum(F.when(F.col(c) >= 0, F.col(c)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("batch", "raw_text"))), lambda x: x["raw_text"]), "\n")
    return batches.groupBy("run_id").agg(
        F.min_by("image", "batch").alias("image"), known("prepare_ms").alias("prepare_ms"), known("inference_ms").alias("inference_ms"),
        text.alias("raw_text"), F.bool_or("failed").alias("failed"), F.count("*").alias("batches"),
    )


def mode_name(mode: Column) -> Column:
    return first_of([(mode == k, F.lit(v)) for k, v in MODE_NAMES.items()], F.coalesce(mode, F.lit("?")))


def history_top(runs: DataFrame, n: int, summary: DataFrame) -> DataFrame:
    """The newest ``n`` runs with short mode names and their accuracy: ``matched``, ``total``, ``percent`` (null without targets).

    ``summary``: run_id, matched, total of ``match_summary``; runs without one have none of none.
    """
    newest = runs.orderBy(F.desc("created"), F.desc("run_id")).limit(n).withColumn("mode_name", mode_name(F.col("mode")))
    out = newest.join(summary.select("run_id", "matched", "total"), "run_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("matched", "total")})
    return out.withColumn("percent", F.when(F.col("total") > 0, F.col("matched") * 100.0 / F.col("total")))


def run_ids(runs: DataFrame) -> DataFrame:
    """``yyyyMMdd_HHmmss_MODE_NNN`` with a number from 1 to 999 that begins again, in order of time per baseline."""
    seq = (F.row_number().over(W.partitionBy("baseline_id").orderBy("created", "run_id")) - 1) % 999 + 1
    return runs.withColumn("experiment_id", F.concat_ws("_", F.date_format("created", "yyyyMMdd_HHmmss"), F.upper("mode"), F.lpad(seq.cast("string"), 3, "0")))


def apply_vision_model(requests: DataFrame, model: Callable[[str, str], tuple[str, str]], key: str = "request_id") -> DataFrame:
    """A user's model over prepared requests (``image``, ``prompt``): ``raw_text``, ``latency_ms``, ``error``.

    ``model`` gives a text and an error code (empty for none). What it raises becomes the code of that row alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for b in batches:
            rows = []
            for i, image, prompt in zip(b[key], b["image"], b["prompt"], strict=True):
                begin = time.monotonic()
                try:
                    text, error = model(image, prompt)
                except Exception as e:  # the model is the user's: one bad request must not end the job
                    text, error = "", type(e).__name__
                rows.append((i, text, int(1000 * (time.monotonic() - begin)), error))
            yield pd.DataFrame(rows, columns=[key, "raw_text", "latency_ms", "error"])

    return requests.select(key, "image", "prompt").mapInPandas(run, f"`{key}` {requests.schema[key].dataType.simpleString()}, raw_text string, latency_ms long, error string")
