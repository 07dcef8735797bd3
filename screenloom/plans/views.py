"""Views that turn the test tables into captures. ``sql.py`` defines the same ones for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from screenloom.cut import dealt
from screenloom.functions.geometry import half_up
from screenloom.operators import native, tree
from screenloom.schema import BOUNDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders, numbered. An order's lines meet in one of as many partitions as the table's size asks for."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").withColumn("seq", F.row_number().over(order).cast("int"))


def screen_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A native view tree per order: window, container, and a view per line."""
    ints = lambda *v: F.array(*v).cast("array<int>")
    no, empty = F.lit(False), F.lit("")
    key = F.col("l_orderkey")
    whole = F.struct(*(F.lit(v).alias(s) for s, v in zip(("left", "top", "right", "bottom"), (0, 0, 1080, 2400), strict=True))).cast(BOUNDS)
    classes = F.array(*(F.lit(f"android.widget.{c}") for c in ("TextView", "ImageView", "ImageButton", "EditText", "CheckBox", "FrameLayout", "CardView")))
    q = F.floor("l_quantity").cast("int")
    left, top = (F.col("l_partkey") % 1000).cast("int"), (F.col("l_suppkey") % 2000).cast("int")
    box = F.struct(left.alias("left"), top.alias("top"), (left + q).alias("right"), (top + q % 40).alias("bottom")).cast(BOUNDS)

    def node(**given: Column) -> Column:
        base = {
            "node_id": F.lit(0), "parent_id": F.lit(None).cast("int"), "depth": F.lit(0), "path": ints(), "sibling_pos": F.lit(0),
            "class_name": empty, "resource_id": empty, "text": empty, "content_desc": empty, "hint": empty, "bounds": whole,
            "clickable": no, "long_clickable": no, "editable": no, "scrollable": no, "checked": no, "selected": no, "focused": no, "password": no,
            "enabled": F.lit(True), "on_click": no, "item_click": no, "item_touch": no, "touch_override": no, "quantity": F.lit(0.0),
        }
        return F.struct(*(v.alias(k) for k, v in (base | given).items()))

    window = node(class_name=F.lit("com.android.internal.policy.DecorView"))
    container = F.array(*(F.lit(c) for c in ("androidx.recyclerview.widget.RecyclerView", "android.widget.LinearLayout", "android.widget.GridView")))
    holder = node(node_id=F.lit(1), parent_id=F.lit(0), depth=F.lit(1), path=ints(F.lit(0)), class_name=F.element_at(container, (key % 3 + 1).cast("int")), item_click=key % 2 == 0)
    view = node(
        node_id=F.col("seq") + 1, parent_id=F.lit(1), depth=F.lit(2), path=ints(F.lit(0), F.lit(1)), sibling_pos=F.col("seq") - 1,
        class_name=F.element_at(classes, F.col("l_linenumber").cast("int")), resource_id=F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("app:id/part_item_"), (F.col("l_partkey") % 7).cast("string"))).otherwise(""),
        text=F.when(F.col("l_partkey") % 3 == 0, F.concat("l_returnflag", "l_linestatus")).otherwise(""), hint=F.when(F.col("l_partkey") % 4 == 0, F.lit("a hint")).otherwise(""),
        bounds=box, clickable=F.col("l_discount") > 0.05, enabled=F.col("l_tax") > 0.01, checked=F.col("l_partkey") % 11 == 0, quantity=F.col("l_quantity"),
    )
    # the first line of an order brings the window and the container with it: one pass over the lines
    rows = F.when(F.col("seq") == 1, F.array(window, holder, view)).otherwise(F.array(view))
    return lines(spark, sf_dir).select(key.alias("tree_id"), F.explode(rows).alias("n")).select("tree_id", "n.*")


def native_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.semantic_nodes(screen_nodes(spark, sf_dir).drop("quantity"))


def native_with_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.assign_refs(native_nodes(spark, sf_dir))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered captures: session, time and text."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tree_id"), F.col("o_custkey").alias("session"), F.col("o_orderdate").alias("ts"))
    return tree.render_snapshot(native_with_refs(spark, sf_dir)).join(orders, "tree_id")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections on images: corners, score and class; ``seq`` breaks ties."""
    x, y, q = F.col("l_partkey") % 1000, F.col("l_suppkey") % 2000, F.col("l_quantity")
    return lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("image"), "seq", x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + q).alias("x2"), (y + q).alias("y2"),
        half_up(F.col("l_discount") * 1000).alias("score"), (F.col("l_partkey") % 23).cast("int").alias("class_id"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment runs."""
    ms = F.when(F.col("event_id") % 17 == 0, -1).otherwise(half_up(F.col("value"))).cast("long")
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("run_id"), F.col("user_id").alias("baseline_id"), F.col("event_type").alias("mode"), F.col("ts").alias("created"), ms.alias("inference_ms"))
