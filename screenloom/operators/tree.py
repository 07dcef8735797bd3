"""Operators on node tables. Everything is keyed by the tree: one shuffle by ``tree_id`` serves a chain of them.

Node ids are in pre-order, so parents and children need no joins: the node before a first child is its parent, and the
node after a parent is its first child. Windows over a tree, and over the children of a node in it, find the rest; they all
keep the partitioning by ``tree_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from screenloom.functions.geometry import valid
from screenloom.functions.text import escape_name
from screenloom.operators import reshape
from screenloom.schema import REF_ROLES


def by_tree() -> WindowSpec:
    return W.partitionBy("tree_id")


def in_order() -> WindowSpec:
    return by_tree().orderBy("node_id")


def siblings() -> WindowSpec:
    return W.partitionBy("tree_id", "parent_id").orderBy("node_id")


def of_parent(nodes: DataFrame, name: str, value: Column) -> DataFrame:
    """``nodes`` with ``value`` of each one's parent as the column ``name``; null for roots."""
    before = F.when(F.row_number().over(siblings()) == 1, F.col("_before"))
    told = nodes.withColumn("_before", F.lag(value).over(in_order())).withColumn("_before", before)
    told = told.withColumn(name, F.when(F.col("parent_id").isNotNull(), F.first("_before").over(siblings())))
    return told.drop("_before")


def with_child_count(nodes: DataFrame, name: str = "_children") -> DataFrame:
    """``nodes`` with the number of children of each."""
    size = F.count("*").over(W.partitionBy("tree_id", "parent_id"))
    first = F.when(F.lead("parent_id").over(in_order()) == F.col("node_id"), F.lead("_size").over(in_order()))
    return nodes.withColumn("_size", size).withColumn(name, F.coalesce(first, F.lit(0))).drop("_size")


def is_parent() -> Column:
    return F.coalesce(F.lead("parent_id").over(in_order()) == F.col("node_id"), F.lit(False))


def number_preorder(nodes: DataFrame) -> DataFrame:
    """Node ids anew from 0 in pre-order, with parents and paths by the new ids. Needs ``node_id`` in pre-order."""
    from screenloom.sources.markup import paths

    rows = nodes.select(*(c for c in nodes.columns if c not in ("node_id", "parent_id", "path", "sibling_pos")), F.size("path").alias("_depth"), F.col("node_id").alias("_old"), F.col("sibling_pos").alias("_pos"))
    return paths(rows.withColumnRenamed("depth", "_said").withColumnRenamed("_depth", "depth"), "_old").withColumn("depth", F.col("_said")).withColumn("sibling_pos", F.col("_pos")).select(*nodes.columns)


def below(test: Column) -> Column:
    """An ancestor passes the test. Needs ``last``, the last node below each: an earlier node that reaches this far is above it."""
    reach = F.max(F.when(test, F.col("last"))).over(in_order().rowsBetween(W.unboundedPreceding, -1))
    return F.coalesce(reach >= F.col("node_id"), F.lit(False))


def restructured(nodes: DataFrame, fate: Column) -> DataFrame:
    """Nodes by their fate (see ``reshape``): those that stay, below the nearest ancestor that stays, order unchanged."""
    return reshape.by_fate(nodes, fate)


def reattach(nodes: DataFrame, gone: Column) -> DataFrame:
    """Remove the nodes of which ``gone`` holds; children move to the nearest ancestor that stays, order unchanged."""
    return restructured(nodes, F.when(gone, reshape.YIELDS).otherwise(reshape.STAYS))


def drop_subtrees(nodes: DataFrame, gone: Column) -> DataFrame:
    """Remove the nodes of which ``gone`` holds, with all that is below them."""
    return restructured(nodes, F.when(gone, reshape.GOES).otherwise(reshape.STAYS))


def cap_depth(nodes: DataFrame, most: int = 50) -> DataFrame:
    return nodes.where(F.col("depth") <= most)


def plain_generic() -> Column:
    return (F.col("role") == "generic") & (F.col("name") == "") & (F.size("states") == 0) & (F.col("ref") == "")


def fold_generic_native(nodes: DataFrame) -> DataFrame:
    """Generic nodes without name, state or ref and with exactly one child give way to the child.

    Folding doesn't change how many children any other node has, so the set is found in one step.
    """
    counted = with_child_count(nodes)
    folded = reattach(counted, plain_generic() & (F.col("_children") == 1))
    return folded.drop("_children").select(*nodes.columns)


def _renamed(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Merged texts: a new name, no states, no ref."""
    merged = F.col("_name").isNotNull()
    changed = {"states": F.array().cast("array<string>"), "ref": F.lit("")}
    out = nodes.withColumns({c: F.when(merged, v).otherwise(F.col(c)) for c, v in changed.items()})
    return out.withColumn("name", F.coalesce("_name", "name")).select(*columns)


def merge_adjacent_text(nodes: DataFrame) -> DataFrame:
    """Text siblings in a row become the first of them, with all names joined; states, ref and children go."""
    return _renamed(reshape.in_trees(nodes, [F.col("role") == "text", F.col("name")], reshape.text_merged), nodes.columns)


def normalize_web(nodes: DataFrame) -> DataFrame:
    """Merged text, then folded generics, then no text that repeats its parent's name: one pass from the leaves up."""
    return _renamed(reshape.in_trees(nodes, [F.col("role") == "text", plain_generic(), F.col("name")], reshape.normalised), nodes.columns)


def executable() -> Column:
    """A node that can be acted on, by its role or as a list item by its states."""
    tiers = F.exists("states", lambda s: s.isin("clickable", "clickable=inferred", "clickable=guessed", "clickable-inferred", "clickable-guessed"))
    return valid(F.col("bounds")) & (F.col("role").isin(*REF_ROLES) | ((F.col("role") == "listitem") & tiers))


def has_executable_descendant(nodes: DataFrame) -> DataFrame:
    """``tree_id``, ``node_id`` of the nodes with something to act on below them."""
    return nodes.where(executable()).select("tree_id", F.explode("path").alias("node_id")).distinct()


def assign_refs(nodes: DataFrame, prefix: str = "n", web_mode: bool = False) -> DataFrame:
    """Numbers, in pre-order, for what can be acted on (in web mode for every node with valid bounds)."""
    if web_mode:
        picked = nodes.withColumn("_ok", valid(F.col("bounds")))
    else:
        # what is below a node follows it, so the next one to act on is below it or none is
        later = by_tree().orderBy(F.desc("node_id")).rowsBetween(W.unboundedPreceding, -1)
        following = F.last(F.when(executable(), F.col("path")), ignorenulls=True).over(later)
        sure = F.arrays_overlap("states", F.array(*map(F.lit, ("clickable", "clickable=inferred", "clickable-inferred"))))
        maybe = F.arrays_overlap("states", F.array(*map(F.lit, ("clickable=guessed", "clickable-guessed"))))
        busy = F.coalesce(F.array_contains("_following", F.col("node_id")), F.lit(False))
        item = (F.col("role") == "listitem") & (sure | (maybe & ~busy))
        picked = nodes.withColumn("_following", following).withColumn("_ok", valid(F.col("bounds")) & (item | F.col("role").isin(*REF_ROLES)))
    number = F.sum(F.col("_ok").cast("int")).over(in_order().rowsBetween(W.unboundedPreceding, 0))
    ref = F.when(F.col("_ok"), F.concat(F.lit(prefix), number.cast("string"))).otherwise(F.col("ref"))
    return picked.withColumn("ref", ref).select(*nodes.columns)


def mark_webviews(nodes: DataFrame) -> DataFrame:
    """The state ``web`` on every topmost web view."""
    marked = reshape.with_test_above(nodes, F.col("role") == "webview", "_inside")
    top = (F.col("role") == "webview") & ~F.col("_inside")
    return marked.withColumn("states", F.when(top, F.array_append("states", F.lit("web"))).otherwise(F.col("states"))).select(*nodes.columns)


def snapshot_line(boxes: bool = False) -> Column:
    """One node as it stands in a snapshot, without indent."""
    b = F.col("bounds")
    shown = b.isNotNull() & ((F.col("ref") != "") | F.lit(boxes))
    return F.concat(
        F.col("role"),
        F.when(F.col("name") != "", F.concat(F.lit(' "'), escape_name(F.col("name")), F.lit('"'))).otherwise(""),
        F.array_join(F.transform("states", lambda s: F.concat(F.lit(" ["), s, F.lit("]"))), ""),
        F.when(F.col("ref") != "", F.concat(F.lit(" [ref="), F.col("ref"), F.lit("]"))).otherwise(""),
        F.when(shown, F.concat(F.lit(" [bounds="), F.concat_ws(",", b["left"], b["top"], b["right"], b["bottom"]), F.lit("]"))).otherwise(""),
    )


def render_snapshot(nodes: DataFrame, boxes: bool = False, max_depth: int = 0) -> DataFrame:
    """``tree_id`` and its ``snapshot``: a line per node, indented by depth."""
    following = F.lead("depth").over(in_order())  # in pre-order a node has children if the next one is deeper
    lined = nodes.withColumn("_parent", F.coalesce(following > F.col("depth"), F.lit(False)))
    colon = F.col("_parent")
    if max_depth > 0:
        lined, colon = lined.where(F.col("depth") < max_depth), colon & (F.col("depth") < max_depth - 1)
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), snapshot_line(boxes), F.when(colon, ":").otherwise(""))
    lines = F.sort_array(F.collect_list(F.struct("node_id", line.alias("line"))))
    return lined.groupBy("tree_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("snapshot"))


def fuse(native: DataFrame, web: DataFrame, mode: str = "BOTH") -> DataFrame:
    """``tree_id`` and ``snapshot`` of native and web trees of the same capture."""
    left = render_snapshot(assign_refs(mark_webviews(native), "n")).select("tree_id", F.col("snapshot").alias("native_text"))
    right = render_snapshot(assign_refs(web, "w", web_mode=True)).select("tree_id", F.col("snapshot").alias("web_text"))
    both = F.col("web_text") if mode == "WEB_ONLY" else F.concat("native_text", F.lit("\n\n--- Web ---\n"), "web_text")
    text = F.coalesce(both, F.col("native_text"), F.col("web_text"), F.lit(""))
    if mode == "WEB_ONLY":
        text = F.coalesce("web_text", "native_text", F.lit(""))
    return left.join(right, "tree_id", "full_outer").select("tree_id", text.alias("snapshot"))


def web_element_map(nodes: DataFrame) -> DataFrame:
    """``tree_id``, ``ref``, ``web_idx`` of the nodes that are elements of a page."""
    return nodes.where((F.col("ref") != "") & (F.col("web_idx") >= 0)).select("tree_id", "ref", "web_idx")


def role_histogram(nodes: DataFrame, top: int = 6) -> DataFrame:
    """``tree_id`` and its commonest roles as ``role×count``, ties by name."""
    counts = nodes.groupBy("tree_id", "role").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("k", F.row_number().over(by_tree().orderBy(F.desc("n"), "role"))).where(F.col("k") <= top)
    parts = F.sort_array(F.collect_list(F.struct("k", F.concat("role", F.lit("×"), F.col("n").cast("string")).alias("part"))))
    return ranked.groupBy("tree_id").agg(F.array_join(F.transform(parts, lambda p: p["part"]), " ").alias("roles"))


def pool_sources(*tables: DataFrame) -> DataFrame:
    """All nodes of several sources together, copies included."""
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t)
    return first
