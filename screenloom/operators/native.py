"""Native view trees to semantic nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.functions import names, roles
from screenloom.functions.text import normalize_text
from screenloom.operators import tree


def select_core_attributes(raw: DataFrame) -> DataFrame:
    """The tree and five attributes: order, class, resource id, text and bounds."""
    return raw.select("tree_id", "node_id", "parent_id", F.col("sibling_pos").alias("index"), "class_name", "resource_id", "text", "bounds")


def filter_visible(raw: DataFrame) -> DataFrame:
    """Drop views that can't be seen, and what is below them. ``visible`` and ``alpha`` are optional columns."""
    b = F.col("bounds")
    seen = F.coalesce((b["right"] - b["left"] > 0) & (b["bottom"] - b["top"] > 0), F.lit(False))
    if "visible" in raw.columns:
        seen &= F.col("visible")
    if "alpha" in raw.columns:
        seen &= F.col("alpha") > 0
    return tree.drop_subtrees(raw, ~seen)


def with_roles(raw: DataFrame) -> DataFrame:
    """Raw nodes with the ``decision`` on their own role.

    The name and the decision on the class are columns: within one expression each rule would cut the name and decide the class again.
    """
    c = F.col
    found = raw.withColumn("_name", roles.simple_name(c("class_name"))).withColumn("_class", roles.android_class(c("_name")))
    decided = roles.android_adjusted(c("_class"), c("text"), c("content_desc"), c("clickable") | c("long_clickable"), c("touch_override"), c("scrollable"), c("editable"))
    return found.withColumn("decision", decided).drop("_name", "_class")


def promote_collection_items(decided: DataFrame) -> DataFrame:
    """Generic, card, section and clickable children of lists and grids become list items."""
    up = F.struct(F.col("decision.role").alias("role"), (F.col("item_click") | F.col("item_touch")).alias("listens"))
    joined = tree.of_parent(decided, "_up", up)
    clickable = (F.col("decision.role") == "button") & (F.col("decision.source") == "attribute:clickable")
    item = F.coalesce(F.col("_up.role").isin("list", "grid"), F.lit(False)) & (F.col("decision.role").isin("generic", "card", "section") | clickable)
    source = F.when(clickable, F.lit("structure:collection-item-clickable")).otherwise(F.lit("structure:collection-item"))
    promoted = F.struct(F.lit("listitem").alias("role"), source.alias("source"), F.lit(0.75).alias("confidence"))
    return joined.withColumn("decision", F.when(item, promoted).otherwise(F.col("decision"))).withColumn("parent_listens", F.coalesce("_up.listens", F.lit(False))).drop("_up")


def semantic_nodes(raw: DataFrame, fold: bool = True) -> DataFrame:
    """Raw native nodes to the node contract: roles, promotion, names, states and, if wanted, folding."""
    c = F.col
    for name in ("text", "content_desc", "hint", "resource_id"):
        raw = raw.withColumn(name, normalize_text(c(name)))
    nodes = promote_collection_items(with_roles(raw))
    role = c("decision.role")
    nodes = nodes.withColumn("name", names.android_name(role, c("text"), c("content_desc"), c("hint"), c("resource_id")))
    flags = {k: c(k) for k in ("enabled", "checked", "selected", "focused", "scrollable", "password")}
    tier = names.click_tier(role, c("clickable") | c("on_click") | c("touch_override"), c("parent_listens"))
    blind = names.needs_visual_desc(role, c("name"), c("class_name"), c("bounds"))
    states = F.concat(names.native_states(role, flags, c("text")), names.states_of((tier.isNotNull(), tier), (blind, "needs_visual_desc")))
    nodes = nodes.select(
        "tree_id", F.lit("native").alias("source"), "node_id", "parent_id", "depth", "path", "sibling_pos", role.alias("role"),
        c("decision.source").alias("role_source"), c("decision.confidence").alias("role_confidence"), "name", "text", "content_desc",
        "resource_id", "class_name", "bounds", states.alias("states"), F.lit(-1).alias("web_idx"), F.lit("").alias("ref"),
    )
    return tree.fold_generic_native(nodes) if fold else nodes
