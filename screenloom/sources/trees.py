"""Trees in JSON: web trees and inspector dumps, taken apart in one pass over each text."""

from __future__ import annotations

import json
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.functions import geometry, names, roles
from screenloom.operators.tree import is_parent

WALKED = "array<struct<path:array<int>,sibling_pos:int,own:string>>"


def _not_json(said: str) -> None:
    raise ValueError(f"not JSON: {said}")


def walked(texts: pa.Array, children: str, root: str | None, strict: bool) -> pa.Array:
    """The nodes of each text in pre-order: ancestors, place among siblings, and the node's own JSON without its children."""
    path, ends, pos, own, sizes = array("i"), array("i", [0]), array("i"), [], array("i", [0])
    for text in texts.to_pylist():
        try:
            found = json.loads(text, parse_constant=_not_json) if text and not text.isspace() else None
        except ValueError as error:
            if strict:
                raise ValueError(f"malformed JSON: {error}") from None
            found = None
        if root is not None:
            found = found.get(root) if isinstance(found, dict) else None
        begin = len(pos)
        todo = [(found, [], 0)] if found is not None else []
        while todo:
            node, above, place = todo.pop()
            kids = node.get(children) if isinstance(node, dict) else None
            me = len(pos) - begin
            path.extend(above)
            ends.append(len(path))
            pos.append(place)
            own.append(json.dumps({k: v for k, v in node.items() if k != children} if isinstance(node, dict) else node, ensure_ascii=False))
            if isinstance(kids, list):
                todo += [(kid, [*above, me], k) for k, kid in reversed(list(enumerate(kids)))]
        sizes.append(len(pos))
    paths = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(path, pa.int32()))
    rows = pa.StructArray.from_arrays([paths, pa.array(pos, pa.int32()), pa.array(own, pa.string())], ["path", "sibling_pos", "own"])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), rows)


def _unfold(df: DataFrame, tree_id: str, text: str, children: str, root: str | None, strict: bool) -> DataFrame:
    """A row for each node, with its own fields ``v`` as a variant. A map over the texts: no row is shuffled."""

    @F.arrow_udf(WALKED)
    def found(texts: pa.Array) -> pa.Array:
        return walked(texts, children, root, strict)

    rows = df.select(F.col(tree_id).alias("tree_id"), F.posexplode(found(F.col(text))).alias("node_id", "x")).select("tree_id", "node_id", "x.*")
    parent = F.try_element_at("path", F.lit(-1))
    return rows.select("tree_id", "node_id", parent.alias("parent_id"), F.size("path").alias("depth"), "path", "sibling_pos", F.try_parse_json("own").alias("v"))


def read_web_trees(df: DataFrame, tree_id: str = "tree_id", json: str = "json") -> DataFrame:
    """``{url, title, root}`` to the node contract. No root or no text, no rows; another text that isn't JSON is an error.

    Of a key that an object has twice the last counts; children that are no list count as none.
    """
    nodes = _unfold(df, tree_id, json, "children", "root", strict=True)
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    box = get("$.bounds", "array<int>")
    nodes = nodes.select("*", roles.map_role(F.coalesce(get("$.role", "string"), F.lit(""))).alias("role"))
    empty = F.lit("")
    return nodes.select(
        "tree_id", F.lit("web").alias("source"), "node_id", "parent_id", "depth", "path", "sibling_pos", "role", F.lit("web").alias("role_source"), F.lit(1.0).alias("role_confidence"),
        F.coalesce(get("$.name", "string"), empty).alias("name"), empty.alias("text"), empty.alias("content_desc"), empty.alias("resource_id"), empty.alias("class_name"),
        F.when(F.size(box) == 4, F.struct(*(box[k].alias(s) for k, s in enumerate(geometry.SIDES)))).alias("bounds"),
        F.coalesce(get("$.states", "array<string>"), F.array().cast("array<string>")).alias("states"), F.coalesce(get("$.__pr_idx", "int"), F.lit(-1)).alias("web_idx"), empty.alias("ref"),
    )


def read_inspector_trees(df: DataFrame, tree_id: str = "tree_id", json: str = "json") -> DataFrame:
    """Inspector dumps to raw nodes: ``kind``, ``id``, ``bounds`` and ``attrs``. What isn't JSON gives no rows."""
    nodes = _unfold(df, tree_id, json, "$children", None, strict=False)
    text = lambda key: F.coalesce(F.try_variant_get("v", f'$["${key}"]', "string"), F.lit(""))
    attrs = F.coalesce(F.try_variant_get("v", '$["$attrs"]', "map<string,string>"), F.create_map().cast("map<string,string>"))
    return nodes.select("tree_id", "node_id", "parent_id", "depth", "path", "sibling_pos", text("type").alias("kind"), text("ID").alias("id"), geometry.parse_rect_float(text("rect")).alias("bounds"), attrs.alias("attrs"))


def harmony_nodes(raw: DataFrame) -> DataFrame:
    """Inspector nodes to the node contract, without blank placeholders."""
    n = drop_blank_placeholders(raw).withColumn("decision", roles.harmony_role(F.col("kind"), F.col("attrs")))
    role, empty = F.col("decision.role"), F.lit("")
    return n.select(
        "tree_id", F.lit("harmony").alias("source"), "node_id", "parent_id", "depth", "path", "sibling_pos", role.alias("role"), F.col("decision.source").alias("role_source"),
        F.col("decision.confidence").alias("role_confidence"), names.harmony_name(role, F.col("attrs")).alias("name"), F.coalesce(F.col("attrs")["content"], empty).alias("text"),
        empty.alias("content_desc"), F.col("id").alias("resource_id"), F.col("kind").alias("class_name"), "bounds", names.harmony_states(F.col("kind"), role, F.col("attrs")).alias("states"),
        F.lit(-1).alias("web_idx"), empty.alias("ref"),
    )


def drop_blank_placeholders(raw: DataFrame) -> DataFrame:
    """Inspector nodes without ``Blank`` ones that hold nothing."""
    blank = (F.col("kind") == "Blank") & (F.coalesce(F.col("attrs")["content"], F.lit("")) == "") & F.col("parent_id").isNotNull()
    return raw.withColumn("_gone", blank & ~is_parent()).where(~F.col("_gone")).drop("_gone")
