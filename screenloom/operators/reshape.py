"""Trees made anew: which nodes of a tree stay, and where.

A tree's nodes are gathered in order. What hangs on ancestors alone is an array by node id, looked up along each node's path;
what hangs on children and siblings is one pass with a stack. Both are linear in the nodes and their paths.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What becomes of a node: it stays, gives way to its children, goes with all below it, or stays without what is below it.
STAYS, YIELDS, GOES, ENDS = range(4)
PLACE = "array<struct<at:int,path:array<int>,sibling_pos:int,name:string>>"

#: The nodes of one tree that stay: which (their place in the tree), path by node ids, place among siblings, and a new name or None.
Places = list[tuple[int, list[int], int, str | None]]


def placed_again(ids: list[int], depths: list[int], fates: list[int], names: dict[int, str] | None = None) -> Places:
    """Each node below the nearest one above it that stays, in the order they had."""
    out: Places = []
    kept: list[tuple[int, int]] = []
    met: dict[int, int] = {}
    ended = None
    for k, depth in enumerate(depths):
        if ended is not None and depth > ended:
            continue
        ended = None
        while kept and kept[-1][0] >= depth:
            kept.pop()
        fate = fates[k] or STAYS
        if fate == GOES:
            ended = depth
        if fate in (GOES, YIELDS):
            continue
        if fate == ENDS:
            ended = depth
        parent = kept[-1][1] if kept else -1
        met[parent] = met.get(parent, -1) + 1
        out.append((k, [i for _, i in kept], met[parent], names.get(k) if names else None))
        kept.append((depth, ids[k]))
    return out


def children_of(depths: list[int]) -> tuple[list[list[int]], list[int]]:
    """The children of each node in order, and the roots."""
    kids: list[list[int]] = [[] for _ in depths]
    roots: list[int] = []
    stack: list[int] = []
    for k, depth in enumerate(depths):
        while stack and depths[stack[-1]] >= depth:
            stack.pop()
        (kids[stack[-1]] if stack else roots).append(k)
        stack.append(k)
    return kids, roots


def merged_texts(kids: list[int], is_text: list[bool], names: list[str], changed: dict[int, str], below: list[list[int]]) -> list[int]:
    """``kids`` with texts in a row merged into the first, whose name is in ``changed`` and which has nothing below it."""
    out: list[int] = []
    said: list[str] = []
    for k in [*kids, -1]:
        if k >= 0 and is_text[k] and said:
            said.append(changed.get(k, names[k]))
            continue
        if len(said) > 1:
            changed[out[-1]] = " ".join(x for x in said if x)
            below[out[-1]] = []
        said = [changed.get(k, names[k])] if k >= 0 and is_text[k] else []
        if k >= 0:
            out.append(k)
    return out


def text_merged(ids: list[int], depths: list[int], is_text: list[bool], names: list[str]) -> Places:
    """Texts in a row are one: the first, with all names and without what is below it."""
    kids, roots = children_of(depths)
    fates, changed = [STAYS] * len(ids), {}
    below = [list(k) for k in kids]
    for of in [roots, *kids]:
        left = merged_texts(of, is_text, names, changed, below)
        for k in set(of) - set(left):
            fates[k] = GOES
    for k in changed:
        fates[k] = ENDS
    return placed_again(ids, depths, fates, changed)


def normalised(ids: list[int], depths: list[int], is_text: list[bool], is_plain: list[bool], names: list[str]) -> Places:
    """From the leaves up: texts in a row merged, plain generics with one child gone, texts that repeat a name gone."""
    kids, roots = children_of(depths)
    stands, changed = list(range(len(ids))), {}
    for k in range(len(ids) - 1, -1, -1):
        own = merged_texts([stands[c] for c in kids[k]], is_text, names, changed, kids)
        if is_plain[k] and len(own) == 1:
            stands[k] = own[0]
            continue
        if len(own) == 1 and is_text[own[0]] and names[k] and changed.get(own[0], names[own[0]]) == names[k]:
            own = []
        kids[k] = own
    out: Places = []
    todo = [(stands[r], [], p) for p, r in reversed(list(enumerate(roots)))]
    while todo:
        k, path, pos = todo.pop()
        out.append((k, path, pos, changed.get(k)))
        todo += [(c, [*path, ids[k]], p) for p, c in reversed(list(enumerate(kids[k])))]
    return out


def in_trees(nodes: DataFrame, asked: list[Column], one: Callable[..., Places]) -> DataFrame:
    """``nodes`` as ``one`` places them, tree by tree, with ``_name``: what a node is newly called, or null.

    ``one`` gets the ids, depths and ``asked`` values of the nodes of a tree in order.
    """
    maps = [f.name for f in nodes.schema if f.dataType.typeName() == "map"]
    gathered = _gathered(nodes, maps, F.struct(*(c.alias(f"v{k}") for k, c in enumerate(asked))))

    @F.arrow_udf(PLACE)
    def found(*columns: pa.Array) -> pa.Array:
        at, path, ends, pos, names, sizes = array("i"), array("i"), array("i", [0]), array("i"), [], array("i", [0])
        for lists in zip(*(c.to_pylist() for c in columns), strict=True):
            for k, above, place, name in one(*lists):
                at.append(k)
                path.extend(above)
                ends.append(len(path))
                pos.append(place)
                names.append(name)
            sizes.append(len(at))
        paths = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(path, pa.int32()))
        rows = pa.StructArray.from_arrays([pa.array(at, pa.int32()), paths, pa.array(pos, pa.int32()), pa.array(names, pa.string())], ["at", "path", "sibling_pos", "name"])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), rows)

    each = lambda f: F.transform("_nodes", f)
    value = lambda name: lambda n: n["_asked"][name]
    values = [each(lambda n: n["node_id"]), each(lambda n: F.size(n["path"])), *(each(value(f"v{k}")) for k in range(len(asked)))]
    placed = gathered.withColumn("_placed", found(*values))
    rows = placed.select("tree_id", F.explode(F.transform("_placed", lambda p: F.struct(F.get("_nodes", p["at"]).alias("n"), p.alias("p")))).alias("_x"))
    return _apart(nodes, maps, rows, {"path": F.col("_x.p.path"), "sibling_pos": F.col("_x.p.sibling_pos")}, F.col("_x.p.name").alias("_name"))


def _gathered(nodes: DataFrame, maps: list[str], asked: Column) -> DataFrame:
    """``tree_id`` and its ``_nodes`` in order, each with ``_asked``. Maps are lists of entries there, which can be sorted."""
    flat = nodes.withColumn("_asked", asked)
    flat = flat.withColumns({c: F.map_entries(c) for c in maps}) if maps else flat
    others = [c for c in nodes.columns if c not in ("tree_id", "node_id")]
    return flat.groupBy("tree_id").agg(F.sort_array(F.collect_list(F.struct("node_id", *others, "_asked"))).alias("_nodes"))


def _apart(nodes: DataFrame, maps: list[str], rows: DataFrame, new: dict[str, Column], *more: Column) -> DataFrame:
    """The columns of ``nodes`` from rows ``_x`` with a node ``n``; depth and parent follow from the new path."""
    new |= {"depth": F.size(new["path"]), "parent_id": F.try_element_at(new["path"], F.lit(-1))} | {c: F.map_from_entries(f"_x.n.{c}") for c in maps}
    return rows.select(*(c if c == "tree_id" else new.get(c, F.col(f"_x.n.{c}")).alias(c) for c in nodes.columns), *more)


def _by_id() -> Column:
    """What is asked of the nodes of a tree as an array by node id: an ancestor is found by its place. Ids may have gaps."""

    def with_gap(n: Column, k: Column) -> Column:
        gap = n["node_id"] - F.coalesce(F.get("_nodes", k - 1)["node_id"], F.lit(-1)) - 1
        return F.concat(F.array_repeat(F.lit(None).cast("int"), gap), F.array(n["_asked"]))

    return F.flatten(F.transform("_nodes", with_gap))


def by_fate(nodes: DataFrame, fate: Column) -> DataFrame:
    """The nodes that stay, below the nearest ancestor that stays; needs no Python, and keeps the trees where they are."""
    maps = [f.name for f in nodes.schema if f.dataType.typeName() == "map"]
    trees = _gathered(nodes, maps, F.coalesce(fate, F.lit(STAYS)).cast("int")).withColumn("_fates", _by_id())
    of = lambda p: F.get("_fates", p)
    stays = F.filter("_nodes", lambda n: (n["_asked"] == STAYS) & ~F.exists(n["path"], lambda p: of(p) == GOES))
    placed = F.transform(stays, lambda n: F.struct(n.alias("n"), F.filter(n["path"], lambda p: of(p) == STAYS).alias("path")))
    rows = _apart(nodes, maps, trees.select("tree_id", F.explode(placed).alias("_x")), {"path": F.col("_x.path")})
    place = F.row_number().over(W.partitionBy("tree_id", "parent_id").orderBy("node_id")) - 1
    return rows.withColumn("sibling_pos", place.cast("int"))


def with_test_above(nodes: DataFrame, test: Column, name: str) -> DataFrame:
    """``nodes`` with the column ``name``: an ancestor passes the test."""
    maps = [f.name for f in nodes.schema if f.dataType.typeName() == "map"]
    trees = _gathered(nodes, maps, F.coalesce(test, F.lit(False)).cast("int")).withColumn("_tests", _by_id())
    marked = F.transform("_nodes", lambda n: F.struct(n.alias("n"), F.exists(n["path"], lambda p: F.get("_tests", p) == 1).alias("above")))
    return _apart(nodes, maps, trees.select("tree_id", F.explode(marked).alias("_x")), {"path": F.col("_x.n.path")}, F.col("_x.above").alias(name))
