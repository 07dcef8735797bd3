"""Marked-up texts as node tables: tokens with a running depth, and paths from it."""

from __future__ import annotations

from array import array
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from screenloom.functions import geometry
from screenloom.schema import RAW_FLAGS
from screenloom.sources import outline

#: Deepest level of a page, as in the reference; deeper nodes are cut. View hierarchies and inspector dumps have no limit.
MAX_DEPTH = 50


def ancestors(trees: pa.Array) -> pa.Array:
    """``path`` and ``sibling_pos`` of each node, from the depths of each tree's nodes in order.

    The ancestors of a node are the last nodes before it of each lesser depth: a stack.
    """
    above, ends, siblings, sizes = array("i"), array("i", [0]), array("i"), array("i", [0])
    for depths in trees.to_pylist():
        stack: list[int] = []
        met: list[int] = []
        for node, depth in enumerate(depths):
            del stack[depth:], met[depth + 1 :]
            above.extend(stack)
            ends.append(len(above))
            if len(met) == depth:
                met.append(0)
            siblings.append(met[depth])
            met[depth] += 1
            stack.append(node)
        sizes.append(len(siblings))
    path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(above, pa.int32()))
    found = pa.StructArray.from_arrays([path, pa.array(siblings, pa.int32())], ["path", "sibling_pos"])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), found)


def paths(nodes: DataFrame, order: str, max_depth: int | None = None) -> DataFrame:
    """``node_id``, ``parent_id``, ``path`` and ``sibling_pos`` of nodes with a ``depth``, given in ``order``.

    One pass over the depths of each tree, however deep; nodes deeper than ``max_depth`` are cut if it is given.
    """
    rows = nodes if max_depth is None else nodes.where(F.col("depth") <= max_depth)
    by_order = lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0)
    others = [order, *(c for c in nodes.columns if c not in ("tree_id", order))]
    listed = F.collect_list(F.struct(*others))
    unordered = any(k in f.dataType.simpleString() for f in nodes.schema for k in ("map<", "variant"))
    gathered = rows.groupBy("tree_id").agg((F.array_sort(listed, by_order) if unordered else F.sort_array(listed)).alias("_nodes"))

    @F.arrow_udf("array<struct<path:array<int>,sibling_pos:int>>")
    def found(depths: pa.Array) -> pa.Array:
        return ancestors(depths)

    gathered = gathered.withColumn("_found", found(F.transform("_nodes", lambda n: n["depth"])))
    out = gathered.select("tree_id", F.posexplode(F.arrays_zip("_nodes", "_found")).alias("node_id", "_node"))
    return out.select("tree_id", *(F.col(f"_node._nodes.{c}") for c in others), "node_id", F.col("_node._found.path"), F.col("_node._found.sibling_pos")).withColumn("parent_id", F.try_element_at("path", F.lit(-1)))


#: Character references that are read, ``&amp;`` last.
REFERENCES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#10;", "\n"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def decoded(c: Column) -> Column:
    """Character references to characters."""
    out = c
    for said, meant in REFERENCES:
        out = F.replace(out, F.lit(said), F.lit(meant))
    return F.when(F.contains(c, F.lit("&")), out).otherwise(c)


def encoded(c: Column) -> Column:
    out = c
    for meant, said in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;")):
        out = F.replace(out, F.lit(meant), F.lit(said))
    return F.when(c.rlike('[&<>"\n]'), out).otherwise(c)


#: XML attributes of a view, by column.
FLAG_NAMES = {"on_click": "has-onclick-listener", "item_click": "has-item-click-listener", "item_touch": "has-item-touch-listener", "touch_override": "overrides-onTouchEvent", "long_clickable": "long-clickable"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_of_each(names: Column, values: Column) -> Column:
    """``map`` of names and values; the first of a name counts. Repeated names are found by sorting them."""

    def firsts(x: Column) -> Column:
        placed_names = F.array_sort(F.transform(x["names"], lambda n, k: F.struct(n.alias("key"), k.alias("at"))))
        new = lambda s: F.filter(s, lambda y, k: (k == 0) | (F.get(s, k - 1)["key"] != y["key"]))
        return F.transform(let(placed_names, new), lambda y: F.struct(y["key"].alias("key"), F.get(x["values"], y["at"]).alias("value")))

    def pairs(x: Column) -> Column:
        plain = F.zip_with(x["names"], x["values"], lambda n, v: F.struct(n.alias("key"), v.alias("value")))
        return F.map_from_entries(F.when(F.size(F.array_distinct(x["names"])) == F.size(x["names"]), plain).otherwise(firsts(x)))

    return let(F.struct(names.alias("names"), values.alias("values")), pairs)


#: What is read of a view's tag as text, and the schema of its node before boxes and roles: texts as they stand in the tag, between
#: quotes, and flags as bits. Trees of so few values take little room in a shuffle.
SAID = ["class", "resource-id", "text", "desc", "content-desc", "hint", "bounds"]
VIEWS = "array<struct<depth:int,path:array<int>,sibling_pos:int,said:string,flags:int>>"


def view_values(tag: str) -> tuple[str, int]:
    """The texts ``SAID`` of a tag, joined by quotes, and its flags: between its quotes stand its values, and before each its name."""
    parts = tag.split('"')
    given: dict[str, str] = {}
    for k in range(0, len(parts) - 1, 2):
        given.setdefault(parts[k].removeprefix("<node").strip(), parts[k + 1])
    flags = 0
    for k, column in enumerate(RAW_FLAGS):
        value = given.get(f"{FLAG_NAMES.get(column, column)}=", "")
        if value.lower() == "true" if value else column == "enabled":
            flags |= 1 << k
    return '"'.join([given.get(f"{name}=", "") for name in SAID]), flags


def views(ids: pa.Array, texts: pa.Array, max_depth: int | None) -> pa.Array:
    """The views of each hierarchy from its tags in order: place in the tree, texts and flags. Tags that don't match are an error."""
    depths, said, flags, sizes = [], [], [], array("i", [0])
    for tree, tags in zip(ids.to_pylist(), texts.to_pylist(), strict=True):
        level, own = 0, []
        for tag in tags or ():
            if tag == "</node>":
                level -= 1
            if level < 0 or tag == "<node":
                raise ValueError(f"malformed view hierarchy: {tree}")
            if tag == "</node>":
                continue
            if max_depth is None or level <= max_depth:
                own.append(level)
                words, marks = view_values(tag)
                said.append(words)
                flags.append(marks)
            level += not tag.endswith("/>")
        if level:
            raise ValueError(f"malformed view hierarchy: {tree}")
        depths.append(own)
        sizes.append(len(said))
    places = ancestors(pa.array(depths, pa.list_(pa.int32()))).flatten()
    depth = pa.array([d for own in depths for d in own], pa.int32())
    rows = pa.StructArray.from_arrays([depth, *places.flatten(), pa.array(said, pa.string()), pa.array(flags, pa.int32())], ["depth", "path", "sibling_pos", "said", "flags"])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), rows)


def read_native_trees(df: DataFrame, tree_id: str = "tree_id", xml: str = "xml", max_depth: int | None = None, partitions: int | None = None) -> DataFrame:
    """View hierarchies in XML to raw nodes. Blank texts give none; tags that don't match, or don't end, are an error.

    With ``partitions`` trees are dealt into so many by their id while each is still one row: their nodes, which take far more
    room in a shuffle, then stay where they are.
    """
    tags = F.regexp_extract_all(F.col(xml), F.lit(r'(<node\b[^<>"]*+(?:"[^<"]*+"[^<>"]*+)*+>|</node>|<node\b)'), 1)

    @F.arrow_udf(VIEWS)
    def found(ids: pa.Array, texts: pa.Array) -> pa.Array:
        return views(ids, texts, max_depth)

    trees = df.select(F.col(tree_id).alias("tree_id"), found(F.col(tree_id).cast("string"), tags).alias("_views"))
    if partitions:
        trees = trees.repartition(partitions, "tree_id")
    rows = trees.select("tree_id", F.posexplode("_views").alias("node_id", "n")).select("tree_id", "node_id", "n.*")
    # references are read in one place: in each text's column they would make code too long for the JVM to compile
    words = F.split("said", '"')
    rows = rows.withColumn("said", F.when(F.contains("said", F.lit("&")), F.transform(words, decoded)).otherwise(words))
    text = {name: F.get("said", F.lit(k)) for k, name in enumerate(SAID)}
    desc = F.coalesce(F.nullif(text["desc"], F.lit("")), text["content-desc"])
    return rows.select(
        "tree_id", "node_id", F.try_element_at("path", F.lit(-1)).alias("parent_id"), "depth", "path", "sibling_pos", text["class"].alias("class_name"), text["resource-id"].alias("resource_id"),
        text["text"].alias("text"), desc.alias("content_desc"), text["hint"].alias("hint"), geometry.parse_bounds(text["bounds"]).alias("bounds"), *((F.col("flags").bitwiseAND(1 << k) != 0).alias(c) for k, c in enumerate(RAW_FLAGS)),
    )


def native_xml(raw: DataFrame, brief: bool = False) -> DataFrame:
    """``tree_id`` and the ``xml`` of its raw nodes: what ``read_native_trees`` reads.

    With ``brief`` what a reader takes for missing is left out: empty texts, flags that don't differ from their default, and
    closing tags of views without children. The nodes that are read again are the same.
    """
    following = F.lead("depth").over(W.partitionBy("tree_id").orderBy("node_id"))
    b = F.col("bounds")
    told = lambda name, c: F.concat(F.lit(f' {name}="'), c, F.lit('"'))
    unless = lambda usual, c, said: F.when(F.col(c) != F.lit(usual), said).otherwise("") if brief else said
    text = lambda name, c: unless("", c, told(name, encoded(F.col(c))))
    flags = [unless(c == "enabled", c, told(FLAG_NAMES.get(c, c), F.col(c).cast("string"))) for c in RAW_FLAGS]
    box = F.when(b.isNotNull(), F.concat(F.lit(' bounds="['), b["left"].cast("string"), F.lit(","), b["top"].cast("string"), F.lit("]["), b["right"].cast("string"), F.lit(","), b["bottom"].cast("string"), F.lit(']"'))).otherwise("")
    tag = F.concat(F.lit("<node"), text("class", "class_name"), text("resource-id", "resource_id"), text("text", "text"), text("content-desc", "content_desc"), text("hint", "hint"), box, *flags)
    # a view's tag is named once: what ends it depends on what follows
    up = F.col("depth") - F.coalesce(following, F.lit(0))
    own = F.lit("/>") if brief else F.lit("></node>")
    end = F.when(following > F.col("depth"), ">").otherwise(F.concat(own, F.repeat(F.lit("</node>"), up)))
    lined = raw.withColumn("line", F.concat(tag, end))
    lines = F.sort_array(F.collect_list(F.struct("node_id", "line")))
    return lined.groupBy("tree_id").agg(F.concat(F.lit("<hierarchy>"), F.array_join(F.transform(lines, lambda x: x["line"]), ""), F.lit("</hierarchy>")).alias("xml"))


# ---- HTML ----

#: Elements without a closing tag; marks that make no node.
VOID = "area base br col embed hr img input link meta source track wbr".split()
MARKS = "b i u s em strong small br wbr".split()
#: Roles that an attribute may give.
VALID_ROLES = """alert alertdialog application article association banner blockquote button caption cell checkbox code
columnheader combobox complementary contentinfo definition deletion dialog directory document feed figure form grid gridcell
group heading img image insertion link list listbox listitem log main marquee math menu menubar menuitem menuitemcheckbox
menuitemradio meter navigation none note option paragraph presentation progressbar radio radiogroup region row rowgroup
rowheader scrollbar search searchbox section separator slider slot spinbutton status strong subscript suggestion superswitch
switch tab table tablist tabpanel term textbox time timer toolbar tooltip tree treegrid treeitem""".split()
#: Global attributes that keep an element with role none.
GLOBAL_ARIA = "atomic busy controls current describedby details disabled dropeffect errormessage flowto grabbed haspopup hidden invalid keyshortcuts label labelledby live owns relevant roledescription".split()
#: Roles by tag where no attribute matters.
TAG_ROLES = {
    "button": "button", "textarea": "textbox", "ul": "list", "ol": "list", "menu": "list", "li": "listitem", "dl": "list", "dt": "term", "dd": "definition",
    "nav": "navigation", "main": "screen", "article": "article", "aside": "complementary", "blockquote": "blockquote", "hr": "separator", "p": "paragraph",
    "datalist": "listbox", "details": "group", "meter": "meter", "optgroup": "group", "option": "option", "output": "status", "progress": "progress",
    "table": "table", "caption": "caption", "tr": "row", "td": "cell", "thead": "rowgroup", "tbody": "rowgroup", "tfoot": "rowgroup", "svg": "image",
}
INPUT_ROLES = {"checkbox": "checkbox", "radio": "radio", "submit": "button", "reset": "button", "button": "button", "image": "button", "file": "button", "number": "spinbutton", "range": "slider", "search": "searchbox"}
#: Roles that are named by what they hold. Roles that are part of one of these words count too.
NAMED_BY_CONTENT = """heading,listitem,button,link,treeitem,option,tab,menuitem,menuitemcheckbox,menuitemradio,cell,gridcell,columnheader,rowheader,tooltip,term,definition,group,note,section,caption,paragraph,separator,alert,log,status,marquee,timer,alertdialog,dialog,article,navigation,region,application,form,toolbar,search"""
#: Roles that can be checked, disabled, expanded and selected; read in the same way.
CHECKED = "checkbox,radio,menuitemcheckbox,option,switch,menuitemradio,treeitem"
DISABLED = "application,button,composite,gridcell,group,input,link,menuitem,scrollbar,separator,tab,checkbox,columnheader,combobox,grid,listbox,menu,menubar,menuitemcheckbox,menuitemradio,option,radio,radiogroup,row,rowheader,searchbox,select,slider,spinbutton,switch,tablist,textbox,toolbar,tree,treegrid,treeitem"
EXPANDED = "application,button,checkbox,combobox,gridcell,link,listbox,menuitem,row,rowheader,tab,treeitem,columnheader,menuitemcheckbox,menuitemradio,switch"
SELECTED = "gridcell,option,row,tab,rowheader,columnheader,treeitem"
READONLY = "checkbox,combobox,grid,gridcell,listbox,radiogroup,slider,spinbutton,textbox,columnheader,rowheader,searchbox,switch,treegrid"
LEVELED = "heading,listitem,row,treeitem"


#: A tag: it begins like one, and ``<`` and ``>`` stand in it between quotes only. No pattern here tries a text twice or
#: recurses: each takes what it can and gives nothing back, however long tags, names and texts are.
MARKUP = r"""<[a-zA-Z/!?][^<>"']*+(?:(?:"[^"]*+"|'[^']*+')[^<>"']*+)*+>"""
#: What ends with the text if it has no end of its own: a comment; an element of which nothing is read.
COMMENT = r"<!--(?:-?>|(?:[^-]++|-(?!-!?>))*+(?:--!?>|\z))"
RAW = "|".join(rf"<{t}\b[^<>]*+>(?:[^<]++|<(?!/{t}\b))*+(?:</{t}\b[^>]*+>|\z)" for t in "script style noscript noframes noembed".split())
#: Elements whose content is text whatever it looks like.
TEXTUAL = "|".join(rf"<{t}\b{MARKUP.removeprefix('<[a-zA-Z/!?]')}(?:[^<]++|<(?!/{t}\b))*+(?:</{t}\b[^>]*+>|\z)" for t in ("textarea", "title", "iframe"))
WORDS = rf"(?:[^<]++|<(?!{MARKUP.removeprefix('<')}|!--))++"
#: Elements that may be switched off, that hold a value, and that can be required or read only.
FORM_TAGS = "button fieldset input optgroup option select textarea".split()
#: Elements without a role of their own that begin a line of their own.
BLOCK_TAGS = "html body div section form header footer fieldset legend figure figcaption address hgroup center summary search pre listing xmp dir optgroup colgroup col frameset".split()


def attributes(tag: Column) -> Column:
    """``map`` of the attributes of a tag, names in lower case; the first of a name counts, bare ones are ``''``."""
    pattern = r"""(?s)\s([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?"""
    part = lambda k: F.regexp_extract_all(tag, F.lit(pattern), k)
    values = F.zip_with(F.zip_with(part(2), part(3), lambda a, b: F.concat(a, b)), part(4), lambda a, b: F.concat(a, b))
    return first_of_each(F.transform(part(1), F.lower), F.transform(values, decoded))


def _no_attributes() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def _token(t: Column) -> Column:
    """A token as an array of ``kind``, ``tag``, ``attrs`` and ``text``: one, or the three of an element with textual content."""
    raw_tag = F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1))
    part = lambda kind, tag, attrs, text: F.struct(kind.alias("kind"), tag.alias("tag"), attrs.alias("attrs"), text.alias("text"))
    none, empty = F.lit(""), _no_attributes()
    tag = F.when(raw_tag == "image", "img").otherwise(raw_tag)
    skipped = t.rlike(r"(?i)^<(?:!|\?|(?:script|style|noscript|noframes|noembed)\b)") | raw_tag.isin(*MARKS) | (raw_tag == "")
    closes = F.startswith(t, F.lit("</"))
    kind = F.when(skipped, outline.OTHER).when(closes, outline.CLOSE).when(raw_tag.isin(*VOID), outline.LEAF).when(F.endswith(t, F.lit("/>")), outline.SELF).otherwise(outline.OPEN)
    attrs = attributes(t)
    given = lambda a, name: F.coalesce(a[name], F.lit(""))

    def control(a: Column) -> Column:
        """What an input says inside other content."""
        form = F.lower(given(a, "type"))
        said = F.when(form.isin("submit", "reset", "button"), F.coalesce(F.nullif(given(a, "value"), none), form)).when(~form.isin("hidden", "checkbox", "radio", "file"), given(a, "value"))
        return F.coalesce(said, none)

    element = let(F.when(skipped | closes, empty).otherwise(attrs), lambda a: F.array(part(kind, F.when(skipped, none).otherwise(tag), a, F.when(tag == "input", control(a)).otherwise(none))))
    opening = F.regexp_extract(t, f"^{MARKUP}", 0)
    content = F.regexp_replace(F.substring(t, F.length(opening) + 1, F.length(t)), r"(?i)</(?:textarea|title|iframe)\b[^>]*+>?\z", "")
    textual = F.array(part(F.lit(outline.OPEN), tag, attributes(opening), none), part(F.when(tag == "iframe", outline.OTHER).otherwise(outline.TEXT), none, empty, content), part(F.lit(outline.CLOSE), tag, empty, none))
    is_text = ~F.startswith(t, F.lit("<")) | ~t.rlike(rf"\A(?i:{MARKUP}|{COMMENT}|{RAW}|{TEXTUAL})\z")
    return F.when(is_text, F.array(part(F.lit(outline.TEXT), none, empty, t))).when(tag.isin("textarea", "title", "iframe") & ~closes, textual).otherwise(element)


def read_html_pages(df: DataFrame, tree_id: str = "page_id", html: str = "html", max_depth: int = MAX_DEPTH) -> DataFrame:
    """Pages to element and text nodes: ``tag``, ``attrs``, ``text`` beside the tree's columns; hidden elements are gone.

    ``last`` is the last node below each; ``told`` has what the outline of the whole page says of an element: its content,
    what labels it, whether something above switches it off. Tags are placed as a parser places them (implied ends, table
    parts, stray ends); marks like ``b`` and ``br`` are no nodes, and misnested ones aren't opened again.
    """
    tokens = F.regexp_extract_all(F.col(html), F.lit(rf"(?i)({COMMENT}|{RAW}|{TEXTUAL}|{MARKUP}|{WORDS})"), 1)
    rows = df.select(F.col(tree_id).alias("tree_id"), F.flatten(F.transform(tokens, _token)).alias("_tokens"))
    has = lambda t, name: F.map_contains_key(t["attrs"], name)
    said = lambda t, name: F.coalesce(t["attrs"][name], F.lit(""))

    def marks(t: Column) -> Column:
        off = F.when(t["tag"].isin(*FORM_TAGS) & has(t, "disabled"), outline.IS_OFF).otherwise(0)
        chosen = F.when((t["tag"] == "option") & has(t, "selected"), outline.SELECTED).otherwise(0)
        several = F.when((t["tag"] == "select") & (has(t, "multiple") | (F.coalesce(said(t, "size").try_cast("int"), F.lit(0)) > 1)), outline.MULTIPLE).otherwise(0)
        return off + chosen + several + F.when(said(t, "aria-disabled") == "true", outline.ARIA_OFF).otherwise(0)

    @F.arrow_udf(outline.PLACED)
    def found(kinds: pa.Array, tags: pa.Array, words: pa.Array, ids: pa.Array, fors: pa.Array, refs: pa.Array, marked: pa.Array) -> pa.Array:
        return outline.outlines(kinds, tags, words, ids, fors, refs, marked, max_depth=max_depth)

    each = lambda f: F.transform("_tokens", f)
    told = found(each(lambda t: t["kind"]), each(lambda t: t["tag"]), each(lambda t: t["text"]), each(lambda t: said(t, "id")), each(lambda t: said(t, "for")), each(lambda t: said(t, "aria-labelledby")), each(marks))
    rows = rows.withColumn("_placed", told)
    token = lambda k: F.get("_tokens", k)
    whole = F.transform("_placed", lambda n: F.struct(n.alias("n"), token(n["at"])["tag"].alias("tag"), token(n["at"])["attrs"].alias("attrs"), token(n["table"])["attrs"]["role"].alias("table_role"), token(n["picked"])["attrs"]["value"].alias("picked")))
    n = rows.select("tree_id", F.posexplode(whole).alias("node_id", "_x")).select("tree_id", "node_id", "_x.*")
    tag = F.coalesce("n.made", F.when(F.col("tag") == "", "#text").otherwise(F.col("tag")))
    kept = ["only_text", "off", "chosen", "spoken", "labelled", "by_for", "wrapped", "inner"]
    return n.select(
        "tree_id", "node_id", F.try_element_at("n.path", F.lit(-1)).alias("parent_id"), "n.depth", "n.path", "n.sibling_pos", tag.alias("tag"), F.coalesce("attrs", _no_attributes()).alias("attrs"), "n.text",
        "n.last", F.struct(*(F.col(f"n.{k}") for k in kept), F.coalesce("table_role", F.lit("")).alias("table_role"), "picked").alias("told"),
    )


def _style() -> Column:
    return F.regexp_replace(F.lower(_said("style")), r"\s+", "")


def hidden_html(nodes: DataFrame) -> DataFrame:
    """Without invisible elements; visible children and texts move up to the nearest shown ancestor. Options of a select stay.

    ``display:none`` and ``aria-hidden`` above an element hide it as well; an element isn't hidden by its own ``aria-hidden``.
    """
    from screenloom.operators.tree import reattach

    return reattach(nodes.withColumn("_hide", _hidden()), F.col("_hide")).select(*nodes.columns)


def _hidden() -> Column:
    from screenloom.operators.tree import below

    none = F.contains(_style(), F.lit("display:none")) | _has("hidden")
    unseen = F.contains(_style(), F.lit("visibility:hidden")) | _style().rlike(r"opacity:0(\.0*)?(;|$)")
    covers = none | (_said("aria-hidden") == "true")
    free = (F.col("tag") == "option") & below(F.col("tag") == "select")
    return (F.col("tag") != "#text") & (none | unseen | below(covers)) & ~free


def _said(name: str) -> Column:
    return F.coalesce(F.col("attrs")[name], F.lit(""))


def _has(name: str) -> Column:
    return F.map_contains_key("attrs", name)


def within(role: Column, words: str) -> Column:
    """A role is part of the list's text."""
    return F.contains(F.lit(words), role)


def _explicit(said: Column) -> Column:
    """The first valid role that an attribute names."""
    tokens = F.filter(F.split(F.trim(said), r"\s+"), lambda t: (t != "") & F.contains(F.lit(",".join(VALID_ROLES)), t))
    return F.get(tokens, F.lit(0))


def html_role(nodes: DataFrame) -> DataFrame:
    """``role`` of each node: the first valid one its attribute names, else by tag, attributes, ancestors and siblings.

    Nodes with neither (``role`` null) are left out of the tree, with all that is below them, by ``html_nodes``.
    """
    from screenloom.operators.tree import below, siblings

    tag = F.col("tag")
    named = (_said("aria-label") != "") | (_said("aria-labelledby") != "") | (_said("title") != "")
    kind = F.lower(_said("type"))
    input_role = F.when(kind == "hidden", None)
    for k, v in INPUT_ROLES.items():
        input_role = input_role.when(kind == k, F.when(F.lit(k == "search") & _has("list"), "combobox").otherwise(v))
    input_role = input_role.when(_has("list") & kind.isin("", "text", "email", "tel", "url"), "combobox").otherwise("textbox")
    in_landmark = below(tag.isin("article", "aside", "main", "nav", "section"))
    multiple = _has("multiple") | (_said("size").try_cast("int") > 1)
    cells = F.sum(F.when(tag.isin("td", "th"), 1).otherwise(0)).over(siblings().rowsBetween(W.unboundedPreceding, 0))
    n = nodes.withColumn("_land", in_landmark).withColumn("_head", below(tag == "thead")).withColumn("_cells", cells)
    implicit = (
        F.when(tag == "#text", "text")
        .when(tag.isin("a", "area"), F.when(_has("href"), "link").otherwise("generic"))
        .when(tag == "input", input_role)
        .when(tag == "select", F.when(F.coalesce(multiple, F.lit(False)), "listbox").otherwise("combobox"))
        .when(tag == "img", F.when(_has("alt") & (_said("alt") == "") & (_said("title") == "") & (_said("aria-label") == "") & (_said("tabindex") == ""), None).otherwise("image"))
        .when(tag.rlike("^h[1-6]$"), "heading")
        .when(tag == "section", F.when(named, "section").otherwise("generic"))
        .when(tag == "form", F.when(named, "form").otherwise("generic"))
        .when(tag == "header", F.when(F.col("_land"), "generic").otherwise("toolbar"))
        .when(tag == "footer", F.when(F.col("_land"), "generic").otherwise("section"))
        .when(tag == "dialog", F.when(_has("open"), "dialog"))
        .when((tag == "td") & F.coalesce(_explicit(F.col("told.table_role")).isin("grid", "treegrid"), F.lit(False)), "gridcell")
        .when(tag == "th", F.when(_said("scope") == "row", "rowheader").when(_said("scope").isin("col", "colgroup") | F.col("_head"), "columnheader").when(F.col("_cells") == 1, "rowheader").otherwise("columnheader"))
    )
    for k, v in TAG_ROLES.items():
        implicit = implicit.when(tag == k, v)
    implicit = implicit.otherwise("generic")
    explicit = _explicit(_said("role"))
    aria = F.lit(False)
    for a in GLOBAL_ARIA:
        aria |= _has(f"aria-{a}")
    role = F.when(explicit.isin("presentation", "none"), F.when(aria | _has("tabindex"), implicit)).when(explicit.isNotNull(), explicit).otherwise(implicit)
    return n.withColumn("role", role).drop("_land", "_head", "_cells")


def html_name(nodes: DataFrame) -> DataFrame:
    """``name`` of each node with a role: labels, then alternatives by tag, then content for the roles that take it.

    Content and labels are those of the whole page, hidden parts too; controls in it say their values.
    """
    tag, form, told = F.col("tag"), F.lower(_said("type")), lambda k: F.col(f"told.{k}")
    content = told("spoken")
    held = F.when(within(F.coalesce("role", F.lit("generic")), NAMED_BY_CONTENT), F.when(F.length(content) > 200, F.concat(F.substring(content, 1, 200), F.lit("..."))).otherwise(content))
    filled = lambda c: F.nullif(c, F.lit(""))
    trimmed = lambda c: filled(F.regexp_replace(c, r"^\s+|\s+$", ""))
    name = F.coalesce(
        F.when(tag == "#text", F.col("text")), trimmed(_said("aria-label")), filled(told("labelled")), filled(told("by_for")), filled(told("wrapped")), F.when((tag == "img") & _has("alt"), _said("alt")),
        F.when((tag == "input") & form.isin("submit", "reset", "button", "image"), F.coalesce(filled(_said("value")), form)), F.when((tag == "input") & (form == "file"), F.lit("Choose File")),
        F.when(tag.isin("input", "textarea"), filled(_said("placeholder"))), F.when(tag.isin("table", "figure", "fieldset", "details", "svg"), filled(told("inner"))), filled(held), filled(_said("title")), F.lit(""),
    )
    return nodes.withColumn("name", name)


def _value() -> Column:
    """The value that a control has on the page as it was loaded; null for what is no control."""
    tag, form, told = F.col("tag"), F.lower(_said("type")), lambda k: F.col(f"told.{k}")
    given = F.col("attrs")["value"]
    number = lambda name, default: F.coalesce(_said(name).try_cast("double"), F.lit(default))
    low, high = number("min", 0.0), number("max", 100.0)
    middle = F.when(high < low, low).otherwise(low + (high - low) / 2)
    middle = F.regexp_replace(middle.cast("string"), r"\.0$", "")
    of_input = F.when(form.isin("checkbox", "radio"), F.coalesce(given, F.lit("on"))).when(form == "file", "").when(form == "range", F.coalesce(F.when(given.try_cast("double").isNotNull(), given), middle))
    of_input = of_input.when(form == "color", F.coalesce(F.when(given.rlike("^#[0-9a-fA-F]{6}$"), F.lower(given)), F.lit("#000000"))).when(form == "number", F.when(given.try_cast("double").isNotNull(), given)).otherwise(given)
    return F.when(tag == "input", of_input).when(tag.isin("textarea", "output"), told("inner")).when(tag == "select", F.coalesce(told("picked"), told("inner"))).when(tag == "option", F.coalesce(given, told("inner"))).when(tag.isin("button", "data"), given)


def _invalid() -> Column:
    """A control whose value breaks what its attributes ask: ``required``, ``min`` and ``max``."""
    tag, form = F.col("tag"), F.lower(_said("type"))
    open_ = ~_has("disabled") & ~_has("readonly")
    blank = F.coalesce(_value(), F.lit("")) == ""
    asks = ~form.isin("hidden", "range", "color", "submit", "reset", "button", "image", "radio", "checkbox")
    missing = _has("required") & open_ & F.when(tag == "input", F.when(form == "checkbox", ~_has("checked")).otherwise(asks & blank)).when(tag.isin("select", "textarea"), blank).otherwise(False)
    number = _value().try_cast("double")
    beyond = (tag == "input") & (form == "number") & ((number < _said("min").try_cast("double")) | (number > _said("max").try_cast("double")))
    return missing | F.coalesce(beyond, F.lit(False))


def html_states(nodes: DataFrame) -> DataFrame:
    """``states`` of each node with a role, in order; a disabled fieldset with a legend disables what is in it but its legend."""
    from screenloom.functions.names import states_of

    role, tag, form = F.coalesce("role", F.lit("generic")), F.col("tag"), F.lower(_said("type"))
    checked = within(role, CHECKED) & (((tag == "input") & _has("checked")) | (_said("aria-checked") == "true"))
    expanded = F.when(tag == "details", F.when(_has("open"), "true").otherwise("false")).otherwise(F.col("attrs")["aria-expanded"])
    off = (tag.isin(*FORM_TAGS) & _has("disabled")) | (_said("aria-disabled") == "true") | F.col("told.off")
    inv = _said("aria-invalid")
    level = F.coalesce(F.nullif(_said("aria-level"), F.lit("")), F.nullif(F.regexp_extract("tag", r"^h(\d)$", 1), F.lit("")))
    click = tag.isin("button", "a", "select") | ((tag == "input") & (form != "hidden")) | (_said("role") == "button") | _has("onclick")
    value = F.nullif(_value(), F.lit(""))
    ok = lambda c: F.coalesce(c, F.lit(False)) & (tag != "#text")
    states = states_of(
        (ok(checked), "checked"),
        (ok(within(role, CHECKED) & (_said("aria-checked") == "mixed")), "indeterminate"),
        (ok(within(role, DISABLED) & off), "disabled"),
        (ok(within(role, EXPANDED) & expanded.isNotNull()), F.when(expanded == "true", "expanded").otherwise("collapsed")),
        (ok((role == "button") & (_said("aria-pressed") == "true")), "pressed"),
        (ok((role == "button") & (_said("aria-pressed") == "mixed")), "pressed=mixed"),
        (ok(within(role, SELECTED) & ((_said("aria-selected") == "true") | F.col("told.chosen"))), "selected"),
        (ok(within(role, READONLY) & ((tag.isin("input", "textarea") & _has("readonly")) | (_said("aria-readonly") == "true"))), "readonly"),
        (ok((inv == "true") | (~inv.isin("grammar", "spelling") & _invalid())), "invalid"),
        (ok(inv.isin("grammar", "spelling")), F.concat(F.lit("invalid="), inv)),
        (ok(within(role, LEVELED) & level.isNotNull()), F.concat(F.lit("level="), level)),
        (ok(click), "clickable"),
        (ok(value.isNotNull()), F.concat(F.lit("value="), value)),
    )
    return nodes.withColumn("states", states)


def html_tree(nodes: DataFrame) -> DataFrame:
    """Nodes with their roles to the tree that is shown.

    A visible element without a role goes with all that is below it. Invisible ones, and those without a role of their own
    that stand in a line and hold nothing but one text, give way to their children. A text box shows no text.
    """
    from screenloom.operators.tree import of_parent, restructured

    style = F.regexp_extract(_style(), "display:([^;]*)", 1)
    inline = F.when(style != "", style == "inline").otherwise(~F.col("tag").isin(*BLOCK_TAGS))
    skip = (F.col("role") == "generic") & inline & F.col("told.only_text") & (F.col("tag") != "#text")
    fate = F.when(F.col("_hide"), 1).when(F.col("role").isNull(), 2).when(skip, 1).otherwise(0)
    shown = of_parent(restructured(nodes.withColumn("_hide", _hidden()), fate), "_up", F.col("role"))
    return shown.where(~((F.col("tag") == "#text") & F.coalesce(F.col("_up") == "textbox", F.lit(False)))).drop("_up", "_hide")


def html_nodes(df: DataFrame, tree_id: str = "page_id", html: str = "html", max_depth: int = MAX_DEPTH) -> DataFrame:
    """Pages to the node contract: read, role, name and states, then the tree that is shown."""
    n = html_tree(html_states(html_name(html_role(read_html_pages(df, tree_id, html, max_depth)))))
    empty = F.lit("")
    return n.select(
        "tree_id", F.lit("html").alias("source"), "node_id", "parent_id", "depth", "path", "sibling_pos", "role", F.lit("html").alias("role_source"), F.lit(1.0).alias("role_confidence"),
        "name", "text", empty.alias("content_desc"), F.coalesce(F.col("attrs")["id"], empty).alias("resource_id"), F.col("tag").alias("class_name"),
        F.lit(None).cast("struct<left:int,top:int,right:int,bottom:int>").alias("bounds"), "states", F.col("node_id").alias("web_idx"), empty.alias("ref"),
    )
