"""Queries over web pages, JSON trees, snapshots, annotations and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.cut import cut, dealt, shared_folder
from screenloom.functions import names, roles
from screenloom.operators import actions, evaluate, native, tree
from screenloom.plans import views as V
from screenloom.plans.native_queries import EVIDENCE, conversation_tree, evidence, flat, icon_targets, run_nodes
from screenloom.plans.registry import query
from screenloom.schema import RAW_FLAGS
from screenloom.sources import files, markup, texts, trees


def page_nodes(spark, sf) -> DataFrame:
    return markup.html_nodes(V.table(spark, sf, "pages"))


BARE = """(SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style|head|noscript|template)\\b[^>]*>.*?</(script|style|head|noscript|template)\\s*>', '', 'g') AS h FROM pages)"""


@query("s5_read_html_pages", f"""SELECT page_id AS tree_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(h, '<(html|body|nav|ul|li|a|div|article|h1|p|footer)\\b', 1)) AS tag FROM {BARE}) GROUP BY ALL""")
def s5(spark, sf):
    n = markup.read_html_pages(V.table(spark, sf, "pages"))
    return n.where("tag <> '#text'").groupBy("tree_id", "tag").agg(F.count("*").alias("n"))


@query("p6_hidden_html", f"""SELECT page_id AS tree_id, len(regexp_extract_all(h, '<(html|body|nav|ul|li|a|article|h1|p|footer)\\b')) AS n FROM {BARE}""")
def p6(spark, sf):
    """Advertisements are hidden by style; what is in them moves up or, if text, goes with the others that stay."""
    hidden = F.regexp_replace("html", '<div class="ad">', '<div class="ad" style="visibility: hidden">')
    n = markup.hidden_html(markup.read_html_pages(V.table(spark, sf, "pages").withColumn("html", hidden)))
    return n.where("tag <> '#text'").groupBy("tree_id").agg(F.count("*").alias("n"))


@query("p10_html_role", f"""SELECT page_id AS tree_id, role, count(*) AS n FROM (SELECT page_id, CASE tag WHEN 'nav' THEN 'navigation' WHEN 'ul' THEN 'list' WHEN 'li' THEN 'listitem' WHEN 'a' THEN 'link' WHEN 'article' THEN 'article' WHEN 'h1' THEN 'heading'
  WHEN 'p' THEN 'paragraph' WHEN 'footer' THEN 'section' ELSE 'generic' END AS role FROM (SELECT page_id, unnest(regexp_extract_all(h, '<(html|body|nav|ul|li|a|div|article|h1|p|footer)\\b', 1)) AS tag FROM {BARE})) GROUP BY ALL""")
def p10(spark, sf):
    n = markup.html_role(markup.read_html_pages(V.table(spark, sf, "pages")))
    return n.where("tag <> '#text'").groupBy("tree_id", "role").agg(F.count("*").alias("n"))


def _named(tag: str) -> str:
    """SQL for what stands between the tags of an element, tags gone. A paragraph ends where the next begins or the article ends."""
    page = "replace(replace(h, '<p>', '</p><p>'), '</article>', '</p></article>')" if tag == "p" else "h"
    return f"SELECT page_id, '{tag}' AS tag, regexp_replace(unnest(regexp_extract_all({page}, '(?s)<{tag}\\b[^>]*>(.*?)</{tag}>', 1)), '<[^>]*>', ' ', 'g') AS part FROM {BARE}"


def _decoded(text: str) -> str:
    """SQL for a text with its character references read; ``&amp;`` last.

    As a parser has it, numbers and the old names (all but ``apos``) need no semicolon: texts may be cut within a reference.
    """
    text = f"regexp_replace({text}, '&#([0-9]+);?', '&#\\1;', 'g')"
    for said, meant in (("&lt", "'<'"), ("&gt", "'>'"), ("&quot", "chr(34)"), ("&apos;", "chr(39)"), ("&#39;", "chr(39)"), ("&#10;", "chr(10)"), ("&nbsp", "' '"), ("&copy", "'©'"), ("&middot", "'·'"), ("&amp", "'&'")):
        text = f"replace({text}, '{said}', {meant})" if said.endswith(";") else f"regexp_replace({text}, '{said};?', {meant}, 'g')"
    return text


NAMED = "a h1 p li ul nav article footer".split()


@query("p14_html_name", f"""SELECT page_id AS tree_id, tag, CASE WHEN length(name) > 200 THEN substr(name, 1, 200) || '...' ELSE name END AS name, count(*) AS n FROM (
  SELECT page_id, tag, trim(regexp_replace({_decoded('part')}, '\\s+', ' ', 'g')) AS name FROM (
    {' UNION ALL '.join(map(_named, NAMED))})) GROUP BY ALL""")
def p14(spark, sf):
    n = page_nodes(spark, sf).where(F.col("class_name").isin(*NAMED))
    return n.groupBy("tree_id", F.col("class_name").alias("tag"), "name").agg(F.count("*").alias("n"))


@query("p21_html_states", f"""SELECT page_id AS tree_id, CASE tag WHEN 'h1' THEN 'level=1' WHEN 'a' THEN 'clickable' ELSE '' END AS states, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(h, '<(html|body|nav|ul|li|a|div|article|h1|p|footer)\\b', 1)) AS tag FROM {BARE}) GROUP BY ALL""")
def p21(spark, sf):
    n = flat(page_nodes(spark, sf).where("class_name <> '#text'").select("tree_id", "states"))
    return n.groupBy("tree_id", "states").agg(F.count("*").alias("n"))


#: A page for each page of the table, made of what pages seldom have; ``@`` is the page's host.
RULES_PAGE = """<ul><li>one @<li>two</ul><table><tr><td>a<td>b</table><label>Own @</label><label>Name <input value="v@"></label><button>Go <input value="v1"></button>
<button>Pick <select><option>x<option selected>@</select></button><div role="presentation"><p>not shown</p></div><textarea>typed @</textarea><fieldset disabled><legend><input title="in"></legend><input title="out"></fieldset>
<fieldset disabled><input title="free"></fieldset><div><span>solo @</span></div><input type="submit" value="Send"><input type="checkbox" checked><input required title="must"></x>"""
#: What of it is shown: class, role, name and states.
RULES_ROWS = [
    ("ul", "list", "one @ two", ""), ("li", "listitem", "one @", ""), ("#text", "text", "one @", ""), ("li", "listitem", "two", ""), ("#text", "text", "two", ""), ("table", "table", "", ""), ("tbody", "rowgroup", "", ""), ("tr", "row", "a b", ""),
    ("td", "cell", "a", ""), ("#text", "text", "a", ""), ("td", "cell", "b", ""), ("#text", "text", "b", ""), ("#text", "text", "Own @", ""), ("label", "generic", "Name", ""), ("#text", "text", "Name", ""),
    ("input", "textbox", "Name", "clickable value=v@"), ("button", "button", "Go v1", "clickable"), ("#text", "text", "Go", ""), ("input", "textbox", "", "clickable value=v1"), ("button", "button", "Pick @", "clickable"), ("#text", "text", "Pick", ""),
    ("select", "combobox", "", "clickable value=@"), ("option", "option", "x", "value=x"), ("#text", "text", "x", ""), ("option", "option", "@", "selected value=@"), ("#text", "text", "@", ""), ("textarea", "textbox", "", "value=typed @"),
    ("fieldset", "generic", "", ""), ("legend", "generic", "", ""), ("input", "textbox", "in", "clickable"), ("input", "textbox", "out", "disabled clickable"), ("fieldset", "generic", "", ""), ("input", "textbox", "free", "clickable"),
    ("div", "generic", "", ""), ("#text", "text", "solo @", ""), ("input", "button", "Send", "clickable value=Send"), ("input", "checkbox", "", "checked clickable value=on"), ("input", "textbox", "must", "invalid clickable"),
]


@query("html_rules", f"""SELECT page_id AS tree_id, r[1] AS class_name, replace(r[2], '@', host) AS role, replace(r[3], '@', host) AS name, replace(r[4], '@', host) AS states, count(*) AS n
FROM (SELECT page_id, coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') AS host FROM pages), (SELECT unnest({[list(r) for r in RULES_ROWS]}) AS r) WHERE host <> '' GROUP BY ALL""")
def html_rules(spark, sf):
    """Implied ends, table parts, labels, controls in content, text boxes, legends, null roles, spans: whole rows of a made page."""
    hosts = V.table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).where("host <> ''")
    n = markup.html_nodes(hosts.select("page_id", F.replace(F.lit(RULES_PAGE), F.lit("@"), F.col("host")).alias("html")))
    return n.groupBy("tree_id", "class_name", "role", "name", F.array_join("states", " ").alias("states")).agg(F.count("*").alias("n"))


def page_evidence(spark) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES (0, 'structure', 'links', 'navigational', 'link', '', 3), (0, 'structure', 'headings', 'structural', 'heading', '', 1), (0, 'text', 'paragraphs', 'textual_content', 'paragraph', '', 4) AS t(baseline_id, target_id, evidence_id, capability, role, name, min_count)")


COUNTS = f"""(SELECT page_id, len(regexp_extract_all(h, '<a\\b')) AS a, len(regexp_extract_all(h, '<h1\\b')) AS h1, len(regexp_extract_all(h, '<p\\b')) AS p FROM {BARE})"""


@query("flagship_page_scores", f"""SELECT CAST(0 AS INT) AS baseline_id, page_id AS run_id, target_id, passed, total, passed / total AS score, CASE WHEN passed = total THEN 'PASS' ELSE 'FAIL' END AS status FROM (
  SELECT page_id, 'structure' AS target_id, CAST((a >= 3)::INT + (h1 >= 1)::INT AS BIGINT) AS passed, 2 AS total FROM {COUNTS} UNION ALL SELECT page_id, 'text', CAST((p >= 4)::INT AS BIGINT), 1 FROM {COUNTS})""")
def flagship(spark, sf):
    """Pages read, roles and names found, held against evidence and scored: the whole way from HTML to a score."""
    nodes = page_nodes(spark, sf).select(F.lit(0).alias("baseline_id"), F.col("tree_id").alias("run_id"), "role", "name")
    return evaluate.score_targets(evaluate.evaluate_counts(evaluate.match_evidence(nodes, page_evidence(spark))))


@query("page_snapshots")
def page_snapshots(spark, sf):
    """Pages as snapshots: a test has a golden one, as SQL would repeat the whole reader."""
    return tree.render_snapshot(page_nodes(spark, sf))


@query("a5_size_reduction")
def a5(spark, sf):
    """Bytes of pages and of their snapshots by host, and in all."""
    pages = V.table(spark, sf, "pages")
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    sizes = pages.select(F.col("page_id").alias("tree_id"), host.alias("host"), F.octet_length("html").alias("raw_bytes")).join(page_snapshots(spark, sf), "tree_id", "left")
    return evaluate.size_reduction(sizes.withColumn("snapshot_bytes", F.coalesce(F.octet_length("snapshot"), F.lit(0))), "host")


ATTRIBUTES = "'<node class=\"' || class_name || '\" resource-id=\"' || resource_id || '\" text=\"' || text || '\" content-desc=\"\" hint=\"' || hint || '\" bounds=\"[' || l || ',' || t || '][' || r || ',' || b || ']\"'"
FLAGS = " || ".join(f"' {markup.FLAG_NAMES.get(c, c)}=\"' || {c if c in ('clickable', 'enabled', 'checked', 'item_click') else 'false'} || '\"'" for c in RAW_FLAGS)


@query("a5_screen_reduction", f"""SELECT * , snapshot_bytes / raw_bytes AS ratio FROM (SELECT container, CAST(sum(raw_bytes) AS BIGINT) AS raw_bytes, CAST(sum(octet_length(encode(snapshot))) AS BIGINT) AS snapshot_bytes FROM (
  SELECT tree_id, max(class_name) FILTER (node_id = 1) AS container, 23 + sum(octet_length(encode({ATTRIBUTES} || {FLAGS} || '>')) + 7) AS raw_bytes FROM screen GROUP BY tree_id) JOIN snaps USING (tree_id) GROUP BY ROLLUP (container))""")
def a5b(spark, sf):
    """Bytes of screens in XML and of their snapshots, by the kind of their container and in all."""
    screens = V.screen_nodes(spark, sf)
    kind = screens.where("node_id = 1").select("tree_id", F.col("class_name").alias("container"))
    raw = markup.native_xml(screens).select("tree_id", F.octet_length("xml").alias("raw_bytes"))
    shots = tree.render_snapshot(V.native_with_refs(spark, sf)).select("tree_id", F.octet_length("snapshot").alias("snapshot_bytes"))
    return evaluate.size_reduction(raw.join(shots, "tree_id").join(kind, "tree_id"), "container")


@query("s2_read_native_trees", "SELECT tree_id, node_id, parent_id, depth, sibling_pos, class_name, resource_id, text, hint, l, t, r, b, clickable, enabled, checked, item_click FROM screen")
def s2(spark, sf):
    """Screens printed as XML and read again."""
    out = markup.read_native_trees(markup.native_xml(V.screen_nodes(spark, sf)))
    return flat(out).select("tree_id", "node_id", "parent_id", "depth", "sibling_pos", "class_name", "resource_id", "text", "hint", "l", "t", "r", "b", "clickable", "enabled", "checked", "item_click")


def web_json(spark, sf) -> DataFrame:
    """Conversations as web trees in JSON."""
    child = F.struct(F.when(F.col("turn") % 2 == 0, "text").otherwise("blob").alias("role"), F.col("text").alias("name"), F.array(F.lit("clickable")).alias("states"), F.when(F.col("turn") % 3 == 0, F.array(F.lit(1), F.lit(2), F.lit(3), F.col("turn").cast("int"))).otherwise(F.array().cast("array<int>")).alias("bounds"), F.col("turn").alias("__pr_idx"))
    said = V.table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", child.alias("child")))).alias("turns"))
    root = F.struct(F.lit("main").alias("role"), F.lit("talk").alias("name"), F.transform("turns", lambda t: t["child"]).alias("children"))
    return said.select(F.col("conv_id").alias("tree_id"), F.to_json(F.struct(F.lit("http://a/").alias("url"), root.alias("root"))).alias("json"))


@query("s3_read_web_trees", """SELECT conv_id AS tree_id, 0 AS node_id, CAST(NULL AS INT) AS parent_id, 'generic' AS role, 'talk' AS name, '' AS states, -1 AS web_idx, CAST(NULL AS INT) AS b FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS INT), 0, CASE WHEN turn % 2 = 0 THEN 'text' ELSE 'generic' END, text, 'clickable', CAST(turn AS INT), CASE WHEN turn % 3 = 0 THEN CAST(turn AS INT) END FROM conversations""")
def s3(spark, sf):
    return flat(trees.read_web_trees(web_json(spark, sf))).select("tree_id", "node_id", "parent_id", "role", "name", "states", "web_idx", "b")


@query("t6_normalize_web", """SELECT tree_id, role, name, count(*) AS n FROM (
  SELECT conv_id AS tree_id, CASE WHEN bool_and(is_text) THEN 'text' ELSE 'generic' END AS role, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (text <> ''), '') AS name FROM (SELECT *, sum(CASE WHEN is_text AND was THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (
    SELECT conv_id, turn, text, role <> 'system' AND turn % 3 < 2 AS is_text, coalesce(lag(role <> 'system' AND turn % 3 < 2) OVER (PARTITION BY conv_id ORDER BY turn), false) AS was FROM conversations)) GROUP BY conv_id, run
  UNION ALL SELECT DISTINCT conv_id, 'screen', '' FROM conversations) GROUP BY ALL""")
def t6(spark, sf):
    return tree.normalize_web(conversation_tree(spark, sf)).groupBy("tree_id", "role", "name").agg(F.count("*").alias("n"))


def inspector_json(spark, sf) -> DataFrame:
    """Orders as inspector dumps: a list with an item for each line."""
    kind = F.get(F.array(*map(F.lit, ("Text", "Button", "Toggle", "Blank", "TextInput", "ListItem", "Custom", "Swiper"))), ((F.col("l_partkey") + F.col("seq")) % 8).cast("int"))
    attrs = F.create_map(F.lit("content"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_returnflag")).otherwise(""), F.lit("enabled"), (F.col("l_tax") > 0.01).cast("string"), F.lit("selected"), (F.col("l_discount") > 0.05).cast("string"), F.lit("focusable"), (F.col("l_partkey") % 2 == 0).cast("string"), F.lit("scrollable"), F.lit("true"), F.lit("placeholder"), F.lit("type here"), F.lit("accessibilityRole"), F.when(F.col("l_partkey") % 5 == 0, "BUTTON").otherwise(""))
    rect = F.format_string("[%.2f, %.2f],[%.2f, %.2f]", F.col("l_quantity") / 4, F.col("l_quantity") / 8, F.col("l_quantity"), F.col("l_quantity") / 2)
    child = F.struct(kind.alias("$type"), F.col("seq").alias("$ID"), rect.alias("$rect"), attrs.alias("$attrs"))
    rows = V.lines(spark, sf).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("seq", child.alias("child"))), lambda a, b: F.when(a["seq"] < b["seq"], -1).otherwise(1)).alias("lines"))
    root = F.struct(F.lit("List").alias("$type"), F.lit(0).alias("$ID"), F.lit("").alias("$rect"), F.create_map(F.lit("enabled"), F.lit("true")).alias("$attrs"), F.transform("lines", lambda x: x["child"]).alias("$children"))
    return rows.select(F.col("l_orderkey").alias("tree_id"), F.to_json(root).alias("json"))


HARMONY = """(SELECT l_orderkey AS tree_id, seq AS node_id, ['Text', 'Button', 'Toggle', 'Blank', 'TextInput', 'ListItem', 'Custom', 'Swiper'][(l_partkey + seq) % 8 + 1] AS kind, CASE WHEN l_partkey % 3 = 0 THEN l_returnflag ELSE '' END AS content, l_tax > 0.01 AS enabled, l_discount > 0.05 AS selected,
  l_partkey % 2 = 0 AS focusable, l_partkey % 5 = 0 AS a11y, CAST(floor(l_quantity / 4 + 0.5) AS INT) AS l, CAST(floor(l_quantity / 8 + 0.5) AS INT) AS t, CAST(floor(l_quantity + 0.5) AS INT) AS r, CAST(floor(l_quantity / 2 + 0.5) AS INT) AS b FROM lines)"""


@query("s4_read_inspector_trees", f"SELECT tree_id, node_id, kind, l, t, r, b, content FROM {HARMONY} UNION ALL SELECT l_orderkey, 0, 'List', NULL, NULL, NULL, NULL, '' FROM order_ids")
def s4(spark, sf):
    n = trees.read_inspector_trees(inspector_json(spark, sf))
    return flat(n.select("tree_id", "node_id", "kind", "bounds", F.coalesce(F.col("attrs")["content"], F.lit("")).alias("content"), "path"))


def harmony_raw(spark, sf) -> DataFrame:
    return trees.read_inspector_trees(inspector_json(spark, sf)).where("depth > 0")


ROLE = """CASE kind WHEN 'Text' THEN 'text' WHEN 'Button' THEN 'button' WHEN 'Toggle' THEN 'switch' WHEN 'TextInput' THEN 'input' WHEN 'ListItem' THEN 'listitem' ELSE CASE WHEN a11y THEN 'button' WHEN content <> '' THEN 'text' ELSE 'generic' END END"""


@query("p9_harmony_role", f"SELECT tree_id, node_id, {ROLE} AS role FROM {HARMONY}")
def p9(spark, sf):
    return harmony_raw(spark, sf).select("tree_id", "node_id", roles.harmony_role(F.col("kind"), F.col("attrs"))["role"].alias("role"))


@query("p13_harmony_name", f"SELECT tree_id, node_id, CASE WHEN kind = 'TextInput' THEN 'type here' ELSE content END AS name FROM {HARMONY}")
def p13(spark, sf):
    return harmony_raw(spark, sf).select("tree_id", "node_id", names.harmony_name(roles.harmony_role(F.col("kind"), F.col("attrs"))["role"], F.col("attrs")).alias("name"))


@query("p19_harmony_states", f"""SELECT tree_id, node_id, array_to_string(list_filter([CASE WHEN NOT enabled THEN 'disabled' END, CASE WHEN kind IN ('Button', 'Toggle', 'ListItem', 'Swiper') THEN 'clickable' WHEN a11y OR (focusable AND role NOT IN ('text', 'image', 'generic')) THEN 'clickable-inferred' END,
  CASE WHEN kind = 'Toggle' AND selected THEN 'checked' END, CASE WHEN kind = 'ListItem' AND selected THEN 'selected' END, CASE WHEN role <> 'input' THEN 'scrollable' END], lambda x: x IS NOT NULL), ' ') AS states FROM (SELECT *, {ROLE} AS role FROM {HARMONY})""")
def p19(spark, sf):
    n = harmony_raw(spark, sf).withColumn("role", roles.harmony_role(F.col("kind"), F.col("attrs"))["role"])
    return n.select("tree_id", "node_id", F.array_join(names.harmony_states(F.col("kind"), F.col("role"), F.col("attrs")), " ").alias("states"))


@query("t7_drop_blank", f"SELECT tree_id, node_id, kind FROM {HARMONY} WHERE NOT (kind = 'Blank' AND content = '') UNION ALL SELECT l_orderkey, 0, 'List' FROM order_ids")
def t7(spark, sf):
    return trees.drop_blank_placeholders(trees.read_inspector_trees(inspector_json(spark, sf))).select("tree_id", "node_id", "kind")


IOS = """(SELECT l_orderkey AS tree_id, seq AS node_id, ['UIButton', 'UILabel', 'UITableViewCell', 'UIView', 'UITextField', 'WKWebView', 'Other', 'UISwitch'][(l_partkey + seq) % 8 + 1] AS class_name, CASE WHEN l_partkey % 3 = 0 THEN l_returnflag ELSE '' END AS text,
  l_discount > 0.05 AS clickable, l_tax > 0.01 AS enabled, l_partkey % 2 = 0 AS scrollable, l_partkey % 7 = 0 AS gestures FROM lines)"""
IOS_ROLE = """CASE class_name WHEN 'UIButton' THEN 'button' WHEN 'UILabel' THEN CASE WHEN clickable THEN 'button' ELSE 'text' END WHEN 'UITableViewCell' THEN 'list' WHEN 'UIView' THEN CASE WHEN clickable THEN 'button' WHEN scrollable THEN 'scroll' ELSE 'generic' END
  WHEN 'UITextField' THEN 'input' WHEN 'WKWebView' THEN 'webview' WHEN 'UISwitch' THEN 'switch' ELSE CASE WHEN clickable THEN 'button' WHEN text <> '' THEN 'text' ELSE 'generic' END END"""


def ios_raw(spark, sf) -> DataFrame:
    names_ = F.array(*map(F.lit, ("UIButton", "UILabel", "UITableViewCell", "UIView", "UITextField", "WKWebView", "Other", "UISwitch")))
    rows = V.lines(spark, sf).select(
        F.col("l_orderkey").alias("tree_id"), F.col("seq").alias("node_id"), F.get(names_, ((F.col("l_partkey") + F.col("seq")) % 8).cast("int")).alias("class_name"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_returnflag")).otherwise("").alias("text"),
        (F.col("l_discount") > 0.05).alias("clickable"), (F.col("l_tax") > 0.01).alias("enabled"), (F.col("l_partkey") % 2 == 0).alias("scrollable"), (F.col("l_partkey") % 7 == 0).alias("gestures"), F.lit(False).alias("checked"), F.lit(False).alias("selected"),
    )
    # a class that none of the rules knows becomes a scroll view only if it is a container by its class
    return rows.withColumn("role", roles.ios_role(F.col("class_name"), F.col("text"), F.lit(""), F.col("clickable"), F.col("scrollable") & (F.col("class_name") == "UIView"))["role"])


@query("p8_ios_role", f"SELECT tree_id, node_id, {IOS_ROLE} AS role FROM {IOS}")
def p8(spark, sf):
    return ios_raw(spark, sf).select("tree_id", "node_id", "role")


@query("p13_ios_name", f"SELECT tree_id, node_id, CASE {IOS_ROLE} WHEN 'input' THEN 'fill in' WHEN 'text' THEN text ELSE coalesce(nullif(text, ''), 'id ' || node_id) END AS name FROM {IOS}")
def p13b(spark, sf):
    own = F.concat(F.lit("id "), F.col("node_id").cast("string"))
    return ios_raw(spark, sf).select("tree_id", "node_id", names.ios_name(F.col("role"), F.col("text"), F.lit(""), F.lit("fill in"), own).alias("name"))


@query("p20_ios_states", f"SELECT tree_id, node_id, array_to_string(list_filter([CASE WHEN NOT enabled THEN 'disabled' END, CASE WHEN scrollable THEN 'scrollable' END, CASE WHEN node_id % 3 = 0 THEN CASE WHEN clickable THEN 'clickable' WHEN gestures THEN 'clickable-inferred' ELSE 'clickable-guessed' END END], lambda x: x IS NOT NULL), ' ') AS states FROM {IOS}")
def p20(spark, sf):
    n = ios_raw(spark, sf).withColumn("role", F.when(F.col("node_id") % 3 == 0, "listitem").otherwise("button"))
    flags = {k: F.col(k) for k in ("enabled", "checked", "selected", "scrollable", "clickable", "gestures")}
    return n.select("tree_id", "node_id", F.array_join(names.ios_states(F.col("role"), flags), " ").alias("states"))


@query("s6_parse_snapshots", "SELECT tree_id, role, name, count(*) AS n FROM reffed GROUP BY ALL")
def s6(spark, sf):
    out = texts.parse_snapshots(tree.render_snapshot(V.native_with_refs(spark, sf)), ["tree_id"])
    return out.groupBy("tree_id", "role", "name").agg(F.count("*").alias("n"))


def annotations(spark, sf) -> DataFrame:
    """Orders as annotations: a target per line, with evidence for its role."""
    line = F.col("seq").cast("string")
    text = F.concat(
        F.lit("  - id: t"), line, F.lit("\n    type: information # a comment\n    description: \"line "), line, F.lit("\"\n    evidence:\n      - id: e"), line,
        F.lit("\n        capability: structural\n        role: "), F.when(F.col("l_partkey") % 5 == 0, "").otherwise("button"), F.lit("\n        minCount: "), F.when(F.col("l_partkey") % 7 == 0, "many").otherwise(F.floor("l_quantity").cast("string")),
        F.lit("\n      - id: f"), line, F.lit("\n        role: 'text'\n"),
    )
    rows = V.lines(spark, sf).select("l_orderkey", "seq", text.alias("part"))
    parts = F.sort_array(F.collect_list(F.struct("seq", "part")))
    return rows.groupBy(F.col("l_orderkey").alias("page")).agg(F.concat(F.lit("# page\npage: x\ntargets:\n"), F.array_join(F.transform(parts, lambda p: p["part"]), "")).alias("yaml"))


@query("s7_read_targets", """SELECT l_orderkey AS page, 't' || seq AS target_id, 'line ' || seq AS description, 'e' || seq AS evidence_id, 'structural' AS capability, 'button' AS role, CASE WHEN l_partkey % 7 = 0 THEN 0 ELSE CAST(floor(l_quantity) AS INT) END AS min_count FROM lines WHERE l_partkey % 5 <> 0
UNION ALL SELECT l_orderkey, 't' || seq, 'line ' || seq, 'f' || seq, '', 'text', 1 FROM lines""")
def s7(spark, sf):
    return texts.read_targets(annotations(spark, sf), ["page"])[1].select("page", "target_id", "description", "evidence_id", "capability", "role", "min_count")


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query("w1_write_captures", "SELECT CAST(conv_id AS VARCHAR) AS baseline_id, CAST(turn AS VARCHAR) AS run_id, role AS plugin, 'raw' AS stage, 'native_xml_' || conv_id || CASE WHEN turn % 2 = 0 THEN '.xml' ELSE '.txt' END AS file, length(text) AS chars FROM conversations")
def w1(spark, sf):
    """Written and read again."""
    c = V.table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("baseline_id"), F.col("turn").cast("string").alias("run_id"), F.col("role").alias("plugin"), F.lit("raw").alias("stage"), F.lit("native_xml").alias("source"), F.col("conv_id").alias("ts"), F.when(F.col("turn") % 2 == 0, "text/xml").otherwise("text/plain").alias("content_type"), F.col("text").alias("content"))
    root = _folder(spark)
    files.write_captures(c, root)
    return files.read_captures(spark, root).select("baseline_id", "run_id", "plugin", "stage", "file", F.length("content").alias("chars"))


@query("s1_scan_captures", """SELECT CAST(conv_id % 2 AS VARCHAR) AS baseline_id, 'r1' AS run_id, plugin, stage, 'application/json' AS content_type, 'PASS' AS schema_status, CAST(sum(10 + length(CAST(turn AS VARCHAR))) AS BIGINT) AS bytes
  FROM conversations, (VALUES ('native', 'raw'), ('native', 'transformed'), ('web', 'raw')) AS v(plugin, stage) GROUP BY ALL""")
def s1(spark, sf):
    """Turns written as files of a capture folder, one of them an evaluation, and found again."""
    root, turns = _folder(spark), V.table(spark, sf, "conversations").select("conv_id", "turn")
    for baseline in (0, 1):
        for place in ("native/raw", "native/transformed", "web/raw", "evaluation/raw"):
            turns.where(F.col("conv_id") % 2 == baseline).select("turn").write.json(f"{root}/captures/{baseline}/runs/r1/{place}")
    found = files.scan_captures(spark, root).where("bytes > 0")
    return found.groupBy("baseline_id", "run_id", "plugin", "stage", "content_type", "schema_status").agg(F.sum("bytes").alias("bytes"))


@query("s8_read_testsets", """SELECT CAST(l_orderkey AS VARCHAR) AS testset_id, CAST(seq - 1 AS INT) AS position, 'T' || seq AS target_id, ['电话图标', 'Search Icon', '加号', '邮件', ''][l_partkey % 5 + 1] AS expected, CASE WHEN seq % 2 = 0 THEN 'quill-pen' ELSE '' END AS acceptable,
  CASE WHEN seq % 3 > 0 THEN CAST(l_partkey % 1000 AS INT) END AS l, CASE WHEN seq % 3 > 0 THEN 60 END AS b FROM lines""")
def s8(spark, sf):
    """Test sets written as JSON, some targets without bounds, words or what is expected, and read again."""
    t = icon_targets(spark, sf).withColumn("expected", F.when(F.col("expected") != "mystery", F.col("expected")))
    box = F.when(F.col("position") % 3 > 0, F.array(*(F.col(f"bounds.{s}") for s in ("left", "top", "right", "bottom"))))
    target = F.struct("position", F.col("target_id").alias("id"), box.alias("bounds"), "expected", F.when(F.col("position") % 2 == 0, F.col("acceptable")).alias("acceptable"))
    root = _folder(spark)
    t.groupBy(F.col("testset_id").cast("string").alias("testset_id")).agg(F.sort_array(F.collect_list(target)).alias("targets")).write.json(root)
    back = files.read_testsets(spark, root, lines=True)
    return back.select("testset_id", "position", "target_id", "expected", F.array_join("acceptable", ",").alias("acceptable"), F.col("bounds.left").alias("l"), F.col("bounds.bottom").alias("b"))


@query("w3_write_experiment_runs", "SELECT 'run of ' || mode || '/' || run_id AS run_id, regexp_replace('run of ' || mode || '/' || run_id, '[^a-zA-Z0-9._-]', '_', 'g') AS file, inference_ms FROM runs")
def w3c(spark, sf):
    """Runs written with the names they go by, and read again."""
    runs = V.runs(spark, sf).select(F.concat(F.lit("run of "), "mode", F.lit("/"), "run_id").alias("runId"), F.when(F.col("inference_ms") >= 0, F.col("inference_ms")).alias("inferenceMs"))
    root = _folder(spark)
    files.write_experiment_runs(runs, root)
    return files.read_experiment_runs(spark, root).select(F.col("runId").alias("run_id"), "file", F.col("inferenceMs").alias("inference_ms"))


@query("st1_stream_evaluate", "SELECT CAST(baseline_id AS VARCHAR) AS baseline_id, CAST(run_id AS VARCHAR) AS run_id, target_id, passed, total, passed / total AS score, CASE WHEN passed = total THEN 'PASS' ELSE 'FAIL' END AS status FROM scored")
def st1(spark, sf):
    """Snapshots land as captures, in two parts of each run; each is scored when its files are there, the last time counts."""
    from screenloom.streaming.jobs import rocksdb, stream_evaluate_table

    folder = _folder(spark)
    shots = tree.render_snapshot(V.native_with_refs(spark, sf)).select((F.col("tree_id") % 3).cast("string").alias("baseline_id"), F.col("tree_id").cast("string").alias("run_id"), F.lit("web").alias("plugin"), F.lit("transformed").alias("stage"), F.lit("llm_input").alias("source"), F.col("tree_id").alias("ts"), F.lit("text/yaml").alias("content_type"), F.col("snapshot").alias("content"))
    shots = cut(shots)
    wanted = evidence(spark).withColumn("baseline_id", F.col("baseline_id").cast("string"))
    score = lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("append").parquet(f"{folder}/out")
    blank = F.instr("content", "\n  ")
    for part in (F.when(blank > 0, F.substring(F.col("content"), F.lit(1), blank - 1)).otherwise(F.col("content")), F.when(blank > 0, F.substring(F.col("content"), blank + 1, F.length("content"))).otherwise("")):
        files.write_captures(shots.withColumn("content", part).withColumn("ts", F.col("ts") * 2 + F.when(blank > 0, F.length(part) % 2).otherwise(0)), f"{folder}/captures")
        with rocksdb(spark):
            stream_evaluate_table(spark, f"{folder}/captures", f"{folder}/state", wanted, score).awaitTermination()
    out = spark.read.schema("baseline_id string, run_id string, target_id string, passed long, total long, score double, status string, batch int").parquet(f"{folder}/out")
    return out.groupBy("baseline_id", "run_id", "target_id").agg(*(F.max_by(c, "batch").alias(c) for c in ("passed", "total", "score", "status")))


@query("w2_write_evaluation", """SELECT run_id, baseline_id, count(*) AS targets, CAST(sum(passed) AS BIGINT) AS passed, CAST(sum(total) AS BIGINT) AS evidence, CASE WHEN bool_and(passed = total) THEN 'PASS' ELSE 'FAIL' END AS status FROM scored GROUP BY run_id, baseline_id""")
def w2(spark, sf):
    """Evaluations written as JSON and read again."""
    nodes = run_nodes(spark, sf).withColumn("schema_status", F.lit("PASS"))
    root = _folder(spark)
    files.write_evaluated(evaluate.evaluate_runs(nodes, evidence(spark), evidence(spark)), root)
    back = spark.read.schema("run_id long, baseline_id int, summary struct<status:string>, targetResults array<struct<passed:bigint,evidenceResults:array<struct<status:string>>>>").json(root)
    total = lambda f: F.aggregate("targetResults", F.lit(0).cast("long"), lambda n, t: n + f(t))
    return back.select("run_id", "baseline_id", F.size("targetResults").cast("long").alias("targets"), total(lambda t: t["passed"]).alias("passed"), total(lambda t: F.size(t["evidenceResults"]).cast("long")).alias("evidence"), F.col("summary.status").alias("status"))


SUMMARY = "artifact_count count_passed count_total target_passed target_total evidence_passed evidence_total".split()


def intents(spark) -> DataFrame:
    """The evidence as annotations, one text for each baseline, with a count target before it."""
    texts_of = {}
    for baseline, target, evidence_id, capability, role, name, least in sorted(EVIDENCE):
        of = texts_of.setdefault(str(baseline), {"": "page: screen  # of an order\ntargets:\n  - id: c1\n    role: listitem\n"})
        head = f"  - id: {target}\n    description: \"what {target} shows\"\n    evidence:\n"
        of[target] = of.get(target, head) + f"      - id: {evidence_id}\n        capability: {capability}\n        role: {role}\n        name: '{name}'\n        minCount: {least}\n"
    rows = ", ".join(f"('{b}', :yaml{b})" for b in texts_of)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(baseline_id, yaml)", args={f"yaml{b}": "".join(of.values()) for b, of in texts_of.items()})


@query("e2_capture_evaluation", """SELECT *, CASE WHEN count_passed = 1 AND target_passed = target_total AND evidence_passed = evidence_total THEN 'PASS' ELSE 'FAIL' END AS status FROM (
  SELECT CAST(s.baseline_id AS VARCHAR) AS baseline_id, CAST(s.run_id AS VARCHAR) AS run_id, CAST(1 AS BIGINT) AS artifact_count, c.n AS count_passed, CAST(1 AS BIGINT) AS count_total, count(*) FILTER (passed = total) AS target_passed, count(*) AS target_total,
    CAST(sum(passed) AS BIGINT) AS evidence_passed, CAST(sum(total) AS BIGINT) AS evidence_total
  FROM (SELECT baseline_id, run_id, target_id, count(*) FILTER (status = 'PASS') AS passed, count(*) AS total FROM judged WHERE role <> '' GROUP BY ALL) s
  JOIN (SELECT run_id, CAST(bool_or(role = 'listitem') AS BIGINT) AS n FROM run_nodes GROUP BY run_id) c ON c.run_id = s.run_id GROUP BY ALL)""")
def e2(spark, sf):
    """A capture's whole way: written, found, parsed, held against annotations, scored, summed up, written and read again."""
    keys, root = ["baseline_id", "run_id"], _folder(spark)
    shots = tree.render_snapshot(V.native_with_refs(spark, sf))
    captures = shots.select((F.col("tree_id") % 3).cast("string").alias("baseline_id"), F.col("tree_id").cast("string").alias("run_id"), F.lit("native").alias("plugin"), F.lit("transformed").alias("stage"), F.lit("native_semantic_snapshot").alias("source"), F.col("tree_id").alias("ts"), F.lit("text/yaml").alias("content_type"), F.col("snapshot").alias("content"))
    files.write_captures(captures, f"{root}/captures")
    # as a run's artifacts meet before they are parsed, all that follows stays where it is
    artifacts = dealt(files.read_captures(spark, f"{root}/captures"), *keys)
    counted, wanted = texts.read_targets(intents(spark), ["baseline_id"])
    files.write_evaluated(evaluate.evaluate_runs(texts.artifact_nodes(artifacts), counted, wanted), f"{root}/evaluation")
    back = spark.read.schema(f"baseline_id string, run_id string, summary struct<{','.join(f'{c}:bigint' for c in SUMMARY)},status:string>").json(f"{root}/evaluation")
    return back.select(*keys, *(f"summary.{c}" for c in SUMMARY), "summary.status")


@query("s9_read_experiment_runs", "SELECT run_id, CAST(floor(epoch(created)) AS BIGINT) * 1000 AS created_ms, mode, inference_ms, 1 AS batches FROM runs")
def s9(spark, sf):
    """Runs written as JSON and read again with their defaults."""
    root = _folder(spark)
    runs = V.runs(spark, sf)
    runs.select(F.col("run_id").alias("runId"), (F.unix_seconds(F.col("created").cast("timestamp")) * 1000).alias("createdAtMs"), F.col("mode").alias("inputMode"), F.when(F.col("inference_ms") >= 0, F.col("inference_ms")).alias("inferenceMs")).write.json(root)
    back = files.read_experiment_runs(spark, root)
    return back.select(F.col("runId").alias("run_id"), F.col("createdAtMs").alias("created_ms"), F.col("inputMode").alias("mode"), F.col("inferenceMs").alias("inference_ms"), F.col("batchCount").alias("batches"))


@query("w3_safe_file_name", "SELECT doc_id, coalesce(nullif(regexp_replace(trim(coalesce(text, '')), '[^a-zA-Z0-9._-]', '_', 'g'), ''), 'icon_experiment_run') AS file FROM documents")
def w3(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", files.safe_file_name(F.col("text")).alias("file"))


@query("w3_whole_file_name", "SELECT doc_id, CASE WHEN file = '' THEN 'icon_experiment_run' ELSE file END AS file FROM (SELECT doc_id, regexp_replace(trim(coalesce(text, '')), '[^a-zA-Z0-9._-]', '_', 'g') AS file FROM documents)")
def w3b(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", files.safe_file_name(F.col("text")).alias("file"))


SESSION_REFS = """SELECT s.session, r.ref, r.l, r.t, r.r, r.b FROM (SELECT o_custkey AS session, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS tree_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY o_custkey) s JOIN reffed r USING (tree_id) WHERE r.ref <> ''"""


@query("st2_ref_table", SESSION_REFS)
def st2(spark, sf):
    """Snapshots as a stream of files; the refs of each session's latest one."""
    from screenloom.streaming.jobs import REFS, rocksdb, stream_ref_table

    folder = _folder(spark)
    # of snapshots of the same time the one with the greater id is the later: its time is moved by the id's microseconds
    shots = V.snapshots(spark, sf).select("session", (F.col("ts") + F.expr("make_interval(0, 0, 0, 0, 0, 0, tree_id / 1000000)")).alias("ts"), "snapshot")
    shots.write.parquet(f"{folder}/in")
    half = -(-len(spark.read.parquet(f"{folder}/in").inputFiles()) // 2)  # two batches
    stream = spark.readStream.schema("session long, ts timestamp, snapshot string").option("maxFilesPerTrigger", max(1, half)).parquet(f"{folder}/in")
    with rocksdb(spark):
        run = stream_ref_table(stream).writeStream.outputMode("update").foreachBatch(lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("append").parquet(f"{folder}/out"))
        run.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(f"{REFS}, batch int").parquet(f"{folder}/out").groupBy("session").agg(F.max_by("refs", F.struct("ts", "batch")).alias("refs"))
    return out.select("session", F.explode("refs").alias("x")).select("session", "x.ref", *(F.col(f"x.{s}").alias(s[0]) for s in ("left", "top", "right", "bottom")))
