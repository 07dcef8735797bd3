"""Operators on small tables, and set formulas against plain recursive models."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from screenloom.functions import geometry, roles
from screenloom.operators import boxes, evaluate, icons, native, tree
from screenloom.sources import files, markup, texts, trees

NODE = "tree_id long, source string, node_id int, parent_id int, depth int, path array<int>, sibling_pos int, role string, role_source string, role_confidence double, name string, text string, content_desc string, resource_id string, class_name string, bounds struct<left:int,top:int,right:int,bottom:int>, states array<string>, web_idx int, ref string"


def table(spark, trees_):
    """Nested ``(role, name, states, children)`` to node rows."""
    rows = []

    def add(t, node, parent, path, pos):
        role, name, states, children = node
        me = sum(r[0] == t for r in rows)
        rows.append((t, "web", me, parent, len(path), path, pos, role, "", 1.0, name, "", "", "", "", (0, 0, 10, 10), states, me, ""))
        for k, child in enumerate(children):
            add(t, child, me, [*path, me], k)

    for t, root in enumerate(trees_):
        add(t, root, None, [], 0)
    return spark.createDataFrame(rows, NODE)


def nested(df):
    """Node rows back to nested ``(role, name, states, children)``, by tree."""
    rows = {}
    for r in df.collect():
        rows.setdefault(r["tree_id"], []).append(r)

    def build(of, node):
        kids = sorted((x for x in of if x["parent_id"] == node["node_id"]), key=lambda x: x["sibling_pos"])
        assert len(node["path"]) == node["depth"]
        return node["role"], node["name"], node["states"], [build(of, k) for k in kids]

    return {t: build(of, next(r for r in of if r["parent_id"] is None)) for t, of in rows.items()}


def some_tree(rng, depth=0):
    role = rng.choice(["generic", "generic", "text", "button", "list", "listitem"])
    name = rng.choice(["", "", "a", "b c"])
    states = rng.choice([[], [], ["clickable"], ["clickable=guessed"]])
    kids = [some_tree(rng, depth + 1) for _ in range(rng.randint(0, 3 if depth < 4 else 0))]
    return role, name, states, kids


def fold(node):
    role, name, states, kids = node
    kids = [fold(k) for k in kids]
    return kids[0] if role == "generic" and not name and not states and len(kids) == 1 else (role, name, states, kids)


def normalise(node):
    role, name, states, kids = node
    merged = []
    for k in map(normalise, kids):
        if k[0] == "text" and merged and merged[-1][0] == "text":
            merged[-1] = ("text", " ".join(x for x in (merged[-1][1], k[1]) if x), [], [])
        else:
            merged.append(k)
    if role == "generic" and not name and not states and len(merged) == 1:
        return merged[0]
    if len(merged) == 1 and merged[0][0] == "text" and name and merged[0][1] == name:
        merged = []
    return role, name, states, merged


def executable(node, path, out):
    role, _, states, kids = node
    out.append(any(executable_self(k) or below(k) for k in kids))
    for k in kids:
        executable(k, path, out)
    return out


def executable_self(node):
    return node[0] in ("button", "list") or (node[0] == "listitem" and any(s.startswith("clickable") for s in node[2]))


def below(node):
    return any(executable_self(k) or below(k) for k in node[3])


def test_fold_and_executable_on_random_trees(spark):
    rng = random.Random(5)
    made = [some_tree(rng) for _ in range(40)]
    df = table(spark, made).cache()
    assert nested(tree.fold_generic_native(df)) == {t: fold(n) for t, n in enumerate(made)}
    found = {(r["tree_id"], r["node_id"]) for r in tree.has_executable_descendant(df).collect()}
    assert found == {(t, k) for t, n in enumerate(made) for k, yes in enumerate(executable(n, [], [])) if yes}


def test_normalise_web(spark):
    t = lambda name: ("text", name, [], [])
    made = [
        ("screen", "", [], [t("a"), t("b"), ("button", "x", [], [t("x")]), t("c")]),
        ("screen", "", [], [("generic", "", [], [("generic", "", [], [("link", "l", [], [t("l")])])])]),
        ("screen", "", [], [("generic", "", [], []), ("button", "save now", [], [t("save"), t("now")])]),
        ("list", "", [], [("listitem", "q", ["clickable"], [t("q"), ("image", "", [], [])])]),
    ]
    assert nested(tree.normalize_web(table(spark, made))) == {k: normalise(n) for k, n in enumerate(made)}


def test_render_limits_and_escapes(spark):
    df = table(spark, [("screen", "", [], [("button", 'say "hi" \\', ["checked"], [("text", "t", [], [])])])])
    df = tree.assign_refs(df, "w", web_mode=True)
    full = tree.render_snapshot(df).first()["snapshot"]
    assert full == '- screen [ref=w1] [bounds=0,0,10,10]:\n  - button "say \\"hi\\" \\\\" [checked] [ref=w2] [bounds=0,0,10,10]:\n    - text "t" [ref=w3] [bounds=0,0,10,10]'
    assert tree.render_snapshot(df, max_depth=2).first()["snapshot"].endswith("[bounds=0,0,10,10]")
    back = [(r["role"], r["name"]) for r in texts.parse_snapshots(spark.createDataFrame([(1, full)], "k long, snapshot string"), ["k"]).orderBy("pos").collect()]
    assert back == [("screen", ""), ("button", 'say "hi" \\'), ("text", "t")]


def test_native_xml_errors_and_blanks(spark):
    df = spark.createDataFrame([(1, ""), (2, '<hierarchy><node class="a.Button" text="x &amp; &lt;y&gt;" bounds="[0,0][4,5]" enabled="false"><node class="T"/></node></hierarchy>')], "tree_id long, xml string")
    rows = markup.read_native_trees(df, max_depth=5).orderBy("node_id").collect()
    assert [(r["tree_id"], r["class_name"], r["parent_id"], r["enabled"]) for r in rows] == [(2, "a.Button", None, False), (2, "T", 0, True)]
    assert rows[0]["text"] == "x & <y>" and rows[0]["bounds"]["right"] == 4 and rows[1]["bounds"] is None
    with pytest.raises(Exception, match="malformed view hierarchy"):
        markup.read_native_trees(spark.createDataFrame([(1, "<node><node></node>")], "tree_id long, xml string"), max_depth=5).collect()


def test_html_roles_names_states(spark):
    html = """<html><body><header>top</header><form aria-label="f"><label for="u">User</label><input id="u" type="text" value="me" disabled>
      <input type="checkbox" checked><input type="hidden" value="z"><fieldset disabled><button>Go <b>now</b></button></fieldset></form>
      <img alt=""><img alt="cat"><a href="#">x</a><a>y</a><section><header>in</header></section><div role="presentation none"><p>one<p>two</div>
      <div style="display:none"><a href="#">gone</a></div><div style="visibility: hidden"><h2 aria-level="3">kept</h2></div><details open><summary>more</summary></details></body></html>"""
    rows = markup.html_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"), max_depth=10).orderBy("node_id").collect()
    seen = [(r["class_name"], r["role"], r["name"], r["states"]) for r in rows if r["class_name"] not in ("#text", "html", "body", "div")]
    assert ("input", "textbox", "User", ["disabled", "clickable", "value=me"]) in seen
    assert any(s[0] == "input" and s[1] == "checkbox" and "checked" in s[3] for s in seen)
    # a disabled fieldset without a legend disables nothing
    assert ("button", "button", "Go now", ["clickable"]) in seen
    assert ("img", "image", "cat", []) in seen and sum(s[0] == "img" for s in seen) == 1
    assert [s[1] for s in seen if s[0] == "a"] == ["link"]
    assert [s[1] for s in seen if s[0] == "header"] == ["toolbar", "generic"]
    assert not any(s[0] == "p" for s in seen)  # what has no role goes with all that is below it
    assert ("h2", "heading", "kept", ["level=3"]) in seen and not any(s[2] == "gone" for s in seen)
    assert any(s[0] == "details" and s[1] == "group" for s in seen)


def outline_of(spark, html):
    """Tags and texts of a page, indented by depth."""
    rows = markup.read_html_pages(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("node_id").collect()
    assert all(r["last"] >= r["node_id"] and all(rows[p]["last"] >= r["last"] for p in r["path"]) for r in rows)
    return [" " * r["depth"] + (r["text"] if r["tag"] == "#text" else f"<{r['tag']}>") for r in rows]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<ul><li>a<li>b<ul><li>c</ul></ul>x", ["<ul>", " <li>", "  a", " <li>", "  b", "  <ul>", "   <li>", "    c", "x"]),
        ("<table><tr><td>1<td>2<tr><th>h</table>x", ["<table>", " <tbody>", "  <tr>", "   <td>", "    1", "   <td>", "    2", "  <tr>", "   <th>", "    h", "x"]),
        ("<table><thead><tr><td>1<tbody><tr><td><table><tr><td>in</table>out</table>", ["<table>", " <thead>", "  <tr>", "   <td>", "    1", " <tbody>", "  <tr>", "   <td>", "    <table>", "     <tbody>", "      <tr>", "       <td>", "        in", "    out"]),
        ("<dl><dt>a<dd>b<dt>c</dl>", ["<dl>", " <dt>", "  a", " <dd>", "  b", " <dt>", "  c"]),
        ("<div>a</span></p>b</x>c</div>d", ["<div>", " a", " <p>", " bc", "d"]),
        ("<p>a<span>b<div>c</div>d", ["<p>", " a", " <span>", "  b", "<div>", " c", "d"]),
        ("<h1>a<h2>b</h1>c", ["<h1>", " a", "<h2>", " b", "c"]),
        ("<head><title>t</title><p>body", ["<p>", " body"]),
        ("<div/>in<svg><path/><title>t</title></svg>", ["<div>", " in", " <svg>", "  <path>"]),
        ("<body><p>a</body></html>b<body class=x><html>c", ["<body>", " <p>", "  abc"]),
        ("<select><optgroup><option>a<option>b<optgroup><option>c</select>d", ["<select>", " <optgroup>", "  <option>", "   a", "  <option>", "   b", " <optgroup>", "  <option>", "   c", "d"]),
        ("<iframe><p>x</p></iframe>y", ["<iframe>", "y"]),
        ("<textarea><b>&lt;</textarea><!-- <p> --><!--><p>x<script>a</p></script>y", ["<textarea>", " <b><", "<p>", " x", " y"]),
        ("<a>one<a>two<button>b<button>c", ["<a>", " one", "<a>", " two", " <button>", "  b", " <button>", "  c"]),
        ("a<!-- open <p>b", ["a"]),
    ],
)
def test_tags_are_placed_as_a_parser_does(spark, html, want):
    assert outline_of(spark, html) == want


def test_hostile_pages_take_linear_time(spark):
    import time

    for text in ("<!--", "<script>", "<script", "<textarea>", "<title", "<p><button><div><x>", "<li>a", "<select><option>", "</p>", "<label><table><td>", "<i '"):
        took = []
        for n in (2_000, 16_000):
            df = spark.createDataFrame([(1, text * n)], "page_id long, html string")
            begin = time.monotonic()
            markup.html_nodes(df).write.format("noop").mode("overwrite").save()
            took.append(time.monotonic() - begin)
        assert took[1] < 3 + 9 * took[0], text


def test_names_labels_and_hidden_parts(spark):
    html = """<p id="d">Told <i>so</i></p><div hidden><span id="h">hidden words</span><em>leaks</em></div><input aria-labelledby="d h none" title="t"><label for="q">For q</label><input id="q">
      <button aria-hidden="true">seen<span>x</span></button><figure><figcaption>Cap</figcaption></figure><details><summary>Sum</summary>more</details><table role="grid"><tr><td>c</table>
      <div aria-disabled="true"><button>off</button></div><select multiple><option selected value="1">a<option selected>b</select><input type="range" min="10" max="20"><button>A<span hidden>B</span></button>"""
    rows = markup.html_nodes(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("node_id").collect()
    seen = [(r["class_name"], r["role"], r["name"], r["states"]) for r in rows]
    assert ("input", "textbox", "Told so hidden words", ["clickable"]) in seen and ("input", "textbox", "For q", ["clickable"]) in seen
    assert ("button", "button", "seen x", ["clickable"]) in seen and ("#text", "text", "leaks", []) in seen and not any(s[0] == "em" for s in seen)
    assert ("figure", "generic", "Cap", []) in seen and ("details", "group", "Sum", []) in seen and ("td", "gridcell", "c", []) in seen
    assert ("button", "button", "off", ["disabled", "clickable"]) in seen and [s[3] for s in seen if s[0] == "option"] == [["selected", "value=1"], ["selected", "value=b"]]
    assert ("input", "slider", "", ["clickable", "value=15"]) in seen and ("button", "button", "A B", ["clickable"]) in seen


def test_normaliser_cases(spark):
    """The cases that the reference tests, one tree each: (tree, what is left of it)."""
    text = lambda name: ("text", name, [], [])
    button = lambda name, *kids: ("button", name, [], list(kids))
    generic = lambda name, *kids: ("generic", name, [], list(kids))
    cases = [
        (generic("", button("Click")), button("Click")), (generic(""), generic("")), (generic("container", text("hello")), generic("container", text("hello"))), (generic("", text("a"), text("b")), text("a b")),
        (generic("", button("A"), button("B")), generic("", button("A"), button("B"))), (generic("container", text("Hello"), text("World")), generic("container", text("Hello World"))),
        (generic("c", text("Hello"), button("Click"), text("World")), generic("c", text("Hello"), button("Click"), text("World"))), (button("Submit", text("Submit")), button("Submit")),
        (button("Submit", text("Submit form")), button("Submit", text("Submit form"))), (generic("", generic("", text("a")), text("b")), text("a b")), (generic("x", text("")), generic("x", text(""))), (button("", text("")), button("", text(""))),
    ]
    df = table(spark, [made for made, _ in cases])
    assert nested(tree.normalize_web(df)) == {t: want for t, (_, want) in enumerate(cases)}
    with_ref = table(spark, [generic("", text("hello"))]).withColumn("ref", F.when(F.col("role") == "generic", "w1").otherwise(""))
    assert [(r["role"], r["ref"]) for r in tree.normalize_web(with_ref).orderBy("node_id").collect()] == [("generic", "w1"), ("text", "")]
    assert tree.normalize_web(df.where("false")).count() == 0


def test_one_pass_normaliser_on_random_trees(spark):
    rng = random.Random(11)
    made = [some_tree(rng) for _ in range(60)]
    df = table(spark, made).cache()
    got = tree.normalize_web(df)
    assert nested(got) == {t: normalise(n) for t, n in enumerate(made)}
    assert exchanges(tree.normalize_web(df.select("*")))[0] <= 1


def test_a_page_of_200_000_nodes(spark):
    html = "<div>" + "<section aria-hidden='true'><p>x</p></section>" * 50_000 + "</div>"
    nodes = markup.html_nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert nodes.count() == 100_001


def test_deep_trees_are_whole(spark):
    """Pages down to level 50 as in the reference; view hierarchies and JSON trees without a limit."""
    html = spark.createDataFrame([(1, "<div>" * 49 + "<p>deep</p><h1>low</h1>" + "</div>" * 49), (2, "<div>" * 52 + "x" + "</div>" * 52)], "page_id long, html string")
    rows = markup.read_html_pages(html).orderBy("tree_id", "node_id").collect()
    assert [len(r["path"]) for r in rows] == [*range(50), 50, 49, 50, *range(51)] and rows[50]["text"] == "deep" and rows[51]["sibling_pos"] == 1
    names = {r["class_name"]: r["name"] for r in markup.html_nodes(html).where("tree_id = 1").collect()}
    assert names["p"] == "deep" and names["h1"] == "low"
    xml = "<node>" * 120 + '<node text="a"/><node text="b"/>' + "</node>" * 120
    rows = markup.read_native_trees(spark.createDataFrame([(1, xml)], "tree_id long, xml string")).orderBy("node_id").collect()
    assert [r["path"] for r in rows] == [list(range(k)) for k in range(121)] + [list(range(120))] and [r["sibling_pos"] for r in rows[-2:]] == [0, 1]
    web, dump = '{"role":"text","name":"end"}', '{"$type":"Text","$attrs":{"content":"end"}}'
    for _ in range(119):
        web, dump = f'{{"role":"generic","children":[{web}]}}', f'{{"$type":"Column","$children":[{dump}]}}'
    for read, json in ((trees.read_web_trees, f'{{"root":{web}}}'), (trees.read_inspector_trees, dump)):
        rows = read(spark.createDataFrame([(1, json)], "tree_id long, json string")).orderBy("node_id").collect()
        assert [r["path"] for r in rows] == [list(range(k)) for k in range(120)]


LONG = 1_000_000


def test_long_tags_names_and_texts(spark):
    """Nothing recurses on a text: a million characters of each kind are read like any other."""
    pages = {
        1: f"<p>{'z' * LONG}</p>", 2: f'<p title="{"t" * LONG}">a</p>', 3: f"<p {'z ' * (LONG // 2)}>b</p>", 4: "a < b and c > d" + "<" * LONG, 5: "<b" * (LONG // 2), 6: "<p>x" * 1000 + "<i>'" * 1000,
    }
    rows = markup.read_html_pages(spark.createDataFrame(list(pages.items()), "page_id long, html string")).where("tree_id < 6").collect()
    of = {k: [r for r in rows if r["tree_id"] == k] for k in pages}
    assert [r["text"] for r in of[1] if r["tag"] == "#text"] == ["z" * LONG] and len(of[2][0]["attrs"]["title"]) == LONG and of[3][1]["text"] == "b"
    assert of[4][0]["text"] == "a < b and c > d" + "<" * LONG and of[5][0]["text"] == "<b" * (LONG // 2)
    assert markup.html_nodes(spark.createDataFrame(list(pages.items()), "page_id long, html string")).count() > 1000
    xml = [(1, f'<node text="{"x" * LONG}" {"y" * LONG}="1"><node class="a.Text"/></node>')]
    rows = markup.read_native_trees(spark.createDataFrame(xml, "tree_id long, xml string")).orderBy("node_id").collect()
    assert len(rows[0]["text"]) == LONG and rows[1]["class_name"] == "a.Text"
    for bad in ('<node a="1"', "<node>" * 3 + "</node>" * 2, "</node><node>", '<node a="<b"/>'):
        with pytest.raises(Exception, match="malformed view hierarchy"):
            markup.read_native_trees(spark.createDataFrame([(1, bad)], "tree_id long, xml string")).collect()
    name = 'q"\\' * (LONG // 3)
    shot = '- button "' + name.replace("\\", "\\\\").replace('"', '\\"') + '" [checked]'
    assert texts.parse_snapshots(spark.createDataFrame([(1, shot)], "k long, snapshot string"), ["k"]).first()["name"] == name


def test_trees_of_500_levels_and_of_many_children(spark):
    for n in (60, 500):
        xml = "<node>" * n + "</node>" * n
        assert [len(r["path"]) for r in markup.read_native_trees(spark.createDataFrame([(1, xml)], "tree_id long, xml string")).orderBy("node_id").collect()] == list(range(n))
    wide = "<node>" + '<node class="a.TextView" text="t"/>' * 20_000 + "</node>"
    nodes = native.semantic_nodes(markup.read_native_trees(spark.createDataFrame([(1, wide)], "tree_id long, xml string")))
    snapshot = tree.render_snapshot(tree.assign_refs(tree.number_preorder(nodes))).first()["snapshot"]
    assert snapshot.count("\n") == 20_000


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange "), plan.count("FileScan ")


@pytest.mark.parametrize("name", ["t3_fold_generic", "t9_assign_refs", "t11_render_snapshot", "j1_match_evidence", "a2_score_targets"])
def test_one_scan_and_few_exchanges(spark, sf, name):
    from screenloom.plans import native_queries  # noqa: F401
    from screenloom.plans.registry import QUERIES

    shuffles, scans = exchanges(QUERIES[name](spark, sf))
    assert scans == 1 and shuffles <= 3


def test_pages_are_read_without_a_shuffle(spark, sf):
    from screenloom.plans import views as V

    assert exchanges(markup.read_html_pages(V.table(spark, sf, "pages"))) == (0, 1)
    assert exchanges(markup.html_nodes(V.table(spark, sf, "pages")))[0] <= 2


def test_file_names_of_whole_texts(spark, tmp_path, sf):
    from screenloom.plans import page_queries
    from screenloom.plans import views as V

    rows = [(1, "a" * 30 + "/x"), (2, "a" * 30 + "/y"), (3, " " * 20 + "late"), (4, "  "), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r["file"] for r in page_queries.w3b(spark, str(tmp_path)).collect()}
    assert found == {1: "a" * 30 + "_x", 2: "a" * 30 + "_y", 3: "late", 4: "icon_experiment_run", 5: "icon_experiment_run"}
    runs = V.runs(spark, sf).select(F.concat(F.lit("run of the experiment/"), "run_id").alias("runId"), F.col("mode").alias("inputMode"))
    files.write_experiment_runs(runs.coalesce(1), str(tmp_path / "runs"))
    read = files.read_experiment_runs(spark, str(tmp_path / "runs"))
    back, names = read.select("runId", "inputMode"), {r["file"] for r in read.select("file").collect()}
    assert runs.exceptAll(back).count() == 0 and back.exceptAll(runs).count() == 0
    assert names == {f"run_of_the_experiment_{r['run_id']}" for r in V.runs(spark, sf).collect()}


def test_web_and_inspector_json(spark):
    web = '{"url":"u","root":{"role":"main","name":"m","children":[{"role":"link","name":"a","bounds":[1,2,3,4],"__pr_idx":7},{"role":"odd","bounds":[1],"children":[{"role":"text"}]}]}}'
    df = spark.createDataFrame([(1, web), (2, "{}")], "tree_id long, json string")
    rows = trees.read_web_trees(df).orderBy("tree_id", "node_id").collect()
    assert [(r["role"], r["parent_id"], r["web_idx"], r["bounds"] is None) for r in rows] == [("generic", None, -1, True), ("link", 0, 7, False), ("generic", 0, -1, True), ("text", 2, -1, True)]
    with pytest.raises(Exception, match="(?i)malformed|json"):
        trees.read_web_trees(spark.createDataFrame([(1, "{")], "tree_id long, json string")).collect()
    assert trees.read_inspector_trees(spark.createDataFrame([(1, "{")], "tree_id long, json string")).count() == 0


def test_json_trees_are_read_in_one_map(spark):
    roles_ = "table row cell columnheader article complementary blockquote caption group term definition separator meter option status paragraph rowgroup button link".split()
    node = lambda role, **more: {"role": role, "name": "n", "states": [], "bounds": [0, 0, 9, 9], "children": []} | more
    made = [json.dumps({"url": "u", "root": node("screen", children=[node(r) for r in [*roles_, "unknownrole"]])}), "", None, json.dumps({"root": node("button", states=["disabled", "expanded"], bounds=[10, 20, 110, 70])}), json.dumps({"root": node("text", children={"a": 1}, name="1.50é\n")})]
    df = spark.createDataFrame(list(enumerate(made)), "tree_id int, json string")
    nodes = trees.read_web_trees(df)
    assert exchanges(nodes)[0] == 0 and exchanges(trees.read_inspector_trees(df))[0] == 0
    rows = nodes.orderBy("tree_id", "node_id").collect()
    assert [r["role"] for r in rows if r["tree_id"] == 0] == ["screen", *roles_, "generic"] and {r["tree_id"] for r in rows} == {0, 3, 4}
    assert rows[-2]["states"] == ["disabled", "expanded"] and rows[-2]["bounds"]["bottom"] == 70 and rows[-1]["name"] == "1.50é\n"
    deep = '{"role":"generic","children":[' * 600 + '{"role":"text"}' + "]}" * 600
    assert trees.read_web_trees(spark.createDataFrame([(1, f'{{"root":{deep}}}')], "tree_id int, json string")).agg(F.max("depth")).first()[0] == 600


EVIDENCE_SCHEMA = "baseline_id string, target_id string, evidence_id string, capability string, role string, name string, min_count int"


def test_runs_without_nodes_fail(spark, tmp_path):
    """A blank snapshot is a run that finds nothing: zero and FAIL, in a batch, as a stream of files, and later with nodes."""
    from screenloom.streaming.jobs import rocksdb, stream_evaluate_table

    wanted = spark.createDataFrame([("m", "t", "e1", "c", "button", "", 1), ("m", "t", "e2", "c", "", "x", 2), ("m", "t", "e3", "c", "text", "x", 1)], EVIDENCE_SCHEMA)
    nodes = spark.createDataFrame([("m", "r1", "button", "a"), ("m", "r1", "text", "x"), ("m", "r1", "list", "x"), ("m", "r1", "list", "other")], "baseline_id string, run_id string, role string, name string")
    runs = spark.createDataFrame([("m", "r1"), ("m", "blank"), ("m", "blank")], "baseline_id string, run_id string")
    found = {(r["run_id"], r["evidence_id"]): r["actual_count"] for r in evaluate.match_evidence(nodes, wanted, runs).collect()}
    assert found == {("r1", "e1"): 1, ("r1", "e2"): 2, ("r1", "e3"): 1, ("blank", "e1"): 0, ("blank", "e2"): 0, ("blank", "e3"): 0}
    shots = lambda rows: spark.createDataFrame([("m", run, "web", "transformed", "llm_input", ts, "text/yaml", text) for run, ts, text in rows], "baseline_id string, run_id string, plugin string, stage string, source string, ts long, content_type string, content string")
    got, progress = [], []
    for part in ([("r1", 1, '- button "a"\n- text "x"'), ("blank", 2, "# nothing")], [("blank", 3, '- button\n- list "x"\n- text "x"')]):
        files.write_captures(shots(part), str(tmp_path / "c"))
        with rocksdb(spark):
            run = stream_evaluate_table(spark, str(tmp_path / "c"), str(tmp_path / "state"), wanted, lambda df, k: got.append({r["run_id"]: (r["passed"], r["status"]) for r in df.collect()}))
            run.awaitTermination()
            progress.append(sum(p["numInputRows"] for p in run.recentProgress))
    assert [g for g in got if g] == [{"r1": (2, "FAIL"), "blank": (0, "FAIL")}, {"blank": (3, "PASS")}]
    assert progress == [2, 1]  # a batch reads the rows that landed, not what a run had before


def test_a_hot_baseline_is_written_by_many_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        name = F.when(F.col("id") < 18_000, "hot").otherwise(F.concat(F.lit("b"), F.col("id") % 5))
        rows = spark.range(20_000).select(name.alias("baseline_id"), (F.col("id") % 100).cast("string").alias("run_id"), F.lit("native").alias("plugin"), F.lit("raw").alias("stage"), F.lit("x").alias("source"), F.col("id").alias("ts"), F.lit("text/xml").alias("content_type"), F.sha2(F.col("id").cast("string"), 512).alias("content"))
        files.write_captures(rows, str(tmp_path / "c"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    sizes = {p.name: [f.stat().st_size for f in p.glob("*.parquet")] for p in (tmp_path / "c").glob("baseline_id=*")}
    assert len(sizes) == 6 and all(len(s) == 1 for name, s in sizes.items() if "hot" not in name)
    hot = sizes["baseline_id=hot"]
    assert len(hot) >= 2 and max(hot) < 1.5e6 and files.read_captures(spark, str(tmp_path / "c")).count() == 20_000


def test_refs_as_of_a_time(spark):
    """An action meets the newest capture before it, and no ref of an older one; held against a plain scan, with hot sessions."""
    from screenloom.operators import actions

    rng = random.Random(4)
    shots, acts = [], []
    for k in range(120):
        session = rng.choice([1, 1, 1, 2, 3])
        refs = rng.sample(range(1, 6), rng.randint(0, 3))
        shots.append((session, k, rng.randint(0, 40_000), "\n".join(f"- button [ref=n{r}] [bounds={r},{k},{r + 10},{k + 4}]" for r in refs)))
    for k in range(300):
        acts.append((rng.choice([1, 1, 1, 2, 3, 4]), k, f"n{rng.randint(1, 5)}", rng.choice([s[2] for s in shots] + [rng.randint(0, 50_000)])))
    at = lambda df: df.withColumn("ts", F.timestamp_seconds("ts"))
    df = actions.resolve_refs_at(at(spark.createDataFrame(acts, "session int, action_id int, ref string, ts long")), at(spark.createDataFrame(shots, "session int, capture_id int, ts long, snapshot string")), slice_seconds=3000)
    got = {r["action_id"]: (r["capture_id"], r["x"], r["y"]) for r in df.collect()}
    want = {}
    for session, k, ref, ts in acts:
        before = max(((s[2], s[1]) for s in shots if s[0] == session and s[2] <= ts), default=None)
        text = next(s[3] for s in shots if s[1] == before[1]) if before else ""
        line = next((x for x in text.split("\n") if f"[ref={ref}]" in x), None)
        box = list(map(int, line.split("bounds=")[1][:-1].split(","))) if line else None
        want[k] = (before[1] if before else None, *((int((box[0] + box[2]) / 2 + 0.5), int((box[1] + box[3]) / 2 + 0.5)) if box else (None, None)))
    assert got == want and len(got) == 300


def test_geometry(spark):
    df = spark.createDataFrame([("[-3,0][4,-5]",), ("x[1,2][3,4]",), (None,)], "s string").select(geometry.box_geometry(geometry.parse_bounds(F.col("s"))).alias("g"))
    rows = [r["g"] for r in df.collect()]
    assert (rows[0]["width"], rows[0]["center_x"], rows[0]["center_y"], rows[0]["valid"]) == (7, 0, -2, False)
    assert rows[1]["width"] is None and rows[2]["valid"] is False


def test_roles_cascade(spark):
    cases = {"BottomSheetDialog": "dialog", "AutoCompleteTextView": "text", "ImageButton": "button", "NestedScrollView": "scroll", "": "generic"}
    df = spark.createDataFrame([(f"a.b.{c}" if c else "",) for c in cases], "c string")
    no = F.lit(False)
    got = [r["role"] for r in df.select(roles.android_role(F.col("c"), F.lit(""), F.lit(""), no, no, no, no).alias("d")).select("d.role").collect()]
    assert got == list(cases.values())


def test_nms_like_the_greedy_scan(spark):
    rng = random.Random(3)
    rows = [(i, k, rng.randint(1, 9), float(x := rng.randint(0, 60)), float(y := rng.randint(0, 60)), x + 20.0, y + 20.0) for i in range(4) for k in range(30)]
    got = {(r["image"], r["seq"]) for r in boxes.nms(spark.createDataFrame(rows, "image int, seq int, score int, x1 double, y1 double, x2 double, y2 double"), 0.3, 12).collect()}

    def overlap(a, b):
        w, h = max(0, min(a[5], b[5]) - max(a[3], b[3])), max(0, min(a[6], b[6]) - max(a[4], b[4]))
        return w * h / (800 - w * h + 1e-6)

    want = set()
    for i in range(4):
        kept = []
        for r in sorted((r for r in rows if r[0] == i), key=lambda r: (-r[2], r[1])):
            if len(kept) < 12 and all(overlap(r, k) <= 0.3 for k in kept):
                kept.append(r)
        want |= {(i, r[1]) for r in kept}
    assert got == want


def test_nms_of_a_long_chain_and_huge_boxes(spark):
    schema = "image int, seq int, score int, x1 double, y1 double, x2 double, y2 double"
    chain = [(1, k, 5000 - k, 6.0 * k, 0.0, 6.0 * k + 10, 10.0) for k in range(1000)]
    kept = sorted(r["seq"] for r in boxes.nms(spark.createDataFrame(chain, schema), 0.2, 1000).collect())
    assert kept == list(range(0, 1000, 2))
    sized = [(1, 0, 0.0, 0.0, 1e7, 1e7), (1, 1, 0.0, 0.0, 0.9e7, 1e7), (1, 2, 5.0, 5.0, 25.0, 25.0), (1, 3, 8.0, 5.0, 28.0, 25.0), (1, 4, -3000.0, -10.0, 20.0, 30.0), (1, 5, -2900.0, -10.0, 20.0, 30.0), (2, 6, 0.0, 0.0, 5.0, 5.0), (1, 7, 0.0, 0.0, 1500.0, 1400.0), (1, 8, 100.0, 0.0, 1000.0, 900.0)]
    df = spark.createDataFrame(sized, "image int, id int, x1 double, y1 double, x2 double, y2 double")
    for least in (0.05, 0.3, 0.6):
        want = set()
        for a in sized:
            for b in sized:
                w, h = max(0, min(a[4], b[4]) - max(a[2], b[2])), max(0, min(a[5], b[5]) - max(a[3], b[3]))
                area = lambda r: (r[4] - r[2]) * (r[5] - r[3])
                if a[0] == b[0] and w * h / (area(a) + area(b) - w * h + 1e-6) > least:
                    want.add((a[1], b[1]))
        rows = boxes.box_iou_pairs(df, df, least).collect()
        assert {(r["a"], r["b"]) for r in rows} == want and len(rows) == len(want)


def test_targets_yaml(spark):
    yaml = "page: p\ntargets:\n  - id: a\n    role: button # c\n    minCount: x\n  - id: b\n    type: information\n    evidence:\n      - id: e1\n        role: text\n        name: \"q\"\n      - id: e2\n      - id: e3\n        role: list\n        minCount:\nother: z\n"
    counts, evidence = texts.read_targets(spark.createDataFrame([(1, yaml)], "k int, yaml string"), ["k"])
    assert [(r["target_id"], r["role"], r["min_count"]) for r in counts.collect()] == [("a", "button", 0)]
    assert [(r["target_id"], r["evidence_id"], r["name"], r["min_count"]) for r in evidence.collect()] == [("b", "e1", "q", 1)]


def test_model_output_and_prompts(spark):
    runs = spark.createDataFrame([(1, "```text\nt1: a phone\nbroken\n：x\n2：电话\n```"), (2, "  ")], "run long, raw_text string")
    assert [(r["id"], r["desc"]) for r in icons.parse_model_output(runs, ["run"]).orderBy("position").collect()] == [("t1", "a phone"), ("2", "电话")]
    with pytest.raises(ValueError, match="input mode"):
        icons.build_prompts(runs, "CROPPED_MULTI_IMAGE")


def test_prompts_say_what_each_mode_needs(spark):
    """Sentences that the reference's own tests ask for, and what must not be told to the model."""
    made = [(1, 0, "1", (922, 161, 1034, 273)), (1, 1, "2", (1062, 161, 1174, 273)), (1, 2, "3", (5, 5, 5, 9))]
    targets = spark.createDataFrame(made, "testset_id int, position int, label string, bounds struct<left:int,top:int,right:int,bottom:int>")
    always = ["Write every description in Simplified Chinese", "Use a very short label of 1 to 4 Chinese characters only", "Do not write sentences, explanations, modifiers", "<id>:<short Chinese label>"]
    boxes_ = ["1=922,161,1034,273\n2=1062,161,1174,273\n", "Coordinates are pixel coordinates in the original screenshot", "The origin (0,0) is the top-left corner", "x increases from left to right. y increases from top to bottom", "Process the target regions one by one in the exact order listed below"]
    says = {
        "FULL_IMAGE": ["1\n2\n3\n", "Return exactly 3 lines"], "FULL_IMAGE_WITH_BOUNDS": [*boxes_, "Valid x range is 0 to 1174. Valid y range is 0 to 273.", "Return exactly 2 lines"], "FULL_IMAGE_WITH_BOUNDS_BATCHED": boxes_,
        "FULL_IMAGE_WITH_MARKED_BOUNDS": ["visible blue rectangles and id labels", "Use the visible rectangle and label in the image", "1\n2\n3\n"], "CROPPED_MONTAGE": ["montage image made from cropped mobile app icon regions", "Each crop has a visible id label above it.", "1\n2\n3\n"],
    }
    for mode, sentences in says.items():
        prompt = icons.build_prompts(targets, mode).first()["prompt"]
        assert all(x in prompt for x in [*always, *sentences]), mode
        assert ("922,161" in prompt) == ("BOUNDS" in mode and "MARKED" not in mode) and "{" not in prompt
    sized = icons.build_prompts(targets, "FULL_IMAGE_WITH_BOUNDS", spark.createDataFrame([(1, 1216, 2640)], "testset_id int, width int, height int")).first()["prompt"]
    assert "The screenshot size is 1216 pixels wide and 2640 pixels high." in sized and "Valid x range is 0 to 1216. Valid y range is 0 to 2640." in sized


def test_vision_model_errors_stay_with_their_row(spark):
    def model(image, prompt):
        if image == "bad":
            raise RuntimeError("no")
        return prompt.upper(), ""

    df = spark.createDataFrame([(1, "ok", "a"), (2, "bad", "b")], "request_id long, image string, prompt string")
    assert [(r["raw_text"], r["error"]) for r in icons.apply_vision_model(df, model).orderBy("request_id").collect()] == [("A", ""), ("", "RuntimeError")]


def test_captures_on_disk_and_stream(spark, tmp_path):
    from screenloom.streaming.jobs import rocksdb, stream_evaluate

    root = tmp_path / "captures"
    for base, run, text in (("m", "r1", '- screen:\n  - button "a"'), ("m", "r2", "- text")):
        for stage, file, body in (("transformed", f"native_semantic_snapshot_{run}.yml", text), ("raw", "native_xml_1.xml", "<node/>")):
            p = root / base / "runs" / run / "native" / stage
            p.mkdir(parents=True, exist_ok=True)
            (p / file).write_text(body)
    scanned = files.scan_captures(spark, str(tmp_path)).collect()
    assert sorted((r["run_id"], r["type"]) for r in scanned) == [("r1", "llm_input"), ("r1", "raw_xml"), ("r2", "llm_input"), ("r2", "raw_xml")]
    evidence = spark.createDataFrame([("m", "t", "e", "c", "button", "", 1)], "baseline_id string, target_id string, evidence_id string, capability string, role string, name string, min_count int")
    got = []
    with rocksdb(spark):
        stream_evaluate(spark, str(tmp_path), str(tmp_path / "state"), evidence, lambda df, k: got.extend(df.collect())).awaitTermination()
    nodes = texts.parse_snapshots(files.scan_captures(spark, str(tmp_path)).where("type = 'llm_input'"), ["baseline_id", "run_id"], "content")
    batch = evaluate.score_targets(evaluate.evaluate_counts(evaluate.match_evidence(nodes, evidence))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch)) and {r["run_id"]: r["status"] for r in got} == {"r1": "PASS", "r2": "FAIL"}


def test_files_of_evaluations_and_experiments(spark, tmp_path):
    (tmp_path / "set.json").write_text('{"testset_id": "s", "image": "i.png", "targets": [{"id": "1", "bounds": [0, 0, 5, 6], "expected": "x", "acceptable": ["y"]}, {"id": "2"}]}')
    sets = files.read_testsets(spark, str(tmp_path / "set.json")).orderBy("position").collect()
    assert [(r["target_id"], r["bounds"] is None) for r in sets] == [("1", False), ("2", True)]
    runs = spark.createDataFrame([("a b", 5), ("c", 9)], "runId string, createdAtMs long")
    files.write_experiment_runs(runs, str(tmp_path / "runs"))
    back = files.read_experiment_runs(spark, str(tmp_path / "runs")).collect()
    assert [(r["runId"], r["inferenceMs"]) for r in back] == [("c", -1), ("a b", -1)]
    nodes = spark.createDataFrame([("m", "r", "button", "x")], "baseline_id string, run_id string, role string, name string")
    evidence = spark.createDataFrame([("m", "t", "e", "c", "button", "", 1)], "baseline_id string, target_id string, evidence_id string, capability string, role string, name string, min_count int")
    results = evaluate.evaluate_counts(evaluate.match_evidence(nodes, evidence))
    targets = evaluate.score_targets(results)
    summary = evaluate.summarize_run(nodes.withColumn("schema_status", F.lit("PASS")), results, targets)
    files.write_evaluation(results, targets, results, summary, str(tmp_path / "out"))
    row = spark.read.json(str(tmp_path / "out")).first()
    assert row["summary"]["status"] == "PASS" and row["targetResults"][0]["evidenceResults"][0]["actual_count"] == 1


def test_captures_are_a_data_source(spark, tmp_path):
    """In batch, in partitions of a size, and as a stream that takes each file once."""
    from screenloom.sources import captures

    captures.register(spark)
    read = lambda: spark.read.format("captures").option("partitionBytes", "30").load(str(tmp_path))
    assert read().count() == 0

    def put(run, name, text):
        p = tmp_path / "captures" / "m" / "runs" / run / "native" / "raw"
        p.mkdir(parents=True, exist_ok=True)
        (p / name).write_text(text)

    for k in range(5):
        put("r1", f"native_xml_{k}.xml", f"<node{k}/>é")
    put("r1", "_SUCCESS", "")
    (tmp_path / "captures" / "stray.txt").write_text("not a capture")
    rows = read().orderBy("file").collect()
    assert [(r["baseline_id"], r["run_id"], r["plugin"], r["stage"], r["file"], r["content"], r["bytes"]) for r in rows] == [("m", "r1", "native", "raw", f"native_xml_{k}.xml", f"<node{k}/>é", 10) for k in range(5)]
    assert read().rdd.getNumPartitions() == 2
    assert [r["type"] for r in spark.createDataFrame(rows).transform(evaluate.artifact_columns).collect()] == ["raw_xml"] * 5

    def taken():
        out = str(tmp_path / "out")
        stream = spark.readStream.format("captures").load(str(tmp_path))
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start()
        run.processAllAvailable()
        run.stop()
        return sorted(r["file"] for r in spark.read.parquet(out).collect())

    assert taken() == [f"native_xml_{k}.xml" for k in range(5)]
    put("r2", "native_xml_9.xml", "<node/>")
    assert taken() == [f"native_xml_{k}.xml" for k in (0, 1, 2, 3, 4, 9)]


def test_tags_of_views_have_their_first_values(spark):
    xml = '<hierarchy><node\n text="a &quot;b&quot; &amp;lt;" text="second" desc="" content-desc="c" clickable="TRUE" enabled="" overrides-onTouchEvent="true" bounds="[1,2][3,4]"><node enabled="false"/></node></hierarchy>'
    rows = markup.read_native_trees(spark.createDataFrame([(1, xml)], "tree_id long, xml string")).orderBy("node_id").collect()
    assert rows[0]["text"] == 'a "b" &lt;' and rows[0]["content_desc"] == "c" and rows[0]["clickable"] and rows[0]["enabled"] and rows[0]["touch_override"] and not rows[0]["checked"]
    assert rows[0]["bounds"]["right"] == 3 and not rows[1]["enabled"] and rows[1]["class_name"] == "" and rows[1]["bounds"] is None


def test_register_source(spark):
    files.register_source("mine", lambda df: table(spark, [("screen", "", [], [])]))
    assert files.read_source("mine", None).count() == 1
    files.register_source("poor", lambda df: df)
    with pytest.raises(ValueError, match="lacks"):
        files.read_source("poor", spark.range(1))


def test_visible_subtrees(spark):
    df = table(spark, [("screen", "", [], [("list", "", [], [("text", "", [], [])]), ("text", "", [], [])])])
    left = native.filter_visible(df.withColumn("visible", F.col("role") != "list"))
    assert [r["role"] for r in left.orderBy("node_id").collect()] == ["screen", "text"]


def test_states_are_aggregates_of_spark(spark, tmp_path):
    """No call of Python a run or session; evidence that is given twice counts twice; late and simultaneous snapshots."""
    from screenloom.streaming.jobs import rocksdb, stream_evaluate_table, stream_ref_table

    wanted = spark.createDataFrame([("m", "t", "e", None, "button", "", 1)] * 2 + [("m", "t", "f", "c", "", "x", 2), ("n", "t", "e", "c", "", "", 1)], EVIDENCE_SCHEMA)
    shots = spark.createDataFrame([("m", f"r{k}", "web", "transformed", "llm_input", k, "text/yaml", '- button "x":\n  - text "x"') for k in range(3)], "baseline_id string, run_id string, plugin string, stage string, source string, ts long, content_type string, content string")
    files.write_captures(shots, str(tmp_path / "c"))
    got = []
    with rocksdb(spark):
        run = stream_evaluate_table(spark, str(tmp_path / "c"), str(tmp_path / "s1"), wanted, lambda df, k: got.extend((r["run_id"], r["passed"], r["total"]) for r in df.collect()))
        run.awaitTermination()
    assert sorted(got) == [("r0", 3, 3), ("r1", 3, 3), ("r2", 3, 3)]
    assert run.lastProgress["stateOperators"][0]["operatorName"] == "stateStoreSave"
    line = lambda k: f'- button "a b" [ref=n{k}] [bounds=1,2,3,{k}]'
    seen = []
    for part in ([(1, 5, line(1)), (2, 5, None)], [(1, 4, line(2)), (2, 5, f"{line(3)}\n- text\n{line(4)}")]):
        spark.createDataFrame(part, "session long, ts long, snapshot string").select("session", F.timestamp_seconds("ts").alias("ts"), "snapshot").write.mode("append").parquet(str(tmp_path / "in"))
        with rocksdb(spark):
            stream = stream_ref_table(spark.readStream.schema("session long, ts timestamp, snapshot string").parquet(str(tmp_path / "in")))
            sink = lambda df, k: seen.append({r["session"]: [tuple(x) for x in r["refs"]] for r in df.collect()})
            run = stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "s2")).trigger(availableNow=True).start()
            run.awaitTermination()
    assert [s for s in seen if s] == [{1: [("n1", 1, 2, 3, 1)], 2: []}, {1: [("n1", 1, 2, 3, 1)], 2: [("n3", 1, 2, 3, 3), ("n4", 1, 2, 3, 4)]}]
    assert run.lastProgress["stateOperators"][0]["operatorName"] == "stateStoreSave"


def test_files_of_screens_are_bounded(spark, sf, monkeypatch):
    from pathlib import Path

    from screenloom.plans import native_queries
    from screenloom.plans.registry import QUERIES

    monkeypatch.setattr(native_queries, "SCREENS_A_FILE", 100)
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(root.rglob("part-*.txt"))
    assert QUERIES["f2_register_source"](spark, sf).count() > 0
    sizes = [p.read_text().count("\n") for p in set(root.rglob("part-*.txt")) - before]
    assert sum(sizes) == spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").distinct().count() and max(sizes) <= 100


def test_partitions_follow_the_input_and_cuts_are_worked_out_once(spark, sf):
    from screenloom.cut import cut, dealt

    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    assert dealt(lines, "l_orderkey", each=10_000).rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
    assert dealt(lines, "l_orderkey").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(k):
        seen.add(1)
        return k

    kept = cut(spark.range(100).select(counted("id").alias("id")))
    assert seen.value == 100 and kept.agg(F.sum("id")).first()[0] == 4950 and seen.value == 100


def test_partitions_follow_the_rows_of_a_small_file(spark, tmp_path):
    from screenloom.cut import dealt

    spark.range(200_000).select((F.col("id") * 0).alias("same"), F.lit("x").alias("text")).write.parquet(f"{tmp_path}/same")
    same = spark.read.parquet(f"{tmp_path}/same")
    assert dealt(same, "same", rows=1000).rdd.getNumPartitions() == 200


def test_class_is_decided_once_a_node(spark):
    from screenloom.operators import native

    no, empty = F.lit(False), F.lit("")
    raw = spark.createDataFrame([("a.b.MyListView",), ("RadioButton",), ("CardViewDialog",), ("Nothing",), (None,), ("x.DecorView",)], "class_name string")
    raw = raw.select("*", *(empty.alias(c) for c in ("text", "content_desc")), *(no.alias(c) for c in ("clickable", "long_clickable", "touch_override", "scrollable", "editable")))
    found = native.with_roles(raw)
    assert [r[0] for r in found.select("decision.source").collect()] == ["class:list", "class:radio", "class:card", "generic-fallback", "generic-fallback", "class:root"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("substring_index") == 1, plan


def test_evaluations_keep_evidence_with_its_target(spark, tmp_path):
    from screenloom.cut import dealt
    from screenloom.sources import files

    keys = ["baseline_id", "run_id"]
    rows = [(0, 1, "a", "e1", "c", "button", "", 1, 2, "PASS"), (0, 1, "a", "e2", "c", "list", "", 1, 0, "FAIL"), (0, 1, "b", "e3", "c", "list", "", 1, 1, "PASS"), (1, 2, None, "e4", "c", "list", "", 1, 1, "PASS")]
    found = spark.createDataFrame(rows, "baseline_id int, run_id long, target_id string, evidence_id string, capability string, role string, name string, min_count int, actual_count long, status string")
    found.write.parquet(f"{tmp_path}/found")
    results = dealt(spark.read.parquet(f"{tmp_path}/found"), *keys)
    targets = evaluate.score_targets(results)
    summary = results.select(*keys).distinct().withColumn("status", F.lit("PASS"))
    files.write_evaluation(results, targets, results, summary, f"{tmp_path}/out")
    back = {(r.baseline_id, r.run_id): r for r in spark.read.json(f"{tmp_path}/out").collect()}
    first = back[0, 1].targetResults
    assert [(t.target_id, t.passed, [e.evidence_id for e in t.evidenceResults]) for t in first] == [("a", 1, ["e1", "e2"]), ("b", 1, ["e3"])]
    assert [(t.target_id, t.passed, t.evidenceResults) for t in back[1, 2].targetResults] == [(None, 1, None)]


def test_coverage_works_its_results_out_once(spark, sf):
    from screenloom.plans import native_queries  # noqa: F401
    from screenloom.plans.registry import QUERIES

    # one scan of the lines, and nothing written in between (before: two scans of what was written)
    plan = QUERIES["a4_capability_coverage"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan ") == 1 and "lineitem" in plan and "cut-" not in plan
    results = spark.createDataFrame([("a", 1, "PASS"), ("a", 2, "FAIL"), ("", 1, "PASS"), (None, None, "PASS"), (None, None, "FAIL")], "capability string, baseline_id int, status string")
    found = sorted(map(tuple, evaluate.capability_coverage(results).collect()), key=str)
    assert found == sorted([("a", 1, 1, 1), ("a", 2, 0, 1), ("a", None, 1, 2), ("default", 1, 1, 1), ("default", None, 1, 2), ("default", None, 2, 3)], key=str)


@pytest.mark.parametrize("name", """t1_number_preorder t12_fuse t9_assign_refs s6_parse_snapshots a1_evaluate_counts j1_match_evidence a4_capability_coverage
a2_score_targets j5_extract_ref_bounds t14_role_histogram t8_has_executable_descendant t3_fold_generic""".split())  # fmt: skip
def test_screens_are_dealt_once_by_their_lines(spark, sf, name):
    from screenloom.plans import native_queries, page_queries  # noqa: F401
    from screenloom.plans.registry import QUERIES

    # lines are shuffled once, into a number of partitions of their own that AQE leaves alone
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1 and plan.count("REPARTITION_BY_NUM") == 1


def test_evaluations_in_one_pass_are_those_of_the_operators(spark, tmp_path):
    """Runs without nodes, baselines without evidence, evidence twice or without target, artifacts that fail or hold nothing."""
    keys = ["baseline_id", "run_id"]
    snap = '- screen:\n  - button "go"\n  - button "stop"\n  - list "go":\n    - listitem\n  - button "go"'
    shots = [("m", "r1", "llm_input", "PASS", snap), ("m", "r1", "llm_input", "PASS", '- text "x"'), ("m", "r2", "llm_input", "PASS", ""), ("m", "r3", "raw_xml", "PASS", snap), ("m", "r4", "llm_input", "FAIL", snap), ("m", "r4", "llm_input", "PASS", snap), ("n", "r1", "llm_input", "PASS", snap), ("o", "r1", "llm_input", "PASS", snap)]
    artifacts = spark.createDataFrame(shots, "baseline_id string, run_id string, type string, schema_status string, content string")
    pieces = [("m", "t", "e2", "c", "button", "go", 2), ("m", "t", "e1", None, "", "go", 3), ("m", "t", "e1", None, "", "go", 3), ("m", "a", "e", "", "", "", 6), ("m", None, "e", "", "list", "", 1), ("m", "t", None, "", "list", "stop", 1), ("o", "t", "e", "", "button", "", None)]
    wanted = spark.createDataFrame(pieces, EVIDENCE_SCHEMA)
    counted = spark.createDataFrame([("m", "c2", "button", "stop", 1), ("m", "c1", "listitem", "", 2), ("n", "c", "", "go", 1)], "baseline_id string, target_id string, role string, name string, min_count int")

    nodes = texts.parse_snapshots(artifacts.where("type = 'llm_input' AND schema_status = 'PASS'"), keys, "content")
    runs = artifacts.select(*keys).distinct()
    counts, results = (evaluate.evaluate_counts(evaluate.match_evidence(nodes, asked, runs)) for asked in (counted, wanted))
    targets = evaluate.score_targets(results)
    files.write_evaluation(counts, targets, results, evaluate.summarize_run(artifacts, counts, targets), f"{tmp_path}/apart")
    files.write_evaluated(evaluate.evaluate_runs(texts.artifact_nodes(artifacts), counted, wanted), f"{tmp_path}/once")
    apart, once = (sorted((tuple(r) for r in spark.read.text(f"{tmp_path}/{d}").select("baseline_id", "value").collect())) for d in ("apart", "once"))
    assert len(once) == 6 and once == apart and any('"score":' in text and '"status":"PASS"' in text for _, text in once)


@pytest.mark.parametrize("name", ["w2_write_evaluation", "e2_capture_evaluation"])
def test_evaluations_write_only_what_they_are_asked_to(spark, sf, name):
    """Nothing is settled in between, and what is written is compressed (before: two or three tables, and JSON in plain text)."""
    from pathlib import Path

    from screenloom.plans import page_queries  # noqa: F401
    from screenloom.plans.registry import QUERIES

    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(root.rglob("*"))
    assert QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").distinct().count()
    new = set(root.rglob("*")) - before
    assert not [p for p in new if p.name.startswith("cut-")]
    assert {"".join(p.suffixes[-2:]) for p in new if p.name.startswith("part-")} == {".json.gz"} | ({".snappy.parquet"} if name.startswith("e2") else set())


def test_runs_are_evaluated_where_their_nodes_are(spark, sf):
    """Runs of dealt screens aren't shuffled again: what is asked is broadcast."""
    from screenloom.plans.native_queries import evidence, run_nodes

    told = evaluate.evaluate_runs(run_nodes(spark, sf).withColumn("schema_status", F.lit("PASS")), evidence(spark), evidence(spark))
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1 and "Exchange hashpartitioning(run_id" not in plan and "run_id#" not in "".join(x for x in plan.splitlines() if "Exchange hash" in x), plan


def test_brief_views_are_read_as_whole_ones(spark):
    """What is left out is what a reader takes for missing; quotes and references stay apart from what separates texts."""
    from screenloom.schema import BOUNDS, RAW_FLAGS

    rows = [(1, 0, None, 0, []), (1, 1, 0, 1, [0]), (1, 2, 1, 2, [0, 1]), (1, 3, 0, 1, [0]), (2, 0, None, 0, [])]
    texts_ = ["", 'a "b" &quot; c', "&amp;lt; <x>\n&", '"', ""]
    raw = [(*r, f"c.{k}" if k else "", texts_[k], texts_[-1 - k], texts_[k - 2], texts_[k - 1], (k, -1, 3, 4) if k % 2 else None, *((k + n) % 3 == 0 for n in range(len(RAW_FLAGS)))) for k, r in enumerate(rows)]
    schema = f"tree_id long, node_id int, parent_id int, depth int, path array<int>, class_name string, resource_id string, text string, content_desc string, hint string, bounds {BOUNDS}, {', '.join(f'{c} boolean' for c in RAW_FLAGS)}"
    df = spark.createDataFrame(raw, schema)
    whole, brief = markup.native_xml(df), markup.native_xml(df, brief=True)
    size = lambda x: x.agg(F.sum(F.length("xml"))).first()[0]
    assert size(brief) < 0.6 * size(whole) and brief.where("tree_id = 2").first()["xml"].count("<node") == 1
    given = sorted(map(str, df.collect()))
    for printed in (whole, brief):
        for partitions in (None, 3):
            back = markup.read_native_trees(printed, partitions=partitions)
            assert sorted(map(str, back.select(*df.columns).collect())) == given


def test_a_source_of_screens_is_written_briefly_and_read_in_place(spark, sf):
    """Some 100 bytes of XML a node (before: 415), and nodes that aren't shuffled once their tree was."""
    from pathlib import Path

    from screenloom.plans import native_queries  # noqa: F401
    from screenloom.plans.registry import QUERIES

    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(root.rglob("part-*.txt"))
    found = QUERIES["f2_register_source"](spark, sf)
    assert sum(p.stat().st_size for p in set(root.rglob("part-*.txt")) - before) < 150 * found.count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "REPARTITION_BY_NUM" in plan, plan
