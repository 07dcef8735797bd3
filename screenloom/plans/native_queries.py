"""Queries over native trees, evaluation, boxes, icons and actions."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from screenloom.cut import cut
from screenloom.functions import geometry, text
from screenloom.operators import actions, boxes, evaluate, icons, native, tree
from screenloom.plans import views as V
from screenloom.plans.registry import query


def flat(df: DataFrame) -> DataFrame:
    """Rectangles as four columns, states as one text: shapes that any engine can compare."""
    out = df
    if "bounds" in df.columns:
        out = out.select("*", *(F.col(f"bounds.{s}").alias(n) for s, n in zip(geometry.SIDES, "ltrb", strict=True))).drop("bounds")
    if "states" in out.columns:
        out = out.withColumn("states", F.array_join("states", " "))
    return out.drop("path")


@query("p1_normalize_text", "SELECT doc_id, coalesce(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), '') AS normal FROM documents")
def p1(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normal"))


BOX_TEXT = "CASE WHEN node_id % 5 = 4 THEN 'none' ELSE '[' || l || ',' || (t - 500) || '][' || r || ',' || b || ']' END"


@query("p2_parse_bounds", f"""SELECT tree_id, node_id, width, height, CASE WHEN sx < 0 THEN -((-sx) // 2) ELSE sx // 2 END AS center_x,
  CASE WHEN sy < 0 THEN -((-sy) // 2) ELSE sy // 2 END AS center_y, coalesce(width > 0 AND height > 0, false) AS valid FROM (
  SELECT tree_id, node_id, CAST(m[3] AS INT) - CAST(m[1] AS INT) AS width, CAST(m[4] AS INT) - CAST(m[2] AS INT) AS height, CAST(m[1] AS INT) + CAST(m[3] AS INT) AS sx, CAST(m[2] AS INT) + CAST(m[4] AS INT) AS sy
  FROM (SELECT tree_id, node_id, regexp_extract_all({BOX_TEXT}, '-?[0-9]+') AS m FROM screen))""")  # fmt: skip
def p2(spark, sf):
    b = F.col("bounds")
    raw = V.screen_nodes(spark, sf).select("tree_id", "node_id", F.when(F.col("node_id") % 5 == 4, "none").otherwise(F.format_string("[%d,%d][%d,%d]", b["left"], b["top"] - 500, b["right"], b["bottom"])).alias("said"))
    return raw.select("tree_id", "node_id", geometry.box_geometry(geometry.parse_bounds(F.col("said"))).alias("g")).select("tree_id", "node_id", "g.*")


@query("p3_parse_rect_float", """SELECT l_orderkey AS tree_id, seq, CAST(floor(l_quantity / 4 - 6 + 0.5) AS INT) AS l, CAST(floor(l_quantity / 8 + 0.5) AS INT) AS t,
  CAST(floor(l_quantity / 2 + 0.5) AS INT) AS r, CAST(floor(l_quantity + 0.5) AS INT) AS b FROM lines""")
def p3(spark, sf):
    q = F.col("l_quantity")
    said = F.format_string("rect [%.3f, %.3f],[%.3f, %.3f]", q / 4 - 6, q / 8, q / 2, q)
    return flat(V.lines(spark, sf).select(F.col("l_orderkey").alias("tree_id"), "seq", geometry.parse_rect_float(said).alias("bounds")))


@query("p4_core_attributes", "SELECT tree_id, node_id, parent_id, sibling_pos AS index, class_name, resource_id, text, l, t, r, b FROM screen")
def p4(spark, sf):
    return flat(native.select_core_attributes(V.screen_nodes(spark, sf)))


@query("p5_filter_visible", "SELECT tree_id, node_id, l, t, r, b FROM screen WHERE r > l AND b > t AND NOT (node_id > 1 AND tree_id % 7 = 0) AND NOT (node_id = 1 AND tree_id % 7 = 0)")
def p5(spark, sf):
    raw = V.screen_nodes(spark, sf).withColumn("visible", ~((F.col("node_id") == 1) & (F.col("tree_id") % 7 == 0)))
    return flat(native.filter_visible(raw).select("tree_id", "node_id", "bounds"))


@query("p7_android_role", "SELECT tree_id, node_id, role, role_source, role_confidence FROM decided")
def p7(spark, sf):
    return native.with_roles(V.screen_nodes(spark, sf)).select("tree_id", "node_id", F.col("decision.role").alias("role"), F.col("decision.source").alias("role_source"), F.col("decision.confidence").alias("role_confidence"))


@query("p11_map_role", "SELECT conv_id, turn, CASE WHEN r IN ('text', 'list', 'option', 'status') THEN r ELSE 'generic' END AS role FROM (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'text' WHEN turn = 1 THEN 'list' WHEN turn = 2 THEN 'option' WHEN turn = 3 THEN 'status' ELSE role END AS r FROM conversations)")
def p11(spark, sf):
    from screenloom.functions.roles import map_role

    wire = F.coalesce(F.get(F.array(*map(F.lit, ("text", "list", "option", "status"))), F.col("turn").cast("int")), "role")
    return V.table(spark, sf, "conversations").select("conv_id", "turn", map_role(wire).alias("role"))


@query("p12_android_name", "SELECT tree_id, node_id, name FROM named")
def p12(spark, sf):
    return native.semantic_nodes(V.screen_nodes(spark, sf).drop("quantity"), fold=False).select("tree_id", "node_id", "name")


@query("p15_readable_resource_name", "SELECT tree_id, node_id, own FROM named")
def p15(spark, sf):
    return V.screen_nodes(spark, sf).select("tree_id", "node_id", text.readable_resource_name(F.col("resource_id")).alias("own"))


@query("p16_native_states", "SELECT tree_id, node_id, array_to_string(states, ' ') AS states FROM stated")
def p16(spark, sf):
    return flat(native.semantic_nodes(V.screen_nodes(spark, sf).drop("quantity"), fold=False).select("tree_id", "node_id", "states"))


@query("p17_click_tier", "SELECT tree_id, tier, count(*) AS n FROM named WHERE tier IS NOT NULL GROUP BY ALL")
def p17(spark, sf):
    nodes = native.semantic_nodes(V.screen_nodes(spark, sf).drop("quantity"), fold=False).select("tree_id", F.explode("states").alias("tier"))
    return nodes.where(F.startswith("tier", F.lit("clickable"))).groupBy("tree_id", "tier").agg(F.count("*").alias("n"))


@query("p18_needs_visual_desc", "SELECT tree_id, node_id FROM stated WHERE list_contains(states, 'needs_visual_desc')")
def p18(spark, sf):
    return native.semantic_nodes(V.screen_nodes(spark, sf).drop("quantity"), fold=False).where(F.array_contains("states", "needs_visual_desc")).select("tree_id", "node_id")


@query("p22_artifact_type", """SELECT event_id, plugin || '.' || type AS artifact_id, type, content_type, CASE WHEN content_type <> '' AND bytes > 0 THEN 'PASS' ELSE 'FAIL' END AS schema_status FROM (
  SELECT event_id, plugin, bytes, CASE event_id % 6 WHEN 0 THEN 'text/xml' WHEN 1 THEN 'text/yaml' WHEN 2 THEN 'text/yaml' WHEN 3 THEN 'application/json' WHEN 4 THEN 'text/html' ELSE '' END AS content_type,
  CASE event_id % 6 WHEN 0 THEN CASE WHEN plugin = 'native' THEN 'raw_xml' ELSE 'xml' END WHEN 1 THEN CASE WHEN plugin = 'native' THEN 'llm_input' ELSE 'yaml' END WHEN 2 THEN 'llm_input' WHEN 3 THEN 'json' WHEN 4 THEN 'html' ELSE 'a-b-' || event_id END AS type
  FROM (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'native' ELSE 'web' END AS plugin, event_id % 5 AS bytes FROM events))""")
def p22(spark, sf):
    k = (F.col("event_id") % 6).cast("int")
    file = F.concat(F.get(F.array(*map(F.lit, ("native_xml_", "native_semantic_snapshot_", "llm_input_", "c_", "d_", "a_b_"))), k), F.col("event_id").cast("string"), F.get(F.array(*map(F.lit, (".xml", ".yml", ".yaml", ".json", ".html", ".bin"))), k))
    files = V.table(spark, sf, "events").select("event_id", F.when(F.col("user_id") % 2 == 0, "native").otherwise("web").alias("plugin"), F.when(k == 0, "raw").otherwise("transformed").alias("stage"), file.alias("file"), (F.col("event_id") % 5).alias("bytes"))
    return evaluate.artifact_columns(files).select("event_id", "artifact_id", "type", "content_type", "schema_status")


@query("p23_screen_coverage", "SELECT l_orderkey AS tree_id, seq, l_quantity * l_quantity / 2000 > 0.5 AS is_web FROM lines")
def p23(spark, sf):
    q = F.col("l_quantity")
    return V.lines(spark, sf).select(F.col("l_orderkey").alias("tree_id"), "seq", boxes.screen_area_coverage(q * q / 2000).alias("is_web"))


@query("t1_number_preorder", "SELECT tree_id, CAST(row_number() OVER (PARTITION BY tree_id ORDER BY node_id) - 1 AS INT) AS node_id, CASE WHEN node_id > 0 THEN node_id // 1 END IS NULL AS is_root, class_name FROM folded")
def t1(spark, sf):
    out = tree.number_preorder(V.native_nodes(spark, sf))
    return out.select("tree_id", "node_id", (F.col("parent_id").isNull() & (F.col("node_id") == 0)).alias("is_root"), "class_name")


@query("t2_promote_collection_items", "SELECT tree_id, node_id, role, role_source, role_confidence FROM promoted WHERE role = 'listitem'")
def t2(spark, sf):
    return native.semantic_nodes(V.screen_nodes(spark, sf).drop("quantity"), fold=False).where("role = 'listitem'").select("tree_id", "node_id", "role", "role_source", "role_confidence")


@query("t3_fold_generic", "SELECT tree_id, node_id, parent_id, CAST(depth AS INT) AS depth, role, name FROM folded")
def t3(spark, sf):
    return V.native_nodes(spark, sf).select("tree_id", "node_id", "parent_id", "depth", "role", "name")


@query("t4_reattach", "SELECT tree_id, node_id, CASE WHEN node_id > 1 THEN 0 END AS parent_id, CAST(CASE WHEN node_id > 1 THEN 1 ELSE 0 END AS INT) AS depth, CAST(CASE WHEN node_id > 1 THEN sibling_pos ELSE 0 END AS INT) AS sibling_pos FROM screen WHERE node_id <> 1")
def t4(spark, sf):
    return tree.reattach(V.screen_nodes(spark, sf), F.col("node_id") == 1).select("tree_id", "node_id", "parent_id", "depth", "sibling_pos")


@query("t5_merge_adjacent_text", """SELECT conv_id, run, min(turn) AS first_turn, string_agg(text, ' ' ORDER BY turn) AS name FROM (
  SELECT *, sum(CASE WHEN is_text AND was_text THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (
    SELECT conv_id, turn, text, role <> 'system' AND turn % 3 < 2 AS is_text, coalesce(lag(role <> 'system' AND turn % 3 < 2) OVER (PARTITION BY conv_id ORDER BY turn), false) AS was_text FROM conversations))
  GROUP BY conv_id, run""")
def t5(spark, sf):
    """Turns as siblings: those that count as text and stand in a row become one."""
    merged = tree.merge_adjacent_text(conversation_tree(spark, sf)).where("depth = 1")
    run = F.row_number().over(W.partitionBy("tree_id").orderBy("sibling_pos")).cast("long")
    return merged.select(F.col("tree_id").alias("conv_id"), run.alias("run"), (F.col("web_idx")).cast("long").alias("first_turn"), "name")


def conversation_tree(spark, sf) -> DataFrame:
    """A web tree per conversation: a screen with a child for each turn."""
    said = V.table(spark, sf, "conversations")
    k = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    ints = lambda *v: F.array(*v).cast("array<int>")
    empty = F.array().cast("array<string>")
    whole = F.struct(*(F.lit(v).alias(s) for s, v in zip(geometry.SIDES, (0, 0, 800, 600), strict=True)))
    is_text = (F.col("role") != "system") & (F.col("turn") % 3 < 2)

    def rows(of: DataFrame, **given: object) -> DataFrame:
        base = {"tree_id": F.col("conv_id"), "source": F.lit("web"), "node_id": F.lit(0), "parent_id": F.lit(None).cast("int"), "depth": F.lit(0), "path": ints(), "sibling_pos": F.lit(0), "role": F.lit("screen"), "role_source": F.lit("web"), "role_confidence": F.lit(1.0), "name": F.lit(""), "text": F.lit(""), "content_desc": F.lit(""), "resource_id": F.lit(""), "class_name": F.lit(""), "bounds": whole, "states": empty, "web_idx": F.lit(-1), "ref": F.lit("")}
        return of.select(*(v.alias(n) for n, v in (base | given).items()))

    turns = said.withColumn("k", k.cast("int"))
    children = rows(turns, node_id=F.col("k"), parent_id=F.lit(0), depth=F.lit(1), path=ints(F.lit(0)), sibling_pos=F.col("k") - 1, role=F.when(is_text, "text").otherwise("generic"), name=F.col("text"), web_idx=F.col("turn").cast("int"), bounds=F.when(F.col("turn") % 2 == 0, F.struct(*(F.lit(v).alias(s) for s, v in zip(geometry.SIDES, (1, 2, 3, 4), strict=True)))))
    return rows(said.select("conv_id").distinct()).unionByName(children)


@query("t8_has_executable_descendant", "SELECT DISTINCT tree_id, node_id FROM acting")
def t8(spark, sf):
    return tree.has_executable_descendant(V.native_nodes(spark, sf))


@query("t9_assign_refs", "SELECT tree_id, node_id, role, ref FROM reffed")
def t9(spark, sf):
    return V.native_with_refs(spark, sf).select("tree_id", "node_id", "role", "ref")


@query("t10_mark_webviews", "SELECT tree_id, node_id, role, array_to_string(list_concat(states, CASE WHEN node_id = 1 AND tree_id % 3 = 1 THEN ['web'] ELSE CAST([] AS VARCHAR[]) END), ' ') AS states FROM (SELECT * REPLACE (CASE WHEN tree_id % 3 = 1 AND node_id IN (1, 3) THEN 'webview' ELSE role END AS role) FROM stated)")
def t10(spark, sf):
    nodes = native.semantic_nodes(V.screen_nodes(spark, sf).drop("quantity"), fold=False)
    nodes = nodes.withColumn("role", F.when((F.col("tree_id") % 3 == 1) & F.col("node_id").isin(1, 3), "webview").otherwise(F.col("role")))
    return flat(tree.mark_webviews(nodes).select("tree_id", "node_id", "role", "states"))


@query("t11_render_snapshot", "SELECT tree_id, snapshot FROM snaps")
def t11(spark, sf):
    return tree.render_snapshot(V.native_with_refs(spark, sf))


@query("t12_fuse", """SELECT coalesce(n.tree_id, w.conv_id) AS tree_id, CASE WHEN n.tree_id IS NOT NULL AND w.conv_id IS NOT NULL THEN n.snapshot || chr(10) || chr(10) || '--- Web ---' || chr(10) || w.snapshot ELSE coalesce(n.snapshot, w.snapshot) END AS snapshot FROM snaps n
  FULL JOIN (SELECT conv_id, '- screen [ref=w1] [bounds=0,0,800,600]:' || chr(10) || string_agg('  - ' || CASE WHEN role <> 'system' AND turn % 3 < 2 THEN 'text' ELSE 'generic' END || CASE WHEN text <> '' THEN ' "' || replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' ELSE '' END
    || CASE WHEN turn % 2 = 0 THEN ' [ref=w' || (1 + k2) || '] [bounds=1,2,3,4]' ELSE '' END, chr(10) ORDER BY turn, role, text) AS snapshot
    FROM (SELECT *, count(*) FILTER (turn % 2 = 0) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k2 FROM conversations) GROUP BY conv_id) w ON w.conv_id = n.tree_id""")
def t12(spark, sf):
    return tree.fuse(V.native_nodes(spark, sf), conversation_tree(spark, sf))


@query("t13_web_element_map", "SELECT conv_id AS tree_id, 'w' || (1 + count(*) FILTER (turn % 2 = 0) OVER (PARTITION BY conv_id ORDER BY turn, role, text)) AS ref, CAST(turn AS INT) AS web_idx FROM conversations QUALIFY turn % 2 = 0")
def t13(spark, sf):
    return tree.web_element_map(tree.assign_refs(conversation_tree(spark, sf), "w", web_mode=True))


@query("t14_role_histogram", """SELECT tree_id, string_agg(role || '×' || n, ' ' ORDER BY k) AS roles FROM (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY n DESC, role) AS k FROM
  (SELECT tree_id, role, count(*) AS n FROM folded GROUP BY ALL)) WHERE k <= 2 GROUP BY tree_id""")
def t14(spark, sf):
    return tree.role_histogram(V.native_nodes(spark, sf), 2)


@query("t15_cap_depth", "SELECT tree_id, node_id, depth FROM screen WHERE depth <= 1")
def t15(spark, sf):
    return tree.cap_depth(V.screen_nodes(spark, sf), 1).select("tree_id", "node_id", "depth")


#: Evidence over the roles of the screens: baseline, target, evidence, capability, role, name, least count.
EVIDENCE = [
    (0, "t1", "e1", "structural", "checkbox", "", 2), (0, "t1", "e2", "textual_content", "checkbox", "NO", 1), (0, "t2", "e3", "actionable", "button", "", 1),
    (1, "t1", "e1", "", "input", "a hint", 1), (1, "t1", "e2", "semantic_label", "generic", "NF", 1), (1, "t3", "e4", "structural", "card", "", 1),
    (1, "t3", "e5", "textual_content", "", "RF", 1), (2, "t3", "e6", "", "", "", 4), (2, "t1", "e1", "navigational", "webview", "", 1), (2, "t2", "e2", "actionable", "listitem", "", 3),
]


def evidence(spark) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, EVIDENCE))} AS t(baseline_id, target_id, evidence_id, capability, role, name, min_count)")


def run_nodes(spark, sf) -> DataFrame:
    return V.native_nodes(spark, sf).select((F.col("tree_id") % 3).cast("int").alias("baseline_id"), F.col("tree_id").alias("run_id"), "role", "name")


def judged(spark, sf) -> DataFrame:
    return evaluate.evaluate_counts(evaluate.match_evidence(run_nodes(spark, sf), evidence(spark)))


@query("j1_match_evidence", "SELECT run_id, baseline_id, target_id, evidence_id, actual_count FROM matched")
def j1(spark, sf):
    return evaluate.match_evidence(run_nodes(spark, sf), evidence(spark)).select("run_id", "baseline_id", "target_id", "evidence_id", "actual_count")


@query("a1_evaluate_counts", "SELECT run_id, baseline_id, target_id, evidence_id, actual_count, min_count, status FROM judged")
def a1(spark, sf):
    return judged(spark, sf).select("run_id", "baseline_id", "target_id", "evidence_id", "actual_count", "min_count", "status")


@query("a2_score_targets", "SELECT *, passed / total AS score, CASE WHEN passed = total THEN 'PASS' ELSE 'FAIL' END AS status FROM scored")
def a2(spark, sf):
    return evaluate.score_targets(judged(spark, sf))


@query("a3_summarize_run", """SELECT baseline_id, run_id, a AS artifact_count, cp AS count_passed, ct AS count_total, tp AS target_passed, tt AS target_total, ep AS evidence_passed, et AS evidence_total,
  CASE WHEN a > 0 AND ok AND cp = ct AND tp = tt AND ep = et THEN 'PASS' ELSE 'FAIL' END AS status FROM (
  SELECT * FROM (SELECT DISTINCT baseline_id, run_id FROM run_nodes)
  JOIN (SELECT run_id, count(*) AS a, bool_and(node_id >= 0) AS ok FROM folded GROUP BY run_id, tree_id AS run_id) x USING (run_id))""".replace("SELECT run_id, count(*) AS a, bool_and(node_id >= 0) AS ok FROM folded GROUP BY run_id, tree_id AS run_id", """SELECT r.run_id, r.a, r.ok, c.cp, c.ct, s.tp, s.tt, s.ep, s.et FROM (SELECT tree_id AS run_id, count(*) AS a, true AS ok FROM folded GROUP BY tree_id) r
    JOIN (SELECT run_id, count(*) FILTER (status = 'PASS') AS cp, count(*) AS ct FROM judged GROUP BY run_id) c USING (run_id)
    JOIN (SELECT run_id, count(*) FILTER (passed = total) AS tp, count(*) AS tt, CAST(sum(passed) AS BIGINT) AS ep, CAST(sum(total) AS BIGINT) AS et FROM scored GROUP BY run_id) s USING (run_id)"""))  # fmt: skip
def a3(spark, sf):
    nodes = cut(run_nodes(spark, sf))
    artifacts = nodes.withColumn("schema_status", F.lit("PASS"))
    j = cut(evaluate.evaluate_counts(evaluate.match_evidence(nodes, evidence(spark))))
    return evaluate.summarize_run(artifacts, j, evaluate.score_targets(j))


@query("a4_capability_coverage", """SELECT coalesce(nullif(capability, ''), 'default') AS capability, baseline_id, count(*) FILTER (status = 'PASS') AS passed, count(*) AS total FROM judged GROUP BY 1, 2
UNION ALL SELECT coalesce(nullif(capability, ''), 'default'), NULL, count(*) FILTER (status = 'PASS'), count(*) FROM judged GROUP BY 1""")
def a4(spark, sf):
    return evaluate.capability_coverage(judged(spark, sf))


@query("a6_decode_detections", """SELECT * FROM (SELECT vec_id AS id, v[1] - v[3] / 2 AS x1, v[2] - v[4] / 2 AS y1, v[1] + v[3] / 2 AS x2, v[2] + v[4] / 2 AS y2, list_max(v[5:]) AS score,
  CAST(list_position(v[5:], list_max(v[5:])) - 1 AS INT) AS class_id FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)) WHERE score >= 0.3""")
def a6(spark, sf):
    scores = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("values"))
    return boxes.decode_detections(scores, 0.3)


@query("j2_entry_outcomes", """SELECT run_id, plugin, captured, CASE WHEN NOT found THEN 'unsupported capture' WHEN NOT captured THEN 'broken' END AS capture_error, tried AS transform_tried, tried AND good AS transformed,
  CASE WHEN tried AND NOT there THEN 'unsupported transform' WHEN tried AND NOT good THEN 'bad' END AS transform_error FROM (
  SELECT event_id AS run_id, event_type AS plugin, event_id % 5 <> 0 AS found, event_id % 5 <> 0 AND event_id % 3 <> 0 AS captured, event_id % 5 <> 0 AND event_id % 3 <> 0 AND event_id % 2 = 0 AS tried, event_id % 7 <> 0 AS there, event_id % 7 <> 0 AND event_id % 11 <> 0 AS good FROM events)""")
def j2(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("plugin"))
    k = F.col("run_id")
    plan = e.withColumn("transform", k % 2 == 0)
    captures = e.where(k % 5 != 0).select("*", (k % 3 != 0).alias("ok"), F.lit("broken").alias("error"))
    transforms = e.where(k % 7 != 0).select("*", (k % 11 != 0).alias("ok"), F.lit("bad").alias("error"))
    return evaluate.entry_outcomes(plan, captures, transforms)


@query("j5_extract_ref_bounds", "SELECT tree_id, ref, l, t, r, b FROM reffed WHERE ref <> ''")
def j5(spark, sf):
    out = actions.extract_ref_bounds(tree.render_snapshot(V.native_with_refs(spark, sf)), ["tree_id"])
    return out.select("tree_id", "ref", *(F.col(s).alias(n) for s, n in zip(geometry.SIDES, "ltrb", strict=True)))


@query("j3_resolve_refs", """SELECT o_orderkey AS session, o_orderkey % 4 AS action_id, ref, CAST(floor((l + r) / 2.0 + 0.5) AS INT) AS x, CAST(floor((t + b) / 2.0 + 0.5) AS INT) AS y,
  CASE WHEN l IS NULL THEN 'Unknown ref: ' || ref || '. Capture UI first.' END AS error FROM (SELECT o_orderkey, 'n' || (1 + o_orderkey % 4) AS ref FROM orders)
  LEFT JOIN (SELECT tree_id, ref, l, t, r, b FROM reffed WHERE ref <> '') x ON x.tree_id = o_orderkey AND x.ref = orders_ref""".replace("AS ref FROM orders)", "AS orders_ref FROM orders)").replace("o_orderkey % 4 AS action_id, ref,", "o_orderkey % 4 AS action_id, orders_ref AS ref,").replace("'Unknown ref: ' || ref", "'Unknown ref: ' || orders_ref"))
def j3(spark, sf):
    k = F.col("o_orderkey")
    wanted = V.table(spark, sf, "orders").select(k.alias("session"), (k % 4).alias("action_id"), F.concat(F.lit("n"), (1 + k % 4).cast("string")).alias("ref"))
    found = actions.extract_ref_bounds(tree.render_snapshot(V.native_with_refs(spark, sf)), ["tree_id"]).withColumnRenamed("tree_id", "session")
    return actions.resolve_refs(wanted, found)


SHOTS = "(SELECT o_custkey AS session, o_orderdate AS ts, max(o_orderkey) AS capture_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY ALL)"
ACTS = "(SELECT o_custkey AS session, o_orderkey AS action_id, 'n' || (1 + o_orderkey % 4) AS ref, o_orderdate + CAST(o_orderkey % 300 - 100 AS INT) * INTERVAL 1 DAY AS ts FROM orders)"


@query("j3_resolve_refs_at", f"""SELECT a.session, a.action_id, s.capture_id, a.ref, CAST(floor((l + r) / 2.0 + 0.5) AS INT) AS x, CAST(floor((t + b) / 2.0 + 0.5) AS INT) AS y, CASE WHEN l IS NULL THEN 'Unknown ref: ' || a.ref || '. Capture UI first.' END AS error
FROM {ACTS} a ASOF LEFT JOIN {SHOTS} s ON a.session = s.session AND a.ts >= s.ts LEFT JOIN (SELECT tree_id, ref, l, t, r, b FROM reffed WHERE ref <> '') x ON x.tree_id = s.capture_id AND x.ref = a.ref""")
def j3_at(spark, sf):
    """Orders of a customer as captures of a session, and actions up to some months before or after: some come before any capture."""
    k = F.col("o_orderkey")
    shots = V.snapshots(spark, sf).select("session", F.col("tree_id").alias("capture_id"), F.col("ts").cast("timestamp").alias("ts"), "snapshot")
    days = F.make_dt_interval((k % 300 - 100).cast("int"))
    acts = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("session"), k.alias("action_id"), F.concat(F.lit("n"), (1 + k % 4).cast("string")).alias("ref"), (F.col("o_orderdate").cast("timestamp") + days).alias("ts"))
    return actions.resolve_refs_at(acts, shots, slice_seconds=90 * 86400)


@query("j4_swipe_path", """SELECT event_id, x + dx AS start_x, y + dy AS start_y, x - dx AS end_x, y - dy AS end_y FROM (SELECT event_id, event_id % 1080 AS x, user_id % 2400 AS y,
  CASE event_id % 5 WHEN 2 THEN 200 WHEN 3 THEN -200 ELSE 0 END AS dx, CASE event_id % 5 WHEN 0 THEN 200 WHEN 1 THEN -200 ELSE 0 END AS dy FROM events)""")
def j4(spark, sf):
    names = F.array(*map(F.lit, ("up", "down", "left", "right", "none")))
    e = V.table(spark, sf, "events").select("event_id", (F.col("event_id") % 1080).alias("x"), (F.col("user_id") % 2400).alias("y"), F.get(names, (F.col("event_id") % 5).cast("int")).alias("direction"))
    return actions.swipe_path(e).select("event_id", "start_x", "start_y", "end_x", "end_y")


@query("j6_dominant_webview", """SELECT screen, position, visible_area, visible_area / 60000 AS coverage, visible_area / 60000 > 0.5 AS is_web FROM (
  SELECT image AS screen, seq AS position, greatest(0, least(x1 + 10 * (x2 - x1), 200) - greatest(x1, 0)) * greatest(0, least(y1 + 10 * (y2 - y1), 300) - greatest(y1, 0)) AS visible_area FROM boxes)
  WHERE visible_area > 0 QUALIFY row_number() OVER (PARTITION BY screen ORDER BY visible_area DESC, position) = 1""")
def j6(spark, sf):
    b = V.boxes(spark, sf)
    views = b.select(F.col("image").alias("screen"), F.col("seq").alias("position"), "x1", "y1", (F.col("x1") + 10 * (F.col("x2") - F.col("x1"))).alias("x2"), (F.col("y1") + 10 * (F.col("y2") - F.col("y1"))).alias("y2"))
    screens = b.select(F.col("image").alias("screen")).distinct().select("screen", F.lit(200).alias("width"), F.lit(300).alias("height"))
    return boxes.dominant_webview(views, screens)


PAIRS = """SELECT l.image, l.seq AS a, r.seq AS b, round((greatest(0, least(l.x2, r.x2) - greatest(l.x1, r.x1)) * greatest(0, least(l.y2, r.y2) - greatest(l.y1, r.y1)))
  / ((l.x2 - l.x1) * (l.y2 - l.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - greatest(0, least(l.x2, r.x2) - greatest(l.x1, r.x1)) * greatest(0, least(l.y2, r.y2) - greatest(l.y1, r.y1)) + 1e-6), 9) AS iou
  FROM boxes l JOIN boxes r ON l.image = r.image"""


@query("j7_box_iou_pairs", f"SELECT * FROM ({PAIRS}) WHERE a < b AND iou > 0.05")
def j7(spark, sf):
    b = V.boxes(spark, sf).withColumnRenamed("seq", "id")
    return boxes.box_iou_pairs(b, b, 0.05).where("a < b").withColumn("iou", F.round("iou", 9))


R3_IOU = """greatest(0, least(k.x2, b.x2) - greatest(k.x1, b.x1)) * greatest(0, least(k.y2, b.y2) - greatest(k.y1, b.y1))"""


@query("r3_nms", f"""SELECT image, unnest(kept, recursive := true) FROM (SELECT image, arg_max(kept, n) AS kept FROM (
  WITH RECURSIVE ranked AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, seq) AS n FROM (
      SELECT image // 40 AS image, CAST(row_number() OVER (PARTITION BY image // 40 ORDER BY score DESC, x1, y1, x2, y2, image, seq) AS INT) AS seq, score, x1, y1, x1 + 4 * (x2 - x1) AS x2, y1 + 4 * (y2 - y1) AS y2, class_id FROM boxes)),
  scan AS (SELECT image, 0::BIGINT AS n, CAST([] AS STRUCT(seq INT, score BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, class_id INT)[]) AS kept FROM (SELECT DISTINCT image FROM ranked)
    UNION ALL SELECT s.image, b.n, CASE WHEN len(s.kept) >= 50 OR len(list_filter(s.kept, lambda k: {R3_IOU} / ((k.x2 - k.x1) * (k.y2 - k.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {R3_IOU} + 1e-6) > 0.2)) > 0 THEN s.kept
      ELSE list_append(s.kept, {{'seq': b.seq, 'score': b.score, 'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2, 'class_id': b.class_id}}) END
    FROM scan s JOIN ranked b ON b.image = s.image AND b.n = s.n + 1) SELECT * FROM scan) GROUP BY image)""")
def r3(spark, sf):
    """All lines of 40 orders on one image, so that boxes overlap."""
    b = V.boxes(spark, sf)
    order = W.partitionBy("image").orderBy(F.desc("score"), "x1", "y1", "x2", "y2", "order", "seq")
    wide = b.withColumn("order", F.col("image")).withColumn("image", F.floor(F.col("image") / 40)).withColumn("seq", F.row_number().over(order))
    grown = wide.withColumn("x2", F.col("x1") + 4 * (F.col("x2") - F.col("x1"))).withColumn("y2", F.col("y1") + 4 * (F.col("y2") - F.col("y1")))
    return boxes.nms(grown.select("image", "seq", "score", "x1", "y1", "x2", "y2", "class_id"), 0.2)


@query("j8_label_classes", """SELECT image, seq, class_id, CASE WHEN class_id < 21 THEN ['BackgroundImage', 'Bottom_Navigation', 'Card', 'CheckBox', 'Checkbox', 'CheckedTextView', 'Drawer', 'EditText', 'Icon', 'Image', 'Map', 'Modal',
  'Multi_Tab', 'PageIndicator', 'Remember', 'Spinner', 'Switch', 'Text', 'TextButton', 'Toolbar', 'UpperTaskBar'][class_id + 1] ELSE 'Unknown#' || class_id END AS label_en FROM boxes""")
def j8(spark, sf):
    return boxes.label_classes(V.boxes(spark, sf)).select("image", "seq", "class_id", "label_en")


@query("j9_caption_crops", """SELECT image, seq AS index, l AS left, t AS top, r AS right, b AS bottom, CASE WHEN seq % 2 = 0 THEN 'caption ' || seq WHEN seq % 3 = 0 THEN 'no model' ELSE '' END AS caption FROM (
  SELECT image, seq, CAST(least(x1, 500) AS INT) AS l, CAST(least(y1, 900) AS INT) AS t, CAST(least(floor(x2 + 0.5), 500) AS INT) AS r, CAST(least(floor(y2 + 0.5), 900) AS INT) AS b FROM boxes) WHERE r > l AND b > t""")
def j9(spark, sf):
    b = V.boxes(spark, sf).withColumnRenamed("seq", "index")
    images = b.select("image").distinct().select("image", F.lit(500).alias("width"), F.lit(900).alias("height"))
    said = b.select("image", "index", F.when(F.col("index") % 2 == 0, F.concat(F.lit("caption "), F.col("index").cast("string"))).alias("caption"), F.when(F.col("index") % 3 == 0, "no model").alias("error"))
    return boxes.caption_crops(b, images, said)


@query("g1_letterbox_params", """SELECT image, seq, round(ratio, 9) AS ratio, nw AS new_w, nh AS new_h, (640 - nw) / 2.0 AS pad_x, (640 - nh) / 2.0 AS pad_y FROM (SELECT *, CAST(greatest(1, floor((1 + x1) * ratio + 0.5)) AS INT) AS nw, CAST(greatest(1, floor((1 + y1) * ratio + 0.5)) AS INT) AS nh FROM
  (SELECT image, seq, x1, y1, least(640.0::DOUBLE / (1 + x1), 640.0::DOUBLE / (1 + y1)) AS ratio FROM boxes))""")
def g1(spark, sf):
    p = geometry.letterbox_params(1 + F.col("x1"), 1 + F.col("y1"), 640)
    return V.boxes(spark, sf).select("image", "seq", p.alias("p")).select("image", "seq", F.round("p.ratio", 9).alias("ratio"), "p.new_w", "p.new_h", "p.pad_x", "p.pad_y")


UNIT = "CASE WHEN {0} BETWEEN 0 AND 1.01 THEN {0} * 640 ELSE {0} END AS {0}"


@query("g2_unletterbox", f"""SELECT image, seq, greatest(0.0, least(400.0, (x1 - 20) / 0.5)) AS x1, greatest(0.0, least(800.0, (y1 - 10) / 0.5)) AS y1, greatest(0.0, least(400.0, (x2 - 20) / 0.5)) AS x2, greatest(0.0, least(800.0, (y2 - 10) / 0.5)) AS y2 FROM (
  SELECT image, seq, {', '.join(UNIT.format(c) for c in ('x1', 'y1', 'x2', 'y2'))}
  FROM (SELECT image, seq, CASE WHEN seq = 1 THEN x1 / 2048 ELSE x1 END AS x1, CASE WHEN seq < 3 THEN y1 / 2048 ELSE y1 END AS y1, CASE WHEN seq = 1 THEN x2 / 2048 ELSE x2 END AS x2, CASE WHEN seq = 1 THEN y2 / 2048 ELSE y2 END AS y2 FROM boxes))""")
def g2(spark, sf):
    b = V.boxes(spark, sf)
    box = [F.when(F.col("seq") < (3 if c == "y1" else 2), F.col(c) / 2048).otherwise(F.col(c)) for c in boxes.CORNERS]
    out = geometry.unletterbox(box, F.lit(0.5), F.lit(20), F.lit(10), F.lit(400), F.lit(800), 640)
    return b.select("image", "seq", *(c.alias(n) for c, n in zip(out, boxes.CORNERS, strict=True)))


@query("g3_clamp_thresholds", "SELECT event_id, least(greatest(value / 100, 0.001), 0.999) AS conf, least(greatest(value / 50, 0.05), 0.95) AS iou FROM events")
def g3(spark, sf):
    conf, iou = geometry.clamp_thresholds(F.col("value") / 100, F.col("value") / 50)
    return V.table(spark, sf, "events").select("event_id", conf.alias("conf"), iou.alias("iou"))


@query("r1_latest_run", "SELECT baseline_id, max(run_id) AS run_id FROM runs GROUP BY baseline_id")
def r1(spark, sf):
    return evaluate.latest_run(V.runs(spark, sf)).select("baseline_id", "run_id")


@query("r1_newest_result", "SELECT baseline_id, run_id FROM (SELECT baseline_id, max(run_id) AS run_id FROM runs GROUP BY baseline_id) JOIN runs USING (baseline_id, run_id) WHERE inference_ms >= 0 ORDER BY created DESC, baseline_id LIMIT 1")
def r1b(spark, sf):
    """Runs without a latency have no result; of the latest runs of all baselines the one with the newest result counts."""
    return evaluate.newest_result(V.runs(spark, sf).withColumn("result_at", F.when(F.col("inference_ms") >= 0, F.col("created")))).select("baseline_id", "run_id")


@query("r7_sort_artifacts", "SELECT mode AS plugin, run_id AS path FROM runs ORDER BY 1, 2")
def r7(spark, sf):
    return evaluate.sort_artifacts(V.runs(spark, sf).select(F.col("mode").alias("plugin"), F.col("run_id").alias("path")))


@query("x4_run_id", """SELECT run_id, strftime(created, '%Y%m%d_%H%M%S') || '_' || upper(mode) || '_' || lpad(CAST((row_number() OVER (PARTITION BY baseline_id ORDER BY created, run_id) - 1) % 999 + 1 AS VARCHAR), 3, '0') AS experiment_id FROM runs""")
def x4(spark, sf):
    return icons.run_ids(V.runs(spark, sf)).select("run_id", "experiment_id")


@query("a9_batch_rollup", """SELECT CAST(conv_id AS VARCHAR) AS run_id, arg_min('image ' || turn, turn) AS image, CAST(sum(turn * 10) AS BIGINT) AS prepare_ms, CAST(sum(CASE WHEN turn % 2 = 0 THEN turn END) AS BIGINT) AS inference_ms,
  string_agg(text, chr(10) ORDER BY turn, text) AS raw_text, bool_or(turn > 5) AS failed, count(*) AS batches FROM conversations GROUP BY conv_id""")
def a9(spark, sf):
    t = F.col("turn")
    batches = V.table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("run_id"), t.alias("batch"), F.concat(F.lit("image "), t.cast("string")).alias("image"), (t * 10).alias("prepare_ms"), F.when(t % 2 == 0, t).otherwise(-1).alias("inference_ms"), F.col("text").alias("raw_text"), (t > 5).alias("failed"))
    return icons.batch_rollup(batches)


def parsed(spark, sf) -> DataFrame:
    """Assistant turns as model output: each line with the turn as its id."""
    said = V.table(spark, sf, "conversations").where("role = 'assistant'")
    raw = F.concat_ws("\n", F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("t"), F.col("turn").cast("string"), F.lit(":"), x)))
    return icons.parse_model_output(said.select("conv_id", "turn", raw.alias("raw_text")), ["conv_id", "turn"])


PARSED = """SELECT conv_id, turn, CAST(k - 1 AS INT) AS position, 't' || turn AS id, trim(part) AS desc_ FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM conversations WHERE role = 'assistant') WHERE trim(part) <> ''"""


@query("x1_parse_model_output", PARSED)
def x1(spark, sf):
    return parsed(spark, sf).withColumnRenamed("desc", "desc_")


@query("j10_remap_output_labels", f"SELECT conv_id, turn, position, CASE WHEN turn = 1 THEN 'late-' || conv_id WHEN turn = 3 THEN 'three' ELSE id END AS id FROM ({PARSED})")
def j10(spark, sf):
    mappings = V.table(spark, sf, "conversations").select("conv_id").distinct().select("conv_id", F.explode(F.array(
        F.struct(F.lit(0).alias("position"), F.lit("t1").alias("label"), F.lit("early").alias("target_id")),
        F.struct(F.lit(1).alias("position"), F.lit("t1").alias("label"), F.concat(F.lit("late-"), F.col("conv_id").cast("string")).alias("target_id")),
        F.struct(F.lit(2).alias("position"), F.lit("t3").alias("label"), F.lit("three").alias("target_id")),
    )).alias("m")).select("conv_id", "m.*")
    return icons.remap_output_labels(parsed(spark, sf), mappings, ["conv_id"]).select("conv_id", "turn", "position", "id")


def icon_targets(spark, sf) -> DataFrame:
    """Targets: the parts of a supplier; what is expected is a word of the part's name or a synonym group."""
    expected = F.get(F.array(*map(F.lit, ("电话图标", "Search Icon", "加号", "邮件", "mystery"))), (F.col("l_partkey") % 5).cast("int"))
    b = F.struct((F.col("l_partkey") % 1000).cast("int").alias("left"), F.lit(0).alias("top"), (F.col("l_partkey") % 1000 + F.floor("l_quantity") - 5).cast("int").alias("right"), F.lit(60).alias("bottom"))
    return V.lines(spark, sf).select(F.col("l_orderkey").alias("testset_id"), F.col("seq").alias("position"), F.concat(F.lit("T"), F.col("seq").cast("string")).alias("target_id"), expected.alias("expected"), F.array(F.lit("quill-pen")).alias("acceptable"), b.cast("struct<left:int,top:int,right:int,bottom:int>").alias("bounds"))


def icon_matches(spark, sf) -> DataFrame:
    said = F.get(F.array(*map(F.lit, ("phone", "放大镜", "a quillpen", "unknown", "mystery icon", ""))), (F.col("l_suppkey") % 6).cast("int"))
    rows = V.lines(spark, sf).select(F.col("l_orderkey").alias("testset_id"), "seq", F.col("seq").alias("position"), F.concat(F.lit("t"), F.col("seq").cast("string")).alias("id"), said.alias("desc"))
    return icons.match_icons(rows.where("desc <> ''"), icon_targets(spark, sf), ["testset_id"])


MATCHED = """SELECT l_orderkey AS testset_id, 'T' || seq AS target_id, ['phone', '放大镜', 'a quillpen', 'unknown', 'mystery icon', ''][l_suppkey % 6 + 1] AS desc_,
  CASE l_suppkey % 6 WHEN 0 THEN l_partkey % 5 = 0 WHEN 1 THEN l_partkey % 5 = 1 WHEN 2 THEN true WHEN 4 THEN l_partkey % 5 = 4 ELSE false END AS matched FROM lines"""


@query("j11_match_icons", MATCHED)
def j11(spark, sf):
    return icon_matches(spark, sf).select("testset_id", "target_id", F.col("desc").alias("desc_"), "matched")


@query("a7_match_summary", f"SELECT testset_id, CAST(count(*) FILTER (matched) AS BIGINT) AS matched, count(*) AS total, count(*) FILTER (matched) * 100.0::DOUBLE / count(*) AS percent FROM ({MATCHED}) GROUP BY testset_id")
def a7(spark, sf):
    return icons.match_summary(icon_matches(spark, sf), ["testset_id"])


#: Matches of the test set with the number of the run.
RUN_MATCHES = f"(SELECT testset_id, CAST(count(*) FILTER (matched) AS BIGINT) AS matched, count(*) AS total FROM ({MATCHED}) GROUP BY testset_id)"


@query("r2_history_top", f"""SELECT run_id, mode AS mode_name, coalesce(matched, 0) AS matched, coalesce(total, 0) AS total, CASE WHEN total > 0 THEN matched * 100.0::DOUBLE / total END AS percent
  FROM (SELECT * FROM runs ORDER BY created DESC, run_id DESC LIMIT 20) LEFT JOIN {RUN_MATCHES} ON testset_id = CAST(run_id AS BIGINT)""")
def r2(spark, sf):
    summary = icons.match_summary(icon_matches(spark, sf), ["testset_id"]).withColumn("run_id", F.col("testset_id").cast("string"))
    return icons.history_top(V.runs(spark, sf), 20, summary).select("run_id", "mode_name", "matched", "total", "percent")


@query("a8_mode_leaderboard", f"""SELECT *, CASE WHEN total > 0 THEN matched * 100.0::DOUBLE / total END AS percent FROM (
  SELECT mode, encoding, count(*) AS runs, count(*) FILTER (inference_ms >= 0) AS timed, avg(inference_ms) FILTER (inference_ms >= 0) AS avg_ms, min(inference_ms) FILTER (inference_ms >= 0) AS min_ms, max(inference_ms) FILTER (inference_ms >= 0) AS max_ms,
    CAST(coalesce(sum(matched), 0) AS BIGINT) AS matched, CAST(coalesce(sum(total), 0) AS BIGINT) AS total
  FROM (SELECT *, ['PNG', 'JPEG 75', 'JPEG 90'][CAST(run_id AS BIGINT) % 3 + 1] AS encoding FROM runs) LEFT JOIN {RUN_MATCHES} ON testset_id = CAST(run_id AS BIGINT) GROUP BY mode, encoding)""")
def a8(spark, sf):
    summary = icons.match_summary(icon_matches(spark, sf), ["testset_id"]).select(F.col("testset_id").cast("string").alias("run_id"), "matched", "total")
    encoding = F.get(F.array(*map(F.lit, ("PNG", "JPEG 75", "JPEG 90"))), (F.col("run_id").cast("long") % 3).cast("int"))
    return icons.mode_leaderboard(V.runs(spark, sf).withColumn("encoding", encoding).join(summary, "run_id", "left"))


@query("j12_manual_scores", "SELECT l_orderkey AS testset_id, seq AS position, CASE WHEN seq % 2 = 0 THEN l_orderkey % 3 END AS score, CASE WHEN seq % 2 = 0 THEN 'seen' ELSE '' END AS note FROM lines")
def j12(spark, sf):
    t = icon_targets(spark, sf).select("testset_id", "position")
    scores = t.where("position % 2 = 0").select("*", (F.col("testset_id") % 3).alias("score"), F.lit("seen").alias("note"))
    return icons.manual_scores(t, scores, ["testset_id", "position"])


@query("r4_label_targets", "SELECT l_orderkey AS testset_id, seq AS position, CAST(seq AS VARCHAR) AS label FROM lines")
def r4(spark, sf):
    return icons.label_targets(icon_targets(spark, sf)).select("testset_id", "position", "label")


@query("r5_batch_targets", "SELECT l_orderkey AS testset_id, seq AS position, CAST((seq - 1) // 4 + 1 AS INT) AS batch FROM lines")
def r5(spark, sf):
    return icons.batch_targets(icon_targets(spark, sf), 4).select("testset_id", "position", "batch")


@query("r6_montage_layout", """SELECT testset_id, position, canvas_width, canvas_height, x AS "left", y AS top, x + w AS "right", y + h AS bottom FROM (
  SELECT *, CAST((position - 1) % 3 * 220 + 16 + greatest(0, (188 - w) // 2) AS INT) AS x, CAST((position - 1) // 3 * 190 + 54 + greatest(0, (120 - h) // 2) AS INT) AS y FROM (
  SELECT testset_id, position, 660 AS canvas_width, CAST(greatest(1, (n + 2) // 3 * 190) AS INT) AS canvas_height, CAST(greatest(1, floor(sw * s + 0.5)) AS INT) AS w, CAST(greatest(1, floor(sh * s + 0.5)) AS INT) AS h FROM (
  SELECT *, least(188.0::DOUBLE / sw, 120.0::DOUBLE / sh) AS s FROM (SELECT l_orderkey AS testset_id, seq AS position, count(*) OVER (PARTITION BY l_orderkey) AS n, CASE WHEN floor(l_quantity) > 5 THEN floor(l_quantity) - 5 ELSE 188 END AS sw, CASE WHEN floor(l_quantity) > 5 THEN 60 ELSE 120 END AS sh FROM lines))))""")
def r6(spark, sf):
    return icons.montage_layout(icon_targets(spark, sf)).select("testset_id", "position", "canvas_width", "canvas_height", "left", "top", "right", "bottom")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def filled_prompt(mode: str) -> str:
    """The SQL that fills a mode's fixed words."""
    out = quoted(icons.PROMPTS[mode])
    for mark, value in (("{targets}", "body"), ("{count}", "CAST(n AS VARCHAR)"), ("{width}", "CAST(w AS VARCHAR)"), ("{height}", "CAST(h AS VARCHAR)")):
        out = f"replace({out}, '{mark}', {value})"
    return out


#: Targets as prompts list them: ``line`` without, ``boxed`` with bounds; images have a size if their order is even.
LISTED = """(SELECT l_orderkey AS testset_id, seq AS position, (seq - 1) // 3 + 1 AS batch, floor(l_quantity) > 5 AS ok, CAST(l_partkey % 1000 + floor(l_quantity) - 5 AS INT) AS r, CASE WHEN l_orderkey % 2 = 0 THEN 1080 ELSE 0 END AS given,
  seq || chr(10) AS line, seq || '=' || (l_partkey % 1000) || ',0,' || CAST(l_partkey % 1000 + floor(l_quantity) - 5 AS INT) || ',60' || chr(10) AS boxed FROM lines)"""
BOXED = f"""SELECT testset_id, batch, CAST(count(*) FILTER (ok) AS INT) AS n, CASE WHEN max(given) > 0 THEN max(given) ELSE coalesce(max(r) FILTER (ok), 0) END AS w, CASE WHEN max(given) > 0 THEN 2400 ELSE CAST(coalesce(max(60) FILTER (ok), 0) AS INT) END AS h,
  coalesce(string_agg(boxed, '' ORDER BY position) FILTER (ok), '') AS body FROM """
PLAIN = f"SELECT testset_id, 0 AS batch, CAST(count(*) AS INT) AS n, 0 AS w, 0 AS h, string_agg(line, '' ORDER BY position) AS body FROM {LISTED} GROUP BY testset_id"


@query("x2_build_prompts", " UNION ALL ".join([
    *(f"SELECT testset_id, 0 AS batch, '{m}' AS mode, n AS n_targets, sha256({filled_prompt(m)}) AS prompt_sha256 FROM ({PLAIN})" for m in ("FULL_IMAGE", "FULL_IMAGE_WITH_MARKED_BOUNDS", "CROPPED_MONTAGE")),
    f"SELECT testset_id, batch, 'FULL_IMAGE_WITH_BOUNDS' AS mode, n AS n_targets, sha256({filled_prompt('FULL_IMAGE_WITH_BOUNDS')}) AS prompt_sha256 FROM ({BOXED} (SELECT * REPLACE (0 AS batch) FROM {LISTED}) GROUP BY ALL)",
    f"SELECT testset_id, batch, 'FULL_IMAGE_WITH_BOUNDS_BATCHED' AS mode, n AS n_targets, sha256({filled_prompt('FULL_IMAGE_WITH_BOUNDS')}) AS prompt_sha256 FROM ({BOXED} {LISTED} GROUP BY ALL)",
]))
def x2(spark, sf):
    """The prompts of every mode in short. The fixed words are shared with SQL, which puts them together by itself."""
    targets = icons.batch_targets(icons.label_targets(icon_targets(spark, sf)), 3)
    images = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("testset_id")).distinct().select("testset_id", F.when(F.col("testset_id") % 2 == 0, 1080).otherwise(0).alias("width"), F.when(F.col("testset_id") % 2 == 0, 2400).otherwise(-1).alias("height"))
    out = []
    for mode in icons.PROMPTS:
        batched = mode.endswith("BATCHED")
        p = icons.build_prompts(targets, mode, images, ("testset_id", "batch") if batched else ("testset_id",))
        out.append(p.select("testset_id", (F.col("batch") if batched else F.lit(0)).cast("int").alias("batch"), F.lit(mode).alias("mode"), "n_targets", F.sha2("prompt", 256).alias("prompt_sha256")))
    return reduce(DataFrame.unionByName, out)


@query("e3_icon_experiment", f"""SELECT l_orderkey AS run_id, CAST(count(*) FILTER (l_partkey % 5 = 0) AS BIGINT) AS matched, count(*) AS total, count(*) FILTER (l_partkey % 5 = 0) * 100.0::DOUBLE / count(*) AS percent FROM lines GROUP BY l_orderkey""")
def e3(spark, sf):
    """An icon experiment from the targets to the score, with a model that calls everything a phone."""
    targets = icons.label_targets(icon_targets(spark, sf))
    requests = icons.build_prompts(targets, "FULL_IMAGE_WITH_MARKED_BOUNDS").select("testset_id", F.lit("screen.png").alias("image"), "prompt")

    def model(image: str, prompt: str) -> tuple[str, str]:
        listed = prompt.split("Target ids:\n")[1].split("\nOutput exactly")[0].split()
        return "\n".join(f"{label}: phone" for label in listed), ""

    said = icons.parse_model_output(icons.apply_vision_model(requests, model, "testset_id"), ["testset_id"])
    mappings = targets.select("testset_id", "position", "label", "target_id")
    matched = icons.match_icons(icons.remap_output_labels(said, mappings, ["testset_id"]), targets, ["testset_id"])
    return icons.match_summary(matched, ["testset_id"]).withColumnRenamed("testset_id", "run_id")


@query("f1_apply_vision_model", "SELECT conv_id * 1000 + turn AS request_id, coalesce(CAST(length(text) AS VARCHAR), '') AS raw_text, CASE WHEN role = 'system' THEN 'ValueError' WHEN text = '' THEN 'EMPTY' ELSE '' END AS error FROM (SELECT conv_id, turn, role, CASE WHEN role = 'system' THEN NULL ELSE coalesce(text, '') END AS text FROM conversations)")
def f1(spark, sf):
    """Turns as requests to a model that counts characters, and fails on those of the system."""

    def model(image: str, prompt: str) -> tuple[str, str]:
        if image == "system":
            raise ValueError("no image")
        return str(len(prompt)), "" if prompt else "EMPTY"

    c = V.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.col("role").alias("image"), F.coalesce("text", F.lit("")).alias("prompt"))
    return icons.apply_vision_model(c, model).select("request_id", "raw_text", "error")


#: Screens in a file of ``f2_register_source``, and bytes of XML in a partition where its trees are read: as many nodes as in one of ``dealt``.
SCREENS_A_FILE, XML_BYTES = 4000, 12_000_000


@query("f2_register_source", "SELECT tree_id, node_id, parent_id, role, name FROM folded")
def f2(spark, sf):
    """Screens as a source of a user: XML in a folder of captures, a format of Spark that lists and reads it, and a reader under the node contract."""
    from screenloom.cut import shared_folder
    from screenloom.sources import captures, files, markup

    root, written = f"{shared_folder(spark)}/{uuid.uuid4().hex}", Observation()
    lines = markup.native_xml(V.screen_nodes(spark, sf), brief=True).select(F.concat(F.col("tree_id").cast("string"), F.lit("\t"), "xml").alias("value"))
    # a capture is read whole, so a file holds no more screens than a task can: some megabytes
    lines.observe(written, F.sum(F.octet_length("value")).alias("size")).write.option("maxRecordsPerFile", SCREENS_A_FILE).text(f"{root}/captures/screens/runs/r1/native/raw")
    captures.register(spark)
    partitions = max(spark.sparkContext.defaultParallelism, -(-(written.get["size"] or 0) // XML_BYTES))

    def to_nodes(df: DataFrame) -> DataFrame:
        rows = df.select(F.explode(F.split("content", "\n")).alias("line")).where("line <> ''")
        xml = rows.select(F.substring_index("line", "\t", 1).cast("long").alias("tree_id"), F.substring_index("line", "\t", -1).alias("xml"))
        return native.semantic_nodes(markup.read_native_trees(xml, partitions=partitions))

    files.register_source("screens", to_nodes)
    found = spark.read.format("captures").load(root).where("plugin = 'native' AND stage = 'raw'")
    return files.read_source("screens", found).select("tree_id", "node_id", "parent_id", "role", "name")


@query("x3_icon_norm", "SELECT p_partkey, translate(replace(replace(lower('图标 ' || p_name || '-Icon_。：'), '图标', ''), 'icon', ''), '：， -_。.', ':,') AS norm FROM part")
def x3(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", text.icon_norm(F.concat(F.lit("图标 "), F.col("p_name"), F.lit("-Icon_。："))).alias("norm"))


@query("u1_pool_sources", "SELECT role, count(*) AS n FROM (SELECT role FROM folded UNION ALL SELECT 'screen' FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT CASE WHEN role <> 'system' AND turn % 3 < 2 THEN 'text' ELSE 'generic' END FROM conversations) GROUP BY role")
def u1(spark, sf):
    return tree.pool_sources(V.native_nodes(spark, sf), conversation_tree(spark, sf)).groupBy("role").agg(F.count("*").alias("n"))


@query("u2_unknown_roles", "SELECT DISTINCT role FROM conversations WHERE role NOT IN ('list') AND role <> ''")
def u2(spark, sf):
    return evaluate.unknown_roles(V.table(spark, sf, "conversations"))


@query("v1_validate_targets", """SELECT folder, target_id, problem FROM (SELECT CAST(event_id % 4 AS VARCHAR) AS folder, CASE WHEN event_id % 13 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS target_id,
  unnest(list_filter([CASE WHEN event_id % 5 = 0 THEN 'missing page' WHEN event_id % 5 <> event_id % 4 THEN 'page differs from folder' END, CASE WHEN event_id % 13 = 0 THEN 'missing id' END, CASE WHEN event_id % 7 = 0 THEN 'missing role' WHEN event_id % 7 = 1 THEN 'unknown role' END,
  CASE WHEN event_id % 3 = 0 THEN 'missing requiredRef' WHEN event_id % 3 = 1 THEN 'requiredRef is neither true nor false' END], lambda x: x IS NOT NULL)) AS problem FROM events)""")
def v1(spark, sf):
    k = F.col("event_id")
    t = V.table(spark, sf, "events").select((k % 4).cast("string").alias("folder"), F.when(k % 5 != 0, (k % 5).cast("string")).alias("page"), F.when(k % 13 != 0, k.cast("string")).otherwise("").alias("target_id"), F.when(k % 7 == 0, "").when(k % 7 == 1, "blob").otherwise("list").alias("role"), F.when(k % 3 == 1, "yes").when(k % 3 == 2, "true").alias("required_ref"))
    return evaluate.validate_targets(t)
