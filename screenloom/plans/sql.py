"""The SQL side of the queries: views as chains of CTEs that DuckDB runs on the same tables."""

from __future__ import annotations

CTES = {
    "lines": """SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
  l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS INT) AS seq FROM lineitem""",
    "order_ids": "SELECT DISTINCT l_orderkey FROM lines",
    "screen": """SELECT l_orderkey AS tree_id, 0 AS node_id, CAST(NULL AS INT) AS parent_id, 0 AS depth, CAST([] AS INT[]) AS path, 0 AS sibling_pos,
  'com.android.internal.policy.DecorView' AS class_name, '' AS resource_id, '' AS text, '' AS hint, 0 AS l, 0 AS t, 1080 AS r, 2400 AS b,
  false AS clickable, true AS enabled, false AS checked, false AS item_click FROM order_ids
UNION ALL SELECT l_orderkey, 1, 0, 1, [0], 0,
  ['androidx.recyclerview.widget.RecyclerView', 'android.widget.LinearLayout', 'android.widget.GridView'][l_orderkey % 3 + 1],
  '', '', '', 0, 0, 1080, 2400, false, true, false, l_orderkey % 2 = 0 FROM order_ids
UNION ALL SELECT l_orderkey, seq + 1, 1, 2, [0, 1], seq - 1,
  'android.widget.' || ['TextView', 'ImageView', 'ImageButton', 'EditText', 'CheckBox', 'FrameLayout', 'CardView'][l_linenumber],
  CASE WHEN l_partkey % 5 = 0 THEN 'app:id/part_item_' || (l_partkey % 7) ELSE '' END,
  CASE WHEN l_partkey % 3 = 0 THEN l_returnflag || l_linestatus ELSE '' END, CASE WHEN l_partkey % 4 = 0 THEN 'a hint' ELSE '' END,
  CAST(l_partkey % 1000 AS INT), CAST(l_suppkey % 2000 AS INT), CAST(l_partkey % 1000 + floor(l_quantity) AS INT),
  CAST(l_suppkey % 2000 + floor(l_quantity) % 40 AS INT), l_discount > 0.05, l_tax > 0.01, l_partkey % 11 = 0, false FROM lines""",
    "class_rules": """SELECT * FROM (VALUES (1, 'DecorView', 'screen', 'class:root', 0.9), (2, 'WebView', 'webview', 'class:webview', 0.9),
  (3, 'RecyclerView', 'list', 'class:list', 0.9), (3, 'ListView', 'list', 'class:list', 0.9), (4, 'GridView', 'grid', 'class:grid', 0.9),
  (5, 'ScrollView', 'scroll', 'class:scroll', 0.9), (6, 'CardView', 'card', 'class:card', 0.85), (7, 'EditText', 'input', 'class:input', 0.95),
  (8, 'CheckBox', 'checkbox', 'class:checkbox', 0.95), (9, 'Button', 'button', 'class:button', 0.95), (10, 'ImageView', 'image', 'class:image', 0.85),
  (11, 'TextView', 'text', 'class:text', 0.85), (12, 'Layout', 'generic', 'class:container', 0.6)) AS v(k, needle, role, source, confidence)""",
    "classes": """SELECT class_name, arg_min(role, k) AS role, arg_min(source, k) AS source, arg_min(confidence, k) AS confidence
FROM (SELECT DISTINCT class_name FROM screen) JOIN class_rules ON contains(split_part(class_name, '.', -1), needle) GROUP BY class_name""",
    "decided": """SELECT s.*, CASE WHEN clickable AND (c.role IS NULL OR c.role IN ('text', 'image', 'generic')) THEN 'button' ELSE coalesce(c.role, 'generic') END AS role,
  CASE WHEN clickable AND (c.role IS NULL OR c.role IN ('text', 'image', 'generic')) THEN 'attribute:clickable' ELSE coalesce(c.source, 'generic-fallback') END AS role_source,
  CASE WHEN clickable AND (c.role IS NULL OR c.role IN ('text', 'image', 'generic')) THEN 0.8 ELSE CAST(coalesce(c.confidence, 0.3) AS DOUBLE) END AS role_confidence
FROM screen s LEFT JOIN classes c USING (class_name)""",
    "promoted": """SELECT d.* REPLACE (
  CASE WHEN item THEN 'listitem' ELSE d.role END AS role,
  CASE WHEN item AND d.role = 'button' THEN 'structure:collection-item-clickable' WHEN item THEN 'structure:collection-item' ELSE d.role_source END AS role_source,
  CASE WHEN item THEN 0.75 ELSE d.role_confidence END AS role_confidence)
FROM (SELECT d.*, coalesce(p.item_click, false) AS parent_listens, coalesce(p.role IN ('list', 'grid')
  AND (d.role IN ('generic', 'card', 'section') OR d.role_source = 'attribute:clickable'), false) AS item
  FROM decided d LEFT JOIN decided p ON p.tree_id = d.tree_id AND p.node_id = d.parent_id) d""",
    "named": """SELECT *, trim(replace(split_part(resource_id, '/', -1), '_', ' ')) AS own,
  CASE role WHEN 'input' THEN coalesce(nullif(hint, ''), trim(replace(split_part(resource_id, '/', -1), '_', ' '))) WHEN 'text' THEN text
    ELSE coalesce(nullif(text, ''), trim(replace(split_part(resource_id, '/', -1), '_', ' '))) END AS name,
  CASE WHEN role = 'listitem' THEN CASE WHEN clickable THEN 'clickable' WHEN parent_listens THEN 'clickable=inferred' ELSE 'clickable=guessed' END END AS tier,
  r > l AND b > t AS valid FROM promoted""",
    "stated": """SELECT *, list_filter([CASE WHEN NOT enabled THEN 'disabled' END, CASE WHEN checked THEN 'checked' END,
  CASE WHEN role = 'input' AND text <> '' THEN 'value=' || text END, tier,
  CASE WHEN role = 'button' AND name = '' AND contains(split_part(class_name, '.', -1), 'Button') AND valid THEN 'needs_visual_desc' END],
  lambda x: x IS NOT NULL) AS states FROM named""",
    "counted": """SELECT s.*, coalesce(c.n, 0) AS children FROM stated s
  LEFT JOIN (SELECT tree_id, parent_id, count(*) AS n FROM stated WHERE parent_id IS NOT NULL GROUP BY ALL) c ON c.tree_id = s.tree_id AND c.parent_id = s.node_id""",
    "folds": "SELECT *, role = 'generic' AND name = '' AND len(states) = 0 AND children = 1 AS gone FROM counted",
    "gone_ids": "SELECT tree_id, list(node_id) AS ids FROM folds WHERE gone GROUP BY tree_id",
    "folded": """SELECT f.* EXCLUDE (path, depth, parent_id), list_filter(path, lambda p: NOT list_contains(coalesce(g.ids, []), p)) AS path,
  len(list_filter(path, lambda p: NOT list_contains(coalesce(g.ids, []), p))) AS depth,
  list_filter(path, lambda p: NOT list_contains(coalesce(g.ids, []), p))[-1] AS parent_id
FROM folds f LEFT JOIN gone_ids g USING (tree_id) WHERE NOT gone""",
    "acting": """SELECT tree_id, unnest(path) AS node_id FROM folded WHERE valid AND (role IN ('button', 'input', 'checkbox', 'radio', 'switch', 'slider', 'picker',
  'list', 'grid', 'scroll', 'webview') OR (role = 'listitem' AND tier IS NOT NULL))""",
    "busy": "SELECT DISTINCT tree_id, node_id FROM acting",
    "picked": """SELECT f.*, valid AND (role IN ('button', 'input', 'checkbox', 'radio', 'switch', 'slider', 'picker', 'list', 'grid', 'scroll', 'webview')
  OR (role = 'listitem' AND (tier IN ('clickable', 'clickable=inferred') OR (tier = 'clickable=guessed' AND b.node_id IS NULL)))) AS ok
FROM folded f LEFT JOIN busy b ON b.tree_id = f.tree_id AND b.node_id = f.node_id""",
    "reffed": "SELECT *, CASE WHEN ok THEN 'n' || count(*) FILTER (ok) OVER (PARTITION BY tree_id ORDER BY node_id) ELSE '' END AS ref FROM picked",
    "shown": """SELECT *, repeat('  ', CAST(depth AS INT)) || '- ' || role || CASE WHEN name <> '' THEN ' "' || name || '"' ELSE '' END
  || array_to_string(list_transform(states, lambda s: ' [' || s || ']'), '') || CASE WHEN ref <> '' THEN ' [ref=' || ref || '] [bounds=' || concat_ws(',', l, t, r, b) || ']' ELSE '' END
  || CASE WHEN coalesce(lead(depth) OVER (PARTITION BY tree_id ORDER BY node_id) > depth, false) THEN ':' ELSE '' END AS line FROM reffed""",
    "snaps": "SELECT tree_id, string_agg(line, chr(10) ORDER BY node_id) AS snapshot FROM shown GROUP BY tree_id",
    "boxes": """SELECT l_orderkey AS image, seq, CAST(l_partkey % 1000 AS DOUBLE) AS x1, CAST(l_suppkey % 2000 AS DOUBLE) AS y1, l_partkey % 1000 + l_quantity AS x2,
  l_suppkey % 2000 + l_quantity AS y2, CAST(floor(l_discount * 1000 + 0.5) AS BIGINT) AS score, CAST(l_partkey % 23 AS INT) AS class_id FROM lines""",
    "runs": """SELECT CAST(event_id AS VARCHAR) AS run_id, user_id AS baseline_id, event_type AS mode, ts AS created,
  CAST(CASE WHEN event_id % 17 = 0 THEN -1 ELSE floor(value + 0.5) END AS BIGINT) AS inference_ms FROM events""",
    "evidence": """SELECT * FROM (VALUES (0, 't1', 'e1', 'structural', 'checkbox', '', 2), (0, 't1', 'e2', 'textual_content', 'checkbox', 'NO', 1),
  (0, 't2', 'e3', 'actionable', 'button', '', 1), (1, 't1', 'e1', '', 'input', 'a hint', 1), (1, 't1', 'e2', 'semantic_label', 'generic', 'NF', 1),
  (1, 't3', 'e4', 'structural', 'card', '', 1), (1, 't3', 'e5', 'textual_content', '', 'RF', 1), (2, 't3', 'e6', '', '', '', 4), (2, 't1', 'e1', 'navigational', 'webview', '', 1), (2, 't2', 'e2', 'actionable', 'listitem', '', 3))
  AS v(baseline_id, target_id, evidence_id, capability, role, name, min_count)""",
    "run_nodes": "SELECT tree_id % 3 AS baseline_id, tree_id AS run_id, role, name FROM reffed",
    "met": """SELECT r.run_id, e.target_id, e.evidence_id, count(*) AS n FROM run_nodes r
  JOIN evidence e ON e.baseline_id = r.baseline_id AND (e.role = '' OR r.role = e.role) AND (e.name = '' OR r.name = e.name) GROUP BY ALL""",
    "matched": """SELECT w.run_id, e.*, coalesce(m.n, 0) AS actual_count FROM (SELECT DISTINCT baseline_id, run_id FROM run_nodes) w
  JOIN evidence e ON e.baseline_id = w.baseline_id LEFT JOIN met m ON m.run_id = w.run_id AND m.target_id = e.target_id AND m.evidence_id = e.evidence_id""",
    "judged": "SELECT *, CASE WHEN actual_count >= min_count THEN 'PASS' ELSE 'FAIL' END AS status FROM matched",
    "scored": """SELECT baseline_id, run_id, target_id, count(*) FILTER (status = 'PASS') AS passed, count(*) AS total FROM judged GROUP BY ALL""",
}


def needs(text: str) -> list[str]:
    """The views that ``text`` names, after those that they name themselves."""
    import re

    out: list[str] = []
    for word in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text)):
        if word in CTES:
            out += [n for n in [*needs(CTES[word]), word] if n not in out]
    return out


def sql(select: str) -> str:
    """A query with the views that it uses in front."""
    found = needs(select)
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in found) + "\n" if found else "") + select
