"""The contract of every operator: one row per node of a tree.

``nodes``: tree_id, source, node_id (pre-order, 0 = root), parent_id, depth, path (ancestors from the root), sibling_pos,
role, role_source, role_confidence, name, text, content_desc, resource_id, class_name, bounds, states, web_idx, ref.
Strings are never null; bounds may be.
"""

from __future__ import annotations

BOUNDS = "struct<left:int,top:int,right:int,bottom:int>"

#: The role vocabulary.
ROLES = """screen toolbar tabbar tab list grid listitem scroll card section dialog sheet text image button input checkbox
radio switch slider picker progress generic webview link heading navigation textbox searchbox spinbutton combobox listbox
table row cell columnheader rowheader form article complementary blockquote caption group term definition separator meter
option status paragraph rowgroup""".split()

#: Roles that can be acted on and so get a ref in a native tree.
REF_ROLES = "button input checkbox radio switch slider picker list grid scroll webview".split()

RAW_FLAGS = "clickable long_clickable editable scrollable checked selected focused password enabled on_click item_click item_touch touch_override".split()
