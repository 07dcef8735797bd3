"""Names and states of nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenloom.functions.geometry import valid
from screenloom.functions.roles import simple_name
from screenloom.functions.text import readable_resource_name


def filled(*values: Column) -> Column:
    """The first that is neither null nor empty, else ``''``."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values), F.lit(""))


def android_name(role: Column, text: Column, desc: Column, hint: Column, resource_id: Column) -> Column:
    own = readable_resource_name(resource_id)
    return F.when(role == "input", filled(hint, desc, own)).when(role == "text", filled(text, desc)).otherwise(filled(text, desc, own))


def ios_name(role: Column, text: Column, label: Column, placeholder: Column, identifier: Column) -> Column:
    return F.when(role == "input", filled(placeholder, label, identifier)).when(role == "text", filled(text, label)).otherwise(filled(text, label, identifier))


def harmony_name(role: Column, attrs: Column) -> Column:
    rest = [attrs[k] for k in ("label", "content", "accessibilityText", "accessibilityDescription")]
    return F.when(role == "input", filled(attrs["placeholder"], *rest)).otherwise(filled(*rest))


def states_of(*pairs: tuple[Column, str | Column]) -> Column:
    """The states that hold, in order."""
    return F.array_compact(F.array(*(F.when(test, F.lit(s) if isinstance(s, str) else s) for test, s in pairs)))


def native_states(role: Column, flags: dict[str, Column], text: Column) -> Column:
    return states_of(
        (~flags["enabled"], "disabled"),
        *((flags[k], k) for k in ("checked", "selected", "focused", "scrollable", "password")),
        ((role == "input") & (text != ""), F.concat(F.lit("value="), text)),
    )


def click_tier(role: Column, own: Column, parent_listens: Column, spelled: str = "clickable=") -> Column:
    """How sure it is that a list item can be clicked; null for other roles."""
    tier = F.when(own, F.lit("clickable")).when(parent_listens, F.lit(f"{spelled}inferred")).otherwise(F.lit(f"{spelled}guessed"))
    return F.when(role == "listitem", tier)


def needs_visual_desc(role: Column, name: Column, class_name: Column, bounds: Column) -> Column:
    return (role == "button") & (name == "") & F.contains(simple_name(class_name), F.lit("Button")) & valid(bounds)


#: HarmonyOS types that are clickable, checkable and selectable by nature.
HARMONY_CLICKABLE = """ListItem GridItem MenuItem Button Toggle Checkbox CheckboxGroup Radio RadioButton Stepper Select Slider
Rating Gauge Swiper Tabs TabContent DatePicker TimePicker TextPicker CalendarPicker""".split()
HARMONY_CHECKABLE = "Toggle Checkbox Radio RadioButton".split()
HARMONY_SELECTABLE = "ListItem GridItem MenuItem".split()


def harmony_clickable(kind: Column, role: Column, attrs: Column) -> Column:
    """``clickable`` by type, ``clickable-inferred`` by accessibility action, role or focus, else null."""
    action = F.contains(F.coalesce(attrs["accessibilityActionOptions"], F.lit("")), F.lit("ACCESSIBILITY_CLICK"))
    a11y = F.coalesce(attrs["accessibilityRole"].isin("BUTTON", "CHECKBOX", "RADIO"), F.lit(False))
    focus = is_true(attrs, "focusable") & ~role.isin("text", "image", "generic")
    return F.when(kind.isin(*HARMONY_CLICKABLE), F.lit("clickable")).when(action | a11y | focus, F.lit("clickable-inferred"))


def is_true(attrs: Column, name: str) -> Column:
    return F.coalesce(attrs[name] == "true", F.lit(False))


def harmony_states(kind: Column, role: Column, attrs: Column) -> Column:
    """Inputs scroll their own text, which is not shown."""
    tier = harmony_clickable(kind, role, attrs)
    return states_of(
        (F.coalesce(attrs["enabled"] == "false", F.lit(False)), "disabled"),
        (tier.isNotNull(), tier),
        (kind.isin(*HARMONY_CHECKABLE) & is_true(attrs, "selected"), "checked"),
        (kind.isin(*HARMONY_SELECTABLE) & is_true(attrs, "selected"), "selected"),
        (is_true(attrs, "scrollable") & (role != "input"), "scrollable"),
    )


def ios_states(role: Column, flags: dict[str, Column]) -> Column:
    """As on Android; gesture recognisers make a list item's click inferred."""
    tier = click_tier(role, flags["clickable"], flags["gestures"], "clickable-")
    return states_of((~flags["enabled"], "disabled"), (flags["checked"], "checked"), (flags["selected"], "selected"), (flags["scrollable"], "scrollable"), (tier.isNotNull(), tier))
