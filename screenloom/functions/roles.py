"""Roles of nodes, from ordered rules that are data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from screenloom.schema import ROLES

#: Fixed values. Android class-name rules in order: needles in the simple name, role, source, confidence.
ANDROID = [
    ("WebView", "webview", "class:webview", 0.9),
    ("Toolbar ActionBar AppBar", "toolbar", "class:toolbar", 0.9),
    ("TabLayout", "tabbar", "class:tabbar", 0.9),
    ("RecyclerView ListView", "list", "class:list", 0.9),
    ("GridView", "grid", "class:grid", 0.9),
    ("ScrollView", "scroll", "class:scroll", 0.9),
    ("CardView", "card", "class:card", 0.85),
    ("Dialog", "dialog", "class:dialog", 0.85),
    ("BottomSheet", "sheet", "class:sheet", 0.85),
    ("EditText", "input", "class:input", 0.95),
    ("CheckBox", "checkbox", "class:checkbox", 0.95),
    ("RadioButton", "radio", "class:radio", 0.95),
    ("Switch", "switch", "class:switch", 0.95),
    ("SeekBar Slider", "slider", "class:slider", 0.9),
    ("Spinner NumberPicker DatePicker TimePicker", "picker", "class:picker", 0.9),
    ("ProgressBar", "progress", "class:progress", 0.9),
    ("Button", "button", "class:button", 0.95),
    ("ImageView", "image", "class:image", 0.85),
    ("TextView", "text", "class:text", 0.85),
    ("Layout ViewGroup", "generic", "class:container", 0.6),
]
#: Fixed values. UIKit class-name rules in order.
UIKIT = [
    ("WKWebView UIWebView", "webview", "class:webview", 0.9),
    ("UINavigationBar UIToolbar", "toolbar", "class:toolbar", 0.9),
    ("UITabBar", "tabbar", "class:tabbar", 0.9),
    ("UISegmentedControl", "tabbar", "class:tabbar", 0.85),
    ("UICollectionView", "grid", "class:grid", 0.9),
    ("UITableView", "list", "class:list", 0.9),
    ("UIContextMenuCell", "listitem", "class:listitem", 0.9),
    ("UIScrollView", "scroll", "class:scroll", 0.9),
    ("UIAlertController UIAlertView UIActionSheet", "dialog", "class:dialog", 0.85),
    ("UITextField UITextView", "input", "class:input", 0.95),
    ("UISwitch", "switch", "class:switch", 0.95),
    ("UISlider", "slider", "class:slider", 0.9),
    ("UIPickerView UIDatePicker", "picker", "class:picker", 0.9),
    ("UIProgressView UIActivityIndicatorView NSProgressView", "progress", "class:progress", 0.9),
    ("UIButton", "button", "class:button", 0.95),
    ("UIImageView", "image", "class:image", 0.85),
    ("UILabel", "text", "class:text", 0.85),
    ("UIStackView UIView UIControl UIContentView ContentAreaView ContainerView BackgroundView WrapperView", "generic", "class:container", 0.6),
]
#: Fixed values. HarmonyOS component types: types, role, source, confidence.
HARMONY = [
    ("root RootNode", "screen", "type:root", 0.9),
    ("Button", "button", "type:button", 0.95),
    ("Toggle", "switch", "type:toggle", 0.95),
    ("Checkbox CheckboxGroup", "checkbox", "type:checkbox", 0.95),
    ("Radio RadioButton", "radio", "type:radio", 0.95),
    ("Slider Rating Gauge", "slider", "type:slider", 0.9),
    ("Select Stepper", "picker", "type:picker", 0.9),
    ("DatePicker TimePicker TextPicker CalendarPicker", "picker", "type:date-picker", 0.9),
    ("TextInput TextArea Search", "input", "type:input", 0.95),
    ("Text Span", "text", "type:text", 0.85),
    ("Image", "image", "type:image", 0.85),
    ("List", "list", "type:list", 0.9),
    ("Grid GridRow WaterFlow", "grid", "type:grid", 0.9),
    ("ListItem GridItem FlowItem", "listitem", "type:listitem", 0.9),
    ("Scroll", "scroll", "type:scroll", 0.9),
    ("Tabs TabContent", "tabbar", "type:tabbar", 0.85),
    ("TabBuilder", "tab", "type:tab", 0.85),
    ("Navigation NavBar NavDestination", "navigation", "type:navigation", 0.85),
    ("Progress LoadingProgress", "progress", "type:progress", 0.9),
    ("Web", "webview", "type:webview", 0.95),
    ("Divider", "separator", "type:separator", 0.85),
    ("Panel Sheet BindSheet", "sheet", "type:sheet", 0.85),
    ("Dialog AlertDialog CustomDialog", "dialog", "type:dialog", 0.85),
]
#: Fixed values. HarmonyOS accessibility roles.
HARMONY_A11Y = {
    "BUTTON": "button", "CHECKBOX": "checkbox", "RADIO": "radio", "SWITCH": "switch", "SLIDER": "slider", "IMAGE": "image",
    "TEXT": "text", "STATIC_TEXT": "text", "EDIT_TEXT": "input", "SEARCH": "input", "LIST": "list", "GRID": "grid",
    "PAGE": "screen", "TAB_BAR": "tabbar", "NAVIGATION_BAR": "toolbar", "PROGRESS_BAR": "progress",
}


def decision(role: str, source: str, confidence: float) -> Column:
    return F.struct(F.lit(role).alias("role"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))


def first_of(rules: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first rule that holds: one ``CASE``, evaluated inside generated code."""
    (test, value), *rest = rules
    out = reduce(lambda case, rule: case.when(*rule), rest, F.when(test, value))
    return out if otherwise is None else out.otherwise(otherwise)


def has_any(c: Column, needles: str) -> Column:
    return reduce(Column.__or__, [F.contains(c, F.lit(n)) for n in needles.split()])


def simple_name(class_name: Column) -> Column:
    return F.substring_index(class_name, ".", -1)


def _by_class(name: Column, exact: list[tuple[Column, Column]], rules: list[tuple]) -> Column:
    """The first rule of which the name holds a needle. Rules are a list that is searched: as a ``CASE`` they make code too long for the JVM to compile."""
    listed = F.array(*(F.struct(F.array(*map(F.lit, needles.split())).alias("needles"), decision(*to).alias("to")) for needles, *to in rules))
    fits = F.filter(listed, lambda rule: F.exists(rule["needles"], lambda needle: F.contains(name, needle)))
    return first_of(exact, F.get(fits, F.lit(0))["to"])


def _adjusted(found: Column, rules: list[tuple[Column, str, Column]], said: Column) -> Column:
    """Attributes overrule weak classes; without a class, text decides."""
    role = found["role"]
    free = F.coalesce(found["source"] != "class:webview", F.lit(True))
    changed = [(free & test & (role.isNull() | role.isin(*over)), value) for test, over, value in rules]
    return first_of([*changed, (found.isNotNull(), found), (said, decision("text", "text-or-desc-fallback", 0.55))], decision("generic", "generic-fallback", 0.3))


def android_class(name: Column) -> Column:
    """The decision on a class by its simple name alone; null if no rule fits."""
    return _by_class(name, [(name == "DecorView", decision("screen", "class:root", 0.9))], ANDROID)


def android_adjusted(found: Column, text: Column, desc: Column, clickable: Column, touch: Column, scrollable: Column, editable: Column) -> Column:
    """``found``, the decision on the class, as the attributes change it."""
    rules = [
        (clickable | touch, ["text", "image", "generic"], decision("button", "attribute:clickable", 0.8)),
        (scrollable, ["generic"], decision("scroll", "attribute:scrollable", 0.7)),
        (editable, ["generic", "text"], decision("input", "attribute:editable", 0.75)),
    ]
    return _adjusted(found, rules, (text != "") | (desc != ""))


def android_role(class_name: Column, *attributes: Column) -> Column:
    """``struct<role, source, confidence>``. ``attributes``: text, description, clickable (long clicks too), an own touch handler, scrollable, editable.

    One expression, in which the class is decided wherever it is named; ``native.with_roles`` decides it once a node.
    """
    return android_adjusted(android_class(simple_name(class_name)), *attributes)


def ios_role(class_name: Column, text: Column, label: Column, clickable: Column, scrollable: Column) -> Column:
    """As on Android, by UIKit's classes. A class whose name holds that of its collection counts as the collection."""
    name = simple_name(class_name)
    root = (name.isin("UIWindow", "UIDropShadowView"), decision("screen", "class:root", 0.9))
    found = _by_class(name, [root], UIKIT)
    rules = [
        (clickable, ["text", "image", "generic"], decision("button", "attribute:clickable", 0.8)),
        (scrollable, ["generic"], decision("scroll", "attribute:scrollable", 0.7)),
    ]
    return _adjusted(found, rules, (text != "") | (label != ""))


def harmony_role(kind: Column, attrs: Column) -> Column:
    """By the exact type, else the accessibility role, else by whether there is text."""
    rules = [(kind.isin(*types.split()), decision(*to)) for types, *to in HARMONY]
    a11y = attrs["accessibilityRole"]
    rules += [(a11y == k, decision(role, "attr:accessibilityRole", 0.85)) for k, role in HARMONY_A11Y.items()]
    said = (F.coalesce(attrs["content"], F.lit("")) != "") | (F.coalesce(attrs["accessibilityText"], F.lit("")) != "")
    return first_of([*rules, (said, decision("text", "text-or-label-fallback", 0.55))], decision("generic", "generic-fallback", 0.3))


def map_role(wire: Column) -> Column:
    """A wire role in the vocabulary; unknown ones are generic."""
    return F.when(wire.isin(*ROLES), wire).otherwise(F.lit("generic"))
