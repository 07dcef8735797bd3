"""The outline of a page: its tokens put into a tree with a stack of tag names, and what elements say.

One pass over the tokens of a page places them as a parser does: some start tags end what is open (a paragraph, a list
item, a cell), an end tag ends the element of its name if one is open in its scope, and any other end tag is ignored. The
page's texts are laid side by side in streams, so what an element says is a slice between two places in them.
"""

from __future__ import annotations

from array import array
from html import unescape

import pyarrow as pa

#: What a token does to the tree: text, an element without content, one that opens, one that closes, something that is no
#: node but stands between texts (comments, scripts, marks), or an element that ends itself inside a drawing.
TEXT, LEAF, OPEN, CLOSE, OTHER, SELF = range(6)
#: Elements that are open at a time, as browsers bound it: what is deeper stands beside the last one.
MOST_OPEN = 512
#: Start tags that end an open paragraph.
ENDS_PARAGRAPH = frozenset("""address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
h5 h6 header hgroup hr li listing main menu nav ol p pre search section summary table ul xmp""".split())
HEAD, PARAGRAPH = frozenset(["head"]), frozenset(["p"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an end tag doesn't look beyond, for paragraphs and for list items.
SCOPE = frozenset("caption html marquee object table td template th".split())
BUTTON_SCOPE, LIST_SCOPE = SCOPE | {"button"}, SCOPE | {"ol", "ul", "menu"}
TABLE_SCOPE = frozenset("html table template".split())
#: Elements that an end tag of another, plain element doesn't close.
SPECIAL = frozenset("""address article aside blockquote body button caption center col colgroup dd details dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html iframe li listing main marquee menu nav object ol p pre search section select summary
table tbody td template textarea tfoot th thead title tr ul xmp""".split())
#: Start tags that end elements of the given names, as far as the scope goes.
ENDS = {
    "li": (frozenset(["li"]), LIST_SCOPE), "dt": (frozenset(["dt", "dd"]), SCOPE | {"dl"}), "dd": (frozenset(["dt", "dd"]), SCOPE | {"dl"}), "option": (frozenset(["option"]), SCOPE | {"select", "datalist", "optgroup"}),
    "optgroup": (frozenset(["optgroup"]), SCOPE | {"select", "datalist"}), "button": (frozenset(["button"]), SCOPE), "a": (frozenset(["a"]), SCOPE),
    "td": (frozenset(["td", "th"]), TABLE_SCOPE | {"tr"}), "th": (frozenset(["td", "th"]), TABLE_SCOPE | {"tr"}), "tr": (frozenset(["tr", "caption", "colgroup"]), TABLE_SCOPE),
    "thead": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), TABLE_SCOPE), "tbody": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), TABLE_SCOPE),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), TABLE_SCOPE),
}
#: Elements that may stand in a head; elements of which nothing is shown.
IN_HEAD = frozenset("base link meta title template noscript script style".split())
HIDDEN = frozenset("head template meta link".split())
#: The element below another that names it.
NAMERS = {"caption": "table", "figcaption": "figure", "legend": "fieldset", "summary": "details", "title": "svg"}
#: Elements that a page has once, however often they begin.
ONCE = ("html", "body")
#: Elements in which a tag may end itself.
DRAWN = ("svg", "math")
#: An element's own slice isn't what it says to others.
CONTROLS = frozenset("select option optgroup textarea".split())
#: Characters of content that a name may need.
SAID = 202
#: Bits of a token's marks: disabled, selected, several options at once, disabled for assistive technology.
IS_OFF, SELECTED, MULTIPLE, ARIA_OFF = 1, 2, 4, 8

PLACED = "array<struct<at:int,made:string,text:string,depth:int,path:array<int>,sibling_pos:int,last:int,only_text:boolean,off:boolean,chosen:boolean,table:int,picked:int,spoken:string,labelled:string,by_for:string,wrapped:string,inner:string>>"
FIELDS = ["at", "made", "text", "depth", "path", "sibling_pos", "last", "only_text", "off", "chosen", "table", "picked", "spoken", "labelled", "by_for", "wrapped", "inner"]
KINDS = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()]


class Streams:
    """Texts side by side: as they are, trimmed, and with controls saying their values."""

    def __init__(self):
        self.parts: tuple[list[str], ...] = ([], [], [])
        self.size = [0, 0, 0]

    def put(self, stream: int, text: str) -> None:
        self.parts[stream].append(text)
        self.size[stream] += len(text)

    def whole(self) -> list[str]:
        return ["".join(p) for p in self.parts]


class Outline:
    """The nodes of one page. Elements that are no nodes (hidden, or too deep) have the number -1 and still have slices."""

    def __init__(self, max_depth: int | None):
        self.max_depth = max_depth
        self.rows: list[list] = []
        self.streams = Streams()
        #: Open elements: tag, node, element number.
        self.stack: list[tuple[str, int, int]] = []
        self.begin: list[tuple[int, int, int]] = []
        self.end: list[tuple[int, int, int] | None] = []
        self.element: list[int] = []
        self.tag: list[str] = []
        self.open_tags: dict[str, int] = {}
        self.concealing: list[bool] = []
        self.children: dict[int, int] = {}
        self.hidden = self.selects = 0
        self.last_text: list | None = None

    def conceals(self, tag: str) -> bool:
        """Nothing of the element is shown; the title of a drawing names it and no more."""
        return tag in HIDDEN or (tag == "title" and bool(self.open_tags.get("svg")))

    def top(self) -> int:
        return self.stack[-1][2] if self.stack else -1

    def add(self, at: int, made: str | None, tag: str) -> tuple[int, int]:
        """A new element: its node (-1 if it isn't shown) and its number."""
        self.last_text = None
        number = len(self.begin)
        self.children[self.top()] = self.children.get(self.top(), 0) + 1
        self.begin.append(tuple(self.streams.size))
        self.end.append(None)
        self.tag.append(tag)
        depth = len(self.stack)
        if self.hidden or self.conceals(tag) or (self.max_depth is not None and depth > self.max_depth):
            self.element.append(-1)
            return -1, number
        table = next((k for t, k, _ in reversed(self.stack) if t == "table"), -1) if tag == "td" else -1
        self.element.append(len(self.rows))
        self.rows.append([at, made, "", depth, [n for _, n, _ in self.stack], number, self.rows[table][0] if table >= 0 else -1])
        return len(self.rows) - 1, number

    def open(self, at: int, tag: str, made: str | None = None) -> int:
        if len(self.stack) >= MOST_OPEN:
            self.pop(MOST_OPEN - 1)
        node, number = self.add(at, made, tag)
        self.concealing.append(self.conceals(tag))
        self.stack.append((tag, node, number))
        self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
        self.hidden += self.concealing[-1]
        self.selects += tag == "select"
        return number

    def pop(self, size: int) -> None:
        """Close all that stands from ``size`` on."""
        while len(self.stack) > size:
            tag, _, number = self.stack.pop()
            self.end[number] = tuple(self.streams.size)
            self.open_tags[tag] -= 1
            self.hidden -= self.concealing.pop()
            self.selects -= tag == "select"
        self.last_text = None

    def find(self, names: frozenset, scope: frozenset) -> int:
        """The place of the innermost open element of ``names`` before any of ``scope``, or -1."""
        if not any(self.open_tags.get(t) for t in names):
            return -1
        for k in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[k][0]
            if tag in names:
                return k
            if tag in scope:
                break
        return -1

    def text(self, at: int, said: str) -> None:
        plain = said.strip()
        if plain and self.stack and self.stack[-1][0] == "head":
            self.pop(len(self.stack) - 1)
        self.streams.put(0, said)
        if plain:
            one = " ".join(plain.split()) + " "
            self.streams.put(1, one)
            drawn = self.open_tags.get("svg") and self.stack[-1][0] == "title"
            if not self.selects and not drawn:
                self.streams.put(2, one)
        if self.last_text is not None:  # a tag that was ignored stood between: one text for the reader
            self.last_text[2] += said
            return
        self.children[self.top()] = self.children.get(self.top(), 0) + 1
        self.last_text = [at, None, said, len(self.stack), [], -1, -1]
        if not self.hidden and (self.max_depth is None or len(self.stack) <= self.max_depth):
            self.last_text[4] = [n for _, n, _ in self.stack]
            self.rows.append(self.last_text)

    def start(self, at: int, tag: str, leaf: bool) -> int:
        """The element's number. What a start tag ends is closed first, and a table's missing parts are made."""
        if tag not in IN_HEAD and (k := self.find(HEAD, SCOPE)) >= 0:
            self.pop(k)
        if tag in ENDS_PARAGRAPH and (k := self.find(PARAGRAPH, BUTTON_SCOPE)) >= 0:
            self.pop(k)
        if tag == "optgroup" and self.stack and self.stack[-1][0] == "option":
            self.pop(len(self.stack) - 1)
        if tag in ENDS and (k := self.find(*ENDS[tag])) >= 0:
            self.pop(k)
        if tag in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
            self.pop(len(self.stack) - 1)
        above = self.stack[-1][0] if self.stack else ""
        if tag in ("tr", "td", "th") and above == "table":
            self.open(-1, "tbody", "tbody")
        if tag in ("td", "th") and self.stack and self.stack[-1][0] in ("tbody", "thead", "tfoot"):
            self.open(-1, "tr", "tr")
        if leaf:
            number = self.add(at, None, tag)[1]
            self.end[number] = tuple(self.streams.size)
            return number
        return self.open(at, tag)

    def close(self, tag: str) -> None:
        """An end tag. It is ignored if no element of its name is open in its scope; a body goes on to the end of its page."""
        if tag in ONCE:
            return
        if tag in HEADINGS:
            k = self.find(HEADINGS, SCOPE)
        elif tag == "li":
            k = self.find(frozenset(["li"]), LIST_SCOPE)
        elif tag == "p":
            k = self.find(PARAGRAPH, BUTTON_SCOPE)
            if k < 0:  # a paragraph's end alone is a whole one
                self.open(-1, "p", "p")
                k = len(self.stack) - 1
        elif tag in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"):
            k = self.find(frozenset([tag]), TABLE_SCOPE - {tag})
        else:
            k = self.find(frozenset([tag]), SCOPE - {tag} if tag in SPECIAL else SPECIAL - {tag})
        if k >= 0:
            self.pop(k)


def page(kinds: list, tags: list, texts: list, ids: list, fors: list, refs: list, marks: list, max_depth: int | None) -> list[list]:
    """The columns of ``FIELDS`` of one page."""
    out, streams = Outline(max_depth), None
    streams = out.streams
    by_id: dict[str, int] = {}
    label_for: dict[str, int] = {}
    labels: dict[int, int] = {}
    namers: dict[int, int] = {}
    #: By select element: the first option, the one chosen last, the first chosen, and whether several may be.
    options: dict[int, list] = {}
    picked: dict[int, int] = {}
    seen: set[str] = set()
    for at, kind in enumerate(kinds):
        tag = tags[at]
        if kind == TEXT:
            out.text(at, unescape(texts[at]) if "&" in texts[at] else texts[at])
            continue
        if kind == OTHER:
            out.children[out.top()] = out.children.get(out.top(), 0) + 1
            out.last_text = None
            continue
        open_selects = [n for t, _, n in out.stack if t == "select"] if out.selects else []
        if kind == CLOSE:
            out.close(tag)
        else:
            if tag in seen and tag in ONCE or tag == "html" and seen:
                continue
            seen.add(tag)
            if kind == SELF:
                kind = LEAF if tag in DRAWN or any(map(out.open_tags.get, DRAWN)) else OPEN
            number = out.start(at, tag, kind == LEAF)
            if kind == LEAF and texts[at]:
                one = " ".join(texts[at].split()) + " "
                if not out.selects:
                    streams.put(2, one)
            if ids[at] and ids[at] not in by_id:
                by_id[ids[at]] = number
            if tag == "label" and fors[at] and fors[at] not in label_for:
                label_for[fors[at]] = number
            node = out.element[number]
            if tag in NAMERS:
                for t, _, n in out.stack[: len(out.stack) - (kind == OPEN)]:
                    if t == NAMERS[tag]:
                        namers.setdefault(n, number)
            if node >= 0:
                near = next((n for t, _, n in reversed(out.stack) if t == "label"), None)
                if near is not None:
                    labels[node] = near
            if tag == "select":
                options[number] = [-1, -1, -1, bool(marks[at] & MULTIPLE)]
                picked[number] = -1
            elif tag == "option":
                owner = next((n for t, _, n in reversed(out.stack) if t == "select"), None)
                if owner is not None:
                    held = options[owner]
                    if held[0] < 0 and not marks[at] & IS_OFF:
                        held[0] = number
                    if marks[at] & SELECTED:
                        held[1] = number
                        held[2] = number if held[2] < 0 else held[2]
        for n in open_selects:
            if out.end[n] is not None:
                picked[n] = choose(out, options[n])
    left = [n for t, _, n in out.stack if t == "select"]
    out.pop(0)
    for n in left:
        picked[n] = choose(out, options[n])
    return finished(out, by_id, label_for, labels, namers, picked, {n for n, held in options.items() if held[3]}, ids, refs, marks)


def choose(out: Outline, held: list) -> int:
    """A select that has ended says its chosen option, whose number it is."""
    first, last, earliest, several = held
    chosen = earliest if several else last if last >= 0 else first
    if chosen >= 0:
        a, b = out.begin[chosen][1], out.end[chosen][1]
        said, at = [], 0
        # the option's words are the last pieces of the trimmed stream that begin at or after its own place
        for piece in reversed(out.streams.parts[1]):
            at += len(piece)
            place = out.streams.size[1] - at
            if place < a:
                break
            if place < b:
                said.append(piece)
        if said:
            out.streams.put(2, "".join(reversed(said)))
    return chosen


def finished(out: Outline, by_id: dict, label_for: dict, labels: dict, namers: dict, picked: dict, several: set, ids: list, refs: list, marks: list) -> list[list]:
    rows, n = out.rows, len(out.rows)
    plain, trimmed, spoken = out.streams.whole()
    begin, end = out.begin, out.end
    content = lambda number: plain[begin[number][0] : end[number][0]].strip()
    last = list(range(n))
    for k in range(n - 1, -1, -1):
        if rows[k][4] and rows[k][4][-1] >= 0:
            parent = rows[k][4][-1]
            last[parent] = max(last[parent], last[k])
    # what is switched off below an element is so from the next node to its last one, but for a fieldset's legend
    change = [0] * (n + 2)

    def off(first: int, to: int, by: int) -> None:
        if first <= to:
            change[first] += by
            change[to + 1] -= by

    for k, row in enumerate(rows):
        if row[5] >= 0 and row[0] >= 0:
            if marks[row[0]] & ARIA_OFF:
                off(k + 1, last[k], 1)
            elif marks[row[0]] & IS_OFF and (legend := namers.get(row[5])) is not None:
                off(k + 1, last[k], 1)
                if (inner := out.element[legend]) >= 0:
                    off(inner, last[inner], -1)
    columns: list[list] = [[] for _ in FIELDS]
    depth_off, met = 0, {}
    chosen = set(picked.values())
    in_several = {k for n in several if (k := out.element[n]) >= 0}
    for k, (at, made, text, depth, path, number, table) in enumerate(rows):
        depth_off += change[k]
        parent = path[-1] if path else -1
        met[parent] = met.get(parent, -1) + 1
        ask = refs[at] if at >= 0 and number >= 0 else ""
        told = " ".join(t for r in ask.split() if r in by_id and (t := content(by_id[r]))) if ask else ""
        own_id = ids[at] if at >= 0 and number >= 0 else ""
        said = inner = ""
        is_chosen, pick = False, -1
        if number >= 0:
            tag = out.tag[number]
            stream, which = (trimmed, 1) if tag in CONTROLS else (spoken, 2)
            low, high = begin[number][which], end[number][which]
            said = stream[low : min(high, low + SAID)].strip()
            if number in namers:
                inner = content(namers[number])
            elif tag == "textarea":
                inner = plain[begin[number][0] : end[number][0]].removeprefix("\n")
            elif tag == "output":
                inner = plain[begin[number][0] : end[number][0]]
            elif tag == "option":
                inner = trimmed[begin[number][1] : end[number][1]].strip()
                free = not any(out.tag[rows[p][5]] == "select" for p in path)
                is_chosen = number in chosen or (bool(marks[at] & SELECTED) and (free or any(p in in_several for p in path)))
            elif tag == "select" and picked[number] >= 0:
                inner = trimmed[begin[picked[number]][1] : end[picked[number]][1]].strip()
                pick = rows[out.element[picked[number]]][0] if out.element[picked[number]] >= 0 else -1
        values = (
            at, made, text.strip(), depth, path, met[parent], last[k], number >= 0 and out.children.get(number, 0) == 1 and k + 1 < n and last[k] == k + 1 and rows[k + 1][5] < 0, depth_off > 0, is_chosen, table, pick, said, told,
            content(label_for[own_id]) if own_id in label_for else "", content(labels[k]) if k in labels else "", inner,
        )
        for column, value in zip(columns, values, strict=True):
            column.append(value)
    blank = [k for k in range(n) if rows[k][5] < 0 and not columns[2][k]]
    return without(columns, set(blank)) if blank else columns


def without(columns: list[list], gone: set[int]) -> list[list]:
    """The nodes without some leaves: blank texts. Numbers, last nodes and places among siblings are made anew."""
    number, new = [], 0
    for k in range(len(columns[0])):
        number.append(new)
        new += k not in gone
    kept = [k for k in range(len(columns[0])) if k not in gone]
    out = [[c[k] for k in kept] for c in columns]
    out[4] = [[number[p] for p in path] for path in out[4]]
    # the last node below that stays: the one before the next number
    out[6] = [number[x] - (x in gone) for x in out[6]]
    met: dict[int, int] = {}
    for i, path in enumerate(out[4]):
        parent = path[-1] if path else -1
        met[parent] = met.get(parent, -1) + 1
        out[5][i] = met[parent]
    return out


def outlines(*arrays: pa.Array, max_depth: int | None) -> pa.Array:
    """The nodes of each page, from arrays of its tokens' kinds, tags, texts, ids, label targets, references and marks."""
    columns: list = [[] for _ in FIELDS]
    sizes = array("i", [0])
    for tokens in zip(*(a.to_pylist() for a in arrays), strict=True):
        found = page(*((t or []) for t in tokens), max_depth)
        for column, new in zip(columns, found, strict=True):
            column.extend(new)
        sizes.append(len(columns[0]))
    rows = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], FIELDS)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), rows)
