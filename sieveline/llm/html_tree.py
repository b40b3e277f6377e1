"""HTML to a tree with implied tags, and the tree to the text that a reader sees."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from html import unescape

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Their content is text up to their own end tag.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext"}
#: Never drawn.
UNSEEN = {"head", "script", "style", "template", "noscript", "title", "iframe", "noembed", "noframes", "datalist", "object", "audio", "video", "canvas", "annotation", "annotation-xml", "area", "base", "link", "meta", "param", "source", "track", "colgroup", "col"}
#: Start tags that end an open paragraph.
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul"}
BLOCK = ENDS_P | {"body", "html", "li", "dt", "dd", "caption", "legend", "optgroup", "option", "tr", "thead", "tbody", "tfoot"}
#: Blocks with an empty line around them.
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "dl", "menu", "dir", "table", "figure", "hr"}
#: What a start tag ends first, if open up to the nearest of the stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
_STOPS = {"table", "td", "th", "caption", "body", "html", "button", "object", "template"}
#: Parts of a table, whose end tags reach out of cells.
_PARTS = {"table", "tr", "tbody", "thead", "tfoot"}

#: Quotes enclose only a value right after its "="; any other quote is a character of a name or value.
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|$))|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"?|'[^']*+'?|[^\s>\"'][^\s>]*+)?)?)*+)>?", re.S)
_ATTR = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>\"'][^\s>]*))?)?")
_SHOWN = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([\w-]+)\s*(!\s*important)?", re.I)
#: Where svg keeps what it draws only by reference, or not at all.
_KEPT = {"defs", "symbol", "clippath", "mask", "pattern", "marker", "desc", "metadata"}
#: Characters of indentation before a line at most.
WIDEST = 200
#: The screen that media queries are asked for, in px.
SCREEN = 1280
#: One element of a selector: a tag, and ids, classes and attributes that it must have.
_COMPOUND = re.compile(r"(?P<tag>[a-z][\w-]*|\*)?(?P<more>(?:[.#][\w-]+|\[\s*[\w-]+\s*(?:=\s*(?:\"[^\"]*\"|'[^']*'|[\w-]+)\s*)?\])*)")
_MORE = re.compile(r"([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*[\"']?([^\"'\]]*?)[\"']?\s*)?\]")


class Node:
    __slots__ = ("tag", "attrs", "children", "foreign")

    def __init__(self, tag: str, attrs: dict[str, str], foreign: bool = False):
        self.tag, self.attrs, self.children, self.foreign = tag, attrs, [], foreign


class Open:
    """The open elements, with the places of each tag among them, so that looking for one does not walk through all."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], defaultdict(list)
        self.at[root.tag].append(0)

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        """End the element at a place and all within it."""
        while len(self.nodes) > at:
            self.at[self.nodes.pop().tag].pop()

    def nearest(self, tags: set[str]) -> int:
        """The place of the innermost of the tags; 0, the root's, for none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, tags: set[str], stops: set[str]) -> None:
        """End the outermost of the tags above the nearest stop."""
        stop = self.nearest(stops)
        found = []
        for t in tags:
            places = self.at.get(t)
            if places and places[-1] > stop:
                found.append(places[bisect_right(places, stop)])
        if found:
            self.cut(min(found))


def parse(html: str) -> tuple[Node, str]:
    """The tree of a page and the text of its style sheets. Any input gives a tree."""
    root = Node("html", {})
    open_, styles, at = Open(root), [], 0
    nodes = open_.nodes

    def text(part: str) -> None:
        if not part:
            return
        if nodes[-1].tag == "head" and not part.isspace():
            open_.close({"head"}, set())
        nodes[-1].children.append(unescape(part) if "&" in part else part)

    while found := _TOKEN.search(html, at):
        text(html[at : found.start()])
        at = found.end()
        end, start = found[1], found[2]
        if end:
            tag = end.lower()
            if tag == "br":
                nodes[-1].children.append(Node("br", {}))
            elif tag not in ("html", "body"):
                own = open_.nearest({tag})
                if own and own >= open_.nearest({"table"} if tag in _PARTS else _STOPS):
                    open_.cut(own)
                elif tag == "p":
                    nodes[-1].children.append(Node("p", {}))
        elif start:
            tag = start.lower()
            attrs = {}
            if found[3].strip(" /\n\t\r\f"):
                for m in _ATTR.finditer(found[3]):
                    attrs.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
            if tag == "html" or tag == "body" and open_.nearest({"body"}):
                continue
            if tag in ENDS_P:
                open_.close({"p"}, _STOPS)
            if tag in IMPLIED:
                open_.close(*IMPLIED[tag])
            if nodes[-1].tag == "head" and tag not in UNSEEN:
                open_.close({"head"}, set())
            if tag in ("td", "th") and nodes[-1].tag in ("table", "thead", "tbody", "tfoot"):
                row = Node("tr", {})
                nodes[-1].children.append(row)
                open_.push(row)
            node = Node(tag, attrs, tag in ("svg", "math") or nodes[-1].foreign and tag != "foreignobject")
            nodes[-1].children.append(node)
            if tag in VOID or node.foreign and found[3].endswith("/"):
                continue
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>]|$)[^>]*>?", re.I).search(html, at) if tag != "plaintext" else None
                inner = html[at : stop.start()] if stop else html[at:]
                at = stop.end() if stop else len(html)
                if tag == "style":
                    styles.append(inner)
                elif inner:
                    node.children.append(unescape(inner) if tag in ("textarea", "title") else inner)
                continue
            open_.push(node)
    text(html[at:])
    return root, "\n".join(styles)


def on_screen(query: str) -> bool:
    """Whether one of the media queries holds for a screen; one with features other than widths does not."""

    def holds(one: str) -> bool:
        for part in re.split(r"\band\b", one):
            part = part.strip().removeprefix("only ").strip()
            width = re.fullmatch(r"\(\s*(min|max)-width\s*:\s*([\d.]+)(px|em|rem)\s*\)", part)
            if width and re.fullmatch(r"\d+(?:\.\d+)?", width[2]):
                px = float(width[2]) * (1 if width[3] == "px" else 16)
                if (SCREEN < px) if width[1] == "min" else (SCREEN > px):
                    return False
            elif part not in ("", "all", "screen", "not print", "not speech"):
                return False
        return True

    return any(holds(q.strip()) for q in query.lower().split(","))


class Styles:
    """The rules of style sheets that say what is drawn: display and visibility.

    Selectors are made of tags, ids, classes and attributes, within (space) and
    right within (>) others; rules with any other part of a selector are left
    out. Rules within at-rules count only in @layer and in @media for a screen.
    Every beginning of a selector is one bit of a number; an element's matches
    follow from its own, its parent's and those of all around it, so no element
    looks up through its ancestors.
    """

    def __init__(self, styles: str):
        self.by_name: dict[str, list[int]] = defaultdict(list)  # "#id", ".class", tag or "*": the bits to test
        self.tests: list[tuple] = []  # of each bit: tag, ids, classes, attributes, "" or " " or ">" before it
        self.rules: dict[int, list[tuple]] = defaultdict(list)  # of a last bit: (property, rank, whether it hides)
        open_: list[tuple[str, bool]] = []  # selectors or at-rule of each open block, and whether it applies
        within = 0  # open blocks of style rules
        parts = re.split(r"([{}])", re.sub(r"/\*.*?\*/", "", styles, flags=re.S)) if styles else []
        for k in range(0, len(parts) - 1, 2):
            text, sign = parts[k], parts[k + 1]
            if sign == "{":
                name = text.rsplit(";", 1)[-1].replace("<!--", "").replace("-->", "").strip().lower()
                at = re.match(r"@([\w-]+)(.*)", name, re.S)
                ok = not at or at[1] == "layer" or at[1] == "media" and on_screen(at[2])
                open_.append((name, ok and (not open_ or open_[-1][1])))
                within += not at
            elif open_:
                name, ok = open_.pop()
                if name.startswith("@"):
                    continue
                within -= 1
                # A rule within a style rule has selectors relative to it.
                if ok and not within and (shown := _SHOWN.findall(text)):
                    for one in re.split(r",(?![^\[]*\])", name):
                        self._add(one.strip(), k, shown)

    def _add(self, selector: str, k: int, shown: list[tuple]) -> None:
        parts = re.split(r"(\s*>\s*|\s+)(?![^\[]*\])", selector)
        bits, weight = [], [0, 0, 0]
        tests = []
        for j in range(0, len(parts), 2):
            found = _COMPOUND.fullmatch(parts[j])
            if not found or not parts[j]:
                return
            more = _MORE.findall(found["more"])
            tag = found["tag"] if found["tag"] != "*" else None
            ids, classes = ([n for s, n, *_ in more if s == sign] for sign in "#.")
            attrs = [(a, v) for s, _, a, v in more if not s]
            before = (">" if ">" in parts[j - 1] else " ") if j else ""
            tests.append((tag, ids, classes, attrs, before))
            for i, n in enumerate((len(ids), len(classes) + len(attrs), int(bool(tag)))):
                weight[i] += n
        for test in tests:
            tag, ids, classes = test[:3]
            self.by_name[f"#{ids[0]}" if ids else f".{classes[0]}" if classes else tag or "*"].append(len(self.tests))
            bits.append(len(self.tests))
            self.tests.append(test)
        for j, (prop, value, important) in enumerate(shown):
            prop, value = prop.lower(), value.lower()
            hides = value == "none" if prop == "display" else value in ("hidden", "collapse")
            self.rules[bits[-1]].append((prop, (bool(important), False, *weight, k, j), hides))

    def matches(self, node: Node, around: int, parent: int) -> int:
        """The bits that an element matches, given those matched by any element around it, and by its parent."""
        a, out = node.attrs, 0
        if not self.tests:
            return 0
        own_id, own = a.get("id", "").lower(), set(a.get("class", "").lower().split())
        for name in (node.tag, "*", f"#{own_id}", *(f".{c}" for c in own)):
            for bit in self.by_name.get(name, ()):
                tag, ids, classes, attrs, before = self.tests[bit]
                if (not tag or tag == node.tag) and all(i == own_id for i in ids) and own.issuperset(classes) and all(n in a and (not v or a[n].lower() == v) for n, v in attrs):
                    if not before or (parent if before == ">" else around) >> (bit - 1) & 1:
                        out |= 1 << bit
        return out

    def look(self, node: Node, bits: int) -> tuple[bool, bool | None]:
        """Whether an element is not drawn at all, and whether it says that it is visible (None: as what is around it)."""
        a = node.attrs
        if node.tag in UNSEEN or (node.tag == "input" and a.get("type", "").lower() == "hidden") or (node.tag == "dialog" and "open" not in a):
            return True, None
        said: dict[str, tuple] = {"display": ((), True)} if "hidden" in a else {}
        if bits:
            for bit in self.rules:
                if bits >> bit & 1:
                    for prop, rank, hides in self.rules[bit]:
                        said[prop] = max(said.get(prop, ((),)), (rank, hides))
        if "style" in a:
            for j, (prop, value, important) in enumerate(_SHOWN.findall(a["style"])):
                prop, value = prop.lower(), value.lower()
                hides = value == "none" if prop == "display" else value in ("hidden", "collapse")
                said[prop] = max(said.get(prop, ((),)), ((bool(important), True, 0, 0, 0, 0, j), hides))
        return said.get("display", ((), False))[1], not said["visibility"][1] if "visibility" in said else None


State = tuple[int, int, bool]  # bits matched around, bits of the parent, whether what is around is visible


def enter(node: Node, styles: Styles, state: State) -> State | None:
    """The state within an element, or None if it is not drawn."""
    around, parent, visible = state
    bits = styles.matches(node, around, parent)
    gone, says = styles.look(node, bits)
    return None if gone else (around | bits, bits, visible if says is None else says)


def drawn(svg: Node, styles: Styles, state: State) -> list[tuple[Node, State]]:
    """The text of a drawing, in order: its text elements and foreign content, each with the state around it."""
    out, stack = [], [(c, state) for c in svg.children[::-1]]
    while stack:
        node, state = stack.pop()
        if isinstance(node, str) or node.tag in _KEPT:
            continue
        if node.tag in ("text", "foreignobject"):
            out.append((node, state))
        elif (inner := enter(node, styles, state)) is not None:
            stack += [(c, inner) for c in node.children[::-1]]
    return out


class Lines:
    """Text as it is laid out: lines, spaces joined, one empty line at most between blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.gap = False
        self.indents: list[tuple[str, str]] = []  # of each open indent: its sign, and what stands before lines in it
        self.used = 0  # indents whose sign is drawn

    def indent(self, first: str, rest: str) -> None:
        """What stands before the first line and the others from now on. Of very deep indents WIDEST characters are drawn."""
        around = self.indents[-1][1] if self.indents else ""
        self.indents.append((first, (around + rest)[:WIDEST]))

    def dedent(self) -> None:
        if self.indents:
            self.indents.pop()
            self.used = min(self.used, len(self.indents))

    def pending(self) -> str:
        """The sign of the innermost indent, if no line has drawn it."""
        return self.indents[-1][0] if self.used < len(self.indents) else ""

    def _prefix(self) -> str:
        out = self.indents[self.used - 1][1] if self.used else ""
        out += "".join(first for first, _ in self.indents[self.used :])
        self.used = len(self.indents)
        return out

    def _begin(self) -> None:
        if not self.now:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.now = [self._prefix()]

    def write(self, text: str, keep: bool = False) -> None:
        if keep:
            for k, line in enumerate(text.expandtabs(8).split("\n")):
                if k:
                    self.end(True)
                if line:
                    self._begin()
                    self.now.append(line)
            return
        words = text.split()
        if not words:
            self.space |= bool(text) and bool(self.now)
            return
        if self.now and (self.space or text[0].isspace()):
            self.now.append(" ")
        self._begin()
        self.now.append(" ".join(words))
        self.space = text[-1].isspace()

    def end(self, always: bool = False) -> None:
        """End the line; a line without text only if always."""
        if self.now:
            self.lines.append("".join(self.now).rstrip())
        elif always:
            if self.gap and self.lines:
                self.gap = False
                self.lines.append("")
            self.lines.append("")
        self.now, self.space = [], False

    def block(self, spaced: bool) -> None:
        self.end()
        self.gap |= spaced

    def whole(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


class Grid:
    """A table's cells, drawn in columns of equal width; one that spans rows stands in the first of them."""

    def __init__(self):
        self.rows: list[list[tuple[str, int, int]]] = []  # of each cell: content, columns, rows (0: to the end)
        self.caption = ""

    def placed(self) -> list[list[tuple[int, int, list[str]]]]:
        """Per row its cells as (first column, columns, lines), those that reach into it from above without lines."""
        out, held = [], {}  # held: first column: (columns, rows left)
        for row in self.rows:
            now = [(k, span, [""]) for k, (span, _) in held.items()]
            taken = {c for k, span, _ in now for c in range(k, k + span)}
            held = {k: (span, left - 1) for k, (span, left) in held.items() if left != 1}
            k = 0
            for content, span, down in row:
                while k in taken:
                    k += 1
                # A cell that would run into one from above ends before it.
                span = next((c - k for c in range(k, k + span) if c in taken), span)
                now.append((k, span, content.split("\n")))
                if down != 1:
                    held[k] = (span, down - 1)
                k += span
            out.append(sorted(now))
        return out

    def text(self) -> list[str]:
        rows = self.placed()
        widths: list[int] = []
        for row in rows:
            for k, span, lines in row:
                widths += [0] * (k + span - len(widths))
                if span == 1:
                    widths[k] = max(widths[k], *map(len, lines))
        out = [self.caption] if self.caption else []
        for row in rows:
            for line in range(max((len(lines) for _, _, lines in row), default=0)):
                cells, at = [], 0
                for k, span, lines in row:
                    cells += ["".ljust(w) for w in widths[at:k]]
                    wide = sum(widths[k : k + span]) + 3 * (span - 1)
                    cells.append((lines[line] if line < len(lines) else "").ljust(wide))
                    at = k + span
                whole = " | ".join(cells).rstrip()
                out.append(whole.rstrip(" |") if whole.strip(" |") else "")
        return out


def _span(node: Node, name: str, least: int) -> int:
    value = node.attrs.get(name, "1")
    return max(least, min(int(value), 1000)) if re.fullmatch(r"\d{1,5}", value) else 1


def render(root: Node, styles: str = "") -> str:
    """All text of a tree that is visible, laid out. Walks with its own stack, so any depth is fine."""
    rules = Styles(styles)
    out = [Lines()]
    grids: list[Grid] = []
    lists: list[list] = []  # [kind, next number]
    stack: list[tuple] = [("in", root, False, (0, 0, True))]
    while stack:
        what, node, pre, state = stack.pop()
        lines = out[-1]
        if what == "text":
            if state[2]:
                lines.write(node, pre)
            continue
        tag = node.tag
        if what == "in":
            inner = enter(node, rules, state)
            if inner is None:
                continue
            visible = inner[2]
            if tag == "br":
                lines.end(True)
                continue
            if tag == "hr":
                lines.block(True)
                if visible:
                    lines.write("---")
                lines.block(True)
                continue
            if tag == "input":
                if visible and node.attrs.get("type", "text").lower() not in ("checkbox", "radio", "image", "file", "password"):
                    lines.write(node.attrs.get("value", ""))
                continue
            if tag == "table":
                lines.block(True)
                grids.append(Grid())
            elif grids and tag == "tr":
                grids[-1].rows.append([])
            elif grids and tag in ("td", "th", "caption"):
                if tag != "caption" and not grids[-1].rows:
                    grids[-1].rows.append([])
                out.append(Lines())
            elif tag in BLOCK:
                lines.block(tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists))
                if tag in ("ul", "ol", "menu", "dir"):
                    start = node.attrs.get("start", "1")
                    lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
                elif tag == "li":
                    if lists and lists[-1][0] == "ol":
                        sign = f"{lists[-1][1]}. "
                        lists[-1][1] += 1
                    else:
                        sign = "- "
                    lines.indent(sign if visible else " " * len(sign), " " * len(sign))
                elif tag == "dd":
                    lines.indent("    ", "    ")
                elif tag == "blockquote":
                    lines.indent("> ", "> ")
            elif tag == "q" and visible:
                lines.write('"')
            pre = pre or tag in ("pre", "xmp", "textarea", "plaintext")
            stack.append(("out", node, pre, inner))
            children = node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            if tag == "svg":
                for part, around in reversed(drawn(node, rules, inner)):
                    stack += [("text", " ", pre, around), ("in", part, pre, around), ("text", " ", pre, around)]
                continue
            if grids and tag in ("table", "thead", "tbody", "tfoot", "tr"):
                children = [c for c in children if isinstance(c, Node) or not c.isspace()]
            stack += [("text" if isinstance(c, str) else "in", c, pre, inner) for c in reversed(children)]
            continue
        if tag == "table" and grids:
            grid = grids.pop()
            for line in grid.text():
                out[-1].write(line, True)
                out[-1].end()
            out[-1].block(True)
        elif grids and tag in ("td", "th", "caption") and len(out) > 1:
            content = out.pop().whole()
            if tag == "caption":
                grids[-1].caption = content
            else:
                grids[-1].rows[-1].append((content, _span(node, "colspan", 1), _span(node, "rowspan", 0)))
        elif tag in BLOCK and not (grids and tag == "tr"):
            if tag == "li" and not lines.now and lines.pending().strip():
                lines._begin()  # an empty item still shows its sign
            lines.block(tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and len(lists) > 1))
            if tag in ("ul", "ol", "menu", "dir") and lists:
                lists.pop()
            elif tag in ("li", "dd", "blockquote"):
                lines.dedent()
        elif tag == "q" and state[2]:
            lines.write('"')
    return out[0].whole()
