"""Static pages: a parsed tree, hidden elements, text, Markdown, metadata. C3, C10.

One Arrow function per page does what needs a tree. Styles come from inline style attributes, the
hidden attribute and <style> rules with a single tag, class or id selector. Layout is not
computed: sizes and places count only where they are declared, and the result says so
(`degraded`), as a reduced guarantee should. Declarative shadow roots are composed as a reader
sees them: an open one stands in for its host's children, slots hold what is assigned to them.

Every walk keeps a stack of its own, so that nesting has no bound but the page's length.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritext.functions import patterns as P
from veritext.functions.colors import NAMES

#: The class of invisible characters, in this language's escapes.
INVISIBLE = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", P.INVISIBLE))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NOISE = frozenset(("script", "style", "noscript", "template"))
CHROME = frozenset(("nav", "header", "footer", "aside", "form", "button"))
MIN_COMMENT, PRE_CUT, PATH_DEPTH, BACKGROUNDS = 20, 200, 5, 16
ALPHA, FONT, CONTRAST, BOX, FAR = 0.05, 4.0, 1.15, 1.0, -1000.0

SPAN = "struct<text:string,reason:string,path:string>"
PAGE = f"struct<title:string,lang:string,canonical:string,meta:map<string,string>,comments:array<string>,hidden:array<{SPAN}>,text:string,markdown:string,degraded:boolean,marks:array<struct<char:string,n:bigint>>>"


class Node:
    """An element. parent: in the tree as a reader sees it; home: in the markup; scope: the host whose
    shadow tree it stands in; crossed: its home is a host, reached through the shadow root."""

    __slots__ = ("tag", "attrs", "children", "parent", "home", "scope", "crossed", "style", "inherited", "flagged", "filled", "breaks")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.home = tag, attrs, parent, parent
        self.children: list[Node | str | tuple[str]] = []  # a one-tuple is a comment
        self.scope: Node | None = None
        self.crossed = self.filled = self.breaks = False
        self.style: dict[str, str] = {}
        self.inherited: dict[str, str] = {}
        self.flagged: str | None = None


class Tree(HTMLParser):
    """A forgiving tree: unknown end tags are ignored, p and li close their like."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", {}, None)
        self.open = Counter(("html",))  # tags from the root down to where we are

    def up_to(self, node: Node) -> None:
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in reversed(attrs)}
        if tag == "html":
            self.root.attrs = values | self.root.attrs
            return
        if tag in ("p", "li", "tr", "td", "th", "dd", "dt", "option") or (self.at.tag == "p" and tag in P.BREAKS and tag != "br"):
            close = "p" if self.at.tag == "p" else tag
            n = self.at if self.open[close] else None
            while n is not None and n.tag not in (close, "ul", "ol", "table", "div", "body", "html", "article", "section"):
                n = n.parent
            if n is not None and n.tag == close and n.parent is not None:
                self.up_to(n.parent)
        node = Node(tag, values, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        outer = tag in ("body", "html")  # what follows still belongs to the body
        if outer:
            tag = "body" if self.open["body"] else "html"
        if not self.open[tag]:
            return
        n = self.at
        while n.tag != tag:
            n = n.parent
        if outer:
            self.up_to(n)
        elif n.parent is not None:
            self.up_to(n.parent)

    def handle_data(self, data):
        self.at.children.append(data)

    def handle_comment(self, data):
        self.at.children.append((data,))


def walk(node: Node, enter=None):
    """The elements of a subtree in page order; enter: whether an element's children are visited."""
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        if enter is None or enter(n):
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]


def texts(node: Node, strip: bool = False):
    """The pieces of text in a subtree; strip: without what is hidden or no text for readers."""
    stack: list = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            yield n
        elif isinstance(n, Node) and not (strip and n is not node and (n.flagged or n.tag in NOISE)):
            stack += reversed(n.children)


def inner_text(node: Node) -> str:
    return "".join(texts(node))


def excerpt(node: Node) -> str:
    """The first characters of an element's text."""
    out, size = [], 0
    for t in texts(node):
        t = t if out else t.lstrip()
        if t:
            out.append(t)
            size += len(t)
        if size > PRE_CUT:
            break
    return "".join(out).strip()[:PRE_CUT]


def compose(root: Node) -> None:
    """Put open declarative shadow roots in place of their hosts' children, and what is assigned
    to a slot into the slot. Light children that no slot takes aren't shown; closed roots stay out."""
    for host in list(walk(root)):
        shadows = [c for c in host.children if isinstance(c, Node) and c.tag == "template" and "shadowrootmode" in c.attrs]
        if not shadows:
            continue
        light = [c for c in host.children if not (isinstance(c, Node) and c in shadows)]
        if shadows[0].attrs["shadowrootmode"].lower() != "open":
            host.children = [] if shadows[0].attrs["shadowrootmode"].lower() == "closed" else light
            continue
        host.children = shadows[0].children
        for c in host.children:
            if isinstance(c, Node):
                c.parent = c.home = host
                c.crossed = True
        for n in list(walk(host, lambda x: x is host or not any(isinstance(c, Node) and "shadowrootmode" in c.attrs for c in x.children)))[1:]:
            n.scope = host
            if n.tag == "slot":
                name = n.attrs.get("name", "")
                mine = [c for c in light if (c.attrs.get("slot", "") if isinstance(c, Node) else "") == name and not isinstance(c, tuple)]
                if any(isinstance(c, Node) or c.strip() for c in mine):
                    taken = set(map(id, mine))
                    n.children, light = mine, [c for c in light if id(c) not in taken]
                    for c in mine:
                        if isinstance(c, Node):
                            c.parent = n
                n.style.setdefault("display", "contents")


def declarations(css: str) -> dict[str, str]:
    out = {}
    for part in css.split(";"):
        name, colon, value = part.partition(":")
        if colon:
            out[name.strip().lower()] = re.sub(r"\s*!important\s*$", "", value.strip().lower())
    return out


def sheet_rules(root: Node) -> list[tuple[Node | None, str, dict[str, str]]]:
    """Rules of the page's style elements, each with the shadow host they are scoped to."""
    rules = []
    for n in walk(root):
        if n.tag == "style":
            css = re.sub(r"/\*.*?\*/", "", inner_text(n), flags=re.S)
            for selectors, body in re.findall(r"([^{}@]+)\{([^{}]*)\}", css):
                for s in selectors.split(","):
                    if re.fullmatch(r"[.#]?[A-Za-z][\w-]*", s.strip()):
                        rules.append((n.scope, s.strip(), declarations(body)))
    return rules


def pixels(value: str | None) -> float | None:
    m = re.fullmatch(r"(-?[0-9.]+)(px)?", value or "")
    try:
        return float(m[1]) if m and (m[2] or float(m[1]) == 0) else None
    except ValueError:
        return None


def rgba(value: str | None) -> tuple[float, float, float, float] | None:
    v = NAMES.get(value or "", value or "")
    if v == "transparent":
        return 0.0, 0.0, 0.0, 0.0
    if m := re.fullmatch(r"#([0-9a-f]{3}|[0-9a-f]{6})", v):
        h = m[1] if len(m[1]) == 6 else "".join(c * 2 for c in m[1])
        return (*(float(int(h[i : i + 2], 16)) for i in (0, 2, 4)), 1.0)
    if m := re.match(r"rgba?\(([^)]+)\)", v):
        try:
            p = [float(x) for x in m[1].split(",")]
        except ValueError:
            return None
        if len(p) >= 3:
            return p[0], p[1], p[2], p[3] if len(p) > 3 else 1.0
    return None


def luminance(c) -> float:
    f = lambda x: x / 255 / 12.92 if x / 255 <= 0.03928 else ((x / 255 + 0.055) / 1.055) ** 2.4
    return 0.2126 * f(c[0]) + 0.7152 * f(c[1]) + 0.0722 * f(c[2])


def background(node: Node | None):
    for _ in range(BACKGROUNDS):
        if node is None:
            break
        c = rgba(node.style.get("background-color") or node.style.get("background"))
        if c and c[3] > ALPHA:
            return c
        node = node.parent
    return 255.0, 255.0, 255.0, 1.0


def paints(n: Node) -> bool:
    """Whether an element without a box of its own shows anything: text, or a child with a box."""
    stack = [n]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, str):
                if c.strip():
                    return True
            elif isinstance(c, Node) and c.tag not in NOISE:
                display = c.style.get("display")
                if display == "contents":
                    stack.append(c)
                elif display != "none" and not ("hidden" in c.attrs and display is None):
                    return True
    return False


def hidden_reason(n: Node) -> str | None:
    """B30-B40, first match wins."""
    s = n.style
    if s.get("display") == "none" or n.inherited.get("visibility") == "hidden" or ("hidden" in n.attrs and "display" not in s):
        return "display:none/visibility:hidden"
    if s.get("content-visibility") == "hidden":
        return "content-visibility:hidden"
    boxed = s.get("display") != "contents"
    if boxed:
        try:
            if float(s.get("opacity", "1")) <= ALPHA:
                return "opacity<=0.05"
        except ValueError:
            pass
    size = pixels(n.inherited.get("font-size"))
    if size is not None and size < FONT:
        return "font-size<4px"
    if not boxed:
        if not paints(n):
            return "no-rendered-content"
    else:
        w, h = pixels(s.get("width")), pixels(s.get("height"))
        if w == 0 and h == 0 and s.get("overflow") == "hidden":
            return "zero-size"
        if w is not None and h is not None and w <= BOX and h <= BOX:
            return "sr-only-1px"
        if re.search(r"rect\(\s*0[a-z%]*[\s,]+0[a-z%]*[\s,]+0[a-z%]*[\s,]+0[a-z%]*\s*\)", s.get("clip", "")):
            return "clip-zero-rect"
        if s.get("position") in ("absolute", "fixed") and any((pixels(s.get(k)) or 0) <= FAR for k in ("left", "top")):
            return "off-screen"
    fg = rgba(n.inherited.get("color"))
    if fg:
        if fg[3] <= ALPHA:
            return "text-color-transparent"
        a, b = luminance(fg), luminance(background(n))
        if (max(a, b) + 0.05) / (min(a, b) + 0.05) < CONTRAST:
            return "color-contrast<1.15"
    return None


def path_of(n: Node | None) -> str:
    """The element and its ancestors in the markup, ::shadow where a shadow root is crossed."""
    parts: list[str] = []
    crossed = False
    while n is not None and len(parts) < PATH_DEPTH:
        parts.insert(0, n.tag + ("#" + n.attrs["id"] if n.attrs.get("id") else "") + "::shadow" * crossed)
        n, crossed = n.home, n.crossed
    return ">".join(parts)


def rebuilt_text(node: Node, strip: bool) -> str:
    """Text without noise, a newline after elements that end a line, blank runs collapsed."""
    out: list[str] = []
    stack: list = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif isinstance(n, Node) and not (n.tag in NOISE or n.tag == "head" or (strip and n.flagged)):
            if n.tag in P.BREAKS:
                stack.append("\n")
            stack += reversed(n.children)
    return re.sub(r"[ \t]*\n(?:[ \t]*\n)+", "\n\n", "".join(out)).strip()


def wrapped(n: Node, text: str) -> str:
    """What an inline element makes of its text."""
    inner = text.strip()
    if n.tag == "br":
        return "\n"
    if not inner:
        return text
    if n.tag == "a":
        return f"[{inner}]({n.attrs['href']})" if n.attrs.get("href") else text
    return f"**{inner}**" if n.tag in ("b", "strong") else f"*{inner}*"


def inline(nodes: list, strip: bool) -> str:
    """Markdown of a run of inline content; what is hidden or no text for readers stays out."""
    parts: list[list[str]] = [[]]
    stack: list = list(reversed(nodes))
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            parts[-1].append(re.sub(r"\s+", " ", n))
        elif isinstance(n, tuple) and len(n) == 2:  # the end of an element
            text = "".join(parts.pop())
            parts[-1].append(wrapped(n[1], text))
        elif isinstance(n, Node) and not (strip and n.flagged) and n.tag not in NOISE:
            if n.tag in ("a", "b", "strong", "i", "em", "br"):
                parts.append([])
                stack.append(("end", n))
            stack += reversed(n.children)
    return "".join(parts[0])


def shown_rows(table: Node, strip: bool) -> list[list[str]]:
    """A table's own rows; tables inside its cells are part of the cell's text."""
    own = lambda n: n is table or (n.tag != "table" and n.tag not in ("td", "th") and not (strip and n.flagged))
    rows = [n for n in walk(table, own) if n.tag == "tr" and not (strip and n.flagged)]
    return [[inline(c.children, strip).strip() for c in r.children if isinstance(c, Node) and c.tag in ("td", "th") and not (strip and c.flagged)] for r in rows]


def markdown_of(root: Node, strip: bool) -> str:
    """The article, or else the page without its chrome, as Markdown with links and tables."""
    seen = lambda n: not (n.tag in NOISE or (strip and n.flagged))
    article = next((n for n in walk(root, seen) if n.tag in ("article", "main") and seen(n)), None)
    blocks: list[str] = []

    def block(n: Node):
        """Adds n's blocks; yields the elements whose blocks come next."""
        if n.tag in NOISE or n.tag == "head" or (strip and n.flagged) or (n.tag in CHROME and article is None):
            return
        if re.fullmatch("h[1-6]", n.tag):
            blocks.append("#" * int(n.tag[1]) + " " + inline(n.children, strip).strip())
        elif n.tag in ("p", "blockquote", "figcaption", "dt", "dd"):
            blocks.append(("> " if n.tag == "blockquote" else "") + inline(n.children, strip).strip())
        elif n.tag == "pre":
            blocks.append("```\n" + "".join(texts(n, strip)).strip("\n") + "\n```")
        elif n.tag in ("ul", "ol"):
            items = [c for c in n.children if isinstance(c, Node) and not (strip and c.flagged)]
            blocks.append("\n".join(("- " if n.tag == "ul" else f"{i}. ") + inline(c.children, strip).strip() for i, c in enumerate(items, 1)))
        elif n.tag == "table":
            rows = [r for r in shown_rows(n, strip) if r]
            lines = ["| " + " | ".join(r) + " |" for r in rows]
            if lines:
                lines.insert(1, "|" + " --- |" * len(rows[0]))
                blocks.append("\n".join(lines))
        else:
            loose: list = []
            for c in [*n.children, None]:
                if c is None or (isinstance(c, Node) and c.breaks):
                    if text := inline(loose, strip).strip():
                        blocks.append(text)
                    loose = []
                    if c is not None:
                        yield c
                elif not isinstance(c, tuple):
                    loose.append(c)

    stack = [block(article or root)]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(block(inner))
    return "\n\n".join(b for b in blocks if b.strip())


def parse_page(html: str, strip: bool) -> dict:
    tree = Tree()
    tree.feed(html)
    tree.close()
    root = tree.root
    compose(root)
    rules = sheet_rules(root)
    meta: dict[str, str] = {}
    title = canonical = None
    comments: list[str] = []
    hidden: list[dict] = []
    order = list(walk(root))
    for n in order:
        for scope, selector, body in rules:
            if scope is not n.scope:
                continue
            if selector == n.tag or selector[0] == "." and selector[1:] in (n.attrs.get("class") or "").split() or selector[0] == "#" and selector[1:] == n.attrs.get("id"):
                n.style |= body
        n.style |= declarations(n.attrs.get("style", ""))
        above = n.parent.inherited if n.parent is not None else {}
        own = {k: n.style[k] for k in ("visibility", "font-size", "color") if k in n.style}
        n.inherited = above | own if own else above
        if n.tag == "title" and title is None:
            title = inner_text(n).strip()
        if n.tag == "meta" and (key := n.attrs.get("name") or n.attrs.get("property")):
            meta.setdefault(key, n.attrs.get("content", ""))  # G8: the first value wins
        if n.tag == "link" and canonical is None and "canonical" in (n.attrs.get("rel") or "").lower().split():
            canonical = n.attrs.get("href")
        comments += [c[0].strip() for c in n.children if isinstance(c, tuple) and len(c[0].strip()) >= MIN_COMMENT]
    for n in reversed(order):  # children before their parents
        n.filled = any(c.strip() if isinstance(c, str) else isinstance(c, Node) and c.filled for c in n.children)
        n.breaks = n.tag in P.BREAKS or any(isinstance(c, Node) and c.breaks for c in n.children)
    body = next((n for n in order if n.tag == "body"), root)
    for n in walk(body, lambda n: not n.flagged):  # B43: nothing below a flagged element is flagged again
        if n.filled and (reason := hidden_reason(n)):
            n.flagged = reason
            if n.tag not in ("script", "style"):  # B42: source is removed, not reported
                hidden.append({"text": excerpt(n), "reason": reason, "path": path_of(n)})
    hidden += [{"text": c[:PRE_CUT], "reason": "html-comment", "path": None} for c in comments]
    text, markdown = rebuilt_text(body, strip), markdown_of(body, strip)
    return {
        "title": title,
        "lang": root.attrs.get("lang") or None,
        "canonical": canonical,
        "meta": list(meta.items()),
        "comments": comments,
        "hidden": hidden,
        "text": text,
        "markdown": markdown,
        "degraded": True,
        "marks": marks_of(markdown or text, text),
    }


def marks_of(*scans: str) -> list[dict]:
    """Invisible characters with the largest count of any scan, in order of first sight."""
    most: dict[str, int] = {}
    for text in scans:
        for char, n in Counter(INVISIBLE.findall(text)).items():
            most[char] = max(n, most.get(char, 0))
    return [{"char": c, "n": n} for c, n in most.items()]


def page_parser(strip: bool = True):
    """A column function: HTML to PAGE. Null and empty pages give empty fields."""
    span = pa.struct([("text", pa.string()), ("reason", pa.string()), ("path", pa.string())])
    kind = pa.struct(
        [
            ("title", pa.string()),
            ("lang", pa.string()),
            ("canonical", pa.string()),
            ("meta", pa.map_(pa.string(), pa.string())),
            ("comments", pa.list_(pa.string())),
            ("hidden", pa.list_(span)),
            ("text", pa.string()),
            ("markdown", pa.string()),
            ("degraded", pa.bool_()),
            ("marks", pa.list_(pa.struct([("char", pa.string()), ("n", pa.int64())]))),
        ]
    )

    @F.arrow_udf(PAGE)
    def parsed(html: pa.Array) -> pa.Array:
        return pa.array([parse_page(h or "", strip) for h in html.to_pylist()], kind)

    return parsed


def with_parsed(pages: DataFrame, html: str = "html", strip: bool = True, out: str = "page") -> DataFrame:
    return pages.withColumn(out, page_parser(strip)(F.col(html)))


def boundary(
    title: Column, final_url: Column, spans: Column, http_status: Column, meta: Column | None = None, canonical: Column | None = None, lang: Column | None = None
) -> dict[str, Column]:
    """B1: what a page may say about itself, cleaned and cut; metadata where it is given."""
    from veritext.functions.text import clean_field
    from veritext.functions.urls import safe_url
    from veritext.operators.hits import cleaned_spans

    out = {
        "title": F.coalesce(clean_field(title, P.TITLE), F.lit("")),
        "final_url": F.coalesce(safe_url(final_url), F.lit("")),
        "hidden_spans": cleaned_spans(spans),
        "http_status": F.when(http_status > 0, http_status),
    }
    if meta is not None:
        # Keys that meet once they are cleaned: the first one wins.
        pairs = F.transform(F.map_entries(meta), lambda e: F.struct(clean_field(e["key"], P.META).alias("key"), F.coalesce(clean_field(e["value"], P.META), F.lit("")).alias("value")))
        first = F.aggregate(
            pairs,
            F.array().cast("array<struct<key:string,value:string>>"),
            lambda done, e: F.when(e["key"].isNull() | F.exists(done, lambda d: d["key"] == e["key"]), done).otherwise(F.concat(done, F.array(e))),
        )
        out["meta"] = F.map_from_entries(first)
    if canonical is not None:
        out["canonical"] = safe_url(canonical)
    if lang is not None:
        out["lang"] = clean_field(lang, P.LANG)
    return out
