"""Small per-page helpers for what needs a tag tree: cleaning and Markdown.

Used inside Arrow batches by ``staygrid.plans.pages``; no Spark in here.
"""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin

# Elements outside the main content, and what keeps one anyway.
NON_MAIN = [
    "header", "footer", "nav", "aside", ".header", ".top", ".navbar", "#header", ".footer", ".bottom", "#footer",
    ".sidebar", ".side", ".aside", "#sidebar", ".modal", ".popup", "#modal", ".overlay", ".ad", ".ads", ".advert",
    "#ad", ".lang-selector", ".language", "#language-selector", ".social", ".social-media", ".social-links",
    "#social", ".menu", ".navigation", "#nav", ".breadcrumbs", "#breadcrumbs", ".share", "#share", ".widget",
    "#widget", ".cookie", "#cookie", ".fc-decoration",
]
KEEP_WITH = [
    "#main", ".swoogo-cols", ".swoogo-text", ".swoogo-table-div", ".swoogo-space", ".swoogo-alert",
    ".swoogo-sponsors", ".swoogo-title", ".swoogo-tabs", ".swoogo-logo", ".swoogo-image", ".swoogo-button",
    ".swoogo-agenda",
]
NEVER_SHOWN = ["head", "meta", "noscript", "style", "script"]

VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = set(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)
# Start tag -> open elements it ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def matches(self, selector: str) -> bool:
        if selector.startswith("."):
            return selector[1:] in (self.attrs.get("class") or "").split()
        if selector.startswith("#"):
            return self.attrs.get("id") == selector[1:]
        return self.tag == selector

    def drop(self):
        if self.parent is not None and self in self.parent.children:
            self.parent.children.remove(self)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def _close_while(self, tags, barrier):
        n = self.at
        while n is not self.root and n.tag not in barrier:
            if n.tag in tags:
                self.at = n.parent
                return
            n = n.parent

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._close_while({"p"}, {"td", "th", "li", "div", "body"})
        if tag in ENDS:
            self._close_while(ENDS[tag], {"ul", "ol", "dl", "table", "select"} - {tag})
        node = Node(tag, {k: v if v is not None else "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        n = self.at
        while n is not self.root:
            if n.tag == tag:
                self.at = n.parent
                return
            n = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _largest(img: Node) -> str | None:
    """Source of the widest or densest srcset entry."""
    entries = []
    for part in img.attrs["srcset"].split(","):
        found = re.fullmatch(r"(?s)\s*(.*?)(?:\s+([\d.]+)([xw]))?\s*", part)
        if found and found[1]:
            entries.append((float(found[2] or 1), found[3] or "x", found[1]))
    if all(unit == "x" for _, unit, _ in entries) and "src" in img.attrs:
        entries.append((1.0, "x", img.attrs["src"]))
    return max(entries, key=lambda e: e[0])[2] if entries else None


def cleaned(html: str, url: str, include: list[str], exclude: list[str], only_main: bool) -> Node:
    """Page tree without hidden, excluded and (optionally) non-main parts; absolute links."""
    root = tree(html)
    base = url
    for n in root.walk():
        if n.tag == "base" and "href" in n.attrs:
            base = urljoin(url, n.attrs["href"])
            break
    if include:
        picked = Node("div", {}, None)
        for selector in include:
            for n in [n for n in root.walk() if n.tag and n.matches(selector)]:
                n.drop()
                n.parent = picked
                picked.children.append(n)
        root = Node("", {}, None)
        picked.parent = root
        root.children.append(picked)
    for n in list(root.walk()):
        if n.tag in NEVER_SHOWN or any(n.tag and n.matches(s) for s in exclude):
            n.drop()
    if only_main:
        for n in [n for n in root.walk() if n.tag and any(n.matches(s) for s in NON_MAIN)]:
            if not any(d.matches(k) for d in n.walk() for k in KEEP_WITH):
                n.drop()
    for n in root.walk():
        if n.tag == "img" and "srcset" in n.attrs:
            best = _largest(n)
            if best:
                n.attrs["src"] = best
        for tag, name in (("img", "src"), ("a", "href")):
            if n.tag == tag and name in n.attrs:
                try:
                    n.attrs[name] = urljoin(base, n.attrs[name].strip())
                except ValueError:
                    pass
    return root


def to_html(root: Node) -> str:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if isinstance(n, tuple):
            out.append(n[0])
        elif isinstance(n, str):
            out.append(escape(n, quote=False))
        else:
            if n.tag:
                attrs = "".join(f' {k}="{escape(v)}"' for k, v in n.attrs.items())
                out.append(f"<{n.tag}{attrs}>")
                if n.tag not in VOID:
                    stack.append((f"</{n.tag}>",))
            stack.extend(reversed(n.children))
    return "".join(out)


def text_of(root: Node) -> str:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        else:
            stack.extend(reversed(n.children))
    return "".join(out)


INLINE = {"b": "**", "strong": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "code": "`"}


def to_markdown(root: Node) -> str:
    """Markdown of a cleaned tree: one blank line between blocks."""
    blocks: list[str] = []
    line: list[str] = []
    lists: list[list] = []
    quotes = 0

    def flush(prefix: str = ""):
        nonlocal line
        text = re.sub(r"[ \t\f\v\r]*\n[ \t]*", "\n", re.sub(r"[^\S\n]+", " ", "".join(line))).strip()
        line = []
        if text:
            mark = "> " * quotes
            blocks.append("\n".join(mark + ln for ln in (prefix + text).split("\n")))

    def item_prefix() -> str:
        if not lists:
            return ""
        kind, number, fresh = lists[-1]
        lists[-1][2] = False
        lead = "  " * (len(lists) - 1)
        return lead + ((f"{number}. " if kind == "ol" else "- ") if fresh else "  ")

    stack: list = [root]
    while stack:
        n = stack.pop()
        if callable(n):
            n()
            continue
        if isinstance(n, str):
            line.append(n.replace("\n", " "))
            continue
        tag = n.tag
        if re.fullmatch(r"h[1-6]", tag):
            flush(item_prefix())
            stack.append(lambda level=int(tag[1]): flush("#" * level + " "))
        elif tag == "pre":
            flush(item_prefix())
            language = re.search(r"language-(\S+)", " ".join(c.attrs.get("class", "") for c in n.walk()))
            blocks.append("```" + (language[1] if language else "") + "\n" + text_of(n).strip("\n") + "\n```")
            continue
        elif tag == "table":
            flush(item_prefix())
            rows = [[" ".join(text_of(c).split()) for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")]
                    for r in n.walk() if r.tag == "tr"]
            rows = [r for r in rows if r]
            if rows:
                lines = ["| " + " | ".join(r) + " |" for r in rows]
                lines.insert(1, "| " + " | ".join("---" for _ in rows[0]) + " |")
                blocks.append("\n".join(lines))
            continue
        elif tag in ("ul", "ol"):
            flush(item_prefix())
            lists.append([tag, 0, False])
            stack.append(lambda: (flush(item_prefix()), lists.pop()))
        elif tag == "li":
            flush(item_prefix())
            if lists:
                lists[-1][1] += 1
                lists[-1][2] = True
            stack.append(lambda: flush(item_prefix()))
        elif tag == "blockquote":
            flush(item_prefix())
            quotes += 1

            def leave():
                nonlocal quotes
                flush()
                quotes -= 1

            stack.append(leave)
        elif tag == "hr":
            flush(item_prefix())
            blocks.append("---")
        elif tag == "br":
            line.append("\n")
        elif tag == "img":
            if n.attrs.get("src"):
                line.append(f"![{n.attrs.get('alt', '')}]({n.attrs['src']})")
        elif tag == "a" and n.attrs.get("href"):
            line.append("[")
            stack.append(lambda h=n.attrs["href"]: line.append(f"]({h})"))
        elif tag in INLINE and text_of(n).strip():
            line.append(INLINE[tag])
            stack.append(lambda m=INLINE[tag]: line.append(m))
        elif tag in BLOCKS or tag in ("body", "html", "td", "th", "dt", "dd"):
            flush(item_prefix())
            stack.append(lambda: flush(item_prefix()))
        stack.extend(reversed(n.children))
    flush()
    return polished("\n\n".join(blocks))


def polished(markdown: str) -> str:
    """Escape line ends inside link texts; drop jump links to the content."""
    if "[" not in markdown:
        return markdown
    out, depth = [], 0
    for piece in re.split(r"([\[\]\n])", markdown):
        depth += (piece == "[") - (piece == "]" and depth > 0)
        out.append("\\\n" if piece == "\n" and depth else piece)
    return re.sub(r"(?i)\[Skip to Content\]\(#[^)]*\)", "", "".join(out))
