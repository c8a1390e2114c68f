"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of blocks whose leaves are runs of text.  Every node is in one of three states: page furniture,
article, or both (some of its text is one, some the other; not for runs).  Node potentials come from the tag, names in
class, id and role, and the shape of the text below; edge potentials from the states of parent and child.  Sum-product
messages go up the tree and down again, so a run's marginal knows the whole page: one word is article inside an article
and furniture inside a menu.  Runs whose marginal for article is the larger one are the text.

The weights are trained (conditional likelihood, its gradient from the same messages) on labelled pages of two kinds:
pages of a bounded sample whose own markup says what is what (article or main against nav, footer, aside ...), and pages
composed of the sample's text in layouts made from ``PARTS``, whose labels are known by construction.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staygrid.llm.common import slices

#: Pages of the sample, the largest that may be in it (characters), and composed pages.
SAMPLE, LARGEST, COMPOSED = 60, 1 << 16, 1000
#: Parts that training takes turns on; its steps, their size at first, and the penalty on weights.
TURNS, STEPS, RATE, PENALTY = 5, 200, 0.4, 0.01
#: Distinct tags with attributes that a worker remembers; it starts anew beyond.
REMEMBERED = 100_000
FURNITURE, ARTICLE, BOTH = 0, 1, 2
ENDINGS = frozenset('.!?…:;"”»')

# Element names of HTML.
CONTAINERS = frozenset("html body div section article main aside nav header footer form fieldset details dialog figure center hgroup search menu address".split())
TEXTS = frozenset(
    "p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table caption thead tbody tfoot tr td th figcaption summary legend hr".split())
RAW = frozenset("script style noscript template head title textarea select button iframe svg canvas object audio video math noframes xmp datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends an open element of these without an end tag, up to the nearest of the second list.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
        "thead": ("thead tbody tfoot tr td th", "table"), "tbody": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tfoot tr td th", "table")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
#: Elements that keep an open paragraph from being ended by a block inside them.
FENCES = frozenset("table td th caption button".split())

# Parts of composed pages, with usual elements and names.
PARTS = {
    "menu": ("nav ul div nav", "nav menu navbar navigation topnav main-menu breadcrumb breadcrumbs pagination tabs toc submenu dropdown"),
    "header": ("header div", "header site-header masthead topbar branding logo banner-top page-header head"),
    "footer": ("footer div", "footer site-footer page-footer copyright colophon legal bottom credits imprint"),
    "sidebar": ("aside div section", "sidebar side-bar aside widget related recommended trending popular more-stories teaser links rail side right-column"),
    "notice": ("div section aside", "cookie cookie-banner consent notice alert gdpr privacy newsletter subscribe paywall modal popup overlay disclaimer toast message"),
    "advert": ("div aside ins section div", "ad ads advert advertisement sponsored sponsor promo promotion banner ad-slot adsense commercial"),
    "form": ("form form div", "search login signup contact-form subscribe-form form"),
    "comments": ("div section ol", "comments comment comment-list reply replies discussion responses respond thread user-comment feedback"),
    "share": ("div ul", "share social sharing follow tools buttons tags"),
}
BODIES = ("article article main div div section", "article article-body content post post-content entry entry-content story story-body main main-content text body-text page-content")
WRAPPERS = ("div div section main", "wrapper container page layout row col site grid inner outer wrap")

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[a-zA-Z/!?][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
LABEL = "data-label"


class Tree:
    """Blocks of one page in the order they open; runs of text are nodes too."""

    def __init__(self, html: str):
        self.parent, self.depth, self.tag, self.attrs = [-1], [0], ["html"], [""]
        self.text: list[str | None] = [None]
        self.linked = [0]  # characters of links in a run
        stack, run, links, in_link = [0], [], 0, 0
        tag_of, depth = self.tag, self.depth

        def close() -> None:
            nonlocal run, links
            if run:
                text = " ".join(unescape("".join(run)).split())
                if text:
                    self.node(stack[-1], "", "", text, min(links, len(text)))
                run, links = [], 0

        at, end = 0, len(html)
        while at < end:
            m = TOKEN.search(html, at)
            if m is None:
                run.append(html[at:])
                links += (end - at) * (in_link > 0)
                break
            if m.start() > at:
                run.append(html[at:m.start()])
                links += (m.start() - at) * (in_link > 0)
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                if name == "a":
                    in_link = 0
                elif name in CONTAINERS or name in TEXTS:
                    close()
                    for k in range(len(stack) - 1, 0, -1):
                        if tag_of[stack[k]] == name:
                            del stack[k:]
                            in_link = 0
                            break
                        if tag_of[stack[k]] in ("td", "th") and name not in ("tr", "table", "tbody", "thead", "tfoot"):
                            break  # an end tag inside a cell ends nothing outside
            elif name in RAW:
                if not m[3].endswith("/"):
                    over = _end_of(name).search(html, at)
                    at = over.end() if over else end if name in ("script", "style") else at
                run.append(" ")
            elif name == "a":
                in_link = 1
            elif name == "br" or name == "hr":
                run.append(" ")
                if name == "hr":
                    close()
            elif name in CONTAINERS or name in TEXTS:
                close()
                self._implied(stack, name)
                in_link = in_link if name == "div" else 0
                if name in ("html", "body") and tag_of[stack[-1]] in ("html", "body") and (name == "html" or tag_of[stack[-1]] == "body"):
                    continue
                stack.append(self.node(stack[-1], name, m[3]))
        close()

    def _implied(self, stack: list[int], name: str) -> None:
        """Ends what the opening tag ends."""
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == "p":
                del stack[k:]
                break
            if self.tag[stack[k]] in FENCES or self.tag[stack[k]] in CONTAINERS:
                break
        if name in ENDS:
            over, fence = ENDS[name]
            cut = None
            for k in range(len(stack) - 1, 0, -1):
                if self.tag[stack[k]] in fence:
                    break
                if self.tag[stack[k]] in over:
                    cut = k
            if cut is not None:
                del stack[cut:]
        if name[0] == "h" and name[1:].isdigit() and self.tag[stack[-1]][0] == "h" and self.tag[stack[-1]][1:].isdigit():
            stack.pop()

    def node(self, parent: int, tag: str, attrs: str, text: str | None = None, linked: int = 0) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1


@lru_cache(maxsize=64)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\b[^>]*>", re.I)


def _names(attrs: str) -> tuple[set[str], bool]:
    """Words of class, id and role, and whether the element is hidden."""
    words, hidden = set(), False
    for m in ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role", "aria-label", "itemprop"):
            words.update(w.lower() for w in NAME.findall(value) if len(w) > 1)
        elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    return words, hidden


def own_features(tag: str, attrs: str) -> list[str]:
    words, hidden = _names(attrs) if attrs.strip() else (set(), False)
    return ["tag " + tag, *(f"name {w}" for w in words), *([] if words else [f"nameless {tag}"]), *({f"begins {w[:4]}" for w in words if len(w) > 4}), *(["hidden"] if hidden else [])]


def _step(n: int) -> int:
    return (n + 1).bit_length() - 1


class Numbers:
    """Feature numbers; while learning, new features get one, afterwards they are left out."""

    def __init__(self, known: dict[str, int] | None = None):
        self.known, self.learning = known if known is not None else {}, known is None
        self.seen: dict[tuple, list[int]] = {}

    def all(self, key: tuple, features: list[str]) -> list[int]:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        if self.learning:
            for f in features:
                self.known.setdefault(f, len(self.known))
        got = self.seen[key] = [self.known[f] for f in features if f in self.known]
        return got

    def element(self, tag: str, attrs: str) -> list[int]:
        got = self.seen.get((tag, attrs))
        return self.all((tag, attrs), own_features(tag, attrs)) if got is None else got

    def shape(self, size: int, links: int, share: int, mean: int) -> list[int]:
        key = (size, links, share, mean)
        got = self.seen.get(key)
        return self.all(key, [f"size {size}", f"links {links}", f"share {share}", f"mean {mean}"]) if got is None else got

    def run(self, size: int, links: int, tag: str, sentence: bool, mark: bool) -> list[int]:
        key = (size, links, tag, sentence, mark)
        got = self.seen.get(key)
        return self.all(key, [f"run {size}", f"run links {links}", f"run in {tag}", f"sentence {sentence}", f"mark {mark}"]) if got is None else got


class Forest:
    """Nodes of several pages, with what the model sees of each."""

    def __init__(self, pages: list[str], numbers: Numbers, keep_attrs: bool = False):
        self.text, self.page, self.attrs, self.tag = [], [], [], []
        parents, depths, found, ends, kinds = [], [], [], [0], []
        for page, html in enumerate(pages):
            tree = Tree(html)
            base, size = len(self.text), len(tree.parent)
            chars, linked, runs = [0] * size, [0] * size, [0] * size
            for k in range(size - 1, -1, -1):
                if tree.text[k] is not None:
                    chars[k], linked[k], runs[k] = len(tree.text[k]), tree.linked[k], 1
                if k:
                    p = tree.parent[k]
                    chars[p] += chars[k]
                    linked[p] += linked[k]
                    runs[p] += runs[k]
            total = max(1, chars[0])
            for k in range(size):
                p, text, n = tree.parent[k], tree.text[k], chars[k]
                density = 4 * linked[k] // max(1, n)
                if text is not None:
                    found += numbers.run(min(8, _step(n)), density, tree.tag[p], text[-1] in ENDINGS, "©" in text)
                else:
                    found += numbers.element(tree.tag[k], tree.attrs[k])
                    found += numbers.shape(min(12, _step(n)), density, 4 * n // total, min(9, _step(n // max(1, runs[k]))))
                ends.append(len(found))
                kinds.append(0 if text is not None else 1 if tree.tag[k] in TEXTS else 2)
                parents.append(p + base if p >= 0 else -1)
            depths += tree.depth
            self.text += tree.text
            self.page += [page] * size
            if keep_attrs:
                self.attrs += tree.attrs
                self.tag += tree.tag
        self.found, self.ends = np.array(found, np.int64), np.array(ends)
        self.parent, self.kind = np.array(parents, np.int64), np.array(kinds, np.int64)
        # The nodes of each depth; messages go from one to the next.
        depth = np.array(depths, np.int64)
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, (depth.max() if len(depth) else 0) + 2))
        self.levels = np.split(order, cuts[:-1]) if len(order) else []
        self.row = np.repeat(np.arange(len(self.text)), np.diff(self.ends))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    """Logarithm of the sum of exponentials over the three states."""
    a, b, c = (x.take(i, axis) for i in range(3))
    top = np.maximum(np.maximum(a, b), c)
    return np.log(np.exp(a - top) + np.exp(b - top) + np.exp(c - top)) + top


def messages(forest: Forest, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(marginals, up, sent, down), all as logarithms: what nodes know from below, tell their parents, and hear from above."""
    size = len(forest.text)
    up = np.zeros((size, 3))
    for s in range(3):
        up[:, s] = np.bincount(forest.row, weights=weights[forest.found, s], minlength=size)
    up[forest.kind == 0, BOTH] = -1e9
    sent, down = np.zeros((size, 3)), np.zeros((size, 3))
    for level in reversed(forest.levels[1:]):
        sent[level] = _log_sum(edges[forest.kind[level]] + up[level][:, None, :], 2)
        p = forest.parent[level]
        low = p.min()
        for s in range(3):
            told = np.bincount(p - low, weights=sent[level, s])
            up[low:low + len(told), s] += told
    for level in forest.levels[1:]:
        p = forest.parent[level]
        down[level] = _log_sum(edges[forest.kind[level]] + (down[p] + up[p] - sent[level])[:, :, None], 1)
    belief = up + down
    return belief - _log_sum(belief, 1)[:, None], up, sent, down


def train(forests: list[tuple[Forest, np.ndarray]], features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and of edges (kind of child, state of parent, state of child) by Adam on the penalised likelihood.

    The steps take turns on the forests, each with its labels.
    """
    weights, edges = np.zeros((features, 3)), np.zeros((3, 3, 3))
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(edges), np.zeros_like(edges)]
    for step in range(1, STEPS + 1):
        forest, labels = forests[step % len(forests)]
        want = np.eye(3)[labels]
        child = np.flatnonzero(forest.parent >= 0)
        kind, parent = forest.kind[child], forest.parent[child]
        log, up, sent, down = messages(forest, weights, edges)
        gap = np.exp(log) - want
        g = np.column_stack([np.bincount(forest.found, weights=gap[forest.row, s], minlength=features) for s in range(3)])
        pair = (down[parent] + up[parent] - sent[child])[:, :, None] + edges[kind] + up[child][:, None, :]
        pair = np.exp(pair - _log_sum(_log_sum(pair, 2), 1)[:, None, None]) - want[parent][:, :, None] * want[child][:, None, :]
        e = np.stack([pair[kind == k].sum(axis=0) for k in range(3)])
        rate = RATE / (1 + step / STEPS * 4)
        for x, d, m, v in ((weights, g + PENALTY * weights, *moments[:2]), (edges, e + PENALTY * edges, *moments[2:])):
            d = d / max(1, len(labels)) * 100
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            x -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
    return weights, edges


def compose(rng: random.Random, words: list[str]) -> str:
    """A page with labelled parts; ``words`` is the text it is made of."""

    def some(least: int, most: int) -> str:
        n, at = rng.randint(least, most), rng.randrange(len(words))
        return " ".join(words[(at + i) % len(words)] for i in range(n))

    def prose(least: int = 1, most: int = 80) -> str:
        return some(least, most) + rng.choice([".", ".", ".", "!", "?", "", ":"])

    def open_tag(part: tuple[str, str], label: int | None) -> tuple[str, str]:
        tag, names = rng.choice(part[0].split()), part[1].split()
        chance = rng.random()
        # Telling elements often go without a name, plain ones rarely.
        plain = tag in ("div", "section", "ul", "ol", "ins")
        name = "" if chance < (0.05 if plain else 0.5) else " ".join(rng.sample(names, rng.choice([1, 1, 2])))
        name += rng.choice(["", "", "", f" c{rng.randrange(9999)}", "-1", "_box"]) if name else rng.choice(["", "", f"css{rng.randrange(9999)}"])
        key = rng.choice(["class", "class", "id"])
        mark = "" if label is None else f' {LABEL}="{label}"'
        return f"<{tag}" + (f' {key}="{name.strip()}"' if name.strip() else "") + mark + ">", f"</{tag}>"

    def heading(least: int, most: int, levels: str = "22334") -> str:
        level = rng.choice(levels)
        return f"<h{level}>{some(least, most)}</h{level}>"

    def links(n: int) -> str:
        chance = rng.random()
        if chance < 0.1:
            return "".join(f"<li>{some(1, 3)}</li>" for _ in range(n)) if chance < 0.05 else some(1, 4)
        if chance < 0.7:
            return "<ul>" + "".join(f'<li><a href="/x">{some(1, 4)}</a></li>' for _ in range(n)) + "</ul>"
        return "".join(f'<a href="/x">{some(1, 3)}</a> ' for _ in range(n))

    def furniture(kind: str) -> str:
        a, b = open_tag(PARTS[kind], FURNITURE)
        if kind == "menu" or kind == "share":
            body = links(rng.randint(1, 9))
        elif kind == "header":
            body = rng.choice(["", heading(1, 4, "112"), f'<a href="/">{some(1, 3)}</a>', f"<p>{some(2, 8)}</p>"]) + (links(4) if rng.random() < 0.5 else "")
        elif kind == "footer":
            body = rng.choice(["&copy; ", "© 2020 ", "<p>&copy; ", ""]) + prose(2, 25) + (links(4) if rng.random() < 0.5 else "")
        elif kind == "sidebar":
            body = rng.choice(["", heading(1, 4)]) + rng.choice([links(rng.randint(2, 8)), f"<p>{prose(3, 40)}</p>" * rng.randint(1, 3)])
        elif kind == "comments":
            item = rng.choice(["div", "li", "p"])
            body = heading(1, 3) * (rng.random() < 0.6) + "".join(
                f'<{item}{rng.choice(["", " class=comment"])}>{rng.choice(["", f"<b>{some(1, 2)}</b> ", f"<h4>{some(1, 2)}</h4>"])}<p>{prose(1, 60)}</p></{item}>' for _ in range(rng.randint(1, 5)))
        elif kind == "form":
            body = heading(1, 4) * (rng.random() < 0.3) + f'<label>{some(1, 4)}</label><input name="q"><p>{some(1, 10)}</p><button>{some(1, 2)}</button>'
        else:
            body = rng.choice(["{}", "<p>{}</p>", "<div>{}</div>"]).format(prose(2, 30)) + (f' <a href="/x">{some(1, 3)}</a>' if rng.random() < 0.4 else "")
        if rng.random() < 0.2:
            body = f"<div{rng.choice(['', ' class=inner', ' class=container'])}>{body}</div>"
        return a + body + b

    def block() -> str:
        kind = rng.random()
        if kind < 0.64:
            inner = prose(1, rng.choice([3, 20, 120]))
            if rng.random() < 0.3:
                inner += f' <a href="/y">{some(1, 5)}</a> {prose(1, 20)}'
            return f"<p>{inner}" + rng.choice(["</p>", "</p>", ""])
        if kind < 0.72:
            return heading(1, 8)
        if kind < 0.88:
            return rng.choice(["<div>{}</div>", "<div>{}</div>", "<div>{}</div>", "{}<br>", "<figure><img src=x><figcaption>{}</figcaption></figure>"]).format(prose(1, 60))
        if kind < 0.92:
            return "<ul>" + "".join(f"<li>{prose(1, 20)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
        if kind < 0.95:
            return f"<blockquote><p>{prose(4, 40)}</p></blockquote>"
        if kind < 0.98:
            return "<table>" + "".join(f"<tr><td>{some(1, 4)}</td><td>{some(1, 6)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        return f"<pre>{some(3, 20)}</pre>"

    a, b = open_tag(BODIES, ARTICLE)
    short = rng.random() < 0.2
    parts = [f"<h1>{some(1, 3 if short else 9)}</h1>"] * (rng.random() < 0.8) + [f"<p>{prose(1, 4)}" if short else block() for _ in range(rng.randint(1, 3 if short else 10))]
    for _ in range(0 if short else rng.choice([0, 0, 0, 1, 1, 2, 3])):
        parts.insert(rng.randrange(len(parts) + 1), furniture(rng.choice(list(PARTS))))
    article = a + "".join(parts) + b
    kinds = list(PARTS)
    before = [furniture(k) for k in rng.sample(kinds, rng.randint(0, 4))]
    after = [furniture(k) for k in rng.sample(kinds, rng.randint(0, 5))]
    middle = before[len(before) // 2:] + [article] + after[:len(after) // 2]
    if rng.random() < 0.5:
        a, b = open_tag(WRAPPERS, None)
        middle = [a, *middle, b]
    return "<html><head><title>x</title></head><body>" + "".join(before[:len(before) // 2] + middle + after[len(after) // 2:]) + "</body></html>"


def labelled(forest: Forest) -> np.ndarray:
    """State of each node by the labels in its page.

    A run has the label of its nearest labelled block: ``LABEL``, or what the element is for.  A block's state follows from its runs.
    """
    size = len(forest.text)
    known = np.full(size, FURNITURE)
    marked = {forest.page[k] for k in range(size) if LABEL in forest.attrs[k]}
    for k in range(size):
        p, page = forest.parent[k], forest.page[k]
        known[k] = known[p] if p >= 0 else FURNITURE
        if page in marked:
            m = re.search(LABEL + r'="(\d)"', forest.attrs[k])
            known[k] = int(m[1]) if m else known[k]
        elif forest.tag[k] in ("article", "main"):
            known[k] = ARTICLE
        elif forest.tag[k] in ("nav", "footer", "aside", "form"):
            known[k] = FURNITURE
    has = np.zeros((size, 2), bool)
    for k in range(size - 1, -1, -1):
        if forest.text[k] is not None:
            has[k, known[k]] = True
        elif not has[k].any():
            has[k, known[k]] = True  # nothing inside
        if forest.parent[k] >= 0:
            has[forest.parent[k]] |= has[k]
    return np.where(has.all(axis=1), BOTH, has[:, 1].astype(int))


Model = tuple[dict[str, int], np.ndarray, np.ndarray]


def learn(pages: list[str], composed: int = COMPOSED) -> Model:
    """(feature numbers, weights, edges) from labelled pages: those of ``pages`` whose markup says what is what, and composed ones."""
    rng = random.Random(1)
    words = " ".join(t for html in pages for t in Tree(html).text if t).split()[:200_000] or ["text"]
    words = [w.replace("<", " ").replace("&", " ") for w in words]
    own = [html for html in pages if re.search(r"<(article|main)\b", html)]
    made = [compose(rng, words) for _ in range(composed)]
    numbers, every = Numbers(), [re.sub(LABEL, "data-other", x) for x in own] + made
    forests = [Forest(every[k::TURNS], numbers, keep_attrs=True) for k in range(TURNS)]
    return numbers.known, *train([(f, labelled(f)) for f in forests], len(numbers.known))


def main_texts(pages: list[str], model: Model, numbers: Numbers | None = None) -> list[str]:
    """The article of each page: its blocks, joined by empty lines."""
    known, weights, edges = model
    forest = Forest(pages, numbers or Numbers(known))
    log = messages(forest, weights, edges)[0]
    out: list[list[str]] = [[] for _ in pages]
    for k in np.flatnonzero((forest.kind == 0) & (log[:, ARTICLE] > log[:, FURNITURE])).tolist():
        out[forest.page[k]].append(forest.text[k])
    return ["\n\n".join(x) for x in out]


def _extracted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(model[0])
        for part in slices(batches, 64):
            found = main_texts([x or "" for x in part.column("html").to_pylist()], model, numbers)
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(found, pa.string())], names=["page_id", "url", "text"])
    return run


def extract(pages: DataFrame, sample: int = SAMPLE, composed: int = COMPOSED) -> DataFrame:
    """page_id, url, text (empty if there is none), n_chars: one row per row of ``pages`` (page_id, url, html).

    Null html is empty.  Blocks come in page order, joined by empty lines; inside a block white space, also from line breaks,
    is one space; character references are decoded.  Repeated rows are pages of their own; other columns are not read; an empty table gives an empty result.
    The model is trained on at most ``sample`` pages of at most ``LARGEST`` characters, chosen by a hash of their content,
    and ``composed`` pages made of their text.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    place = F.shiftrightunsigned(F.xxhash64("html"), 1).alias("place")
    few = int(min(1.0, 4 * sample / max(1, rows.count())) * (2.0 ** 63 - 1024))
    # Only numbers are compared at large; the pages themselves come from the few chosen rows.
    places = [r.place for r in rows.filter(F.length("html") <= LARGEST).select(place).filter(F.col("place") < few).distinct().orderBy("place").limit(sample).collect()]
    some = rows.withColumn("place", place).filter(F.col("place").isin(places) & (F.length("html") <= LARGEST)).groupBy("place").agg(F.min("html").alias("html")).collect()
    model = learn(sorted(r.html for r in some), composed)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    found = rows.mapInArrow(_extracted(model), f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
