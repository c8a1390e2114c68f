"""Hard negatives, page trees, lexical search."""

import html
import math
import random
import re

import llm_cases as cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from staygrid.llm import lexical, negatives, pagetrees
from staygrid.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def mined(rows, anchor, positives=5, negs=5):
    """(anchor, positive, rank, negative, score, score) of (id, label, vector) rows, by comparing all."""
    out = set()
    rows = list({(i, n, tuple(q)): (i, n, q) for i, n, q in rows}.values())
    for a, label, q in rows:
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, r)), i, n) for i, n, r in rows if i != a)
        own = [(i, -s) for s, i, n in scored if n == label][:positives]
        for i, p in own:
            good = [(j, -s) for s, j, n in scored if n != label and 80 * p <= -100 * s <= 100 * p][:negs]
            out |= {(a, i, rank, j, p, s) for rank, (j, s) in enumerate(good, 1)}
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label long, vector array<long>")


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(3), [rng.randrange(-6, 7) for _ in range(6)]) for i in range(400)]
    rows += [(400 + i, i % 3, [3, 3, 3, 0, 0, 0]) for i in range(200)]  # a vector that many rows have
    rows += rows[:5]
    for shard, block in ((8192, 1 << 16), (40, 7)):
        got = negatives.mine(vectors(spark, rows), F.col("vec_id") % 20 == 0, sample=64, shard=shard, block=block)
        assert {tuple(r) for r in got.collect()} == mined(rows, lambda a: a % 20 == 0)


def test_negatives_of_odd_rows(spark):
    rows = [(1, 1, [1, 2]), (2, 1, [2, 2]), (3, 2, [1, 2]), (4, 2, [1, 1, 5]), (5, None, [1, 2]), (6, 2, None), (None, 2, [1, 2]), (7, 2, []), (8, 2, [None, 1]), (0, 2, [0, 1])]
    got = negatives.mine(vectors(spark, rows).withColumns({c: F.lit("x") for c in cases.CLASHES}), F.col("vec_id") < 3)
    usable = [(1, 1, [1, 2, 0]), (2, 1, [2, 2, 0]), (3, 2, [1, 2, 0]), (4, 2, [1, 1, 5]), (7, 2, [0, 0, 0]), (0, 2, [0, 1, 0])]
    found = got.collect()
    assert {tuple(r) for r in found} == mined(usable, lambda a: a < 3) and len(found) == len(set(found))
    assert negatives.mine(vectors(spark, rows).limit(0), F.lit(True)).count() == 0
    assert negatives.mine(vectors(spark, rows), F.lit(None).cast("boolean")).count() == 0
    values = [[1.0, 2.0], [float("nan")], [float("inf")], [None], None, []]
    frame = spark.createDataFrame([(v,) for v in values], "v array<float>")
    assert [r.ok for r in frame.select(negatives.finite(F.col("v")).alias("ok")).collect()] == [True, False, False, False, False, True]
    assert frame.limit(1).select(negatives.quantised(F.col("v") / 3 if False else F.transform("v", lambda x: -x / 3)).alias("q")).first().q == [-86, -171]


def ranked(docs, items, keep=10):
    """(item, rank, doc, score) by scoring every document."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lists = [(i, term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in docs]
    count, words = sum(bool(t) for _, t in lists), sum(len(t) for _, t in lists)
    df = {}
    for _, t in lists:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        asked = set(term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        scores = []
        for i, t in lists:
            m = 10 + 90 * len(t) * count // words if t else 0
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in asked if x in t)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:keep], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_search_against_scoring_all(spark, seed, monkeypatch):
    monkeypatch.setattr(lexical, "FIRST", 3)
    rng = random.Random(seed)
    letters = "a b C d é 7 g h i j k l m n o p".split()

    def text(n):
        return rng.choice([" ", "-", ", "]).join(rng.choices(letters, [2.0 ** -k for k in range(len(letters))], k=n))

    docs = [(i, text(rng.randrange(40))) for i in range(300)] + [(1000 + i, "o p a") for i in range(100)] + [(None, "p o"), (7, "p"), (900, None)]
    items = [(i, text(rng.randrange(1, 9))) for i in range(8)] + [(8, None), (9, "zzz"), (3, "o p"), (None, "p p o")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for postings, queries in ((1 << 20, 1024), (150, 5)):
        got = lexical.search(frame, asked, postings=postings, queries=queries).collect()
        assert sorted((tuple(r) for r in got), key=str) == ranked(docs, items)


def test_intervals_are_split(monkeypatch):
    """Whole search by splitting, also where leaves are single documents."""
    rng = np.random.default_rng(3)
    import pyarrow as pa

    monkeypatch.setattr(lexical, "LEAF", 0)
    shard = lexical.Shard([b"a", b"b", b"c"], np.array([5, 7, 1]))
    docs = [[t for t in (b"a", b"b", b"c") if rng.random() < 0.4] for _ in range(200)]
    tfs = [[int(x) for x in rng.integers(1, 5, len(d))] for d in docs]
    shard.add(pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array([10] * 200, pa.int64()), pa.array(docs, pa.list_(pa.binary())),
                                          pa.array(tfs, pa.list_(pa.int64()))], names=["id", "m", "terms", "nums"]))
    shard.close()
    w = {b"a": 5, b"b": 7, b"c": 1}
    scores = [sum(w[t] * (10**9 * f // (1000 * f + 80)) for t, f in zip(d, fs)) for d, fs in zip(docs, tfs)]
    want = sorted((-s, i) for i, s in enumerate(scores) if s)[:10]
    assert sorted((-s, i) for s, i in shard.search(np.array([0, 1, 2]), 10, 0)) == want


def test_search_of_odd_rows(spark):
    items = cases.benchmark(spark, [(1, "lorem fox"), (2, None), (2, "a")])
    got = lexical.search(cases.odd(spark), items).collect()
    assert sorted((tuple(r) for r in got), key=str) == ranked(cases.TEXTS, [(1, "lorem fox"), (2, None), (2, "a")])
    assert lexical.search(cases.none(spark), items).count() == 0 and lexical.search(cases.odd(spark), items.limit(0)).count() == 0


PAGES = {
    "cookie": ('<html><body><div id="cookie-notice"><p>We use cookies to improve. Accept all of them now.</p><button>OK</button></div>'
               '<header class="site-header"><a href="/">Site</a><nav><ul><li><a href=/a>Home</a><li><a href=/b>About</a></ul></nav></header>'
               '<main><h1>Title of it</h1><p>A first paragraph of text that says something, and more.</p><p>Short.</p>'
               '<aside class="related"><h3>Related</h3><ul><li><a href=x>Other story</a></ul></aside><p>Last paragraph &amp; end.</p></main>'
               '<section id="comments"><h2>Comments</h2><div class="comment"><p>Great article, I liked it a lot.</p></div></section>'
               '<footer><p>&copy; 2020 Site</p></footer></body></html>',
               ["Title of it", "A first paragraph of text that says something, and more.", "Short.", "Last paragraph & end."]),
    "divs": ('<html><body><div class="menu"><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div class="content"><h1>Head line</h1>'
             '<div>Text straight in a div, long enough to be an article text of its own. It goes on for a while.</div>'
             '<p>More text here, with <a href=x>a link</a> inside.</p><div class="ad">Buy now! Cheap things.</div></div>'
             '<div class="sidebar"><p>Popular posts you may like to read as well.</p></div><div id="footer">Copyright 2020</div></body></html>',
             ["Head line", "Text straight in a div, long enough to be an article text of its own. It goes on for a while.", "More text here, with a link inside."]),
    "table": ("<body><nav>m</nav><article><table><tr><td>a<td>b<tr><td>c</table><pre>x  y\nz</pre><p>one<br>more<p>two<ul><li>i<li>j</ul></article></body>",
              ["a", "b", "c", "x y z", "one more", "two", "i", "j"]),
    "signs": ("<article><p>a < b and c > d &lt;ok&gt; 1&nbsp;2<script>var x='<p>';</script></p></article>", ["a < b and c > d <ok> 1 2"]),
    "text": ("hello world", ["hello world"]),
    "empty": ("", []),
    "deep": ("<div>" * 2000 + "x" + "</div>" * 2000, ["x"]),
}


def test_pages(spark):
    rows = spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame([(k, k, page) for k, (page, _) in PAGES.items()] + [(None, None, None), ("text", "text", "hello world")], "page_id string, url string, html string")
    model = pagetrees.learn([r.html for r in rows.limit(60).collect()])
    assert dict(zip(PAGES, pagetrees.main_texts([p for p, _ in PAGES.values()], model))) == {k: "\n\n".join(t) for k, (_, t) in PAGES.items()}
    got = pagetrees.extract(odd.withColumns({c: F.lit("x") for c in cases.CLASHES}), composed=20).collect()
    assert len(got) == len(PAGES) + 2 and all(r.n_chars == len(r.text) for r in got)
    assert pagetrees.extract(odd.limit(0), composed=20).count() == 0


def test_composed_pages_apart_from_training():
    """Layouts and names of parts that the model was not trained on."""
    words = [f"word{i}" for i in range(500)]
    model = pagetrees.learn(["<article><p>" + " ".join(words) + "</p></article>"])
    pages = [pagetrees.compose(random.Random(f"held {k}"), words) for k in range(200)]
    marked = pagetrees.Forest(pages, pagetrees.Numbers(model[0]), keep_attrs=True)
    want = pagetrees.labelled(marked)
    bare = pagetrees.Forest([re.sub(f' {pagetrees.LABEL}="."', "", p) for p in pages], pagetrees.Numbers(model[0]))
    log = pagetrees.messages(bare, *model[1:])[0]
    runs = bare.kind == 0
    assert np.allclose(np.exp(log).sum(axis=1), 1)
    assert ((log[:, pagetrees.ARTICLE] > log[:, pagetrees.FURNITURE]) == (want == pagetrees.ARTICLE))[runs].mean() > 0.98


def test_messages_against_all_states():
    """Marginals of a small tree by summing over every assignment."""
    import itertools

    rng = np.random.default_rng(5)
    numbers = pagetrees.Numbers()
    forest = pagetrees.Forest(["<div><p>a</p>b</div>"], numbers)
    weights, edges = rng.normal(size=(len(numbers.known), 3)), rng.normal(size=(3, 3, 3))
    own = np.zeros((len(forest.text), 3))
    np.add.at(own, forest.row, weights[forest.found])
    total = np.zeros_like(own)
    for states in itertools.product(range(3), repeat=len(own)):
        if any(s == pagetrees.BOTH and forest.kind[k] == 0 for k, s in enumerate(states)):
            continue
        p = sum(own[k, s] + (edges[forest.kind[k], states[forest.parent[k]], s] if forest.parent[k] >= 0 else 0) for k, s in enumerate(states))
        for k, s in enumerate(states):
            total[k, s] += math.exp(p)
    got = np.exp(pagetrees.messages(forest, weights, edges)[0])
    assert np.allclose(got, total / total.sum(axis=1, keepdims=True))


def test_extraction_of_the_table(spark):
    """Every page's article element, tags taken off."""
    got = {r.page_id: r.text for r in QUERIES["op12_html_extraction"](spark, FOLDER).collect()}
    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)
