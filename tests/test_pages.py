import pytest

from staygrid.functions import markup
from staygrid.plans import pages

HTML = """<html lang=en><head><base href="/"><title>T &amp; U</title><meta name="keywords" content="a"><meta name="keywords" content="b">
<meta property="og:title" content="OG"><link rel="shortcut icon" href="/f.ico"><script>var x='<a href="/no">';</script></head>
<body><!-- <a href="/never"> --><nav><a href="/menu">M</a></nav><h1>Head</h1><p>One <b>two</b> <a class="k v" href='page.php'>three
lines</a><p>Next<ul><li>i1<li>i2</ul><a href="#top">t</a><a href="http:/x.org/q">r</a><a href="mailto:a@b.co">m</a>
<img srcset="s.png 1x, big.png 2x" src="s.png"><table><tr><th>n</th><th>v</th></tr><tr><td>a</td><td>1</td></tr></table></body></html>"""


@pytest.fixture
def one(spark):
    return spark.createDataFrame([(1, "https://example.org/foo/bar", HTML)], "page_id int, url string, html string")


def test_links(one):
    got = [r.link for r in pages.page_links(one, ["page_id"]).collect()]
    assert got == ["https://example.org/menu", "https://example.org/page.php", "http://x.org/q", "mailto:a@b.co"]


def test_metadata(one):
    m = pages.page_metadata(one, ["page_id"]).first().metadata
    assert m["title"] == "T & U" and m["language"] == "en" and m["ogTitle"] == "OG" and m["favicon"] == "/f.ico"
    assert m["keywords"] == '["a","b"]' and m["og:title"] == "OG"


def test_title_falls_back(spark):
    df = spark.createDataFrame([(1, '<head><meta property="og:title" content="X"></head>')], "page_id int, html string")
    assert pages.page_metadata(df, ["page_id"]).first().metadata["title"] == "X"


def test_images(one):
    got = {r.image for r in pages.page_images(one, ["page_id"]).collect()}
    assert got == {"https://example.org/s.png", "https://example.org/big.png", "https://example.org/f.ico"}


def test_attributes(one):
    rows = pages.page_attributes(one, ["page_id"], "a", "href", css_class="v").collect()
    assert [r.value for r in rows] == ["page.php"]


def test_clean_and_markdown(one):
    row = pages.clean_pages(one, "page_id", ["html", "markdown"]).first()
    assert "<script" not in row.html and "<nav" not in row.html and 'src="https://example.org/big.png"' in row.html
    assert row.markdown.startswith("# Head\n\nOne **two** [three lines](https://example.org/page.php)\n\nNext\n\n- i1\n\n- i2")
    assert "| n | v |\n| --- | --- |\n| a | 1 |" in row.markdown


def test_main_content_retry(spark):
    df = spark.createDataFrame([(1, "https://x.com/", "<nav>only menu</nav>")], "page_id int, url string, html string")
    assert pages.clean_pages(df, "page_id", ["markdown"]).first().markdown == "only menu"


def test_forced_content_is_kept():
    root = markup.cleaned('<div class="menu"><div id="main">x</div></div><div class="ad">y</div>', "https://x.com/", [], [], True)
    assert markup.text_of(root) == "x"


def test_include_tags():
    root = markup.cleaned("<p>a</p><div class=c>b</div>", "https://x.com/", [".c"], [], False)
    assert markup.text_of(root) == "b"


def test_polished():
    assert markup.polished("[a\nb](u) x\n[Skip to content](#m)y") == "[a\\\nb](u) x\ny"


def test_deep_page_does_not_recurse():
    deep = "<div>" * 20000 + "x" + "</div>" * 20000
    assert markup.to_markdown(markup.cleaned(deep, "https://x.com/", [], [], True)) == "x"
