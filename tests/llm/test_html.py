from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from quarrylight.llm import html
from quarrylight.llm.queries import op2_html_text

SMALL = html.Settings(pages=300, epochs=5)


@pytest.fixture(scope="module")
def model(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    return html.fit(pages, SMALL)


@pytest.fixture(scope="module")
def full_model(spark):
    return html.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def test_blocks():
    page = "<html><head><title>no</title><style>p{}</style></head><body><!-- <p>no</p> --><p>One &amp; <b>two</b>\n three<br>four<p>Five</p><script>var a='</p>';</script>tail<div>a<ul><li>x<li>y</ul>b</div>"
    assert [b.text for b in html.parse(page)] == ["One & two three four", "Five", "tail", "a", "x", "y", "b"]


def test_formulas_drawings_and_fallbacks():
    page = "<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold<p>See <svg viewBox='0 0 1 1'><path d='M0'/><g><text>axis</text><text>label</text></g></svg> here<div><object data=a><p>fallback</p></object><noscript>no script</noscript></div><canvas>drawn</canvas> end"
    assert [b.text for b in html.parse(page)] == ["Let x=1 hold", "See axis label here", "fallback", "no script", "drawn end"]


@pytest.mark.parametrize("name", "object svg math canvas noscript script style template title iframe".split())
def test_elements_without_end_tag(model, name):
    menu, article = "<nav><a>Home</a> <a>About us</a></nav>", "<article>" + "<p>The amber river ran slowly past the old stone mill, and maple leaves fell.</p>" * 4 + "</article>"
    whole = [b.text for b in html.parse(f"<body>{menu}{article}</body>")]
    blocks = html.parse(f"<body>{menu}<{name} x='1'>{article}</body>")
    assert [b.text for b in blocks] == whole
    kept = html.label_pages([blocks], model, SMALL)[0] >= 0.5
    assert [b.text for b, k in zip(blocks, kept, strict=True) if k] == whole[-4:]


@pytest.mark.parametrize("page", ["", "<", "< p", "<p", "<p class='x>never closed", "</p></div>text", "<!-- open", "<script>open", "&lt;b&gt; &#x41; &nosuch;", "<p>" * 500 + "deep", "<a " + "x='" * 300])
def test_broken_pages(page):
    html.parse(page)


def test_gradients_match_differences():
    settings = html.Settings(path_bits=4, word_bits=4, path_dim=3, word_dim=2, hidden=3)
    pages = [html.describe(html.parse(p), settings, labels) for p, labels in [("<nav>a b</nav><p>c d e.</p><p>f</p>", [0, 1, 1]), ("<p>x</p><div class=ad>y z</div>", [1, 0])]]
    p = {k: v.astype(np.float64) for k, v in html.initial(settings).items()}
    batch = html.Batch(pages)

    def loss():
        chance, _ = batch.forward(p)
        return -np.mean(np.where(batch.labels == 1, np.log(chance), np.log(1 - chance)))

    grads = batch.gradients(p)
    for name in ("fx", "bh", "f0", "out", "path", "word"):
        flat = p[name].ravel()
        for at in np.argsort(-np.abs(grads[name].ravel()))[:3]:
            kept, step = flat[at], 1e-2
            flat[at] = kept + step
            up = loss()
            flat[at] = kept - step
            down = loss()
            flat[at] = kept
            assert abs((up - down) / (2 * step) - grads[name].ravel()[at]) < 2e-3


@pytest.mark.parametrize("layout", [None, *html.LAYOUTS])
def test_held_out_layouts(full_model, layout):
    maker = html.PageMaker(["amber", "stone", "river", "cloud", "maple", "ember"], 1234, layout)
    parsed = [html.parse(maker.page()) for _ in range(150)]
    labels = [[b.text.startswith(html.KEEP) for b in p] for p in parsed]
    for b in (b for p in parsed for b in p):
        b.text = b.text.replace(html.KEEP, "") or "x"
    right = np.concatenate([(c >= 0.5) == np.array(a) for a, c in zip(labels, html.label_pages(parsed, full_model, html.Settings()), strict=True)])
    assert right.mean() > 0.95


def test_pages_without_names(full_model):
    """Menus and the line of the copyright by what they are, not by what they are called."""
    text = "<h1>The old mill</h1>" + "<p>The amber river ran slowly past the old stone mill, and maple leaves fell on it all day long.</p>" * 4
    menu = "<a href=/>Home</a> <a href=/a>About</a> <a href=/n>News</a>"
    for page in (f"<div>{menu}</div><div>{text}</div><div>Copyright 2024 by the mill</div>", f"<table><tr><td>{menu}</td></tr><tr><td>{text}</td></tr></table>"):
        blocks = html.parse(page)
        kept = [b.text for b, c in zip(blocks, html.label_pages([blocks], full_model, html.Settings())[0], strict=True) if c >= 0.5]
        assert "Home About News" not in kept and sum("amber river" in x for x in kept) == 4


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("<p>a <a href=x'y>b</a> c</p>", ["a b c"]), ("<p title=it's>hello</p>", ["hello"]), ("<p title=\"a>b\">c</p>", ["c"]), ("<p a='>' b=\">\" c = d>e</p>", ["e"]),
        ("<p x=\"never closed>one</p><p>two</p>", ["one", "two"]), ("a<!-->b<!--->c<!-- > -->d<!-- x --!>e", ["abcde"]), ("<!doctype html><?xml a?></ x>t", ["t"]),
        ("<p =a=b>c<p/>d", ["c", "d"]), ("1 < 2 <3 and a<b", ["1 < 2 <3 and a<b"]), ("<p a=b/>c", ["c"]), ("<script>a</scripty>b</script >c", ["c"]), ("x &#x0000000041;&#00000066; &#99999999999; &#x110000;", ["x AB \ufffd \ufffd"]),
    ],
)
def test_tags_by_the_standard(page, blocks):
    assert [b.text for b in html.parse(page)] == blocks


def test_long_broken_markup_in_linear_time():
    import time

    pages = ["<a " * 350_000, '<a "' * 250_000, "<! " * 350_000, "</ " * 350_000, "<a x='" * 170_000, '<a x=">" ' * 110_000, "<a x=\"1\" " * 100_000 + '<a y=">', "<!--" * 250_000, "</script " * 110_000, "<script>" + "</script " * 110_000, "&#" + "1" * 1_000_000, "class=" * 170_000, "<p " + "class " * 170_000 + ">x"]
    for page in pages:
        began = time.process_time()
        html.parse(page)
        assert time.process_time() - began < 5, page[:20]


class Texts(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text = []

    def handle_data(self, data):
        self.text.append(data)


@given(st.lists(st.sampled_from(["<p>", "</p>", "<b x=1>", "</b>", "<i y='a>b'>", "<i z=\"c'd\">", "<br/>", "<hr a = b >", "word", " ", "&amp;", "é", "<!-- c > -->", "<u v=it's>", "<p w>", "<p / q=1>", "1 < 2"]), max_size=25))
def test_same_text_as_another_parser(parts):
    page = "".join(parts)
    other = Texts()
    other.feed(page)
    other.close()
    assert "".join("".join(b.text.split()) for b in html.parse(page)) == "".join("".join(other.text).split())


class Reader(HTMLParser):
    """The blocks of the article by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = self.hidden = 0
        self.blocks, self.text = [], ""

    def end_block(self):
        if text := " ".join(self.text.split()):
            self.blocks.append(text)
        self.text = ""

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.hidden += tag in ("script", "style", "nav", "aside", "form", "footer")
        if tag not in html.INLINE:
            self.end_block()

    def handle_endtag(self, tag):
        if tag not in html.INLINE:
            self.end_block()
        self.hidden -= tag in ("script", "style", "nav", "aside", "form", "footer")
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside and not self.hidden:
            self.text += data


def test_given_pages_by_another_parser(spark):
    rows = {r.page_id: r.text for r in op2_html_text(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        reader = Reader()
        reader.feed(r.html)
        assert rows[r.page_id] == "\n\n".join(reader.blocks)


def test_pages_of_any_size(model):
    import time
    import tracemalloc

    pages = ["<nav><a>Home</a></nav>" + "<p>A line of plain words, and some more of them.</p>" * 20_000, "<div>" * 50_000 + "text" + "</div>" * 50_000, "<div><p>x" * 20_000, "<p class='" + "a " * 50_000 + "'>" + "<b>y</b><br>" * 20_000, "</i>" * 100_000]
    pages += ["<article><p>Few words.</p></article>"] * 63
    began = time.process_time()
    parsed = [html.parse(p) for p in pages]
    tracemalloc.start()
    chances = html.label_pages(parsed, model, SMALL)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(c) for c in chances] == [len(p) for p in parsed] and len(parsed[0]) == 20_001
    assert peak < 300 << 20 and time.process_time() - began < 120
    alone = html.label_pages([parsed[-1]], model, SMALL)[0]
    assert np.allclose(alone, chances[-1], atol=1e-5)


def test_slices():
    assert list(html._slices([1, 9, 9, 1, 1], rows=2, limit=10)) == [(0, 2), (2, 4), (4, 5)]
    assert list(html._slices([])) == []


def test_given_pages(spark):
    rows = {r.page_id: r for r in op2_html_text(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = r.html[r.html.index("<article>") : r.html.index("</article>")]
        wanted = "\n\n".join(b.text for b in html.parse(inner))
        assert rows[r.page_id].text == wanted and rows[r.page_id].n_chars == len(wanted)


def test_odd_pages(spark, model):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p></p>"), (4, "u", "<article>" + "<p>word " * 3000 + "</article>"), (4, "u", "text"), (None, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS text", "1 AS n_chars")
    out = html.extract(pages, model, SMALL).collect()
    assert len(out) == 6 and [r.text for r in out if r.page_id in (1, 2, 3)] == ["", "", ""]
    assert all(r.n_chars == len(r.text) for r in out)
    assert html.extract(pages.limit(0), model, SMALL).count() == 0
    html.training_pages([], html.Settings(pages=3))
