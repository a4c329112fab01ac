import random
import re

import pytest

from tessera.llm import wrappers as X

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/">Menu</a></ul></nav><div class="cookie-notice">Notice</div>
<main><article><header><h1>T&eacute;st &amp;  title</h1></header><p>One <b>two</b>,
 three<br>four</p><!-- <p>no</p> --><ul><li>x<li>y</ul><div class="ad">Advert</div><table><tr><td>1<td>2</table></article>
<section id="comments"><article class="comment">Comment</article></section><form><label>Form</label></form></main>
<aside>Side</aside><footer>&copy; Foot</footer></body></html>"""


def test_article():
    assert X.extract(PAGE) == "Tést & title\nOne two, three four\nx\ny\n1\n2"


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\nb"), ("<p>cut of", "cut of"), ("<p>a &am", "a &am"), ("<p>a &amp", "a &"), ("<p>a</p><p", "a"),
    ("<div>a<span>b</span> c</div>", "ab c"), ("<script>x</script>y", "y"), ("<p>a<script>x", "a"), ("<nav>m</nav><div>a</div><div class='sidebar'>s</div>", "a"),
    ("<article></article><p>out", "out"), ("<p>&lt;b&gt; &#233;&#x41;", "<b> éA"), ("<p title='a > b'>x", "x"), ("a&nbsp;&nbsp;b", "a b"), ("<b>x<i>y</b>z</i>", "xyz"),
    ("<P>Upper</P><DIV CLASS=AD>n</DIV>", "Upper"), ("</p></div>x", "x"), ("<![CDATA[x]]>y<?php z ?>", "y"),
])
def test_pages(page, text):
    assert X.extract(page) == text


def page(title, items, extra=""):
    lis = "".join(f"<li>{x}</li>" for x in items)
    return f"<html><body><div>Welcome to the site</div><h2>{title}</h2><ul>{lis}</ul>{extra}<div>All rights</div></body></html>"


def test_inference():
    w = X.infer([page("A", "123"), page("B", "45", "<p>more</p>"), page("C", "6789")])
    text = X.expression(w.root)
    assert "(<li> #text </li>)+" in text and "(<p> 'more' </p>)?" in text and "'Welcome to the site'" in text and "<h2> #text </h2>" in text
    assert frame(w) == ["All rights", "Welcome to the site"] and frame(X.infer([page("A", "1"), page("B", "2")])) == []
    assert X.infer([]) is None and X.Wrapper.load(w.dump()) == w  # what a task hands over is whole


def frame(w):
    todo, found = [w.root], []
    while todo:
        x = todo.pop()
        todo += x.parts
        found += [x.text] if x.kind == "#" and X.label(x, w) == "frame" else []
    return sorted(found)


def as_pattern(x):
    """A wrapper as a regular expression over the symbols of a page: the language by brute force."""
    inside = "".join(map(as_pattern, x.parts))
    inside = f"(?:{inside})*" if x.free else inside
    body = "#;" if x.kind == "#" else inside if x.kind == "(" else f"{x.kind};{inside}/{x.kind};"
    return f"(?:{body}){'*' if x.opt and x.repeat else '+' if x.repeat else '?' if x.opt else ''}"


@pytest.mark.parametrize("seed", range(6))
def test_every_page_belongs_to_the_language_of_its_wrapper(seed):
    r = random.Random(seed)

    def body(depth):
        out = ""
        for _ in range(r.randint(0, 5 if depth < 3 else 2)):
            tag = r.choice(["div", "p", "section", "h2", "ul", "table"][: 6 if depth < 3 else 2])
            out += f"<{tag}>{r.choice(['', 'x', 'y', body(depth + 1) if depth < 3 and tag != 'p' else 'z'])}</{tag}>" if r.random() < 0.8 else r.choice(["t ", "u "])
        return out

    pages = [f"<body><div>{body(0)}</div>{body(1)}</body>" for _ in range(25)]
    whole, halves = X.infer(pages), [X.infer(pages[:9]), X.infer(pages[9:])]
    halves[0].take(X.Wrapper.load(halves[1].dump()))
    for w in (whole, halves[0]):
        language = re.compile(as_pattern(w.root))
        for p in pages:
            tokens = X.tokens(p)
            assert language.fullmatch("html;" + "".join(t.symbol + ";" for t in tokens) + "/html;"), (p, X.expression(w.root))
            own = X.Wrapper.of(tokens, True)
            met = [k for y, _ in X.match([w.root], [own.root]) for k in y.src]
            assert sorted(met) == [k for k, t in enumerate(tokens) if t.text is not None]


def test_many_kinds_of_parts_come_in_any_order():
    kinds = [f"<x-{k}>{k}</x-{k}>" for k in range(100)]
    pages = ["".join(random.Random(k).sample(kinds, 60)) for k in range(4)]
    w = X.infer(pages)
    assert w.root.free and all(re.fullmatch(as_pattern(w.root), "html;" + "".join(t.symbol + ";" for t in X.tokens(p)) + "/html;") for p in pages)
    flood = ["".join(f"<div><x-{a}><y-{b}>{c}</y-{b}></x-{a}></div>" for a in range(40) for b in range(40)) for c in range(2)]
    w = X.infer(flood)
    assert X.size(w.root) <= 2 * X.MOST_NODES and X.extract(flood[1], w).count("1") == 1600


def test_the_wrapper_decides(spark):
    """A host whose pages have neither main elements nor telling names: without its wrapper all of its frame would stay."""
    body = "<html><body><div>Daily Herald</div><div><a href=1>Start</a><a href=2>World</a></div><div><h2>Title {0}</h2><p>Text {0}</p>{1}</div><div>Imprint</div></body></html>"
    quote = "<blockquote>Imprint</blockquote>"  # the same text at another place is no frame
    rows = [(i, "http://h.example/x", body.format(i, quote if i == 3 else "")) for i in range(6)]
    out = {r.page_id: r.text for r in X.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: f"Title {i}\nText {i}" + ("\nImprint" if i == 3 else "") for i in range(6)}
    assert X.extract(rows[0][2]) == "Daily Herald\nStartWorld\nTitle 0\nText 0\nImprint"


@pytest.mark.parametrize("page,text", [
    ('<article><div class="related-work"><p>real text</p></div><p class="share">and more</p></article>', "real text\nand more"),
    ('<div class="page-header"><h1>Title</h1></div><div class="social-science"><p>body</p></div>', "Title\nbody"),
    ('<article><p>t</p><div class="share"><a href=1>Share this</a></div></article>', "t"),
    ('<div class="header">Site</div><p>t</p><div class="notice">We use cookies</div>', "t"),
    ("<b>" * 30 + "x</b></b>y" + "</b>" * 40 + "<p>z</i></b>", "xy\nz"), ("<svg><path d=''/><g/></svg><p>x", "x"),
])
def test_names_are_evidence(page, text):
    assert X.extract(page) == text


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(7, "http://r.example/a", "<div>Menu</div><p>same")] * 5000 + [(k, "http://r.example/b", f"<div>Menu</div><p>own {k}") for k in range(100, 110)]
    docs = spark.createDataFrame([(*r, "w", 1, 2) for r in rows], "page_id long, url string, html string, wrapper string, task int, host int").repartition(6)
    out = X.extract_pages(docs).groupBy("page_id", "text").count().collect()
    assert {(r.page_id, r.text, r["count"]) for r in out} == {(7, "same", 5000)} | {(k, f"own {k}", 1) for k in range(100, 110)}


def test_frame_goes(spark):
    rows = [(i, "http://h.example/x", page(f"Title {i}", "abc"[: i % 3 + 1])) for i in range(6)] + [(9, None, None), (10, "odd", "<p>x"), (10, "odd", "<p>x"), (None, "http://h.example/", "<p>q")]
    df = spark.createDataFrame([(*r, 1, True) for r in rows], "page_id long, url string, html string, host int, main boolean")
    out = X.extract_pages(df).collect()
    assert len(out) == len(rows)
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in out}
    assert got[0, "http://h.example/x"] == ("Title 0\na", 9) and got[9, None] == ("", 0) and got[10, "odd"] == ("x", 1) and got[None, "http://h.example/"] == ("q", 1)
    joined = X.extract_pages(df, broadcast_bytes=-1).collect()
    assert sorted(map(tuple, joined), key=str) == sorted(map(tuple, out), key=str)
    assert X.extract_pages(df.limit(0)).count() == 0


def test_table(spark, sf):
    import html
    import re

    for r, t in zip(*[spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").collect(), X.op1_html(spark, sf).orderBy("page_id").collect()], strict=True):
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>|<[^>]*\Z", "", x))).strip() for x in re.split(r"<br>|</?p>|</?h1>", body)]
        assert t.text == "\n".join(p for p in parts if p) and t.n_chars == len(t.text)


def test_long_page():
    deep = "<div>" * 4000 + "x" + "</div>" * 4000 + "<p>y" * 2000
    assert X.extract(deep) == "\n".join(["x"] + ["y"] * 2000)
    assert X.infer([deep, deep + "<p>z"]) is not None


def test_a_list_that_never_changes_is_a_menu():
    pages = [page(f"T{k}", ["Home", "News"], f"<ul><li>x{k}<li>y</ul>") for k in range(4)]
    assert X.extract(pages[2], X.infer(pages)) == "T2\nx2\ny"


def test_frame_inside_an_article(spark):
    body = "<html><body><article><h1>T{0}</h1><div>Subscribe to us</div><p>Text {0}</p></article></body></html>"
    rows = [(i, "http://h.example/x", body.format(i)) for i in range(5)] + [(9, "http://other.example/", body.format(9))]
    out = X.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in out.collect()} == {i: f"T{i}\nText {i}" for i in range(5)} | {9: "T9\nSubscribe to us\nText 9"}


def test_frame_of_all_pages(spark):
    # copies of one text and long pages: a sample sees too few distinct pages; a heading on few of all pages is no frame
    far = "x" * 250_000
    rows = [(i, "http://c.example/", page("Same", "ab")) for i in range(300)] + [(1000 + i, "http://c.example/", page(f"Other {i}", f"a{i}", "<h3>Intro</h3>" if i < 9 else "")) for i in range(30)]
    rows += [(2000 + i, "http://long.example/", f"<div>Menu</div><p>{far}{i}") for i in range(3)]
    out = {r.page_id: r.text for r in X.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert out[0] == "Same\na\nb" and out[1000] == "Other 0\na\n0\nIntro" and out[1029] == "Other 29\na\n2\n9"
    assert out[2001] == far + "1"


@pytest.mark.parametrize("page,text", [
    ("<article><p>a</p><figure><table><tr><td>1<td>2</table><figcaption>Caption</figcaption></figure><figure><pre>code</pre></figure></article>", "a\n1\n2\nCaption\ncode"),
    ("<article><p>let <math><msup><mi>x</mi><mn>2</mn></msup></math> be</p></article>", "let x2 be"),
    ("<main><h1>Title</h1><p>lead</p><nav>Menu</nav><article>Text</article><p>after</p></main><p>out", "Title\nlead\nText\nafter"),
    ("<article>a<object>plain</object><svg><text>Axis</text></svg><xmp><b>x</xmp><dialog>Notice</dialog></article>", "a\nplain\nAxis\n<b>x"),
])
def test_nothing_lost_in_main(page, text):
    assert X.extract(page) == text
