from pyspark.sql import functions as F

from quillstack.operators import graph as gr
from quillstack.operators import web as wb


def value(spark, column, **cells):
    names = ", ".join(f"{n} string" for n in cells)
    return spark.createDataFrame([tuple(cells.values())], names).select(column.alias("x")).first()["x"]


def test_links(spark):
    html = """<a href="https://other.org/x">1</a> <a class=b href='/page1'>2</a><a href="page2">3</a><A HREF="../page3#top">4</A>
    <a href="#in">5</a><a href="javascript:x()">6</a><a href="mailto:a@b">7</a><a href="tel:1">8</a><a href=" ">9</a>
    <a href="?q=1&amp;r=2">10</a><a href="//cdn.org/y">11</a><a href="/page1">again</a><!-- <a href="/no">c</a> -->
    <script>var s = '<a href="/no2">';</script><a href="./a/./b/../c/">12</a><a data-href="/no3">13</a><a href="../../../up">14</a>"""
    base = "https://example.com/docs/"
    links = value(spark, wb.page_links(F.col("h"), F.col("u")), h=html, u=base)
    assert links == [
        "https://other.org/x", "https://example.com/page1", "https://example.com/docs/page2", "https://example.com/page3#top",
        "https://example.com/docs/?q=1&r=2", "https://cdn.org/y", "https://example.com/docs/a/c/", "https://example.com/up",
    ]
    # A page without a path resolves against the root.
    assert value(spark, wb.page_links(F.col("h"), F.col("u")), h='<a href="x">', u="http://h.org") == ["http://h.org/x"]


def test_url_rules(spark):
    assert value(spark, wb.normalize_url(F.col("u")), u="HTTP://Ex.org/a?b=1#c") == "http://Ex.org/a?b=1"
    assert value(spark, wb.normalize_url(F.col("u")), u="ftp://ex.org/a") is None
    assert value(spark, wb.should_crawl(F.col("u"), F.lit("ex.org"), None, ["admin"]), u="http://ex.org/päge") is True
    assert value(spark, wb.should_crawl(F.col("u"), F.lit("ex.org"), None, ["admin"]), u="http://ex.org/admin") is False
    assert value(spark, wb.should_crawl(F.col("u"), F.lit("ex.org")), u="http://sub.ex.org/") is False


def test_robots_longest_prefix_and_ties(spark):
    urls = spark.createDataFrame([("http://h/a/b",), ("http://h/a/c",), ("http://h/",), ("http://other/a",)], "url string")
    rules = spark.createDataFrame(
        [("h", "*", "/a", False), ("h", "*", "/a/b", True), ("h", "*", "/a/b", False), ("h", "x", "/", False)],
        "host string, agent string, prefix string, allow boolean",
    )
    out = {r.url: r.allowed for r in wb.robots_allowed(urls, rules, "me").collect()}
    assert out == {"http://h/a/b": True, "http://h/a/c": False, "http://h/": True, "http://other/a": True}


def test_markdown(spark):
    html = """<html><head><title>T</title></head><body><h1>Head &amp; more</h1><p>A <b>bold</b> <a href="/x">link</a><br>new</p>
    <ul><li>one</li><li>two</li></ul><img src="p.png" alt="pic"><table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td><td> 2
    </td></tr></table><script>x()</script><em>end</em></body></html>"""
    text = value(spark, wb.html_to_markdown(F.col("h")), h=html)
    assert text == (
        "# Head & more\n\nA **bold** [link](/x)\nnew\n\n  * one\n  * two\n\n![pic](p.png)\n\n"
        "| a | b\\|c |\n| --- | --- |\n| 1 | 2 |\n\n_end_"
    )


def test_lists_and_preformatted_text(spark):
    html = """<p>Before</p><ol><li>one</li><li>two <b>bold</b><ul><li>in</li><li>deeper<ol><li>x</li></ol></li></ul></li><li>three</li></ol>
    <p>Then   text</p><pre>line 1
      line  2 &lt;x&gt;

last</pre><ul>
    <li> a </li>
    <li>b</li>
    </ul>end \u0002 sign"""
    assert value(spark, wb.html_to_markdown(F.col("h")), h=html) == (
        "Before\n\n  1. one\n  2. two **bold**\n    * in\n    * deeper\n      1. x\n  3. three\n\nThen text\n\n"
        "    line 1\n          line  2 <x>\n\n    last\n\n  * a\n  * b\n\nend \u0002 sign"
    )


def test_attributes_without_double_quotes(spark):
    html = """<a href=/x>one</a> <a class=b href='/y z'>two</a> <img alt=pic src=p.png> <img src='q.png' alt='two words'> a href=no"""
    assert value(spark, wb.html_to_markdown(F.col("h")), h=html) == "[one](/x) [two](/y z) ![pic](p.png) ![two words](q.png) a href=no"


def test_removed_elements_end_at_their_own_closing_tag(spark):
    remove = lambda html, *selectors: value(spark, wb.remove_unwanted(F.col("h"), list(selectors)), h=html)
    nested = '<div>a<div class="ad x">b<div>c<div>d</div></div>e<br>f</div>g</div>h'
    assert remove(nested, ".ad") == "<div>a" + "g</div>h"
    assert remove(nested, "div") == "h"
    assert remove("<ul><li>a<li class=ad>b</ul>c", ".ad") == "<ul><li>a</ul>c"
    assert remove("<section id='s'><p>x</section>y<navigator>z</navigator><nav>q</nav>", "#s", "nav") == "y<navigator>z</navigator>"
    assert remove("a</div>b<div class=adx>c</div>", ".ad") == "a</div>b<div class=adx>c</div>"
    assert remove("x<img class='ad'>y<p class='ad'/>z", ".ad") == "xyz"
    assert remove("<div class='ad'>never closed", ".ad") == "" and remove("<p>1 < 2</p>", "p", "i") == ""


def test_removal_against_a_tree(spark):
    """Random well-formed pages: what is left is what a recursive walk leaves."""
    import random

    rnd, names = random.Random(3), ["div", "p", "ul", "b"]

    def tree(depth):
        out = []
        for _ in range(rnd.randrange(4)):
            if depth and rnd.random() < 0.7:
                out.append((rnd.choice(names), rnd.random() < 0.2, tree(depth - 1)))
            else:
                out.append(rnd.choice(["x", "1 < 2", " ", "y&amp;"]))
        return out

    def text(nodes, cut):
        return "".join(n if isinstance(n, str) else "" if cut and n[1] else f"<{n[0]}{' class=ad' if n[1] else ''}>{text(n[2], cut)}</{n[0]}>" for n in nodes)

    pages = [tree(6) for _ in range(60)]
    df = spark.createDataFrame([(i, text(p, False)) for i, p in enumerate(pages)], "i int, h string")
    for r in df.select("i", wb.remove_unwanted(F.col("h"), [".ad"]).alias("x")).collect():
        assert r["x"] == text(pages[r["i"]], True)


def test_titles(spark):
    cases = {
        "<title> A </title><h1>B</h1>": "A", "<title></title><h1>B &lt;</h1>": "B <",
        '<meta content="O" property="og:title">': "O", "<p>x</p>": None,
    }
    for html, title in cases.items():
        assert value(spark, wb.page_title(F.col("h")), h=html) == title


def test_breadth_first_on_a_chain_with_a_hub(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(6)]
    hub = [("n2", f"leaf{i}") for i in range(500)]
    edges = spark.createDataFrame(chain + hub + [("n6", "n0"), ("n1", "n1")], "src string, dst string")
    seeds = spark.createDataFrame([("n0",)], "node string")
    depths = {r.node: r.depth for r in gr.breadth_first(edges, seeds, None).collect()}
    assert len(depths) == 507 and depths["n6"] == 6 and depths["leaf3"] == 3
    few = gr.breadth_first(edges, seeds, 5, 10).collect()
    assert len(few) == 10 and max(r.depth for r in few) == 3


def test_graph_without_problems(spark):
    nodes = spark.createDataFrame([("a", "start"), ("b", "step"), ("c", "end")], "id string, type string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert gr.graph_problems(nodes, edges).count() == 0
