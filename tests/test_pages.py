from pyspark.sql import functions as F

from songloom.functions import addresses
from songloom.functions.markup import Node, node_texts
from songloom.functions.tokens import text_of, tokens, value_of
from songloom.operators import pages

LYRICS = '<div class="x song_body-lyrics"> a <b>b</b> &amp; c<!-- no --><script>var s = "</div>"; </script> </div>'
TITLE = '<h1 class="header_with_cover_art-primary_info-title"> T </h1>'
INFO = (
    '<span class="metadata_unit-info"> outside </span>'
    '<div class="u-xx_large_vertical_margins show_tiny_edit_button_on_hover"><p>'
    '<span class="metadata_unit-info"> F </span><span class="metadata_unit-info"> G </span></div>'
)


def table(spark, *htmls):
    return spark.createDataFrame([(i, f"https://h.example/a/p{i}?q=1", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_fields(spark):
    rows = pages.page_fields(table(spark, LYRICS + TITLE + INFO, TITLE + INFO, LYRICS + INFO, LYRICS + TITLE, None, "")).orderBy("page_id").collect()
    assert tuple(rows[0])[2:] == ("a b & c", "T", "F", "ok")
    for row in rows[1:]:
        assert tuple(row)[2:] == ("Unscrapable", None, None, "Unscrapable")


def test_info_outside_its_block_does_not_count(spark):
    html = LYRICS + TITLE + '<span class="metadata_unit-info"> outside </span>'
    assert pages.page_fields(table(spark, html)).first().status == "Unscrapable"


def test_reader_rules():
    text = lambda html, node: [r.get(node.name) for r in node_texts(html, (node,))]
    div = Node("x", "div", "a b")
    assert text('<div class="a">1</div><div class="b a">2</div><div class=" a  b ">3</div>', div) == ["3"]
    assert text('<div class="a c">1</div>', Node("x", "div", "c")) == ["1"]
    assert text('<p class="a  b">1</p><p class="a b">2</p>', Node("x", "p", "a b", exact=True)) == ["2"]
    assert text("<b>1<br>2<i>3</b>4</i>", Node("x", "b")) == ["123"]
    assert text("<p>1</p></p><b>2", Node("x", "b")) == ["2"]
    assert text("<div/>x<div>y</div>", Node("x", "div", nth=1)) == ["y"]
    assert text("<p>&eacute;&#233;&#x41;&nosuch;&lt;</p>", Node("x", "p")) == ["ééA&nosuch<"]
    assert text("<p>a<style>s</style><template>t</template>b</p>", Node("x", "p")) == ["ab"]
    assert text(None, Node("x", "p")) == []


HIT = (
    '<a class="media"><p class="subtitle is-6 artist-name"> DRAKE </p><p class="title is-4 track-name">God\'s\n  Plan</p>'
    '<p class="title">4:02</p><p class="title"> 77 </p></a>'
)


def test_search_page_hits(spark):
    html = HIT + '<a class="media other"><p class="title">no</p></a>' + HIT.replace("77", "80").replace("DRAKE", "Other")
    rows = pages.search_page_hits(table(spark, html, "<p>none</p>")).orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [(0, 0, "drake", "god's plan", "77"), (0, 1, "other", "god's plan", "80")]


def test_links(spark):
    card = 'class="mini_card mini_card--small"'
    html = (
        f'<a {card} href="/x?a=1&amp;b=2">1</a><a href="/x?a=1&amp;b=2" {card}>2</a><a href="/other">3</a>'
        f"<a title='a > b' {card} href='y'>4</a><!-- <a {card} href=\"/hidden\"> --><A {card.upper().replace('MINI_CARD', 'mini_card').replace('SMALL', 'small')} HREF=z>"
        f"<script>'<a {card} href=\"/script\">'</script><abbr {card} href='no'>"
    )
    got = sorted(r.href for r in pages.page_links(table(spark, html)).collect())
    assert got == ["/x?a=1&b=2", "y", "z"]
    full = sorted(r.href for r in pages.page_links(table(spark, html), resolve=True).collect())
    assert full == ["https://h.example/a/y", "https://h.example/a/z", "https://h.example/x?a=1&b=2"]


# The examples of RFC 3986, 5.4, against http://a/b/c/d;p?q
EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g",
    "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s",
    ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "g;x?y#s": "http://a/b/c/g;x?y#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/",
    "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/",
    "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g",
    "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g",
    "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y",
    "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g?y/../x": "http://a/b/c/g?y/../x", "g#s/./x": "http://a/b/c/g#s/./x",
    "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}


def test_addresses(spark):
    df = spark.createDataFrame([(h, w) for h, w in EXAMPLES.items()], "h string, wanted string")
    got = df.select("h", "wanted", addresses.resolved(F.col("h"), F.lit("http://a/b/c/d;p?q")).alias("got")).collect()
    assert [(r.h, r.got) for r in got] == [(r.h, r.wanted) for r in got]
    bare = df.limit(0).unionByName(spark.createDataFrame([("?p=2", "http://a?p=2"), ("g", "http://a/g"), ("", "http://a"), (None, None)], df.schema))
    got = bare.select("wanted", addresses.resolved(F.col("h"), F.lit("http://a")).alias("got")).collect()
    assert [r.got for r in got] == [r.wanted for r in got]
    unknown = df.where("h = '../g'").select(addresses.resolved(F.col("h"), F.lit(None).cast("string")))
    assert unknown.first()[0] is None


def test_targets_on_a_page(spark):
    html = '<a href="../z"><a href=" ?p=2 "><a href="#t"><a href=""><a href="a\nb"><a name=x><template><a href=no></template>'
    got = sorted(r.href for r in pages.page_links(table(spark, html), None, resolve=True).collect())
    page = "https://h.example/a/p0?q=1"
    assert got == sorted(["https://h.example/z", "https://h.example/a/p0?p=2", page + "#t", page, "https://h.example/a/ab"])
    based = pages.page_links(table(spark, '<base href="/x/"><base href="/y/"><a href="z">'), None, resolve=True).collect()
    assert [r.href for r in based] == ["https://h.example/x/z"]


def test_attributes_and_references():
    starts = lambda html: [(t[1], t[2]) for t in tokens(html) if t[0] == "start"]
    assert starts("""<a title="x class='b' href=y" CLASS=c class=d href = '1>2' e/>""") == [
        ("a", {"title": "x class='b' href=y", "class": "c", "href": "1>2", "e": ""})
    ]
    assert starts('<p a="unclosed><b>') == [] and starts("<p a=1") == [] and starts("< p>") == []
    assert value_of("?x=1&copy=2&amp;y&lt&notit;&#65;&ampz&amp") == "?x=1&copy=2&y<&notit;A&ampz&"
    assert text_of("&lt;&eacute;&nosuch;&amp &ampx &#x41;") == "<é&nosuch& &x A"
    text = lambda html: "".join(t[1] for t in tokens(html) if t[0] == "text")
    assert text("a<!-->b<!--->c<!-- x --!>d<!-- --> <? q>e</>f</ x>g< h <3") == "abcd efg< h <3"
    assert text("<title><b>&amp;</title><script>'</p>' a<b</SCRIPT >z<style>q") == "<b>&'</p>' a<bzq"


def test_time_is_linear_in_anything():
    import time

    for odd in ("<a", '<a b="', "<li><a href=x>y", "<a b ", "<main>", "<!--", "<!---->", "<", "</", "<script>", "<a ===", "&", "&a", "<title></title", "<![x"):
        begin = time.perf_counter()
        for _ in tokens(odd * 100_000):
            pass
        assert time.perf_counter() - begin < 4, odd


def test_link_completeness(spark):
    headers = spark.createDataFrame([(0, " 2 Songs"), (1, "1 Song"), (2, "none")], "page_id long, header string")
    links = spark.createDataFrame([(0, "a"), (0, "b")], "page_id long, href string")
    rows = pages.link_completeness(headers, links).orderBy("page_id").collect()
    assert [tuple(r) for r in rows] == [(0, 2, 2, True), (1, 1, 0, False), (2, None, 0, False)]


def test_marked_sections_are_read_over():
    for odd in ("<![foo bar]]>", "<![ ]>", "<![CDATA[x]]>", "<!["):
        assert node_texts(f"<h1>a</h1>{odd}", (Node("t", "h1"),))[0]["t"] == "a"
    assert node_texts("<![foo bar]]><h1>a</h1>", (Node("t", "h1"),)) == [{"t": "a"}]


def test_end_tags_may_be_left_out():
    read = lambda html, tag: [r.get("t") for r in node_texts(html, (Node("t", "b"),), Node("e", tag))]
    assert read("<ul><li><b>1</b><li><ul><li><b>2</b></ul></ul><ul><li><b>3</b></ul>", "li") == ["1", "2", "2", "3"]
    assert read("<table><tr><td><b>1</b><td><b>2</b><tr><td><b>3</b></table>", "td") == ["1", "2", "3"]
    assert read("<a><b>1</b><a><b>2</b>", "a") == ["1", "2"]


def test_time_is_linear_in_unclosed_tags():
    import time

    begin = time.perf_counter()
    assert len(node_texts("<li><a href=x>y" * 100_000, (Node("t", "a"),), Node("e", "li"))) == 100_000
    assert time.perf_counter() - begin < 10
