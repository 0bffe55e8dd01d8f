"""Main text of pages: golden cases, templates of a host, matching against brute force, pages that are not well-formed."""

import html
import random
import re
import time

import pytest

from songloom.llm import page_text
from songloom.llm.page_text import content_blocks, extract_text, matched, parsed, skeleton

PAGES = [
    ("<html><body><nav>menu</nav><article><h1>T &amp; t</h1><p>a <b>b</b><br>c<p>d&nbsp;&eacute;</article><footer>f</footer>", "T & t\na b c\nd é"),
    ("<article><p>x</p>tail<ul><li>1<li>2</ul><div class='comments'>no</div><aside>no</aside></article>", "x\ntail\n1\n2"),
    ("<body><div id=sidebar>no</div><div class=\"cookie-notice\">no</div><p>only  text\n here</p><form>no</form></body>", "only text here"),
    ("<header>no</header><main><header><h1>yes</h1></header><script>if (a<b) x='</p>'</script><p>z</main>", "yes\nz"),
    ("<h1>a</h1><![foo bar]]><![ ]><p>b<!-- c --><p title='x>y'>d", "a\nb\nd"),
    ("<article><p>one</article><div><article class=teaser><p>two</article></div>", "one\ntwo"),
    ("<article><p class='ad-hoc'>Body<div class='entry-header'><h1>Title</h1></div><div class='ad'>no</div><p class='top-banner'>no</article>", "Body\nTitle"),
    ("<div id='main-menu-page'><p>whole page</div>", "whole page"), ("<div class='sidebar'><p>all there is</div>", "all there is"),
    ("<div class='page menu'><main><p>x</main></div><p>y", "x"), ("<main></main><p>out", "out"),
    ("plain", "plain"), ("", ""), (None, ""), ("< 3 <> </> <p", "< 3 <> <p"), ("<textarea><p>no</textarea><p>1 < 2", "1 < 2"),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_blocks(page, want):
    got = "\n".join(t for _, t in content_blocks(parsed(page or "")))
    assert re.sub(r"\s+", " ", got) == re.sub(r"\s+", " ", want)


def test_linear_on_unclosed_tags():
    begun = time.time()
    for page in ("<li><a href=x>y" * 100_000, "<p>z" * 100_000, "<div>" * 100_000 + "x"):
        content_blocks(parsed(page))
        skeleton(parsed(page))
    assert time.time() - begun < 60


def brute_matching(a, b):
    """Largest number of matched nodes, by trying everything."""

    def below(rows, place):
        return [i for i, r in enumerate(rows) if r[1] == place]

    def best(xs, ys):
        if not xs or not ys:
            return 0
        found = max(best(xs[1:], ys), best(xs, ys[1:]))
        if a[xs[0]][0] == b[ys[0]][0]:
            found = max(found, 1 + best(below(a, xs[0]), below(b, ys[0])) + best(xs[1:], ys[1:]))
        return found

    return best(below(a, -1), below(b, -1))


def test_matching_is_largest():
    rng = random.Random(8)

    def tree(n):
        return [(rng.choice("ab"), rng.randint(-1, i - 1), "") for i in range(n)]

    for _ in range(60):
        a, b = tree(rng.randint(0, 7)), tree(rng.randint(0, 7))
        pairs = matched(a, b)
        assert len(pairs) == brute_matching(a, b)
        assert len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs)
        assert all(a[x][0] == b[y][0] for x, y in pairs)


def test_templates_of_a_host(spark):
    page = lambda i: f"<div class=x>Read our daily news</div><div class=y>story {i}</div><p>body {i}</p>"
    rows = [(i, "http://News.example/a?" + str(i), page(i)) for i in range(8)]
    rows += [(20 + i, "http://few.example/", page(i)) for i in range(2)] + [(30 + i, "http://copy.example/", page(1)) for i in range(9)]
    rows += [(None, None, None), (40, "nothing", "<p>x"), (40, "nothing", "<p>x")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = extract_text(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert text[3] == "story 3\nbody 3" and text[20] == "Read our daily news\nstory 0\nbody 0" and text[30] == "Read our daily news\nstory 1\nbody 1"
    assert text[None] == "" and text[40] == "x"
    assert extract_text(pages.limit(0)).count() == 0


def test_given_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in extract_text(pages).collect():
        article = re.search("<article>(.*?)</article>", source[r.page_id], re.S)[1]
        plain = re.sub("<[^>]*>", " ", article)
        assert r.text.split() == html.unescape(plain).split()


def test_odd_pages_take_linear_time():
    for odd in ("<a", "<main>", "<div>", "<article><p>x", '<a b="', "<!--", "<p class='a", "<main><p>x</main>"):
        begun = time.time()
        page = odd * (100_000 if odd.startswith(("<a", "<!")) and odd != "<article><p>x" else 10_000)
        top = parsed(page)
        content_blocks(top)
        skeleton(top)
        assert time.time() - begun < 4, odd


def test_deep_and_wide_pages():
    deep = skeleton(parsed("<div>" * 5_000 + "x"))
    begun = time.time()
    assert len(matched(deep, deep)) == 5_000
    blocks = [f"<p>block {i}</p>" for i in range(3_000)]
    wide = skeleton(parsed("".join(blocks)))
    assert len(matched(wide, skeleton(parsed("<p>new</p>" + "".join(blocks))))) == 3_000
    half = [b for i, b in enumerate(blocks) if i % 7] + ["<p>end</p>"]
    assert len(matched(wide, skeleton(parsed("".join(half))))) >= len(half) - 1
    plain = skeleton(parsed("<p>same</p>" * 3_000 + "<div>x</div>"))
    other = skeleton(parsed("<div>y</div>" + "<p>other</p>" * 2_000))
    assert len(matched(plain, other)) >= 2_000
    assert time.time() - begun < 30


def test_template_step_equals_brute_force(spark):
    """A block is template if most of the pages that have its place show the same text there."""
    rng = random.Random(5)
    pages, want = [], {}
    for i in range(24):
        parts = [("fixed line", True), (f"own {i}", False), ("often" if i % 8 else "seldom", True), (rng.choice(["x", "y"]), False)]
        pages.append((i, "http://h.example/a", "<body>" + "".join(f"<section class=s{k}><p>{t}</p></section>" for k, (t, _) in enumerate(parts))))
    texts = {i: [f"fixed line", f"own {i}", "often" if i % 8 else "seldom"] + [re.findall("<p>(.*?)</p>", p)[3]] for i, _, p in pages}
    others = [i for i in texts if texts[i] != texts[0]]
    fixed = {k for k in range(4) if sum(texts[i][k] == texts[0][k] for i in others) >= 0.8 * len(others)}
    want = {i: "\n".join(t for k, t in enumerate(ts) if k not in fixed) for i, ts in texts.items()}
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract_text(df).collect()} == want


def heaviest(a, b):
    """Weight of the heaviest matching, by the definition."""
    below = lambda rows, p: [i for i, r in enumerate(rows) if r[1] == p]

    def forest(xs, ys):
        if not xs or not ys:
            return 0
        best = max(forest(xs[1:], ys), forest(xs, ys[1:]))
        x, y = xs[0], ys[0]
        if a[x][0] == b[y][0]:
            best = max(best, 2 + (a[x][2] == b[y][2]) + forest(below(a, x), below(b, y)) + forest(xs[1:], ys[1:]))
        return best

    return forest(below(a, -1), below(b, -1))


def test_matching_is_the_same_for_lists_of_any_length(monkeypatch):
    rng = random.Random(11)

    def tree(n):
        return [(rng.choice("ab"), rng.randint(max(-1, i - 4), i - 1), rng.choice("xyz")) for i in range(n)]

    weight = lambda a, b, pairs: sum(2 + (a[x][2] == b[y][2]) for x, y in pairs)
    for n in [7] * 60 + [40] * 40:
        a, b = tree(rng.randint(0, n)), tree(rng.randint(0, n))
        found = []
        for cells, rows in ((10_000, 500_000), (0, 500_000), (3, 1)):
            monkeypatch.setattr(page_text, "CELLS", cells)
            monkeypatch.setattr(page_text, "ROW_CELLS", rows)
            found.append(sorted(matched(a, b)))
        assert found[0] == found[1] == found[2]
        assert n > 7 or weight(a, b, found[0]) == heaviest(a, b)


def test_wide_lists_are_matched_as_short_ones():
    """One subtree that both lists have, at the far ends: it is no reason to give up all other pairs."""
    for n in (30, 900):
        item = lambda text: f"<ul><li>{text}</li><li>x</li></ul>"
        a = skeleton(parsed(item("both") + "".join(item(f"a{i}") for i in range(n))))
        b = skeleton(parsed("".join(item(f"b{i}") for i in range(n)) + item("both")))
        begun = time.time()
        assert len(matched(a, b)) == 3 * (n + 1)
        assert time.time() - begun < 20
