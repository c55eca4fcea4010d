import html
import re

import pytest

from tests.llm.conftest import DATA, read
from tidemark.llm import site_style as sst


def article(page):
    """What the generated pages hold: headings and paragraphs of the article element."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [re.sub(r"<[^>]+>", "", re.sub("<br>", " ", p)) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_generated_pages(spark):
    pages = read("pages", DATA)
    got = {r.page_id: r.text for r in sst.extract(spark.createDataFrame(pages)).collect()}
    assert got == {k: article(h) for k, h in zip(pages["page_id"], pages["html"])}


PAGES = [
    ("<p>one  two\n three</p><p>four</p>", "one two three\nfour"),
    ("a &amp; b &lt;c&gt; &#233;&nbsp;x<br>y", "a & b <c> é x y"),
    ("<div>a<div>b</div>c</div>", "a\nb\nc"),
    ("<p>x<b>y</b>z<i> w</i></p>", "xyz w"),
    ("<nav>menu</nav><header>top</header><main><header><h1>Title</h1></header><p>text</p><aside>more</aside></main><footer>f</footer>", "Title\ntext"),
    ("<article><p>body</p><div class='comments'><p>reader says</p></div><form>f<input value='v'></form></article>", "body"),
    ("<article><p>unclosed <b>bold<p>next</article><div>after</div>", "unclosed bold\nnext"),
    ("<script>if (a<b) '</p>'</script><style>p{}</style><p>t</p><!-- c <p>no</p> -->", "t"),
    ("<div class='cookie-notice'>we use</div><div id='sidebar-2'>s</div><div class='adder'>kept</div>", "kept"),
    ("<div class='content with-sidebar no-comments'><p>t</p><div class='site-sidebar'>s</div><section id=comments>c</section></div>", "t"),
    ("<div hidden>h</div><div aria-hidden='true'>g</div><div role=navigation>n</div>x", "x"),
    ("<ul><li>a<li>b</ul>", "a\nb"),
    ("<p title='a > b'>ok</p>", "ok"),
    ("<p>never ends", "never ends"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("<title>t</title><body></body></html>", ""),
    ("<script>open", ""),
    ("<!-- open <p>x</p>", ""),
    ("<p>x</p><!-- open", "x"),
    ("<p>x</p>y <a hre", "x\ny"),
    ("<p>x</p>" + "<b " * 50_000, "x"),
    ("<p>x</p><a href='" * 3 + "z", "x\nx"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_marks_and_blocks(page, want):
    assert sst.main_text(page) == want


def site(spark, pages):
    rows = [(k, u, h, "x", 1) for k, (u, h) in enumerate(pages)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, n_chars int")


def test_tree_removes_what_a_site_repeats(spark):
    """Same box on every page of one site, without any telling mark; own text elsewhere."""
    page = "<div class=wrap><div class=top7><span>Our house rules and motto</span></div><div class=story><p>Story number {} of this site</p></div></div>"
    pages = [("http://a.org/%d" % k, page.format(k)) for k in range(12)]
    pages += [("http://b.org/1", page.format(1))]
    got = {r.page_id: r.text for r in sst.extract(site(spark, pages)).collect()}
    assert got[3] == "Story number 3 of this site"
    # One page of a site says nothing about its style.
    assert got[12] == "Our house rules and motto\nStory number 1 of this site"


def test_importance_equals_hand_computation(spark):
    """Four pages: a node with one text on all, one with a text each, one half and half."""
    page = "<div class=s>same</div><div class=o>{}</div><div class=h>{}</div>"
    pages = [("http://h/%d" % k, page.format(k, k % 2)) for k in range(4)]
    rows = {r.node: r for r in sst.tree_statistics(site(spark, pages)).collect()}
    assert rows["#/div.s"].content == pytest.approx(0.0)
    assert rows["#/div.o"].content == pytest.approx(1.0)
    assert rows["#/div.h"].content == pytest.approx(0.5)
    assert rows["#"].pages == 4 and rows["#"].presentation == pytest.approx(0.0)
    noise = sst.noise_branches(sst.tree_statistics(site(spark, pages)), threshold=0.6, min_pages=4).collect()
    assert [(r.host, r.branches) for r in noise] == [("h", ["#/div.h", "#/div.s"])]


def test_copies_of_an_article_do_not_erase_it(spark):
    page = "<nav>n</nav><article><h1>T</h1><p>Same words on all pages</p></article>"
    got = sst.extract(site(spark, [("http://a.org/%d" % k, page) for k in range(9)])).collect()
    assert {r.text for r in got} == {"T\nSame words on all pages"}


def test_edges(spark):
    pages = site(spark, [(None, None), ("", "<p>a</p>"), ("nowhere", "<p>b</p>"), ("http://h", "<p>" + "long " * 300_000), ("http://h", "<p>c</p>"), ("http://h", "<p>c</p>")])
    rows = sst.extract(pages).collect()
    got = {r.page_id: (r.url, r.text) for r in rows}
    assert len(rows) == 6 and got[0] == (None, "") and got[1] == ("", "a") and got[2] == ("nowhere", "b")
    assert len(got[3][1]) == 5 * 300_000 - 1 and got[4] == got[5] == ("http://h", "c")
    assert sst.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "attributes",
    ['style="overflow:hidden"', 'data-hidden="false"', 'title="The hidden valley"', 'data-href="/hidden/x"', 'data-href="/view?id=share"', 'data-id="ad-1"', "data-role=menu", 'title="a class=ad b"', 'aria-hidden="false"'],
)
def test_other_attributes_do_not_make_noise(attributes):
    assert sst.main_text(f"<div {attributes}><p>Story</p></div>") == "Story"


@pytest.mark.parametrize("attributes", ["hidden", 'hidden=""', "HIDDEN", "aria-hidden='true'", 'title="x" class = "ad"', "id=share", "role=menu", 'style="a"hidden'])
def test_marks_make_noise(attributes):
    assert sst.main_text(f"<div {attributes}><p>Menu</p></div><p>Story</p>") == "Story"
