import html
import re

import pytest

from tracewarden.llm import html_consensus as H

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class="has-header"><header class=top><h1>Site</h1></header>
<div id="cookie-notice">We use</div><!-- <p>not</p> --><div class="content post-12"><h2>T &lt;x&gt; &amp; y</h2><p>Hello <a href="x>y">link</a>&nbsp; world<br>next
line<ul><li>one<li>two</ul><table><tr><td>a<td>b</table><div class=ads>buy</div><form>f<input></form><script>if (a < b) "</p>"</script></div>
<section class="comments"><p>nice</p></section><aside>s</aside><div hidden>h</div><footer>c</footer>"""


def test_clutter_goes_and_blocks_stay():
    assert H.main_text(PAGE, []) == "T <x> & y\n\nHello link world next line\n\none\n\ntwo\n\na\n\nb"
    assert H.vote(PAGE)[0] == "html/body.has-header/div.content.post-0"


@pytest.mark.parametrize("page,want", [("", ""), ("plain & text <b", "plain & text <b"), ('<p>a<p title="x>y">b</p><!-- c', "a\n\nb"), ("<div><p>a</div>b", "a\n\nb"), ("<script>x", ""), ("<p>a<b>b<p>c</b>d", "ab\n\ncd"), ("<pre>a\n b</pre>", "a b"), ("&#65;&copy;&bogus;", "A©&bogus;")])
def test_odd_markup(page, want):
    assert H.main_text(page, []) == want


def test_paths_before_own_choice():
    page = "<body><div class=a><p>short</div><div class=b><p>" + "long " * 50 + "</div>"
    assert H.main_text(page, ["body/div.a"]) == "short"
    assert H.main_text(page, ["body/div.x"]).startswith("long")


def test_hosts_agree(spark):
    big, small = "<p>" + "word " * 40, "<p>tiny"
    pages = [(i, f"http://H.com/{i}", f"<body><div class=main>{big if i else small}</div><div class=x>{small if i else big}</div>") for i in range(8)]
    pages += [(90, None, None), (91, "http://h.com/", ""), (None, "http://h.com/", "<p>x"), (92, "nohost", "<p>alone"), (0, pages[0][1], pages[0][2])]
    rows = spark.createDataFrame([(*p, "c", 1) for p in pages], "page_id long, url string, html string, host string, paths int")
    got = H.extract(rows).collect()
    assert len(got) == len(pages)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[0] == "tiny" and by[90] == by[91] == "" and by[92] == "alone" and by[None] == "x"
    assert H.extract(rows.where("false")).count() == 0


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in H.extract(pages).collect():
        article = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        parts = re.sub(r"<[^>]*>", " ", re.sub(r"</?(p|h1)>", "\0", article)).split("\0")
        assert r["text"] == "\n\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


@pytest.mark.parametrize("name", ["overflow-hidden", "with-sidebar", "content no-sidebar", "has-header", "elementor-widget-container", "header", "widget-area"])
def test_wrappers_are_kept(name):
    page = f'<body><div class="{name}"><p>{"word " * 40}</div><div class="site-footer"><p>of the foot</div><div id=main-nav><p>menu</div><ul class=menu><li>entry</ul>'
    assert H.main_text(page, []) == ("word " * 40).strip()


def test_headline_and_lead_stay():
    lead, body = "A lead of some more words.", "word " * 60
    page = f"<body><article><h1>Head</h1><div class=lead><p>{lead}</div><div class=body><p>{body}</div></article><div class=related><p>{lead}</div></body>"
    assert H.vote(page)[0] == "body/article"
    assert H.main_text(page, []) == f"Head\n\n{lead}\n\n{body.strip()}"


@pytest.mark.parametrize("page,want", [
    ("<p><a title=don't>link</a> text that isn't lost</p><p>more", "link text that isn't lost\n\nmore"),
    ("<p class=it's hidden>gone</p><p>kept, isn't it", "kept, isn't it"),
    ('<p title="a>b" x=\'c>d\'>one</p><p title = "e>f">two', "one\n\ntwo"),
    ('<p "odd" x="y"z>one</p><p =a>two<br/>three', "one\n\ntwo three"),
    ("<p title=it's>one</p><p title=that's>two</p>", "one\n\ntwo"),
    ("<a href=/x/y>one</a> two", "one two"),
])
def test_quotes_within_tags(page, want):
    assert H.main_text(page, []) == want


def test_paragraph_about_a_topic_stays():
    words = "word " * 30
    page = f"<body><article><p>{words}</p><p class=social>We were social people in those days.</p><p class=social><a href=x>Follow us</a></p><p class=advert>Buy our fine things now, all of them</p></article>"
    page += "<p class=social>We are on all of the networks, too.</p></body>"
    assert H.main_text(page, []) == f"{words.strip()}\n\nWe were social people in those days."


def test_very_long_page():
    page = "<div class=nav>menu</div>" + "<p title=it's>some words of text" * 20_000
    assert H.main_text(page, []).count("some words of text") == 20_000
