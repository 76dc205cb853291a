import random
import time

import pytest

from eventlake.llm import html_extract
from eventlake.llm.html_extract import extract, main_text
from tests.llm import brute

LONG = "It was a fine day, and everyone went out, all of them, to see the boats on the river."
MORE = "Nobody had expected so many people, so much noise, or such a long wait before the first race."


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>Not this</title>{head}</head><body>{body}</body></html>"


BOILERPLATE = [
    "<nav><ul><li><a href='/a'>Home, sweet home, with a long link text, and more</a></li></ul></nav>",
    "<header><h2>The Site, a newspaper, daily since 1900, for all of you</h2></header>",
    "<footer><p>Copyright, all rights reserved, by us, and by nobody else in the world.</p></footer>",
    "<aside><p>Also of interest, for you, and for others, is what we wrote on other days.</p></aside>",
    "<div class='sidebar'><p>Popular today, as always, are the things that others read, and shared.</p></div>",
    "<div id='cookie-notice'><p>We use cookies, as all do, and you agree, of course, by reading on.</p></div>",
    "<div class=\"ad\">Buy this, and that, now, cheaper than ever before in this town!</div>",
    "<form action='/s'><label>Search, if you like</label><input name=q><p>Sign up, now, here, with your name, and your address.</p></form>",
    "<script>var x = '<p>Not text, not at all, never, by no means, in no way.</p>';</script>",
    "<style>p { content: '<p>, , , , , , , , , , , , , </p>' }</style>",
    "<section class='comments'><p>I think, and I say, that this is wrong, so wrong, as you all know.</p></section>",
    "<!-- <p>Hidden, hidden, hidden, hidden, hidden, hidden text, in a comment.</p> -->",
    "<p hidden>Not shown, not shown, not shown, not shown, not shown, not shown.</p>",
    "<div style='display: none'><p>Not shown, not shown, not shown, not shown, not shown.</p></div>",
]


@pytest.mark.parametrize("extra", BOILERPLATE)
@pytest.mark.parametrize("shape", ["<article>{}</article>", "<main><div>{}</div></main>", "<div class='content'>{}</div>", "<div><div><section>{}</section></div></div>"])
def test_boilerplate_goes(extra, shape):
    article = f"<h1>Boats</h1><p>{LONG}</p><p>{MORE} <a href='#'>See</a> them.</p>"
    want = f"Boats\n{LONG}\n{MORE} See them."
    assert main_text(page(extra + shape.format(article))) == want
    assert main_text(page(shape.format(article) + extra)) == want
    assert main_text(page(shape.format(article + extra))) == want


def test_wrappers_named_for_what_stands_beside_them():
    body = f"<div class='has-sidebar'><div class='page-with-comments'><article class='post'><p>{LONG}</p></article></div></div>"
    assert main_text(page(body)) == LONG


def test_comments_in_articles_of_their_own():
    comments = f"<section class='comments'><article><p>{MORE}</p></article><article><p>{MORE}</p></article></section>"
    assert main_text(page(f"<article><h1>T</h1><p>{LONG}</p>{comments}</article>")) == f"T\n{LONG}"
    assert main_text(page(f"<main><article><p>{LONG}</p></article>{comments}</main>")) == LONG
    assert main_text(page(f"<div class='post'><h1>T</h1><div class='entry'><p>{LONG}</p></div></div><div id='disqus_thread'><p>{MORE}</p></div>")) == f"T\n{LONG}"


def test_usual_pages():
    blog = (
        "<div id='top-header'><h1>My site</h1></div><div class='topnav'><a href=a>A</a> <a href=b>B</a></div><div id='wrap' class='page-with-sidebar'>"
        f"<article class='post'><header class='entry-header'><h1>Boats</h1></header><div class='entry-content'><p>{LONG}</p><h2>Later</h2><p>{MORE}</p>"
        f"<div class='sharedaddy share'><a href=f>Share, share, and share, on all the sites there are</a></div></div></article><div class='sidebar'><article class='teaser'><p>{MORE}</p></article></div></div>"
    )
    assert main_text(page(blog)) == f"Boats\n{LONG}\nLater\n{MORE}"
    old = f"<table><tr><td><a href=1>One</a><br><a href=2>Two</a></td><td><h1>Boats</h1><p>{LONG}<p>{MORE}</td></tr></table>"
    assert main_text(page(old)) == f"Boats\n{LONG}\n{MORE}"
    form = f"<form id='aspnetForm'><div class='menu'>x</div><article><p>{LONG}</p></article></form>"
    assert main_text(page(form)) == LONG


def test_parts_of_main_and_article():
    box = "<div class='b2'><p>Unrelated text box</p></div>"
    post = f"<div class='post'><h1>Boats</h1><p>{LONG}</p><p>{MORE}</p></div>"
    assert main_text(page(f"<main>{post}{box}</main>")) == f"Boats\n{LONG}\n{MORE}"
    assert main_text(page(f"<main>{box}<section>{post}</section></main>")) == f"Boats\n{LONG}\n{MORE}"
    two = f"<article><h2>One</h2><p>{LONG}</p><p>{MORE}</p></article><article><h2>Two</h2><p>{MORE}</p></article>"
    assert main_text(page(f"<main>{two}</main>")) == f"One\n{LONG}\n{MORE}\nTwo\n{MORE}"
    assert main_text(page(f"<main><h1>Races</h1>{two}</main>")).startswith("Races\nOne\n")
    short = f"<article><div class='lead'>In short.</div><div class='text'><p>{LONG}</p><p>{MORE}</p></div><table><tr><td>1<td>2</table><div><a href=x>A long, long link to another story</a></div></article>"
    assert main_text(page(short)) == f"In short.\n{LONG}\n{MORE}\n1\n2"
    assert main_text(page(f"<main><p>{LONG}</p><p>{MORE}</p>{box}</main>")) == f"{LONG}\n{MORE}"


def _random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["p", "p", "li", "div", "section", "article", "main", "td", "a", "b", "h2", "blockquote", "nav", "text"])
        if kind == "text" or depth > 6:
            out.append(rng.choice([LONG, MORE, "short, ", "&amp; so on, and so on, and so on, on, on. "]))
        else:
            cls = rng.choice(["", "", "", " class='x'", " class='sidebar'", " hidden"])
            out.append(f"<{kind}{cls}>{_random_page(rng, depth + 1)}" + (f"</{kind}>" if rng.random() < 0.9 else ""))
    return "".join(out)


def test_points_against_the_definition():
    rng, scored = random.Random(11), 0
    for _ in range(300):
        nodes = html_extract.parse(_random_page(rng))
        html_extract._drop(nodes)
        html_extract._measure(nodes)
        html_extract._score(nodes)
        want = brute.page_points(nodes[0], html_extract.LEVELS)
        for n in nodes:
            assert (n.given, n.points) == pytest.approx(want.get(id(n), (0, 0)))
        scored += len(want)
    assert scored > 1000


@pytest.mark.parametrize("unit", ["<div>", "<div><p>", "<article><p>x", "<div><a href=x>", "<ul><li>", "<b><div>", "<p><b>", "<table><tr><td>", "<div></p></b>", f"<div>{LONG}"])
def test_cost_is_linear_in_the_page(unit):
    def took(n):
        text = unit * n + LONG
        best = min(_timed(text) for _ in range(3))
        return best

    small, large = took(2000), took(8000)
    assert large < 4 * 2.5 * small + 0.05


def _timed(text):
    began = time.process_time()
    main_text(text)
    return time.process_time() - began


def test_a_page_of_open_elements():
    assert _timed("<div>" * 200_000 + LONG) < 5


def test_broken_markup():
    assert main_text(f"<article><h1>Title</h1><p><b>{LONG}<br><p>{MORE}</article>") == f"Title\n{LONG}\n{MORE}"
    assert main_text(f"<div><p>{LONG}<p>{MORE}") == f"{LONG}\n{MORE}"
    assert main_text(f"<article><p title='a > b'>{LONG}</p><ul><li>{LONG}<li>{MORE}</ul>") == f"{LONG}\n{LONG}\n{MORE}"
    assert main_text(f'<article><p title="never closed>{LONG}</p><p>{MORE}</p></article>').endswith(MORE)
    assert main_text("<article><p>1 < 2 & 3 > 2, as we know, and always knew, in all these years.</p>") == "1 < 2 & 3 > 2, as we know, and always knew, in all these years."
    assert main_text("<" * 50_000) != ""
    assert main_text("<div>" * 20_000 + LONG) == LONG
    main_text("<a x='" * 20_000)


def test_characters_and_spaces():
    body = f"<article><p>A&nbsp;b &amp; c\n\t&eacute;&#233;&#xe9; &lt;p&gt; &unknown; &am</p><pre>x  y\nz</pre><p> {LONG}  </p></article>"
    assert main_text(page(body)) == f"A b & c ééé <p> &unknown; &am\nx y z\n{LONG}"


def test_short_pages_and_nothing():
    assert main_text(page("<nav><a href=x>Menu</a></nav><article><h1>Hi</h1><p>Short.</p></article>")) == "Hi\nShort."
    assert main_text(page("<p>Hm.</p>")) == "Hm."
    assert main_text("just text") == "just text"
    for empty in (None, "", "   ", page(""), page("<script>x</script>"), "<html"):
        assert main_text(empty) == ""


def test_lists_of_links_go_but_lists_stay():
    links = "".join(f"<li><a href='/{i}'>Another story, number {i}</a></li>" for i in range(5))
    items = "<ul><li>First, a thing.</li><li>Second, <a href=x>another</a> thing.</li></ul>"
    assert main_text(page(f"<article><p>{LONG}</p>{items}<ul>{links}</ul></article>")) == f"{LONG}\nFirst, a thing.\nSecond, another thing."


def test_query_columns(spark):
    rows = [(1, "u", page(f"<article><p>{LONG}</p></article>"), "old", 5), (2, None, None, None, None), (None, "v", "<p>x", "old", 6), (1, "u", "", "", 7)]
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, c0_ int"))
    assert out.columns == ["page_id", "url", "c0_", "text"]
    assert sorted(map(str, out.collect())) == sorted(map(str, [_row(1, "u", 5, LONG), _row(2, None, None, ""), _row(None, "v", 6, "x"), _row(1, "u", 7, "")]))
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _row(page_id, url, c, text):
    from pyspark.sql import Row

    return Row(page_id=page_id, url=url, c0_=c, text=text)
