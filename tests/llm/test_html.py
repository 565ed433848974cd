"""op4 on pages of known content."""

from __future__ import annotations

import html
import random
import re
import time

import pytest

from tidemark.llm import html_paths as hp
from tidemark.llm.common import table

CASES = {
    "containers without article": (
        '<html><body class="has-sidebar"><header><h1>Site</h1></header><div id="menu"><a href=x>Home</a> <a>B</a></div><div class="wrap"><div class="post"><h1>Title here</h1><p>First para, long enough text. It goes on and on.'
        '<p>Second &amp; third.<ul><li>x<li>y</ul><table><tr><td>a<td>b</table><p>Short.</div><div class="comments"><p>I liked this, very very much. Really, it was good, and so on.</p></div></div><div class="footer">c 2020</div>',
        "Title here First para, long enough text. It goes on and on. Second & third. x y a b Short.",
    ),
    "clutter inside an article": ('<body><main><article><header><h1>T</h1></header><p>Hello, world<b>ly</b> things.</p><aside>no</aside><form>f</form><div class="ad">buy</div></article><section id=comments><p>c1, c2. c3</p></section></main>', "T Hello, worldly things."),
    "scripts, comments, references": ("<article><p>a&nbsp;&lt;b&gt; &#233;&#x20AC;<script>if (a < b) x('</p>')</script><!-- <p>no</p> -->c<style>p{}</style></p></article>", "a <b> é€c"),
    "unclosed elements": ("<article><p>one<p>two<br>three<b>four<p>five", "one two threefour five"),
    "stray signs": ("<article><p>1 < 2 and 3 > 2 <3 & so on</article>", "1 < 2 and 3 > 2 <3 & so on"),
    "a notice and hidden text": ('<body><div role="alert">Cookies!</div><article><p>Text, then.</p><p hidden>not shown</p><p style="display: none">nor this</p></article></body>', "Text, then."),
    "a header of the post": ('<body><div class="site-header"><h2>Site</h2></div><div class="post"><div class="post-header"><h1>Title</h1></div><div class="post-body"><p>Some text, and more.</p><p>And more, still.</p></div></div></body>', "Title Some text, and more. And more, still."),
    "plain text": ("plain text only", "plain text only"),
    "no text": ("<html><head><title>t</title></head><body><nav>menu</nav></body></html>", ""),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    page, want = CASES[name]
    assert hp.main_text(page) == want


def test_synthetic_pages(spark, sf_dir):
    """Every block of the article comes out, and nothing else; checked with a plain cut at the article's tags."""
    got = {r["page_id"]: r for r in hp.op4_html_paths(spark, sf_dir).collect()}
    for r in table(spark, sf_dir, "pages").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]


def test_odd_markup_ends():
    rnd = random.Random(1)
    parts = ["<p>", "</p>", "<div class='x", "'>", '"', "<", ">", "<!--", "-->", "<a href=", "text, ", "</div>", "<li>", "<table><td>", "<script>", "</script>", "&amp", "&#x;", "<b>", "</b>", "<br/>", "<h1>", "<svg/>"]
    for _ in range(500):
        hp.main_text("".join(rnd.choice(parts) for _ in range(rnd.randrange(40))))
    assert hp.main_text("<div>" * 3000 + "deep, text." + "</div>" * 3000) == "deep, text."
    assert len(hp.main_text("<article>" + "<p>word, word. " * 20_000)) == 20_000 * 12 - 1


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div><p class=it's>Second sentence here.</p><p>And it's third, with text.</p></div>", "Second sentence here. And it's third, with text."),
        ('<p><b title="x>bold</b> and "quoted" text, more.</p><p>Next one.</p>', 'bold and "quoted" text, more. Next one.'),
        ('<p title="a > b" data-x=\'<i>\'>hi there</p><div <p>more</div>', "hi there more"),
        ('<p class="x"id="y">one</p><p class = "z" >two</p><p/>three', "one two three"),
        ("a <b and text. <p>next</p>x<![CDATA[ a > b ]]>y", "a <b and text. next xy"),
        (
            '<div><p class="share-price">The share price rose, and fell, and rose again today in trading.</p><p class="comment-on-law">A comment on law, long enough, with commas.</p>'
            '<p>More text here, long enough to count.</p><div class="comments"><p>Reader says, hello hello hello hello.</p></div><div class="share-buttons">Tell all your friends about it, please.</div></div>',
            "The share price rose, and fell, and rose again today in trading. A comment on law, long enough, with commas. More text here, long enough to count.",
        ),
    ],
)
def test_malformed_attributes_and_names_that_hold_a_word(page, want):
    assert hp.main_text(page) == want


def page_without_article(seed: int) -> tuple[str, str]:
    """A page of divs alone, and its article's text: menus and lists of links carry no telling names."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randint(2, 9)))
    prose = lambda n: " ".join(word() + rnd.choice(["", "", "", ",", "."]) for _ in range(n))
    links = lambda n: "".join(f'<{tag}><a href="/{word()}">{word()} {word()}</a></{tag}>' for tag in [rnd.choice(["li", "div"])] for _ in range(n))
    blocks = []
    for _ in range(rnd.randint(4, 12)):
        kind = rnd.random()
        blocks.append(("p", prose(rnd.randint(20, 80)) + ".") if kind < 0.75 else ("p", word()) if kind < 0.85 else ("h2", prose(3)))
    open_p = rnd.random() < 0.3  # paragraphs that are never closed
    body = "".join(f"<{t}>{x}" + ("" if open_p and t == "p" else f"</{t}>") for t, x in blocks)
    clutter = [f"<div class=c1>{links(rnd.randint(3, 9))}</div>", f'<div class="sidebar">{prose(30)}</div>', f"<div class='cookie-bar'>{prose(25)}</div>", f"<ul>{links(5)}</ul>", '<div class="comment-list"><p>' + prose(40) + "</p></div>", f"<footer>{prose(12)}</footer>", f"<nav>{links(4)}</nav>"]
    rnd.shuffle(clutter)
    cut = rnd.randint(0, len(clutter))
    wrap = rnd.randint(0, 5)
    page = "<html><body>" + "".join(clutter[:cut]) + "<div>" * wrap + f"<div class=c2>{body}</div>" + "</div>" * wrap + "".join(clutter[cut:]) + "</body></html>"
    return page, " ".join(x for _, x in blocks)


def test_pages_without_an_article_element():
    for seed in range(300):
        page, want = page_without_article(seed)
        assert hp.main_text(page) == want, seed


@pytest.mark.parametrize(
    "make",
    [
        lambda n: "<div>" * n + "text, here." + "</div>" * n, lambda n: "<b>" * n + "text<br>" * n, lambda n: "<div><p>x</section>" * n, lambda n: "<b title='x " * n, lambda n: "</ " * n + ">", lambda n: "<ul><li>" * n + "</b></p></li>" * n, lambda n: "<article>" * n + "x. " + "</article>" * n, lambda n: "<" * n,
    ],
)
def test_deep_and_broken_pages_take_time_in_proportion(make):
    hp.main_text(make(100))
    took = []
    for n in (5_000, 20_000):
        start = time.process_time()
        hp.main_text(make(n))
        took.append(time.process_time() - start)
    assert took[1] < 10 * max(took[0], 0.05)


def test_query_edges(spark, tables):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>a, b.</p>"), (3, "u", "<p>x</p>"), (3, "u", "<p>x</p>")]
    got = sorted(map(str, map(tuple, hp.op4_html_paths(spark, tables(pages=rows)).collect())))
    assert got == sorted(map(str, [(1, "u", "", 0), (2, None, "", 0), (None, "u", "a, b.", 5), (3, "u", "x", 1), (3, "u", "x", 1)]))
    assert hp.op4_html_paths(spark, tables()).count() == 0
