from __future__ import annotations

import html
import random

import pytest

from tablecraft.llm import html_text as m

NOISE = (
    '<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>',
    '<div class="ad-banner">Buy this wonderful thing right now for only a few coins, friends.</div>',
    "<script>var t = '</p><p>not text</p>';</script><style>p > a {color: red}</style>",
    "<!-- a comment <p>with markup</p> -->",
    '<form><label>Name</label><input name="n"><button>Send it</button></form>',
    '<aside class="sidebar"><p>Read what others like a lot these days, it is quite long.</p></aside>',
    '<div id="cookie-notice" role="dialog"><p>We use cookies to make everything better for everyone.</p></div>',
    '<section class="comments"><article class="comment"><p>I fully agree with every word that was written.</p></article></section>',
    '<div hidden><p>This was hidden by the writer of the page.</p></div>',
    "<footer>&copy; someone, somewhere, with more words than a footer needs</footer>",
    '<header class="site-header"><p>The great paper of the small town</p></header>',
)


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div class="wrap"><div id="story">{}</div></div>'])
def test_article_among_noise(wrap):
    rng = random.Random(wrap)
    for _ in range(60):
        texts = [
            " ".join("".join(rng.choice("abcdé &<") for _ in range(rng.randint(1, 8))).strip() or "x" for _ in range(rng.randint(4, 60)))
            for _ in range(rng.randint(2, 9))
        ]
        inner = "".join(f"<p class=text>{html.escape(t)}" + ("</p>" if rng.random() < 0.7 else "\n") for t in texts)
        inner = "<h1>The title</h1>" + inner
        before, after = (" ".join(rng.sample(NOISE, rng.randint(0, 5))) for _ in range(2))
        page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{before}{wrap.format(inner)}{after}</body></html>"
        want = "\n\n".join(" ".join(t.split()) for t in ["The title", *texts])
        assert m.main_text(page) == want


def test_blocks_and_white_space():
    assert m.main_text("<p>a&nbsp;b<br>c\n d<p> <p>x &lt; &#233;<ul><li>one<li>two</ul>") == "a b c d\n\nx < é\n\none\n\ntwo"
    assert m.main_text("<table><tr><td>1<td>2<tr><td>3</table>") == "1 2\n\n3"
    assert m.main_text("<article><header><h1>T</h1></header><p>text <b>bold<p>more</article>") == "T\n\ntext bold\n\nmore"


def test_broken_pages():
    assert m.main_text(None) == m.main_text("") == m.main_text("<!-- never closed <p>x") == ""
    assert m.main_text("x < y > z") == "x < y > z"
    assert m.main_text("<p>cut off <a hre") == "cut off"
    assert m.main_text("<div>" * 5000 + "deep") == "deep"
    assert m.main_text('<p title="a > b">quoted</p>') == "quoted"


def test_densities_count_links():
    page = m.parse("<body><div><a>link text here</a></div><div>plain text here</div></body>")
    density, _, chars, links = m.densities(page, 1)
    plain, linked = (next(n for n in range(len(page.names)) if page.names[n] == "div" and bool(links[n]) == b) for b in (False, True))
    assert chars[plain] == 15 and density[plain] > density[linked]


STORY = "<h1>The title</h1><p>One long sentence of the story, with words enough.<p>And one more sentence, as long as that."
WANT = "The title\n\nOne long sentence of the story, with words enough.\n\nAnd one more sentence, as long as that."


@pytest.mark.parametrize(
    "wrap",
    [
        '<div class="layout has-sidebar"><article>{}</article></div>',
        '<div class="page widget"><article>{}</article></div>',
        '<div class="sidebar-left"><main>{}</main><div class="sidebar">other things, of less weight</div></div>',
        '<div id="content-with-ads"><div>{}</div></div>',
        '<div class="social-science">{}</div>',
        '<section class="related-work">{}</section>',
        "<form action='/x'><nav><a href='/'>Home</a></nav><div>{}</div><label>Name</label><input name=n></form>",
        '<form class="page-form"><div class="sidebar-right"><article>{}</article></div><button>Go</button></form>',
        "<svg><path d='M0'><article>{}</article>",
        "<select><option>one<div><article>{}</article></div>",
    ],
)
def test_wrappers_and_open_elements_hide_no_article(wrap):
    page = f"<body><nav><a href='/'>Home</a></nav>{wrap.format(STORY)}<div class='cookie-notice'>We use cookies for all.</div></body>"
    assert m.main_text(page) == WANT


@pytest.mark.parametrize(
    "noise",
    [
        '<section class="post-comments"><article><p>A comment that is longer than the article, by far, as comments often are.'
        " It goes on and on and on, and then it goes on some more, until nobody reads it any longer.</article></section>",
        '<div class="sidebar-left"><article>A teaser of another story.</article></div>',
        '<form><h1>Sign up</h1><p>Get all of our news in one letter.</p></form>',
        '<div class="site-footer">Someone, somewhere</div>',
        '<div class="top-ad">Buy things</div>',
    ],
)
def test_marked_parts_beside_the_article_go(noise):
    for story in (f"<article>{STORY}</article>", f"<div id=story>{STORY}</div>"):
        assert m.main_text(f"<body>{noise}{story}{noise}</body>") == WANT


def test_pages_of_nothing_but_noise():
    assert m.main_text("<body><div class='cookie-notice'><p>We use cookies for all.</p></div></body>") == ""
    assert m.main_text("<body><form><p>Your name<input></form><footer>us</footer></body>") == ""
    assert m.main_text("<p>seen</p><script>var a = 1; <p>unseen") == "seen"
    assert m.main_text("<p>a</p>" + "<object>" * 20_000 + "<p>b</p>") == "a\n\nb"


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>a", "x"), (2, "v", "", "x")], "page_id long, url string, html string, text string")
    rows = m.extract(pages).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in rows) == [(0, "a", 1), (1, "", 0), (1, "", 0), (2, "", 0)]
    assert m.extract(pages.limit(0)).count() == 0
