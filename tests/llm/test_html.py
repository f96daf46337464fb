"""op8: built pages whose article is known."""

import html as escape_lib
import random

import pytest
from tests.llm.helpers import prose

from lodestar.llm.html import content_paths, extract, main_text

PARTS = [
    "<nav><ul><li><a href='/a'>Home page</a></li><li><a>News</a></li></ul></nav>",
    "<header><h1>The Site</h1><p>Best site, of all sites.</p></header>",
    "<div class='ad'>Buy now, great offers.</div>",
    "<aside><p>Read also: another long story, with many words.</p></aside>",
    "<div id='sidebar'><p>Most read, today. And so on, and on.</p></div>",
    "<div class='cookie-notice'>We use cookies.</div>",
    "<form><label>Search</label><input name=q><button>Go</button></form>",
    "<script>var a = '<p>no</p>';</script><style>p{}</style><!-- <p>none</p> -->",
    "<section class='comments'><article><p>Great read, thanks! I liked it.</p></article></section>",
    "<footer>&copy; the site, all rights.</footer>",
]


def page(rng, wrap):
    texts = [prose(rng, rng.randrange(1, 60)) + rng.choice([".", "!", " & co."]) for _ in range(rng.randrange(1, 9))]
    title = prose(rng, 5)
    body = f"<h1>{escape_lib.escape(title)}</h1>"
    for t in texts:
        words = escape_lib.escape(t).split()
        words[0] = f"<b>{words[0]}</b>"
        body += f"<p>{' '.join(words)}" + rng.choice(["</p>", "", "<br></p>", "</p><div class='ad'>Ad, here.</div>"])
    before = rng.sample(PARTS, 4)
    after = rng.sample(PARTS, 4)
    full = f"<html><head><title>T</title></head><body>{''.join(before)}{wrap[0]}{body}{wrap[1]}{''.join(after)}</body></html>"
    return full, " ".join([title, *texts])


@pytest.mark.parametrize("wrap", [("<article>", "</article>"), ("<main><div class=post>", "</div></main>"), ("<div class='content'>", "</div>")])
def test_built_pages(wrap):
    rng = random.Random(3)
    for _ in range(60):
        full, want = page(rng, wrap)
        assert main_text(full) == want


def test_references_and_white_space():
    assert main_text("<article><p> a &amp;&lt;b&gt;\n\n c&#233;&nbsp;d<i>e</i>f <p>g<br>h</article>") == "a &<b> cé def g h"
    assert main_text("<article><p>one</p><ul><li>two<li>three</ul>four</article><p>") == "one two three four"
    assert main_text("<p>unclosed <b>bold") == "unclosed bold"
    for nothing in (None, "", "   ", "<p></p>", "<script>x</script>", "<nav>menu</nav>"):
        assert main_text(nothing) == ""


def test_paths_are_chosen_by_ratio():
    nodes = [("/a/nav", "x")] * 10 + [("/a/p", "A long paragraph, with marks. And more, still more words.")] * 6 + [("/a/foot", "y")] * 5
    assert content_paths(nodes) == {"/a/p"}


def test_containers_leave_no_content_outside():
    long = "A long paragraph, with marks. And more, still more words."
    text = f"<p>{long}</p>" * 20
    want = " ".join([long] * 20)
    post = f"<div class=post><h1>Title</h1><div class=lead><p>short</p></div><div class=text>{text}</div></div>"
    assert main_text(f"<body><nav>Home</nav><div id=page><div>{post}</div></div><footer>end</footer></body>") == "Title short " + want
    assert main_text(f"<div><font>{long}</font> tail</div>") == long + " tail"
    assert main_text(f"<div><span>{long * 9}</span><p>{long}</p></div>") == long * 9 + " " + long
    assert main_text(f"<div><div><div>{text}</div><p>{long}</p></div><p>{long}</p></div>") == " ".join([long] * 22)


@pytest.mark.parametrize("wrap", [("<article>", "</article>"), ("<div class=post>", "</div>")])
def test_names_inside_an_article(wrap):
    """Class and id of parts of an article, which outside would name boilerplate."""
    long = "A long paragraph, with marks. And more, still more words."
    inner = (
        f"<h1>Title</h1><p>{long}</p><h2 id='related-work'>Related work</h2><p>{long}</p><section id='search'><p>{long}</p></section>"
        f"<p id='data-sharing'>Data.</p><h3 class='notice'>Mind</h3><pre>x = 1 <span class='comment'># one</span></pre>"
        f"<div class='alert'><p>{long * 3}</p></div><div class='share'><a>Like</a> <a>Tell</a></div>"
    )
    full = f"<body><div id='search'><p>{long}</p></div>{wrap[0]}{inner}{wrap[1]}<div class='related'><p>{long}</p></div></body>"
    want = f"Title {long} Related work {long} {long} Data. Mind x = 1 # one {long * 3}"
    assert main_text(full) == want


LONG = "A long reply, with marks! And more, still more words, as readers write them. "
SHORT = "<h1>Title</h1>" + "".join(f"<p>Short line {i}.</p>" for i in range(12))
ARTICLE = "Title " + " ".join(f"Short line {i}." for i in range(12))


@pytest.mark.parametrize(
    "around",
    [
        "<main>{a}<section class='comments'><p>{c}</p></section></main>",
        "<article>{a}<div class='comments'><p>{c}</p></div></article>",
        "<main>{a}<article class='comment'><p>{c}</p></article><article class='comment odd'><p>{c}</p></article></main>",
        "<article>{a}</article><div id='comments'><p>{c}</p></div>",
        "<article>{a}<div id='comments'><ol class='comment-list'><li class='comment'>{c}</li></ol></div></article>",
        "<article>{a}<div class='advert'><p>{c}</p></div></article>",
        "<div class='page'><div class='story'>{a}</div><div class='user-comments'><p>{c}</p></div></div>",
        "<main><article class='post comments-open'>{a}<div class='newsletter-signup'>{c}</div></article></main>",
    ],
)
def test_long_comments_and_adverts_go(around):
    assert main_text(f"<body><nav>Home</nav>{around.format(a=SHORT, c=LONG * 9)}</body>") == ARTICLE


def test_odd_declarations():
    for odd in ("<![foo bar]>", "<![", "<![CDATA[x]]>", "<!DOCTYPE [", "<!-", "<!->", "<!--", "<?", "<?php x ?>", "<", "<!", "</", "<![if !IE]>", "&#", "&#x110000;", "<a b='", "<p/><br/>"):
        assert main_text(f"<article><p>before</p>{odd}").startswith("before")
        assert "before" in main_text(f"<article><p>before</p>{odd}<p>after > it</p></article>")
    assert main_text("<article><p>a</p><![foo bar]><p>b</p></article>") == "a b"


def test_depth_costs_no_recursion():
    for opened, closed in (("<div>", "</div>"), ("<b>", ""), ("<span>", "</span>"), ("<ul><li>", ""), ("<div class=x>", "")):
        for depth in (1500, 10_000):
            assert main_text(f"<article><p>head</p>{opened * depth}deep{closed * depth}</article>") == "head deep"
            assert main_text(opened * depth + "deep text, here." + closed * depth) == "deep text, here."
    assert main_text("<b>x" * 10_000).split() == ["x" * 10_000]
    assert main_text("<article>" + "<b>" * 5000 + "x" + "</i>" * 20_000) == "x"


def test_mangled_pages_end_in_a_text():
    rng = random.Random(8)
    pieces = ["<!", "<![", "]>", "--", "<?", "&#", "&amp", "</", "/>", "<table>", "<td>", "</p>", "<svg>", "'", '"', "=", "<script>", "\x00", "\ud7ff"]
    for _ in range(2000):
        raw = list(page(rng, ("<article>", "</article>"))[0])
        for _ in range(rng.randrange(1, 12)):
            at = rng.randrange(len(raw))
            kind = rng.randrange(3)
            if kind == 0:
                raw[at : at + rng.randrange(1, 40)] = []
            elif kind == 1:
                raw[at:at] = rng.choice(pieces)
            else:
                raw[at] = chr(rng.randrange(1, 300))
        text = main_text("".join(raw))
        assert text == " ".join(text.split())


def test_rows(spark):
    rows = [(1, "u", "<article><p>x</p></article>", "clash"), (1, "u", "<article><p>x</p></article>", "clash"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extract(df, carry=["page_id", "url", "text"]).collect()
    assert sorted((r["row"]["page_id"] or 0, r["text"], r["n_chars"], r["row"]["text"] or "") for r in out) == [(0, "", 0, ""), (1, "x", 1, "clash"), (1, "x", 1, "clash")]
    assert extract(df.limit(0)).collect() == []
    assert main_text("<article>" + "<p>word</p>" * 30000 + "</article>") == " ".join(["word"] * 30000)
