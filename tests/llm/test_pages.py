import random

from tessera.llm import templates
from tests.llm.helpers import prose


def text_of(html):
    return templates.Read(html).text()


def test_markup():
    assert text_of("<") == "<" and text_of(None) == text_of("") == text_of("<!-- x") == text_of("<script>x") == ""
    assert text_of("a < b &amp; c &am d&amp<p>e&#233;&nbsp;&nbsp;f</p>") == "a < b & c &am d& eé f"
    assert text_of("<p>one<b>two</b>three<br>four<td>five<td>six") == "onetwothree four five six"
    assert text_of("<title>no</title><style>p{}</style><script>var t='</p>';</script><p>yes<!-- no --> <!DOCTYPE html>it<![CDATA[x]]> is</p></p></b>") == "yes it is"
    assert text_of("<p>a<p>b<div>c<p>d</div>e<ul><li>f<li>g</ul>h") == "a b c d e f g h"
    assert text_of('<p title="a > b" class=\'x\'>t</p><a href="x>y">u</a>') == "t u"
    assert text_of("<p>a<b>b<p>c</b>d</p>e") == "ab cd e"
    assert text_of("<noscript>on</noscript><textarea><p>x</textarea><svg><text>y</text></svg>z") == "z"
    assert text_of("<" * 1000 + "<a " * 1000).startswith("<")
    assert text_of("<div>" * 20_000 + "deep" + "</span></div>" * 20_000) == "deep"
    assert text_of('<a b="' * 3000 + "x") in ("", "x")


def test_what_markup_says():
    page = """<html><head><title>t</title></head><body class="has-sidebar js-menu"><header><h1>Site</h1></header><nav>Menu</nav><div id="cookie-notice">We use cookies</div>
    <form id="page"><div class="wrapper sidebar-left"><article class="post with-comments"><header class="entry-header"><h1>Title</h1></header><div class="ad">Buy</div><p>One &copy; two</p>
    <aside>See also</aside><blockquote>Said</blockquote><form>Mail <input></form><p>Three.</p><footer>Tags</footer><section id="comments"><article><p>Nice!</p></article></section></article>
    <article class="teaser related">More</article></div></form><ol class="commentlist"><li>First!</li></ol><div role="complementary">Side</div><footer>Foot</footer></body></html>"""
    assert text_of(page) == "Title One © two Said Three."
    assert text_of("<body><nav>m</nav><main><h1>Title</h1><article><p>x</p></article><div>later</div></main></body>") == "Title x"
    assert text_of("<body><nav>m</nav><main><h2>Title</h2><p>x</p><div class='newsletterBox signup'>n</div></main>out</body>") == "Title x"
    assert text_of("<article><p>a</p><article><p>comment</p></article></article>") == "a"
    assert text_of("<article><h1>T</h1><article><p>a</p></article></article>") == "T a"
    assert text_of("<article>a</article><article>b</article>") == "a b"
    assert text_of("<body><div class=menu>m</div>plain <i>text</i></body>") == "plain text"


def site(spark, pages, **columns):
    rows = [(i, u, h, "clash", 1) for i, (u, h) in enumerate(pages)]
    return {r.page_id: r.text for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, slot int"), keep=("page_id", "url")).collect()}


def test_templates_of_a_site(spark):
    """Menus, notices and adverts whose names say nothing, in <div>s only; of another host the same words are its text."""
    r = random.Random(3)
    adverts = [prose(5, 100 + i) for i in range(3)]
    pages, want = [], []
    for i in range(40):
        body = "".join(f"<p>{prose(12, 1000 + 7 * i + k)}</p>" for k in range(3)) + "<p>shared line</p>" * (i % 3 == 0)
        text = " ".join([*(prose(12, 1000 + 7 * i + k) for k in range(3)), *["shared line"] * (i % 3 == 0)])
        box = f"<div class='q7'>{adverts[i % 3]}</div>" if i % 2 else ""
        pages.append((f"https://A.example/{i}", f"<body><div class='x{i}'><ul><li>Home</li><li>News</li></ul></div><div class='z1'>{box}{body}<div>Send this on</div></div><div class='y'>All rights</div></body>"))
        want.append(text)
    for i in range(30):  # copies of one page do not make a template of its text
        pages.append(("https://a.example/copy", pages[0][1]))
        want.append(want[0])
    for i in range(12):
        pages.append((f"https://b.example/{i}", f"<article><h1>{prose(3, 50 + i)}</h1><div>Subscribe now</div><p>{prose(20, 60 + i)}</p></article>"))
        want.append(f"{prose(3, 50 + i)} {prose(20, 60 + i)}")
    pages += [("https://c.example/1", "<div>Home News</div><p>Send this on</p>"), (None, None), (None, ""), ("no url", "<p>x</p>")]
    want += ["Home News Send this on", "", "", "x"]
    assert site(spark, pages) == dict(enumerate(want))


def test_near_copies_keep_their_text(spark):
    """A third of a site's pages are near copies of each other."""
    paragraphs = [prose(15, 500 + k) for k in range(6)]
    pages, want = [], []
    for i in range(45):
        own = [prose(9, 900 + i), *paragraphs] if i % 3 == 0 else [prose(15, 2000 + 9 * i + k) for k in range(4)]
        pages.append((f"http://n.example/{i}", f"<nav>{'abc'[i % 3]}</nav><article><h1>t{i}</h1>{''.join(f'<p>{p}</p>' for p in own)}</article>"))
        want.append(" ".join([f"t{i}", *own]))
    assert site(spark, pages) == dict(enumerate(want))


def test_one_host_of_all_pages_by_join(spark, monkeypatch):
    pages = [("http://h.example/", f"<div>Home</div><p>{prose(9, i)}</p>") for i in range(60)]
    want = {i: prose(9, i) for i in range(60)}
    assert site(spark, pages) == want
    monkeypatch.setattr(templates, "MOST", 0)
    assert site(spark, pages) == want


def test_no_pages(spark):
    out = templates.extract(spark.createDataFrame([], "page_id long, url string, html string"), keep=("page_id",))
    assert out.columns == ["page_id", "text"] and out.count() == 0
    assert templates.extract(spark.createDataFrame([(1, None, None)] * 2, "page_id long, url string, html string")).collect() == [("",)] * 2
