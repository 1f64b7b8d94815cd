import pytest

from polyquilt.llm import html

CASES = [
    ("<p>a&amp;b &lt;c&gt;<p>d&nbsp; e", "a&b <c>\nd e"),
    ("<html><head><title>t</title><style>p{}</style></head><body><nav>menu</nav><article><h1>H</h1><p><b>one<br>two<p>three</article><footer>f</footer>", "H\none two\nthree"),
    ('<body><div class="cookie-notice">ok?</div><div id="sidebar"><p>s</p></div><main><p>text</p><form><input>go</form><aside>x</aside></main><div class="comments"><p>me too</p></div>', "text"),
    ('<div class="content-with-sidebar"><p>kept</p></div>', "kept"),
    ("<ul><li>one<li>two</ul><table><tr><td>a<td>b</table>", "one\ntwo\na\nb"),
    ('<article>x<script>var t="</p>";if(a<b){}</script>y<!-- no --></article>', "xy"),
    ('<article><p>a</p><section class="comments"><p>b</p></section><div class="ad">c</div></article>', "a"),
    ("<p>5 < 6 and 7 > 3</p>", "5 < 6 and 7 > 3"),
    ("<article>never closed <b>bold", "never closed bold"),
    ("plain", "plain"),
    ("", ""),
    ("<div" + "><div" * 3000 + ">deep" + "</div>" * 3000, "deep"),
    ('<form id="page"><article><p>in a form</p></article></form>', "in a form"),
    ('<a href="x>y">link</a> <img alt="a>b"> end', "link end"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_pages(page, text):
    assert html.main_text(html.parse(page)) == text


def site(n, host="example.org", unique=True):
    out = []
    for k in range(n):
        body = f"<div><span>Same line on all pages</span></div><div><p>Story {k if unique else 0} begins</p><p>and goes on {k * 7}</p></div>"
        out.append((k, f"http://{host}/{k}", f"<body><section>About us and our site</section>{body}</body>"))
    return out


def test_low_branches_go_and_small_sites_stay_whole(spark):
    pages = spark.createDataFrame(site(20) + [(100 + k, f"http://small.org/{k}", p) for k, _, p in site(3)], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    assert got[4] == "Same line on all pages\nStory 4 begins\nand goes on 28" and "About" not in got[4]
    assert got[101].startswith("About us and our site")


def test_importance_is_entropy(spark):
    import math

    pages = spark.createDataFrame([("h", f"<section>{'same' if k % 2 else k}</section>") for k in range(8)], "host string, html string")
    found = {r["style"]: r["importance"] for r in html.importance(pages).collect()}
    want = (math.log(8) - 4 * math.log(4) / 8) / math.log(8)
    assert abs(found["/section"] - want) < 1e-9


def test_hard_rows(spark):
    rows = [(1, None, None, "x", 1), (None, "http://a.b/", "<p>x</p>", "x", 1), (2, "", "", "x", 1), (2, "", "", "x", 1), (3, "http://a.b/", "<p>" + "long " * 50000 + "</p>", None, None)]
    out = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, low int"))
    got = out.collect()
    assert out.columns == ["page_id", "url", "text"] and len(got) == 5
    assert sorted(len(r["text"]) for r in got) == [0, 0, 0, 1, 249999]
    assert html.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_large_style_tables_meet_pages_by_host(spark, monkeypatch):
    pages = spark.createDataFrame(site(20), "page_id bigint, url string, html string")
    want = sorted(map(tuple, html.extract(pages).collect()))
    monkeypatch.setattr(html, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, html.extract(pages).collect())) == want


def article(k, chrome="About us"):
    return f"<body><div>{chrome}</div><article><section>Share this story</section><h1>Title {k}</h1><p>Story {k} begins</p><p>and goes on {k * 7}</p></article></body>"


@pytest.mark.parametrize("copies,others", [(8, 0), (40, 1), (83, 17)])
def test_copies_of_one_page_keep_their_text(spark, copies, others):
    """A host, or the site of all null URLs, that is mostly copies loses no article; exact copies and copies in other chrome alike."""
    pages = [article(0, "About us" if k % 2 else f"Page {k}") for k in range(copies)] + [article(k) for k in range(1, others + 1)]
    rows = [(k, url and f"{url}{k}", p) for url in (None, "http://example.org/") for k, p in enumerate(pages)]
    got = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        n = max(0, r["page_id"] - copies + 1)
        assert r["text"].endswith(f"Title {n}\nStory {n} begins\nand goes on {n * 7}")
        assert ("Share" in r["text"]) == (others < 8)


def test_the_style_of_most_of_an_article_stays():
    page = html.parse("<article><section>Menu</section><p>The story of the river</p></article>")
    assert html.main_text(page, frozenset(["/article/section", "/article/p"])) == "The story of the river"


def test_deep_markup_keeps_blocks_and_styles():
    root = html.parse("<div>" * 1500 + "<p>a</p><p>b <b>c</b></p><section>menu</section>")
    assert html.main_text(root) == "a\nb c\nmenu"
    deep = "/div" * 1500
    assert html.main_text(root, frozenset([f"{deep}/section"])) == "a\nb c"
    assert {f"{deep}/p", f"{deep}/section"} <= set(html.styles(root))


def test_names_of_content_are_kept():
    """A word in a name is no reason to drop a paragraph, a heading, an article's header, or a part that is named by more."""
    kept = [
        '<p class="warning">Never mix acids.</p>', '<div class="related-work">Others did so too.</div>', '<h2 id="comments-on-plato">Comments on Plato</h2>', "<header><h1>The headline</h1></header>",
        '<div class="notice-of-death">He died in May.</div>', '<p class="ad-hoc">An ad hoc rule.</p>', '<p class="share-price">It fell by half.</p>', '<section id="social-history">Guilds and towns.</section>',
    ]
    gone = [
        '<div class="ad">Buy now</div>', '<div class="comments">First!</div>', '<div id="comment-list">Nice.</div>', '<ul class="social-share-buttons"><li>Tweet</li></ul>', '<div class="related-posts">More</div>',
        '<section class="newsletter signup-box">Sign up</section>', "<nav>Home</nav>", "<aside>Also</aside>", "<form>Search</form>", "<footer>Imprint</footer>", '<div class="cookie-notice">We use cookies</div>',
    ]
    page = "<body><header>Site</header><article>" + "".join(x + y for x, y in zip(kept + ["<p>End.</p>"] * 3, gone)) + "</article><footer>Foot</footer></body>"
    text = html.main_text(html.parse(page))
    assert text.split("\n") == ["Never mix acids.", "Others did so too.", "Comments on Plato", "The headline", "He died in May.", "An ad hoc rule.", "It fell by half.", "Guilds and towns.", "End.", "End.", "End."]
    only = html.main_text(html.parse('<article><div class="notice-of-death">A</div><p class="ad-hoc">B</p><p class="share-price">C</p></article>'))
    assert only == "A\nB\nC"
