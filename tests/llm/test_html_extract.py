"""Main text: what stays, what goes, and what pages of one host tell about each other."""

import random
import time

import pytest

from strandline.llm import html_extract as he

HEAD = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>'


def text_of(html):
    page = he.Page(html)
    return page.text(page.best()) if page.blocks else ""


def test_article_without_its_surroundings():
    html = HEAD + (
        '<nav><ul><li><a href="/x">Menu</a></li></ul></nav><header>Top</header><div class="ad-1">Buy</div><div id=cookie-notice>We use</div>'
        "<article><h1>Title &amp; more</h1><p><b>One\n  two&nbsp;three.<br><p>Four <i>f</i>ive&#33;</p><!-- a > b --><p></p><ul><li>item</ul>"
        '<aside>side</aside><div class="share">tweet</div><form><p>name</p></form><script>if (a<b) x("<p>no</p>")</script><p>Last</p></article>'
        '<section class="comments"><p>first!</p></section><div class="sidebar"><p>more more more more</p></div><footer>&copy; me</footer>'
    )
    assert text_of(html) == "Title & more\nOne two three.\nFour five!\nitem\nLast"


def test_marked_wrappers_hold_the_article():
    article = "<article><h1>Title</h1><p>" + "some text " * 30 + "</p></article>"
    want = "Title\n" + " ".join(["some text"] * 30)
    rest = '<div class="sidebar"><p>more and more</p></div><section id="comments"><p>first!</p></section>'
    for wrapper in ('class="layout has-sidebar"', 'class="site no-comments"', 'id="page-header-fixed"'):
        for before, after in (("", ""), ("<p>brand</p>", "<div>Copyright</div>")):
            assert text_of(f"{HEAD}{before}<div {wrapper}>{article}{rest}</div>{after}") == want
            assert text_of(f'{HEAD}{before}<div {wrapper}><div class="no-toc">{article}</div>{rest}</div>{after}') == want
    assert text_of(f'{HEAD}<div id="page-header-fixed"><p>only this</p></div><nav>x</nav>') == "only this"
    # What is longer than the article is not the article.
    assert text_of(f'{HEAD}<article><p>short</p></article><div class="comments"><h1>Comments</h1>{"<p>a long answer</p>" * 50}</div>') == "short"
    assert text_of(f'{HEAD}<div><p>short</p></div><div class="comments">{"<p>a long answer</p>" * 50}</div>') == "short"
    assert text_of(f'{HEAD}<div><p>short</p></div><div class="nav">{"<a>a long link</a>" * 50}</div>') == "short"


def test_drawings_that_close_themselves():
    for tag in ("svg", "math", "SVG"):
        assert text_of(f'<article><p>one <{tag} class="x"/> two</p></article>') == "one two"
        assert text_of(f"<article><p>one <{tag}/> two</p><p>three <{tag}><p>no</p></{tag}></p></article>") == "one two\nthree"


def test_broken_and_plain_pages():
    assert text_of("") == text_of("<nav>x</nav>") == ""
    assert text_of("just text & more") == "just text & more"
    assert text_of("<p>a<p>b<div>c</div>d < e") == "a\nb\nc\nd < e"
    assert text_of("<body><article><p>the article</article></div></p><p>b") == "the article"
    assert text_of("<div class='x'><p>only</div><script>never ends") == "only"


def test_hosts_vote(spark):
    post = '<div class="wrap"><div class="post post-{i}"><p>{text}</p></div><div class="box">{other}</div></div>'
    rows = [(i, f"http://h.example/{i}", post.format(i=i, text=f"article {i} " + "text " * 30, other="x")) for i in range(9)]
    rows += [(9, "https://H.example:80/9", post.format(i=9, text="tiny", other="<p>" + "noise " * 50 + "</p>"))]
    rows += [(10, "http://other.example/", "<main><p>alone</p></main>"), (11, None, None), (12, "", ""), (10, "http://other.example/", "<main><p>alone</p></main>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in he.extract(df).collect())
    want = sorted([(i, t := f"article {i} " + " ".join(["text"] * 30), len(t)) for i in range(9)] + [(9, "tiny", 4), (10, "alone", 5), (10, "alone", 5), (11, "", 0), (12, "", 0)])
    assert got == want
    assert he.extract(df.limit(0)).collect() == []


def test_very_long_page():
    html = "<article>" + "".join(f"<p>line {i}</p>" for i in range(50_000)) + "</article>"
    assert text_of(html).count("\n") == 49_999


def test_words_that_are_no_marks():
    keep = '<article><h1>T</h1><p class="social">one</p><section id="related-work"><p>two</p></section><div class="share-price"><p>three</p></div><div class="has-sidebar"><p>four</p></div>'
    gone = '<div class="share-buttons">x</div><div id="related">x</div><p class="ad">x</p><div class="site-footer">x</div><ul class="social links"><li>x</ul></article>'
    assert text_of(keep + gone) == "T\none\ntwo\nthree\nfour"


def test_time_is_linear():
    """Time at twice the length is under three times the time, of the better of two runs."""
    bits = ["<a ", '<a "', "<a '\"", "<!", "</x>", "<div>", "<!-- ", "<p class='ad'>x", '<a href="', "<div class=nav>a", "<svg>", "&amp;", "<", "<form>y", "<article>z", "<div class=comments><h1>q"]

    def taken(html):
        began = time.perf_counter()
        he.Page(html).best()
        return time.perf_counter() - began

    for bit in bits:
        for tail in ("", ">", "x</p>"):
            one, two = (min(taken(bit * (n // len(bit)) + tail) for _ in range(2)) for n in (300_000, 600_000))
            assert two < 3 * one + 0.1, (bit, tail, one, two)


PROSE = "The river rose again in spring and the town moved its market to the hill. " * 3


@pytest.mark.parametrize("html,want", [
    (f"<body><form id=aspnetForm><div class=content><p>{PROSE}</p></div></form></body>", PROSE),
    (f"<body><form id=aspnetForm><div class=content><h1>T</h1><p>{PROSE}</p></div></form><footer>f</footer><p>outside</p></body>", f"T\n{PROSE}"),
    (f"<body><div class=notice><p>{PROSE}</p></div><div class=c><p>Hi</p></div></body>", PROSE),
    (f"<body><article><header><h1>T</h1><p>lead</p></header><p>{PROSE}</p><section id=search><p>how to</p></section></article><header>site</header></body>", f"T\nlead\n{PROSE}\nhow to"),
    (f"<body><article><p>{PROSE}</p><div class='user-comment-thread'><p>reader says hi</p></div><div id='articleComments'>me too</div></article></body>", PROSE),
    (f"<body><article class=post><p>{PROSE}</p></article><article class=post><p>Teaser</p></article></body>", PROSE),
    (f"<body><main><h1>T</h1><p>{PROSE}</p><form><input>Subscribe here</form><dialog open>Sign in</dialog></main><aside>{PROSE}{PROSE}</aside></body>", f"T\n{PROSE}"),
    (f"<body class='no-comments'><div class='site no-comments'><p>{PROSE}</p></div></body>", PROSE),
    (f"<body><form><div class=content><p>{PROSE}<p>second", f"{PROSE}\nsecond"),
])
def test_what_holds_the_article_is_kept(html, want):
    assert text_of(html) == "\n".join(line.strip() for line in want.split("\n"))


def regular_page(rng):
    """A well-formed page and its article's blocks, by construction."""
    words = lambda n: " ".join(rng.choice(["alpha", "beta &amp; co", "g\n amma", "<b>delta</b>", "&#233;t&eacute;", "x < y"]) for _ in range(n))
    plain = lambda t: " ".join(t.replace("<b>", "").replace("</b>", "").replace("&amp;", "&").replace("&#233;", "é").replace("&eacute;", "é").split())
    blocks = [words(rng.randrange(3, 30)) for _ in range(rng.randrange(1, 8))]
    body = "".join(f"<p>{b}</p>" if rng.random() < 0.7 else f"<div><p>{b}</p></div><div class='ad'>buy {rng.random()}</div>" for b in blocks)
    talk = f"<div class='reader-comments-box'><p>{words(5)}</p></div>" if rng.random() < 0.3 else ""
    html = f"<html><body><nav><a href=/>menu</a></nav><main>{body}{talk}</main><aside>other {words(40)}</aside><footer>end</footer></body></html>"
    if rng.random() < 0.3:
        html = html.replace("<body>", "<body><form id=page>").replace("</body>", "</form></body>" if rng.random() < 0.5 else "</body>")
    return html, "\n".join(map(plain, blocks))


def test_built_pages_give_what_they_were_built_from(spark):
    rng = random.Random(8)
    made = [regular_page(rng) for _ in range(120)]
    df = spark.createDataFrame([(i, f"http://h{i % 3}.example/{i}", h) for i, (h, _) in enumerate(made)], "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in he.extract(df).collect()} == {i: t for i, (_, t) in enumerate(made)}


def test_html_is_not_shuffled(spark):
    df = spark.createDataFrame([(1, "http://a.example/", "<p>x</p>")], "page_id bigint, url string, html string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = he.extract(df)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    moved = [below for line, below in zip(lines, lines[1:]) if "Exchange" in line]
    assert moved and not any("html" in below and "MapInArrow" not in below for below in moved)
