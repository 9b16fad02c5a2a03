from barlattice.llm import html_main

FIXED = html_main.Weights({})


def test_parts_that_are_not_the_article():
    page = """<!doctype html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="has-sidebar">
    <header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>no</p> --><div id="cookie-notice">We use cookies</div>
    <article><h1>A &amp; B</h1><p>First <b>bold
      words</b> &eacute;&nbsp;x<p>Second<br>line<div class="ad">Buy now</div><ul><li>One<li>Two</ul><form>Name <input></form>
    <blockquote>Said &lt;so&gt;</blockquote><aside>Else</aside><p>Last.</article>
    <section class="comments"><article class="comment"><p>First!</p></article></section><footer>&copy; me</footer>"""
    want = "A & B\nFirst bold words é x\nSecond line\nOne\nTwo\nSaid <so>\nLast."
    assert html_main.main_text(page, FIXED) == want


def test_best_region_is_the_brute_force_one():
    import itertools
    import random
    random.seed(2)
    for _ in range(300):
        scores = [random.choice([-3, -1, 0, 1, 2]) for _ in range(random.randint(0, 9))]
        a, b = html_main.best_region(scores)
        best = max([0, *(sum(scores[i:j]) for i, j in itertools.combinations(range(len(scores) + 1), 2))])
        assert sum(scores[a:b]) == best


def test_pages_without_article():
    menu = "<div><a href=1>a menu of</a> <a href=2>many links</a></div>" * 3
    page = f"<body>{menu}<div>Here are many words of text</div><div>and some more of them</div>{menu}</body>"
    assert html_main.main_text(page, FIXED) == "Here are many words of text\nand some more of them"


def test_layout_classes_on_wrappers():
    body = "<h1>Title here</h1><p>One two three four five six.</p><p>Seven eight nine ten.</p>"
    want = "Title here\nOne two three four five six.\nSeven eight nine ten."
    menu = "<div class='sidebar-left'><a href=1>Menu</a> and more words beside</div>"
    for wrapper in ("div class='content has-sidebar'", "div class='no-sidebar'", "div class=layout-header-fixed",
                    "div class='page sidebar-page'", "div id='main' data-id='search-1'", "div title='it is hidden here'",
                    "article class='post share-enabled'", "section aria-label=\"menu class='ad'\""):
        page = f"<body>{menu}<{wrapper}>{body}</{wrapper.split()[0]}><footer>none</footer>"
        assert html_main.main_text(page, FIXED) == want, wrapper
        page = f"<body>{menu}<{wrapper}><article>{body}</article></{wrapper.split()[0]}><div class='comments'><p>{'c ' * 99}</div>"
        assert html_main.main_text(page, FIXED) == want, wrapper


def test_parts_of_the_article_stay():
    page = "<article><p class=byline>By me</p><p>Some text.</p><p class='disclaimer'>No advice.</p><p class=promotion>Her promotion came.</p></article>"
    assert html_main.main_text(page, FIXED) == "By me\nSome text.\nNo advice.\nHer promotion came."


def test_teasers_are_not_the_article():
    text = "\n".join(f"Paragraph {i} of the long text that this page is about." for i in range(6))
    page = ("<body><article><p>A teaser here</p></article><nav><a href=1>x</a></nav><div>"
            + "".join(f"<p>{x}</p>" for x in text.split("\n")) + "</div>")
    assert text in html_main.main_text(page, FIXED)


def test_dropped_parts_within_a_line():
    page = "<article><p>Hello <span class='share'>Share</span>big <button>Push</button>world, <b>bold</b> text.</p></article>"
    assert html_main.main_text(page, FIXED) == "Hello big world, bold text."


def test_comments_of_a_page_without_article():
    page = ("<body><div><p>The text of the page, a few words.</p></div><div id='comment-list'>"
            + "<p>First! Many more words than the text has.</p>" * 9 + "</div>")
    assert html_main.main_text(page, FIXED) == "The text of the page, a few words."


def test_deep_marks_are_read_in_linear_time():
    page = "<div class='ad x'>a " * 20_000 + "<p>last"
    assert html_main.main_text(page, FIXED) is not None


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    import html
    import re
    rows = html_main.extract(pages).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(rows) == pages.count()
    for r in rows:
        inner = r.html[r.html.index("<article>"):r.html.index("</article>")]
        cut = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|article)>", "\0", inner.replace("<br>", " ")))
        want = "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in cut.split("\0")) if x)
        assert r.text == want and r.n_chars == len(want)


def test_odd_rows(spark):
    pages = spark.createDataFrame([
        (1, None, None, 0), (1, "u", "", 0), (None, "u", "plain text only", 0), (2, "u", "<article><p>" + "word " * 60_000, 0),
        (3, "u", "<p title='a > b'>x <", 0), (4, "u", "<article><p>" + "<b>" * 5_000 + "deep", 0)],
        "page_id bigint, url string, html string, text bigint")
    rows = html_main.extract(pages).collect()
    assert len(rows) == 6
    texts = {(r.page_id, r.url): r.text for r in rows}
    assert texts[1, None] == "" and texts[1, "u"] == "" and texts[None, "u"] == "plain text only"
    assert texts[2, "u"] == " ".join(["word"] * 60_000) and texts[3, "u"] == "x <" and texts[4, "u"] == "deep"
    assert html_main.extract(pages.limit(0)).count() == 0
