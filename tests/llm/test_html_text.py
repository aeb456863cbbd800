from pyspark.sql import functions as F

from tessera.llm.html_text import extract_text, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="post comments-open">
<header><p>Site header, with a long and punctuated sentence. Really.</p></header><nav><ul><li><a href=/a>Menu one</a><li><a>Menu two</a></ul></nav>
<div class="ad">Buy this, now. It is great, they say, and cheap.</div><!-- c <p>no</p> --><div id="cookie-notice">We use cookies.</div>
<article><h1>Title  &amp; more</h1><p>First <b>bold
text</b> here.<br>Next line.<p>Second &eacute;&#x41; para<script>bad()</script>.<ul><li>one<li>two</ul>
<aside>Related things.</aside><form><input value=x><label>Name</label></form><p>.</p></article>
<section class="comments"><p>A reader's comment, long and wordy, with punctuation. Yes.</p></section>
<footer>&copy; someone. All of it.</footer></body></html>"""


def test_article():
    assert main_text(PAGE) == "Title & more\nFirst bold text here. Next line.\nSecond éA para.\none\ntwo\n."


def test_page_without_article_element():
    page = "<div class=top><a>x</a><a>y</a></div><div id=content><p>" + "A long sentence, with commas, and more. " * 9 + "</p><p>Short.</p></div><div>tiny</div><div class='sidebar'><p>" + "Side text, not wanted. " * 30 + "</p></div>"
    assert main_text(page).endswith("\nShort.") and "Side" not in main_text(page) and "x" not in main_text(page).split("\n")[0][:1]


def test_wrapper_classes_leave_articles_alone():
    body = "<p>A sentence of the article, with commas. And another.</p>"
    for c in ("page has-sidebar", "no-sidebar hfeed", "content-with-sidebar", "main-content header-fixed", "post no-comments", "nav-open", "sidebar", "widget"):
        assert main_text(f"<div class='{c}'><article>{body}</article></div>") == "A sentence of the article, with commas. And another.", c
    for c in ("post category-social-policy", "entry tag-search", "social"):
        assert main_text(f"<article class='{c}'>{body}<div class='share social'>Share this.</div></article>") == "A sentence of the article, with commas. And another.", c
    assert main_text("<div class='sidebar'><p>All there is, a sentence.</p></div>") == "All there is, a sentence."
    assert main_text(f"<article>{body}</article><section class='comments'><article><p>A reader, with a comment.</p></article></section>") == "A sentence of the article, with commas. And another."


def test_best_branch_keeps_its_short_parts_and_closed_svg_hides_nothing():
    long = "<p>" + "A long sentence, with commas, and more. " * 13 + "</p>"
    quote = "<blockquote><p>One short sentence, quoted.</p></blockquote><table><tr><td>A cell</td></tr></table>"
    got = main_text(f"<div id=content>{long}{quote}{long}</div><div>tiny</div>").split("\n")
    assert got[1:3] == ["One short sentence, quoted.", "A cell"] and len(got) == 4
    assert main_text('<p>One</p><svg class="i"/><p>Two</p><svg><text>no</text></svg><p>Three</p>') == "One\nTwo\nThree"


def test_ratios_decide_between_articles_and_other_parts():
    story = "<p>" + "A long sentence of the story, with commas, and more. " * 6 + "</p>"
    page = f"<div id=content><h1>Title</h1>{story * 5}</div><article class=card><p>A teaser.</p></article>"
    got = main_text(page)
    assert got.startswith("Title\nA long sentence") and got.count("\n") == 5 and "teaser" not in got
    inside = main_text(f"<article>{story}<div class='related-work'><p>Others did this, too.</p></div>{story}</article>")
    assert "Others did this, too." in inside
    two = main_text(f"<main><article>{story}</article></main><div class=teaser><article><p>Short.</p></article></div>")
    assert "Short" not in two
    assert main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be, they say.</p><object><p>A fallback.</p></object></article>") == "Let x=2 be, they say.\nA fallback."


def test_comments_and_notices_are_no_content():
    story = "<p>A short story, of one sentence.</p>"
    said = "".join(f"<p>Reader {i} says this, at length, and says it again, with many words. Really, they do.</p>" for i in range(30))
    for opening, closing in (
        ("<div id='reader-comments'>", "</div>"), ("<div class='user-comments'>", "</div>"), ("<div class='wp-comments-area'>", "</div>"), ("<section><h2>Comments</h2>", "</section>"), ("<section id=comments>", "</section>"),
        ("<section><h3>12 comments</h3>", "</section>"), ("<div class=thread><h3>Leave a reply</h3>", "</div>"), ("<ol class='comment-list'><li>", "</ol>"), ("<div class=box>", "</div>"), ("<div class=thread><article class=comment>", "</article></div>"),
    ):
        for page in (f"<article>{story}</article>{opening}{said}{closing}", f"<main><article>{story}</article></main>{opening}{said}{closing}"):
            assert main_text(page) == "A short story, of one sentence.", page[:150]
        if "box" not in opening:
            assert main_text(f"<main>{story}{opening}{said}{closing}</main>") == "A short story, of one sentence.", opening
            assert main_text(f"<div class=story>{story}</div>{opening}{said}{closing}") == "A short story, of one sentence.", opening
    assert main_text(f"<div class=story>{story}</div><div class='legal-notice'>{said}</div>") == "A short story, of one sentence."
    # articles about such things, and sections of them, stay
    paper = f"<article><h1>Comments on a theorem</h1>{story}<section><h2>Discussion</h2>{story}</section></article>"
    assert main_text(paper).count("\n") == 3
    assert main_text(f"<div class='comments-enabled'>{story * 3}</div><div>x</div>").count("story") == 3


def test_hostile_pages_take_linear_time():
    import time

    deep = "<div>" * 20_000 + "<p>Deep down, a text.</p>" + "</div>" * 20_000
    lists = "<ul><li>" * 20_000 + "x"
    for page, want in ((deep, "Deep down, a text."), (lists, "x"), ('<a title="x>' * 40_001 + "y", None), ("<a " * 100_000, None), ("<!" * 100_000, None), ("<svg a='" * 30_000, None)):
        began = time.perf_counter()
        got = main_text(page)
        assert time.perf_counter() - began < 5, page[:20]
        assert want is None or got == want


def test_odd_input():
    for t in (None, "", "   ", "<", "<p", "<!-- open", "<script>never closed", "</p></div>", "<p>" * 3000, "&bogus; &#xFFFFFFFF;"):
        assert isinstance(main_text(t), str)
    assert main_text("plain text, no tags.") == "plain text, no tags."
    assert main_text("<article>" + "<p>word word, word.</p>" * 30_000 + "</article>").count("\n") == 29_999


def test_table(spark):
    rows = [(1, "u", PAGE), (2, None, None), (2, None, None), (None, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = extract_text(df).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 0, len(main_text(PAGE))]
    assert extract_text(df.limit(0)).count() == 0


def test_real_pages_keep_the_article_whole(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    texts = {r.page_id: r.text for r in extract_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert texts[r.page_id] == "\n".join(b for b in blocks if b)
