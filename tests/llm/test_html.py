import html as std
import re

from molgrid.llm import html


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    salted = {r.page_id: r.text for r in html.extract(pages, broadcast_hosts=-1, salts=4).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        inner = re.sub(r"</?b>", "", inner).replace("<br>", " ")
        blocks = (" ".join(std.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        want = "\n\n".join(x for x in blocks if x)
        assert got[r.page_id].text == want == salted[r.page_id]
        assert got[r.page_id].n_chars == len(want)


def test_what_is_not_the_article_goes():
    page = """<body><header><h1>Site</h1></header><nav><a href=x>menu</a></nav><div class="cookie-notice">cookies</div>
    <div id=main class="content-12"><article><header><h1>Title &amp; more</h1></header><p>Hello <b>wor</b>ld<br>again
    <p>third<script>var x = "</p><p>no</p>";</script></p><div class="share-bar">share</div><form>form</form>
    <table><tr><td>a<td>b</tr></table><!-- <p>hidden</p> --></article>
    <div class="comments"><p>a reader's long comment, longer than all the rest of this page, again and again</p></div></div>
    <aside>side</aside><footer>foot</footer>"""
    assert html.text_of(html.parse(page), None) == "Title & more\n\nHello world again\n\nthird\n\na b"


def test_host_decides(spark):
    usual = "<body><div class='story-{}'><p>{}</p></div><div class='box'><p>{}</p></div></body>"
    rows = [(k, f"http://h.example/{k}", usual.format(k, "long text of the story. " * 9, "short")) for k in range(5)]
    rows.append((9, "http://h.example/9", usual.format(9, "brief", "here the box is longer than the story, by far")))
    rows += [(10, None, None), (11, None, ""), (12, "nonsense", "just text"), (9, "http://h.example/9", "<p>other <i>page</i></p>")]
    pages = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, path string, host string")
    got = sorted((r.page_id, r.text) for r in html.extract(pages).collect())
    assert got[5:] == [(9, "brief"), (9, "other page"), (10, ""), (11, ""), (12, "just text")]
    assert html.extract(pages.where("page_id < 0")).count() == 0


def test_broken_markup_does_not_crash():
    for page in ("<", "<p", "<!--", "<div class='a", "</p></p>", "<script>", "a<b>c</i>d &#0; &#xZZ; &amp", "<p>" * 3000, "<div>" * 3000 + "x"):
        html.text_of(html.parse(page), None)


def test_the_whole_article_around_the_winner(spark):
    story = "long text of the story. " * 20
    nested = "<body><div class=teaser><p>other</p></div><article id=a{}><h1>title</h1><p>lead</p><div class=body><p>{}</p></div></article></body>"
    parts = "<body><main><section class=intro><p>intro</p></section><section class=text><p>{}</p></section><section class=end><p>end</p></section></main><div class=box><p>box</p></div></body>"
    rows = [(k, f"http://n.example/{k}", nested.format(k, story)) for k in range(3)] + [(k, f"http://s.example/{k}", parts.format(story)) for k in range(3, 6)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"title\n\nlead\n\n{story.strip()}" for k in range(3))
    assert all(got[k] == f"intro\n\n{story.strip()}\n\nend" for k in range(3, 6))
