import html
import re

from cinderglass.llm.html_extract import extract, extract_pages, op7_extract_pages


def plain(page):
    """The article of the fixture's one template."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", body)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p.replace("<b>", ""))).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    rows = op7_extract_pages(spark, d).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain(pages[r.page_id]) and r.n_chars == len(r.text)


def test_other_templates(spark):
    body = "<div class='post-{k}'><header><h2>Head &eacute; {k}</h2></header><p>First  para\n of <a href=x>it</a> &amp; more words here.<p>Second para, long enough to count as text.<ul><li>one<li>two</ul><div class='share'>Share me</div><section id=comments><p>{c}</p></section></div>"
    page = "<html><body><header><h1>Site</h1></header><div class=menu><a href=/>Home</a></div><div class='cookie-notice'>We use cookies</div>{b}<aside>Side bar text</aside><form>Name<input></form><footer>foot</footer></body></html>"
    rows = [(k, f"http://h.example/{k}", page.format(b=body.format(k=k, c="I liked this very much! " * (30 if k == 3 else 1))), "old") for k in range(5)]
    rows += [(9, None, None, ""), (10, "not a url", "", ""), (11, "http://h.example/x", "just text", ""), (12, "http://h.example/y", "<p>open <script>x<", "")]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    for k in range(5):
        assert got[k] == f"First para of it & more words here.\n\nSecond para, long enough to count as text.\n\none\n\ntwo"
    assert (got[9], got[10], got[11], got[12]) == ("", "", "just text", "open")


def test_keeps_title_intro_and_other_containers(spark):
    page = "<html><body><article><h1>T</h1><div class=intro><p>{a}</p></div><div class=body><p>{b}</p></div></article><nav>menu</nav></body></html>"
    other = "<html><body><div><article><p>short</p></article><div class=long><p>{b}</p></div></div></body></html>"
    a, b = "intro word " * 3, "body word " * 9
    rows = [(k, f"http://h.example/{k}", page.format(a=a, b=b)) for k in range(3)] + [(3, "http://h.example/3", other.format(b=b))]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"T\n\n{a.strip()}\n\n{b.strip()}" for k in range(3)} | {3: f"short\n\n{b.strip()}"}


def test_names_that_only_mention_boilerplate(spark):
    around = ["<div class='layout has-sidebar'>{}</div>", "<div id='page' class='no-comments'>{}</div>", "<div class='content banner-off'>{}</div>", "<div class='widget'>{}</div>", "<div data-hidden=1>{}</div>", "<div class='promo'><div class='widget'>{}</div></div>"]
    article = "<article><h1>Title</h1><p>Some text of the article.</p></article><div class='share-buttons'>Share</div>"
    rows = [(k, f"http://h{k}.example/", f"<html><body>{a.format(article)}<div class=site-footer>foot</div></body></html>") for k, a in enumerate(around)]
    rows += [(20, "http://x.example/", "<body><div class='promo'><p>all there is</p></div></body>"), (21, "http://y.example/", "<body><p hidden>gone</p><p>seen</p></body>")]
    rows += [(22, "http://z.example/", "<body><article><p>Mine.</p></article><ol class='comments'><li><article><p>theirs</p></article></ol></body>")]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "Title\n\nSome text of the article." for k in range(6)} | {20: "all there is", 21: "seen", 22: "Mine."}


def test_deep_nesting_takes_linear_time():
    import time

    began = time.time()
    deep = extract("<div class=a>" * 100_000 + "<p>text</p>" + "</div>" * 100_000, None)
    mixed = extract("<div><b>" * 50_000 + "<p>text</b></i>" * 1000, "div\x1fdiv")
    assert (deep, mixed[:4]) == ("text", "text") and time.time() - began < 20


def test_odd_rows(spark):
    rows = [(1, "http://h.example/", "<p>a</p>", {"odd name": 1}, "x", "y")] * 2 + [(2, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, path struct<`odd name`: int>, host string, _html string")
    got = [tuple(r) for r in extract_pages(df).orderBy("page_id").collect()]
    assert [(r[0], r[-2], r[-1], r[4], r[5]) for r in got] == [(1, "a", 1, "x", "y")] * 2 + [(2, "", 0, None, None)]
    assert extract_pages(df.limit(0)).count() == 0
