from __future__ import annotations

from urllib.parse import urljoin

from pyspark.sql import functions as F

from quirework.functions import web as W
from quirework.operators import web as OW


def test_resolve_url_agrees_with_the_standard_library(spark):
    bases = ["https://h.example/a/b/c?x=1#f", "http://h.example", "https://h.example/works/1"]
    hrefs = ["/d/1.epub", "d/2.pdf", "../e.html", "../../../e", "./f", "?q=1", "#top", "//o.example/x", "https://z.example/y",
             "mailto:a@b", "/a/./b/../c", "..", "g/", "/"]
    rows = [(b, h) for b in bases for h in hrefs]
    df = spark.createDataFrame(rows, "b string, h string")
    for r in df.select("b", "h", W.resolve_url(F.col("b"), F.col("h")).alias("u")).collect():
        assert r.u == urljoin(r.b, r.h), (r.b, r.h)


def test_work_urls(evaluate):
    urls = ["https://a.example/works/31/chapters/68?x#y", "HTTP://b.example/works/7/", "/works/5", "//c.example/works/9x", "https://a.example/users/works/1", "", "works/3"]
    assert evaluate(W.normalize_work_url, urls) == [
        "https://a.example/works/31", "http://b.example/works/7", "https://archiveofourown.org/works/5", "https://c.example/works/9", None, None, None]


def test_metadata(spark):
    page = '<head><meta property="og:title" content=" Meta &amp; T "></head><h2 class="title heading"> {} </h2><h3 class="byline heading">by <a rel="author" href="#">Ann <b>B</b></a></h3>'
    rows = [(1, page.format("A <i>b</i>")), (2, page.format("")), (3, "<h2>no</h2><h3>x</h3>"),
            (4, '<h3 class="byline heading">anonymous</h3>' + page.format("T"))]
    got = OW.page_metadata(spark.createDataFrame(rows, "id int, html string"), ["id"]).orderBy("id").collect()
    assert [(r.title, r.author) for r in got] == [("A b", "Ann B"), ("Meta & T", "Ann B"), ("AO3 Work", "Unknown Author"), ("T", "Ann B")]
    assert got[0].file_stem == "Ann B - A b"


def test_links_last_one_wins(spark):
    html = ('<a name="x">EPUB</a><a href="/1">Get EPUB</a><a href="/2.epub">file</a><a href="/x.PDF">p</a>'
            '<a href="">MOBI</a><a href="/m?format=azw3&amp;y">k<span>indle</span></a>')
    df = spark.createDataFrame([(1, html, "https://h.example/w/1"), (2, "<a href='/z'>z</a>", "https://h.example")], "id int, html string, url string")
    links = OW.download_links(df, ["id"])
    got = {r.id: r.links for r in links.collect()}
    assert got[1] == {"epub": "https://h.example/2.epub", "pdf": "https://h.example/x.PDF", "azw3": "https://h.example/m?format=azw3&y"}
    assert got[2] == {}
    best = {r.id: tuple(r)[1:] for r in OW.picked_formats(links, ["id"], ("mobi", "PDF", "epub")).collect()}
    assert best == {1: ("pdf", "https://h.example/x.PDF", "ok"), 2: (None, None, "no_format")}
