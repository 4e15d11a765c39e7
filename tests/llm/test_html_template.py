"""Template text of a host: constant blocks in neutral elements go, copies and small hosts keep everything."""

from lobspark.llm import html

SCHEMA = "page_id long, url string, html string"


def page(i: int, extra: str = "", body: str = "") -> str:
    return f"<html><body><article><div class=box3>Read our weekly letter, free for members.</div><h1>Title {i}</h1><p>Words of page {i}.</p>{extra}{body}</article></body></html>"


def texts(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], SCHEMA).repartition(3)
    return [r.text for r in html.extract(df).orderBy("row.page_id").select("text").collect()]


def test_constant_boxes_of_a_host_go(spark):
    pages = [("http://a.org/%d" % i, page(i)) for i in range(12)] + [("http://b.org/1", page(1))]
    got = texts(spark, pages)
    assert got[:12] == [f"Title {i} Words of page {i}." for i in range(12)]
    assert got[12] == "Read our weekly letter, free for members. Title 1 Words of page 1."  # one page tells nothing


def test_the_same_words_in_another_slot_stay(spark):
    quote = "<blockquote>Read our weekly letter, free for members.</blockquote>"
    pages = [("http://a.org/%d" % i, page(i, quote if i == 4 else "")) for i in range(12)]
    assert texts(spark, pages)[4] == "Title 4 Words of page 4. Read our weekly letter, free for members."


def test_copies_of_an_article_are_no_template(spark):
    pages = [("http://a.org/%d" % i, page(0)) for i in range(40)] + [("http://a.org/x", page(1))]
    assert texts(spark, pages) == ["Read our weekly letter, free for members. Title 0 Words of page 0."] * 40 + ["Read our weekly letter, free for members. Title 1 Words of page 1."]


def test_a_text_of_fewer_pages_stays(spark):
    """Seven of ten pages are below the share; eight of ten are not."""
    for n, want in ((7, "Title 0 Words of page 0. Seen often."), (8, "Title 0 Words of page 0.")):
        pages = [("http://a.org/%d" % i, page(i, "<p class=q>Seen often.</p>" if i < n else "")) for i in range(10)]
        assert texts(spark, pages)[0] == want


def test_unknown_hosts_and_empty_pages(spark):
    pages = [(None, page(i)) for i in range(12)] + [("http://a.org/1", None), ("http://a.org/2", "")]
    got = texts(spark, pages)
    assert all(t.startswith("Read our weekly letter") for t in got[:12]) and got[12:] == ["", ""]
