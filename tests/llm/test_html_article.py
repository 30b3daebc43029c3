"""Text inside an article is never part of a host's template."""

from sedimill.llm import html_extract


def texts(spark, pages):
    rows = [(i, "http://h.example/" + str(i), page) for i, page in enumerate(pages)]
    found = html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(found, key=lambda r: r["page_id"])]


def test_near_copies_keep_their_article(spark):
    pages = [f"<body><nav>Menu {i}</nav><article><h1>Title</h1><p>The same text.</p></article></body>" for i in range(8)]
    assert texts(spark, pages) == ["Title\n\nThe same text."] * 8
    pages = [f"<body><nav>Menu {i}</nav><div>The same text.</div></body>" for i in range(8)]
    assert texts(spark, pages) == ["The same text."] * 8


def test_repeated_heading_stays_in_the_article(spark):
    pages = [f"<body><div>Follow us</div><main><h2>Summary</h2><p>Own text {i}</p></main></body>" for i in range(8)]
    assert texts(spark, pages) == [f"Summary\n\nOwn text {i}" for i in range(8)]


def test_template_outside_an_article_is_still_cut(spark):
    pages = [f"<body><div>Follow us</div><div>Own text {i}</div></body>" for i in range(8)]
    assert texts(spark, pages) == [f"Own text {i}" for i in range(8)]
