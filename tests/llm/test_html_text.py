"""Main text against the markup of the test pages read another way, and hand-made pages."""

import html
import re

from originflow.llm.html_text import extract, main_text, smooth


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_furniture_and_short_blocks():
    body = "<p>" + "long text " * 40 + "<p>a<p>b &amp; c&nbsp;d&#33;"
    page = ("<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>m<li>n</ul></nav>"
            f"<aside>side</aside><main><h1>T</h1>{body}<form><p>mail<input></form><div class='comments box'><p>nice</div>"
            "<script>var x='<p>no</p>'</script></main><div id=cookie-notice>ok?</div><footer>f</footer>")
    assert main_text(page) == "T\n\n" + ("long text " * 40).strip() + "\n\na\n\nb & c d!"


def test_two_containers_without_article():
    text = "words that go on and on " * 20
    page = f"<body><div><a href=x>one</a><a href=y>two</a></div><div><p>{text}</p><p>x</p></div>"
    assert main_text(page) == text.strip() + "\n\nx"


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, None, "u", 5), (2, "", "u", 5), (3, "plain &lt; text", "u", 5), (3, "<p>a\n b<br>c", "u", 5),
                                (None, "<div><p>" + "x" * 300_000, None, 5), (4, "<!-- <p>no</p>", "u", 5), (5, "<b>cut <i", "u", 5)],
                               "page_id long, html string, url string, n_chars int")
    got = [(r.page_id, r.text, r.n_chars) for r in extract(df).collect()]
    assert sorted(g[2] for g in got) == sorted(len(g[1]) for g in got)
    texts = {(g[0], g[1]) for g in got if g[0] is not None}
    assert {(1, ""), (2, ""), (3, "plain < text"), (3, "a b c"), (4, ""), (5, "cut")} <= texts
    assert any(g[0] is None and g[2] == 300_000 for g in got)
    assert extract(df.limit(0)).count() == 0


def test_smoothing_keeps_constants():
    assert all(abs(x - 3) < 1e-12 for x in smooth([3.0] * 7)) and smooth([5.0]) == [5.0]
