"""Main text of pages."""

import re

import pytest

from cohortkit.llm import html_text
from tests.llm.conftest import SF001, read

CASES = [
    (None, ""), ("", ""), ("plain words only", "plain words only"),
    ("<html><body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>one\n  two<b>bold</b></p>"
     "<aside>side</aside><p>three</article><footer>foot</footer>", "T & U\none twobold\nthree"),
    ("<body><div class='cookie-notice'>We use cookies</div><main><p>Body <i>text</i></p><div id=comments><p>Nice!</p></div>"
     "<form><input><button>Go</button></form><p>End</p></main></body>", "Body text\nEnd"),
    ("<script>var a='<article>no</article>'</script><style>p{}</style><article>x<br>y<!-- c --><p class=ad>buy<p>z", "x y\nz"),
    ("<article><header><h1>Title</h1></header><p>a < b &lt;c&gt;</p></article>", "Title\na < b <c>"),
    ("<article><p>cut off &am", "cut off &am"), ("<article><p>a<div class='x", "a"), ("<nav>menu<article><p>kept</p></article>", "kept"),
    ("<ul><li><a>one</a><li><a>two</a></ul><div><p>" + "long text " * 20 + "</p><p>more text here</p></div>",
     ("long text " * 20).strip() + "\nmore text here"),
    *[(f"<article><h1>T</h1><p>One foo<img src=x>bar.</p><{e} {k}='{n}'><p>drop this text, all of it</p></{e}><p>Two.</p></article>", "T\nOne foobar.\nTwo.")
      for e in ("div", "section") for k, n in (("class", "article-comments"), ("class", "post-comments"), ("class", "user-comments"),
                                               ("class", "ad-300x250"), ("class", "cookie-banner-v2"), ("class", "blog-sidebar"), ("class", "adsbygoogle"))],
    *[(f"<div><h1>T</h1><p>One.</p><div class={n}><p>drop</p></div><p>Two.</p></div>", "T\nOne.\nTwo.")
      for n in ("article-comments", "ad-300x250", "cookie-banner-v2", "blog-sidebar", "adsbygoogle")],
    ("<div class='page has-sidebar'><div class=with-comments><h1>T</h1><p>One.</p></div></div>", "T\nOne."),
    ("<div class='sidebar-layout'><article><p>One.</p></article></div>", "One."),
    ("<div class=comment-howto><h1>T</h1><p>One.</p></div>", "T\nOne."),
    ("<article><p class='notice'>hidden</p></article>", ""), ("<article></article>", ""),
]


@pytest.mark.parametrize("page,want", CASES)
def test_cases(page, want):
    assert html_text.main_text(page) == want


def test_pages_table(spark):
    pages = read(spark, SF001, "pages")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "text"]
    by_id = {r.page_id: r.text for r in got.collect()}
    import html
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split())
                 for b in re.split(r"</?(?:p|h1)>", inner)]
        assert by_id[r.page_id] == "\n".join(p for p in parts if p)


def test_odd_pages(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, None, None), (2, "u", "<p>" + "w " * 200_000, "y")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = html_text.extract(df)
    assert got.columns == ["page_id", "url", "text"] and got.count() == 4
    assert sorted(len(r.text) for r in got.collect()) == [0, 1, 1, 399_999]
    assert html_text.extract(df.limit(0)).count() == 0
