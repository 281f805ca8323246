"""Pages whose main text lies beside comments and teaser cards that are articles too."""

import time

import pytest

from cohortkit.llm import html_text

LONG = "long text of the article " * 30
INTRO, BODY, END = "A short intro.", LONG.strip(), "A short end."

CASES = [
    # articles inside containers, after, in and before the article
    (f"<article><p>{BODY}</p></article><div id=comments><article class=comment><p>Nice!</p></article>"
     "<article><p>First!</p></article></div>", BODY),
    (f"<aside><article><p>card</p></article></aside><nav><article>card</article></nav><article><p>{BODY}</p></article>"
     "<section class=related><article><p>card</p></article></section>", BODY),
    (f"<article><p>{INTRO}</p><aside><article><p>card</p></article></aside><p>{BODY}</p><div class=comments>"
     "<article class=comment><p>one</p></article><article class=comment><p>two</p></article></div></article>", f"{INTRO}\n{BODY}"),
    (f"<article><p>{BODY}</p></article><article class='comment even'><p>Nice!</p></article>", BODY),
    (f"<main><div class=ad>never closed<article><p>{BODY}</p></article></main><p>out</p>", ""),
    (f"<div id=wrap><div><nav>menu</div><article><p>{BODY}</p></article></div>", BODY),
    (f"<div class=sidebar>never closed<article><p>{BODY}</p></article>", BODY),
    (f"<form id=page><nav>menu</nav><article><p>{BODY}</p></article></form>", BODY),
    (f"<div class=site-header>top<main><p>{BODY}</p></main></div>", BODY),
    # names: whole classes, and no ids of headings, sections and inline elements
    (f"<article><section id=related-work><h2 id=search>Search</h2><p>{BODY}</p></section><section id=notice><p>{END}</p></section>"
     "<h2><span id=share>Share</span></h2><div class=post-header><p>Head</p></div></article>", f"Search\n{BODY}\n{END}\nShare\nHead"),
    (f"<article class='post has-comments share-on'><p class='search-results-explained'>{BODY}</p><div class=social-share>tweet</div>"
     "<div class='box related-posts'>more</div></article>", BODY),
]


@pytest.mark.parametrize("page,want", CASES)
def test_cases(page, want):
    assert html_text.main_text(page) == want


def test_deep_and_unclosed_pages_take_linear_time():
    start = time.time()
    for page in ("<div class=ad>" * 50_000 + "x", "<b><li>" * 50_000 + "x", "<nav><article>" * 50_000 + "x", "</p>" * 50_000,
                 "<p class=ad>a" * 50_000, "<nav/><nav />" * 50_000):
        html_text.main_text(page)
    assert time.time() - start < 30
