"""Pages without article elements keep the text around adverts and forms."""

import pytest

from cohortkit.llm import html_text

LONG = "long text of the article " * 30
INTRO, BODY, END = "A short intro.", LONG.strip(), "A short end."
AD = "<div class=ad><p>buy this</p></div>"
MENU = "<ul>" + "".join(f"<li><a href=x>entry {i}</a></li>" for i in range(5)) + "</ul>"

CASES = [
    # no article element: adverts, asides, forms, buttons and notices inside the text
    (f"<div><p>{INTRO}</p>{AD}<p>{BODY}</p>{AD}<p>{END}</p></div>", f"{INTRO}\n{BODY}\n{END}"),
    (f"{MENU}<div><p>{INTRO}</p><aside>see</aside><p>{BODY}</p><form><input></form><p>two</p><button>go</button>"
     f"<p class=cookie-notice>cookies</p><p>{END}</p></div>{MENU}", f"{INTRO}\n{BODY}\ntwo\n{END}"),
    (f"<div><p>{BODY}</p>{MENU}<p>{END}</p></div>", f"{BODY}\n{END}"),
]


@pytest.mark.parametrize("page,want", CASES)
def test_cases(page, want):
    assert html_text.main_text(page) == want
