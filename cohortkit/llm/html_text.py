"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element; scripts, styles,
comments and navigation, advert, form and reader-comment containers leave
nothing.  The text lengths of ``WINDOW`` consecutive lines are summed; a
surge is a line where the sum leaves zero, the dive is where it falls back,
and the text between them is a region.  With an ``article`` (or ``main``)
element the tags decide: all text inside it is main text.  Containers of
comments, adverts, notices and the like go by their element or by the words of
their class and id; one strong word is enough (``STRONG_NAMES``) where the
container holds neither the main text nor its title nor nearly all text.  Without
such an element lines
that are mostly links count as empty, and all regions are kept: link lists of
``WINDOW`` lines and more, or at either end of the page, are what is dropped.

Edge cases: null and empty pages give an empty text; unclosed or cut-off
markup ends with the page; repeated pages and null urls keep a row each; an
empty table gives an empty result.  A page is one row, so memory is bounded by
the largest page of a batch.
"""

from __future__ import annotations

import bisect
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3

# Elements by the way they are treated.
RAW = frozenset("script style title textarea noscript template xmp iframe".split())
BOILERPLATE = frozenset("head nav header footer aside form menu dialog button select svg object audio video canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROOTS = frozenset("html body article main".split())
# Words that name a container which is not the article.  A class, id or role counts when it consists of such
# words, alone or with the layout words below (cookie-notice, related-posts; not related-work).
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter "
    "notice notices pager pagination popup promo promoted promotion related reply replies search share sharing "
    "sidebar sidebars social sponsor sponsored subscribe toolbar widget widgets".split())
LAYOUT_NAMES = frozenset(
    "a area articles bar bottom box btn button buttons card cards container content default div fixed form global "
    "google group icons inline inner item items large left link links list main media mobile outer overlay page panel "
    "posts primary right row secondary section sidebar signup site slot small stories sticky template thread top "
    "unit wrap wrapper".split())
# Of these names, the ones that make an article element a reader comment, teaser or advert.
ARTICLE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising comment comments promo promoted promotion related reply replies "
    "sponsor sponsored".split())
# Section ids are link targets of the text, but for these.
SECTION_IDS = frozenset("comments disqus".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Any of these words in a class or id names such a container, however it goes on (post-comments, ad-300x250), unless
# a modifier says that the element merely has one (has-sidebar).
STRONG_NAMES = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertisements advertising comment comments commentlist consent "
    "cookie cookies disqus newsletter popup promo promotion sidebar sidebars sponsor sponsored".split())
MODIFIERS = frozenset("has is no not with without".split())
CONTAINERS = frozenset("aside dl div ins ol section table ul".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_SPACE = re.compile(r"\s+")


def _named(value: str, names: frozenset) -> bool:
    words = [w for w in re.split(r"[^a-z]+", value) if w]
    return not names.isdisjoint(words) and all(w in names or w in LAYOUT_NAMES for w in words)


def _is_boilerplate(name: str, attrs: str, in_article: bool) -> bool:
    if name in BOILERPLATE:
        return not (name == "header" and in_article)
    if name in ROOTS and name != "article" or not attrs:
        return False
    names = ARTICLE_NAMES if name == "article" else BOILERPLATE_NAMES
    if in_article:
        names = names - {"header"}
    for key, a, b, c in _ATTR.findall(attrs):
        value, key = (a or b or c).lower(), key.lower()
        if key != "id":
            found = any(_named(v, names) for v in value.split())
        elif name in HEADINGS or name not in BLOCKS:  # a link target
            found = False
        elif name == "section" and in_article:
            found = _named(value, SECTION_IDS)
        else:
            found = _named(value, names)
        if found:
            return True
    return name not in ROOTS and bool(_HIDDEN.search(attrs))


def _strongly_named(name: str, attrs: str) -> bool:
    if name not in CONTAINERS or not attrs:
        return False
    for key, a, b, c in _ATTR.findall(attrs):
        for value in (a or b or c).lower().split():
            words = [w for w in re.split(r"[^a-z]+", value) if w]
            if not STRONG_NAMES.isdisjoint(words) and MODIFIERS.isdisjoint(words) and not (key.lower() == "id" and name == "section"):
                return True
    return False


def page_tags(page: str):
    """Tags as (start, end, closing?, name, attributes); comments and raw elements have the name None."""
    out, at, low, n = [], 0, None, len(page)
    while m := _TAG.search(page, at):
        start, at = m.span()
        closing, name, attrs = m.group(1) or m.group(4), m.group(2) or m.group(5), m.group(3) or m.group(6) or ""
        name = name and name.lower()
        if name in RAW and not closing:
            if not attrs.rstrip().endswith("/"):
                low = page.lower() if low is None else low
                # lower() may change lengths outside ASCII; search the page itself then
                end = (low.find(f"</{name}", at) if len(low) == n else
                       next((x.start() for x in re.compile(rf"</{name}", re.I).finditer(page, at)), -1))
                at = n if end < 0 else end
            name = None
        out.append((start, at, bool(closing), name, attrs))
    return out


def _is_empty(name: str, attrs: str) -> bool:
    return name in VOID or attrs == "/" or (attrs[-1:] == "/" and (attrs[-2].isspace() or attrs[-2] in "\"'"))


def element_ends(tags):
    """Per opening tag: the tag that ends its element, and whether the element was closed.

    A closing tag ends the nearest open element of its name; elements opened
    inside that one were never closed and end there too, as all do at the end
    of the page.  A block ends an open p, and an li the one before it.
    """
    ends, closed = [len(tags)] * len(tags), [False] * len(tags)
    stack, by_name, lists = [], {}, []  # open elements, their places by name, places of lists and items

    def pop_to(depth, at):
        while len(stack) > depth:
            i = stack.pop()
            name = tags[i][3]
            by_name[name].pop()
            if lists and lists[-1] == len(stack):
                lists.pop()
            ends[i] = at

    for i, (_, _, closing, name, attrs) in enumerate(tags):
        if name is None:
            continue
        if closing:
            if by_name.get(name):
                depth = by_name[name][-1]
                closed[stack[depth]] = True
                pop_to(depth, i)
            continue
        if name in BLOCKS and by_name.get("p"):
            depth = by_name["p"][-1]
            closed[stack[depth]] = True
            pop_to(depth, i)
        if name == "li" and lists and tags[stack[lists[-1]]][3] == "li":
            closed[stack[lists[-1]]] = True
            pop_to(lists[-1], i)
        if _is_empty(name, attrs):
            ends[i], closed[i] = i, True
            continue
        by_name.setdefault(name, []).append(len(stack))
        if name in ("ul", "ol", "menu", "dir", "li"):
            lists.append(len(stack))
        stack.append(i)
    return ends, closed


def page_lines(page: str):
    """Lines of a page as (text, link characters, inside the article?); empty texts are gaps.

    A boilerplate container is skipped to its end, with all articles inside;
    one that was never closed ends at the next article, and a container or
    form around the main element (a form around an article) at that element.
    """
    lines, buf, links = [], [], 0
    article = 0          # open article or main elements
    anchor = 0
    seen_article = False
    tags = page_tags(page)
    ends, closed = element_ends(tags)
    # starts of main texts, for containers that are never closed or lie around them
    mains = [i for i, t in enumerate(tags) if t[3] == "main" and not t[2]]
    texts = [i for i, t in enumerate(tags)
             if t[3] in ("article", "main") and not t[2] and not _is_boilerplate(t[3], t[4], False)]

    # what a container with a strong name may not hold: the main text, or its title, or nearly all text of the page
    heads = sorted({*texts, *mains, *[i for i, t in enumerate(tags) if t[3] == "h1" and not t[2]]})
    written = [0]  # characters outside tags before each tag
    for i, t in enumerate(tags):
        written.append(written[-1] + t[0] - (tags[i - 1][1] if i else 0))
    written.append(written[-1] + len(page) - (tags[-1][1] if tags else 0))

    def strong(i):
        if not _strongly_named(tags[i][3], tags[i][4]):
            return False
        k = bisect.bisect_right(heads, i)
        if k < len(heads) and heads[k] < ends[i]:
            return False
        return 10 * (written[min(ends[i] + 1, len(tags))] - written[i + 1]) <= 9 * written[-1]

    def flush():
        nonlocal links
        text = _SPACE.sub(" ", html.unescape("".join(buf))).strip()
        if text:
            lines.append((text, links, article > 0))
        buf.clear()
        links = 0

    def gap():
        lines.extend([("", 0, article > 0)] * WINDOW)

    def text(part):
        nonlocal links
        if part:
            buf.append(part)
            if anchor:
                links += len(part)

    def skip(i):
        """Where to go on after the container that tag ``i`` opens: the next tag and the place in the page."""
        end = ends[i]
        inner = mains if closed[i] and tags[i][3] != "form" else texts
        k = bisect.bisect_right(inner, i)
        if not article and k < len(inner) and inner[k] < end:
            end = inner[k]
        elif end == i or (end < len(tags) and closed[i] and tags[end][2]):  # its own tag is the last one
            return end + 1, tags[end][1]
        return end, tags[end][0] if end < len(tags) else len(page)

    i, at = 0, 0
    while i < len(tags):
        start, end, closing, name, attrs = tags[i]
        text(page[at:start])
        at = end
        i += 1
        if name is None:
            continue
        if name == "a":
            anchor = 0 if closing else 1
        if name in BLOCKS:
            flush()
            anchor = 0
        elif name in ("br", "td", "th"):
            buf.append(" ")
        if not closing and name not in VOID and (_is_boilerplate(name, attrs, article > 0) or strong(i - 1)):
            flush()
            i, at = skip(i - 1)
        elif name in ("article", "main"):
            gap()
            article = max(0, article + (-1 if closing else 1))
            seen_article |= not closing
            gap()
    text(page[at:])
    flush()
    return lines, seen_article


def regions(weights: list[int]) -> list[tuple[int, int]]:
    """Line ranges between a surge and the next dive of the windowed sums."""
    n = len(weights)
    sums = [sum(weights[i:i + WINDOW]) for i in range(n)]
    out, start = [], None
    for i in range(n + 1):
        here = sums[i] if i < n else 0
        if here and start is None:
            start = i
        elif not here and start is not None:
            while weights[start] == 0:  # the window reaches ahead of the text
                start += 1
            out.append((start, i))
            start = None
    return out


def main_text(page: str | None) -> str:
    """The main text: its blocks joined by newlines."""
    if not page:
        return ""
    lines, has_article = page_lines(page)
    if has_article:
        weights = [len(t) if inside else 0 for t, _, inside in lines]
    else:
        weights = [0 if 2 * links > len(t) else len(t) for t, links, _ in lines]
    return "\n".join(lines[i][0] for a, b in regions(weights) for i in range(a, b) if lines[i][0])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Every column of ``pages`` but the markup, with ``text`` (an input column of that name is replaced)."""
    names = [c for c in pages.columns if c not in (html_col, "text")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("page"), F.col(html_col).alias("html"))

    def run(batches):
        for batch in batches:
            texts = pa.array([main_text(h.as_py()) for h in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["page", "text"])

    schema = rows.select("page", F.lit("").alias("text")).schema
    return rows.mapInArrow(run, schema).select("page.*", "text")
