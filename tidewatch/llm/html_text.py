"""Main text of web pages by composite text density.

Every DOM node gets characters per tag, adjusted for characters inside links; a node's
density sum adds up its children's densities.  The densest-sum node marks the article; the
smallest density on its path to the body is the threshold from which other nodes may add
their own densest-sum subtree.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import first_columns, python_ready

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)>")
_LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_HINT = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_BLOCK = frozenset("""address article aside blockquote body br button caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup
    option p pre section select summary table tbody td tfoot th thead tr ul""".split())
#: Opening one of the key's tags ends an open element of these.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
         "th": ("td", "th"), "option": ("option",), "body": ("head",), "tbody": ("thead", "tbody"),
         "tfoot": ("tbody", "thead")}
#: An implied end never reaches beyond these.
_SCOPE = frozenset("table ul ol dl div article section main body html td th select blockquote".split())
_CLOSES_P = _BLOCK - {"br", "body", "html", "head", "button", "option", "optgroup"}
#: Never part of an article.
_DROPPED = frozenset("""nav header footer aside script style noscript template iframe button select textarea menu
    dialog svg canvas head title object embed map datalist""".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
#: Whole names of what readers wrote; other names that hold such a word ("comments-open",
#: "no-comments") only describe an element.
_READERS = re.compile("(?:user|reader|post|article|blog|page)?[-_]?(?:comments?|disqus|replies)"
                      "(?:[-_]?(?:list|area|section|thread|body|wrapper|wrap|container|content|box|item|block|text|form))?")
#: Names of what stands beside an article, unless most of the page's text is in it.
_SIDE = frozenset("""ad ads adv advert adverts advertisement advertisements banner sponsor sponsored promo sidebar menu
    nav navbar navigation footer header masthead notice notices cookie cookies consent popup modal share sharing social
    related breadcrumb breadcrumbs newsletter subscribe widget toolbar pagination""".split())
_KEEP = frozenset("html body".split())
_ARTICLE = frozenset("main article".split())
#: Markup within a line: part of the text around it, no node of its own for densities.
_INLINE = frozenset("""abbr b bdi bdo big br cite code del dfn em font i img ins kbd label mark q s samp small span strike
    strong sub sup time tt u var wbr""".split())


class _Page:
    """Elements in page order: parent, tag, last element inside, and what they hold."""

    def __init__(self) -> None:
        self.parent, self.tag, self.last, self.hints = [-1], ["#root"], [0], [frozenset()]
        self.chunks: list[tuple[int, str | None]] = []   # (element, text), None for a block's edge


def parse(source: str) -> _Page:
    """Elements of a page, tolerant of missing and crossed end tags."""
    page = _Page()
    stack, open_tags = [0], {}
    at, n, lower = 0, len(source), None

    def push(tag: str, hints: frozenset) -> int:
        node = len(page.tag)
        page.parent.append(stack[-1])
        page.tag.append(tag)
        page.last.append(node)
        page.hints.append(hints)
        return node

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            open_tags[page.tag[node]] -= 1
            page.last[node] = len(page.tag) - 1
            if page.tag[node] in _BLOCK:
                page.chunks.append((stack[-1], None))

    def end_open(tags: tuple[str, ...], scope: frozenset) -> None:
        if not any(open_tags.get(t) for t in tags):
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = page.tag[stack[depth]]
            if tag in tags:
                pop_to(depth)
                return
            if tag in scope:
                return

    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            page.chunks.append((stack[-1], source[at:]))
            break
        if lt > at:
            page.chunks.append((stack[-1], source[at:lt]))
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if source.startswith(("<!", "<?"), lt):
            end = source.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(source, lt) or _LOOSE_TAG.match(source, lt)
        if not m:
            page.chunks.append((stack[-1], "<"))
            at = lt + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag in _BLOCK:
                page.chunks.append((stack[-1], None))
            if tag in _KEEP:
                # what follows still belongs to the body
                pop_to(1 + max((d for d in range(1, len(stack)) if page.tag[stack[d]] in _KEEP), default=len(stack) - 1))
                continue
            if open_tags.get(tag):
                for depth in range(len(stack) - 1, 0, -1):
                    if page.tag[stack[depth]] == tag:
                        pop_to(depth)
                        break
            continue
        if tag in _CLOSES_P:
            end_open(("p",), _SCOPE)
        if tag in _ENDS:
            end_open(_ENDS[tag], _SCOPE - frozenset(_ENDS[tag]))
        if tag in _BLOCK:
            page.chunks.append((stack[-1], None))
        node = push(tag, _hints(m[3]) if m[3] else frozenset())
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK and tag not in _RAW:
            continue
        if tag in _RAW:
            lower = source.lower() if lower is None else lower
            # lower() may change lengths of a few letters; search the original then
            end = lower.find("</" + tag, at) if len(lower) == n else _find_end(source, tag, at)
            at = n if end < 0 else end
            close = source.find(">", at)
            at = n if close < 0 else close + 1
            continue
        stack.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1
    pop_to(1)
    page.last[0] = len(page.tag) - 1
    return page


def _find_end(source: str, tag: str, at: int) -> int:
    m = re.compile("</" + re.escape(tag), re.I).search(source, at)
    return m.start() if m else -1


def _hints(attributes: str) -> frozenset:
    out = set()
    for name, value in _HINT.findall(attributes):
        value = html.unescape(value.strip("\"'")).lower()
        words = re.findall("[a-z]+", value)
        out.update("role:" + w if name.lower() == "role" else w for w in words)
        if name.lower() != "role" and any(map(_READERS.fullmatch, value.split())):
            out.add("#readers")
    return frozenset(out)


def _is_named_boilerplate(page: _Page, node: int, holds_head: list[bool], holds_article: list[bool]) -> bool:
    """What readers wrote, and roles beside an article; never the body, a main element, or what holds the
    page's heading or main element."""
    tag, hints = page.tag[node], page.hints[node]
    if not hints or tag in _KEEP or tag == "main" or holds_head[node]:
        return False
    beside = any(h[5:] in _ROLES for h in hints if h.startswith("role:")) and not holds_article[node]
    return beside or "#readers" in hints


def _side_names(page: _Page, node: int, holds_title: list[bool], holds_article: list[bool]) -> frozenset:
    tag, hints = page.tag[node], page.hints[node]
    if tag == "form":
        return frozenset() if holds_article[node] else frozenset(["form"])
    # a container of the article may be named after what stands beside it
    return frozenset() if tag in _KEEP or tag in _ARTICLE or holds_title[node] else hints & _SIDE


def _dropped(page: _Page, chunks: list[tuple[int, str | None]]) -> list[bool]:
    """Elements that are no part of the article by their tags, roles and names.

    Where one main or article element has text of its own, all names count.  Else a form or a
    side-named element with more than half of the page's link-free characters stays; and if names
    would still remove more than half of them, those that remove most are passed over.
    """
    n = len(page.tag)
    holds_article = [t in _ARTICLE for t in page.tag]
    holds_head = [t in ("h1", "main") for t in page.tag]
    for node in range(n - 1, 0, -1):
        holds_article[page.parent[node]] |= holds_article[node]
        holds_head[page.parent[node]] |= holds_head[node]
    holds_title = [a or b for a, b in zip(holds_article, holds_head)]
    by_tag, firm, names, in_link = [False] * n, [False] * n, [frozenset()] * n, [False] * n
    for node in range(1, n):
        p = page.parent[node]
        by_tag[node] = by_tag[p] or page.tag[node] in _DROPPED
        firm[node] = firm[p] or by_tag[node] or _is_named_boilerplate(page, node, holds_head, holds_article)
        in_link[node] = in_link[p] or page.tag[node] == "a"
    own = [0] * n
    for node, text in chunks:
        if text is not None and not by_tag[node] and not in_link[node]:
            own[node] += len("".join(text.split()))
    if any(x and not gone for x, gone in zip(own, firm)):
        own = [0 if gone else x for x, gone in zip(own, firm)]
    else:
        firm = by_tag                     # a page of nothing else
    for node in range(1, n):
        if not firm[node]:
            names[node] = _side_names(page, node, holds_title, holds_article)
    if not any(names):
        return firm
    plain = list(own)
    for node in range(n - 1, 0, -1):
        plain[page.parent[node]] += plain[node]

    def drop(passed: set, least: float) -> list[bool]:
        out = list(firm)
        for node in range(1, n):
            out[node] = firm[node] or out[page.parent[node]] or bool(names[node] - passed) and plain[node] <= least
        return out

    out = drop(set(), math.inf)
    marked, inside = 0, [False] * n
    for node in range(1, n):
        here = page.tag[node] in _ARTICLE and not out[node] and plain[node] > 0
        marked += here and not inside[page.parent[node]]
        inside[node] = here or inside[page.parent[node]]
    if marked == 1:
        return out
    passed: set = set()
    while True:
        out = drop(passed, plain[0] / 2)
        if 2 * sum(x for x, gone in zip(own, out) if not gone) >= plain[0]:
            return out
        lost: dict[str, int] = {}
        for node in range(1, n):
            if out[node] and not firm[node] and not out[page.parent[node]]:
                for name in names[node] - passed:
                    lost[name] = lost.get(name, 0) + plain[node]
        passed.add(max(sorted(lost), key=lost.get))


def main_text(source: str | None) -> str:
    """The article's text, white space of a block as one space and blocks joined by one space.

    Null, empty or all-boilerplate pages give the empty text.
    """
    if not source:
        return ""
    page = parse(source)
    n = len(page.tag)
    chunks = [(node, text if text is None else html.unescape(text)) for node, text in page.chunks]
    dropped = _dropped(page, chunks)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for node in range(1, n):
        in_link[node] = in_link[page.parent[node]] or page.tag[node] == "a"
    chunks = [(node, text) for node, text in chunks if not dropped[node]]
    for node, text in chunks:
        if text is not None:
            size = len("".join(text.split()))
            chars[node] += size
            link_chars[node] += size * in_link[node]
    for node in range(n - 1, 0, -1):
        if not dropped[node]:
            p = page.parent[node]
            chars[p] += chars[node]
            tags[p] += tags[node] + (page.tag[node] not in _INLINE)
            link_chars[p] += link_chars[node]
            link_tags[p] += link_tags[node] + (page.tag[node] == "a")
    if not chars[0]:
        return ""
    body = next((i for i in range(1, n) if page.tag[i] == "body" and not dropped[i]), 0)
    if not chars[body]:
        body = 0
    density = _densities(chars, tags, link_chars, link_tags, body)
    sums = [0.0] * n
    for node in range(n - 1, 0, -1):
        if not dropped[node]:
            sums[page.parent[node]] += sums[node] if page.tag[node] in _INLINE else density[node]
    # a leaf that holds text is as dense as itself
    for node in range(n):
        if not sums[node] and page.tag[node] not in _INLINE:
            sums[node] = density[node]
    best = _best_inside(page, sums, dropped)
    top = best[body]
    threshold, node = density[body], top
    while node not in (body, 0):
        threshold = min(threshold, density[node])
        node = page.parent[node]
    chosen = [False] * n
    stack = [body]
    while stack:
        node = stack.pop()
        if dropped[node] or density[node] < threshold and page.tag[node] not in _INLINE:
            continue
        if page.tag[node] not in _INLINE:
            chosen[best[node]] = True
        if not chosen[node]:
            stack += _children(page, node)
    inside = [False] * n
    inside[0] = chosen[0]
    for node in range(1, n):
        inside[node] = chosen[node] or inside[page.parent[node]]
    return " ".join("".join(" " if text is None else text for node, text in chunks if text is None or inside[node]).split())


def _children(page: _Page, node: int) -> Iterator[int]:
    child = node + 1
    while child <= page.last[node]:
        yield child
        child = page.last[child] + 1


def _densities(chars, tags, link_chars, link_tags, body: int) -> list[float]:
    out = []
    share = link_chars[body] / chars[body] if chars[body] else 0.0
    for c, t, lc, lt in zip(chars, tags, link_chars, link_tags):
        if not c:
            out.append(0.0)
            continue
        t, lt_, lc_ = max(t, 1), max(lt, 1), max(lc, 1)
        plain = max(c - lc, 1)
        base = math.log(c / plain * lc + share * c + math.e)
        value = c / lc_ * t / lt_
        # without any link on the page the base is 1: natural logarithm instead
        out.append(c / t * math.log(max(value, 1.0)) / (math.log(base) if base > 1 + 1e-9 else 1.0))
    return out


def _best_inside(page: _Page, sums: list[float], dropped: list[bool]) -> list[int]:
    """Per element the element of the greatest density sum inside it (itself included); the
    outermost of equals."""
    best = list(range(len(sums)))
    worth = lambda node: -1.0 if page.tag[node] in _INLINE else sums[node]
    for node in range(len(sums) - 1, 0, -1):
        if not dropped[node]:
            p = page.parent[node]
            if worth(best[node]) > worth(best[p]):
                best[p] = best[node]
    return best


_RESULT = "page_id bigint, url string, text string, n_chars bigint"
_RESULT_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [main_text(x.as_py()) for x in b.column("html")]
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array(found, pa.string()),
             pa.array([len(x) for x in found], pa.int64())], schema=_RESULT_ARROW)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.  Null or empty html: empty
    text.  Repeated rows and null ids are rows like any other."""
    python_ready(pages.sparkSession)
    rows = first_columns(pages, page_id=id_col, url=url_col, html=html_col)
    return rows.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_text_rows, _RESULT)
