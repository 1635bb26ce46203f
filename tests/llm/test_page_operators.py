"""URL filters and HTML extraction."""

import random
import re
from collections import Counter

import pytest

from tidewatch.llm import html_text, url_rules
from tidewatch.llm import queries as Q
from tidewatch.testing import compare, duckdb_connect

SMALL = "/root/testdata/sf0.001"

URLS = [None, "", "no scheme", "http://", "http://a.NET", "http://a.net/", "HTTP://Example.NET/en/x?y#z", "x://example.net/EN/",
        "http://sub.example.net/en/1", "http://notexample.net/en/1", "http://example.com/de/1", "http://org/fr/9",
        "http://a.b.org/fr/", "http://a.org/fr", "http://a.org?fr/", "http://a.org#/fr/", "http://x.com/?u=http://b.net/",
        "http://casino-win.example.com/a", "http://casino-win.example.net/en/a", "http://x.com/login", "http://x.com/loginx",
        "http://x.com/a/signin.html", "http://ÄÖ.net/ß", "http://a.net/\nnewline", "http://user@b.net:80/x"]


def brute(url, rules, patterns):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url[url.index("://") + 3:])
        host = re.sub("[A-Z]", lambda x: x[0].lower(), m[1])
        path = m[2]
    best = None
    for text, verdict in rules:
        h, p = text.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = max(best or (0,), (len(text), text, verdict))
    if best:
        return host, path, best[1], best[2], None
    hit = max(((len(r.name), r.name, r.verdict) for r in patterns if re.search(r.pattern, host + path)), default=None)
    return (host, path, None, hit[2], hit[1]) if hit else (host, path, None, "allow", None)


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"),
         ("x.com/log", "block"), ("com/", "allow")]


@pytest.mark.parametrize("every", [False, True])
def test_urls_equal_brute_force(spark, every):
    rng = random.Random(2)
    urls = URLS + [f"http://{rng.choice(['a.', 'www.', ''])}{rng.choice(['example', 'x', 'spam-farm.q'])}."
                   f"{rng.choice(['net', 'org', 'com', 'de'])}/{rng.choice(['en', 'de', 'fr', 'cart'])}/{rng.randint(0, 9)}" for _ in range(200)]
    patterns = list(url_rules.SITE_RULES) + ([url_rules.pattern_rule("digit at end", "block", "9$")] if every else [])
    rows = list(enumerate(urls)) + [(0, None), (7, urls[7]), (None, urls[8])]
    pages = spark.createDataFrame([(i, u, "t", "h") for i, u in rows], "page_id long, url string, token string, host string")
    out = url_rules.judge_urls(pages, [url_rules.prefix_rule(*r) for r in RULES], patterns).collect()
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict, r.pattern) for r in out)
    assert got == Counter((i, *brute(u, RULES, patterns)) for i, u in rows)
    assert url_rules.judge_urls(pages.limit(0), [url_rules.prefix_rule(*RULES[0])], []).count() == 0
    assert {r.verdict for r in url_rules.judge_urls(pages, [], []).collect()} == {"allow"}


def test_literals_and_rarest_token(spark):
    assert url_rules.prefix_rule("example.net/en/", "allow").literals == ("example", "net", "en")
    assert url_rules.prefix_rule("x.com/log", "block").literals == ("x", "com")       # "log" may go on
    rules = url_rules._rule_table(spark, [url_rules.prefix_rule("example.net/en/", "allow"), url_rules.prefix_rule("net/", "block")])
    tokens = spark.createDataFrame([("net", 50), ("example", 70), ("en", 50), ("other", 1)], "token string, n_urls long")
    assert {(r.rule, r.token) for r in url_rules.rule_index(rules, tokens).collect()} == {("example.net/en/", "en"), ("net/", "net")}


def test_url_query_equals_oracle(spark):
    r = compare(Q.op3_url_filters(spark, SMALL), duckdb_connect(SMALL), Q.ORACLES["op3_url_filters"])
    assert r["match"], r


def test_url_rules_are_not_run_on_all_pairs(spark):
    plan = Q.op3_url_filters(spark, SMALL)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


PAGE = ("<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<nav><ul><li><a href='/a'>menu one</a><li><a href='/b'>menu two</a></ul></nav><!-- no --><div class='ad'>Buy now.</div>"
        "%s<footer>&copy; foot</footer></body></html>")
LONG = "Some words of a long paragraph that tells the story at some length and goes on. " * 6
CASES = [
    (None, ""), ("", ""), ("plain &lt;text&gt; only", "plain <text> only"), ("<p>unclosed <b>bold", "unclosed bold"),
    (PAGE % f"<article><h1>Head&nbsp;line</h1><p><b>a&eacute;<br><p>{LONG}</p><p>Ok.</p></article>", f"Head line aé {LONG.strip()} Ok."),
    (PAGE % f"<div id='content'><h2>Sub</h2><p>{LONG}</p><ul><li>item <i>o</i>ne<li>two</ul><p>{LONG}</p></div>"
            f"<aside>side</aside><form>Name: <input></form><section class='comments'><article class='comment'>{LONG}{LONG}</article></section>",
     f"Sub {LONG.strip()} item one two {LONG.strip()}"),
    (PAGE % f"<div class='main-sidebar-layout'><h1>A</h1><p>{LONG}</p><p>x<a href='#'>link</a>y</p><div class='sidebar'>s</div>"
            "<div class='cookie-notice'>We use cookies</div></div>", f"A {LONG.strip()} xlinky"),
    (PAGE % f"<article><h1>A</h1><p>{LONG}<script>if (a < b) x('<p>')</script></p><noscript>n</noscript><p>a < b &amp;amp; c</p></article>",
     f"A {LONG.strip()} a < b &amp; c"),
    ("<html><body><nav>only menu</nav><footer>f</footer></body></html>", ""),
    ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"), ("<p>" + "w " * 100_000 + "</p>", ("w " * 100_000).strip()),
    ("</p></div><p>a</span>b</p><", "ab <"), ("<p>a<!-- open", "a"), ("<script>never closed", ""),
]


BODY = f"<p>{LONG}</p><p>Second. {LONG}</p><p>{LONG}</p>"
TEXT = f"{LONG.strip()} Second. {LONG.strip()} {LONG.strip()}"
SEARCH = "<form action='/search'>Search here <input></form>"


def test_article_inside_named_containers():
    """Forms and side-named elements that hold the article stay; those beside it go."""
    widgets = "".join(f"<div class='elementor-widget'><p>{x}</p></div>" for x in (LONG, "Second. " + LONG, LONG))
    for body in (f"<form id='aspnetForm' action='x.aspx'>{BODY}</form>", f"<form><div class='sidebar'>s</div><div>{BODY}</div></form>",
                 f"<h1>A</h1><div class='elementor-widget'>{BODY}</div>", f"<h1>A</h1><div class='content no-sidebar'>{BODY}</div>{SEARCH}",
                 f"<div class='content no-sidebar'>{BODY}</div><div class='sidebar'>side</div>",
                 f"<div class='widget-wrap'>{widgets}</div>", f"<div>{widgets}</div>{SEARCH}",
                 f"<form><main>{BODY}</main></form>{SEARCH}"):
        text = html_text.main_text(PAGE % body)
        assert text.removeprefix("A ") == TEXT, body
    # one article with text: what stands beside it goes however long it is
    for beside in (f"<form>{BODY}</form>", f"<div class='related'>{BODY}</div>"):
        assert html_text.main_text(PAGE % f"<article><p>Short one.</p></article>{beside}") == "Short one."


def test_names_that_only_mention_readers_or_roles():
    """Classes that describe an article, and roles around one, cost it nothing; readers' words go."""
    for body in (f"<article class='post comments-open'>{BODY}</article>", f"<div class='entry no-comments'>{BODY}</div>",
                 f"<main id='replies-off'>{BODY}</main>", f"<div role='dialog'><main>{BODY}</main></div>",
                 f"<div id='comments-closed'><div>{BODY}</div></div>", f"<div class='comments'><main>{BODY}</main></div>",
                 f"<div role='search'><article>{BODY}</article></div>", f"<article class='has-replies post'>{BODY}</article>"):
        assert html_text.main_text(PAGE % body) == TEXT, body
    for readers in ("class='comments'", "id=comments", "class='comment-list box'", "id='disqus_thread'", "class='user-comments'",
                    "class='replies'", "role='complementary'"):
        beside = f"<section {readers}><article class='comment'><p>{LONG}{LONG}{LONG}{LONG}</p></article></section>"
        if "role" in readers:
            beside = f"<div {readers}><p>{LONG}</p></div>"
        for body in (f"<article>{BODY}</article>", f"<div>{BODY}</div>"):
            assert html_text.main_text(PAGE % (body + beside)) == TEXT, (readers, body)
    # a page of nothing else keeps its text
    assert html_text.main_text(f"<body><div class='comments'>{BODY}</div></body>") == TEXT


def test_text_after_the_body_end():
    for page in (f"<html><body><nav>menu</nav></body>{BODY}</html>", f"<html><body><p>x</p></body></html><div>{BODY}</div>",
                 f"<body><div></body><div>{BODY}</div></body></html>"):
        assert html_text.main_text(page).removeprefix("x ") == TEXT, page
    assert html_text.main_text("</body>a</html>b") == "a b"


def test_pages(spark):
    rows = list(enumerate(h for h, _ in CASES)) + [(3, CASES[3][0]), (None, "<p>x</p>")]
    pages = spark.createDataFrame([(i, f"u{i}", h, "clash") for i, h in rows], "page_id long, url string, html string, text string")
    out = html_text.extract(pages).collect()
    want = Counter((i, f"u{i}", CASES[i][1] if i is not None else "x") for i, _ in rows)
    assert Counter((r.page_id, r.url, r.text) for r in out) == want
    assert all(r.n_chars == len(r.text) for r in out)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_article_of_every_page(spark):
    """Template pages: the article element's text, tags as blocks or nothing."""
    import html
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in Q.op10_html_extraction(spark, SMALL).collect():
        article = re.search("<article>(.*?)</article>", source[r.page_id], re.S)[1]
        spaced = re.sub(r"</?(p|h1|br|li|div)\b[^>]*>", " ", article)
        assert r.text == " ".join(html.unescape(re.sub("<[^>]*>", "", spaced)).split())
