import re
import time
from collections import Counter, defaultdict

import pytest

from cohortry.llm import html_template as T
from cohortry.llm.html_template import Page, equivalence_classes, extract_text, templates

SHELL = (
    '<!DOCTYPE html><html><head><title>T {k}</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body>'
    '<nav><ul><li><a href="/">Home {k}</a></li></ul></nav><!-- note --><div class="ad">Buy {k}</div>'
    "<div id=wrap><div class='post-body'><h1>Title {k} &amp; more</h1><p>First <b>bold</b>\n  text{k}&nbsp;here<br>line<p>Second {k}"
    "<form>Your mail<input></form><aside>Side</aside><ul><li>one {k}<li>two</ul></div></div>"
    '<section id="comments-3"><p>I think {k}</p></section><footer>&copy; site</footer></body></html>'
)
WANT = "Title {k} & more\nFirst bold text{k} here line\nSecond {k}\none {k}\ntwo"


def test_article_is_cut_from_the_template(rows):
    pages = rows(
        "page_id long, url string, html string, host string, main int",
        *((k, f"https://h.example/{k}", SHELL.format(k=k), "x", 0) for k in range(8)),
        (100, "http://single.example/", SHELL.format(k=100), "x", 0),
    )
    got = {r.page_id: r for r in extract_text(pages).collect()}
    for k, r in got.items():
        assert r.text == WANT.format(k=k) and r.n_chars == len(r.text)


def test_classes_share_their_vector_and_nest(rows):
    pages = rows("host string, html string", *(("h", SHELL.format(k=k)) for k in range(5)), ("h", SHELL.format(k=0)))
    found = equivalence_classes(pages)
    frame = [r for r in found.collect() if r.wording == 0 and r.path in ("", ">html", ">html>body", ">html>body>nav")]
    assert len({r.vector for r in frame}) == 1 and all(r.pages == r.occurrences == 5 for r in frame)
    lists = {r.vector for r in found.collect() if r.wording == 0 and r.path.endswith(">li")}
    assert len(lists) == 2  # once in the menu, twice in the article
    main = templates(found).collect()
    assert [(r.host, r.main) for r in main] == [("h", ">html>body>div.wrap>div.post-body")]


def test_edge_rows(rows, spark):
    pages = rows(
        "page_id long, url string, html string",
        (1, None, None), (2, "u", ""), (3, "u", "plain &lt;text&gt; only"), (3, "u", "plain &lt;text&gt; only"),
        (None, "http://x.example", "<p>a<p>b"), (4, "::bad", "<div><p>cut <b>off here"), (5, "u", "<p>" + "word " * 200_000),
        (6, "u", "<script>never ends <p>x"), (7, "u", "a < b and <3 > c"), (8, "u", '<p title="a > b">quoted</p><p x="open>y</p>'),
    )
    got = sorted(((str(r.page_id), r.text[:30], r.n_chars) for r in extract_text(pages).collect()))
    assert [g for g in got if g[0] != "8"] == [
        ("1", "", 0), ("2", "", 0), ("3", "plain <text> only", 17), ("3", "plain <text> only", 17), ("4", "cut off here", 12),
        ("5", ("word " * 6)[:30], 999_999), ("6", "", 0), ("7", "a < b and <3 > c", 16), ("None", "a\nb", 3),
    ]
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_unclosed_and_misnested_elements():
    assert Page("<article><p>a<div>b</p>c</div>d</article>").text(None) == "a\nb\nc\nd"
    assert Page("<body><main><table><tr><td>1<td>2<tr><td>3</table>end</main><div class='sidebar-left'>s").text(None) == "1\n2\n3\nend"


def test_documents_of_the_test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r, html in zip(*(sorted(x, key=lambda r: r.page_id) for x in (extract_text(pages).collect(), pages.collect())), strict=True):
        assert r.text and "track(" not in r.text and "&copy;" not in r.text
        article = html.html.split("<article>")[1].split("</article>")[0]
        assert r.text.count("\n") <= article.count("<p>") + 1


ARTICLE_TEXT = "<p>Story {k} tells at length of matter {k}, which no other page has.</p><p>It ends {k} times, and for good.</p>"


def extracted(rows, *pages):
    got = extract_text(rows("page_id long, url string, html string", *((k, "http://h.example/x", html) for k, html in enumerate(pages))))
    return {r.page_id: r.text for r in got.collect()}


def test_template_texts_in_the_slot_are_cut(rows):
    shell = "<body><div class=post>{often}<div class='x1'>Read our offer</div>{text}<h4>Ask us.</h4></div></body>"
    often = "<section class=x2><p>Now in colour</p></section>"  # on seven of ten pages
    pages = [shell.format(often=often if k < 7 else "", text=ARTICLE_TEXT.format(k=k)) for k in range(10)]
    for k, text in extracted(rows, *pages).items():
        assert text == f"Story {k} tells at length of matter {k}, which no other page has.\nIt ends {k} times, and for good."


def test_copies_of_an_article_stay_whole(rows):
    shell = "<body><nav>{n}</nav><article><h1>T</h1>{text}</article></body>"
    copies = [shell.format(n=n, text=ARTICLE_TEXT.format(k=0)) for n in range(4)]
    whole = Page(copies[0]).text(None)
    assert whole.count("\n") == 2 and set(extracted(rows, *copies).values()) == {whole}
    assert extracted(rows, *copies[:2], shell.format(n=9, text=ARTICLE_TEXT.format(k=9)).replace("<h1>T</h1>", ""))[0] == whole
    others = [shell.format(n=k, text=ARTICLE_TEXT.format(k=k)).replace("<h1>T</h1>", f"<h1>T {k}</h1>") for k in (7, 8)]
    assert extracted(rows, *copies, *others)[0] == whole


def test_wrappers_are_not_apart(rows):
    names = [
        "<body class='has-sidebar'>{}", "<body class='no-comments'>{}", "<article class='social-policy'>{}</article>",
        "<form id=aspnetForm>{}</form>", "<div class='sidebar wide'><form class=page>{}</form></div><footer>Imprint</footer>",
        "<main role=search>{}</main><div class=comments><p>Fine.</p></div>",
    ]
    inner = "<nav>Home</nav><div class=post>{}</div><div class=ad>Buy</div>".format(ARTICLE_TEXT.format(k=1))
    want = Page(ARTICLE_TEXT.format(k=1)).text(None)
    for k, name in enumerate(names):
        assert Page(name.format(inner)).text(None) == want, name
        single = rows("page_id long, url string, html string", *((j, f"http://h{k}.example/", name.format(inner.replace("1", str(j)))) for j in range(4)))
        assert all(f"matter {r.page_id}," in r.text and "Buy" not in r.text and "Home" not in r.text for r in extract_text(single).collect())


def test_long_comments_stay_apart():
    page = "<body><div class=post>" + ARTICLE_TEXT.format(k=1) + "</div><div class=comments>" + "<p>I think so too.</p>" * 20 + "</div>"
    assert Page(page).text(None) == Page(ARTICLE_TEXT.format(k=1)).text(None)


BROKEN = {
    "quoted attributes cut off": "<p>a</p><img " + 'a="b" ' * 200,
    "open quotes": "<a " + '"' * 3000,
    "tags without an end": "<p>x" + "<x " * 100_000,
    "nested": "<div>" * 50_000 + "<p>t",
    "nested and closed": "<div>" * 50_000 + "t" + "</div>" * 50_000,
    "nested menus": "<nav>" * 50_000 + "x",
    "cells below a deep nest": "<tr>" + "<div>" * 30_000 + "<td>x</td>" * 30_000,
    "closed scripts": "<script/>" * 50_000,
    "scripts without an end": "<script>" + "</script " * 50_000,
    "quotes that hide the end": "<b x=\"'>" * 50_000 + "<i '",
    "comments without an end": "<!--" * 100_000,
    "declarations without an end": "<!" * 100_000,
    "a long class": "<div class='" + "k " * 200_000 + "'>" + "<p>x</p>" * 20_000,
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_pages_take_linear_time(name):
    start = time.perf_counter()
    page = Page(BROKEN[name])
    page.main_path(), page.text(None)
    assert time.perf_counter() - start < 5


def test_quotes_in_tags():
    assert Page('<p title="a > b" x=\'c>\'>text</p>').text(None) == "text"
    assert Page('<p title="a > b>text</p>').text(None) == "b>text"  # the quote is never closed
    assert Page("<p>a < b <c").text(None) == "a < b <c"


def test_depth_and_labels():
    deep = Page("<div>" * 200 + "<p>in</p>" + "</div>" * 200 + "<p>out</p>")
    assert [t for _, t, _ in deep.blocks] == ["in", "out"] and max(p.count(">") for p in deep.opened) == T.MAX_DEPTH
    assert deep.blocks[1][0] == ">p"
    labels = Page(f"<div class='{'a' * 500}'><p>x</p></div>").opened
    assert max(map(len, labels)) < 2 * T.MAX_LABEL


def directly(pages):
    """Main path and template texts of each host, from all tokens of its pages."""
    hosts = defaultdict(dict)
    for url, html in pages:
        found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", url or "")
        hosts[found[1].lower() if found else ""][html or ""] = Page(html or "")
    out = {}
    for host, own in hosts.items():
        if len(own) < T.LEAST_PAGES:
            out[host] = (None, frozenset())
            continue
        seen, volume = defaultdict(dict), Counter()
        for html, page in own.items():
            for path, n in {"": 1, **page.opened}.items():
                seen[path, None][html] = n
            for path, n in page.volume().items():
                volume[path] += n
            for (path, text), n in Counter((p, t) for p, t, apart in page.blocks if not apart).items():
                seen[path, text][html] = n
        valid = {k: v for k, v in seen.items() if len(v) >= T.COVER * len(own) and len(v) > (k[1] is not None)}
        fixed = Counter()
        for (path, text), on in valid.items():
            steps = path.split(">")
            for k in range(1, len(steps) + 1) if text is not None else ():
                fixed[">".join(steps[:k])] += len(text) * sum(on.values())
        whole = volume[""] - fixed[""]
        slots = []
        for (path, text), on in valid.items():
            varying = volume[path] - fixed[path]
            if text is None and sum(on.values()) == len(on) and varying >= T.MAIN_SHARE * whole and varying > 0 and not re.search(T.LEAF, path):
                kinds = (bool(re.search(T.ARTICLE, path)), bool(re.search(T.MAIN, path)), len(path.split(">")), path.encode())
                slots.append((*kinds, varying < (1 - T.MAIN_SHARE) * volume[path]))
        if not slots:
            out[host] = (None, frozenset())
            continue
        *_, main, copies = max(slots)
        nested = {(path, tuple(sorted(on.items()))) for (path, text), on in valid.items() if text is None and len(on) >= T.LEAST_PAGES}
        texts = {(p, t) for (p, t), on in valid.items() if t is not None and (p, tuple(sorted(on.items()))) in nested}
        out[host] = (main.decode(), frozenset() if copies else frozenset(T.text_token(p, t) for p, t in texts))
    return out


def test_template_deduction_equals_the_definition(spark):
    """All pages of the test table: template and text, derived token by token without Spark."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    wanted = directly([(u, h) for _, u, h in rows])
    assert sum(main is not None for main, _ in wanted.values()) > 0
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    for page_id, url, html in rows:
        found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", url or "")
        assert got[page_id] == Page(html or "").text(*wanted[found[1].lower() if found else ""])
