"""Main text of pages: the tree recomputed in plain Python, markup cases, sites made for the purpose."""

import html
import math
import random
import re
from collections import defaultdict

import pytest

from tessera.llm import html_text
from tessera.llm.common import table
from tessera.llm.html_text import Page

SCHEMA = "page_id long, url string, html string"


def article(page: str) -> str:
    """The article of a page as the test tables have it: flat paragraphs in one article element."""
    inside = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside))
    return "\n\n".join(x for x in blocks if x)


def importance(pages):
    """(host, node) -> importance of (host, html) pages."""
    seen, info = defaultdict(lambda: defaultdict(set)), {}
    for k, (host, text) in enumerate(dict.fromkeys(pages)):
        for node, parent, kind, feature, chars, linked, named in Page(text).facts():
            seen[host, node][kind, feature].add(k)
            if kind == 1:
                old = info.get((host, node), (parent, 0, 0, False))
                info[host, node] = (parent, old[1] + chars, old[2] + linked, old[3] or named)
    m = {n: len(set().union(*f.values())) for n, f in seen.items()}
    entropy = lambda node, kind: [math.log(len(v)) / math.log(m[node]) if m[node] > 1 else 0.0 for (k, _), v in seen[node].items() if k == kind]

    def presentation(node):
        if node not in seen:
            return None
        if m[node] == 1:
            return 1.0
        shares = [len(v) / m[node] for (k, _), v in seen[node].items() if k == 1]
        return -sum(p * math.log(p) for p in shares) / math.log(m[node])

    out = {}
    for node, (parent, chars, linked, named) in info.items():
        texts = entropy(node, 0)
        if texts:
            own, around = presentation(node), presentation((node[0], parent))
            mean = (1 - sum(texts) / len(texts) + own + (own if around is None else around)) / 3
            out[node] = (m[node] * mean + 4) / (m[node] + 4) * (0.2 if named or linked >= 0.8 * chars else 1.0)
    return out


def test_tree_is_the_plain_one(spark, sf):
    pages = table(spark, sf, "pages")
    rows = html_text.parsed(pages)
    got = {(r["host"], r["node"]): r["importance"] for r in html_text.style_tree(rows).collect()}
    want = importance([(re.match(r"https?://([^/?#:]*)", r["url"])[1].lower(), r["html"]) for r in pages.collect()])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_articles_of_all_pages(spark, sf):
    got = {r["page_id"]: r for r in html_text.op11_html_text(spark, sf).collect()}
    for r in table(spark, sf, "pages").collect():
        assert got[r["page_id"]]["text"] == article(r["html"]) and got[r["page_id"]]["n_chars"] == len(article(r["html"]))
        assert got[r["page_id"]]["url"] == r["url"]


@pytest.mark.parametrize(
    "page, blocks",
    [
        ("", []),
        ("plain  text\n here", ["plain text here"]),
        ("<p>a<p>b<br>c &amp; d&#233;&nbsp;e</p>f", ["a", "b c & dé e", "f"]),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", ["a", "b", "c"]),
        ("<p><b>a<br><p>b</b> c</p></p>d", ["a", "b c", "d"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("a<!-- <p>no</p> -->b<![CDATA[x]]>c<?x?>d", ["abcd"]),
        ('<script>if (a<b) "</p>"</script>x<style>p{}</style>y<title>t</title>', ["xy"]),
        ('<a title="1 > 2">x</a> y < z &lt;p&gt;', ["x y < z <p>"]),
        ("<div title='it''s'>a</div><p class=x>b", ["a", "b"]),
        ("<p>a <i>b</i><em>c</em> d", ["a bc d"]),
        ("a<div", ["a"]),
        ("a<!-- never closed <p>b", ["a"]),
        ("<script>never closed", []),
        ("</p></div>a</body>b", ["a", "b"]),
        ("<pre>a\n  b</pre>", ["a b"]),
        ("<P>A</P><DIV>B</DIV>", ["A", "B"]),
        ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]),
    ],
)
def test_blocks_as_browsers_read_them(page, blocks):
    assert [b[2] for b in Page(page).blocks] == blocks


def kept(spark, pages, **how):
    rows = [(i, url, text) for i, (url, text) in enumerate(pages)]
    return [r["text"] for r in html_text.extract(spark.createDataFrame(rows, SCHEMA).repartition(3), **how).orderBy("page_id").collect()]


def test_names_in_the_markup(spark):
    page = (
        "<body class='has-sidebar'><header>head</header><div role=navigation>menu</div><div class='cookie-notice'>we bake</div><main><h1>T</h1><header>sub</header>"
        "<p>one <span class='ad'>buy</span>two</p><div class='adContainer'>ad</div><form>f<button>b</button></form><div hidden>h</div><div style='display: none'>n</div>"
        "<section id=comments><article class=comment>me too</article></section><p class='shadow address'>three</p></main><div id=sidebar>side</div><p>beside</p><aside>a</aside><footer>f</footer></body>"
    )
    assert kept(spark, [("http://x.y/1", page)]) == ["T\n\nsub\n\none two\n\nthree"]
    flags = "<div class='post comments-open no-sidebar'><article class='entry comments-closed' id='with-ads'><p>text</p></article></div>"
    assert kept(spark, [("http://x.y/2", flags)]) == ["text"]


@pytest.mark.parametrize("bound", [0, 200_000])
def test_a_site_without_names(spark, monkeypatch, bound):
    """Blocks that a template repeats go, what pages say themselves stays, whether or not there is room to send the removed nodes everywhere."""
    monkeypatch.setattr(html_text, "BROADCAST_NODES", bound)
    r = random.Random(1)
    say = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(30))
    pages, want = [], []
    for i in range(60):
        text = [say() for _ in range(r.randrange(1, 9))]
        body = "".join(f"<p>{t}</p>" for t in text)
        pages.append((f"http://Site.example:80/{i}", f"<div class=t1>All our offers</div><div class=t2><ul>{''.join(f'<li><a href=/{j}>{say()}</a>' for j in range(5))}</ul></div><div class=t3><h1>Title {i}</h1>{body}</div><div class=t4><span>Made with care</span> since 1999</div>"))
        want.append("\n\n".join([f"Title {i}", *text]))
    pages += [pages[0]] * 300 + [("http://other.example", pages[0][1]), (None, pages[0][1]), ("nohost", pages[1][1])]
    got = kept(spark, pages)
    assert got[:360] == want + [want[0]] * 300
    alone = lambda text: "All our offers\n\n" + text + "\n\nMade with care since 1999"
    assert got[360:] == [alone(want[0]), alone(want[0]), alone(want[1])]


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "http://a.b/", ""), (1, "http://a.b/", None), (2, "http://a.b/x", "<p>" + "long word " * 200000), (2, "http://a.b/x", "<div>" * 3000 + "deep"), (3, "", "<p>a")]
    d = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA + ", host int, `row` string, `a.b` string").repartition(2)
    got = html_text.extract(d)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted(len(r["text"]) for r in got.collect()) == [0, 0, 0, 1, 4, 1999999]
    assert html_text.extract(d.limit(0)).count() == 0
