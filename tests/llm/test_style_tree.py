"""Main text of pages by site style trees."""

import html
import math
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from terrascope.llm import style_tree as st
from tests.conftest import SF_SMALL

WORDS = "river stone light under over quick brown fox".split()
SCHEMA = "page_id long, url string, html string, id string, text string, row int, removed int, part int"


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 99)) for _ in range(n))


@pytest.mark.parametrize("source, text", [
    ("<body><nav>menu</nav><article><h1>T&eacute;st</h1><p>One<p>Two\n  lines<br>more</article><footer>f</footer>", "Tést\nOne\nTwo lines more"),
    ("<form id=f><article><header><h1>T</h1></header>foo <b>b</b>ar&nbsp;&#65;<ul><li>x<li>y</ul><footer>f</footer>"
     "<aside>z</aside></article></form><p>other", "T\nfoo bar A\nx\ny"),
    ("text < 5 & <3 <!-- c --> more <!-- unclosed", "text < 5 & <3 more"),
    ("<table><tr><td>a<td>b<tr><td>c</table>tail<script>x=\"</p>\"</script >z<p title=\"a>b\">q</p>", "a\nb\nc\ntailz\nq"),
    ("<p>a <button>no</button> b <select><option>1</select> c<p class=\"x", "a b c"),
    ("<div class=\"has-sidebar\"><main><h1>H</h1><div class=\"share\">s</div><p>x</main></div><p>out", "H\nx"),
    ("<b><p>x</b>y</p><i class=\"ad\">z<i>w</i>v</i>ok<", "xy\nok<"),
    ("<ARTICLE><P>a<DIV CLASS='AD'>no</DIV>b</P><section class=comments><article>c</article></section></ARTICLE>", "a\nb"),
    ("<div class=post-content><p>a</p><div id=cookieNotice>no</div></div><p>out</p>", "a"),
    ("<style>p{}</style><title>t</title><p>&lt;b&gt; &amp;amp; &am &amp", "<b> &amp; &am &"),
    ("", ""), ("<div class=ad>only</div>", ""), ("<p a='b>c</p><p>d", "c\nd"),
])
def test_text_of_a_page(source, text):
    assert st.Page(source).text() == text


def test_long_deep_and_broken_pages():
    assert st.Page("<div>" * 30_000 + "x" + "</div>" * 30_000 + "<p>y").text() == "x\ny"
    assert st.Page("<article>" + "<p>w" * 50_000).text().count("\n") == 49_999
    assert st.Page("<" * 50_000 + "</" * 50_000).text().startswith("<<")
    assert st.Page("<li><p>a" * 20_000).text().count("a") == 20_000


def site(i, rnd, host):
    art = "".join(f"<p>{sentence(rnd, 12)}</p>" for _ in range(2 + i % 7))
    note = '<div class="q"><p>We keep this short.</p><p>Ask us.</p></div>' if i % 2 else ""
    body = (f'<div class="t1"><a href=/>Start page</a> <a>All topics</a></div><div class="k{i}">{art}{note}</div>'
            f"<div class=b9><p>All rights kept.</p></div>{'<p>' + sentence(rnd, 3) if i % 5 == 0 else ''}")
    return (i, f"http://{host}/{i}", body)


def plain_removals(pages):
    """Branches to remove by plain code: trees of dictionaries, one site at a time."""
    sites = {}
    for i, url, source in pages:
        m = re.match(r"^.*?://([^/?#]*)", url or "")
        sites.setdefault(m.group(1).lower() if m else "", []).append((i, st.Page(source or "")))
    out = {}
    for some in sites.values():
        seen = {}
        for _, page in some:
            for path, mark in {(p[3], p[4]) for p in page.parts()}:
                seen.setdefault(path, Counter())[mark] += 1
        pages_of = {path: 0 for path in seen}
        for _, page in some:
            for path in {p[3] for p in page.parts()}:
                pages_of[path] += 1
        for i, page in some:
            rows = []
            for part, up, leaf, path, mark in page.parts():
                base = math.log(pages_of[path] + 2)
                if leaf:
                    value = 1 - math.log(seen[path][mark]) / base
                else:
                    total = sum(seen[path].values())
                    value = -sum(k / total * math.log(k / total) for k in seen[path].values()) / base
                rows.append((part, up, leaf, value, len(seen[path])))

            def importance(part):
                mine = [r for r in rows if r[0] == part]
                if mine[0][2]:
                    return sum(r[3] for r in mine) / len(mine)
                below = sorted({r[0] for r in rows if r[1] == part})
                damp = 0.9 ** mine[0][4]
                return (1 - damp) * mine[0][3] + damp * sum(map(importance, below)) / len(below)

            def noisy(part):
                return importance(part) < 0.3 and all(noisy(r[0]) for r in rows if r[1] == part)
            gone, todo = [], [-1] if rows and not all(noisy(r[0]) for r in rows if r[2]) else []
            while todo:
                part = todo.pop()
                if noisy(part):
                    gone.append(part)
                else:
                    todo += {r[0] for r in rows if r[1] == part}
            out[i] = page.text(sorted(gone))
    return out


@pytest.mark.parametrize("hot_keys", [st.HOT_KEYS, 4])
def test_style_tree_is_that_of_plain_code(spark, hot_keys):
    rnd = random.Random(5)
    pages = [site(i, rnd, ["one.example.com", "ONE.example.com", "two.example.org"][i % 3]) for i in range(45)]
    pages += [(100, None, pages[0][2]), (101, "no host", pages[1][2]), (102, "http://three/", pages[2][2]),
              (103, "http://four/", pages[3][2]), (104, "http://four/", pages[3][2]), (105, "http://one.example.com/", None)]
    frame = spark.createDataFrame([(*p, "x", "y", 1, 2, 3) for p in pages], SCHEMA).repartition(4)
    got = {r.id: r for r in st.extract(frame, hot_keys=hot_keys).collect()}
    want = plain_removals(pages)
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[105].text == ""
    for i in range(45):
        text = got[i].text
        assert "Start page" not in text and "All rights" not in text and got[i].removed >= 2
        assert len(text.split("\n")) >= 2 + i % 7      # every paragraph of the article
    # a page of its own site, and two alike, prove no template
    assert all("Start page" in got[i].text for i in (102, 103, 104))


def test_copies_keep_their_article(spark):
    rnd = random.Random(6)
    art = "".join(f"<p>{sentence(rnd, 12)}</p>" for _ in range(5))
    named = [(i, "http://h/", f"<div class=x>Same on all</div><article>{art}</article>") for i in range(30)]
    bare = [(100 + i, "http://g/", f"<div class=x>Same on all</div><div class=c>{art}</div>") for i in range(30)]
    frame = spark.createDataFrame(named + bare + [named[0]], "page_id long, url string, html string")
    got = st.extract(frame).collect()
    assert len(got) == 61
    assert all(len(r.text.split("\n")) == 5 for r in got if r.id < 100)
    # alike as a whole: nothing tells its parts apart, so nothing is removed
    assert all(len(r.text.split("\n")) == 6 for r in got if r.id >= 100)


def test_empty_table(spark):
    out = st.extract(spark.createDataFrame([], SCHEMA))
    assert out.columns == ["id", "url", "text", "n_chars", "removed"] and out.count() == 0


def test_registered_query_gives_the_articles(spark):
    from terrascope.llm.queries import op11_style_tree
    got = {r.page_id: r for r in op11_style_tree(spark, SF_SMALL).collect()}
    rows = pq.read_table(f"{SF_SMALL}/pages.parquet").to_pylist()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S).group(1)
        parts = re.split(r"<p>|</p>|<h1>|</h1>", re.sub(r"<[^>]*$", "", re.sub(r"</?b>", "", inner).replace("<br>", " ")))
        blocks = (" ".join(html.unescape(x).split()) for x in parts)
        assert got[r["page_id"]].text == "\n".join(b for b in blocks if b)


def test_pages_that_name_their_article_go_through_the_tree(spark):
    rnd = random.Random(7)
    menu, notice = "<nav><a>Start</a></nav>", "<div class=q><div><p>We keep this short.</p></div>Ask us.</div>"

    def page(art, tail=""):
        return f"{menu}<article><h1>Same title</h1>{art}{notice}<div class=c>{sentence(rnd, 9)}</div></article>{tail}"
    arts = ["".join(f"<p>{sentence(rnd, 12)}</p>" for _ in range(3)) + "<p>One line for all.</p>" for _ in range(20)]
    rows = [(i, "http://h/", page(a, "<div>beside</div>" if i % 2 else "")) for i, a in enumerate(arts)]
    # the same article on all pages of a host is no template
    rows += [(100 + i, "http://g/", f"<article><h1>T {i}</h1>{arts[0]}<div class=d>{arts[1]}</div></article>") for i in range(20)]
    # a page without a named article learns from the named ones of its host
    rows += [(200, "http://h/", f"<div class=k><p>{sentence(rnd, 12)}</p></div>{menu}")]
    got = {r.id: r for r in st.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, a in enumerate(arts):
        lines = got[i].text.split("\n")
        assert lines[:-1] == ["Same title", *re.findall("<p>(.*?)</p>", a)] and got[i].removed == 1
    assert all(len(got[100 + i].text.split("\n")) == 9 and got[100 + i].removed == 0 for i in range(20))
    assert len(got[200].text.split("\n")) == 1

    one = st.Page(rows[1][2])
    leaves = {p[0]: p for p in one.parts() if p[2]}
    assert sorted(one.weight[p] for p in leaves) == [0, 0, 2, 2, 3, 3, 3]
