"""Multiset fingerprints and URL rules (DataFrame operations only)."""

import hashlib

import pytest
from pyspark.sql import functions as F

from terrascope.llm import fingerprint as fp
from terrascope.llm import url_filter
from terrascope.llm.queries import URL_RULES
from tests.llm.frames import edge_docs, edge_rows, empty_docs, saved, sentence


def prints(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = fp.fingerprints(df, ["k"], "t")
    return {r.k: (list(r.exact), list(r.sketch), r.n) for r in got.collect()}


def test_order_does_not_matter_and_counts_do(spark):
    a, b, c = (sentence(i, 12) for i in range(3))
    got = prints(spark, [f"{a}\n{b}\n{c}", f"{c}\n{a}\n\n{b}", f"{a}\n{b}\n{c}\n{c}", "", None, a])
    assert got[0] == got[1] and got[0] != got[2]
    assert got[3] == got[4] == ([0] * fp.EXACT, [0] * fp.SKETCH, 0)


def test_insertion_and_deletion(spark):
    a, b = "\n".join(sentence(i, 30) for i in range(4)), "\n".join(sentence(i, 30) for i in range(9, 12))
    df = spark.createDataFrame([(0, a), (1, b), (2, a + "\n" + b)], "k long, t string")
    rows = fp.fingerprints(df, ["k"], "t")
    f = {k: rows.where(F.col("k") == k).select(F.struct("exact", "sketch", "n").alias(f"f{k}")) for k in range(3)}
    one = f[0].join(f[1], F.lit(True)).join(f[2], F.lit(True))

    def lanes(k):
        return {x: F.col(f"f{k}.{x}") for x in ("exact", "sketch", "n")}
    plus, minus = fp.combine(lanes(0), lanes(1)), fp.combine(lanes(2), lanes(1), -1)
    got = one.select(*[(plus[x] == lanes(2)[x]).alias(f"p{x}") for x in plus],
                     *[(minus[x] == lanes(0)[x]).alias(f"m{x}") for x in minus]).first()
    assert all(got)


def test_edit_report(spark, tmpdir_run):
    docs = saved(edge_docs(spark), tmpdir_run + "/docs")
    got = fp.edit_report(docs).collect()
    assert len(got) == len(edge_rows())
    unique = [(i, t or "") for i, t, *_ in edge_rows() if i is not None]
    order = sorted(unique, key=lambda r: r[0])
    after = {i: order[(k + 1) % len(order)][1] for k, (i, _) in enumerate(order)}
    for r in got:
        if r.id in (None, 7, 16):  # repeated or null ids leave the successor open
            continue
        text = dict(order)[r.id]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[r.id][:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by = {r.id: r for r in got}
    assert by[5].fingerprint == by[6].fingerprint and by[5].near_next == 1.0
    assert by[2].fingerprint == by[3].fingerprint
    assert fp.edit_report(empty_docs(spark)).count() == 0


def test_likeness_follows_the_share(spark):
    parts = [sentence(100 + i, 20) for i in range(40)]
    texts = ["\n".join(parts)] + ["\n".join(parts[:k] + [sentence(500 + k * 50 + i, 20) for i in range(40 - k)]) for k in (0, 10, 20, 30)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    rows = fp.fingerprints(df, ["k"], "t").select("k", F.struct("exact", "sketch", "n").alias("f"))
    pair = rows.alias("a").join(rows.where("k = 0").select(F.col("f").alias("g")), F.lit(True))

    def lanes(c):
        return {x: F.col(f"{c}.{x}") for x in ("exact", "sketch", "n")}
    got = {r.k: r.v for r in pair.select("k", fp.likeness(lanes("f"), lanes("g")).alias("v")).collect()}
    assert got[0] == 1.0
    for k, share in ((1, 0.0), (2, 0.25), (3, 0.5), (4, 0.75)):
        assert abs(got[k] - share) < 0.3


URLS = ["http://example.com/en/a", "https://WWW.Example.com/en/x?y=/de/", "http://a.b.net/es/1", "http://net/fr/", "http://xnet/fr/",
        "http://www.example.com/de/", "http://a.www.example.com/en/", "http://example.com", "http://example.com?q=/en/",
        "no scheme", "", None, "a://b://c.com/x", "http://example.com:80/en/", "http://example.com/EN/", "http:///en/", "ftp://u.com/",
        "http://net/es", "http://x.net/es/" + "y/" * 3000,
        "http://" + "a." * 50_000 + "net/es/" + "y/" * 200_000 + "z" * 300_000]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut].lower(), rest[cut:]
    path = tail[:min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    fit = []
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fit.append((len(rule), len(h), verdict == "block", rule, verdict))
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("limit", [200_000, 0])
def test_url_rules(spark, tmpdir_run, limit):
    rules = URL_RULES + [("block", "u.com/"), ("allow", "example.com/en")]
    df = spark.createDataFrame([(i % 17, u, "clash", 1) for i, u in enumerate(URLS * 2)], "page_id int, url string, host string, id int")
    got = url_filter.judge(saved(df, tmpdir_run + f"/urls{limit}"), url_filter.rules_frame(spark, rules), max_broadcast_rules=limit)
    want = [(i % 17, *brute(u, rules)) for i, u in enumerate(URLS * 2)]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert url_filter.judge(df.limit(0), url_filter.rules_frame(spark, rules)).count() == 0


def test_no_python_in_plans(spark):
    docs = edge_docs(spark)
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    for df in (fp.edit_report(docs), url_filter.judge(pages, url_filter.rules_frame(spark, URL_RULES))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow", "Cartesian", "NestedLoop"))


def test_likeness_of_long_repetitive_texts(spark):
    line = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(0, "\n".join([line] * 5000)), (1, "\n".join([line] * 2500))], "k int, t string")
    rows = fp.fingerprints(df, ["k"], "t").select("k", F.struct("exact", "sketch", "n").alias("f"))
    both = rows.where("k = 0").select(F.col("f").alias("a")).crossJoin(rows.where("k = 1").select(F.col("f").alias("b")))
    a, b = ({x: F.col(f"{c}.{x}") for x in ("exact", "sketch", "n")} for c in "ab")
    assert both.select(fp.likeness(a, b).alias("v")).first().v == pytest.approx(0.8)
