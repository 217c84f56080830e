"""Class-based bigram model against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrascope.llm import brown
from tests.llm.frames import edge_docs, empty_docs, saved, sentence

SMALL = dict(classes=6, clustered_words=12, suffix_buckets=16)


def tokens(t):
    return re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) + [None]


def corpus(spark, folder):
    rows = [(i, sentence(i % 7, 20 + i)) for i in range(40)] + [(100, None), (101, "never seen words"), (102, "")]
    return saved(spark.createDataFrame(rows, "doc_id long, text string"), folder)


def test_base_scores_and_counts(spark, tmpdir_run):
    docs = corpus(spark, tmpdir_run + "/docs")
    usable = F.col("doc_id") % 3 != 0
    rows = docs.collect()
    c = Counter(w for r in rows if r.doc_id % 3 for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    for table in (1 << 18, 9, 0):
        model = brown.train(docs, usable, table_words=table, **SMALL)
        assert (model.total, model.kinds) == (n, v) and len(model.table) <= table
        got = {r.id: r for r in brown.score(docs, model).collect()}
        for r in rows:
            t = tokens(r.text)
            base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
            x = got[r.doc_id]
            assert (x.n_tokens, x.n_known) == (len(t), sum(c[w] > 0 for w in t))
            assert x.base_score == pytest.approx(base, rel=1e-9)


def test_model_is_a_distribution_and_score_follows_it(spark, tmpdir_run):
    docs = corpus(spark, tmpdir_run + "/docs")
    m = brown.train(docs, F.lit(True), **SMALL)
    assert np.allclose((10 ** m.trans).sum(axis=1), 1)
    assert m.class_kinds.sum() == m.kinds - 1 and len(m.table) == m.kinds - 1
    for c in range(1, 6):
        mine = m.table_class == c
        if m.class_total[c]:
            mass = ((m.table_count[mine] - m.discount).sum() + m.discount * m.class_kinds[c]) / m.class_total[c]
            assert mass == pytest.approx(1)
    # the document end is alone in its class
    assert not (m.table_class == 0).any() and m.class_total[0] == m.ends


def test_rare_words_by_join_score_like_frequent_ones(spark, tmpdir_run):
    docs = corpus(spark, tmpdir_run + "/docs")
    m = brown.train(docs, F.col("doc_id") != 101, **SMALL)
    order = np.argsort(-m.table_count, kind="stable")
    keep = np.sort(order[:20])
    least = int(m.table_count[keep].min())
    keep = np.flatnonzero(m.table_count >= least)
    cut = brown.Model(**{**m.__dict__, "least": least, "table": m.table[keep], "table_count": m.table_count[keep],
                         "table_class": m.table_class[keep]})
    a = {r.id: r for r in brown.score(docs, m).collect()}
    b = {r.id: r for r in brown.score(docs, cut).collect()}
    for i in a:
        assert a[i].base_score == pytest.approx(b[i].base_score) and a[i].n_known == b[i].n_known
        if len(tokens("")) == a[i].n_tokens:
            assert a[i].score == pytest.approx(b[i].score)


def test_exchange_separates_alternating_classes():
    rng = np.random.default_rng(0)
    pairs = np.zeros((21, 21))
    word = 0
    for i in range(20_000):  # words 1-10 and 11-20 alternate
        nxt = 1 + rng.integers(10) + 10 * (i % 2)
        pairs[word, nxt] += 1
        word = nxt
    cls = brown.exchange(pairs, 3, 10)
    assert cls[0] == 0 and len(set(cls[1:11])) == 1 and len(set(cls[11:])) == 1 and cls[1] != cls[11]


def test_exchange_ends_where_no_single_move_helps():
    rng = np.random.default_rng(3)
    pairs = rng.poisson(2, (30, 30)) * rng.random((30, 30)).round(1)

    def likelihood(cls):
        one = np.eye(5)[cls]
        n = one.T @ pairs @ one
        return sum(s * (x * np.log(np.maximum(x, 1e-300))).sum() for s, x in ((1, n), (-1, n.sum(0)), (-1, n.sum(1))))
    sweeps = [likelihood(brown.exchange(pairs, 5, k)) for k in range(5)]
    assert sweeps == sorted(sweeps)
    cls = brown.exchange(pairs, 5, 100)
    for u in range(1, 30):
        for c in range(1, 5):
            moved = cls.copy()
            moved[u] = c
            assert likelihood(moved) <= likelihood(cls) + 1e-6


def test_classes_help_on_held_out_text(spark, tmpdir_run):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(("abcdefghij"[rng.integers(10)] + "x" if k % 2 else "klmnopqrst"[rng.integers(10)] + "y")
                         for k in range(60))) for i in range(60)]
    docs = saved(spark.createDataFrame(rows, "doc_id long, text string"), tmpdir_run + "/docs")
    m = brown.train(docs, F.col("doc_id") < 50, classes=4, clustered_words=30, suffix_buckets=4)
    held = [r for r in brown.score(docs, m).collect() if r.id >= 50]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.25 * sum(r.n_tokens for r in held)


def test_edge_cases(spark, tmpdir_run):
    docs = saved(edge_docs(spark), tmpdir_run + "/docs")
    m = brown.train(docs, F.lit(True), table_words=100, **SMALL)
    got = brown.score(docs, m).collect()
    assert len(got) == 17 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert {r.n_tokens for r in got if r.id in (2, 3, 4)} == {1}
    empty = empty_docs(spark)
    none = brown.train(empty, F.lit(True), **SMALL)
    assert brown.score(empty, none).count() == 0
    unseen = brown.score(docs, none).collect()
    assert {r.n_known for r in unseen} == {0} and {r.base_score for r in unseen} == {0.0}


def test_gains_equal_likelihood_of_each_move():
    rng = np.random.default_rng(5)
    pairs = rng.poisson(1, (20, 20)).astype(float)
    cls = np.concatenate(([0], 1 + rng.integers(3, size=19)))
    one = np.eye(4)[cls]
    off = pairs * (1 - np.eye(20))
    got = brown.gains(one.T @ pairs @ one, cls, off @ one, off.T @ one, np.diag(pairs).copy())
    for u in range(1, 20):
        moved = []
        for c in (1, 2, 3):
            x = np.eye(4)[np.where(np.arange(20) == u, c, cls)]
            moved.append(brown.likelihood(x.T @ pairs @ x))
        assert np.allclose(np.diff(got[u, 1:]), np.diff(moved))


def test_every_word_is_clustered_by_its_own_neighbours(spark, tmpdir_run):
    """Words beyond the in-memory start, all with one suffix, alternate by kind."""
    rng = np.random.default_rng(2)
    kinds = [[f"{k}{i:02d}end" for i in range(40)] for k in "ab"]
    rows = [(i, " ".join(kinds[k % 2][rng.integers(40)] for k in range(60))) for i in range(80)]
    docs = saved(spark.createDataFrame(rows, "doc_id long, text string"), tmpdir_run + "/docs")
    m = brown.train(docs, F.lit(True), classes=3, clustered_words=10, suffix_buckets=4)
    cut = brown.train(docs, F.lit(True), classes=3, clustered_words=10, suffix_buckets=4, piece=9)
    assert np.array_equal(cut.class_total.sum(), m.class_total.sum()) and np.array_equal(cut.table, m.table)
    top = brown.train(docs, F.lit(True), classes=3, clustered_words=80, suffix_buckets=4).top
    of = {h: c for h, _, c in top}
    for model in (m, cut):      # units of one row, and units cut into pieces
        got = {}
        for h, c in zip(model.table, model.table_class):
            got.setdefault(of[int(h)], []).append(int(c))
        assert sorted(map(len, got.values())) == [40, 40]
        assert all(len(set(x)) == 1 for x in got.values()) and len({x[0] for x in got.values()}) == 2


def test_packed_links_are_all_neighbours(spark, tmpdir_run):
    docs = corpus(spark, tmpdir_run + "/docs").repartition(4)
    from terrascope.llm.common import with_row
    from terrascope.llm.textvec import Words, text_slices
    rows = with_row(docs, "doc_id", "text")
    import pyarrow as pa
    texts = [r.text for r in docs.collect()]
    words = sorted({w for t in texts for w in tokens(t) if w})
    hashes = {}
    for _, _, data, offs in text_slices(pa.array([" ".join(words)])):
        w = Words(data, offs)
        hashes.update(zip(words, w.hash.tolist()))
    table = np.sort(np.array(list(hashes.values()), np.uint64))
    unit = {w: 1 + int(np.searchsorted(table, h)) for w, h in hashes.items()}
    want, count = Counter(), Counter()
    for t in texts:
        path = [0] + [unit[w] if w else 0 for w in tokens(t)]
        count.update(path[1:])
        for a, b in zip(path, path[1:]):
            want[a, 2 * b + 1] += 1
            want[b, 2 * a] += 1
    units = len(table) + 1 + 4
    occurrences = np.array([count[i] for i in range(units)])
    for most in (10 ** 6, 7):
        pieces = brown.unit_pieces(occurrences, most)
        got, rows_of = Counter(), Counter()
        for r in brown.unit_links(rows, table, len(table) + 1, 4, pieces).collect():
            links, n = np.frombuffer(r.links, np.int32), np.frombuffer(r.counts, np.int64)
            assert r.frequent == (pieces[r.unit] > 1) and len(set(links.tolist())) == len(links)
            rows_of[r.unit] += 1
            got.update({(r.unit, int(k)): int(x) for k, x in zip(links, n)})
        assert got == want
        assert all(rows_of[u] <= pieces[u] for u in rows_of) and (most > 7 or max(rows_of.values()) > 1)
