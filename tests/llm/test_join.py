"""N-gram Jaccard groups and components against brute force."""

import random
import re

import pytest

from terrascope.llm import ngram_join
from terrascope.llm.components import components, joined
from tests.llm.frames import edge_docs, edge_rows, empty_docs, saved, sentence


def sets_of(rows, k):
    out = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute(rows, k, percent):
    sets, root = sets_of(rows, k), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    least = {}
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        for i in g:
            least[i] = min(ids) if ids else None
    return [(rows[i][0], len(sets[i]), least[i]) for i in range(len(rows))]


def cloud(seed, n, length, edits, first):
    """Copies of one text with some words changed, far ones too."""
    rnd = random.Random(seed)
    base = sentence(seed, length).split()
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(length)] = f"edit{rnd.randint(0, 10 ** 6)}"
        out.append((first + i, " ".join(w)))
    return out


def check(spark, folder, rows, k, percent, **options):
    docs = saved(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), folder)
    got = ngram_join.linked_groups(docs, k, percent, **options).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([(r.id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(brute(rows, k, percent), key=key)
    # one row of each group is kept, every row without n-grams too
    kept = [r for r in got if r.first]
    with_words = [r for r in kept if r.n_shingles]
    assert len({r.component_id for r in with_words}) == len(with_words)
    assert sum(r.n_shingles == 0 for r in kept) == sum(r.n_shingles == 0 for r in got)
    return got


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (1, 50)])
def test_clouds(spark, tmpdir_run, k, percent):
    rows = cloud(1, 60, 80, 8, 0) + cloud(2, 25, 30, 3, 100) + cloud(3, 25, 300, 20, 200)
    shared = sentence(77, 60)
    rows += [(300 + i, sentence(400 + i, 20 + i) + " " + shared) for i in range(25)]
    rows += [(400 + i, " ".join(sentence(9, 60).split()[:60 - i])) for i in range(25)]  # a chain of sizes
    check(spark, tmpdir_run + "/docs", rows, k, percent)


def test_hot_order_and_blocks(spark, tmpdir_run, monkeypatch):
    rows = cloud(5, 150, 60, 9, 0) + [(500 + i, sentence(600 + i, 40) + " " + sentence(78, 50)) for i in range(60)]
    hot = ngram_join.hot_ngrams
    monkeypatch.setattr(ngram_join, "hot_ngrams", lambda *a: hot(*a, least=8, max_hot=200))
    check(spark, tmpdir_run + "/docs", rows, 4, 85, block=16)


def test_edge_cases(spark, tmpdir_run):
    rows = [(i, t) for i, t, *_ in edge_rows()]
    got = check(spark, tmpdir_run + "/docs", rows, 4, 85)
    by = {r.id: r for r in got}
    assert by[6].component_id == 5 and by[11].component_id == 10 and by[3].component_id == 3
    docs = saved(edge_docs(spark), tmpdir_run + "/wide")
    kept = ngram_join.keep_first(docs, 4, 85)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted([1, 2, 3, 4, 5, 7, 0, 0, 10, 12, 13, 14, 16])
    assert ngram_join.linked_groups(empty_docs(spark)).count() == 0
    assert ngram_join.keep_first(empty_docs(spark)).count() == 0


def test_prefix_length_is_exact():
    for percent in (50, 80, 85, 100):
        for n in range(1, 200):
            least = next(o for o in range(n + 1) if 100 * o >= percent * n)
            assert ngram_join.prefix_length(n, percent) == n - least + 1


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, 200 + i) for i in range(1, 80)] + [(300, 300)]
    edges += [(1000 + rnd.randrange(60), 1000 + rnd.randrange(60)) for _ in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_rows_of_any_frame_are_kept_alike(spark):
    """A frame that is no scan of files may number its rows anew in every scan."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(r.doc_id for r in ngram_join.keep_first(docs).select("doc_id").collect())
    got = sorted(r.doc_id for r in ngram_join.keep_first(docs.repartition(7)).select("doc_id").collect())
    assert got == want


def test_components_of_chains_hubs_and_later_links(spark):
    import random

    from terrascope.llm.components import components, joined
    rnd = random.Random(2)
    first = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 900)] + [(5000 + 2 * i, 5001 + 2 * i) for i in range(40)]
    later = [(60, 1400), (5000, 5003), (7000, 7001), (5079, 7001), (3, 9)]
    rnd.shuffle(first)

    def plain(edges):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x
        for a, b in edges:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return {(x, find(x)) for x in root}
    frame = spark.createDataFrame(first, "a long, b long")
    groups = components(frame, "a", "b").cache()
    assert {tuple(r) for r in groups.collect()} == plain(first)
    assert {tuple(r) for r in joined(groups, spark.createDataFrame(later, "a long, b long"), "a", "b").collect()} == plain(first + later)
    assert {tuple(r) for r in joined(groups, spark.createDataFrame([], "a long, b long"), "a", "b").collect()} == plain(first)


def test_sets_of_pairs_are_not_written(spark, monkeypatch):
    from terrascope.llm import ngram_join as nj
    written, keep = [], nj.keep_table
    monkeypatch.setattr(nj, "keep_table", lambda df, name: written.append((name, df.columns)) or keep(df, name))
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words[:-1], "end"]), " ".join(words[:30]), "other words of a text", " ".join(words), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.component_id for r in nj.linked_groups(nj.stable_rows(docs), 4, 85).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 0, 5: 5}
    assert written and not [name for name, columns in written if "s" in columns]
