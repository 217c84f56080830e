"""Shared ranking of many items, and Orchard clustering, against plain code."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from terrascope.llm import orchard, shared_rank
from tests.llm.frames import WORDS, edge_docs, edge_rows, empty_docs, saved, sentence

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_rank(docs, items, k):
    counts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for place, (i, c) in enumerate(counts):
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in set(TERM.findall((text or "").translate(LOWER))) if c[t])
            if score:
                scored.append((-score, -1 if i is None else i, place, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return out


ITEMS = [(1, "river stone7 LIGHT under over quick3"), (2, "river stone7 light UNDER over lazy1 dog2"), (3, None), (4, ""), (5, "...!"),
         (6, "one"), (7, "日本 x éß"), (2, "river stone7 light under"), (None, "winter1 summer2 seven3"), (9, "unheard-of zzz"),
         (10, sentence(1, 3000))]


@pytest.mark.parametrize("block_terms", [1 << 19, 12])
def test_rank_is_that_of_plain_code(spark, tmpdir_run, block_terms):
    rows = edge_rows() + [(100 + i, sentence(50 + i % 40, 5 + 7 * i), "en", "x", 1, 2, 3, 4, "e") for i in range(60)]
    docs = saved(spark.createDataFrame(rows, edge_docs(spark).schema).repartition(5, "doc_id"), tmpdir_run + "/docs")
    items = saved(spark.createDataFrame([(i, t, "clash", 1) for i, t in ITEMS], "item_id long, text string, id string, rank int"),
                  tmpdir_run + "/items")
    got = shared_rank.search(docs, items, k=4, block_terms=block_terms).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    want = plain_rank([(r[0], r[1]) for r in rows], ITEMS, 4)
    assert sorted(((r.item_id, r["rank"], r.id, r.score) for r in got), key=key) == sorted(want, key=key)


def test_rank_of_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert shared_rank.search(empty_docs(spark), items).count() == 0
    assert shared_rank.search(edge_docs(spark), items.limit(0)).count() == 0
    assert shared_rank.search(edge_docs(spark), items.where("item_id in (3, 4, 5)")).count() == 0


def test_shared_sums_are_each_built_once():
    rnd = random.Random(4)
    common = [rnd.sample(range(40), 6) for _ in range(5)]
    lists = [sorted(set(rnd.choice(common) + rnd.choice(common) + rnd.sample(range(40, 400), 3))) for _ in range(80)]
    pairs, rest = shared_rank.sharing(lists, 400)
    assert len(set(pairs)) == len(pairs)

    def leaves(node):
        return [node] if node < 400 else leaves(pairs[node - 400][0]) + leaves(pairs[node - 400][1])
    for one, short in zip(lists, rest):
        assert sorted(x for node in short for x in leaves(node)) == one
    assert len(pairs) + sum(map(len, rest)) < sum(map(len, lists)) * 0.7
    used = Counter(x for p in pairs for x in p) + Counter(x for one in rest for x in one)
    assert all(used[400 + i] for i in range(len(pairs)))


def plain_clusters(rows, k, rounds, dim=64, seed=2):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    def digest(i):
        return hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, members in groups.items():
            c[j] = [sum(x) // len(members) for x in zip(*members)]
    placed = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = Counter()
    for _, j, d in placed:
        inertia[j] += d
    return [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest())
            for i, j, d in placed]


def test_clusters_are_those_of_plain_code(spark):
    rnd = random.Random(9)
    rows = [(i, [float(np.float32(rnd.gauss(i % 5, 0.4))) for _ in range(64)]) for i in range(150)]
    bad = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63),
           (905, [float("nan")] + [1.0] * 63), (906, [float("inf")] + [1.0] * 63)]
    rows += bad + [(7, rows[7][1]), (8, rows[9][1]), (None, rows[3][1])] + [(1000 + i, [0.5] * 64) for i in range(80)]
    frame = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows],
                                  "vec_id long, embedding array<float>, cluster int, id string, n int").repartition(4)
    got = orchard.report(frame, k=12, rounds=3)
    assert got.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_clusters(rows, 12, 3), key=key)


def test_few_and_no_vectors(spark):
    three = [(i, [float(i)] * 64) for i in range(3)]
    frame = spark.createDataFrame(three, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, orchard.report(frame).collect())) == sorted(plain_clusters(three, 40, 5))
    assert orchard.report(frame.limit(0)).count() == 0
    with pytest.raises(Exception, match="exceeds"):
        orchard.report(spark.createDataFrame([(1, [1e30] * 64)], frame.schema)).count()


def test_search_measures_ties_and_stops_early():
    rnd = np.random.default_rng(3)
    c = rnd.integers(-3, 4, (30, 3))
    c[7], c[11] = c[2], c[2]
    x = rnd.integers(-4, 5, (4000, 3))
    best, dist = orchard.nearest(x, c)
    every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (dist == every.min(axis=1)).all()
