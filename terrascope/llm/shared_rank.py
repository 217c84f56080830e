"""Ranked lexical search of many queries at once, sharing common partial sums.

The items' terms are mined for shared term sets: terms that occur in the same
items form one class, and adjacent classes that two or more items share are
paired, round by round, into nodes of a directed acyclic graph (``sharing``).  A
block of documents evaluates every node once, as a vector of partial document
scores, whatever the number of items above it; an item's scores are the sum of
the few nodes that remain in its own list.  All sums are 64-bit integers, so the
order of additions does not matter.

Two passes over the table: the first counts, per document, its terms and the
terms that items ask for (a table of small integers, from which ``df``, ``N`` and
``L`` come), the second scores that table and keeps the best ``k`` documents per
item of every task; Spark merges those, first in groups of tasks.  Items go in
blocks of about ``BLOCK_TERMS`` (item, term) pairs, one scoring pass each,
so the graph in a task is bounded whatever the number of items.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``
with A-Z lower-cased, told apart by 64-bit hashes.  Null and empty texts, of
documents or items, have no terms: such items have no rows, such documents are
never found and count for nothing.  Repeated rows of an item or a document are
rows of their own (an item's rows are told apart by ``item_row``); equal scores
rank by ascending document id, null ids first, then by row.  Empty tables give no
rows.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrascope.llm.common import ROW, keep_table, ship, with_row
from terrascope.llm.textvec import Words, text_slices

#: (item, term) pairs of a block of items, about; bounds the arrays of a task and the driver.
BLOCK_TERMS = 1 << 19
#: Cells of the accumulators of a block of documents.
CELLS = 1 << 21

SEPARATOR = np.ones(256, dtype=bool)
SEPARATOR[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    SEPARATOR[_a:_b] = False


def _counts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(h, return_counts=True)


def item_terms(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(item_row, item_id, term)``: the distinct terms of every item, as hashes."""
    def run(batches):
        for batch in batches:
            for a, b, data, offs in text_slices(batch.column(2)):
                words = Words(data, offs, separators=SEPARATOR)
                for d in range(a, b):
                    terms = np.unique(words.hash[words.bound[d - a]:words.bound[d - a + 1]])
                    n = len(terms)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, batch.column(0)[d].as_py(), np.int64)),
                         pa.array([batch.column(1)[d].as_py()] * n, pa.int64()), pa.array(terms.view(np.int64))],
                        names=["item_row", "item_id", "term"])

    return with_row(items, id_column, text_column).mapInArrow(run, "item_row long, item_id long, term long")


def sharing(lists: list[list[int]], leaves: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Common subexpressions of item lists: ``(pairs, rest)``.

    ``lists`` holds leaf numbers below ``leaves``.  Node ``leaves + i`` is the sum of
    the two nodes ``pairs[i]``, each of them numbered below it; ``rest`` are the
    lists written with nodes.  Each round counts neighbouring entries (lists are kept
    in one common order, leaves of many items first) and replaces every pair that two
    or more lists hold, the most frequent first; linear in the lists."""
    use = Counter(x for one in lists for x in one)
    rest = [sorted(one, key=lambda x: (-use[x], x)) for one in lists]
    pairs: list[tuple[int, int]] = []
    while True:
        seen = Counter(p for one in rest for p in zip(one, one[1:]))
        new = {p: leaves + len(pairs) + i for i, p in enumerate(
            p for p, n in sorted(seen.items(), key=lambda e: (-e[1], e[0])) if n > 1)}
        if not new:
            return pairs, rest
        used: Counter = Counter()
        shorter = []
        for one in rest:
            out, i = [], 0
            while i < len(one):
                node = new.get((one[i], one[i + 1])) if i + 1 < len(one) else None
                # of two overlapping pairs the more frequent (smaller number) is taken
                after = new.get((one[i + 1], one[i + 2])) if node is not None and i + 2 < len(one) else None
                if node is None or (after is not None and after < node):
                    out.append(one[i])
                    i += 1
                else:
                    out.append(node)
                    used[node] += 1
                    i += 2
            shorter.append(out)
        # nodes that ended in no list are numbered away, so none is evaluated for nothing
        taken = [p for p, node in new.items() if used[node]]
        number = {new[p]: leaves + len(pairs) + i for i, p in enumerate(taken)}
        pairs += taken
        rest = [[number.get(x, x) for x in one] for one in shorter]


class Plan:
    """Classes, sharing graph and item lists of a block of items.

    ``cls[t]``: the class of term ``t`` (terms that occur in the same items);
    ``levels``: arrays (node, left, right) in an order of evaluation."""

    def __init__(self, item: np.ndarray, term: np.ndarray, items: int, terms: int):
        mark = np.zeros(terms, np.uint64)
        salt = np.random.default_rng(11).integers(1, 2 ** 63, size=(items, 2), dtype=np.uint64)
        mark2 = np.zeros(terms, np.uint64)
        np.add.at(mark, term, salt[item, 0])
        np.add.at(mark2, term, salt[item, 1])
        _, self.cls = np.unique(np.stack([mark, mark2], axis=1), axis=0, return_inverse=True)
        self.cls = self.cls.reshape(-1)
        self.classes = int(self.cls.max()) + 1 if terms else 0
        lists: list[set[int]] = [set() for _ in range(items)]
        for i, c in zip(item.tolist(), self.cls[term].tolist()):
            lists[i].add(c)
        pairs, self.rest = sharing([sorted(one) for one in lists], self.classes)
        self.nodes = self.classes + len(pairs)
        depth = np.zeros(self.nodes, np.int64)
        for i, (a, b) in enumerate(pairs):
            depth[self.classes + i] = 1 + max(depth[a], depth[b])
        both = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        self.levels = []
        for level in range(1, int(depth.max()) + 1 if self.nodes else 1):
            at = np.flatnonzero(depth == level)
            self.levels.append((at, both[at - self.classes, 0], both[at - self.classes, 1]))
        self.flat = np.array([x for one in self.rest for x in one], dtype=np.int64)
        self.start = np.cumsum([0] + [len(one) for one in self.rest])[:-1]

    def scores(self, term: np.ndarray, doc: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        """Item scores ``(items, docs)`` from the contributions of terms to documents."""
        acc = np.zeros((self.nodes, docs), np.int64)
        np.add.at(acc, (self.cls[term], doc), value)
        for node, a, b in self.levels:
            acc[node] = acc[a] + acc[b]
        return np.add.reduceat(acc[self.flat], self.start, axis=0)


def matched_terms(docs: DataFrame, vocabulary: np.ndarray, id_column: str, text_column: str) -> DataFrame:
    """``(__row, id, n, terms, tf)`` of every document with a term: its number of
    terms, and the places in the sorted ``vocabulary`` that it holds with their counts."""
    def run(batches):
        for batch in batches:
            for a, b, data, offs in text_slices(batch.column(2)):
                words = Words(data, offs, separators=SEPARATOR)
                bound = words.bound
                owner = np.repeat(np.arange(b - a), np.diff(bound))
                at = np.searchsorted(vocabulary, words.hash)
                at[at == len(vocabulary)] = 0
                hit = vocabulary[at] == words.hash if len(vocabulary) else np.zeros(len(at), bool)
                key, tf = _counts(owner[hit] * len(vocabulary) + at[hit])
                doc = key // max(len(vocabulary), 1)
                ends = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
                terms = pa.ListArray.from_arrays(pa.array(ends), pa.array((key % max(len(vocabulary), 1)).astype(np.int32)))
                counts = pa.ListArray.from_arrays(pa.array(ends), pa.array(tf))
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(bound)), terms, counts],
                    names=[ROW, "id", "n", "terms", "tf"])
                yield out.filter(pa.array(np.diff(bound) > 0))

    return with_row(docs, id_column, text_column).mapInArrow(
        run, f"{ROW} long, id long, n long, terms array<int>, tf array<long>")


def _best(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best positive scores: highest first, then by id and row."""
    at = np.flatnonzero(score > 0)
    if len(at) > 4 * k:
        least = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= least]
    return at[np.lexsort((rows[at], ids[at], -score[at]))][:k]


def _search_block(found: DataFrame, plan: Plan, weights: np.ndarray, documents: int, terms: int, k: int) -> DataFrame:
    """``(item, __row, id, score)``: the best ``k`` documents per item of every task."""
    step = max(1, CELLS // max(plan.nodes, 1))
    held = len(plan.rest)
    null = np.iinfo(np.int64).min

    def run(batches):
        best = [(np.zeros(0, np.int64),) * 3 for _ in range(held)]
        for batch in batches:
            row, has, n = batch.column(0).to_numpy(), batch.column(1).is_valid().to_numpy(zero_copy_only=False), batch.column(2)
            ids = np.where(has, batch.column(1).fill_null(0).to_numpy(), null)
            m8 = np.array([8 * (10 + (90 * x * documents) // terms) for x in n.to_pylist()], dtype=np.int64)
            for a in range(0, len(row), step):
                b = min(len(row), a + step)
                lists, counts = batch.column(3).slice(a, b - a), batch.column(4).slice(a, b - a)
                term, tf = lists.flatten().to_numpy(), counts.flatten().to_numpy()
                doc = np.repeat(np.arange(b - a), np.diff(lists.offsets.to_numpy()))
                value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + m8[a:b][doc]))
                score = plan.scores(term, doc, value, b - a)
                for i in range(held):
                    old = best[i]
                    least = old[0][-1] if len(old[0]) == k else 1
                    if score[i].max() < least:
                        continue
                    merged = [np.concatenate(p) for p in zip(old, (score[i], ids[a:b], row[a:b]))]
                    top = _best(*merged, k)
                    best[i] = tuple(p[top] for p in merged)
        for i, (score, ids, rows) in enumerate(best):
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(score), i, np.int32)), pa.array(rows), pa.array(ids, mask=ids == null),
                     pa.array(score)], names=["item", ROW, "id", "score"])

    return found.mapInArrow(run, f"item int, {ROW} long, id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_column: str = "doc_id", text_column: str = "text",
           item_id_column: str = "item_id", item_text_column: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_row, item_id, rank, id, score)``: the ``k`` best documents of every item.

    A term of ``df`` documents weighs ``floor(1000 ln((2N + 2) / (2 df + 1)))``; a document
    of ``n`` terms scores the sum over the item's distinct terms of weight times
    ``(10**9 tf) div (1000 tf + 8 m)``, with ``m = 10 + (90 n N) div L``."""
    spark = docs.sparkSession
    ship(spark)
    asked = keep_table(item_terms(items, item_id_column, item_text_column), "item-terms")
    blocks = -(-asked.count() // block_terms)
    results = []
    for block in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_row"), F.lit(blocks)) == block)
        got = part.toArrow()                       # about block_terms rows
        if not len(got):
            continue
        rows, item = np.unique(got["item_row"].to_numpy(), return_inverse=True)
        vocabulary, term = np.unique(got["term"].to_numpy().view(np.uint64), return_inverse=True)
        names = dict(zip(got["item_row"].to_pylist(), got["item_id"].to_pylist()))
        plan = Plan(item.reshape(-1), term.reshape(-1), len(rows), len(vocabulary))
        found = keep_table(matched_terms(docs, vocabulary, id_column, text_column), "matched-terms")
        documents, terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        held = found.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()   # a row per term of the block
        df[held["t"].to_numpy()] = held["count"].to_numpy()
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        best = _search_block(found, plan, weights, documents, terms, k)
        order = [F.desc("score"), F.asc_nulls_first("id"), F.asc(ROW)]
        # tasks are merged in groups before the last sort of an item
        some = F.pmod(F.shiftright(ROW, 33), F.lit(64))
        best = best.withColumn("place", F.row_number().over(Window.partitionBy("item", some).orderBy(*order))).where(F.col("place") <= k)
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        known = spark.createDataFrame([(i, int(r), names[r]) for i, r in enumerate(rows.tolist())],
                                      "item int, item_row long, item_id long")
        results.append(best.join(F.broadcast(known), "item").select("item_row", "item_id", "rank", "id", "score"))
    if not results:
        return spark.createDataFrame([], "item_row long, item_id long, rank int, id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
