"""Growing classification forests of two classes on whole tables.

MLlib keeps a histogram for every open node in every task, which for deep trees on many
rows is more memory and time than the rows themselves.  Here a node of more than
``LOCAL_ROWS`` rows is split from histograms that all tasks add up (a pass per level);
the rows of a smaller one go to one task, which grows all that is below it in memory.  Every
row takes part, and every value that a feature takes is a candidate threshold.

* Row weights are Poisson draws hashed from the row's key, the tree and the seed (Bernoulli without
  ``bootstrap``), so they do not depend on how rows are dealt.
* A node is known by its heap number (root 1, children 2i and 2i + 1); it tries the features that a hash
  of tree and number puts first.
* As in MLlib, a split needs a gain and ``minInstancesPerNode`` (bootstrap) rows on both sides, and sibling
  leaves of the same class are one leaf.

The result has MLlib's own layout on disk and is loaded as an MLlib model when one is asked for.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from terrascope.plans.forest import copy_metadata, saved
from terrascope.session import scratch_path, ship

#: Bootstrap rows of a node that one task takes, at most.
LOCAL_ROWS = 1 << 19
#: Nodes whose histograms a task holds at once, at most.
NODES_AT_ONCE = 2048
#: Rows times trees that are dealt to tasks at once, at most.
DEALT_ROWS = 1 << 28

#: A node: heap number, bootstrap rows, those of class 1, split feature (-1: a leaf) and cut, gain.
NODE = np.dtype([("node", np.int64), ("n", np.int64), ("one", np.int64), ("feature", np.int32), ("cut", np.int32),
                 ("gain", np.float64)])
#: Nodes between tasks: one row per part of a tree, so no sort handles single nodes.
PACKED = "tree int, nodes binary"


@dataclass
class Plan:
    """What the tasks need to know: parameters, and the sorted values of every feature."""
    values: list[np.ndarray]
    tried: int
    depth: int
    min_leaf: int
    min_split: int
    min_gain: float
    entropy: bool
    rate: float
    bootstrap: bool
    seed: int

    @property
    def bins(self) -> int:
        return max(len(v) for v in self.values)

    @property
    def row(self) -> np.dtype:
        return np.dtype([("x", np.uint8 if self.bins <= 256 else np.uint16 if self.bins <= 65536 else np.uint32,
                          (len(self.values),)), ("y", np.uint8), ("w", np.uint8)])


def _mix(z: np.ndarray) -> np.ndarray:
    """A 64-bit hash (splitmix64)."""
    z = np.asarray(z, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _key(seed: int, tree: int) -> np.ndarray:
    return _mix(_mix(np.array([seed % (1 << 64)], np.uint64)) + np.uint64(tree))


def draws(u: np.ndarray, tree: int, plan: Plan) -> np.ndarray:
    """How often each row (hash ``u`` of its key) is in the sample of ``tree``."""
    x = (_mix(u ^ _key(plan.seed, tree)) >> np.uint64(11)) * 2.0 ** -53
    if not plan.bootstrap:
        return (x < plan.rate).astype(np.uint8)
    p = [math.exp(-plan.rate)]
    for k in range(1, 60):
        p.append(p[-1] * plan.rate / k)
    return np.searchsorted(np.cumsum(p)[:-1], x, side="right").astype(np.uint8)


def _tried(tree: int, nodes: np.ndarray, plan: Plan) -> np.ndarray:
    """The features that each node tries, in their order."""
    n = len(plan.values)
    if plan.tried >= n:
        return np.tile(np.arange(n), (len(nodes), 1))
    h = _mix(_mix(nodes.astype(np.uint64) ^ ~_key(plan.seed, tree))[:, None] + np.arange(n, dtype=np.uint64)[None, :])
    return np.sort(np.argsort(h, axis=1, kind="stable")[:, :plan.tried], axis=1)


def _impurity(one: np.ndarray, n: np.ndarray, plan: Plan) -> np.ndarray:
    p = one / np.maximum(n, 1)
    if not plan.entropy:
        return 2.0 * p * (1.0 - p)
    q = np.stack([p, 1.0 - p])
    return -(q * np.log2(np.where(q > 0, q, 1.0))).sum(axis=0)


def _open(node: np.ndarray, n: np.ndarray, one: np.ndarray, plan: Plan) -> np.ndarray:
    """Nodes that may be split."""
    deep = np.frexp(node.astype(np.float64))[1] - 1
    return (deep < plan.depth) & (one > 0) & (one < n) & (n >= max(2 * plan.min_leaf, plan.min_split))


def _best_cuts(at: np.ndarray, n: np.ndarray, one: np.ndarray, left: np.ndarray, left_one: np.ndarray, plan: Plan):
    """``(node, place)``: the best cut of every node that has one, among cuts in the order of nodes ``at`` with ``left``
    rows, ``left_one`` of them of class 1, on the left; and its gain."""
    n, one = n[at], one[at]
    ok = np.flatnonzero((left >= plan.min_leaf) & (n - left >= plan.min_leaf))
    if not len(ok):
        return ok, ok, np.zeros(0)
    at, n, one, left, left_one = at[ok], n[ok], one[ok], left[ok], left_one[ok]
    right = n - left
    gain = (_impurity(one, n, plan) - left / n * _impurity(left_one, left, plan)
            - right / n * _impurity(one - left_one, right, plan))
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    most = np.maximum.reduceat(gain, first)
    top = np.flatnonzero(gain == np.repeat(most, np.diff(np.append(first, len(at)))))
    top = top[np.append(True, at[top][1:] != at[top][:-1])]
    return at[top], ok[top], gain[top]


def grow(rows: np.ndarray, root: int, tree: int, plan: Plan) -> np.ndarray:
    """All nodes (``NODE``) from ``root`` down, from its bootstrap rows (``Plan.row``)."""
    rows = rows[rows["w"] > 0]
    x, y, w = np.ascontiguousarray(rows["x"]), rows["y"].astype(np.int64), rows["w"].astype(np.int64)
    low = (y << 8) | w
    at, node = np.zeros(len(rows), np.int64), np.array([root], np.int64)
    out: list[np.ndarray] = []
    while len(node):
        w, y = low & 255, low >> 8
        n = np.bincount(at, w, len(node)).astype(np.int64)
        one = np.bincount(at, w * y, len(node)).astype(np.int64)
        level = np.zeros(len(node), NODE)
        level["node"], level["n"], level["one"] = node, n, one
        level["feature"], level["cut"], level["gain"] = -1, -1, -1.0
        out.append(level)
        may = _open(node, n, one, plan)
        # rows of closed nodes are done with
        keep, number = may[at], np.cumsum(may) - 1
        x, low, at = x[keep], low[keep], number[at[keep]]
        opened = np.flatnonzero(may)
        n, one = n[may], one[may]
        before, before_one = np.cumsum(n) - n, np.cumsum(one) - one
        best, feature, cut = np.zeros(len(opened)), np.full(len(opened), -1), np.full(len(opened), -1)
        tried = _tried(tree, node[may], plan)
        flat, start = x.ravel(), np.arange(len(x)) * x.shape[1]
        for j in range(tried.shape[1]):
            key = ((at * plan.bins + flat.take(start + tried[at, j])) << 9) | low
            key.sort()
            ends = np.flatnonzero(np.append(key[1:] >> 9 != key[:-1] >> 9, True)) if len(key) else np.zeros(0, np.int64)
            place = key[ends] >> 9
            sums = np.cumsum(key & 255)[ends]
            ones = np.cumsum((key & 255) * (key >> 8 & 1))[ends]
            of = place // plan.bins
            k, i, gain = _best_cuts(of, n, one, sums - before[of], ones - before_one[of], plan)
            more = gain > best[k]
            k, i = k[more], i[more]
            best[k], feature[k], cut[k] = gain[more], tried[k, j], place[i] % plan.bins
        split = (feature >= 0) & (best >= plan.min_gain)
        to = opened[split]
        level["feature"][to], level["cut"][to], level["gain"][to] = feature[split], cut[split], best[split]
        keep, number = split[at], np.cumsum(split) - 1
        x, low, at = x[keep], low[keep], at[keep]
        right = x.ravel().take(np.arange(len(x)) * x.shape[1] + feature[at]) > cut[at]
        at = 2 * number[at] + right
        node = np.repeat(node[to] * 2, 2)
        node[1::2] += 1
    return np.concatenate(out)


def _batch(batch: pa.RecordBatch, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Rows (``Plan.row``, without weights) and key hashes of a batch of features, label and hash."""
    rows = np.zeros(batch.num_rows, plan.row)
    for j, values in enumerate(plan.values):
        if batch.column(j).null_count:
            raise ValueError("a feature has no value")
        rows["x"][:, j] = np.searchsorted(values, batch.column(j).to_numpy(zero_copy_only=False).astype(np.float64))
    rows["y"] = batch.column(len(plan.values)).to_numpy(zero_copy_only=False)
    return rows, batch.column(len(plan.values) + 1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


class Top:
    """The upper part of a tree: nodes by their heap numbers, split nodes with feature and cut."""

    def __init__(self, splits: dict[int, tuple[int, int]]):
        self.node = np.array(sorted({1}.union(*({2 * k, 2 * k + 1} for k in splits))), np.int64)
        self.feature, self.cut = np.full(len(self.node), -1), np.zeros(len(self.node), np.int64)
        for k, (feature, cut) in splits.items():
            i = np.searchsorted(self.node, k)
            self.feature[i], self.cut[i] = feature, cut
        self.left = np.searchsorted(self.node, 2 * self.node)

    def walk(self, x: np.ndarray) -> np.ndarray:
        """The lowest of these nodes that each row reaches."""
        flat, start = x.ravel(), np.arange(len(x)) * x.shape[1]
        at = np.zeros(len(x), np.int64)
        while (go := self.feature[at] >= 0).any():
            right = flat.take(start + np.where(go, self.feature[at], 0)) > self.cut[at]
            at = np.where(go, self.left[at] + right, at)
        return self.node[at]


def _split_large(data: DataFrame, plan: Plan, tops: dict[int, dict], large: list[tuple[int, int]]) -> list:
    """One level: totals and best split of nodes with many rows, from histograms added up over all tasks."""
    large = sorted(large)
    trees, nodes = (np.array(c, np.int64) for c in zip(*large))
    tried = np.concatenate([_tried(t, np.array([n]), plan) for t, n in large])
    bins = plan.bins
    upper = {int(t): Top(tops[t]) for t in np.unique(trees)}

    def count(batches):
        sums = np.zeros((len(large), plan.tried, bins, 2), np.int64)
        for batch in batches:
            rows, u = _batch(batch, plan)
            for t, top in upper.items():
                mine = slice(*np.searchsorted(trees, (t, t + 1)).tolist())
                w = draws(u, t, plan)
                x, y, w = rows["x"][w > 0], rows["y"][w > 0].astype(np.int64), w[w > 0]
                node = top.walk(x)
                at = np.minimum(np.searchsorted(nodes[mine], node), mine.stop - mine.start - 1)
                here = nodes[mine][at] == node
                x, y, w, at = np.ascontiguousarray(x[here]), y[here], w[here].astype(np.int64), at[here] + mine.start
                flat, start = x.ravel(), np.arange(len(x)) * x.shape[1]
                for j in range(plan.tried):
                    v = flat.take(start + tried[at, j]).astype(np.int64)
                    np.add.at(sums.reshape(-1), ((at * plan.tried + j) * bins + v) * 2 + y, w)
        yield pa.RecordBatch.from_pydict({"tree": pa.array(trees, pa.int32()), "node": pa.array(nodes, pa.int64()),
                                          "sums": pa.array([s.tobytes() for s in sums], pa.binary())})

    def best(group):
        t, node = group.column("tree")[0].as_py(), group.column("node")[0].as_py()
        sums = sum(np.frombuffer(s.as_py(), np.int64) for s in group.column("sums")).reshape(-1, bins, 2)
        n, one = sums[0].sum(), sums[0, :, 1].sum()
        found = (-1, -1, -1.0, 0)
        if _open(np.array([node]), np.array([n]), np.array([one]), plan)[0]:
            for j, f in enumerate(_tried(t, np.array([node]), plan)[0]):
                some = np.flatnonzero(sums[j].sum(axis=1))      # values that the node has
                left = np.cumsum(sums[j][some], axis=0)
                _, i, gain = _best_cuts(np.zeros(len(some), int), np.array([n]), np.array([one]), left.sum(axis=1), left[:, 1], plan)
                if len(i) and gain[0] > max(found[2], 0.0):
                    found = (f, some[i[0]], gain[0], left[i[0]].sum())
        if found[2] < plan.min_gain:
            found = (-1, -1, -1.0, 0)
        here = np.array([(node, n, one, *found[:3])], NODE)
        return pa.table({"tree": pa.array([t], pa.int32()), "nodes": pa.array([here.tobytes()], pa.binary()),
                         "left": pa.array([found[3]], pa.int64())})

    parts = data.mapInArrow(count, "tree int, node long, sums binary")
    return parts.groupBy("tree", "node").applyInArrow(best, f"{PACKED}, left long").collect()


def _grow_dealt(data: DataFrame, plan: Plan, tops: dict[int, dict], roots: set[tuple[int, int]]) -> DataFrame:
    """The nodes below ``roots``: the rows of each go to one task."""
    upper = {t: Top(splits) for t, splits in tops.items()}
    below_top = {t: np.array(sorted(n for tree, n in roots if tree == t), np.int64) for t in tops}

    def deal(batches):
        for batch in batches:
            rows, u = _batch(batch, plan)
            out: dict[str, list] = {"tree": [], "node": [], "rows": []}
            for t, top in upper.items():
                rows["w"] = draws(u, t, plan)
                mine = rows[rows["w"] > 0]
                node = top.walk(np.ascontiguousarray(mine["x"]))
                here = np.isin(node, below_top[t])        # other nodes are leaves
                order = np.flatnonzero(here)[np.argsort(node[here], kind="stable")]
                mine, node = mine[order], node[order]
                first = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else []
                for a, b in zip(first, [*first[1:], len(node)]):
                    out["tree"].append(t)
                    out["node"].append(int(node[a]))
                    out["rows"].append(mine[a:b].tobytes())
            yield pa.RecordBatch.from_pydict({"tree": pa.array(out["tree"], pa.int32()), "node": pa.array(out["node"], pa.int64()),
                                              "rows": pa.array(out["rows"], pa.binary())})

    def below(group):
        t, node = group.column("tree")[0].as_py(), group.column("node")[0].as_py()
        parts = [np.frombuffer(r.as_buffer(), plan.row) for r in group.column("rows")]
        nodes = grow(np.concatenate(parts), node, t, plan)
        return pa.table({"tree": pa.array([t], pa.int32()), "nodes": pa.array([nodes.tobytes()], pa.binary())})

    dealt = data.mapInArrow(deal, "tree int, node long, rows binary")
    # a tree that draws no row is a leaf without rows
    dealt = dealt.unionByName(data.sparkSession.createDataFrame([(t, n, b"") for t, n in roots], dealt.schema))
    # a number of its own: small partitions put together would leave cores without a tree
    return dealt.repartition(min(2 * len(roots), 4096), "tree", "node").groupBy("tree", "node").applyInArrow(below, PACKED)


def _layout(parts: pa.Table, plan: Plan, classes: int, schema: pa.Schema) -> pa.Table:
    """One tree in MLlib's layout, parents before children; sibling leaves of the same class are one leaf."""
    c = np.concatenate([np.frombuffer(p.as_buffer(), NODE) for p in parts.column("nodes")])
    c = c[np.argsort(c["node"])]
    node, inner = c["node"], c["feature"] >= 0
    left = np.where(inner, np.searchsorted(node, 2 * node), -1)
    says = (2 * c["one"] > c["n"]).astype(np.int64)
    keep, deep = np.ones(len(node), bool), np.frexp(node.astype(np.float64))[1]
    for d in range(int(deep[-1]) - 1, 0, -1):
        up = np.flatnonzero(inner & (deep == d))
        a = left[up]
        same = ~inner[a] & ~inner[a + 1] & (says[a] == says[a + 1])
        inner[up[same]] = False
        says[up[same]] = says[a[same]]
        keep[a[same]] = keep[a[same] + 1] = False
    number = np.cumsum(keep) - 1
    left = np.where(inner, number[left], -1)[keep]
    c, says, inner = c[keep], says[keep], inner[keep]
    cuts = [(v[:-1] + v[1:]) / 2.0 for v in plan.values]
    at = np.where(inner, c["cut"], 0)
    threshold = np.zeros(len(at))
    for j, v in enumerate(cuts):
        mine = inner & (c["feature"] == j)
        threshold[mine] = v[at[mine]]
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(inner)), pa.int32()), pa.array(threshold[inner]))
    stats = np.stack([c["n"] - c["one"], c["one"]], axis=1)[:, :classes].astype(np.float64)
    kind = schema.field("nodeData").type
    split = kind.field("split").type
    split = pa.StructArray.from_arrays(
        [pa.array(np.where(inner, c["feature"], -1), pa.int32()), lists, pa.array(np.full(len(at), -1), pa.int32())],
        names=[f.name for f in split])
    data = {"id": pa.array(np.arange(len(at)), pa.int32()), "prediction": pa.array(says.astype(np.float64)),
            "impurity": pa.array(_impurity(c["one"], c["n"], plan)),
            "impurityStats": pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * classes, pa.int32()), pa.array(stats.ravel())),
            "rawCount": pa.array(c["n"].copy()), "gain": pa.array(np.where(inner, c["gain"], -1.0)),
            "leftChild": pa.array(left, pa.int32()), "rightChild": pa.array(np.where(inner, left + 1, -1), pa.int32()), "split": split}
    whole = pa.StructArray.from_arrays([data[f.name] for f in kind], names=[f.name for f in kind])
    return pa.table({"treeID": pa.array(np.full(len(at), parts.column("tree")[0].as_py()), pa.int32()), "nodeData": whole})


class GrownForest(RandomForestClassificationModel):
    """A forest on disk (``_node_folder``); MLlib's model is loaded when it is first asked for."""

    _loaded = None

    @property
    def _java_obj(self):
        if self._loaded is None and "_node_folder" in self.__dict__:
            self._loaded = RandomForestClassificationModel.load(self._node_folder)
            self._loaded._transfer_params_to_java()
        return None if self._loaded is None else self._loaded._java_obj

    @_java_obj.setter
    def _java_obj(self, value):
        if value is not None:
            raise AttributeError("a grown forest is loaded from its folder")

    def __del__(self):
        pass          # the loaded model lets go of its own Java object

    def copy(self, extra=None):
        _ = self._java_obj
        return self._loaded.copy(extra)


def _tried_number(strategy: str, features: int, trees: int) -> int:
    """MLlib's ``featureSubsetStrategy``."""
    named = {"auto": features if trees == 1 else math.ceil(math.sqrt(features)), "all": features,
             "sqrt": math.ceil(math.sqrt(features)), "log2": max(1, math.ceil(math.log2(features))),
             "onethird": math.ceil(features / 3.0)}
    if strategy in named:
        return named[strategy]
    return min(int(strategy), features) if strategy.isdigit() else max(1, math.ceil(float(strategy) * features))


def fit(estimator: RandomForestClassifier, data: DataFrame, features: Sequence[str], key: Sequence[str],
        min_split: int = 2) -> GrownForest:
    """The forest of ``estimator`` on all rows of ``data``: columns ``features`` with at most some thousand different values
    each, a label 0 or 1, and ``key`` columns whose hash draws the rows of a tree."""
    spark: SparkSession = data.sparkSession
    get = estimator.getOrDefault
    found = data.agg(F.count(F.lit(1)).alias("n"), F.max(get("labelCol")).alias("most"),
                     *[F.collect_set(F.col(c).cast("double")).alias(f"v{j}") for j, c in enumerate(features)]).first()
    if not found.n:
        raise ValueError("no rows to train on")
    trees, classes = get("numTrees"), int(found.most) + 1
    if classes > 2:
        raise ValueError("labels are 0 and 1")
    plan = Plan([np.sort(np.array(found[f"v{j}"])) for j in range(len(features))],
                _tried_number(get("featureSubsetStrategy"), len(features), trees), get("maxDepth"), get("minInstancesPerNode"),
                min_split, get("minInfoGain"), get("impurity") == "entropy", get("subsamplingRate"), get("bootstrap"), get("seed"))
    ship(spark)
    rows = data.select(*features, get("labelCol"), F.xxhash64(F.lit(get("seed")), *key).alias("u"))
    folder = scratch_path(spark, f"grown-forest-{uuid.uuid4().hex}")
    # metadata of such a forest in MLlib's layout
    small = spark.createDataFrame([(Vectors.dense([0.0] * len(features)), float(c)) for c in range(classes)],
                                  [get("featuresCol"), get("labelCol")])
    pattern = saved(spark, estimator.fit(small), "forest-pattern")
    copy_metadata(spark, pattern, folder)
    schema = spark.read.parquet(f"{pattern}/data").schema
    arrow = to_arrow_schema(schema)
    at_once = max(1, min(trees, DEALT_ROWS // found.n))
    for first in range(0, trees, at_once):
        some = range(first, min(first + at_once, trees))
        tops: dict[int, dict] = {t: {} for t in some}
        top_nodes: list = []
        roots = {(t, 1) for t in some}
        large = sorted(roots) if found.n * plan.rate > LOCAL_ROWS else []
        while large:
            level = [r for a in range(0, len(large), NODES_AT_ONCE)
                     for r in _split_large(rows, plan, tops, large[a:a + NODES_AT_ONCE])]
            roots.difference_update(large)
            large = []
            top_nodes += [tuple(r)[:-1] for r in level]
            for r in level:
                node, rows_here, _, feature, cut, _ = np.frombuffer(r.nodes, NODE)[0].tolist()
                if feature >= 0:
                    tops[r.tree][node] = (feature, cut)
                    for side, n in ((0, r.left), (1, rows_here - r.left)):
                        roots.add((r.tree, 2 * node + side))
                        large += [(r.tree, 2 * node + side)] if n > LOCAL_ROWS else []
        nodes = _grow_dealt(rows, plan, tops, roots)
        if top_nodes:
            nodes = nodes.unionByName(spark.createDataFrame(top_nodes, PACKED))
        nodes.groupBy("tree").applyInArrow(lambda one: _layout(one, plan, classes, arrow), schema).write.mode("append").parquet(
            f"{folder}/data")
    model = estimator._copyValues(GrownForest())
    model._node_folder = folder
    return model
