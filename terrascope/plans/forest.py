"""Grown forests as node tables: minimum split size, and scoring in one Arrow pass.

MLlib saves a forest as a table of nodes (tree, node, children, split, class counts);
``node_table`` reads it.  MLlib has no minimum split size; ``pruned`` applies one
afterwards: a node of fewer rows than the minimum becomes a leaf, which is what
growing with that limit gives for the same draws, as a node's split never depends on
nodes below it.  The count of a node is that of its bootstrap rows.  The pruned table
is saved beside the model's metadata and loaded again, so the result is an
ordinary MLlib model.

``Forest`` holds the nodes as flat arrays and labels rows of any table batch by batch,
adding up class shares in the order of the trees as MLlib does; ``LargeForest`` does so with
some trees at a time (at most two nodes per training row and tree, and 2^(depth + 1)).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from terrascope.session import materialize, scratch_path, ship

#: Rows that walk through a tree together: bounds the arrays of a task.
WALK = 16384
#: Nodes that a task holds at once, at most, unless one tree has more.
NODES_AT_ONCE = 1_000_000
#: Columns of sums of class shares.
VOTES = "_votes"


def saved(spark: SparkSession, model, name: str) -> str:
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    model.write().save(path)
    return path


_saved = saved


def copy_metadata(spark: SparkSession, old: str, new: str) -> None:
    """The metadata of the forest saved at ``old`` beside the nodes written to ``new``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for part in ("metadata", "treesMetadata"):
        source, target = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}") for folder in (old, new))
        fs = source.getFileSystem(conf)
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, fs, target, False, conf)


def node_table(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of a forest saved at ``path``: one row per node, children as node
    numbers of the same tree (-1: a leaf), ``rows`` that reached it, ``stats`` (class
    counts, or the moments of a regression)."""
    n = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        n["split"]["featureIndex"].alias("feature"), F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        n["rawCount"].alias("rows"), n["prediction"].alias("prediction"), n["impurityStats"].alias("stats"))


def _cut(nodes: pa.Table, min_split: int) -> pa.Table:
    """One tree without splits of fewer than ``min_split`` rows, renumbered in the same order."""
    table = nodes.combine_chunks()
    data = table.column("nodeData").chunk(0) if table.num_rows else None
    if data is None:
        return table
    order = np.argsort(data.field("id").to_numpy())
    data = data.take(pa.array(order))
    left, right, rows = (data.field(c).to_numpy().copy() for c in ("leftChild", "rightChild", "rawCount"))
    inner = left >= 0
    up = np.full(len(left), -1)
    up[left[inner]], up[right[inner]] = np.flatnonzero(inner), np.flatnonzero(inner)
    # counts fall from parent to child: a child of a small node is below the cut
    keep = (up < 0) | (rows[up] >= min_split)
    leaf = inner & (rows < min_split)
    number = np.cumsum(keep) - 1
    new_left = np.where(inner & ~leaf, number[left], -1)
    new_right = np.where(inner & ~leaf, number[right], -1)
    split = data.field("split")
    feature = np.where(leaf, -1, split.field("featureIndex").to_numpy())
    at = split.field("leftCategoriesOrThreshold")
    cuts = pa.array([[] if small else v for small, v in zip(leaf, at.to_pylist())], at.type)
    split = pa.StructArray.from_arrays([pa.array(feature, pa.int32()), cuts, split.field("numCategories")], fields=list(split.type))
    gain = np.where(leaf, -1.0, data.field("gain").to_numpy())
    fields = {"id": pa.array(number, pa.int32()), "leftChild": pa.array(new_left, pa.int32()),
              "rightChild": pa.array(new_right, pa.int32()), "split": split, "gain": pa.array(gain)}
    whole = pa.StructArray.from_arrays([fields.get(f.name, data.field(f.name)) for f in data.type], fields=list(data.type))
    mask = pa.array(keep)
    return pa.table({"treeID": table.column("treeID").take(pa.array(order)).filter(mask), "nodeData": whole.filter(mask)},
                    schema=table.schema)


def pruned(spark: SparkSession, model, min_split: int):
    """The forest ``model`` without splits of fewer than ``min_split`` rows: one pass
    over its node table, a tree to a group."""
    ship(spark)
    old, new = _saved(spark, model, "grown-forest"), scratch_path(spark, f"pruned-forest-{uuid.uuid4().hex}")
    data = spark.read.parquet(f"{old}/data")
    data.groupBy("treeID").applyInArrow(lambda nodes: _cut(nodes, min_split), data.schema).write.parquet(f"{new}/data")
    copy_metadata(spark, old, new)
    cut = type(model).load(new)
    cut._node_folder = new          # its node table need not be saved again to score with it
    return cut


class Forest:
    """A classification forest as flat arrays over all trees."""

    def __init__(self, nodes: pa.Table):
        # a column after the other: no second copy of the table
        at = np.lexsort((nodes["node"].to_numpy(), nodes["tree"].to_numpy()))
        tree, left, right = (nodes[c].to_numpy()[at] for c in ("tree", "left", "right"))
        self.root = np.flatnonzero(nodes["node"].to_numpy()[at] == 0).astype(np.int32)
        start = np.repeat(self.root, np.diff(np.append(self.root, len(tree))))
        here, leaf = np.arange(len(tree), dtype=np.int32), left < 0
        # a leaf leads to itself, whatever the row
        self.left = np.where(leaf, here, left + start).astype(np.int32)
        self.right = np.where(leaf, here, right + start).astype(np.int32)
        self.feature = np.where(leaf, 0, nodes["feature"].to_numpy()[at]).astype(np.int32)
        self.threshold = np.where(leaf, np.inf, nodes["threshold"].fill_null(0.0).to_numpy()[at])
        self.share = np.concatenate([c.flatten().to_numpy() for c in nodes["stats"].chunks]).reshape(len(tree), -1)[at]
        self.share /= np.maximum(self.share.sum(axis=1, keepdims=True), 1e-300)

    @classmethod
    def of(cls, spark: SparkSession, model) -> "Forest | LargeForest":
        """The arrays of a fitted MLlib forest (the last stage of a pipeline model); kept with it."""
        stage = model.stages[-1] if hasattr(model, "stages") else model
        known = getattr(stage, "_node_arrays", None)
        if known is None:
            folder = getattr(stage, "_node_folder", None) or saved(spark, stage, "scoring-forest")
            nodes = node_table(spark, folder).drop("rows", "prediction")
            groups: list[list[int]] = []
            held = 0
            for r in nodes.groupBy("tree").count().orderBy("tree").collect():
                if not groups or held + r["count"] > NODES_AT_ONCE:
                    groups.append([])
                    held = 0
                groups[-1].append(r.tree)
                held += r["count"]
            known = cls(nodes.toArrow()) if len(groups) == 1 else LargeForest(nodes, groups)
            stage._node_arrays = known
        return known

    def votes(self, x: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """Sums of class shares over the trees for every row, added to ``start``."""
        classes = self.share.shape[1]
        out = np.zeros((len(x), classes))
        for a in range(0, len(x), WALK):
            part = np.ascontiguousarray(x[a:a + WALK])
            flat, first = part.ravel(), np.arange(len(part)) * part.shape[1]
            node = np.empty((len(part), len(self.root)), np.int32)
            for t, root in enumerate(self.root):      # the nodes of one tree stay in the cache
                at = np.full(len(part), root, np.int32)
                while True:
                    low = flat.take(first + self.feature.take(at)) <= self.threshold.take(at)
                    below = np.where(low, self.left.take(at), self.right.take(at))
                    if np.array_equal(below, at):
                        break
                    at = below
                node[:, t] = at
            # trees in their order, one after the other: the sums are MLlib's to the last bit
            for c in range(classes):
                shares = self.share[node, c]
                if start is not None:
                    shares = np.concatenate([start[a:a + WALK, c:c + 1], shares], axis=1)
                out[a:a + WALK, c] = np.cumsum(shares, axis=1)[:, -1]
        return out

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Class of every row: the largest sum of class shares, the first one of ties."""
        return self.votes(x).argmax(axis=1).astype(np.int32)

    def label(self, df: DataFrame, features: Sequence[str], out: str = "label") -> DataFrame:
        """``df`` plus the class of every row."""
        return self.scored(df, features, out)

    def scored(self, df: DataFrame, features: Sequence[str], out: str | None, start: Sequence[str] = ()) -> DataFrame:
        """``df`` plus the class of every row as ``out``, without ``start``, columns of sums of other trees to add to; or,
        without ``out``, plus sums as ``VOTES``."""
        ship(df.sparkSession)
        at = [df.columns.index(c) for c in features]
        sums = [df.columns.index(c) for c in start]
        kept = [j for j in range(len(df.columns)) if j not in sums]
        new = [(out, IntegerType())] if out else [(f"{VOTES}{c}", DoubleType()) for c in range(self.share.shape[1])]
        schema = StructType([*[df.schema.fields[j] for j in kept], *[StructField(n, kind) for n, kind in new]])
        forest, names = self, schema.names

        def run(batches):
            for batch in batches:
                def matrix(columns):
                    return np.stack([batch.column(j).to_numpy(zero_copy_only=False).astype(np.float64) for j in columns], axis=1)
                votes = forest.votes(matrix(at), matrix(sums) if sums else None)
                more = [votes.argmax(axis=1).astype(np.int32)] if out else list(votes.T)
                yield pa.RecordBatch.from_arrays([*[batch.column(j) for j in kept], *map(pa.array, more)], names=names)

        return df.mapInArrow(run, schema)


class LargeForest:
    """A forest of more nodes than a task holds: some trees after the others, the sums of class shares are
    written in between."""

    def __init__(self, nodes: DataFrame, groups: list[list[int]]):
        self.nodes, self.groups = nodes, groups

    def label(self, df: DataFrame, features: Sequence[str], out: str = "label") -> DataFrame:
        """``df`` plus the class of every row."""
        sums: list[str] = []
        for k, trees in enumerate(self.groups):
            forest = Forest(self.nodes.where(F.col("tree").between(trees[0], trees[-1])).toArrow())
            if k + 1 == len(self.groups):
                break
            df = materialize(forest.scored(df, features, None, sums), "votes")
            sums = [f"{VOTES}{c}" for c in range(forest.share.shape[1])]
            del forest          # before the next trees come to the driver
        return forest.scored(df, features, out, sums)
