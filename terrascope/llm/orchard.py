"""Exact centroid clustering of integer vectors with Orchard's search.

Every component ``x`` becomes the integer ``floor(256 * x)`` (``x`` as double), so
sums, means and squared distances are exact and do not depend on the order in
which tasks finish.  A round is one pass over the table: each task assigns its
vectors and sends one row of sums per centroid, Spark adds them up, and the
driver holds the ``k`` centroids only.

Orchard's search: every centroid has a list of the others by distance.  A vector
walks the list of its present centroid, jumps to the list of a closer one (of two
at the same distance, the smaller number) as soon as it meets it, skips centroids
it has measured, and stops where the list is strictly beyond twice its present
distance: by the triangle inequality nothing further can win or tie.  All vectors
of a batch walk at once in numpy.

Kept are vectors of exactly ``dim`` components, none null or non-finite; other
rows, null vectors included, have no result.  Repeated rows and ids are rows of
their own; a null id counts as the empty text in the choice of the first
centroids, and rows whose ids tie there are taken by their vectors.  Fewer kept
rows than ``k`` give as many centroids as there are rows; no rows give no
rows.  Other columns are not read.  Components beyond +-2**27 (after scaling)
have no 64-bit squared distance; they raise an error instead of a wrong one.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascope.llm.common import keep_table, ship

SCALE = 256.0
LIMIT = 1 << 27
#: Vectors that walk together: bounds the arrays of a task.
WALK = 8192


@dataclass
class Model:
    centroids: np.ndarray          # (k, dim) int64


def kept_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, integers)`` of the kept vectors of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(pa.float64()))
    n = len(column)
    if not n:
        return np.zeros(0, np.int64), np.zeros((0, dim), np.int64)
    ends = column.offsets.to_numpy()
    sized = (np.diff(ends) == dim) & column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sized)
    values = column.values
    flat = values.to_numpy(zero_copy_only=False) if values.null_count == 0 else values.fill_null(np.nan).to_numpy(
        zero_copy_only=False)
    x = flat[ends[rows][:, None] + np.arange(dim)[None, :]] if len(rows) else np.zeros((0, dim))
    fine = np.isfinite(x).all(axis=1)
    rows, x = rows[fine], np.floor(x[fine] * SCALE)
    if len(x) and np.abs(x).max() > LIMIT:
        raise ValueError(f"a component exceeds {LIMIT} after scaling: its squared distance has no 64-bit value")
    return rows, x.astype(np.int64)


def neighbour_lists(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per centroid the others by squared distance (ties by number), and those distances."""
    k = len(c)
    d = np.stack([((c - row) ** 2).sum(axis=1) for row in c])
    order = np.argsort(d + 0, axis=1, kind="stable")
    order = np.stack([row[row != i] for i, row in enumerate(order)]) if k > 1 else np.zeros((k, 0), np.int64)
    return order, np.take_along_axis(d, order, axis=1)


def nearest(x: np.ndarray, c: np.ndarray, lists=None) -> tuple[np.ndarray, np.ndarray]:
    """``(centroid, squared distance)`` of every row of ``x`` by Orchard's search."""
    order, apart = lists if lists is not None else neighbour_lists(c)
    n, k = len(x), len(c)
    best, dist = np.zeros(n, np.int64), ((x - c[0]) ** 2).sum(axis=1)
    at = np.zeros(n, np.int64)
    seen = np.zeros((n, k), bool)
    seen[:, 0] = True
    live = np.arange(n) if k > 1 else np.zeros(0, np.int64)
    while len(live):
        spot = at[live] < k - 1
        live = live[spot]
        beyond = apart[best[live], at[live]] > 4 * dist[live]
        live = live[~beyond]
        other = order[best[live], at[live]]
        at[live] += 1
        new = ~seen[live, other]
        walker, other = live[new], other[new]
        seen[walker, other] = True
        d = ((x[walker] - c[other]) ** 2).sum(axis=1)
        closer = (d < dist[walker]) | ((d == dist[walker]) & (other < best[walker]))
        walker, other = walker[closer], other[closer]
        best[walker], dist[walker], at[walker] = other, d[closer], 0
    return best, dist


def _walks(column: pa.Array, dim: int, c: np.ndarray, lists):
    """Yield ``(rows, integers, centroid, distance)`` of a column in blocks."""
    rows, x = kept_rows(column, dim)
    for a in range(0, len(rows), WALK):
        part = x[a:a + WALK]
        yield (rows[a:a + WALK], part, *nearest(part, c, lists))


def first_centroids(vectors: DataFrame, id_column: str, vector_column: str, dim: int, k: int, seed: int) -> np.ndarray:
    """The ``k`` kept vectors with the smallest sha256 of ``seed:id``, in that order.

    Only rows whose hash lies below a threshold, widened until it holds ``k``
    rows, are sorted: few rows reach the driver however many tasks there are."""
    ship(vectors.sparkSession)
    v = F.col(vector_column).cast("array<double>")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    kept = vectors.where((F.size(v) == dim) & finite).select(key.alias("key"), v.alias("v"))
    total = kept.count()
    share = min(1.0, 8.0 * k / total) if total else 1.0
    while total:
        below = kept if share >= 1.0 else kept.where(F.col("key") < format(int(share * 16 ** 12), "012x"))
        got = below.orderBy("key", "v").limit(k).collect()
        if len(got) == min(k, total):
            break
        share = min(1.0, share * 8)
    else:
        return np.zeros((0, dim), np.int64)
    return kept_rows(pa.array([r.v for r in got], pa.list_(pa.float64())), dim)[1]


def train(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", dim: int = 64, k: int = 40,
          rounds: int = 5, seed: int = 2) -> Model:
    """Centroids after ``rounds`` rounds; a centroid without vectors stays."""
    c = first_centroids(vectors, id_column, vector_column, dim, k, seed)
    sums = ", ".join(f"s{i} long" for i in range(dim))
    only = vectors.select(vector_column)
    for _ in range(rounds if len(c) else 0):
        lists = neighbour_lists(c)

        def run(batches, c=c, lists=lists):
            total, count = np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)
            for batch in batches:
                for _, x, best, _ in _walks(batch.column(0), dim, c, lists):
                    np.add.at(total, best, x)
                    count += np.bincount(best, minlength=len(c))
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used), pa.array(count[used]), *[pa.array(total[used, i]) for i in range(dim)]],
                names=["cluster", "n", *[f"s{i}" for i in range(dim)]])

        found = only.mapInArrow(run, f"cluster long, n long, {sums}").groupBy("cluster").agg(
            F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(dim)]).collect()
        c = c.copy()
        for r in found:      # one row per centroid
            c[r.cluster] = [r[f"s{i}"] // r.n for i in range(dim)]
    return Model(c)


def assign(vectors: DataFrame, model: Model, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``(id, cluster, distance)`` of every kept vector."""
    ship(vectors.sparkSession)
    c, dim = model.centroids, model.centroids.shape[1]
    lists = neighbour_lists(c) if len(c) else None

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for rows, _, best, dist in _walks(batch.column(1), dim, c, lists) if len(c) else ():
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), pa.array(best.astype(np.int32)), pa.array(dist)],
                    names=["id", "cluster", "distance"])

    source = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"))
    return source.mapInArrow(run, "id long, cluster int, distance long")


def centroid_digest(row: np.ndarray) -> str:
    """Lowercase hex sha256 of a centroid's components, as decimal integers joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest()


def report(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", dim: int = 64, k: int = 40,
           rounds: int = 5, seed: int = 2) -> DataFrame:
    """``(id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every kept vector."""
    spark = vectors.sparkSession
    model = train(vectors, id_column, vector_column, dim, k, rounds, seed)
    placed = keep_table(assign(vectors, model, id_column, vector_column), "clusters")
    per = {r.cluster: r.s for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = [(i, int(per[i]), int(sum(per.values())), centroid_digest(model.centroids[i])) for i in sorted(per)]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(known), "cluster").select(      # at most k rows
        "id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
