"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words and character
n-grams (``features``), followed by a softmax over the two labels; both layers
are trained by stochastic gradient descent in numpy, in one task, on a bounded
hash sample of the labelled rows (``max_rows``; their features are computed by
Spark); only the trained weights reach the driver.  Because the softmax is linear in the
average, a trained model is one weight per bucket, and scoring is one pass over
the texts without a shuffle.

Edge cases: null and empty texts have no features and get the score of the
biases; repeated labels of a document count as their largest; labels other than
0 and 1 or null, and null ids, are not learned from; without any usable label
every score is 0.5; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascope.llm.common import ROW, hashed_share, ship, with_row
from terrascope.llm.features import dense, mean_scores, sparse_rows

BITS = 15
ORDERS = (3, 4)
SCALE = 20.0  # of the average, so that plain gradient steps suit it


@dataclass
class Model:
    """``weights[bucket]``: what an occurrence adds to the log odds of label 1."""
    weights: np.ndarray
    bias: float


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_column: str = "doc_id",
                  text_column: str = "text") -> DataFrame:
    """``(id, label, b, w)``: buckets and shares of at most ``max_rows`` labelled documents."""
    known = (labels.where(F.col(label).isin(0, 1) & F.col(id_column).isNotNull())
             .groupBy(F.col(id_column).cast("long").alias("l_id")).agg(F.max(label).cast("int").alias("label")))
    n = known.count()
    if n > max_rows:
        known = known.where(hashed_share(F.col("l_id"), 1.1 * max_rows / n))
    known = known.orderBy(F.xxhash64("l_id"), "l_id").limit(max_rows)  # a bounded table from here on
    rows = with_row(docs, id_column, text_column).join(F.broadcast(known), F.col("id") == F.col("l_id"))

    def run(batches):
        for batch in batches:
            got = sparse_rows(batch.column(2), BITS, ORDERS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([b for b, _ in got], pa.binary()),
                 pa.array([w for _, w in got], pa.binary())], names=["id", "label", "b", "w"])

    found = rows.select("id", "label", "text").mapInArrow(run, "id long, label int, b binary, w binary")
    return found.limit(max_rows)      # repeated document rows may exceed the bound again


def train(rows: DataFrame, **options) -> Model:
    """``fit`` of the training rows, in one task (their number is bounded)."""
    ship(rows.sparkSession)

    def run(batches):
        held = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
        model = fit([r[1:] for r in sorted(held)], **options)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.bias])], names=["weights", "bias"])

    got = rows.select("id", "label", "b", "w").coalesce(1).mapInArrow(run, "weights binary, bias double").first()
    return Model(np.frombuffer(got.weights, np.float32), got.bias) if got else fit([])


def fit(rows: list[tuple[int, bytes, bytes]], dim: int = 8, epochs: int = 6, rate: float = 0.5, batch: int = 32,
          min_steps: int = 1000, seed: int = 7) -> Model:
    """Fit embeddings, softmax weights and biases by stochastic gradient descent:
    ``epochs`` passes, more if they make fewer than ``min_steps`` steps."""
    if not rows:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    y = np.array([r[0] for r in rows])
    per_epoch = -(-len(rows) // batch)
    epochs = max(epochs, -(-min_steps // per_epoch))
    steps, step = epochs * per_epoch, 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), batch):
            some = order[a:a + batch]
            x = dense([rows[i][1:] for i in some], BITS)
            used = np.flatnonzero(x.any(axis=0))
            x = x[:, used] * SCALE
            hidden = x @ emb[used]
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            lr = rate * (1 - step / steps)
            step += 1
            grad = p @ out.T
            out -= lr * (hidden.T @ p)
            bias -= lr * p.sum(axis=0)
            emb[used] -= lr * (x.T @ grad)
    return Model(((emb @ (out[:, 1] - out[:, 0])) * SCALE).astype(np.float32), float(bias[1] - bias[0]))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(__row, id, score)``: probability of label 1 of every text."""
    weights, bias = model.weights, model.bias

    def run(batches):
        for batch in batches:
            z = mean_scores(batch.column(2), weights, BITS, ORDERS)[:, 0] + bias
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))],
                names=[ROW, "id", "score"])

    return with_row(docs, id_column, text_column).mapInArrow(run, f"{ROW} long, id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``."""
    ship(docs.sparkSession)
    weights, bias, at = model.weights, model.bias, docs.columns.index(text_column)

    def run(batches):
        for batch in batches:
            z = mean_scores(batch.column(at), weights, BITS, ORDERS)[:, 0] + bias
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
