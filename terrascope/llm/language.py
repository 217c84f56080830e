"""Language identification by error-correcting output codes.

Each language has a codeword of +1/-1 bits (all splits of the languages for a
few of them, otherwise the random code with the largest least distance of some
draws).  One logistic classifier per bit, on hashed words and character n-grams,
predicts the bit; the language with the smallest sum of logistic losses of its
codeword against the bits' margins wins, so a few wrong bits are outvoted.  Its
share of ``exp(-loss)`` is the score; texts whose second choice is nearly as
near are flagged ``ambiguous``.

The classifiers are trained in numpy on the driver, on a bounded hash sample
(``max_rows_per_language``) whose features Spark computes; prediction is one
pass over the texts without a shuffle.

Edge cases: a null text or one without letters is ``und`` with score 0; ties go
to the first language by name; repeated rows are predicted each; null languages
are not learned from; with one language every text with letters has it, with
none every text is ``und``; empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascope.llm.common import ROW, hashed_share, ship, strings, with_row
from terrascope.llm.features import dense, mean_scores, sparse_rows

BITS = 12
ORDERS = (2, 3)
SCALE = 20.0
_OUT = f"{ROW} long, id long, lang_pred string, score double, second string, ambiguous boolean"


@dataclass
class Model:
    """``weights``: buckets x bits; ``code``: languages x bits of +1/-1."""
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray = field(repr=False)
    bias: np.ndarray = field(repr=False)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """Codewords of ``n`` classes, +1/-1: every split of the classes into two
    sides for up to five classes, else the best of random codes."""
    if n < 2:
        return np.ones((n, 0), dtype=np.int8)
    if n <= 5:
        splits = np.arange(1, 1 << (n - 1))
        return np.array([[1 if c == 0 else 1 - 2 * (s >> (c - 1) & 1) for s in splits] for c in range(n)], dtype=np.int8)
    rng = np.random.default_rng(seed)
    width = max(15, int(np.ceil(10 * np.log2(n))))
    best, far = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, width))
        mixed = abs(code.sum(axis=0)) < n
        same = code[:, mixed].astype(int) @ code[:, mixed].T
        np.fill_diagonal(same, -width)
        least = (mixed.sum() - same.max()) // 2
        if least > far:
            best, far = code[:, mixed], least
    return best


def training_rows(docs: DataFrame, usable: Column, max_rows_per_language: int, id_column: str = "doc_id",
                  text_column: str = "text", lang_column: str = "lang") -> list[tuple[str, bytes, bytes]]:
    """``(language, buckets, shares)`` of about ``max_rows_per_language`` rows of
    each language (at most 1.5 times as many over all), of rows where ``usable``."""
    ship(docs.sparkSession)
    rows = docs.where(usable & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), F.col(lang_column).cast("string").alias("lang"),
        F.col(text_column).cast("string").alias("text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return []
    share = reduce(lambda c, x: c.when(F.col("lang") == x[0], F.lit(min(1.0, max_rows_per_language / x[1]))),
                   sorted(counts.items()), F).otherwise(F.lit(0.0))
    # repeated rows share an id and so a hash: the text decides among them
    chosen = rows.where(hashed_share(F.concat_ws(":", "id", F.xxhash64("text")), share))

    def run(batches):
        for batch in batches:
            got = sparse_rows(batch.column(2), BITS, ORDERS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([b for b, _ in got], pa.binary()),
                 pa.array([w for _, w in got], pa.binary())], names=["id", "lang", "b", "w"])

    found = chosen.mapInArrow(run, "id long, lang string, b binary, w binary")
    found = found.limit(int(1.5 * max_rows_per_language * len(counts))).collect()
    return [(r.lang, bytes(r.b), bytes(r.w)) for r in sorted(found, key=lambda r: (r.lang, r.id is None, r.id, r.b))]


def train(rows: list[tuple[str, bytes, bytes]], epochs: int = 6, rate: float = 2.0, batch: int = 32, decay: float = 1e-4,
          min_steps: int = 500, seed: int = 5) -> Model:
    """Fit one logistic classifier per bit, all bits of a batch at once:
    ``epochs`` passes, more if they make fewer than ``min_steps`` steps."""
    languages = sorted({r[0] for r in rows})
    code = codewords(len(languages))
    weights = np.zeros((1 << BITS, code.shape[1]), dtype=np.float32)
    bias = np.zeros(code.shape[1], dtype=np.float32)
    at = {x: i for i, x in enumerate(languages)}
    y = code[[at[r[0]] for r in rows]].astype(np.float32) if rows else np.zeros((0, 0), np.float32)
    rng = np.random.default_rng(seed)
    per_epoch = max(1, -(-len(rows) // batch))
    epochs = max(epochs, -(-min_steps // per_epoch))
    steps, step = epochs * per_epoch, 0
    for _ in range(epochs if code.shape[1] else 0):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), batch):
            some = order[a:a + batch]
            x = dense([rows[i][1:] for i in some], BITS) * SCALE
            margin = (x @ weights + bias) * y[some]
            grad = -y[some] / (1 + np.exp(np.clip(margin, -60, 60))) / len(some)
            lr = rate * (1 - step / steps)
            step += 1
            weights -= lr * (x.T @ grad + decay * weights)
            bias -= lr * grad.sum(axis=0)
    return Model(languages, code, weights * np.float32(SCALE), bias)


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(order, share)``: languages by rising loss, and ``exp(-loss)`` shares."""
    loss = np.logaddexp(0.0, -margins[:, None, :] * code[None, :, :]).sum(axis=2)
    order = np.argsort(loss, axis=1, kind="stable")
    share = np.exp(loss.min(axis=1, keepdims=True) - loss)
    return order, share / share.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, model: Model, min_gap: float = 0.2, id_column: str = "doc_id",
            text_column: str = "text") -> DataFrame:
    """``(__row, id, lang_pred, score, second, ambiguous)`` of every row;
    ``ambiguous``: the best share is less than ``min_gap`` above the second."""
    def run(batches):
        names = model.languages
        for batch in batches:
            n = batch.num_rows
            letters = np.array([any(map(str.isalpha, t)) for a in range(0, n, 1000)
                                for t in strings(batch.column(2).slice(a, 1000))], dtype=bool)
            pred, second = np.full(n, "und", dtype=object), np.full(n, None, dtype=object)
            score, near = np.zeros(n), np.zeros(n, dtype=bool)
            if names:
                margins = mean_scores(batch.column(2), model.weights, BITS, ORDERS)[:, :model.code.shape[1]] + model.bias
                order, share = decode(margins, model.code)
                label = np.array(names, dtype=object)
                rows = np.flatnonzero(letters)
                pred[rows] = label[order[rows, 0]]
                score[rows] = share[rows, order[rows, 0]]
                if len(names) > 1:
                    second[rows] = label[order[rows, 1]]
                    near[rows] = score[rows] - share[rows, order[rows, 1]] < min_gap
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score),
                 pa.array(second, pa.string()), pa.array(near)],
                names=[ROW, "id", "lang_pred", "score", "second", "ambiguous"])

    return with_row(docs, id_column, text_column).mapInArrow(run, _OUT)
