"""Quality and language classifiers: held-out accuracy, plain code and edge cases."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrascope.llm import language, quality
from terrascope.llm.common import documents, held_out
from terrascope.llm.textvec import Words, text_slices
from tests.conftest import SF_MID
from tests.llm.frames import edge_docs, empty_docs, saved


def test_quality_held_out(spark):
    docs = documents(spark, SF_MID)
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    rows = quality.training_rows(docs, labels.where(held_out("doc_id", 5, 0, equal=False)), "quality", 4000)
    got = quality.score(docs, quality.train(rows)).join(
        labels.where(held_out("doc_id", 5, 0)), F.col("id") == F.col("doc_id")).toPandas()
    assert len(got) > 50 and ((got.score >= 0.3) == (got.quality == 1)).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_quality_sample_is_bounded_and_stable(spark):
    docs, labels = documents(spark, SF_MID), spark.read.parquet(f"{SF_MID}/labels.parquet")
    a = sorted(quality.training_rows(docs, labels, "quality", 50).collect())
    assert 30 <= len(a) <= 50 and a == sorted(quality.training_rows(docs.repartition(5), labels, "quality", 50).collect())


def test_quality_edge_cases(spark, tmpdir_run):
    docs = saved(edge_docs(spark), tmpdir_run + "/docs")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (None, 1, 0), (5, None, 0), (7, 3, 0), (99, 1, 0)],
                                   "doc_id long, quality int, id int")
    rows = quality.training_rows(docs, labels, "quality", 100)
    assert sorted(r.label for r in rows.collect()) == [0, 1]
    model = quality.train(rows)
    got = quality.score(docs, model).collect()
    assert len(got) == 17 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.id in (2, 3, 4)}) == 1
    kept = quality.keep_good(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == 17
    none = quality.train(quality.training_rows(docs, labels.limit(0), "quality", 100))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(empty_docs(spark), model).count() == 0


def test_language_held_out(spark):
    docs = documents(spark, SF_MID)
    model = language.train(language.training_rows(docs, held_out("doc_id", 5, 0, equal=False), 200))
    assert model.code.shape == (4, 7)
    got = language.predict(docs, model).join(docs.where(held_out("doc_id", 5, 0)), F.col("id") == F.col("doc_id")).toPandas()
    assert len(got) > 150 and (got.lang_pred == got.lang).mean() > 0.97


def test_language_edge_cases(spark, tmpdir_run):
    docs = saved(edge_docs(spark), tmpdir_run + "/docs")
    model = language.train(language.training_rows(docs, F.lit(True), 100))
    got = {r.id: r for r in language.predict(docs, model).collect()}
    assert {got[i].lang_pred for i in (2, 3, 4, 16)} == {"und"} and got[1].lang_pred == "en" and got[1].score == 1.0
    none = language.train(language.training_rows(docs.where("lang = 'xx'"), F.lit(True), 100))
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}
    assert language.predict(empty_docs(spark), model).count() == 0


@pytest.mark.parametrize("n", [2, 3, 4, 5, 8, 40])
def test_codewords(n):
    code = language.codewords(n).astype(int)
    apart = (code[:, None, :] != code[None, :, :]).sum(axis=2) + 999 * np.eye(n, dtype=int)
    assert len(code) == n and apart.min() >= max(1, code.shape[1] // 5)
    assert (abs(code.sum(axis=0)) < n).all()


def test_decoding_corrects_a_wrong_bit():
    code = language.codewords(4)
    for c in range(4):
        margins = code[c].astype(float) * 3
        margins[2] *= -0.5
        order, share = language.decode(margins[None, :], code)
        assert order[0, 0] == c and share.sum() == pytest.approx(1)
    order, share = language.decode(np.zeros((1, 7)), code)
    assert order[0].tolist() == [0, 1, 2, 3]  # a tie goes to the first


MASK = (1 << 64) - 1


def plain_mix(x):
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = ((x ^ (x >> shift)) * mult) & MASK
    return x


def plain_features(text, bits, orders, word_hash):
    """Buckets of all feature occurrences of a text, one by one."""
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", low) if w]
    out = [word_hash(w) >> (64 - bits) for w in words]
    out += [0x9D3F5A61C2B47E08 >> (64 - bits) for a, b in zip(words, words[1:]) if a == b]
    for w in words:
        padded = b" " + w + b" "
        for n in orders:
            for i in range(len(padded) - n + 1):
                gram = padded[i:i + n]
                if not (gram[:1] == b" " and gram[-1:] == b" "):
                    out.append(plain_mix((int.from_bytes(gram, "big") + (n << 56)) & MASK) >> (64 - bits))
    return out


def hash_of_word(w):
    (_, _, data, offs), = text_slices(pa.array([w], pa.binary()))
    return int(Words(data, offs).hash[0])


TEXTS = ["The river the river and  the RIVER", None, "", "  \n", "One", "é ß ñandú über a a a", "x1 y2\tz3\nq", "haus und garten im winter"]


def test_quality_scores_are_those_of_plain_code(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality.train(quality.training_rows(docs, labels, "quality", 100))
    for r in quality.score(docs, model).where("id < 8").collect():
        found = plain_features(TEXTS[r.id], quality.BITS, quality.ORDERS, hash_of_word)
        z = (sum(float(model.weights[b]) for b in found) / len(found) if found else 0.0) + model.bias
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-4)


def test_languages_are_those_of_plain_code(spark):
    rows = [(i, t, "abc"[i % 3]) for i, t in enumerate(TEXTS * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(language.training_rows(docs, F.lit(True), 100))
    for r in language.predict(docs, model).where("id < 8").collect():
        text = TEXTS[r.id]
        if not any(c.isalpha() for c in text or ""):
            assert r.lang_pred == "und"
            continue
        found = plain_features(text, language.BITS, language.ORDERS, hash_of_word)
        margin = [sum(float(model.weights[b, j]) for b in found) / len(found) + float(model.bias[j]) for j in range(model.code.shape[1])]
        loss = [sum(math.log1p(math.exp(-m * c)) for m, c in zip(margin, word)) for word in model.code.astype(float)]
        best = min(range(len(loss)), key=lambda k: loss[k])
        share = math.exp(-loss[best]) / sum(math.exp(-x) for x in loss)
        assert r.lang_pred == model.languages[best] and r.score == pytest.approx(share, rel=1e-4)
