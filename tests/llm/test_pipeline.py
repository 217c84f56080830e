"""The corpus pipeline and the registration of its operators."""

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries

from terrascope.llm import decontaminate, ngram_join, quality, secret_scan
from terrascope.llm.common import documents
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare, duck

NAMES = {1: "op1_brown", 2: "op2_token_files", 3: "op3_ngram_join", 4: "op4_packing", 5: "op5_language", 6: "op6_decontaminate",
         7: "op7_quality", 8: "op8_fingerprints", 9: "op9_url_filter", 10: "op10_secrets"}


def test_every_operator_is_registered():
    assert set(NAMES.values()) | {"pipeline"} <= set(queries())


def test_url_query_matches_sql(spark):
    ok, detail, _, _ = compare(spark, "op9_url_filter", queries()["op9_url_filter"], oracle_sql()["op9_url_filter"], SF_SMALL, duck(SF_SMALL))
    assert ok, detail


def test_result_columns(spark):
    want = {"op1_brown": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            "op2_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
            "op3_ngram_join": ["doc_id", "n_shingles", "component_id"],
            "op4_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            "op5_language": ["doc_id", "held_out", "lang_pred", "score"], "op7_quality": ["doc_id", "held_out", "score", "predicted"],
            "op8_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            "op10_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]}
    n = documents(spark, SF_SMALL).count()
    for name, columns in want.items():
        df = queries()[name](spark, SF_SMALL)
        assert df.columns[:len(columns)] == columns
        assert df.select("doc_id").distinct().count() == n, name


def test_stages(spark, tmpdir_run):
    """Each stage does to its input what its operator says, and no more."""
    docs = documents(spark, SF_SMALL)
    columns, texts = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF_SMALL)
        out.write.parquet(f"{tmpdir_run}/{name}")
        after = spark.read.parquet(f"{tmpdir_run}/{name}")
        if name != "packing":
            assert after.columns == columns
            texts[name] = {r.doc_id: r.text for r in after.collect()}
            assert set(texts[name]) <= set(before)
            if name != "secrets":
                assert all(before[i] == t for i, t in texts[name].items())
        if name == "quality":
            rows = quality.training_rows(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"), "quality", 4000)
            good = {r.id for r in quality.score(docs, quality.train(rows)).collect() if r.score >= 0.3}
            assert set(texts[name]) == good
        if name == "near_duplicates":
            groups = ngram_join.linked_groups(docs, 5, 80).collect()
            assert set(texts[name]) == {r.component_id for r in groups}
        if name == "decontamination":
            hit = {r.id for r in decontaminate.matches(docs, spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")).collect()}
            assert set(texts[name]) == set(before) - hit
        if name == "secrets":
            assert set(texts[name]) == set(before)
            for i, t in texts[name].items():
                assert not secret_scan.base_spans(t)
                if not secret_scan.base_spans(before[i]):
                    assert t == before[i]
        if name == "packing":
            assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == set(before)
        docs = after
    assert corpus_pipeline.ORACLE_SQL is None
