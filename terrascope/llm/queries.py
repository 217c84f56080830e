"""Registered queries of the training-data operators: each applies one operator
with production parameters to its whole table and derives the result columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascope.llm.common import ROW, documents, held_out
from terrascope.session import scratch_path

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]


#: Labelled documents that a quality model is fitted on, at most.
QUALITY_ROWS = 4000


def tokenizer_path() -> str:
    """Default byte-level BPE file of the public tokenizers."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a class-based bigram model of six sevenths of them."""
    from terrascope.llm import brown
    docs = documents(spark, sf_dir)
    model = brown.train(docs, held_out("doc_id", 7, 2, equal=False))
    return brown.score(docs, model).select(
        F.col("id").alias("doc_id"), held_out("id", 7, 2).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token folder of all documents, read back from its files."""
    from terrascope.llm import token_files
    folder, path = scratch_path(spark, f"tokens-{uuid.uuid4().hex}"), tokenizer_path()
    token_files.write_token_files(documents(spark, sf_dir), folder, path, end_id=2)
    return token_files.read_token_files(spark, folder, path, end_id=2)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents linked by 4-word shingles at a Jaccard similarity of 0.85."""
    from terrascope.llm import ngram_join
    groups = ngram_join.linked_groups(documents(spark, sf_dir), k=4, percent=85)
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    from terrascope.llm import packing
    return packing.pack(documents(spark, sf_dir), tokenizer_path(), end_id=0, capacity=1024)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from four fifths of them."""
    from terrascope.llm import language
    docs = documents(spark, sf_dir)
    model = language.train(language.training_rows(docs, held_out("doc_id", 5, 0, equal=False), 1000))
    return language.predict(docs, model).select(
        F.col("id").alias("doc_id"), held_out("id", 5, 0).alias("held_out"), "lang_pred", "score", "second", "ambiguous")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one with other numbers or names."""
    from terrascope.llm import decontaminate
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    found = decontaminate.matches(documents(spark, sf_dir), items)
    return found.drop(ROW).withColumnRenamed("id", "doc_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from four fifths of the labels."""
    from terrascope.llm import quality
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").where(held_out("doc_id", 5, 0, equal=False))
    model = quality.train(quality.training_rows(docs, labels, "quality", QUALITY_ROWS))
    return quality.score(docs, model).select(
        F.col("id").alias("doc_id"), held_out("id", 5, 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts."""
    from terrascope.llm import fingerprint
    return fingerprint.edit_report(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: base spans, and costly values in credential contexts."""
    from terrascope.llm import secret_scan
    return secret_scan.report(documents(spark, sf_dir))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the URL rules on all pages."""
    from terrascope.llm import url_filter
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    judged = url_filter.judge(pages, url_filter.rules_frame(spark, URL_RULES))
    return judged.withColumnRenamed("id", "page_id")


def op11_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    from terrascope.llm import style_tree
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    return style_tree.extract(pages).select(F.col("id").alias("page_id"), "url", "text", "n_chars", "removed")


def op12_shared_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item, all items ranked together."""
    from terrascope.llm import shared_rank
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return shared_rank.search(documents(spark, sf_dir), items, k=10).select(
        "item_id", "rank", F.col("id").alias("doc_id"), "score")


def op13_orchard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 clusters of all embedding vectors after 5 rounds."""
    from terrascope.llm import orchard
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return orchard.report(vectors, k=40, rounds=5, seed=2).withColumnRenamed("id", "vec_id")


def twin_op1_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1 that SQL can say."""
    return op1_brown(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens",
                                           F.round("base_score", 4).alias("base_score"))


def twin_op3_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set sizes of op3."""
    return op3_ngram_join(spark, sf_dir).select("doc_id", "n_shingles")


def twin_op8_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited texts of op8, by their digest."""
    return op8_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def twin_op10_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op10's base spans."""
    return op10_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline`` on all documents."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_brown, op2_token_files, op3_ngram_join, op4_packing, op5_language,
                                     op6_decontaminate, op7_quality, op8_fingerprints, op9_url_filter, op10_secrets, op11_style_tree, op12_shared_rank, op13_orchard, pipeline,
                                     twin_op1_base, twin_op3_sets, twin_op8_texts, twin_op10_counts)}


def _orchard_sql(rounds: int = 5, k: int = 40, seed: int = 2) -> str:
    """Plain clustering: every vector against every centroid, round by round."""
    kept = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v
  FROM kept QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) <= {k})"""

    def placed(i: int) -> str:
        return f""",
a{i} AS MATERIALIZED (
  SELECT n, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS best FROM (
    SELECT k.n, k.vec_id, k.v, c.c, CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
    FROM kept k CROSS JOIN c{i} c) GROUP BY n)"""

    def moved(i: int) -> str:
        return f""",
c{i + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
    SELECT c, list((s - ((s % t) + t) % t) // t ORDER BY i) AS v FROM (
      SELECT best.c AS c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS t
      FROM (SELECT best, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{i}) GROUP BY best.c, i) GROUP BY c) m ON m.c = c.c)"""

    last = f"""
SELECT a.vec_id, CAST(a.best.c AS INTEGER) AS cluster, a.best.d AS distance,
       CAST(sum(a.best.d) OVER (PARTITION BY a.best.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.best.c"""
    return kept + "".join(placed(i) + moved(i) for i in range(rounds)) + placed(rounds) + last


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"
#: crc32 of the decimal text of doc_id, bit by bit.
_CRC = """xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
        lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""

SQL = {
    "twin_op1_base": f"""
WITH d AS (SELECT doc_id, {_CRC} % 7 = 2 AS held_out, list_append({_WORDS}, ' ') AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS token FROM d),
c AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY token),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n.n) AS train_tokens,
       round(sum(log10((coalesce(c.c, 0) + 1) / CAST(n.n + n.v + 1 AS DOUBLE))), 4) AS base_score
FROM t LEFT JOIN c USING (token), n GROUP BY doc_id""",
    "twin_op3_sets": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents)
SELECT doc_id, CAST(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 4 THEN 1 ELSE len(list_distinct(list_transform(
       range(1, CAST(len(w) - 2 AS BIGINT)), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS BIGINT) AS n_shingles FROM d""",
    "twin_op8_texts": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                  coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS nx
           FROM documents)
SELECT doc_id, n AS n_chars, sha256(substr(t, 1, CAST(n - n // 2 AS BIGINT)) || substr(nx, 1, CAST(n // 2 AS BIGINT))) AS edited_sha256 FROM d""",
    "twin_op10_counts": """
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(coalesce(text, ''),
         '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 8)) AS BIGINT) AS n_assign,
       CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_access,
       CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32)) AS BIGINT) AS n_hex
FROM documents""",
    "op12_shared_rank": """
WITH words AS (
  SELECT doc_id, n, unnest(w) AS term FROM (
    SELECT doc_id, w, len(w) AS n FROM (
      SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents))),
sizes AS (SELECT doc_id, any_value(n) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
tf AS (SELECT doc_id, any_value(n) AS n, term, count(*) AS tf FROM words GROUP BY doc_id, term),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
           FROM tf, total GROUP BY term),
scored AS (SELECT item_id, doc_id,
             CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
           FROM asked JOIN tf USING (term) JOIN weight USING (term), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10""",
    "op13_orchard": _orchard_sql(),
    "op9_url_filter": """
WITH rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
       ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
cut AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
               THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
won AS (SELECT p.page_id, max_by(struct_pack(rule := r.host || r.path, verdict := r.verdict),
               length(r.host || r.path)) AS w
        FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
        GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, w.rule AS rule, coalesce(w.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN won USING (page_id)""",
}
