"""Sampling and splitting (W8, W9) -- reproducible through hashing.

Both need ranks in hash order without a window over a whole group.  Rows are
counted per ``(group, hash bucket)``, a mergeable histogram; prefix sums of that
table give each bucket's offset, in two levels (buckets of a block of ``BLOCK``, then
blocks), so no window holds more than ``BLOCK`` offsets; the rank inside a bucket
(a window over ~n / 2^bits rows) completes the exact rank.

* ``sample_per_image`` keeps up to ``k`` pixels per image in hash order.  Up to
  ``GROUP_LIMIT`` rows, ``row_number() <= k`` lets Spark insert a partial group limit
  before the shuffle (WindowGroupLimit), so a huge image ships at most ``k`` rows
  per map task; beyond, buckets above the image's threshold are left out and only
  the others are ranked.
* ``stratified_split`` gives every class exactly ``round((1 - f) * n_c)``
  training rows, chosen in hash order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Hash buckets of a block of prefix sums.
BLOCK = 1024
#: Sample sizes up to which Spark limits groups before the shuffle (its own default threshold).
GROUP_LIMIT = 1000


def _md5_key(seed: int, cols: Sequence[str]) -> Column:
    """Hex md5 of ``seed:c1:c2...`` -- the same string in any SQL engine, so a
    sample or split drawn with it can be checked against an oracle."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def _hashed(df: DataFrame, key: Sequence[str], seed: int, bits: int, hash_fn: str) -> DataFrame:
    """``df`` plus ``_u``, a hash of ``key``, and ``_bucket``, its first ``bits`` bits (with md5,
    whole hex digits), so bucket order agrees with hash order."""
    if hash_fn == "md5":
        u = _md5_key(seed, key)
        bucket = F.conv(F.substring(u, 1, -(-bits // 4)), 16, 10).cast("long")
    else:
        u = F.xxhash64(F.lit(seed), *[F.col(c) for c in key])
        bucket = F.shiftrightunsigned(u, 64 - bits)
    return df.withColumn("_u", u).withColumn("_bucket", bucket)


def in_hash_share(share: float, seed: int = 42, key: Sequence[str] = ("image_id", "y", "x")) -> Column:
    """True for rows in the first ``share`` of the order that ``sample_per_image`` and ``sample_rows`` follow
    (``xxhash64``, unsigned)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) for c in key]), 11) < F.lit(int(share * (1 << 53)))


def bucket_offsets(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """``(group, _bucket, _n)`` plus ``_before``, the rows in smaller buckets of the
    group, and ``_total``: prefix sums inside blocks of buckets, then over blocks."""
    block = counts.withColumn("_block", F.shiftright("_bucket", BLOCK.bit_length() - 1))
    inside = Window.partitionBy(*group, "_block").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    blocks = block.groupBy(*group, "_block").agg(F.sum("_n").alias("_sum"))
    over = Window.partitionBy(*group).orderBy("_block")
    blocks = blocks.select(
        *group, "_block", F.coalesce(F.sum("_sum").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.sum("_sum").over(Window.partitionBy(*group)).alias("_total"))
    return (block.withColumn("_inner", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(blocks, [*group, "_block"])
            .select(*group, "_bucket", "_n", (F.col("_base") + F.col("_inner")).alias("_before"), "_total"))


def sample_per_image(df: DataFrame, k: int = 500, seed: int = 42, group: str = "image_id",
                     key: Sequence[str] = ("y", "x"), hash_fn: str = "xxhash64") -> DataFrame:
    """Up to ``k`` rows per group, without replacement, in hash order
    (``hash_fn``: ``xxhash64``, fast, or ``md5``, engine-independent)."""
    hashed = _hashed(df, [group, *key], seed, 12, hash_fn)
    if k <= GROUP_LIMIT:
        w = Window.partitionBy(group).orderBy("_bucket", "_u", *key)
        return hashed.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn", "_u", "_bucket")
    return _first_in_hash_order(hashed, k, [group], key)


def sample_rows(df: DataFrame, k: int, seed: int = 42, key: Sequence[str] = ("image_id", "y", "x"),
                hash_fn: str = "xxhash64") -> DataFrame:
    """Up to ``k`` rows of the whole table, in hash order of ``key``."""
    return _first_in_hash_order(_hashed(df, key, seed, 16, hash_fn), k, [], key)


def _first_in_hash_order(hashed: DataFrame, k: int, group: Sequence[str], key: Sequence[str]) -> DataFrame:
    counts = hashed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    if not group:      # prefix sums take a group column
        return _first_in_hash_order(hashed.withColumn("_all", F.lit(0)), k, ["_all"], key).drop("_all")
    wanted = bucket_offsets(counts, group).where(F.col("_before") < k).select(*group, "_bucket", "_before")
    w = Window.partitionBy(*group, "_bucket").orderBy("_u", *key)
    ranked = hashed.join(wanted, [*group, "_bucket"]).withColumn("_rn", F.col("_before") + F.row_number().over(w))
    return ranked.filter(F.col("_rn") <= k).drop("_rn", "_u", "_bucket", "_before")


def stratified_split(df: DataFrame, label: str = "label", key: Sequence[str] = ("image_id", "y", "x"),
                     test_fraction: float = 0.2, seed: int = 42, bits: int = 20, hash_fn: str = "xxhash64") -> DataFrame:
    """Adds ``is_train``; per class exactly ``round((1-f) * n_c)`` rows
    are training rows -- the first ones in (hash, key) order."""
    hashed = _hashed(df, key, seed, bits, hash_fn)
    offsets = bucket_offsets(hashed.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n")), [label])
    offsets = offsets.select(label, "_bucket", "_before",
                             F.round(F.lit(1.0 - test_fraction) * F.col("_total")).cast("long").alias("_n_train"))
    w = Window.partitionBy(label, "_bucket").orderBy("_u", *key)
    ranked = hashed.join(offsets, [label, "_bucket"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(w))
    return ranked.withColumn("is_train", F.col("_rank") <= F.col("_n_train")).drop(
        "_u", "_bucket", "_before", "_n_train", "_rank")
