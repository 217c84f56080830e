"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascope.session import scratch_path, ship

ROW = "__row"


def folder_fs(folder: str):
    """``(file system, path)`` of a folder named by a path or a URI."""
    from pyarrow import fs
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def keep_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: cuts
    lineage, and a lost executor re-reads files instead of recomputing."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin_splits(spark: SparkSession) -> None:
    """Make the splits of files independent of the number of live executors, so
    that a later scan (after executors came or went) numbers rows as the first
    did: the present default is set where the user has set none."""
    key = "spark.sql.files.minPartitionNum"
    if not spark.conf.get(key, None):
        spark.conf.set(key, spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
                       or str(spark.sparkContext.defaultParallelism))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without_rows(df: DataFrame, rows: DataFrame, row: str) -> DataFrame:
    """``df`` without the rows whose number (see ``number_rows``) is in ``rows``."""
    number, gone = free_name(df, "__number"), free_name(df, "__gone")
    listed = rows.select(F.col(row).alias(gone))
    return number_rows(df, number).join(listed, F.col(number) == F.col(gone), "left_anti").drop(number)


def stable_rows(df: DataFrame) -> DataFrame:
    """``df`` if it is a plain scan of files, whose rows every scan numbers alike
    (``number_rows``), else a written copy of it."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    return df if "LogicalRelation" in node.getClass().getSimpleName() else keep_table(df, "rows")


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """``df`` plus a row number.  The number follows the files and their splits,
    so every scan of the same files gives the same; ``df`` is a table read from
    files (or a checkpoint; see ``stable_rows``)."""
    pin_splits(df.sparkSession)
    return df.withColumn(name, F.monotonically_increasing_id())


def with_row(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(__row, id, text)``: other columns are dropped, so they cannot clash.
    ``__row`` (see ``number_rows``) tells repeated ids apart."""
    ship(df.sparkSession)
    pin_splits(df.sparkSession)
    return df.select(F.monotonically_increasing_id().alias(ROW),
                     F.col(id_column).cast("long").alias("id"),
                     F.col(text_column).cast("string").alias("text"))


def held_out(id_column: str, modulus: int, remainder: int, equal: bool = True) -> Column:
    """True where crc32(id as text) mod ``modulus`` is (or is not) ``remainder``;
    a null id counts as the empty text."""
    crc = F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary"))
    return (crc % modulus == remainder) if equal else (crc % modulus != remainder)


def strings(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null reads as the empty string."""
    return [x if x is not None else "" for x in column.to_pylist()]


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once: inside another lambda a plain
    expression would be evaluated again for every element."""
    return F.transform(F.array(value), use)[0]


def hashed_share(key: Column, share: Column | float) -> Column:
    """True for about ``share`` of the keys, by their hash: every row of a key or none."""
    return F.pmod(F.xxhash64(F.lit(17), key), F.lit(1 << 20)) < F.lit(1 << 20) * share


def hash_bitmap(hashes: DataFrame, column: str, bits: int = 23):
    """A bitmap of ``2**bits`` bits (numpy; its size does not follow the input)
    with a bit for the top bits of every 64-bit hash; Spark sets the bits, and at
    most ``2**bits / 64`` words reach the driver."""
    import numpy as np
    bit = F.shiftrightunsigned(column, 64 - bits)
    word = hashes.select(bit.alias("b")).distinct().groupBy(F.shiftright("b", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(b & 63 AS int))")).alias("x"))
    got = word.toArrow()
    words = np.zeros(1 << (bits - 6), dtype=np.uint64)
    words[got["w"].to_numpy()] = got["x"].to_numpy().view(np.uint64)
    return words


def in_bitmap(words, hashes):
    """True where a hash (unsigned) may be among those of the bitmap."""
    import numpy as np
    at = (hashes >> np.uint64(64 - 6 - (len(words).bit_length() - 1))).astype(np.int64)
    return (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
