"""Token-ID / binary output: flat unsigned-integer files with 64-bit offsets.

A token folder holds, per shard, ``tokens-*.bin`` (little-endian unsigned ids,
16 bit when the vocabulary allows, else 32), ``offsets-*.bin`` (one 64-bit
global start per document and the end of the shard) and ``ids-*.bin`` (64-bit
document ids).  Documents are in ascending id order over the shards, ties by
text hash; a null id comes first and is stored as the smallest 64-bit integer.

Three steps, none of which holds more than a slice of a shard: range-partition
the documents and write tokens and lengths (files carry the task attempt, so a
repeated attempt writes files of its own and only those named by a finished
task count); turn the shards' token counts (one row per shard) into partition
bases by a prefix sum; write global offsets per shard.  Readers memory-map the
files, so a document costs its own bytes.  All files go to one folder that
driver and executors share; a folder on another file system than a mounted one
is read and written through pyarrow's file systems.

Edge cases: a null or empty text is a document of the end id alone; repeated
rows are documents of their own; an empty table gives no shard and no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascope.llm.common import folder_fs, ship
from terrascope.llm.encode import encoder
from terrascope.llm.textvec import text_slices

NULL_ID = -(1 << 63)
_SHARD = "shard int, name string, n_docs long, n_tokens long"
_SPAN = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _mapped(folder: str, name: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the folder is mounted."""
    from pyarrow import fs
    system, base = folder_fs(folder)
    path = f"{base}/{name}"
    if isinstance(system, fs.LocalFileSystem):
        if system.get_file_info(path).size == 0:
            return np.zeros(0, dtype=dtype)
        return np.memmap(path, dtype=dtype, mode="r")
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def id_type(vocab_size: int) -> str:
    """Smallest unsigned file type that holds every id."""
    return "<u2" if vocab_size <= 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_column: str = "doc_id",
                      text_column: str = "text", shards: int | None = None) -> DataFrame:
    """Write ``docs`` as a token folder; returns its manifest ``(shard, name,
    n_docs, n_tokens, base)``, one row per shard."""
    spark = docs.sparkSession
    ship(spark)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    system, base = folder_fs(folder)
    system.create_dir(base, recursive=True)
    text = F.col(text_column).cast("string")
    ranged = (docs.select(F.col(id_column).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
              .repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h").select("id", "text"))

    def write(batches):
        enc = encoder(tokenizer)
        kind = id_type(max(enc.vocab_size, end_id + 1))
        where = TaskContext.get()
        name = f"{where.partitionId():06d}-{where.taskAttemptId()}"
        out_fs, out = folder_fs(folder)
        docs_n = tokens_n = 0
        files = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                files = {k: out_fs.open_output_stream(f"{out}/{k}-{name}.bin") for k in ("tokens", "lengths", "ids")}
            ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            for a, b, data, offs in text_slices(batch.column(1)):
                flat, bound = enc.encode_slice(data, offs)
                with_end = np.insert(flat, bound[1:], end_id)
                files["tokens"].write(with_end.astype(kind).tobytes())
                files["lengths"].write((np.diff(bound) + 1).astype("<i8").tobytes())
                files["ids"].write(ids[a:b].astype("<i8").tobytes())
                docs_n += b - a
                tokens_n += len(with_end)
        if files is not None:
            for f in files.values():
                f.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([where.partitionId()], pa.int32()), "name": [name],
                                              "n_docs": [docs_n], "n_tokens": [tokens_n]})

    shards_done = sorted(ranged.mapInArrow(write, _SHARD).collect())  # one row per shard
    bases = np.cumsum([0] + [r.n_tokens for r in shards_done])
    manifest = spark.createDataFrame([(*r, int(b)) for r, b in zip(shards_done, bases)], _SHARD + ", base long")
    manifest = manifest.repartitionByRange(max(1, len(shards_done)), "shard")

    def offsets(batches):
        out_fs, out = folder_fs(folder)
        for batch in batches:
            for r in batch.to_pylist():
                lengths = _mapped(folder, f"lengths-{r['name']}.bin", "<i8")
                starts = np.concatenate(([0], np.cumsum(lengths))) + r["base"]
                with out_fs.open_output_stream(f"{out}/offsets-{r['name']}.bin") as f:
                    f.write(starts.astype("<u8").tobytes())
            yield batch

    manifest.mapInArrow(offsets, manifest.schema).write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """One row per document of a token folder: ``(doc_id, start, n_tokens,
    ids_crc32)``, from the files alone; the CRC is over the ids as little-endian
    unsigned 32-bit integers."""
    ship(spark)
    manifest = spark.read.schema(_SHARD + ", base long").parquet(f"{folder}/manifest")
    manifest = manifest.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")

    def read(batches):
        kind = id_type(max(encoder(tokenizer).vocab_size, end_id + 1))
        for batch in batches:
            for r in batch.to_pylist():
                tokens = _mapped(folder, f"tokens-{r['name']}.bin", kind)
                starts = _mapped(folder, f"offsets-{r['name']}.bin", "<u8").astype(np.int64)
                ids = _mapped(folder, f"ids-{r['name']}.bin", "<i8")
                at = starts - starts[0]
                for a in range(0, len(ids), 10_000):
                    b = min(len(ids), a + 10_000)
                    crc = [zlib.crc32(tokens[at[d]:at[d + 1]].astype("<u4").tobytes()) for d in range(a, b)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(ids[a:b], mask=ids[a:b] == NULL_ID),
                        "start": pa.array(starts[a:b]), "n_tokens": pa.array(np.diff(at[a:b + 1])),
                        "ids_crc32": pa.array(crc, pa.int64())})

    return manifest.mapInArrow(read, _SPAN)


def read_documents(folder: str, name: str, kind: str = "<u2"):
    """``(doc ids, offsets, tokens)`` of one shard, memory-mapped; document ``d``
    is ``tokens[offsets[d] - offsets[0]:offsets[d + 1] - offsets[0]]``."""
    return (_mapped(folder, f"ids-{name}.bin", "<i8"), _mapped(folder, f"offsets-{name}.bin", "<u8"),
            _mapped(folder, f"tokens-{name}.bin", kind))
