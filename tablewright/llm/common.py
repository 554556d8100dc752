"""Reading, staging and batching helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.session import new_path

SLICE_BYTES = 2 << 20


#: Large blocks go back to the system at once, and Arrow takes its blocks from there as well.
_MEMORY = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "524288", "MALLOC_TRIM_THRESHOLD_": "1048576", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def lean_workers(spark: SparkSession) -> None:
    """Python workers that are started from now on keep no memory that they have freed.

    A worker outlives its tasks; without this it holds the most that any stage before took.
    """
    for name, value in _MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def write_stage(df: DataFrame, label: str, *partition_by: str) -> str:
    """Write a table to the shared folder; the path survives the loss of any executor."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage through a written table."""
    return df.sparkSession.read.schema(df.schema).parquet(write_stage(df, label))


def drop_stage(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a stage that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(conf).delete(folder, True)


def crc_part(key: str, parts: int) -> Column:
    """crc32 of a key written as text, modulo ``parts``; null keys count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def hash_bound(share: float) -> int:
    """Largest signed 64-bit hash within the given share of all hashes."""
    return min(int(share * 2.0**64) - 2**63, 2**63 - 1)


def sample_by_class(df: DataFrame, group: str, key: str, size: int) -> DataFrame:
    """At most ``size`` rows of each class, those with the smallest hash of ``key`` (column ``pick``).

    Rows are counted per class first, so that about 1.2 times ``size`` of each are ranked, however
    many there are. There are few classes: a model holds each of them on the driver anyway.
    """
    counted = {row[0]: row[1] for row in df.filter(F.col(group).isNotNull()).groupBy(group).count().collect()}
    keep = F.lit(False)
    for value, count in counted.items():
        share = min(1.0, 1.2 * (size + 50) / count)
        below = F.col("pick") <= hash_bound(share)
        keep = keep | ((F.col(group) == F.lit(value)) & below)
    order = Window.partitionBy(group).orderBy("pick", key)
    picked = df.withColumn("pick", F.xxhash64(key)).filter(keep)
    return picked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size).drop("place")


def flat_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text array in one buffer, and ``len + 1`` offsets; null counts as empty."""
    if values.null_count:
        values = values.fill_null(b"" if pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type) else "")
    large = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    _, offsets, data = values.buffers()
    kind = np.int64 if large else np.int32
    offsets = np.frombuffer(offsets, kind, len(values) + 1, values.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about ``limit`` bytes of text each, so that memory stays bounded."""
    if not batch.num_rows:
        return
    sizes = np.diff(flat_bytes(batch.column(batch.schema.get_field_index(text)))[1])
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def groups_in_order(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Groups of equal consecutive keys from batches that arrive sorted by that key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            part = batch.slice(start, end - start)
            if held and held[-1].column(held[-1].schema.get_field_index(key))[0].as_py() != keys[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)
