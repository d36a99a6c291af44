"""Helpers of the operators: tables in the shared folder, slices of Arrow batches, word arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from imputeflow.session import ensure_checkpoint_dir

SLICE_BYTES = 12 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table into the shared folder and read it back: a lost executor costs no replay of what made it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def write_buckets(df: DataFrame, key: str, name: str) -> DataFrame:
    """Write a table into the shared folder in buckets of a key, as its tasks have it; joins by the key don't move it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    df.write.bucketBy(n, key).option("path", path).saveAsTable(table)
    return spark.table(table)


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table of ``write_table`` that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose texts hold about ``limit`` bytes; a longer row goes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def list_offsets(lists: pa.ListArray) -> np.ndarray:
    """Offsets of a list array into its flattened values, from 0."""
    return np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False),
                                          dtype=np.int64)])


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts in order, and the offset of each text's first word."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, offsets = lists.flatten(), list_offsets(lists)
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        kept = np.concatenate([[0], np.cumsum(~empty)])
        return flat.filter(pa.array(~empty)), kept[offsets]
    return flat, offsets


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of all ranges [start, start + length), one range after the other."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def take_runs(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """pool[start:start + length] for each run, one after the other."""
    return pool[ranges(starts, lengths)]


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # splitmix64


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixing bijection of unsigned 64-bit integers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def run_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for each i."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


class RecentValues:
    """A map of bounded size: when the newer half is full it becomes the older half."""

    def __init__(self, capacity: int):
        self.capacity, self.new, self.old = capacity, {}, {}

    def get_all(self, keys: list, make) -> list:
        """The values of the keys; ``make(missing keys)`` gives those that are not held."""
        new, old = self.new, self.old
        out = [new.get(k) for k in keys]
        missing = []
        for i, v in enumerate(out):
            if v is None:
                k = keys[i]
                v = old.get(k)
                if v is None:
                    missing.append(k)
                else:
                    out[i] = new[k] = v
        if missing:
            missing = list(dict.fromkeys(missing))
            made = dict(zip(missing, make(missing), strict=True))
            for i, v in enumerate(out):
                if v is None:
                    out[i] = made[keys[i]]
            new.update(made)
        if len(new) > self.capacity:
            self.old, self.new = new, {}
        return out
