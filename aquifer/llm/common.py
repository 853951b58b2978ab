"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aquifer.session import checkpoint_dir

#: The white space between words, as a pattern of one word: fixed by the data contract.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\r\x0b\x0c"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which the driver and all executors share."""
    checkpoint_dir(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    root = configured or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def freeze(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of a table that has been read for the last time."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def sent(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A frozen table of two or three numbers a row, marked to be sent to all tasks if it has up to `most` rows
    (tens of MB); a larger one is joined by shuffling."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """mapInArrow, after which the worker gives back the memory that Arrow holds in reserve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The 64-bit hash of each run of n consecutive word hashes (len(words) - n + 1 of them)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    factors = mix64(np.arange(n * 100, n * 101, dtype=np.uint64)) | np.uint64(1)
    h = words[:m] * factors[0]
    for k in range(1, n):
        h += words[k:k + m] * factors[k]
    return mix64(h)


class WordHashes(dict):
    """bytes of a word -> 64-bit hash; remembers up to `limit` words, then starts anew."""

    limit = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def as_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A text column's values as UTF-8 bytes; null gives empty bytes."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batch's rows in order, in slices of up to about `most` bytes of a text column (one row at least)."""
    sizes = batch.column(column).cast(pa.binary())
    ends = np.cumsum([0 if x is None else x for x in pc.binary_length(sizes).to_pylist()])
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def keyed(docs: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, str]:
    """The rows and the name of a column that tells them apart: the id where it is unique, else a new number.

    The number is written down with the rows, so that it stays the same when a task is repeated.
    """
    counts = docs.groupBy(doc_id).count().agg(F.max("count").alias("most"), F.max(F.col(doc_id).isNull()).alias("null"))
    got = counts.first()
    if got["most"] in (None, 1) and not got["null"]:
        return docs, doc_id
    return freeze(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered"), "__row"
