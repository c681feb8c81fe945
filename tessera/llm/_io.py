"""Tables, Arrow helpers and the shared checkpoint folder."""

from __future__ import annotations

import ctypes
import sys
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where a local session names none (tests on one machine), a temporary folder stands in; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def held_out(doc_id: str = "doc_id"):
    """True for the evaluation rows: crc32 of the decimal doc_id, modulo 4, is 2 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def smallest_hashes(rows: DataFrame, by: str, n: int, most_bytes: int) -> DataFrame:
    """For each value of `by` at most n distinct rows (doc_id, by, text) and about most_bytes of texts (one text at least): those with the smallest hashes of doc_id and text.

    Rows far beyond the n-th hash are dropped in the scan by a bound from the counts (sent along: a number for each value, of
    which the caller learns a model with a row each), so only a few rows a value meet in a window.
    """
    rows = rows.select("doc_id", by, "text", F.xxhash64("doc_id", "text").alias("hash")).withColumn("draw", F.pmod("hash", F.lit(1 << 40)))
    counts = rows.groupBy(by).agg(F.count("*").alias("all"))
    few = rows.join(F.broadcast(counts), by).filter(F.col("draw") * F.col("all") <= float(1 << 40) * (2 * n + 200)).drop("all")
    return first_hashes(few, by, n, most_bytes)


def first_hashes(few: DataFrame, by: str, n: int, most_bytes: int) -> DataFrame:
    """For each value of `by` the n distinct rows (doc_id, by, text, hash) of the smallest hashes, up to about most_bytes of texts; meant for few rows."""
    few = few.withColumn("draw", F.pmod("hash", F.lit(1 << 40))).groupBy(by, "draw", "hash").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    order = Window.partitionBy(by).orderBy("draw", "hash")
    before = F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    few = few.withColumn("place", F.row_number().over(order)).withColumn("before", F.coalesce(before, F.lit(0)))
    return few.filter((F.col("place") <= n) & (F.col("before") < most_bytes)).select("doc_id", by, "text")


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function over batches; a worker gives memory back when its task ends, as workers outlive tasks."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in smaller ones, so that what is built for a batch stays small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def text_blocks(off: np.ndarray, most: int = 1 << 19):
    """Ranges of consecutive texts with about `most` bytes together; a longer text stands alone."""
    first, n = 0, len(off) - 1
    while first < n:
        last = int(np.searchsorted(off, off[first] + most, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last
