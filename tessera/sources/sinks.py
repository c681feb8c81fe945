"""Sinks: rows to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def put_objects(rows: DataFrame, held: DataFrame | None, path: str) -> None:
    """Content under its hash, once: objects that are held aren't written again."""
    new = rows.dropDuplicates(["hash"])
    if held is not None:
        new = new.join(held.select("hash"), "hash", "left_anti")
    new.withColumn("head", F.substring("hash", 1, 2)).write.mode("append").partitionBy("head").parquet(path)


def shards(chunks: DataFrame, most: int, doc_id: str = "doc_id", buckets: int = 1) -> DataFrame:
    """chunks with shard: about `most` chunks each and never a document in two. Documents are dealt to buckets by a hash and packed in order
    inside them, so that no task sees them all."""
    sizes = chunks.groupBy(doc_id).agg(F.count("*").alias("__n")).withColumn("__b", F.pmod(F.xxhash64(doc_id), F.lit(buckets)))
    w = Window.partitionBy("__b").orderBy(doc_id).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("shard", F.concat_ws("-", F.col("__b"), F.floor(F.coalesce(F.sum("__n").over(w), F.lit(0)) / most)))
    return chunks.join(sizes.select(doc_id, "shard"), doc_id)


def write_shards(sharded: DataFrame, path: str) -> None:
    sharded.write.partitionBy("shard").option("compression", "gzip").json(path)


def import_vectors(chunks: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """(doc_id, chunk_id, vector): vectors joined to their chunks by id, of the right length, scaled to 1."""
    from ..functions.legal import l2_normalise

    good = vectors.filter(F.size("vector") == dims)
    return chunks.select("doc_id", "chunk_id").join(good, ["doc_id", "chunk_id"]).withColumn("vector", l2_normalise(F.col("vector")))


def as_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", "true").csv(path)
