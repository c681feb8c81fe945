"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import checkpointed, lean

#: So many links at most are merged in one task; more are in rounds.
FEW = 1 << 17


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, comp) of the links of all batches."""
    parent: dict = {}
    kind = None

    def top(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            for x in (a, b):
                parent.setdefault(x, x)
            least, other = sorted((top(a), top(b)))
            parent[other] = least
    if parent:
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), kind), pa.array([top(x) for x in parent], kind)], names=["node", "comp"])


def connected(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of the links (a, b); comp is the smallest node of its component.

    Each round takes the smallest label around a node and then that label's own label, so paths shorten by
    half at least; only a count of changes reaches the driver. Rounds over few links would cost files and tasks
    for each partition, so up to FEW links are merged in one task, to the same rows. Null ends and links of a node with itself
    are passed over; no links give no rows.
    """
    links = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    if links.limit(FEW + 1).count() <= FEW:
        kind = links.schema["a"].dataType.simpleString()
        return checkpointed(links.select("a", "b").coalesce(1).mapInArrow(lean(_merged), f"node {kind}, comp {kind}"))
    edges = checkpointed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        around = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("m"))
        nearer = labels.join(around, F.col("node") == F.col("a")).select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        of = nearer.select(F.col("node").alias("x"), F.col("comp").alias("further"))
        moved = checkpointed(nearer.join(of, F.col("comp") == F.col("x")).select("node", "was", F.least("comp", "further").alias("comp")))
        labels = moved.select("node", "comp")
        if moved.filter(F.col("was") != F.col("comp")).isEmpty():
            return labels
