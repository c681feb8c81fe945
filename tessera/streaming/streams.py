"""Structured Streaming forms of the ingest semantics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def dedup(events: DataFrame, key: str, at: str = "ts", late: str = "2 days") -> DataFrame:
    """Each id once, as long as its repeats arrive within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def sliding_counts(events: DataFrame, by: str, at: str = "ts", length: str = "1 hour", step: str = "15 minutes", late: str = "2 days") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, length, step), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")


def sessions(events: DataFrame, by: str, at: str = "ts", gap: str = "150 seconds", late: str = "2 days") -> DataFrame:
    """Leases: a session of a key ends when no event came for the gap."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def daily(events: DataFrame, kind: str, at: str = "ts", late: str = "2 days") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, "1 day"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("day"), kind, "n", "total")


def budget(events: DataFrame, by: str, limit: int, seconds: int, at: str = "ts") -> DataFrame:
    """(key, ts, allowed, retry_after): a rolling budget of `limit` events in `seconds`; only allowed ones use it, and a refused one says how long until the oldest leaves."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        used = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(at)
        out = []
        for t in rows[at]:
            s = t.timestamp()
            used = [u for u in used if u > s - seconds]
            ok = len(used) < limit
            out.append((key[0], t, ok, 0.0 if ok else used[len(used) - limit] + seconds - s))
            if ok:
                used.append(s)
        state.update((used,))
        yield pd.DataFrame(out, columns=["key", "ts", "allowed", "retry_after"])

    kind = events.schema[by].dataType.simpleString()
    return events.groupBy(by).applyInPandasWithState(step, f"key {kind}, ts timestamp, allowed boolean, retry_after double", "used array<double>", "append", "NoTimeout")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All that is there now, into Parquet, exactly once."""
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").option("path", path).outputMode("append").start().awaitTermination()


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """The final state of an aggregate, as Parquet in a shared folder: each micro-batch replaces the table, and nothing passes through the driver."""

    def replace(rows: DataFrame, _: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").outputMode("complete").foreachBatch(replace).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/rows")
