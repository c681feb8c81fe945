"""Joins beyond a plain equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def or_key_join(edges: DataFrame, docs: DataFrame, keys: tuple[str, ...], candidate: str = "candidate_id", doc_id: str = "stable_id") -> DataFrame:
    """Edges whose candidate is any of a document's keys: keys become rows, so the join stays an equality; the smallest id wins."""
    values = F.array_distinct(F.array_compact(F.array(*(F.col(k).cast("string") for k in keys))))
    by_key = docs.select(F.explode(values).alias("__key"), F.col(doc_id).alias("__doc")).groupBy("__key").agg(F.min("__doc").alias("matched"))
    return edges.join(by_key, edges[candidate].cast("string") == by_key["__key"], "left").drop("__key")


def asof_latest(versions: DataFrame, refs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each reference (ref_id, base_id, ref_date) the latest version of its base on or before its date; references without one drop out.

    Versions and references are merged by time within a base: one sort, no pair of a reference and a version is made.
    """
    v = versions.select("base_id", F.col("version_date").alias("t"), F.lit(0).alias("is_ref"), F.col("version_date").alias("found"), F.lit(None).cast(refs.schema["ref_id"].dataType).alias("ref_id"))
    r = refs.select("base_id", F.col("ref_date").alias("t"), F.lit(1).alias("is_ref"), F.lit(None).cast("date").alias("found"), "ref_id")
    from pyspark.sql import Window

    w = Window.partitionBy("base_id").orderBy("t", "is_ref").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = v.unionByName(r).withColumn("version_date", F.last("found", ignorenulls=True).over(w))
    return rows.filter((F.col("is_ref") == 1) & F.col("version_date").isNotNull()).select("ref_id", "base_id", F.col("t").alias("ref_date"), "version_date")


def band_join(rows: DataFrame, key: str, at: str, ident: str, low: float, high: float) -> DataFrame:
    """Pairs (a, b) of one key with low <= b.at - a.at <= high, a and b different; places are cut into bins as wide as the band, so a row meets two or three bins only."""
    width = max(high - low, 1e-9)
    a = rows.select(F.col(key).alias("k"), F.col(at).alias("a_at"), F.col(ident).alias("a_id")).withColumn("bin", F.explode(F.sequence(F.floor((F.col("a_at") + low) / width), F.floor((F.col("a_at") + high) / width))))
    b = rows.select(F.col(key).alias("k"), F.col(at).alias("b_at"), F.col(ident).alias("b_id"), F.floor(F.col(at) / width).alias("bin"))
    gap = F.col("b_at") - F.col("a_at")
    return a.join(b, ["k", "bin"]).filter((F.col("a_id") != F.col("b_id")) & gap.between(low, high)).select(F.col("k").alias(key), "a_id", "b_id", gap.alias("gap"))


def relational_division(edges: DataFrame, targets: list, src: str = "src_id", dst: str = "dst_id") -> DataFrame:
    """Sources with an edge to every target; fewer than two targets give none."""
    wanted = sorted(set(targets))
    if len(wanted) < 2:
        return edges.select(src).limit(0)
    return edges.filter(F.col(dst).isin(*wanted)).groupBy(src).agg(F.countDistinct(dst).alias("__n")).filter(F.col("__n") == len(wanted)).select(src)


def unheld(edges: DataFrame, docs: DataFrame, candidate: str = "candidate_id", doc_id: str = "stable_id") -> DataFrame:
    """Edges whose candidate is given but held by no document."""
    return edges.filter(F.col(candidate).isNotNull()).join(docs.select(F.col(doc_id).alias(candidate)), candidate, "left_anti")


def dangling(aliases: DataFrame, docs: DataFrame) -> DataFrame:
    """Aliases whose target is neither a document nor another alias."""
    held = aliases.join(docs.select(F.col("stable_id").alias("canonical_id")), "canonical_id", "left_anti")
    return held.join(aliases.select(F.col("alias").alias("canonical_id")).distinct(), "canonical_id", "left_anti")


def lineage(edges: DataFrame, mapping: DataFrame, inside: Column) -> DataFrame:
    """Edges to a previous provision, inherited by its current one: equal document, anchor inside the mapped one, date up to inherit_before."""
    m = mapping.select("current_id", "previous_id", "previous_anchor", "inherit_before")
    joined = edges.join(m, edges["dst_id"] == m["previous_id"])
    early = F.col("inherit_before").isNull() | (F.col("event_date") <= F.col("inherit_before"))
    return joined.filter(inside & early & (F.col("src_id") != F.col("current_id")))


def chase(aliases: DataFrame, docs: DataFrame) -> DataFrame:
    """(alias, stable_id) along chains of aliases of any length; those that end nowhere, or run in a circle, drop out.

    Each round doubles the steps taken, so a chain of n aliases takes about log n rounds; the rounds end when no pointer moves.
    """
    from ..session import cut_lineage

    held = docs.select(F.col("stable_id").alias("canonical_id")).distinct()
    step = cut_lineage(aliases.select("alias", "canonical_id").distinct().join(held.withColumn("held", F.lit(True)), "canonical_id", "left").withColumn("held", F.coalesce("held", F.lit(False))).select("alias", "canonical_id", "held"))
    limit = max(1, step.count()).bit_length() + 1  # a longer walk than there are aliases is a circle
    for _ in range(limit):
        onward = step.select(F.col("alias").alias("canonical_id"), F.col("canonical_id").alias("next"), F.col("held").alias("next_held"))
        if step.filter(~F.col("held")).join(onward, "canonical_id").isEmpty():
            break
        moved = step.filter(~F.col("held")).join(onward, "canonical_id").select("alias", F.col("next").alias("canonical_id"), F.col("next_held").alias("held"))
        step = cut_lineage(step.filter("held").unionByName(moved).distinct())
    return step.filter("held").select("alias", F.col("canonical_id").alias("stable_id")).distinct()
