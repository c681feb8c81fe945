"""Windows, sorts, top-k and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def sort_order(name: str) -> list:
    """Named orders; nulls come last and ids break ties."""
    return {
        "date": [F.desc_nulls_last("decision_date"), F.asc("stable_id")], "date_asc": [F.asc_nulls_last("decision_date"), F.asc("stable_id")], "title": [F.asc_nulls_last("title"), F.asc("stable_id")],
        "cited": [F.desc_nulls_last("cited_by"), F.asc("stable_id")], "authority": [F.desc_nulls_last("pagerank"), F.asc("stable_id")], "authority_recent": [F.desc_nulls_last("pagerank_decayed"), F.asc("stable_id")],
    }[name]


def newest_n(rows: DataFrame, by: str, order: list, n: int) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("__r") <= n).drop("__r")


def rolling_counts(rows: DataFrame, by: str, at: str, windows: dict[str, int]) -> DataFrame:
    """rows with, for each window, how many rows of the key lie in the seconds before and at this one."""
    seconds = F.unix_micros(at)
    for name, s in windows.items():
        rows = rows.withColumn(name, F.count("*").over(Window.partitionBy(by).orderBy(seconds).rangeBetween(-s * 1_000_000, 0)))
    return rows


def relevance_band(title: Column, query: str) -> Column:
    q = query.lower()
    t = F.lower(title)
    return F.when(t == q, 0).when(t.startswith(q), 1).when(t.contains(q), 2).otherwise(3)


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def capped_count(rows: DataFrame, cap: int) -> DataFrame:
    """One row: how many rows there are up to cap, and whether there are more; a scan stops beyond cap."""
    return rows.limit(cap + 1).agg(F.count("*").alias("seen")).select(F.least("seen", F.lit(cap)).cast("long").alias("n"), (F.col("seen") > cap).alias("more"))


def collapse_versions(rows: DataFrame, family: str, version: str, rank: str) -> DataFrame:
    """The best version of each family, with the family's first rank."""
    w = Window.partitionBy(family)
    best = F.row_number().over(w.orderBy(F.desc("has_text"), F.desc(version)))
    return rows.withColumn("first_rank", F.min(rank).over(w)).withColumn("__r", best).filter("__r = 1").drop("__r")


def running_total(rows: DataFrame, order: list, amount: Column, name: str) -> DataFrame:
    """rows with the sum of the amount over all rows up to this one in a total order.

    Rows are dealt by ranges of the order; each task sums its own, and the totals of the ranges before, a row
    for each range, are added, so no task sees all rows.
    """
    dealt = cut_lineage(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).withColumn("__n", amount))
    sums = dealt.groupBy("__range").agg(F.sum("__n").alias("__sum"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__range", "__before")
    own = F.sum("__n").over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.join(F.broadcast(before), "__range").withColumn(name, own + F.col("__before")).drop("__range", "__n", "__before")  # before has a row for each partition


def rank_all(rows: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """rows with their place from 1 in a total order of any number of rows."""
    return running_total(rows, order, F.lit(1), name).withColumn(name, F.col(name).cast("int"))


def percentile_among(rows: DataFrame, score: str, counted: Column) -> DataFrame:
    """rows with percentile: 100 * the share of counted rows that score as much or less; null for the others."""
    inside = rows.filter(counted)
    total = inside.agg(F.count("*").alias("__all"))
    steps = running_total(inside.groupBy(score).agg(F.count("*").alias("__here")), [F.col(score)], F.col("__here"), "__upto").drop("__here")
    found = inside.join(steps, score).join(F.broadcast(total)).withColumn("percentile", 100.0 * F.col("__upto") / F.col("__all")).drop("__upto", "__all")  # total is one row
    return found.unionByName(rows.filter(~counted).withColumn("percentile", F.lit(None).cast("double")), allowMissingColumns=True)


def gap_groups(rows: DataFrame, by: str, start: str, end: str, most: float) -> DataFrame:
    """rows with group: it rises where the gap to the row before is larger than `most`."""
    w = Window.partitionBy(by).orderBy(start, end)
    fresh = F.coalesce((F.col(start) - F.lag(end).over(w) > most).cast("int"), F.lit(0))
    return rows.withColumn("__new", fresh).withColumn("group", F.sum("__new").over(w)).drop("__new")


def nearest_before(rows: DataFrame, by: str, at: str, wanted: Column, value: str, most: float) -> DataFrame:
    """rows with the value of the nearest wanted row before, if it is near enough."""
    w = Window.partitionBy(by).orderBy(at, value).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(wanted, F.struct(F.col(at).alias("at"), F.col(value).alias("value"))), ignorenulls=True).over(w)
    return rows.withColumn("__s", seen).withColumn("nearest", F.when(F.col(at) - F.col("__s.at") <= most, F.col("__s.value"))).drop("__s")
