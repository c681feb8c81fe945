"""Roll-ups over documents and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import CITING_TYPES, edges


def n(name: str = "n") -> Column:
    return F.count("*").alias(name)


def worklist(rel: DataFrame, docs: DataFrame, special_source: str = "F", min_citing: int = 1) -> DataFrame:
    """Hanging references, one row each: how often and by how many documents they are cited, and whether one of a given source does."""
    special = docs.filter(F.col("source") == special_source).select(F.col("stable_id").alias("src_id"), F.lit(True).alias("special"))
    pending = edges(rel, status="pending", exclude_inferred=True).join(special, "src_id", "left")
    key = F.coalesce(F.col("candidate_id").cast("string"), F.col("raw")).alias("ref")
    out = pending.groupBy(key).agg(
        F.max("candidate_id").alias("candidate_id"), F.min("raw").alias("raw"), F.min("dst_anchor").alias("anchor"), F.array_join(F.array_sort(F.collect_set("via")), ",").alias("via"),
        n("occurrences"), F.countDistinct("src_id").alias("citing"), F.coalesce(F.bool_or("special"), F.lit(False)).alias("special"),
    )
    return out.filter(F.col("citing") >= min_citing)


def citation_counts(rel: DataFrame) -> DataFrame:
    return rel.filter(F.col("candidate_id").isNotNull()).groupBy("candidate_id", F.col("type").alias("kind")).agg(F.min("via").alias("method"), F.min("raw").alias("raw"), n("occurrences"), F.countDistinct("src_id").alias("documents"))


def corpus_shape(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source", "doc_type", "court", F.year("decision_date").alias("year")).agg(n(), F.sum(F.col("weight").isNotNull().cast("long")).alias("with_weight"))


def corpus_counts(shape: DataFrame, key: str) -> DataFrame:
    """Counts by one key, from the shape; null is `?`."""
    return shape.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("?")).alias(key)).agg(F.sum("n").alias("n"))


def source_stats(rel: DataFrame, docs: DataFrame) -> DataFrame:
    found = edges(rel, status="resolved", exclude_self=True).join(docs.select(F.col("stable_id").alias("src_id"), "source"), "src_id")
    return found.groupBy("source").agg(n("resolved"), F.countDistinct("dst_id").alias("targets"))


def date_ranges(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(n(), F.min("decision_date").cast("string").alias("first"), F.max("decision_date").cast("string").alias("last"), F.count_if(F.col("decision_date").isNull()).alias("undated"))


def queue_depths(rel: DataFrame) -> DataFrame:
    pending = F.col("status") == "pending"
    return rel.agg(F.count_if(pending).alias("pending"), F.count_if(pending & F.col("candidate_id").isNull()).alias("unnamed"), F.count_if(F.col("via") == "inferred").alias("inferred"), F.count_if(F.col("status") == "resolved").alias("resolved"))


def resolution_coverage(rel: DataFrame, *by: str) -> DataFrame:
    return rel.groupBy(*by).agg(n("total"), F.count_if(F.col("status") == "resolved").alias("resolved")).withColumn("ratio", F.round(F.when(F.col("total") > 0, F.col("resolved") / F.col("total")).otherwise(0.0), 6))


def facets(docs: DataFrame, keys: tuple[str, ...], top: int | None = 40) -> DataFrame:
    """(facet, value, n) of several keys in one pass; null values drop out and each facet is cut to its most frequent."""
    from pyspark.sql import Window

    typed = docs.select(*(F.col(k).cast("string").alias(k) for k in keys))
    grouped = typed.groupingSets([[F.col(k)] for k in keys], *(F.col(k) for k in keys)).agg(F.grouping_id().alias("gid"), n())
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, k in enumerate(keys):  # a grouping id has a 1 for every key that isn't grouped by
        here = F.col("gid") == (2 ** len(keys) - 1) - 2 ** (len(keys) - 1 - i)
        name, value = F.when(here, F.lit(k)).otherwise(name), F.when(here, F.col(k)).otherwise(value)
    out = grouped.select(name.alias("facet"), value.alias("value"), "n").filter(F.col("value").isNotNull())
    if top is None:
        return out
    w = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    return out.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= top).drop("__r")


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.countDistinct("doc_id").alias("documents"))


def coverage(docs: DataFrame, done: DataFrame, *by: str) -> DataFrame:
    """How many documents with text are in `done`."""
    have = done.select("doc_id", F.lit(1).alias("__one")).distinct()
    return docs.filter(F.length("text") > 0).join(have, "doc_id", "left").groupBy(*by).agg(n("with_text"), F.count("__one").alias("covered"))


def cited_by_counts(rel: DataFrame) -> DataFrame:
    return edges(rel, status="resolved", exclude_inferred=True, exclude_types=("cited_by",), exclude_self=True).groupBy("dst_id").agg(F.countDistinct("src_id").alias("cited_by"))


def cited_by_types(rel: DataFrame) -> DataFrame:
    return edges(rel, status="resolved", exclude_inferred=True, exclude_types=("cited_by",), exclude_self=True).groupBy("dst_id", "type").agg(F.countDistinct("src_id").alias("citing"))


def cited_by_breakdown(rel: DataFrame, docs: DataFrame) -> DataFrame:
    found = edges(rel, status="resolved", exclude_inferred=True, exclude_types=("cited_by",), exclude_self=True)
    return found.join(docs.select(F.col("stable_id").alias("src_id"), "source", "court", "doc_type"), "src_id").groupBy("source", "court", "doc_type").agg(F.countDistinct("src_id").alias("citing"))


def cited_by_stats(rel: DataFrame, docs: DataFrame, since: str) -> DataFrame:
    found = edges(rel, status="resolved", exclude_inferred=True, exclude_types=("cited_by",), exclude_self=True)
    recent = found.join(docs.select(F.col("stable_id").alias("src_id"), "decision_date"), "src_id", "left")
    return recent.groupBy("dst_id").agg(F.countDistinct("src_id").alias("total"), F.countDistinct(F.when(F.col("decision_date") >= F.to_date(F.lit(since)), F.col("src_id"))).alias("recent"))


def family_citers(rel: DataFrame, family: Column) -> DataFrame:
    """Distinct citers with versions of one text taken as one."""
    found = edges(rel, status="resolved", exclude_inferred=True, types=CITING_TYPES, exclude_self=True)
    return found.groupBy("dst_id").agg(F.countDistinct(family).alias("citers"))


def combined_citers(rel: DataFrame) -> DataFrame:
    """Distinct citers of a target, whether resolved to it or only naming it."""
    found = edges(rel, exclude_inferred=True, types=CITING_TYPES).select("src_id", F.coalesce("dst_id", "candidate_id").alias("target")).filter(F.col("target").isNotNull() & (F.col("src_id") != F.col("target")))
    return found.groupBy("target").agg(F.countDistinct("src_id").alias("citers"))


def result_set_cites(rel: DataFrame, docs: DataFrame) -> DataFrame:
    """What a set of documents cites."""
    return edges(rel, status="resolved").filter(F.col("dst_id").isNotNull()).join(docs.select(F.col("stable_id").alias("src_id")), "src_id", "left_semi").groupBy("dst_id").agg(F.countDistinct("src_id").alias("citing"))


def authority_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("candidate_id").agg(F.max("occurrences").alias("occurrences"))


def outgoing_targets(rel: DataFrame, docs: DataFrame) -> DataFrame:
    return edges(rel, exclude_inferred=True).join(docs.select(F.col("stable_id").alias("src_id"), "source"), "src_id").groupBy("source", "dst_id", "raw").agg(n())


def dominant(counts: DataFrame, key: str, value: str, size: str, times: int = 3) -> DataFrame:
    """The most frequent value of each key, null unless it is unrivalled or `times` as frequent as the next."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.desc(size), value)
    ranked = counts.withColumn("__r", F.row_number().over(w)).filter("__r <= 2")
    first, second = F.max(F.when(F.col("__r") == 1, F.col(size))), F.max(F.when(F.col("__r") == 2, F.col(size)))
    top = F.max(F.when(F.col("__r") == 1, F.col(value)))
    return ranked.groupBy(key).agg(F.when(second.isNull() | (first >= times * second), top).alias(value))


def shorthand_evidence(rows: DataFrame, shorthand: str, candidate: str, doc: str, least: int = 3) -> DataFrame:
    return rows.groupBy(shorthand, candidate).agg(F.countDistinct(doc).alias("documents")).filter(F.col("documents") >= least)


def share(docs: DataFrame, hit: Column, *by: str) -> DataFrame:
    return docs.groupBy(*by).agg(F.round(F.avg(hit.cast("double")), 6).alias("share"))


def source_alerts(stats: DataFrame, *, failures: int = 3, stale_days: int = 14, ratio: float = 0.5, least_docs: int = 10) -> DataFrame:
    """(source, alert) rows for sources that fail, are stale, or lean on a model too much."""
    found = F.array_compact(F.array(
        F.when(F.col("failures") >= failures, F.lit("failing")), F.when((F.col("stale_days") >= stale_days) & (F.col("docs") > 0), F.lit("stale")), F.when((F.col("ratio") >= ratio) & (F.col("docs") >= least_docs), F.lit("model_ratio")),
    ))
    return stats.select("source", F.explode(found).alias("alert"))
