"""Document filters and edge selectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CITING_TYPES = ("mentions", "interprets", "applies", "considers", "follows", "distinguishes", "overrules", "cites_for_fact")


def edges(rel: DataFrame, *, status: str | None = None, exclude_inferred: bool = False, exclude_types: tuple[str, ...] = (), types: tuple[str, ...] = (), exclude_self: bool = False) -> DataFrame:
    """The edges an operator counts; each operator says which."""
    if status:
        rel = rel.filter(F.col("status") == status)
    if exclude_inferred:
        rel = rel.filter(F.col("via") != "inferred")
    if exclude_types:
        rel = rel.filter(~F.col("type").isin(*exclude_types))
    if types:
        rel = rel.filter(F.col("type").isin(*types))
    return rel.filter(~F.col("src_id").eqNullSafe(F.col("dst_id"))) if exclude_self else rel


def tokenised_query(query: str, *columns: str) -> Column:
    """Every word of the query is part of some column, in any order and case."""
    words = query.lower().split()
    return reduce(lambda a, b: a & b, (reduce(lambda a, b: a | b, (F.coalesce(F.lower(F.col(c).cast("string")).contains(w), F.lit(False)) for c in columns)) for w in words), F.lit(True))


def source_or_court(scopes: list[str], carved_out: tuple[str, ...] = ("dpa-", "court-")) -> Column:
    """The source is in scope, unless the court is carved out, or the court is; no scope fits nothing."""
    if not scopes:
        return F.lit(False)
    free = reduce(lambda a, b: a & b, (~F.coalesce(F.col("court"), F.lit("")).startswith(p) for p in carved_out))
    return (F.col("source").isin(*scopes) & free) | F.coalesce(F.col("court"), F.lit("")).isin(*scopes)


def id_prefix(heads: list[str], column: str = "stable_id") -> Column:
    return reduce(lambda a, b: a | b, (F.col(column).startswith(h.strip() + "/") for h in heads), F.lit(False))


def year_range(column: str, low: int | None = None, high: int | None = None) -> Column:
    """Bounds on the year; a null date passes neither."""
    year = F.year(column)
    out = F.lit(True)
    if low is not None:
        out = out & (year >= low)
    return F.coalesce(out & (year <= high) if high is not None else out, F.lit(False))


def cites(docs: DataFrame, rel: DataFrame, target) -> DataFrame:
    """Documents with an edge to the target, pending ones too."""
    hit = rel.filter((F.col("dst_id") == target) | (F.col("candidate_id") == target)).select(F.col("src_id").alias("stable_id"))
    return docs.join(hit, "stable_id", "left_semi")


def cited_by(docs: DataFrame, rel: DataFrame, source) -> DataFrame:
    hit = rel.filter((F.col("src_id") == source) & F.col("dst_id").isNotNull()).select(F.col("dst_id").alias("stable_id"))
    return docs.join(hit, "stable_id", "left_semi")


def has_tag(docs: DataFrame, tags: DataFrame, tag: str, key: str = "doc_id") -> DataFrame:
    return docs.join(tags.filter(F.col("tag") == tag).select(key), key, "left_semi")


def retrieval_prefilter(docs: DataFrame, *, sources: list[str] | None = None, scopes: list[str] | None = None, doc_types: list[str] | None = None, year_from: int | None = None) -> DataFrame:
    """What may be retrieved: never excluded rows; an empty list of scopes fits nothing."""
    if "search_excluded" in docs.columns:
        docs = docs.filter(~F.col("search_excluded"))
    if sources is not None:
        docs = docs.filter(F.col("source").isin(*sources) if sources else F.lit(False))
    if scopes is not None:
        docs = docs.filter((F.col("source").isin(*scopes) | F.col("court").isin(*scopes)) if scopes else F.lit(False))
    if doc_types is not None:
        docs = docs.filter(F.col("doc_type").isin(*doc_types) if doc_types else F.lit(False))
    return docs.filter(F.col("decision_date") >= F.to_date(F.lit(f"{year_from}-01-01"))) if year_from else docs


def text_worklist(docs: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with text that haven't been processed."""
    return docs.filter(F.length("text") > 0).join(done.select(key), key, "left_anti")


def relevance_gate(docs: DataFrame, citations: DataFrame, gated: Column) -> DataFrame:
    """docs with search_excluded: true for gated documents without a citation."""
    held = citations.groupBy("src_id").agg(F.count("*").alias("__n")).withColumnRenamed("src_id", "stable_id")
    return docs.join(held, "stable_id", "left").withColumn("search_excluded", gated & F.col("__n").isNull()).drop("__n")
