"""Lists of documents: standing, ranking, paging, typeahead, and unions of candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import edges, tokenised_query


def id_set(docs: DataFrame, ids: list[str], keys: tuple[str, ...] = ("stable_id", "ecli")) -> DataFrame:
    """Documents that any of their keys names."""
    return docs.filter(F.coalesce(reduce(lambda a, b: a | b, (F.col(k).cast("string").isin(*ids) for k in keys)), F.lit(False)))


def title_or_alias(docs: DataFrame, query: str, aliases: DataFrame, *columns: str) -> DataFrame:
    """Documents whose columns, or one of whose aliases, hold every word of a query; of an alias words of more than two letters count."""
    words = [w for w in query.lower().split() if len(w) > 2]
    hit = reduce(lambda a, b: a & b, (F.lower("alias").contains(w) for w in words)) if words else F.lit(False)
    named = aliases.filter(hit).select(F.col("canonical_id").alias("stable_id")).distinct().withColumn("__named", F.lit(True))
    return docs.join(named, "stable_id", "left").filter(tokenised_query(query, *columns) | F.coalesce("__named", F.lit(False))).drop("__named")


def in_scope(docs: DataFrame, doc_types: list[str] | None = None, sources: list[str] | None = None) -> DataFrame:
    """The documents a rule looks at; a list that is missing bounds nothing."""
    for column, wanted in (("doc_type", doc_types), ("source", sources)):
        if wanted:
            docs = docs.filter(F.col(column).isin(*wanted))
    return docs


def citing_worklist(docs: DataFrame, cites: DataFrame, targets: list, *, source_prefix: str | None = None, without_run=None) -> DataFrame:
    """Documents with text that cite any of the targets already, from sources of a prefix, that a run hasn't worked on."""
    rows = docs.filter(F.col("has_text")).join(cites.filter(F.col("candidate_id").isin(*targets)).select(F.col("src_id").alias("stable_id")), "stable_id", "left_semi")
    if source_prefix:
        rows = rows.filter(F.col("source").startswith(source_prefix))
    return rows if without_run is None else rows.filter(~F.col("run_id").eqNullSafe(F.lit(without_run)))


def standing(docs: DataFrame, counts: DataFrame, authority: DataFrame) -> DataFrame:
    """docs with cited_by (the most occurrences of any of their keys), authority and percentile; 0 and null without."""
    keys = docs.select("stable_id", F.explode(F.array_distinct(F.array_compact(F.array(F.col("stable_id").cast("string"), F.col("ecli").cast("string"))))).alias("candidate"))
    cited = keys.join(counts.select(F.col("candidate").cast("string").alias("candidate"), "occurrences"), "candidate").groupBy("stable_id").agg(F.max("occurrences").alias("cited_by"))
    rank = authority.select(F.col("node").alias("stable_id"), F.col("rank").alias("authority"), "percentile")
    return docs.join(cited, "stable_id", "left").join(rank, "stable_id", "left").withColumn("cited_by", F.coalesce("cited_by", F.lit(0).cast("long"))).withColumn("authority", F.coalesce("authority", F.lit(0.0)))


def listing_order(title: Column, query: str, cited: str, date: str, ident: str) -> list:
    """Exact titles, then those that begin so, then others; the most cited first, then the latest, then by id."""
    t, q = F.lower(title), query.lower()
    return [F.when(t == q, 0).when(t.startswith(q), 1).otherwise(2), F.desc(cited), F.desc_nulls_last(date), F.asc(ident)]


def collapsed_page(rows: DataFrame, family: str, order: list, limit: int) -> DataFrame:
    """A page of families: each by its best row. Rows are collapsed before the limit, so a page is never short."""
    best = rows.withColumn("__r", F.row_number().over(Window.partitionBy(family).orderBy(*order))).filter("__r = 1").drop("__r")
    return best.orderBy(*order).limit(limit)


def after_key(rows: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The next page in order of a key."""
    return (rows if after is None else rows.filter(F.col(key) > after)).orderBy(key).limit(limit)


def sampled(rows: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows at random, the same for the same seed: those with the smallest hashes of their key."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)


def typeahead(names: DataFrame, typed: str, limit: int = 20, least_docs: int = 3) -> DataFrame:
    """Names that begin as typed, with or without a leading `the`: exact ones first, then those in most documents. Blocked names, and those of too few documents, don't show."""
    q = " ".join(typed.lower().split())
    if len(q) < 2:
        return names.limit(0)
    starts = [q] if q.startswith("the ") else [q, f"the {q}"]
    name = F.lower("shorthand")
    rows = names.filter(reduce(lambda a, b: a | b, (name.startswith(s) for s in starts)) & ~F.coalesce("blocked", F.lit(False)) & (F.col("doc_count") >= least_docs))
    return rows.orderBy(F.when(name.isin(*starts), 0).otherwise(1), F.desc("doc_count"), name, "candidate_id").limit(limit)


def first_wins(lists: list[DataFrame], key: str) -> DataFrame:
    """The union of lists, each key once with what the first list that holds it says."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (x.withColumn("__list", F.lit(k)) for k, x in enumerate(lists)))
    rest = [c for c in rows.columns if c not in (key, "__list")]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), "__list").alias("__v")).select(key, "__v.*")


def citers_of_references(rel: DataFrame, refs: DataFrame, per_ref: int = 10) -> DataFrame:
    """(ref, citers): of each hanging reference its first citing documents in order of id, so many at most."""
    ref = F.coalesce(F.col("candidate_id").cast("string"), "raw")
    rows = edges(rel, status="pending", exclude_inferred=True).select(ref.alias("ref"), "src_id").distinct().join(refs.select("ref").distinct(), "ref", "left_semi")
    w = Window.partitionBy("ref").orderBy("src_id")
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= per_ref).groupBy("ref").agg(F.array_sort(F.collect_list("src_id")).alias("citers"))


def live_worklist(rel: DataFrame) -> DataFrame:
    """(ref, occurrences, citing) of pending references as they are written, inferred ones too."""
    return edges(rel, status="pending").groupBy(F.col("raw").alias("ref")).agg(F.count("*").alias("occurrences"), F.countDistinct("src_id").alias("citing"))


def inferred_citers(rel: DataFrame) -> DataFrame:
    """(dst_id, n): how many documents a model, and nothing else, has cite another; of any status."""
    return rel.filter((F.col("via") == "inferred") & ~F.col("src_id").eqNullSafe(F.col("dst_id"))).groupBy("dst_id").agg(F.countDistinct("src_id").alias("n")).filter(F.col("dst_id").isNotNull())


def citing_among(rel: DataFrame, targets: list, among: DataFrame) -> DataFrame:
    """The documents of a set that cite any of the targets, in any way."""
    return among.join(rel.filter(F.col("dst_id").isin(*targets) | F.col("candidate_id").isin(*targets)).select(F.col("src_id").alias("stable_id")), "stable_id", "left_semi")


def identities(docs: DataFrame) -> DataFrame:
    """(stable_id, identity): every key under which a document may be cited: its id, its ECLI, and the ids of documents with the same ECLI."""
    own = docs.select("stable_id", F.explode(F.array_compact(F.array("stable_id", "ecli"))).alias("identity"))
    named = docs.filter(F.col("ecli").isNotNull())
    kin = named.select("stable_id", "ecli").join(named.select("ecli", F.col("stable_id").alias("identity")), "ecli").select("stable_id", "identity")
    return own.unionByName(kin).distinct()


def merged_identities(rows: DataFrame, key: str, prefer: list) -> DataFrame:
    """(old_id, new_id): of rows that share a key the one first in order survives; nulls share nothing."""
    w = Window.partitionBy(key).orderBy(*prefer)
    ids = rows.filter(F.col(key).isNotNull()).select(F.col("stable_id").alias("old_id"), F.first("stable_id").over(w).alias("new_id"))
    return ids.filter("old_id <> new_id")
