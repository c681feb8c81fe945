"""Versions of laws over time, provisions, and the edges at them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import anchor_norm
from .filters import CITING_TYPES, edges
from .joins import asof_latest


def edges_at(rel: DataFrame, target, *, exact: str | None = None, prefixes: tuple[str, ...] = (), likes: tuple[str, ...] = ()) -> DataFrame:
    """Resolved edges to a document, the reverse ones left out; with an anchor, or beginnings or patterns of anchors in their normal form, only those that fit any."""
    found = edges(rel, status="resolved", exclude_types=("cited_by",)).filter(F.col("dst_id") == target)
    anchor = anchor_norm(F.col("dst_anchor"))
    if exact is not None:
        return found.filter(F.lower(F.replace(F.coalesce("dst_anchor", F.lit("")), F.lit(" "), F.lit(""))) == exact.lower().replace(" ", ""))
    tests = [anchor.startswith(p) for p in prefixes] + [anchor.like(p) for p in likes]
    return found.filter(reduce(lambda a, b: a | b, tests)) if tests else found


def readable_asof(versions: DataFrame, cutoff: str) -> DataFrame:
    """(base_id, version_id, version_date): of each base the latest version up to the cutoff that has a text; of one date the greatest id."""
    held = versions.filter(F.col("has_text") & F.col("version_date").isNotNull() & (F.col("version_date") <= F.to_date(F.lit(cutoff))))
    best = held.groupBy("base_id").agg(F.max(F.struct("version_date", "version_id")).alias("b"))
    return best.select("base_id", "b.version_id", "b.version_date")


def applicable_version_edges(rel: DataFrame, versions: DataFrame, docs: DataFrame, today: str) -> DataFrame:
    """(src_id, base_id, version_date, dst_anchor): for each citing document the version of what it cites that applied on its own date, the first edge of each anchor.

    The date is the first of updated_at, public_updated_at and decision_date that is there, else today. Edges of any status count, of the citing types, at the target or the candidate, not a law's to itself.
    """
    dates = docs.select(F.col("stable_id").alias("src_id"), F.coalesce(*(F.col(c) for c in ("updated_at", "public_updated_at", "decision_date") if c in docs.columns), F.to_date(F.lit(today))).alias("ref_date"))
    base = F.coalesce("dst_id", "candidate_id")
    cited = edges(rel, types=CITING_TYPES).withColumn("base_id", base).filter(F.col("base_id").isNotNull() & (F.col("src_id") != F.col("base_id")))
    refs = cited.select("src_id", "base_id", "dst_anchor").distinct().join(dates, "src_id")
    # one reference for each base and date: many citing documents share them
    asked = refs.select("base_id", "ref_date").distinct().withColumn("ref_id", F.xxhash64("base_id", "ref_date"))
    found = asof_latest(versions, asked).select("base_id", "ref_date", "version_date")
    return refs.join(found, ["base_id", "ref_date"]).select("src_id", "base_id", "version_date", "dst_anchor").distinct()


def projected_mentions(rel: DataFrame, versions: DataFrame, rank: DataFrame, limit: int | None = None) -> DataFrame:
    """(version_id, src_id, dst_anchor, rank): mentions of a base law, inherited by each of its versions, those of high rank first; `limit` keeps so many of a version."""
    cited = edges(rel, types=CITING_TYPES, exclude_inferred=True).withColumn("base_id", F.coalesce("dst_id", "candidate_id")).filter(F.col("base_id").isNotNull())
    rows = cited.select("src_id", "base_id", "dst_anchor").join(versions.select("version_id", "base_id"), "base_id").filter((F.col("src_id") != F.col("base_id")) & (F.col("src_id") != F.col("version_id")))
    rows = rows.join(rank.select(F.col("node").alias("src_id"), "rank"), "src_id", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    if limit is None:
        return rows.select("version_id", "src_id", "dst_anchor", "rank")
    w = Window.partitionBy("version_id").orderBy(F.desc("rank"), "src_id", "dst_anchor")
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= limit).select("version_id", "src_id", "dst_anchor", "rank")


def lineage_by_status(rel: DataFrame, base: Column) -> DataFrame:
    """Edges at a base, resolved ones by target and pending ones by candidate, as one union of two equalities in place of an OR."""
    resolved = rel.filter((F.col("status") == "resolved") & (F.col("dst_id") == base))
    return resolved.unionByName(rel.filter((F.col("status") == "pending") & (F.col("candidate_id") == base)))


def notices_decided(notices: DataFrame, decisions: DataFrame) -> DataFrame:
    """(notice_id, decision_id): pending notices (CELEX 6YYYYCNnnnn) whose judgment or order, the same number with J or O, is held in full."""
    wanted = notices.filter(F.upper("celex").rlike(r"^6\d{4}[CTF]N\d{4}$")).select(F.col("stable_id").alias("notice_id"), F.upper("celex").alias("c"))
    keys = F.transform(F.array(F.lit("J"), F.lit("O")), lambda d: F.concat(F.left("c", F.lit(6)), d, F.substr(F.col("c"), F.lit(8))))
    held = decisions.filter(F.col("has_text")).select(F.col("stable_id").alias("decision_id"), F.upper("celex").alias("key"))
    return wanted.select("notice_id", F.explode(keys).alias("key")).join(held, "key").filter("notice_id <> decision_id").select("notice_id", "decision_id").distinct()


def index_join(corpus: DataFrame, index: DataFrame, order: list) -> DataFrame:
    """corpus with the name that the first row of its slug in an index gives; null where the index has none."""
    first = index.withColumn("__r", F.row_number().over(Window.partitionBy("slug").orderBy(*order))).filter("__r = 1").drop("__r")
    return corpus.join(first, "slug", "left")


def provision_window(segments: DataFrame, wanted: DataFrame, context: int = 1) -> DataFrame:
    """(doc_id, label, text, focus): of each wanted (doc_id, label) the segment and `context` segments on either side, in order of place."""
    w = Window.partitionBy("doc_id").orderBy("char_start")
    rows = segments.withColumn("place", F.row_number().over(w))
    focus = rows.join(wanted.select("doc_id", F.col("label").alias("__l")), "doc_id").filter(F.col("label") == F.col("__l")).select("doc_id", F.col("place").alias("__at")).distinct()
    return rows.join(focus, "doc_id").filter(F.abs(F.col("place") - F.col("__at")) <= context).withColumn("focus", F.col("place") == F.col("__at")).drop("__at")


def segment_at(segments: DataFrame, offsets: DataFrame) -> DataFrame:
    """(doc_id, offset, label) of the segment that holds each place in a text."""
    return offsets.join(segments, "doc_id").filter((F.col("char_start") <= F.col("offset")) & (F.col("offset") < F.col("char_end"))).select("doc_id", "offset", "label")


def reanchored(cites: DataFrame, docs: DataFrame, radius: int = 5000) -> DataFrame:
    """cites with char_start and char_end where the reference stands now: as stored if that still holds it, else its occurrence nearest to the old place within the radius, else null."""
    rows = cites.join(docs.select("doc_id", "text"), "doc_id")
    n, old = F.length("raw"), F.col("char_start")
    same = F.substr("text", old + 1, n) == F.col("raw")
    low = F.greatest(F.lit(0), old - radius)
    around = F.substr("text", low + 1, 2 * F.lit(radius) + n)
    pieces = F.split(around, F.concat(F.lit("\\Q"), "raw", F.lit("\\E")), -1)
    # occurrences in the neighbourhood: each begins where the pieces before it and the references between them end
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    found = F.aggregate(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), start, lambda a, p: F.struct((a["at"] + F.length(p) + n).alias("at"), F.concat(a["found"], F.array(a["at"] + F.length(p))).alias("found")))["found"]
    nearest = F.array_min(F.transform(found, lambda x: F.struct(F.abs(x + low - old).alias("d"), (x + low).alias("at"))))["at"]
    place = F.when(same, old).otherwise(nearest)
    return rows.select(*(c for c in cites.columns if c not in ("char_start", "char_end")), old.alias("old_start"), place.alias("char_start"), (place + n).alias("char_end"))
