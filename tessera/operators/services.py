"""What a reader asks of the corpus: look-ups, mentions, hanging references, slices, proceedings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import display_kind, excerpt, jurisdiction, normalise_candidate, register_link
from ..functions.legal import match_reference
from ..functions.text import anchor_in_family, anchor_norm
from .filters import edges
from .resolve import route


def lookup(asked: DataFrame, docs: DataFrame, aliases: DataFrame, preview: int = 600) -> DataFrame:
    """(citation, candidate, stable_id, held, preview, truncated, link): each citation with the document it names, by its id, its shape or an alias, the start of its text, and where it can be read if it isn't held."""
    text = F.trim("citation")
    rows = asked.filter(text != "").select("citation", text.alias("__t"), F.coalesce(match_reference(text)["candidate"], text).alias("candidate"))
    names = aliases.groupBy(F.lower("alias").alias("__a")).agg(F.min("canonical_id").alias("__by_name"))
    rows = rows.join(names, F.lower("__t") == F.col("__a"), "left")
    held = docs.select("stable_id", "text")
    direct = rows.join(held.select(F.col("stable_id").alias("__d")), F.col("candidate") == F.col("__d"), "left")
    found = direct.withColumn("stable_id", F.coalesce("__d", "__by_name")).drop("__d", "__a", "__by_name", "__t").join(held.withColumn("held", F.lit(True)), "stable_id", "left")
    return found.select("citation", "candidate", F.when(F.col("held"), F.col("stable_id")).alias("stable_id"), F.coalesce("held", F.lit(False)).alias("held"), F.left("text", F.lit(preview)).alias("preview"), (F.length("text") > preview).alias("truncated"), F.when(F.col("held").isNull(), register_link(F.col("candidate"))).alias("link"))


def passage(docs: DataFrame, segments: DataFrame, asked: DataFrame, context: int = 0) -> DataFrame:
    """(doc_id, label, passage): the asked segment of each document with `context` segments on either side, as text."""
    from .provisions import provision_window

    rows = provision_window(segments, asked, context).join(docs.select("doc_id", "text"), "doc_id")
    spans = rows.groupBy("doc_id").agg(F.max(F.when(F.col("focus"), F.col("label"))).alias("label"), F.min("char_start").alias("a"), F.max("char_end").alias("z"), F.first("text").alias("text"))
    return spans.select("doc_id", "label", F.substr("text", F.col("a") + 1, F.col("z") - F.col("a")).alias("passage"))


def mentions(rel: DataFrame, rank: DataFrame, target, anchor: str | None = None) -> DataFrame:
    """(src_id, type, n, pins, rank): who cites a document, or a part of it with all below that, one row for each document and type; ranked over the whole set."""
    found = edges(rel, status="resolved", exclude_inferred=True, exclude_types=("cited_by",), exclude_self=True).filter(F.col("dst_id") == target)
    if anchor is not None:
        found = found.filter(anchor_in_family(anchor_norm(F.col("dst_anchor")), anchor_norm(F.lit(anchor))))
    rows = found.groupBy("src_id", "type").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("dst_anchor")).alias("pins"))
    return rows.join(rank.select(F.col("node").alias("src_id"), "rank"), "src_id", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))


def mention_facets(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(facet, value, n) of all mentions, whatever page of them is shown."""
    rows = found.select("src_id", "type").join(docs.select(F.col("stable_id").alias("src_id"), "source", "court"), "src_id", "left")
    sides = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in ("type", "source", "court")))
    return rows.select("src_id", F.explode(sides).alias("f")).filter("f.value IS NOT NULL").groupBy("f.facet", "f.value").agg(F.countDistinct("src_id").alias("n"))


def unresolved(rel: DataFrame, least: int = 1) -> DataFrame:
    """(ref, citing, occurrences, form, adapter, needs_identifier): hanging references, URLs under the id they stand for, so that they meet other spellings; anchors like `#` and inferred edges don't count."""
    raw = F.trim("raw")
    rows = edges(rel, status="pending", exclude_inferred=True).filter(~F.coalesce(raw, F.lit("")).rlike(r"^#|^$") | F.col("candidate_id").isNotNull())
    candidate = normalise_candidate(F.col("candidate_id").cast("string"), F.col("raw"))
    rows = rows.select("src_id", F.coalesce(candidate, raw).alias("ref"), candidate.isNull().alias("__none"))
    out = rows.groupBy("ref").agg(F.countDistinct("src_id").alias("citing"), F.count("*").alias("occurrences"), F.bool_and("__none").alias("needs_identifier")).filter(F.col("citing") >= least)
    r = route(F.col("ref"))
    return out.select("ref", "citing", "occurrences", r["form"].alias("form"), r["adapter"].alias("adapter"), "needs_identifier")


def resolved_by_hand(rel: DataFrame, choices: DataFrame) -> DataFrame:
    """rel with pending edges at a reference resolved to the document somebody chose for it; choices: (ref, stable_id)."""
    ref = F.coalesce(F.col("candidate_id").cast("string"), F.col("raw"))
    rows = rel.join(choices.select(F.col("ref").alias("__ref"), F.col("stable_id").alias("__to")), (F.col("status") == "pending") & (ref == F.col("__ref")), "left")
    return rows.withColumn("dst_id", F.coalesce("__to", "dst_id")).withColumn("status", F.when(F.col("__to").isNotNull(), "resolved").otherwise(F.col("status"))).select(*rel.columns)


def reference_context(cites: DataFrame, docs: DataFrame, before: int = 120, after: int = 260) -> DataFrame:
    """cites (doc_id, char_start, char_end, ...) with snippet and where the reference is in it."""
    rows = cites.join(docs.select("doc_id", "text"), "doc_id")
    e = excerpt(F.col("text"), F.col("char_start"), F.col("char_end"), before, after)
    return rows.withColumn("__e", e).select(*cites.columns, F.col("__e.text").alias("snippet"), F.col("__e.start").alias("mark_start"), F.col("__e.end").alias("mark_end"))


def shape(docs: DataFrame, rank: DataFrame, top: int = 5) -> DataFrame:
    """(jurisdiction, kind, n, top): how many documents of each kind, and the ids of those with the highest rank."""
    rows = docs.select("stable_id", jurisdiction(F.col("source")).alias("jurisdiction"), display_kind(F.col("doc_type")).alias("kind")).join(rank.select(F.col("node").alias("stable_id"), "rank"), "stable_id", "left")
    w = Window.partitionBy("jurisdiction", "kind").orderBy(F.desc_nulls_last("rank"), "stable_id")
    best = rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= top).groupBy("jurisdiction", "kind").agg(F.array_sort(F.collect_list(F.struct("__r", "stable_id"))).alias("__b"))
    return rows.groupBy("jurisdiction", "kind").agg(F.count("*").alias("n")).join(best, ["jurisdiction", "kind"]).select("jurisdiction", "kind", "n", F.col("__b.stable_id").alias("top"))


def drill(docs: DataFrame, rel: DataFrame, citing: DataFrame, rank: DataFrame, where: Column, limit: int = 20) -> DataFrame:
    """The documents of a slice in order of rank, each with hanging: how many documents of each type cite it."""
    top = docs.filter(where).join(rank.select(F.col("node").alias("stable_id"), "rank"), "stable_id", "left").orderBy(F.desc_nulls_last("rank"), "stable_id").limit(limit)
    cited = edges(rel, status="resolved", exclude_inferred=True, exclude_types=("cited_by",)).select("src_id", F.col("dst_id").alias("stable_id")).join(top.select("stable_id"), "stable_id", "left_semi").distinct()
    kinds = cited.join(citing.select(F.col("stable_id").alias("src_id"), F.col("doc_type").alias("__t")), "src_id").groupBy("stable_id", "__t").agg(F.count("*").alias("__n"))
    maps = kinds.groupBy("stable_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__t", "__n")))).alias("hanging"))
    return top.join(maps, "stable_id", "left").orderBy(F.desc_nulls_last("rank"), "stable_id")


def pending_proceedings(notices: DataFrame, rel: DataFrame, instrument, today: str, stale_years: int = 5) -> DataFrame:
    """(src_id, preliminary, stale, anchors): live notices that turn on an instrument with the provisions they name; older ones are marked stale, to be counted and not listed."""
    at = edges(rel).filter((F.col("dst_id") == instrument) | (F.col("candidate_id") == instrument)).groupBy("src_id").agg(F.array_sort(F.collect_set("dst_anchor")).alias("anchors"))
    rows = notices.select(F.col("stable_id").alias("src_id"), F.col("procedure").isin("PREJ", "REFER_PREL", "REFER_PREL_URG").alias("preliminary"), F.coalesce(F.col("decision_date") < F.add_months(F.to_date(F.lit(today)), -12 * stale_years), F.lit(False)).alias("stale"))
    return rows.join(at, "src_id")


def legislation_types(docs: DataFrame) -> DataFrame:
    """(kind, n, years): documents by kind, with how many of each year, as a map."""
    rows = docs.select(display_kind(F.col("doc_type")).alias("kind"), F.year("decision_date").alias("year")).groupBy("kind", "year").agg(F.count("*").alias("n"))
    return rows.groupBy("kind").agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("year").isNotNull(), F.struct("year", "n"))))).alias("years"))


def uncovered_cues(texts: DataFrame, spans: DataFrame, cues: dict[str, str], pad: int = 2) -> DataFrame:
    """(cue, source, hits, uncovered): places in texts that look like a reference, and how many of them no extracted span touches within `pad` characters. texts: (doc_id, source, text); spans: (doc_id, char_start, char_end)."""
    from functools import reduce

    def places(pattern: str) -> Column:
        pieces, found = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,z:int>>").alias("out"))
        both = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, f: F.struct(F.length(p).alias("p"), F.length(f).alias("f")))
        return F.aggregate(both, start, lambda s, x: F.struct((s["at"] + x["p"] + x["f"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x["p"]).alias("a"), (s["at"] + x["p"] + x["f"]).alias("z")))).alias("out")))["out"]

    rows = reduce(DataFrame.unionByName, (texts.select("doc_id", "source", F.lit(k).alias("cue"), F.explode(places(p)).alias("h")) for k, p in cues.items())).select("doc_id", "source", "cue", "h.a", "h.z")
    bin_ = lambda c: F.floor(F.col(c) / 256)  # noqa: E731  # hits and spans meet in bins of places
    wide = spans.select("doc_id", (F.col("char_start") - pad).alias("s"), (F.col("char_end") + pad).alias("e")).withColumn("bin", F.explode(F.sequence(bin_("s"), bin_("e"))))
    near = rows.withColumn("bin", F.explode(F.sequence(bin_("a"), bin_("z")))).join(wide, ["doc_id", "bin"]).filter((F.col("s") <= F.col("z")) & (F.col("a") <= F.col("e")))
    covered = near.select("doc_id", "cue", "a").distinct().withColumn("__c", F.lit(1))
    return rows.join(covered, ["doc_id", "cue", "a"], "left").groupBy("cue", "source").agg(F.count("*").alias("hits"), F.count_if(F.col("__c").isNull()).alias("uncovered"))
