"""Data-quality probes over edges and documents, and repairs bounded by them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import dangling


def self_citation(rel: DataFrame) -> DataFrame:
    return rel.filter(F.col("src_id") == F.col("dst_id"))


def resolved_target_missing(rel: DataFrame, docs: DataFrame) -> DataFrame:
    return rel.filter((F.col("status") == "resolved") & F.col("dst_id").isNotNull()).join(docs.select(F.col("stable_id").alias("dst_id")), "dst_id", "left_anti")


def pending_but_held(rel: DataFrame, docs: DataFrame) -> DataFrame:
    return rel.filter(F.col("status") == "pending").join(docs.select(F.col("stable_id").alias("candidate_id")), "candidate_id", "left_semi")


def alias_dangling(aliases: DataFrame, docs: DataFrame) -> DataFrame:
    return dangling(aliases, docs)


def year_shaped_pinpoint(rel: DataFrame) -> DataFrame:
    return rel.filter(F.col("dst_anchor").rlike(r"^para (19|20)\d\d$"))


def kind_mismatch(rel: DataFrame, docs: DataFrame, doc_types: tuple[str, ...], anchors: str) -> DataFrame:
    """Edges with an anchor of a form that the cited document's type doesn't have."""
    kinds = docs.select(F.col("stable_id").alias("dst_id"), "doc_type")
    return rel.join(kinds, "dst_id").filter(F.col("doc_type").isin(*doc_types) & F.col("dst_anchor").rlike(anchors))


def with_lateness(rel: DataFrame, citing: DataFrame) -> DataFrame:
    """Edges with days_late: how long after the citing document what it cites is dated."""
    dates = citing.select(F.col("stable_id").alias("src_id"), "decision_date")
    return rel.join(dates, "src_id").withColumn("days_late", F.datediff("event_date", "decision_date"))


def forward_citation(rel: DataFrame, citing: DataFrame, days: int = 365) -> DataFrame:
    """Edges to something dated more than `days` after the citing document."""
    return with_lateness(rel, citing).filter(F.col("days_late") > days)


def anachronistic(rel: DataFrame, citing: DataFrame) -> DataFrame:
    return forward_citation(rel, citing, 0)


def future_dated(docs: DataFrame, today: str) -> DataFrame:
    return docs.filter(F.col("decision_date") > F.to_date(F.lit(today)))


def misdated(docs: DataFrame, slug_year: str, years: int = 2) -> DataFrame:
    return docs.filter(F.abs(F.col(slug_year) - F.year("decision_date")) > years)


def never_extracted(docs: DataFrame, rel: DataFrame) -> DataFrame:
    return docs.join(rel.select(F.col("src_id").alias("stable_id")), "stable_id", "left_anti")


def duplicate_spans(rel: DataFrame, *key: str) -> DataFrame:
    return rel.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def paragraph_after_case(cites: DataFrame, most: int = 10) -> DataFrame:
    """Carried-forward `para` references that begin 0 to `most` characters behind the end of a case: the case's own pinpoint, given to something else.

    cites: (src_id, citation_id, char_start, char_end, kind, method, raw); ends and starts meet in bins of the band.
    """
    width = most + 1
    near = cites.filter(F.col("kind").isin("case", "opinion")).select("src_id", F.col("char_end").alias("end"), F.explode(F.sequence(F.floor(F.col("char_end") / width), F.floor((F.col("char_end") + most) / width))).alias("bin"))
    carried = cites.filter((F.col("method") == "carry_forward") & F.lower("raw").startswith("para")).withColumn("bin", F.floor(F.col("char_start") / width))
    return carried.join(near, ["src_id", "bin"]).filter((F.col("char_start") - F.col("end")).between(0, most)).select("citation_id", "src_id", "end")


def paragraph_in_judgment(cites: DataFrame, docs: DataFrame) -> DataFrame:
    """Carried-forward `para` references of judgments, decisions and opinions."""
    of = docs.filter(F.col("doc_type").isin("judgment", "decision", "opinion")).select(F.col("stable_id").alias("src_id"))
    return cites.filter((F.col("method") == "carry_forward") & F.lower("raw").startswith("para")).join(of, "src_id", "left_semi")


def paragraph_of_eu_instrument(cites: DataFrame) -> DataFrame:
    """Carried-forward pinpoints `para N` on instruments that are cited by article."""
    return cites.filter(F.col("kind").isin("directive", "eu_instrument") & F.col("pinpoint").startswith("para ") & (F.col("method") == "carry_forward"))


def ambiguous_reporter(cites: DataFrame, docs: DataFrame, always: tuple[str, ...] = ("us/p/",), outside: tuple[str, ...] = ("us/a/", "us/f/", "us/so/"), home: str = "us-") -> DataFrame:
    """References to a reporter whose abbreviation is an ordinary word: always for some, for others where the citing document isn't from home."""
    starts = lambda heads: reduce(lambda a, b: a | b, (F.col("candidate_id").startswith(h) for h in heads))
    foreign = docs.filter(~F.col("source").startswith(home)).select(F.col("stable_id").alias("src_id"))
    first = cites.filter(starts(always))
    return first.unionByName(cites.filter(starts(outside) & ~starts(always)).join(foreign, "src_id", "left_semi"))


def foreign_statute(rel: DataFrame, docs: DataFrame, host: tuple[str, ...], targets: tuple[str, ...], via: tuple[str, ...] = ("regex", "inferred")) -> DataFrame:
    """Edges made by a machine from documents of one jurisdiction to statutes of another that share their names."""
    home = docs.filter(reduce(lambda a, b: a | b, (F.col("source").startswith(h) for h in host))).select(F.col("stable_id").alias("src_id"))
    hit = reduce(lambda a, b: a | b, (F.col("dst_id").cast("string").startswith(h) for h in targets))
    return rel.filter(F.col("via").isin(*via) & hit).join(home, "src_id", "left_semi")


def counted_once(rows: DataFrame, tests: dict) -> DataFrame:
    """(probe, n) of probes that look at one row each, in one pass."""
    counts = rows.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in tests.items()))
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, tests)), F.array(*tests))).alias("probe", "n"))


def summary(probes: dict[str, DataFrame]) -> DataFrame:
    """(probe, n) of many probes in one result."""
    return reduce(DataFrame.unionByName, (d.agg(F.count("*").alias("n")).select(F.lit(k).alias("probe"), "n") for k, d in probes.items()))


def repair_self_citation(rel: DataFrame) -> DataFrame:
    return rel.filter(~F.coalesce(F.col("src_id") == F.col("dst_id"), F.lit(False)))


def repair_missing_target(rel: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges to documents that aren't held become pending again; the named target stays as candidate."""
    held = docs.select(F.col("stable_id").alias("__held")).distinct()
    rows = rel.join(held, F.col("dst_id") == F.col("__held"), "left")
    bad = F.col("dst_id").isNotNull() & F.col("__held").isNull()
    return rows.withColumn("candidate_id", F.when(bad, F.coalesce("candidate_id", "dst_id")).otherwise(F.col("candidate_id"))).withColumn("status", F.when(bad, "pending").otherwise(F.col("status"))).withColumn("dst_id", F.when(~bad, F.col("dst_id"))).drop("__held")


def repair_pending_but_held(rel: DataFrame, docs: DataFrame) -> DataFrame:
    held = docs.select(F.col("stable_id").alias("__held")).distinct()
    rows = rel.join(held, F.col("candidate_id") == F.col("__held"), "left")
    hit = (F.col("status") == "pending") & F.col("__held").isNotNull()
    return rows.withColumn("dst_id", F.when(hit, F.col("__held")).otherwise(F.col("dst_id"))).withColumn("status", F.when(hit, "resolved").otherwise(F.col("status"))).drop("__held")


def repair_duplicate_spans(rel: DataFrame, ident: str, *key: str) -> DataFrame:
    """Of rows with one key the one with the smallest id."""
    from pyspark.sql import Window

    return rel.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(ident))).filter("__r = 1").drop("__r")


def repair_year_pinpoint(rel: DataFrame) -> DataFrame:
    return rel.withColumn("dst_anchor", F.when(~F.coalesce(F.col("dst_anchor").rlike(r"^para (19|20)\d\d$"), F.lit(False)), F.col("dst_anchor")))


def repair_dangling_alias(aliases: DataFrame, docs: DataFrame) -> DataFrame:
    """Aliases without the dangling ones; a removal can leave others dangling, so the probe is run again until it finds none."""
    from .graph import _cut

    while True:
        bad = dangling(aliases, docs).select("alias").distinct()
        if bad.isEmpty():
            return aliases
        aliases = _cut(aliases.join(bad, "alias", "left_anti"))


def issues(errors: DataFrame) -> DataFrame:
    """(fingerprint, seen_count, first, last, sample): errors that differ only in numbers are one issue."""
    shape = F.sha2(F.concat_ws("|", "kind", F.regexp_replace("message", r"\d+", "#")), 256)
    return errors.groupBy(shape.alias("fingerprint")).agg(F.count("*").alias("seen_count"), F.min("at").alias("first"), F.max("at").alias("last"), F.min("message").alias("sample"))
