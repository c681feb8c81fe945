"""What follows a reference: pinpoints, lists, carried-forward provisions, short names, guards."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import drop_overlaps

#: Grammars by language: (kind, pattern).
LANGUAGES: dict[str, tuple[tuple[str, str], ...]] = {
    "de": (("statute", r"§§?\s?\d+[a-z]?(?:\s(?:Abs\.|Absatz)\s?\d+)?(?:\s(?:S\.|Satz)\s?\d+)?\s[A-ZÄÖÜ][A-Za-zÄÖÜäöü]{1,12}G?B?\b"), ("statute", r"\bArt\.\s?\d+(?:\sAbs\.\s?\d+)?\s(?:GG|EGBGB|DSGVO)\b"), ("case", r"\b(?:BGH|BVerfG|BAG|BSG|BFH|BVerwG)\b[^\n]{0,40}?\b[IVX]{0,4}\s?\d?\s?[A-Z][A-Za-z]{0,3}\s\d{1,4}/\d{2}\b")),
    "at": (("case", r"\bOGH\b[^\n]{0,20}?\b\d{1,2}\s?Ob[A-Z]?\s?\d{1,4}/\d{2}[a-z]?\b"), ("statute", r"§\s?\d+[a-z]?\s(?:ABGB|StGB|DSG|ZPO)\b")),
    "fr": (("statute", r"\b[Aa]rticles?\s(?:L\.|R\.|D\.)?\s?\d+(?:-\d+)*\sdu\s[Cc]ode\s[a-zéèêà]+(?:\s[a-zéèêà]+)?"), ("case", r"\bn°\s?\d{2}-\d{2}\.\d{3}\b")),
    "nl": (("statute", r"\bart(?:ikel|\.)\s?\d+(?::\d+)?[a-z]?(?:\slid\s\d+)?\s(?:BW|Sr|Sv|Rv|Awb|AVG|Gw)\b"), ("case", r"\bLJN:?\s?[A-Z]{2}\d{4}\b")),
    "it": (("statute", r"\bart(?:icolo|\.)\s?\d+(?:-bis|-ter)?\s(?:c\.c\.|c\.p\.|c\.p\.c\.|Cost\.)"), ("case", r"\bCass\.[^\n]{0,30}?n\.\s?\d+/\d{4}\b")),
    "es": (("statute", r"\bart(?:ículo|\.)\s?\d+(?:\.\d+)?\s(?:de\sla\sConstitución|CE|CC|LEC|LOPJ)\b"), ("case", r"\bST[SC]\s\d+/\d{4}\b")),
    "da": (("statute", r"§\s?\d+(?:,\sstk\.\s?\d+)?\si\slov\snr\.\s?\d+"), ("case", r"\bU(?:fR)?\s?\d{4}\.\d+\b")),
    "sv": (("case", r"\bNJA\s\d{4}\ss\.\s?\d+\b"), ("statute", r"\b\d+\skap\.\s\d+\s§\s[a-zåäö]+balken\b")),
    "fi": (("case", r"\bKKO\s?:?\s?\d{4}:\d+\b"), ("statute", r"\b[a-zäö]+lain\s\d+\s(?:luvun\s\d+\s)?§")),
    "et": (("case", r"\bRK[THK]Ko?\s\d-\d{1,2}-\d{1,2}-\d{1,3}-\d{2}\b"),),
    "sk": (("statute", r"§\s?\d+(?:\sods\.\s\d+)?\szákona\sč\.\s?\d+/\d{4}\sZ[b.z]{1,3}"),),
    "us": (("case", r"\b\d{1,4}\s(?:U\.S\.|S\.\sCt\.|F\.(?:2d|3d|4th)|F\.\sSupp\.(?:\s2d|\s3d)?)\s\d{1,4}\b"), ("statute", r"\b\d{1,2}\sU\.S\.C\.\s§\s?\d+[a-z]?")),
    "cw": (("case", r"\[\d{4}\]\s(?:HCA|FCA|FCAFC|NZSC|NZCA|SGCA|SGHC|HKCFA)\s\d+"), ("case", r"\b\d{4}\s(?:SCC|ONCA|BCCA|FCA)\s\d+\b")),
}


def citations_by_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = None) -> DataFrame:
    """(doc_id, lang, char_start, char_end, kind, raw): references in the grammars of each language; with a column lang, only in that of the document's own and, always, those of case reports in English."""
    compiled = {k: [(kind, re.compile(p)) for kind, p in v] for k, v in LANGUAGES.items()}
    type_ = docs.schema[doc_id].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, t, own in zip(f.iloc[:, 0], f.iloc[:, 1], f.iloc[:, 2]):
                for k in compiled if own is None else {own, "us", "cw"} & set(compiled):
                    out += [(i, k, *c) for c in drop_overlaps([(m.start(), m.end(), kind, m[0]) for kind, p in compiled[k] for m in p.finditer(t or "")])]
            yield pd.DataFrame(out, columns=["doc_id", "lang", "char_start", "char_end", "kind", "raw"])

    return docs.select(doc_id, text, (F.col(lang) if lang else F.lit(None)).cast("string").alias("__lang")).mapInPandas(run, f"doc_id {type_}, lang string, char_start int, char_end int, kind string, raw string")


PIN = r"^\s*,?\s*(?:at\s+)?(?:\[(\d{1,4})\](?:\s*[-–]\s*\[?(\d{1,4})\]?)?|(?:paras?|paragraphs?)\.?\s+(\d{1,4}(?:\s*(?:,|–|-|to|and|&)\s*\d{1,4})*))"


def pinpoint(after: Column) -> Column:
    """The paragraphs that follow a case: `at [57]` is para 57, `at paras 8, 44` para 8, 44; a year is none."""
    g = lambda k: F.regexp_extract(F.left(after, F.lit(60)), PIN, k)
    run = F.when(g(3) != "", F.regexp_replace(F.regexp_replace(g(3), r"\s*,\s*", ", "), r"\s*(to|and|&)\s*", " $1 ")).when(g(2) != "", F.concat(g(1), F.lit("–"), g(2))).when(g(1) != "", g(1))
    return F.when(~F.regexp_extract(run, r"^\d+", 0).rlike(r"^(19|20)\d\d$"), F.concat(F.lit("para "), run))


def with_pinpoints(cites: DataFrame, after: str = "after") -> DataFrame:
    """cites with pinpoint: of cases and opinions that have none, the paragraphs named right behind them."""
    own = F.col("pinpoint") if "pinpoint" in cites.columns else F.lit(None).cast("string")
    return cites.withColumn("pinpoint", F.coalesce(own, F.when(F.col("kind").isin("case", "opinion", "neutral", "ecli"), pinpoint(F.col(after)))))


LIST = r"(?:Articles|Arts\.|Sections|ss\.)\s+\d+[A-Za-z]?(?:\(\d+\))*(?:\s*(?:,|and|or|to|–|-)\s*\d+[A-Za-z]?(?:\(\d+\))*)+(?:\s+of\s+(?:the\s+|that\s+)?[A-Z][\w’']*(?:\s+(?:of|on|the|[A-Z][\w’']*|\d{4}))*)?"


def provision_lists(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", widest: int = 200) -> DataFrame:
    """(doc_id, list_no, provision, host, raw): a row for each provision of a list, `Articles 7, 8 and 11 of the Charter`; ranges of up to `widest` plain numbers are spelled out, host is what the list belongs to, if it says so."""
    rows = docs.select(doc_id, F.posexplode(F.regexp_extract_all(text, F.lit(LIST), F.lit(0))).alias("list_no", "raw"))
    host = F.nullif(F.regexp_extract("raw", r"\sof\s+(?:the\s+|that\s+)?([A-Z].*)$", 1), F.lit(""))
    items = F.split(F.regexp_replace(F.regexp_replace("raw", r"\sof\s.*$", ""), r"^\D+", ""), r"\s*(?:,|\band\b|\bor\b)\s*")
    rows = rows.select(doc_id, "list_no", "raw", host.alias("host"), F.explode(F.filter(items, lambda x: x != "")).alias("item"))
    low, high = (F.regexp_extract("item", r"^(\d+)\s*(?:to|–|-)\s*(\d+)$", k).try_cast("int") for k in (1, 2))
    wide = low.isNotNull() & (high >= low) & (high - low <= widest)
    each = F.when(wide, F.transform(F.sequence(F.coalesce(low, F.lit(0)), F.when(wide, high).otherwise(F.coalesce(low, F.lit(0)))), lambda n: n.cast("string"))).otherwise(F.array("item"))
    return rows.select(doc_id, "list_no", F.explode(each).alias("provision"), "host", "raw")


def carried_forward(cites: DataFrame, most: int = 20_000) -> DataFrame:
    """Bare provisions with host and confidence: the instrument that was named last before them, of the kind that has such provisions (articles: EU instruments, sections: acts), within `most` characters.

    cites: (doc_id, char_start, kind, raw, candidate); a bare provision has kind article and no candidate.
    """
    bare = F.col("candidate").isNull() & (F.col("kind") == "article")
    section = F.lower("raw").rlike(r"^(section|s\.|schedule)")
    w = Window.partitionBy("doc_id").orderBy("char_start", "raw").rowsBetween(Window.unboundedPreceding, -1)
    named = F.struct(F.col("char_start").alias("at"), F.col("candidate").alias("host"))
    last = lambda kinds: F.last(F.when(~bare & F.col("kind").isin(*kinds) & F.col("candidate").isNotNull(), named), ignorenulls=True).over(w)
    rows = cites.withColumn("__eu", last(("celex", "regulation", "directive", "treaty", "eu_instrument"))).withColumn("__act", last(("act", "statute")))
    host = F.when(section, F.col("__act")).otherwise(F.col("__eu"))
    gap = F.col("char_start") - host["at"]
    near = rows.filter(bare & (gap <= most)).withColumn("host", host["host"]).withColumn("confidence", F.when(gap <= 500, "high").when(gap <= 3000, "medium").otherwise("low"))
    return near.filter(F.col("host").isNotNull()).drop("__eu", "__act")


def defined_names(cites: DataFrame, after: str = "after") -> DataFrame:
    """(doc_id, shorthand, candidate, char_start): names that a text gives to what it has just cited, as in `Data Protection Act 2018 ("the Act")`, and where the definition ends."""
    shape = r"^\s*\((?:hereinafter\s+)?[\"“'‘](?:the\s+)?([^\"”’')]{2,40})[\"”'’]\)"
    name, whole = F.regexp_extract(F.col(after), shape, 1), F.regexp_extract(F.col(after), shape, 0)
    return cites.withColumn("shorthand", F.nullif(F.trim(name), F.lit(""))).filter(F.col("shorthand").isNotNull()).select("doc_id", "shorthand", "candidate", (F.col("char_end") + F.length(whole)).alias("char_start"))


def used_names(docs: DataFrame, names: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, shorthand, candidate, n): how often each defined name stands in its document behind its definition."""
    rows = names.join(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__t")), "doc_id")
    behind = F.substr("__t", F.col("char_start") + 1)
    word = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), "shorthand", F.lit(r"\E(?![\p{L}\p{N}])"))
    return rows.select("doc_id", "shorthand", "candidate", (F.size(F.split(behind, word, -1)) - 1).alias("n")).filter("n > 0")


def not_suppressed(cites: DataFrame, vetoed: DataFrame) -> DataFrame:
    """cites without those that somebody rejected in their document, by candidate or by wording; vetoed: (doc_id, candidate, raw), either null."""
    by_id = vetoed.filter(F.col("candidate").isNotNull()).select("doc_id", "candidate").distinct()
    by_text = vetoed.filter(F.col("raw").isNotNull()).select("doc_id", "raw").distinct()
    return cites.join(by_id, ["doc_id", "candidate"], "left_anti").join(by_text, ["doc_id", "raw"], "left_anti")


def guarded(cites: DataFrame, docs: DataFrame, rules: DataFrame) -> DataFrame:
    """cites kept, dropped or given another candidate by the jurisdiction of the citing document.

    rules: (prefix, jurisdiction, rebind): references whose candidate begins so are only meant in documents of
    that jurisdiction; elsewhere they become rebind + rest, or go where rebind is null. The longest prefix counts.
    """
    from ..functions.identity import jurisdiction

    of = docs.select(F.col("doc_id"), jurisdiction(F.col("source")).alias("__j"))
    # a rule is found by the candidate's first segment, so rules and references meet in an equality
    head = lambda c: F.concat(F.substring_index(c, "/", 1), F.lit("/"))
    r = rules.groupBy("prefix").agg(F.collect_set("jurisdiction").alias("__in"), F.max("rebind").alias("__to"))
    rows = cites.join(of, "doc_id", "left").withColumn("__h", head(F.col("candidate"))).join(r, F.col("__h") == F.col("prefix"), "left")
    alien = F.col("prefix").isNotNull() & ~F.array_contains("__in", F.coalesce("__j", F.lit("Other")))
    moved = F.concat("__to", F.substr("candidate", F.length("prefix") + 1))
    return rows.filter(~F.coalesce(alien, F.lit(False)) | F.col("__to").isNotNull()).withColumn("candidate", F.when(alien, moved).otherwise(F.col("candidate"))).select(*cites.columns)


def extra_pass(docs: DataFrame, cites: DataFrame, extract: Callable[[str], list[tuple[int, int, str]]] | None, size: int = 4000, overlap: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, char_start, char_end, raw) that another extractor finds in sliding windows of a text and no reference found so far overlaps; without one, nothing."""
    step = size - overlap
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).filter(F.length("t") > 0)
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("t") - overlap - 1), F.lit(step)))).select("doc_id", "at", F.substr("t", F.col("at") + 1, F.lit(size)).alias("w"))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(i, int(a) + s, int(a) + e, raw) for i, a, w in zip(f["doc_id"], f["at"], f["w"]) for s, e, raw in (extract(w) if extract else ())], columns=["doc_id", "char_start", "char_end", "raw"])

    found = rows.mapInPandas(run, f"doc_id {kind}, char_start int, char_end int, raw string").distinct()
    bins = lambda a, z: F.sequence(F.floor(F.col(a) / 512), F.floor((F.col(z) - 1) / 512))
    taken = cites.select("doc_id", F.col("char_start").alias("s"), F.col("char_end").alias("e")).withColumn("bin", F.explode(bins("s", "e")))
    hit = found.withColumn("bin", F.explode(bins("char_start", "char_end"))).join(taken, ["doc_id", "bin"]).filter((F.col("s") < F.col("char_end")) & (F.col("char_start") < F.col("e"))).select("doc_id", "char_start", "char_end").distinct()
    return found.join(hit, ["doc_id", "char_start", "char_end"], "left_anti")
