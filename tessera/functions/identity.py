"""Identifiers of laws and cases, jurisdictions, status words, titles and links."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .legal import act_level, match_reference

CONSOLIDATED = r"^0(\d{4}[A-Z]{1,2}\d{4})-(\d{4})(\d{2})(\d{2})$"


def celex(identifier: Column) -> Column:
    """Struct (sector, year, descriptor, consolidated, date, base): a consolidation, 0…-YYYYMMDD, derives from the act of sector 3."""
    g = lambda k: F.regexp_extract(F.trim(identifier), CONSOLIDATED, k)
    plain = lambda k: F.regexp_extract(F.trim(identifier), r"^(\d)(\d{4})([A-Z]{1,2})\d{4}", k)
    empty = lambda c: F.nullif(c, F.lit(""))
    dated = g(1) != ""
    return F.struct(
        empty(plain(1)).alias("sector"), plain(2).try_cast("int").alias("year"), empty(plain(3)).alias("descriptor"), dated.alias("consolidated"),
        F.when(dated, F.concat_ws("-", g(2), g(3), g(4))).alias("date"), F.when(dated, F.concat(F.lit("3"), g(1))).alias("base"),
    )


def version_date(stable_id: Column, meta: Column, anchor: Column) -> Column:
    """The date of a version as text: from its id (-YYYYMMDD, @YYYY-MM-DD), else from the metadata (as_at, point_in_time, updated_to, currency.as_at), else from the anchor."""
    day = F.regexp_extract(stable_id, r"-(\d{4})(\d{2})(\d{2})$", 0)
    named = F.regexp_extract(stable_id, r"@(\d{4}-\d{2}-\d{2})$", 1)
    dates = [F.get_json_object(meta, f"$.{k}") for k in ("as_at", "point_in_time", "updated_to", "currency.as_at")] + [anchor]
    iso = [F.when(F.left(d, F.lit(10)).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.left(d, F.lit(10))) for d in dates]
    return F.coalesce(F.when(day != "", F.concat_ws("-", F.substring(day, 2, 4), F.substring(day, 6, 2), F.substring(day, 8, 2))), F.nullif(named, F.lit("")), *iso)


def normalise_candidate(dst: Column, raw: Column) -> Column:
    """What an edge points at: the given id, or, where that is missing or a URL, what the reference's shape says; statutes at the level of the act."""
    vague = dst.isNull() | (dst == "") | dst.startswith("http")
    found = F.coalesce(match_reference(F.coalesce(F.nullif(dst, F.lit("")), raw))["candidate"], match_reference(raw)["candidate"])
    return act_level(F.when(vague, F.coalesce(found, dst)).otherwise(dst))


def identifier_variants(candidate: Column) -> Column:
    """Ids under which a reference with a known slip may be held: ukut/aac and ukut/acc for each other, with and without leading zeros."""
    m = lambda k: F.regexp_extract(F.lower(candidate), r"^ukut/(?:aac|acc)/(\d{4})/0*(\d+)$", k)
    ids = F.array(*(F.concat(F.lit(f"ukut/{c}/"), m(1), F.lit("/"), n) for c in ("aac", "acc") for n in (m(2), F.lpad(m(2), 2, "0"), F.lpad(m(2), 3, "0"))))
    return F.when(m(1) != "", F.array_sort(F.array_distinct(ids))).otherwise(F.array(candidate))


#: Buckets by the beginnings of source keys, first match wins, and the short codes that name them.
JURISDICTIONS = (
    ("European Union", ("eu-", "edpb", "cellar")), ("Council of Europe", ("coe-", "echr")), ("France", ("fr-",)), ("Germany", ("de-",)), ("Netherlands", ("nl-",)), ("Italy", ("it-",)), ("Ireland", ("ie-",)), ("Australia", ("au-",)),
    ("Canada", ("ca-",)), ("New Zealand", ("nz-",)), ("Singapore", ("sg-",)), ("Hong Kong", ("hk-",)), ("India", ("in-",)), ("United States", ("us-",)), ("United Kingdom", ("uk-", "gb-")),
)
CODES = {
    "gb": "United Kingdom", "uk": "United Kingdom", "eu": "European Union", "coe": "Council of Europe", "fr": "France", "de": "Germany", "nl": "Netherlands", "it": "Italy", "ie": "Ireland",
    "au": "Australia", "ca": "Canada", "nz": "New Zealand", "sg": "Singapore", "hk": "Hong Kong", "in": "India", "us": "United States",
}


def jurisdiction(source: Column) -> Column:
    """The bucket of a source key; Other for unknown, empty and null ones."""
    key = F.lower(F.coalesce(source, F.lit("")))
    return reduce(lambda rest, j: F.when(reduce(lambda a, b: a | b, (key.startswith(p) for p in j[1])), F.lit(j[0])).otherwise(rest), reversed(JURISDICTIONS), F.lit("Other"))


def canonical_jurisdiction(name: Column) -> Column:
    """A bucket's name for its name or code; null for any other."""
    known = F.trim(name)
    codes = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in CODES.items()))
    return F.when(known.isin(*(j for j, _ in JURISDICTIONS)), known).otherwise(F.try_element_at(codes, F.lower(known)))


def lock_holds(source: Column, lock: Column) -> Column:
    """The source lies in the jurisdiction that a row is locked to; no lock holds always, an unknown one never."""
    return F.coalesce(lock.isNull() | (lock == ""), F.lit(True)) | F.coalesce(jurisdiction(source) == canonical_jurisdiction(lock), F.lit(False))


#: Status words of registers and what they mean; then all meanings, the one a reader must see first.
STATUS = {
    "fr-etat": {"vigueur": "in_force", "vigueur_diff": "prospective", "modifie": "amended", "modifie_mort_ne": "repealed", "abroge": "repealed", "abroge_diff": "in_force", "perime": "expired", "annule": "repealed", "disjoint": "unknown", "sans_etat": "unknown"},
    "de-force": {"inforce": "in_force", "in_force": "in_force", "notinforce": "repealed", "not_in_force": "repealed", "partiallyinforce": "partially_in_force", "partially_in_force": "partially_in_force", "future": "prospective"},
    "nl-wti": {"geldig": "in_force", "in_werking": "in_force", "toekomstig": "prospective", "vervallen": "repealed", "ingetrokken": "repealed"},
    "uk-leg": {"revised": "in_force", "final": "in_force", "prospective": "prospective", "repealed": "repealed", "revoked": "repealed"},
    "eu-cellar": {"in_force": "in_force", "no_longer_in_force": "repealed", "not_yet_in_force": "prospective", "partially_in_force": "partially_in_force"},
    "nz-pco": {"in_force": "in_force", "not_in_force": "prospective", "repealed": "repealed", "revoked": "repealed", "superseded": "repealed", "expired": "expired", "spent": "expired"},
    "au-register": {"inforce": "in_force", "in_force": "in_force", "ceased": "expired", "repealed": "repealed", "nevereffective": "repealed", "never_effective": "repealed"},
}
SEVERITY = ("repealed", "recast", "expired", "prospective", "partially_in_force", "amended", "corrected", "consolidated", "in_force", "unknown")


def status(scheme: Column, token: Column) -> Column:
    """The meaning of a register's word, whatever its case and separators; null if it has none."""
    table = F.create_map(*chain.from_iterable((F.lit(f"{s}|{k}"), F.lit(v)) for s, words in STATUS.items() for k, v in words.items()))
    word = F.translate(F.lower(F.trim(token)), " -", "__")
    return F.coalesce(F.try_element_at(table, F.concat_ws("|", scheme, word)), F.try_element_at(table, F.concat_ws("|", scheme, F.replace(word, F.lit("_"), F.lit("")))))


def more_severe(*states: Column) -> Column:
    """Of some meanings the one that a reader must see first; nulls are passed over."""
    order = F.array(*map(F.lit, SEVERITY))
    rank = lambda s: F.when(s.isNotNull(), F.struct(F.when(F.array_position(order, s) > 0, F.array_position(order, s)).otherwise(99).alias("r"), s.alias("s")))
    return F.array_min(F.array_compact(F.array(*map(rank, states))))["s"]


def roman_value(token: Column) -> Column:
    """The value of i to xxxix in either case; 0 for anything else."""
    t = F.lower(token)
    tens = F.length(F.regexp_extract(t, r"^(x{0,3})(?:ix|iv|v?i{0,3})$", 1))
    ones = F.regexp_extract(t, r"^x{0,3}(ix|iv|v?i{0,3})$", 1)
    value = F.when(ones == "ix", 9).when(ones == "iv", 4).otherwise(F.when(ones.startswith("v"), 5).otherwise(0) + F.length(F.replace(ones, F.lit("v"), F.lit(""))))
    return F.when(t.rlike(r"^x{0,3}(ix|iv|v?i{0,3})$") & (t != ""), 10 * tens + value).otherwise(0)


def alpha_value(token: Column) -> Column:
    """a is 1, z 26, aa 27; 0 if there is anything but letters a to z."""
    codes = F.transform(F.split(F.lower(token), ""), lambda c: F.ascii(c) - 96)
    return F.when(token.rlike(r"^[A-Za-z]+$"), F.aggregate(codes, F.lit(0), lambda n, c: n * 26 + c)).otherwise(0)


#: Kinds of documents by words of their types; what fits none is of kind other.
KINDS = (
    ("cases", ("judgment", "decision", "opinion", "order")), ("legislation", ("legislation", "act", "regulation", "directive", "statute")), ("guidance", ("guidance", "guideline", "code", "recommendation")),
    ("administrative", ("notice", "report", "administrative", "circular")), ("preparatory", ("bill", "proposal", "preparatory", "debate")),
)


def display_kind(doc_type: Column) -> Column:
    """Exactly one kind for any document; a filter on the kind is a comparison with this label."""
    t = F.lower(F.coalesce(doc_type, F.lit("")))
    return reduce(lambda rest, k: F.when(reduce(lambda a, b: a | b, (t.contains(w) for w in k[1])), F.lit(k[0])).otherwise(rest), reversed(KINDS), F.lit("other"))


def of_kind(doc_type: Column, kind: str) -> Column:
    """Documents of a kind; a name that is no kind is compared with the type as it is."""
    known = {k for k, _ in KINDS} | {"other"}
    return display_kind(doc_type) == kind if kind in known else F.coalesce(doc_type == kind, F.lit(False))


SMALL_WORDS = ("and", "of", "the", "in", "for", "on", "v", "ex", "parte", "de", "la", "le", "du", "von", "van")


def titlecase(name: Column) -> Column:
    """A name in capitals as words with one capital each, small words inside it in small letters; other names stay."""
    words = F.split(F.lower(name), " ")
    cased = F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*SMALL_WORDS), w).otherwise(F.array_join(F.transform(F.split(w, "-"), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))), "-")))
    return F.when(name.rlike(r"[A-Z]") & ~name.rlike(r"[a-z]"), F.array_join(cased, " ")).otherwise(name)


#: Long and short forms of words in the names of laws.
ABBREVIATED = (("regulations", "regs"), ("regulation", "reg"), ("directive", "dir"), ("article", "art"), ("section", "s"), ("schedule", "sch"), ("statutory instrument", "si"), ("protection", "prot"))


def abbreviated(name: Column) -> Column:
    """The name in small letters with every long form shortened and dots dropped, so that both forms meet."""
    text = F.replace(F.lower(name), F.lit("."), F.lit(""))
    return F.trim(F.regexp_replace(reduce(lambda t, p: F.regexp_replace(t, rf"\b{p[0]}\b", p[1]), ABBREVIATED, text), r"\s+", " "))


def name_variants(name: Column) -> Column:
    """The distinct spellings of a name: as it is, in small letters, shortened, and without a leading article."""
    bare = F.regexp_replace(F.lower(name), r"^the\s+", "")
    return F.array_sort(F.array_distinct(F.array(name, F.lower(name), abbreviated(name), bare)))


def coreference_key(name: Column, year: Column) -> Column:
    """Struct (names, year) under which references to one case meet; null with fewer than two names."""
    from .text import surnames

    words = surnames(name)
    return F.when(F.size(words) >= 2, F.struct(F.array_join(words, " ").alias("names"), year.alias("year")))


def oscola(kind: Column, title: Column, year: Column, court: Column, number: Column) -> Column:
    """A citation in the usual form of its kind: cases with the year in brackets, the court and the number, laws with the year, others with the year in brackets."""
    neutral = F.concat(F.coalesce(title, F.lit("")), F.lit(" ["), year.cast("string"), F.lit("] "), F.upper(court), F.lit(" "), number.cast("string"))
    law = F.when(title.rlike(r"\b\d{4}$"), title).otherwise(F.concat_ws(" ", title, year.cast("string")))
    return F.trim(F.when((kind == "cases") & court.isNotNull() & year.isNotNull() & number.isNotNull(), neutral).when(kind == "legislation", law).otherwise(F.concat(F.coalesce(title, F.lit("")), F.when(year.isNotNull(), F.concat(F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(""))))


#: Public registers by the first segment of an id: the page of court/year/number.
REGISTERS = {"uksc": "https://www.bailii.org/uk/cases/UKSC/{y}/{n}.html", "ewca": "https://www.bailii.org/ew/cases/EWCA/{y}/{n}.html", "ukpga": "https://www.legislation.gov.uk/ukpga/{y}/{n}", "uksi": "https://www.legislation.gov.uk/uksi/{y}/{n}"}


def register_link(stable_id: Column) -> Column:
    """The page of a document in the public register of its kind; null if there is none."""
    parts = F.split(stable_id, "/")
    head, year, number = F.get(parts, F.lit(0)), F.element_at(parts, -2), F.element_at(parts, -1)
    out = F.lit(None).cast("string")
    for k, pattern in REGISTERS.items():
        a, rest = pattern.split("{y}")
        b, c = rest.split("{n}")
        out = F.when(head == k, F.concat(F.lit(a), year, F.lit(b), number, F.lit(c))).otherwise(out)
    return F.when(F.size(parts) >= 3, out)


def text_fragment(url: Column, quoted: Column) -> Column:
    """A link to the first words of a passage of a page."""
    words = F.slice(F.split(F.trim(F.regexp_replace(quoted, r"\s+", " ")), " "), 1, 8)
    return F.concat(F.regexp_replace(url, r"#.*$", ""), F.lit("#:~:text="), F.replace(F.url_encode(F.array_join(words, " ")), F.lit("+"), F.lit("%20")))


def domain_label(url: Column) -> Column:
    """The host without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")


def current_article(rows_live: Column, start: Column, ident: Column) -> Column:
    """Aggregate: of an article's versions the id of the live one that starts last, else of the one that starts last."""
    return F.max_by(ident, F.struct(rows_live.cast("int"), start, ident))


def excerpt(text: Column, start: Column, end: Column, before: int = 120, after: int = 260) -> Column:
    """Struct (text, start, end): the text around a span (places from 0), and where the span is in it; null where the span lies outside."""
    low = F.greatest(F.lit(0), start - before)
    return F.when((start >= 0) & (end <= F.length(text)) & (start <= end), F.struct(F.substr(text, low + 1, end + after - low).alias("text"), (start - low).alias("start"), (end - low).alias("end")))
