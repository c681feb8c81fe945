"""Identifiers, jurisdictions, status words, titles and links over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity as Y
from ..views import Tables
from .registry import query


@query("SELECT l_partkey AS id, l_linenumber % 2 = 0 AS consolidated, CASE WHEN l_linenumber % 2 = 0 THEN '0' ELSE '3' END AS sector, CAST(year(l_shipdate) AS INTEGER) AS year, CASE WHEN l_linenumber % 2 = 0 THEN '3' || year(l_shipdate) || 'R' || lpad(CAST(l_partkey % 10000 AS VARCHAR), 4, '0') END AS base, CASE WHEN l_linenumber % 2 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') END AS date FROM lineitem")
def scalar_celex(t: Tables) -> DataFrame:
    act = F.concat(F.year("l_shipdate"), F.lit("R"), F.lpad((F.col("l_partkey") % 10000).cast("string"), 4, "0"))
    ident = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("0"), act, F.lit("-"), F.date_format("l_shipdate", "yyyyMMdd"))).otherwise(F.concat(F.lit("3"), act))
    return t.raw("lineitem").select(F.col("l_partkey").alias("id"), Y.celex(ident).alias("c")).select("id", "c.consolidated", "c.sector", "c.year", "c.base", "c.date")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders")
def scalar_version_date(t: Tables) -> DataFrame:
    k, day = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yyyy-MM-dd")
    ident = F.when(k == 0, F.concat(F.lit("act@"), day)).when(k == 1, F.concat(F.lit("0x-"), F.date_format("o_orderdate", "yyyyMMdd"))).otherwise("act")
    meta = F.when(k == 2, F.concat(F.lit('{"currency": {"as_at": "'), day, F.lit('T00:00"}}'))).otherwise("not json")
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), Y.version_date(ident, meta, F.lit("s. 4")).alias("date"))


@query("SELECT l_partkey AS id, CASE WHEN l_linenumber % 3 = 0 THEN 'ukpga/1998/' || l_partkey WHEN l_linenumber % 3 = 1 THEN CAST(l_partkey AS VARCHAR) ELSE 'http://x/' || l_partkey END AS candidate FROM lineitem")
def scalar_normalise_candidate(t: Tables) -> DataFrame:
    n, part = F.col("l_linenumber") % 3, F.col("l_partkey")
    dst = F.when(n == 0, F.concat(F.lit("ukpga/1998/"), part, F.lit("/section/2"))).when(n == 2, F.concat(F.lit("http://x/"), part))
    raw = F.when(n == 1, F.concat(F.lit("see ref-"), part)).otherwise("nothing")
    rows = t.raw("lineitem").select(part.alias("id"), dst.alias("dst"), raw.alias("raw"))
    found = Y.normalise_candidate(F.col("dst"), F.col("raw"))
    return rows.select("id", F.when(F.col("dst").startswith("http"), F.col("dst")).otherwise(found).alias("candidate"))


SOURCES = "CASE o_orderpriority WHEN '1-URGENT' THEN 'eu-cellar' WHEN '2-HIGH' THEN 'fr-dila' WHEN '3-MEDIUM' THEN 'UK-nat' WHEN '4-NOT SPECIFIED' THEN 'ie-caselaw' ELSE 'zz' END"
BUCKETS = f"CASE {SOURCES} WHEN 'eu-cellar' THEN 'European Union' WHEN 'fr-dila' THEN 'France' WHEN 'UK-nat' THEN 'United Kingdom' WHEN 'ie-caselaw' THEN 'Ireland' ELSE 'Other' END"


def _source():
    p = F.col("o_orderpriority")
    return F.when(p == "1-URGENT", "eu-cellar").when(p == "2-HIGH", "fr-dila").when(p == "3-MEDIUM", "UK-nat").when(p == "4-NOT SPECIFIED", "ie-caselaw").otherwise("zz")


@query(f"SELECT {BUCKETS} AS bucket, count(*) AS n FROM orders GROUP BY 1")
def agg_jurisdiction_buckets(t: Tables) -> DataFrame:
    return t.raw("orders").groupBy(Y.jurisdiction(_source()).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 = 0 OR (o_orderkey % 4 = 1 AND {BUCKETS} = 'European Union') OR (o_orderkey % 4 = 2 AND {BUCKETS} = 'Ireland')")
def filter_jurisdiction_lock(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 4
    lock = F.when(k == 1, "EU").when(k == 2, "Ireland").when(k == 3, "nowhere")
    return t.raw("orders").filter(Y.lock_holds(_source(), lock)).select(F.col("o_orderkey").alias("id"))


@query("SELECT n_name AS name, CASE n_name WHEN 'FRANCE' THEN 'France' WHEN 'GERMANY' THEN 'Germany' WHEN 'INDIA' THEN 'India' WHEN 'CANADA' THEN 'Canada' END AS bucket FROM nation")
def scalar_jurisdiction_name(t: Tables) -> DataFrame:
    code = F.when(F.col("n_name") == "FRANCE", "FR").when(F.col("n_name") == "GERMANY", " de ").when(F.col("n_name") == "INDIA", "India").when(F.col("n_name") == "CANADA", "ca").otherwise(F.col("n_name"))
    return t.raw("nation").select(F.col("n_name").alias("name"), Y.canonical_jurisdiction(code).alias("bucket"))


@query("""SELECT l_partkey AS id, CASE l_returnflag WHEN 'A' THEN 'in_force' WHEN 'N' THEN 'prospective' ELSE 'repealed' END AS state,
    CASE WHEN l_returnflag = 'R' OR l_linestatus = 'F' THEN 'repealed' WHEN l_returnflag = 'N' THEN 'prospective' ELSE 'in_force' END AS worst FROM lineitem""")
def scalar_currency_status(t: Tables) -> DataFrame:
    f = F.col("l_returnflag")
    scheme = F.when(f == "A", "de-force").when(f == "N", "fr-etat").otherwise("nl-wti")
    token = F.when(f == "A", "InForce").when(f == "N", "VIGUEUR DIFF").otherwise("Vervallen")
    rows = t.raw("lineitem").select(F.col("l_partkey").alias("id"), Y.status(scheme, token).alias("state"), Y.status(F.lit("uk-leg"), F.when(F.col("l_linestatus") == "F", "Revoked")).alias("other"))
    return rows.select("id", "state", Y.more_severe(F.col("state"), F.col("other")).alias("worst"))


@query("SELECT n AS id, CAST(n AS INTEGER) AS roman, CAST(n AS INTEGER) AS alpha FROM range(1, 40) r(n)")
def scalar_enumerators(t: Tables) -> DataFrame:
    n = F.col("id")
    ones = F.array(*map(F.lit, ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")))
    roman = F.concat(F.repeat(F.lit("x"), F.floor(n / 10).cast("int")), F.element_at(ones, (n % 10 + 1).cast("int")))
    letters = F.when(n <= 26, F.char(96 + n)).otherwise(F.concat(F.char(96 + F.floor((n - 1) / 26)), F.char(97 + (n - 1) % 26)))
    return t.spark.range(1, 40).select("id", Y.roman_value(roman).alias("roman"), Y.alpha_value(F.upper(letters)).alias("alpha"))


@query("SELECT p_partkey AS id, CASE p_type WHEN 'PROMO' THEN 'cases' WHEN 'ECONOMY' THEN 'legislation' WHEN 'STANDARD' THEN 'guidance' ELSE 'other' END AS kind FROM part")
def scalar_display_kind(t: Tables) -> DataFrame:
    p = F.col("p_type")
    doc_type = F.when(p == "PROMO", "Judgment").when(p == "ECONOMY", "uk regulation").when(p == "STANDARD", "guideline")
    return t.raw("part").select(F.col("p_partkey").alias("id"), Y.display_kind(doc_type).alias("kind"))


@query("SELECT p_partkey AS id FROM part WHERE p_type = 'PROMO'")
def filter_raw_doc_type(t: Tables) -> DataFrame:
    return t.raw("part").filter(Y.of_kind(F.col("p_type"), "PROMO")).select(F.col("p_partkey").alias("id"))


@query("SELECT c_custkey AS id, 'Customer ' || c_custkey || ' v the ' || upper(left(lower(c_mktsegment), 1)) || substr(lower(c_mktsegment), 2) AS title FROM customer")
def scalar_titlecase(t: Tables) -> DataFrame:
    name = F.concat(F.lit("CUSTOMER "), "c_custkey", F.lit(" V THE "), "c_mktsegment")
    return t.raw("customer").select(F.col("c_custkey").alias("id"), Y.titlecase(name).alias("title"))


@query("SELECT p_partkey AS id, 'data prot regs ' || p_size AS short, CAST(3 AS INTEGER) AS variants FROM part")
def scalar_name_variants(t: Tables) -> DataFrame:
    name = F.concat(F.lit("Data Protection Regulations "), F.col("p_size"))
    return t.raw("part").select(F.col("p_partkey").alias("id"), Y.abbreviated(name).alias("short"), F.size(Y.name_variants(name)).alias("variants"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'Smith v Jones [' || year(o_orderdate) || '] UKSC ' || o_custkey ELSE 'Act ' || o_custkey || ' (' || year(o_orderdate) || ')' END AS citation FROM orders")
def scalar_oscola(t: Tables) -> DataFrame:
    even = F.col("o_orderkey") % 2 == 0
    cite = Y.oscola(F.when(even, "cases").otherwise("guidance"), F.when(even, "Smith v Jones").otherwise(F.concat(F.lit("Act "), "o_custkey")), F.year("o_orderdate"), F.when(even, "uksc"), F.when(even, F.col("o_custkey")))
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), cite.alias("citation"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'https://www.legislation.gov.uk/ukpga/' || year(o_orderdate) || '/' || o_custkey END AS link FROM orders")
def scalar_register_link(t: Tables) -> DataFrame:
    ident = F.when(F.col("o_orderkey") % 2 == 0, F.concat_ws("/", F.lit("ukpga"), F.year("o_orderdate"), "o_custkey")).otherwise("other/1/2")
    return t.raw("orders").select(F.col("o_orderkey").alias("id"), Y.register_link(ident).alias("link"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '') AS label, regexp_replace(url, '#.*$', '') || '#:~:text=the%20first%20words' AS link FROM pages")
def scalar_urls(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", Y.domain_label(F.col("url")).alias("label"), Y.text_fragment(F.col("url"), F.lit(" the first\n words ")).alias("link"))


@query("SELECT l_partkey AS id, 'ukut/aac/2011/' || (1 + l_partkey % 9) AS held FROM lineitem GROUP BY ALL")
def scalar_identifier_variants(t: Tables) -> DataFrame:
    rows = t.raw("lineitem").select(F.col("l_partkey").alias("id")).distinct()
    variants = rows.select("id", F.explode(Y.identifier_variants(F.concat(F.lit("UKUT/ACC/2011/00"), 1 + F.col("id") % 9))).alias("held"))
    docs = t.spark.range(1, 10).select(F.concat(F.lit("ukut/aac/2011/"), "id").alias("held"))
    return variants.join(docs, "held", "left_semi").select("id", "held")


@query("SELECT l_partkey AS article, arg_max(l_orderkey, (CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END, l_shipdate, l_orderkey)) AS current FROM lineitem GROUP BY 1")
def scalar_current_article(t: Tables) -> DataFrame:
    return t.raw("lineitem").groupBy(F.col("l_partkey").alias("article")).agg(Y.current_article(F.col("l_linestatus") == "O", F.col("l_shipdate"), F.col("l_orderkey")).alias("current"))


@query("SELECT doc_id, substr(text, greatest(0, 300 - 120) + 1, 120 + 10 + 260) AS text, CAST(120 AS INTEGER) AS start FROM documents WHERE length(text) >= 310")
def text_excerpt(t: Tables) -> DataFrame:
    e = t.documents.select("doc_id", Y.excerpt(F.col("text"), F.lit(300), F.lit(310)).alias("e"))
    return e.filter("e IS NOT NULL").select("doc_id", "e.text", F.col("e.start").cast("int").alias("start"))


@query("SELECT array_to_string(list_sort(list_distinct([x FOR x IN regexp_extract_all(lower(c_mktsegment || ' v Smith'), '[a-z]{3,}') IF x NOT IN ('the', 'and', 'ltd', 'plc', 'inc', 'parte')])), ' ') AS names, CAST(c_nationkey + 1990 AS INTEGER) AS year, count(*) AS n FROM customer GROUP BY ALL")
def resolve_coreference(t: Tables) -> DataFrame:
    key = Y.coreference_key(F.concat(F.col("c_mktsegment"), F.lit(" v Smith")), F.col("c_nationkey") + 1990)
    return t.raw("customer").groupBy(key.alias("k")).agg(F.count("*").alias("n")).select("k.names", "k.year", "n")
