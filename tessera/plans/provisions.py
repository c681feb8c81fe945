"""As-of joins, provisions and lists over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import listing as Li
from ..operators import provisions as Pv
from ..operators import ranking as R
from ..views import Tables
from .registry import query

CITING = "'mentions', 'interprets', 'applies', 'considers', 'follows', 'distinguishes', 'overrules', 'cites_for_fact'"


@query("SELECT src_id, dst_anchor, type FROM rel WHERE status = 'resolved' AND type <> 'cited_by' AND dst_id = 42 AND (starts_with(lower(translate(dst_anchor, ' .§', '')), 's1') OR lower(translate(dst_anchor, ' .§', '')) LIKE '%3')", "rel")
def filter_anchor_guard(t: Tables) -> DataFrame:
    return Pv.edges_at(t.rel, 42, prefixes=("s1",), likes=("%3",)).select("src_id", "dst_anchor", "type")


@query("SELECT src_id, type FROM rel WHERE status = 'resolved' AND type <> 'cited_by' AND dst_id = 42 AND dst_anchor = 's. 5'", "rel")
def graph_relations_to(t: Tables) -> DataFrame:
    return Pv.edges_at(t.rel, 42, exact="S.5").select("src_id", "type")


VERSIONED = "SELECT l_partkey AS base_id, l_partkey * 1000000 + l_orderkey AS version_id, CAST(l_shipdate AS DATE) AS version_date, l_linenumber % 3 <> 0 AS has_text FROM lineitem"


def _versions(t: Tables) -> DataFrame:
    return t.raw("lineitem").select(F.col("l_partkey").alias("base_id"), (F.col("l_partkey") * 1000000 + F.col("l_orderkey")).alias("version_id"), F.to_date("l_shipdate").alias("version_date"), (F.col("l_linenumber") % 3 != 0).alias("has_text"))


@query(f"WITH v AS ({VERSIONED}) SELECT base_id, arg_max(version_id, (version_date, version_id)) AS version_id, CAST(max(version_date) AS VARCHAR) AS date FROM v WHERE has_text AND version_date <= DATE '1999-06-30' GROUP BY 1")
def join_asof_readable(t: Tables) -> DataFrame:
    return Pv.readable_asof(_versions(t), "1999-06-30").select("base_id", "version_id", F.col("version_date").cast("string").alias("date"))


@query(
    f"""WITH r AS (SELECT DISTINCT src_id, coalesce(dst_id, candidate_id) AS base_id, dst_anchor FROM rel WHERE type IN ({CITING}) AND coalesce(dst_id, candidate_id) IS NOT NULL AND src_id <> coalesce(dst_id, candidate_id)),
    d AS (SELECT r.*, coalesce(decision_date, DATE '2001-01-01') AS ref_date FROM r JOIN docs_l ON src_id = stable_id)
    SELECT src_id, d.base_id, dst_anchor, CAST(v.version_date AS VARCHAR) AS date FROM d ASOF JOIN versions v ON d.base_id = v.base_id AND d.ref_date >= v.version_date""",
    "docs_l rel versions",
)
def join_asof_per_citing(t: Tables) -> DataFrame:
    found = Pv.applicable_version_edges(t.rel, t.versions, t.docs_l, "2001-01-01")
    return found.select("src_id", "base_id", "dst_anchor", F.col("version_date").cast("string").alias("date"))


@query(
    f"""WITH v AS (SELECT DISTINCT base_id, version_id FROM ({VERSIONED}) WHERE version_date >= DATE '2001-01-01'), c AS (SELECT src_id, coalesce(dst_id, candidate_id) AS base_id, dst_anchor FROM rel WHERE type IN ({CITING}) AND via <> 'inferred')
    SELECT version_id, src_id, dst_anchor, count(*) AS n FROM c JOIN v USING (base_id) WHERE src_id <> base_id AND src_id <> version_id GROUP BY ALL""",
    "rel",
)
def join_version_projection(t: Tables) -> DataFrame:
    recent = _versions(t).filter("version_date >= DATE '2001-01-01'").select("version_id", "base_id").distinct()
    return Pv.projected_mentions(t.rel, recent, t.docs_l.select(F.col("stable_id").alias("node"), F.col("weight").alias("rank"))).groupBy("version_id", "src_id", "dst_anchor").agg(F.count("*").alias("n"))


@query("SELECT src_id, status, dst_anchor FROM rel WHERE (status = 'resolved' AND dst_id = 42) OR (status = 'pending' AND candidate_id = 42)", "rel")
def set_lineage_union(t: Tables) -> DataFrame:
    return Pv.lineage_by_status(t.rel, F.lit(42)).select("src_id", "status", "dst_anchor")


@query("SELECT o_orderkey AS notice_id, d.p AS decision_id FROM orders JOIN (SELECT 1000000 + p_partkey AS p, p_partkey AS k, p_size FROM part WHERE p_size > 10) d ON o_orderkey = d.k WHERE o_orderkey % 2 = 0")
def join_notice_pairing(t: Tables) -> DataFrame:
    number = lambda c: F.lpad((F.col(c) % 10000).cast("string"), 4, "0")
    year = lambda c: (2000 + F.floor(F.col(c) / 10000)).cast("string")
    notices = t.raw("orders").select(F.col("o_orderkey").alias("stable_id"), F.concat(F.lit("6"), year("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, "CN").otherwise("CX"), number("o_orderkey")).alias("celex"))
    held = t.raw("part").select((F.col("p_partkey") + 1000000).alias("stable_id"), F.concat(F.lit("6"), year("p_partkey"), F.when(F.col("p_partkey") % 4 == 0, "cj").otherwise("co"), number("p_partkey")).alias("celex"), (F.col("p_size") > 10).alias("has_text"))
    return Pv.notices_decided(notices, held)


@query("SELECT o_orderkey AS id, name FROM orders LEFT JOIN (SELECT c_mktsegment AS slug, arg_min(c_name, c_custkey) AS name FROM customer WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1) ON slug = (CASE o_orderkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'AUTOMOBILE' END)")
def join_index_corpus(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 3
    corpus = t.raw("orders").select(F.col("o_orderkey").alias("id"), F.when(k == 0, "BUILDING").when(k == 1, "MACHINERY").otherwise("AUTOMOBILE").alias("slug"))
    index = t.raw("customer").filter("c_mktsegment <> 'MACHINERY'").select(F.col("c_mktsegment").alias("slug"), F.col("c_name").alias("name"), "c_custkey")
    return Pv.index_join(corpus, index, [F.asc("c_custkey")]).select("id", "name")


@query("WITH s AS (SELECT conv_id AS doc_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations) SELECT s.doc_id, CAST(s.turn AS VARCHAR) AS label, s.place = f.place AS focus FROM s JOIN (SELECT doc_id, place FROM s WHERE turn = 2) f USING (doc_id) WHERE abs(s.place - f.place) <= 1")
def text_provision_window(t: Tables) -> DataFrame:
    c = t.raw("conversations")
    segments = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("string").alias("label"), F.col("turn").alias("char_start"), "text")
    return Pv.provision_window(segments, c.filter("turn = 2").select(F.col("conv_id").alias("doc_id"), F.lit("2").alias("label"))).select("doc_id", "label", "focus")


@query()
def text_reanchor(t: Tables) -> DataFrame:
    c = t.documents.filter(F.length("text") >= 80).select("doc_id", F.substring("text", 41, 40).alias("raw"), F.when(F.col("doc_id") % 2 == 0, 40).otherwise(55).alias("char_start"))
    return Pv.reanchored(c.withColumn("char_end", F.col("char_start") + 40), t.documents).select("doc_id", "char_start")


@query("SELECT p_partkey AS stable_id FROM part WHERE p_partkey IN (3, 5) OR p_partkey * 2 IN (20, 41)")
def filter_id_set(t: Tables) -> DataFrame:
    return Li.id_set(t.docs_r.withColumn("ecli", F.concat(F.lit("E"), F.col("stable_id") * 2)), ["3", "5", "E20", "E41"]).select("stable_id")


@query("SELECT stable_id FROM docs_r WHERE (lower(title) LIKE '%red%' AND lower(title) LIKE '%1%') OR stable_id % 7 = 0", "docs_r")
def filter_title_or_alias(t: Tables) -> DataFrame:
    aliases = t.docs_r.select(F.when(F.col("stable_id") % 7 == 0, "the RED 1 report").otherwise("blue").alias("alias"), F.col("stable_id").alias("canonical_id"))
    return Li.title_or_alias(t.docs_r, "1 red", aliases, "title").select("stable_id")


@query("SELECT stable_id FROM docs_l WHERE doc_type IN ('1-URGENT', '2-HIGH') AND source IN ('F')", "docs_l")
def filter_rule_scope(t: Tables) -> DataFrame:
    return Li.in_scope(t.docs_l, ["1-URGENT", "2-HIGH"], ["F"]).select("stable_id")


@query("SELECT stable_id FROM docs_l WHERE stable_id % 3 <> 0 AND source LIKE 'O%' AND stable_id % 5 <> 1 AND stable_id IN (SELECT src_id FROM rel WHERE candidate_id IN (7, 42, 99))", "docs_l rel")
def filter_grammar_worklist(t: Tables) -> DataFrame:
    docs = t.docs_l.withColumn("has_text", F.col("stable_id") % 3 != 0).withColumn("run_id", F.when(F.col("stable_id") % 5 != 0, F.col("stable_id") % 5))
    return Li.citing_worklist(docs, t.rel, [7, 42, 99], source_prefix="O", without_run=1).select("stable_id")


@query("WITH c AS (SELECT candidate_id AS k, count(*) AS n FROM rel WHERE candidate_id IS NOT NULL GROUP BY 1) SELECT stable_id, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS cited_by, round(size / 50.0, 4) AS authority FROM docs_r LEFT JOIN c a ON a.k = stable_id LEFT JOIN c b ON b.k = stable_id + 1", "docs_r rel")
def join_doc_standing(t: Tables) -> DataFrame:
    counts = t.rel.filter("candidate_id IS NOT NULL").groupBy(F.col("candidate_id").alias("candidate")).agg(F.count("*").alias("occurrences"))
    authority = t.docs_r.select(F.col("stable_id").alias("node"), (F.col("size") / 50.0).alias("rank"), F.lit(None).cast("double").alias("percentile"))
    return Li.standing(t.docs_r.withColumn("ecli", F.col("stable_id") + 1), counts, authority).select("stable_id", "cited_by", F.round("authority", 4).alias("authority"))


@query("SELECT stable_id FROM (SELECT *, CASE WHEN lower(title) = 'red' THEN 0 WHEN starts_with(lower(title), 'r') THEN 1 ELSE 2 END AS band FROM docs_r) ORDER BY band, size DESC, stable_id LIMIT 25", "docs_r")
def sort_listing_rank(t: Tables) -> DataFrame:
    rows = t.docs_r.withColumn("date", F.lit(None).cast("date"))
    return rows.orderBy(*Li.listing_order(F.col("title"), "r", "size", "date", "stable_id")).limit(25).select("stable_id")


@query("SELECT source, stable_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, stable_id) AS r FROM docs_r) WHERE r = 1 ORDER BY size DESC, stable_id LIMIT 10", "docs_r")
def topk_collapsed(t: Tables) -> DataFrame:
    return Li.collapsed_page(t.docs_r, "source", [F.desc("size"), F.asc("stable_id")], 10).select("source", "stable_id")


@query("SELECT stable_id FROM docs_l WHERE stable_id > 500 ORDER BY 1 LIMIT 40", "docs_l")
def page_keyset(t: Tables) -> DataFrame:
    return Li.after_key(t.docs_l.select("stable_id"), "stable_id", 500, 40)


@query("SELECT 50 AS n, 50 AS distinct_ids, true AS same")
def sample_seeded(t: Tables) -> DataFrame:
    a, b = (Li.sampled(t.docs_l.select("stable_id"), 50, 7, "stable_id") for _ in range(2))
    return a.join(b.withColumn("also", F.lit(True)), "stable_id", "left").agg(F.count("*").alias("n"), F.countDistinct("stable_id").alias("distinct_ids"), F.bool_and(F.coalesce("also", F.lit(False))).alias("same"))


@query("SELECT lower(p_name) AS name, p_partkey AS candidate_id FROM part WHERE (starts_with(lower(p_name), 'b') OR starts_with('the ' || lower(p_name), 'b')) AND p_size >= 3 AND p_partkey % 4 <> 0 AND starts_with(lower(p_name), 'bl') ORDER BY p_size DESC, 1, 2 LIMIT 20")
def text_typeahead(t: Tables) -> DataFrame:
    names = t.raw("part").select(F.col("p_name").alias("shorthand"), F.col("p_partkey").alias("candidate_id"), F.col("p_size").alias("doc_count"), (F.col("p_partkey") % 4 == 0).alias("blocked"))
    return Li.typeahead(names, " BL").select(F.lower("shorthand").alias("name"), "candidate_id")


@query("SELECT k, CASE WHEN k % 2 = 0 THEN 'a' WHEN k % 3 = 0 THEN 'b' ELSE 'c' END AS origin FROM (SELECT DISTINCT o_custkey AS k FROM orders) WHERE k % 2 = 0 OR k % 3 = 0 OR k % 5 = 0")
def set_first_wins(t: Tables) -> DataFrame:
    ids = t.raw("orders").select(F.col("o_custkey").alias("k")).distinct()
    return Li.first_wins([ids.filter(F.col("k") % m == 0).withColumn("origin", F.lit(n)) for m, n in ((2, "a"), (3, "b"), (5, "c"))], "k")


@query("WITH r AS (SELECT DISTINCT coalesce(CAST(candidate_id AS VARCHAR), raw) AS ref, src_id FROM rel WHERE status = 'pending' AND via <> 'inferred'), f AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY src_id) AS k FROM r) SELECT ref, string_agg(src_id, ',' ORDER BY src_id) AS citers FROM f WHERE k <= 10 GROUP BY 1", "rel")
def win_per_ref_cap(t: Tables) -> DataFrame:
    refs = t.rel.select(F.coalesce(F.col("candidate_id").cast("string"), "raw").alias("ref"))
    return Li.citers_of_references(t.rel, refs).select("ref", F.array_join(F.transform("citers", lambda x: x.cast("string")), ",").alias("citers"))


@query("SELECT raw AS ref, count(*) AS occurrences, count(DISTINCT src_id) AS citing FROM rel WHERE status = 'pending' GROUP BY 1", "rel")
def agg_worklist_live(t: Tables) -> DataFrame:
    return Li.live_worklist(t.rel)


@query("SELECT dst_id, count(DISTINCT src_id) AS n FROM rel WHERE via = 'inferred' AND src_id IS DISTINCT FROM dst_id AND dst_id IS NOT NULL GROUP BY 1", "rel")
def graph_inferred_citers(t: Tables) -> DataFrame:
    return Li.inferred_citers(t.rel)


@query("SELECT stable_id FROM docs_l WHERE court = 'BUILDING' AND stable_id IN (SELECT src_id FROM rel WHERE dst_id IN (7, 42) OR candidate_id IN (7, 42))", "docs_l rel")
def graph_citing_among(t: Tables) -> DataFrame:
    return Li.citing_among(t.rel, [7, 42], t.docs_l.filter("court = 'BUILDING'")).select("stable_id")


@query(f"SELECT src_id, coalesce(dst_id, candidate_id) AS base_id, count(*) AS n FROM rel WHERE type IN ({CITING}) AND coalesce(dst_id, candidate_id) % 50 = 7 AND src_id <> coalesce(dst_id, candidate_id) GROUP BY ALL", "rel")
def graph_applicable_sources(t: Tables) -> DataFrame:
    base = F.coalesce("dst_id", "candidate_id")
    return Pv.edges(t.rel, types=Pv.CITING_TYPES).filter((base % 50 == 7) & (F.col("src_id") != base)).groupBy("src_id", base.alias("base_id")).agg(F.count("*").alias("n"))


@query("WITH d AS (SELECT CAST(p_partkey AS VARCHAR) AS id, 'E' || p_size AS ecli FROM part WHERE p_partkey < 120) SELECT id AS stable_id, id AS identity FROM d UNION SELECT id, ecli FROM d UNION SELECT a.id, b.id FROM d a JOIN d b USING (ecli)")
def graph_identity_expansion(t: Tables) -> DataFrame:
    docs = t.raw("part").filter("p_partkey < 120").select(F.col("p_partkey").cast("string").alias("stable_id"), F.concat(F.lit("E"), "p_size").alias("ecli"))
    return Li.identities(docs)


@query("SELECT p_partkey AS old_id, first_value(p_partkey) OVER (PARTITION BY p_name, p_brand ORDER BY p_size DESC, p_partkey) AS new_id FROM part QUALIFY old_id <> new_id")
def dml_identity_merge(t: Tables) -> DataFrame:
    rows = t.raw("part").select(F.col("p_partkey").alias("stable_id"), F.concat_ws("|", "p_name", "p_brand").alias("key"), "p_size")
    return Li.merged_identities(rows, "key", [F.desc("p_size"), F.asc("stable_id")])


@query("SELECT stable_id, CAST(row_number() OVER (ORDER BY size DESC, stable_id) AS INTEGER) AS place FROM docs_r", "docs_r")
def win_rank_all(t: Tables) -> DataFrame:
    return R.rank_all(t.docs_r.select("stable_id", "size"), [F.desc("size"), F.asc("stable_id")], "place").select("stable_id", "place")
