"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..views import Tables
from .registry import query

CITED = "status = 'resolved' AND via <> 'inferred' AND type <> 'cited_by' AND src_id IS DISTINCT FROM dst_id"


@query(
    """SELECT coalesce(CAST(candidate_id AS VARCHAR), raw) AS ref, max(candidate_id) AS candidate_id, min(raw) AS raw, min(dst_anchor) AS anchor, string_agg(DISTINCT via, ',' ORDER BY via) AS via,
    count(*) AS occurrences, count(DISTINCT src_id) AS citing, bool_or(src_id IN (SELECT stable_id FROM docs_l WHERE source = 'F')) AS special
    FROM rel WHERE status = 'pending' AND via <> 'inferred' GROUP BY 1""",
    "docs_l rel",
)
def agg_worklist(t: Tables) -> DataFrame:
    return A.worklist(t.rel, t.docs_l)


@query("SELECT candidate_id, type AS kind, min(via) AS method, min(raw) AS raw, count(*) AS occurrences, count(DISTINCT src_id) AS documents FROM rel WHERE candidate_id IS NOT NULL GROUP BY ALL", "rel")
def agg_citation_counts(t: Tables) -> DataFrame:
    return A.citation_counts(t.rel)


@query("SELECT source, doc_type, court, CAST(year(decision_date) AS INTEGER) AS year, count(*) AS n, CAST(count(weight) AS BIGINT) AS with_weight FROM docs_l GROUP BY ALL", "docs_l")
def agg_corpus_shape(t: Tables) -> DataFrame:
    return A.corpus_shape(t.docs_l)


@query("SELECT coalesce(CAST(year(decision_date) AS VARCHAR), '?') AS year, count(*) AS n FROM docs_l GROUP BY 1", "docs_l")
def agg_corpus_counts_rollup(t: Tables) -> DataFrame:
    return A.corpus_counts(A.corpus_shape(t.docs_l), "year")


@query("SELECT d.source, count(*) AS resolved, count(DISTINCT dst_id) AS targets FROM rel JOIN docs_l d ON src_id = d.stable_id WHERE status = 'resolved' AND src_id IS DISTINCT FROM dst_id GROUP BY 1", "docs_l rel")
def agg_source_stats(t: Tables) -> DataFrame:
    return A.source_stats(t.rel, t.docs_l)


@query("SELECT source, count(*) AS n, CAST(min(decision_date) AS VARCHAR) AS first, CAST(max(decision_date) AS VARCHAR) AS last, count(*) FILTER (decision_date IS NULL) AS undated FROM docs_l GROUP BY 1", "docs_l")
def agg_source_date_ranges(t: Tables) -> DataFrame:
    return A.date_ranges(t.docs_l)


@query("SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'pending' AND candidate_id IS NULL) AS unnamed, count(*) FILTER (via = 'inferred') AS inferred, count(*) FILTER (status = 'resolved') AS resolved FROM rel", "rel")
def agg_queue_depths(t: Tables) -> DataFrame:
    return A.queue_depths(t.rel)


@query("SELECT type, count(*) AS total, count(*) FILTER (status = 'resolved') AS resolved, round(count(*) FILTER (status = 'resolved') / count(*), 6) AS ratio FROM rel GROUP BY 1", "rel")
def agg_resolution_coverage(t: Tables) -> DataFrame:
    return A.resolution_coverage(t.rel, "type")


@query(
    """WITH g AS (SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(doc_type) = 0 THEN 'doc_type' WHEN grouping(court) = 0 THEN 'court' ELSE 'year' END AS facet,
      coalesce(source, doc_type, court, year) AS value, count(*) AS n FROM (SELECT source, doc_type, court, CAST(year(decision_date) AS VARCHAR) AS year FROM docs_l) GROUP BY GROUPING SETS ((source), (doc_type), (court), (year)))
    SELECT facet, value, n FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS r FROM g WHERE value IS NOT NULL) WHERE r <= 40""",
    "docs_l",
)
def agg_facets_grouping_sets(t: Tables) -> DataFrame:
    return A.facets(t.docs_l.withColumn("year", F.year("decision_date")), ("source", "doc_type", "court", "year"))


@query("SELECT tag, count(DISTINCT doc_id) AS documents FROM tags GROUP BY 1", "tags")
def agg_tag_counts(t: Tables) -> DataFrame:
    return A.tag_counts(t.tags)


@query("SELECT lang, count(*) AS with_text, count(l.doc_id) AS covered FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE length(text) > 0 GROUP BY 1")
def agg_fts_coverage(t: Tables) -> DataFrame:
    return A.coverage(t.documents, t.raw("labels"), "lang")


@query("SELECT source, count(*) AS with_text, count(v.vec_id) AS covered FROM documents d LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) v ON d.doc_id = v.vec_id WHERE length(text) > 0 GROUP BY 1")
def agg_embedding_coverage(t: Tables) -> DataFrame:
    return A.coverage(t.documents, t.vectors.select(F.col("vec_id").alias("doc_id")), "source")


@query(f"SELECT dst_id, count(DISTINCT src_id) AS cited_by FROM rel WHERE {CITED} GROUP BY 1", "rel")
def agg_cited_by_counts(t: Tables) -> DataFrame:
    return A.cited_by_counts(t.rel)


@query(f"SELECT dst_id, type, count(DISTINCT src_id) AS citing FROM rel WHERE {CITED} GROUP BY ALL", "rel")
def agg_cited_by_types(t: Tables) -> DataFrame:
    return A.cited_by_types(t.rel)


@query(f"SELECT d.source, d.court, d.doc_type, count(DISTINCT src_id) AS citing FROM rel JOIN docs_l d ON src_id = d.stable_id WHERE {CITED} GROUP BY ALL", "docs_l rel")
def agg_cited_by_breakdown(t: Tables) -> DataFrame:
    return A.cited_by_breakdown(t.rel, t.docs_l)


@query(f"SELECT dst_id, count(DISTINCT src_id) AS total, count(DISTINCT CASE WHEN decision_date >= DATE '1999-01-01' THEN src_id END) AS recent FROM rel LEFT JOIN docs_l d ON src_id = d.stable_id WHERE {CITED} GROUP BY 1", "docs_l rel")
def agg_cited_by_stats(t: Tables) -> DataFrame:
    return A.cited_by_stats(t.rel, t.docs_l, "1999-01-01")


@query("SELECT dst_id, count(DISTINCT src_id // 4) AS citers FROM rel WHERE status = 'resolved' AND via <> 'inferred' AND type <> 'cited_by' AND src_id IS DISTINCT FROM dst_id GROUP BY 1", "rel")
def agg_family_citers(t: Tables) -> DataFrame:
    return A.family_citers(t.rel, F.floor(F.col("src_id") / 4))


@query("SELECT coalesce(dst_id, candidate_id) AS target, count(DISTINCT src_id) AS citers FROM rel WHERE via <> 'inferred' AND type <> 'cited_by' AND coalesce(dst_id, candidate_id) IS NOT NULL AND src_id <> coalesce(dst_id, candidate_id) GROUP BY 1", "rel")
def agg_combined_citers(t: Tables) -> DataFrame:
    return A.combined_citers(t.rel)


@query("SELECT dst_id, count(DISTINCT src_id) AS citing FROM rel WHERE status = 'resolved' AND dst_id IS NOT NULL AND src_id IN (SELECT stable_id FROM docs_l WHERE court = 'BUILDING') GROUP BY 1", "docs_l rel")
def agg_result_set_cites(t: Tables) -> DataFrame:
    return A.result_set_cites(t.rel, t.docs_l.filter(F.col("court") == "BUILDING"))


@query("SELECT candidate_id, max(n) AS occurrences FROM (SELECT candidate_id, type, count(*) AS n FROM rel WHERE candidate_id IS NOT NULL GROUP BY ALL) GROUP BY 1", "rel")
def agg_authority_counts(t: Tables) -> DataFrame:
    return A.authority_counts(A.citation_counts(t.rel))


@query("SELECT d.source, dst_id, raw, count(*) AS n FROM rel JOIN docs_l d ON src_id = d.stable_id WHERE via <> 'inferred' GROUP BY ALL", "docs_l rel")
def agg_outgoing_targets(t: Tables) -> DataFrame:
    return A.outgoing_targets(t.rel, t.docs_l)


@query("SELECT split_part(split_part(split_part(url, '://', 2), '?', 1), '/', 2) AS section, count(*) AS n FROM pages GROUP BY 1")
def agg_subtype_prefix(t: Tables) -> DataFrame:
    path = F.split_part(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1)), F.lit("/"), F.lit(2))
    return t.raw("pages").groupBy(path.alias("section")).agg(A.n())


@query("SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def agg_source_hosts(t: Tables) -> DataFrame:
    return t.raw("pages").groupBy(F.parse_url("url", F.lit("HOST")).alias("host")).agg(A.n())


@query(
    """WITH c AS (SELECT source, doc_type, count(*) AS n FROM docs_r GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, doc_type) AS k FROM c)
    SELECT source, CASE WHEN max(n) FILTER (k = 2) IS NULL OR max(n) FILTER (k = 1) >= 2 * max(n) FILTER (k = 2) THEN max(doc_type) FILTER (k = 1) END AS doc_type FROM r GROUP BY 1""",
    "docs_r",
)
def agg_dominant_type(t: Tables) -> DataFrame:
    return A.dominant(t.docs_r.groupBy("source", "doc_type").agg(A.n()), "source", "doc_type", "n", times=2)


@query("SELECT dst_anchor, candidate_id, count(DISTINCT src_id) AS documents FROM rel WHERE candidate_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT src_id) >= 3", "rel")
def agg_shorthand_evidence(t: Tables) -> DataFrame:
    return A.shorthand_evidence(t.rel.filter(F.col("candidate_id").isNotNull()), "dst_anchor", "candidate_id", "src_id")


@query("SELECT type, round(avg(CASE WHEN via = 'inferred' THEN 1.0 ELSE 0.0 END), 6) AS share FROM rel GROUP BY 1", "rel")
def agg_inferred_share(t: Tables) -> DataFrame:
    return A.share(t.rel, F.col("via") == "inferred", "type")


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def agg_last_run_per_kind(t: Tables) -> DataFrame:
    from ..operators.ranking import newest_n

    return newest_n(t.events, "event_type", [F.desc("ts"), F.desc("event_id")], 1).select("event_type", "event_id", "value")


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def agg_json_key(t: Tables) -> DataFrame:
    return t.events.groupBy(F.get_json_object("props", "$.k").alias("k")).agg(A.n(), F.round(F.sum("value"), 2).alias("total"))


@query(
    """WITH s AS (SELECT CAST(user_id AS VARCHAR) AS source, count(*) FILTER (event_type = 'error') AS failures, date_diff('day', max(CAST(ts AS DATE)), DATE '2024-01-31') AS stale_days, count(*) AS docs, avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0 END) AS ratio FROM events GROUP BY 1)
    SELECT source, 'failing' AS alert FROM s WHERE failures >= 3 UNION ALL SELECT source, 'stale' FROM s WHERE stale_days >= 14 AND docs > 0 UNION ALL SELECT source, 'model_ratio' FROM s WHERE ratio >= 0.5 AND docs >= 10"""
)
def alert_thresholds(t: Tables) -> DataFrame:
    stats = t.events.groupBy(F.col("user_id").cast("string").alias("source")).agg(F.count_if(F.col("event_type") == "error").alias("failures"), F.datediff(F.lit("2024-01-31"), F.max(F.to_date("ts"))).alias("stale_days"), F.count("*").alias("docs"), F.avg((F.col("event_type") == "view").cast("double")).alias("ratio"))
    return A.source_alerts(stats)
