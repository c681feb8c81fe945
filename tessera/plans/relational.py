"""Filters, joins, windows, sorts, set operations and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import legal as L
from ..functions import text as X
from ..operators import filters as Fi
from ..operators import ingest as I
from ..operators import joins as J
from ..operators import ranking as R
from ..views import Tables
from .registry import query


@query("SELECT stable_id, title FROM docs_r WHERE lower(title) LIKE '%ring%' AND (lower(title) LIKE '%s%' OR lower(doc_type) LIKE '%s%')", "docs_r")
def filter_tokenised_query(t: Tables) -> DataFrame:
    return t.docs_r.filter(Fi.tokenised_query("ring", "title") & Fi.tokenised_query("S", "title", "doc_type")).select("stable_id", "title")


@query("SELECT stable_id FROM docs_l WHERE (source IN ('F', 'BUILDING') AND coalesce(court, '') NOT LIKE 'MACH%') OR coalesce(court, '') IN ('F', 'BUILDING')", "docs_l")
def filter_source_or_court(t: Tables) -> DataFrame:
    return t.docs_l.filter(Fi.source_or_court(["F", "BUILDING"], ("MACH",))).select("stable_id")


@query("SELECT stable_id FROM docs_l WHERE year(decision_date) BETWEEN 1996 AND 1998", "docs_l")
def filter_year_range(t: Tables) -> DataFrame:
    return t.docs_l.filter(Fi.year_range("decision_date", 1996, 1998)).select("stable_id")


@query("SELECT stable_id FROM docs_l WHERE stable_id IN (SELECT src_id FROM rel WHERE dst_id = 42 OR candidate_id = 42)", "docs_l rel")
def filter_cites(t: Tables) -> DataFrame:
    return Fi.cites(t.docs_l, t.rel, 42).select("stable_id")


@query("SELECT stable_id, title FROM docs_r WHERE stable_id IN (SELECT dst_id FROM rel WHERE src_id = 5979 AND dst_id IS NOT NULL)", "docs_r rel")
def filter_cited_by(t: Tables) -> DataFrame:
    return Fi.cited_by(t.docs_r, t.rel, 5979).select("stable_id", "title")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM tags WHERE tag = 'toxic')", "tags")
def filter_tag_exists(t: Tables) -> DataFrame:
    return Fi.has_tag(t.documents, t.tags, "toxic").select("doc_id", "lang")


@query("SELECT DISTINCT replace(replace(replace(lower(dst_anchor), ' ', ''), '.', ''), '§', '') AS anchor FROM rel", "rel")
def filter_anchor_norm(t: Tables) -> DataFrame:
    return t.rel.select(X.anchor_norm(F.col("dst_anchor")).alias("anchor")).distinct()


@query("SELECT src_id, a FROM (SELECT src_id, 's' || supp || CASE WHEN quantity > 25 THEN '(1)' ELSE 'a' END AS a FROM rel) WHERE a = 's3' OR a LIKE 's3(%'", "rel")
def filter_anchor_family(t: Tables) -> DataFrame:
    a = F.concat(F.lit("s"), F.col("supp"), F.when(F.col("quantity") > 25, "(1)").otherwise("a"))
    return t.rel.select("src_id", a.alias("a")).filter(X.anchor_in_family(F.col("a"), F.lit("s3")))


@query("SELECT stable_id FROM docs_l WHERE source = 'F' AND doc_type IN ('5-LOW', '1-URGENT') AND decision_date >= DATE '1997-01-01'", "docs_l")
def filter_retrieval_prefilter(t: Tables) -> DataFrame:
    return Fi.retrieval_prefilter(t.docs_l, sources=["F"], doc_types=["5-LOW", "1-URGENT"], year_from=1997).select("stable_id")


@query("SELECT doc_id FROM documents WHERE length(text) > 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def filter_text_worklist(t: Tables) -> DataFrame:
    return Fi.text_worklist(t.documents, t.raw("labels")).select("doc_id")


@query("SELECT stable_id, source = 'O' AND stable_id NOT IN (SELECT src_id FROM rel) AS search_excluded FROM docs_l", "docs_l rel")
def filter_relevance_gate(t: Tables) -> DataFrame:
    return Fi.relevance_gate(t.docs_l, t.rel, F.col("source") == "O").select("stable_id", "search_excluded")


@query("SELECT src_id, raw, CAST(min(p.stable_id) AS BIGINT) AS matched FROM rel LEFT JOIN (SELECT stable_id, CAST(stable_id AS VARCHAR) AS k FROM docs_r UNION SELECT stable_id, CAST(stable_id + 100000 AS VARCHAR) FROM docs_r) p ON CAST(candidate_id AS VARCHAR) = k WHERE status = 'pending' GROUP BY src_id, raw", "docs_r rel")
def join_or_key(t: Tables) -> DataFrame:
    docs = t.docs_r.withColumn("second", F.col("stable_id") + 100000)
    return J.or_key_join(t.rel.filter("status = 'pending'"), docs, ("stable_id", "second")).groupBy("src_id", "raw").agg(F.min("matched").alias("matched"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def join_anti_embedding_backlog(t: Tables) -> DataFrame:
    return t.documents.join(t.vectors.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id")


@query("SELECT candidate_id, count(*) AS n FROM rel WHERE candidate_id IS NOT NULL AND candidate_id NOT IN (SELECT stable_id FROM docs_r WHERE size < 40) GROUP BY 1", "docs_r rel")
def join_left_null_unheld(t: Tables) -> DataFrame:
    return J.unheld(t.rel, t.docs_r.filter("size < 40")).groupBy("candidate_id").agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT stable_id AS alias, stable_id + size * 37 AS canonical_id FROM docs_r) SELECT alias, canonical_id FROM a WHERE canonical_id NOT IN (SELECT stable_id FROM docs_r WHERE size > 10) AND canonical_id NOT IN (SELECT alias FROM a)", "docs_r")
def join_double_anti_alias(t: Tables) -> DataFrame:
    aliases = t.docs_r.select(F.col("stable_id").alias("alias"), (F.col("stable_id") + F.col("size") * 37).alias("canonical_id"))
    return J.dangling(aliases, t.docs_r.filter("size > 10")).select("alias", "canonical_id")


@query("SELECT r.src_id AS ref_id, r.base_id, CAST(r.ref_date AS VARCHAR) AS ref_date, CAST(v.version_date AS VARCHAR) AS version_date FROM (SELECT DISTINCT src_id, candidate_id AS base_id, decision_date AS ref_date FROM rel JOIN docs_l ON src_id = stable_id WHERE candidate_id IS NOT NULL AND decision_date IS NOT NULL) r ASOF JOIN versions v ON r.base_id = v.base_id AND r.ref_date >= v.version_date", "docs_l rel versions")
def join_asof_batch(t: Tables) -> DataFrame:
    refs = t.rel.filter("candidate_id IS NOT NULL").join(t.docs_l.select(F.col("stable_id").alias("src_id"), "decision_date"), "src_id").filter("decision_date IS NOT NULL").select(F.col("src_id").alias("ref_id"), F.col("candidate_id").alias("base_id"), F.col("decision_date").alias("ref_date")).distinct()
    return J.asof_latest(t.versions, refs).select("ref_id", "base_id", F.col("ref_date").cast("string").alias("ref_date"), F.col("version_date").cast("string").alias("version_date"))


@query("SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND epoch_us(b.ts) - epoch_us(a.ts) BETWEEN 0 AND 600000000")
def join_band_proximity(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", (F.unix_micros("ts")).alias("at"))
    return J.band_join(rows, "user_id", "at", "event_id", 0, 600_000_000).select("user_id", "a_id", "b_id")


@query("SELECT supp FROM rel WHERE dst_id IN (7, 11) GROUP BY 1 HAVING count(DISTINCT dst_id) = 2", "rel")
def join_relational_division(t: Tables) -> DataFrame:
    return J.relational_division(t.rel, [7, 11], src="supp")


@query("WITH m AS (SELECT stable_id AS previous_id, stable_id + 1 AS current_id, 's. ' || (size % 7 + 1) AS previous_anchor, DATE '1999-01-01' AS inherit_before FROM docs_r WHERE size % 3 = 0) SELECT src_id, current_id, dst_anchor FROM rel JOIN m ON dst_id = previous_id WHERE (dst_anchor = previous_anchor OR dst_anchor LIKE previous_anchor || '(%') AND event_date <= inherit_before AND src_id <> current_id", "docs_r rel")
def join_lineage_theta(t: Tables) -> DataFrame:
    m = t.docs_r.filter("size % 3 = 0").select(F.col("stable_id").alias("previous_id"), (F.col("stable_id") + 1).alias("current_id"), F.concat(F.lit("s. "), F.col("size") % 7 + 1).alias("previous_anchor"), F.to_date(F.lit("1999-01-01")).alias("inherit_before"))
    return J.lineage(t.rel, m, X.anchor_in_family(F.col("dst_anchor"), F.col("previous_anchor"))).select("src_id", "current_id", "dst_anchor")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3")
def win_newest_n_per_group(t: Tables) -> DataFrame:
    return R.newest_n(t.events, "user_id", [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id")


@query("SELECT stable_id, round(100 * cume_dist() OVER (ORDER BY weight), 6) AS percentile FROM docs_l WHERE source = 'F' UNION ALL SELECT stable_id, NULL FROM docs_l WHERE source <> 'F'", "docs_l")
def win_cume_percentile(t: Tables) -> DataFrame:
    return R.percentile_among(t.docs_l, "weight", F.col("source") == "F").select("stable_id", F.round("percentile", 6).alias("percentile"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS per_hour, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS per_day FROM events")
def win_rolling_budget(t: Tables) -> DataFrame:
    return R.rolling_counts(t.events, "user_id", "ts", {"per_hour": 3600, "per_day": 86400}).select("event_id", "per_hour", "per_day")


@query("SELECT p_size AS family, p_partkey AS version, CAST(first_rank AS BIGINT) AS first_rank FROM (SELECT *, min(p_partkey % 97) OVER (PARTITION BY p_size) AS first_rank, row_number() OVER (PARTITION BY p_size ORDER BY (p_partkey % 3 = 0) DESC, p_partkey DESC) AS r FROM part) WHERE r = 1")
def win_version_collapse(t: Tables) -> DataFrame:
    rows = t.raw("part").select(F.col("p_size").alias("family"), F.col("p_partkey").alias("version"), (F.col("p_partkey") % 3 == 0).alias("has_text"), (F.col("p_partkey") % 97).alias("rank"))
    return R.collapse_versions(rows, "family", "version", "rank").select("family", "version", "first_rank")


@query("WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600000000 THEN 1 ELSE 0 END AS fresh FROM events) SELECT event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS \"group\" FROM g")
def win_gap_groups(t: Tables) -> DataFrame:
    rows = t.events.withColumn("at", F.unix_micros("ts"))
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.coalesce((F.col("at") - F.lag("at").over(w) > 3_600_000_000).cast("long"), F.lit(0))
    return rows.withColumn("fresh", fresh).select("event_id", F.sum("fresh").over(w).alias("group"))


@query("SELECT event_id, CASE WHEN e - w.at <= 86400000000 THEN w.v END AS nearest FROM (SELECT *, epoch_us(ts) AS e, max(CASE WHEN event_type = 'signup' THEN {'at': epoch_us(ts), 'v': event_id} END) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM events)")
def win_nearest_before(t: Tables) -> DataFrame:
    rows = t.events.withColumn("at", F.unix_micros("ts"))
    return R.nearest_before(rows, "user_id", "at", F.col("event_type") == "signup", "event_id", 86_400_000_000).select("event_id", "nearest")


@query("SELECT stable_id, CASE WHEN lower(title) = 'ring' THEN 0 WHEN lower(title) LIKE 'ring%' THEN 1 WHEN lower(title) LIKE '%ring%' THEN 2 ELSE 3 END AS band FROM docs_r ORDER BY band, stable_id LIMIT 50", "docs_r")
def sort_relevance_bands(t: Tables) -> DataFrame:
    return R.page(t.docs_r.select("stable_id", R.relevance_band(F.col("title"), "ring").alias("band")), ["band", "stable_id"], 50)


@query("SELECT stable_id, CAST(decision_date AS VARCHAR) AS decision_date FROM docs_l ORDER BY docs_l.decision_date ASC NULLS LAST, stable_id LIMIT 100", "docs_l")
def sort_nulls_last(t: Tables) -> DataFrame:
    return R.page(t.docs_l, R.sort_order("date_asc"), 100).select("stable_id", F.col("decision_date").cast("string").alias("decision_date"))


@query("SELECT candidate_id, count(*) AS n FROM rel WHERE candidate_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, candidate_id LIMIT 20 OFFSET 40", "rel")
def topk_paged(t: Tables) -> DataFrame:
    return R.page(t.rel.filter("candidate_id IS NOT NULL").groupBy("candidate_id").agg(F.count("*").alias("n")), [F.desc("n"), "candidate_id"], 20, 40)


@query("SELECT CAST(least(count(*), 1000) AS BIGINT) AS n, count(*) > 1000 AS more FROM rel", "rel")
def count_capped(t: Tables) -> DataFrame:
    return R.capped_count(t.rel, 1000)


@query("SELECT doc_id AS id, 0 AS part FROM documents UNION ALL SELECT page_id, -1 FROM pages")
def set_union_all_parts(t: Tables) -> DataFrame:
    body, heads = t.documents.select(F.col("doc_id").alias("id"), F.lit(0).alias("part")), t.raw("pages").select(F.col("page_id").alias("id"), F.lit(-1).alias("part"))
    return body.unionByName(heads)


@query("SELECT d.doc_id AS stable_id, CASE WHEN d.doc_id % 3 = 0 AND d.doc_id % 2 = 0 THEN 2 ELSE 1 END AS version, d.doc_id % 5 = 0 AS search_excluded FROM documents d")
def dml_upsert_version(t: Tables) -> DataFrame:
    base = t.documents.select(F.col("doc_id").alias("stable_id"), F.sha2("text", 256).alias("payload_hash"), F.lit(1).alias("version"), (F.col("doc_id") % 5 == 0).alias("search_excluded"))
    new = base.filter("stable_id % 3 = 0").withColumn("payload_hash", F.when(F.col("stable_id") % 2 == 0, F.lit("changed")).otherwise(F.col("payload_hash"))).withColumn("search_excluded", F.lit(False))
    return I.upsert_versions(base, new).select("stable_id", "version", "search_excluded")


@query("SELECT src_id, dst_anchor, min(candidate_id) AS candidate_id FROM rel WHERE candidate_id IS NOT NULL GROUP BY ALL", "rel")
def dml_dedup_min_id(t: Tables) -> DataFrame:
    from ..operators.quality import repair_duplicate_spans

    return repair_duplicate_spans(t.rel.filter("candidate_id IS NOT NULL"), "candidate_id", "src_id", "dst_anchor").select("src_id", "dst_anchor", "candidate_id")


@query("SELECT doc_id, tag, min(added_by) AS added_by FROM (SELECT doc_id, tag, 'manual' AS added_by FROM tags UNION ALL SELECT doc_id, 'quality', 'rule' FROM documents WHERE doc_id % 2 = 0) GROUP BY ALL", "tags")
def dml_manual_wins(t: Tables) -> DataFrame:
    rule = t.documents.filter("doc_id % 2 = 0").select("doc_id", F.lit("quality").alias("tag"), F.lit("rule").alias("added_by"))
    return I.merge_manual_wins(t.tags.withColumn("added_by", F.lit("manual")), rule, ["doc_id", "tag"])


@query("SELECT sha256(text) AS payload_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def text_content_hash_dedup(t: Tables) -> DataFrame:
    return I.by_content(t.documents)


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-18'")
def ingest_overlap_window(t: Tables) -> DataFrame:
    return I.since(t.events.withColumn("date", F.to_date("ts")), "2024-01-20", 2).select("event_id")


@query("SELECT CAST(least(max(CAST(ts AS DATE)), DATE '2024-01-15') AS VARCHAR) AS watermark FROM events WHERE CAST(ts AS DATE) < (SELECT min(CAST(ts AS DATE)) FROM events WHERE event_type = 'error' AND value > 480)")
def ingest_freeze_and_clamp(t: Tables) -> DataFrame:
    run = t.events.select(F.to_date("ts").alias("date"), (~((F.col("event_type") == "error") & (F.col("value") > 480))).alias("ok"))
    return I.next_watermark(run, "2024-01-15").select(F.col("watermark").cast("string").alias("watermark"))


@query("WITH r AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS stored, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT CAST(user_id AS BIGINT) AS source_key FROM r WHERE k <= 3 GROUP BY 1 HAVING count(*) = 3 AND sum(stored) = 0")
def drain_health(t: Tables) -> DataFrame:
    runs = t.events.select(F.col("user_id").cast("long").alias("source_key"), F.col("event_id").alias("run_id"), (F.col("event_type") == "purchase").cast("int").alias("stored"))
    return I.drained(runs)


@query("SELECT CAST(user_id AS BIGINT) AS job_id, arg_max(event_type, row(ts, event_type)) AS state FROM events GROUP BY 1")
def job_last_state(t: Tables) -> DataFrame:
    return I.job_states(t.events.select(F.col("user_id").cast("long").alias("job_id"), F.col("ts").alias("at"), F.col("event_type").alias("state"))).select("job_id", "state")


@query("SELECT user_id, CAST(least(21 * power(2, least(count(*), 3)), 168) AS BIGINT) AS days FROM events WHERE event_type = 'error' GROUP BY 1")
def scalar_backoff(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'error'").groupBy("user_id").agg(L.backoff_days(F.count("*")).alias("days"))


@query("SELECT stable_id, CAST(coalesce(decision_date, CASE WHEN stable_id % 20 = 0 THEN DATE '2001-12-31' END) AS VARCHAR) AS date, CASE WHEN decision_date IS NOT NULL THEN 'decision_date' WHEN stable_id % 20 = 0 THEN 'identifier' ELSE 'none' END AS origin FROM docs_l", "docs_l")
def scalar_effective_date(t: Tables) -> DataFrame:
    ident = F.when(F.col("stable_id") % 20 == 0, F.concat(F.lit("uksc/2001/"), "stable_id")).otherwise(F.col("stable_id").cast("string"))
    rows = t.docs_l.select("stable_id", L.effective_date(F.col("decision_date"), ident).alias("e"))
    return rows.select("stable_id", F.col("e.date").cast("string").alias("date"), "e.origin")


@query("SELECT base_id, CAST(version_date AS VARCHAR) AS date FROM versions", "versions")
def scalar_version_suffix(t: Tables) -> DataFrame:
    v = t.versions.select(F.concat_ws("@", F.col("base_id"), F.col("version_date").cast("string")).alias("v")).select(L.version_base_and_date(F.col("v")).alias("s"))
    return v.select(F.col("s.base").cast("long").alias("base_id"), F.col("s.date").cast("string").alias("date"))


@query("SELECT DISTINCT l_partkey AS id, 'ref' AS matcher, CAST(l_partkey AS VARCHAR) AS candidate FROM lineitem")
def scalar_matcher_ladder(t: Tables) -> DataFrame:
    m = t.raw("lineitem").select(F.col("l_partkey").alias("id")).distinct().withColumn("m", L.match_reference(F.concat(F.lit("see ref-"), "id")))
    return m.select("id", "m.matcher", "m.candidate")


@query("SELECT doc_id, lower(strip_accents(text)) AS folded FROM documents")
def scalar_fold(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.fold_latin(F.col("text")).alias("folded"))


@query("SELECT stable_id, round(power(0.5, greatest(0, CASE WHEN decision_date IS NULL THEN 15.0 ELSE 2026 - year(decision_date) END) / 10), 9) AS weight FROM docs_l", "docs_l")
def scalar_decay_weight(t: Tables) -> DataFrame:
    return t.docs_l.select("stable_id", F.round(L.decay_weight(F.year("decision_date"), 2026), 9).alias("weight"))
