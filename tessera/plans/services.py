"""Jobs, ingest, resolution and what readers ask, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ingest as I
from ..operators import jobs as Jb
from ..operators import resolve as Re
from ..operators import services as Sv
from ..operators import text as Tx
from ..views import Tables
from .registry import query

JOBS = """SELECT event_id AS job_id, ['queued', 'running', 'done', 'error', 'interrupted'][1 + event_id % 5] AS status, ts AS started_at, CASE WHEN event_id % 7 <> 0 THEN ts + INTERVAL (event_id % 400) SECOND END AS heartbeat_at,
    CASE WHEN event_id % 3 <> 0 THEN ts - INTERVAL (event_id % 4000) SECOND END AS progress_at, event_type AS kind, CASE WHEN user_id % 4 <> 0 THEN 's' || user_id % 6 END AS source, props AS params, event_id % 12 AS resumes, user_id % 3 AS stored, ts + INTERVAL 1 HOUR AS finished_at FROM events"""


def _jobs(t: Tables) -> DataFrame:
    k, ts = F.col("event_id"), F.col("ts")
    later = lambda s: F.timestamp_seconds(F.unix_micros(ts) / 1e6 + s)
    return t.events.select(
        k.alias("job_id"), F.element_at(F.array(*map(F.lit, ("queued", "running", "done", "error", "interrupted"))), (1 + k % 5).cast("int")).alias("status"), ts.alias("started_at"), F.when(k % 7 != 0, later(k % 400)).alias("heartbeat_at"),
        F.when(k % 3 != 0, later(-(k % 4000))).alias("progress_at"), F.col("event_type").alias("kind"), F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("s"), F.col("user_id") % 6)).alias("source"), F.col("props").alias("params"),
        (k % 12).alias("resumes"), (F.col("user_id") % 3).alias("stored"), later(3600).alias("finished_at"),
    )


@query(f"SELECT job_id, CAST(row_number() OVER (ORDER BY started_at, job_id) AS INTEGER) AS place FROM ({JOBS}) WHERE status = 'queued'")
def job_fifo(t: Tables) -> DataFrame:
    return Jb.fifo(_jobs(t)).select("job_id", "place")


@query(f"SELECT job_id, CASE WHEN heartbeat_at IS NULL THEN 'orphan' WHEN epoch(TIMESTAMP '2024-01-15 00:00:00') - floor(epoch(heartbeat_at)) > 150 THEN 'stalled' WHEN epoch(TIMESTAMP '2024-01-15 00:00:00') - floor(epoch(coalesce(progress_at, started_at))) > 1800 THEN 'wedged' ELSE 'well' END AS health FROM ({JOBS}) WHERE status = 'running'")
def job_health(t: Tables) -> DataFrame:
    return Jb.health(_jobs(t), F.lit("2024-01-15 00:00:00").cast("timestamp")).select("job_id", "health")


@query(f"SELECT job_id FROM ({JOBS}) WHERE status = 'interrupted' AND resumes < 8")
def job_resumable(t: Tables) -> DataFrame:
    return Jb.resumable(_jobs(t)).select("job_id")


@query(f"WITH j AS ({JOBS}) SELECT job_id FROM j WHERE status = 'running' UNION ALL (SELECT job_id FROM j WHERE status <> 'running' ORDER BY started_at DESC, job_id LIMIT 200)")
def job_prune(t: Tables) -> DataFrame:
    return Jb.pruned(_jobs(t)).select("job_id")


@query(f"""WITH j AS ({JOBS}), r AS (SELECT * FROM j WHERE status = 'running' ORDER BY job_id LIMIT 9)
    SELECT job_id, EXISTS (SELECT 1 FROM r WHERE (j.kind IN ('click', 'view') AND r.kind IN ('click', 'view') AND (j.source IS NULL OR r.source IS NULL OR j.source = r.source)) OR (j.kind = 'signup' AND r.kind = 'signup') OR (j.kind = 'purchase' AND r.kind = 'purchase' AND j.params = r.params)) AS blocked FROM j WHERE status = 'queued'""")
def job_conflicts(t: Tables) -> DataFrame:
    j = _jobs(t)
    running = j.filter("status = 'running'").orderBy("job_id").limit(9)  # as many as may run
    return Jb.blocked(j.filter("status = 'queued'"), running, scans=("click", "view"), singletons=("signup",), deduped=("purchase",)).select("job_id", "blocked")


@query(f"WITH j AS ({JOBS}), c AS (SELECT 'click' AS kind, 'view' AS follow_up, 300 AS cool_down UNION ALL SELECT 'view', 'signup', 86400) SELECT job_id, follow_up FROM (SELECT j.job_id, c.follow_up, cool_down, finished_at, (SELECT max(started_at) FROM j k WHERE k.kind = c.follow_up AND k.started_at <= j.finished_at) AS last FROM j JOIN c USING (kind) WHERE status = 'done' AND stored > 0) WHERE last IS NULL OR floor(epoch(finished_at)) - floor(epoch(last)) >= cool_down")
def job_follow_ups(t: Tables) -> DataFrame:
    chain = t.spark.createDataFrame([("click", "view", 300), ("view", "signup", 86400)], "kind string, follow_up string, cool_down int")
    return Jb.follow_ups(_jobs(t), chain)


@query("SELECT user_id AS job_id, arg_min(event_id, (ts, event_id)) AS worker FROM events GROUP BY 1")
def job_claims(t: Tables) -> DataFrame:
    return Jb.claimed(t.events.select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), F.col("event_id").alias("worker")))


@query("SELECT n_nationkey AS task FROM nation WHERE n_nationkey % 4 <> 0 AND (n_nationkey % 3 = 0 OR 600 >= 60 * n_nationkey) AND (n_nationkey % 2 = 0 OR n_nationkey = 13)")
def job_due(t: Tables) -> DataFrame:
    n = F.col("n_nationkey")
    tasks = t.raw("nation").select(n.alias("task"), (n % 4 != 0).alias("enabled"), F.when(n % 3 != 0, n).alias("minutes"), F.when(n % 2 != 0, n).alias("hour"), F.lit("2024-01-15 13:00:00").cast("timestamp").alias("last_started"))
    return Jb.due(tasks, F.lit("2024-01-15 13:10:00").cast("timestamp")).select("task")


@query(
    """WITH s AS (SELECT l_partkey AS stable_id, 'u' || l_suppkey AS landing_url, 'h' || l_linenumber AS contenthash, l_returnflag = 'A' AND l_quantity > 45 AS revision, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS position FROM lineitem),
    h AS (SELECT p_partkey * 2 AS stable_id, CASE WHEN p_partkey % 3 = 0 THEN 'u' || p_partkey END AS landing_url, 'h1' AS contenthash FROM part), u AS (SELECT landing_url, min(stable_id) AS id FROM h WHERE landing_url IS NOT NULL GROUP BY 1),
    f AS (SELECT s.stable_id, s.contenthash, s.revision, position, coalesce(h.stable_id, u.id, CASE WHEN s.stable_id % 5 = 0 THEN 2 END) AS held_id, row_number() OVER (PARTITION BY s.stable_id ORDER BY position) AS r FROM s LEFT JOIN h ON h.stable_id = s.stable_id LEFT JOIN u ON u.landing_url = s.landing_url)
    SELECT stable_id, CASE WHEN r > 1 THEN 'repeat' WHEN held_id IS NULL THEN 'new' WHEN revision OR contenthash <> 'h1' THEN 'refetch' ELSE 'held' END AS decision, count(*) AS n FROM f GROUP BY ALL"""
)
def ingest_ladder(t: Tables) -> DataFrame:
    from ..operators.ranking import rank_all

    line = t.raw("lineitem")
    order = [F.asc(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")]
    stubs = rank_all(line, order, "position").select(F.col("l_partkey").alias("stable_id"), F.concat(F.lit("u"), "l_suppkey").alias("landing_url"), F.concat(F.lit("h"), "l_linenumber").alias("contenthash"), ((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 45)).alias("revision"), "position")
    held = t.raw("part").select((F.col("p_partkey") * 2).alias("stable_id"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("u"), "p_partkey")).alias("landing_url"), F.lit("h1").alias("contenthash"))
    aliases = t.raw("part").filter("p_partkey % 5 = 0").select(F.col("p_partkey").alias("alias"), F.lit(2).cast("long").alias("canonical_id"))
    return I.ladder(stubs, held, aliases).groupBy("stable_id", "decision").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS stable_id, CASE WHEN p_partkey IN (SELECT l_partkey FROM (SELECT l_partkey, arg_max(l_linenumber, (l_shipdate, l_orderkey, l_linenumber)) AS s FROM lineitem GROUP BY 1) WHERE s = 4) THEN 'gone_404' ELSE 'live' END AS upstream_status FROM part")
def ingest_tombstones(t: Tables) -> DataFrame:
    docs = t.raw("part").select(F.col("p_partkey").alias("stable_id"), F.lit("live").alias("upstream_status"))
    fetches = t.raw("lineitem").select(F.col("l_partkey").alias("stable_id"), F.when(F.col("l_linenumber") == 4, 404).otherwise(200).alias("status"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"))
    return I.with_tombstones(docs, fetches)


@query("SELECT p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE CAST(l_shipdate AS DATE) > DATE '2001-06-01' - 30)")
def ingest_miss_ttl(t: Tables) -> DataFrame:
    misses = t.raw("lineitem").select(F.col("l_partkey").alias("key"), F.to_date("l_shipdate").alias("at"))
    return I.worth_asking(t.raw("part").select(F.col("p_partkey").alias("key")), misses, "2001-06-01", 30)


@query("SELECT user_id AS source_key, arg_max(CAST(value AS INTEGER), event_id) AS frontier FROM events WHERE event_type <> 'error' AND event_id % 3 <> 0 AND event_id % 11 <> 0 GROUP BY 1")
def ingest_backfill_frontier(t: Tables) -> DataFrame:
    runs = t.events.select(F.col("user_id").alias("source_key"), F.col("event_id").alias("run_id"), F.rint("value").cast("int").alias("page"), (F.col("event_type") == "error").cast("int").alias("errors"), (F.col("event_id") % 3 == 0).alias("capped"), (F.col("event_id") % 11 == 0).alias("rate_limited"))
    return I.backfill_frontier(runs)


@query("SELECT CAST(k // 500 AS BIGINT) AS window, sum(CASE WHEN status = 'resolved' OR candidate % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS resolved, count(*) AS n FROM (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'pending' END AS status, o_custkey AS candidate FROM orders) GROUP BY 1")
def resolve_batched(t: Tables) -> DataFrame:
    edges = t.raw("orders").select(F.col("o_orderkey").alias("edge_id"), F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("pending").alias("status"), F.col("o_custkey").cast("string").alias("candidate"), F.lit("raw").alias("raw"), F.when(F.col("o_orderstatus") == "F", "x").alias("dst_id"))
    docs = t.raw("customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("stable_id"), F.lit(None).cast("string").alias("ecli"))
    none = t.spark.createDataFrame([], "alias string, canonical_id string")
    return Re.resolve_batched(edges, docs, none, 500).groupBy("window").agg(F.count_if(F.col("status") == "resolved").alias("resolved"), F.count("*").alias("n"))


@query("SELECT 'b' || l_partkey AS alias, 'b' || l_partkey || '@' || strftime(max(l_shipdate), '%Y-%m-%d') AS canonical_id, 'version' AS owner FROM lineitem WHERE l_partkey % 3 <> 0 AND l_partkey % 7 <> 0 GROUP BY l_partkey UNION ALL SELECT 'b' || p_partkey, 'kept', 'manual' FROM part WHERE p_partkey % 7 = 0")
def resolve_version_refresh(t: Tables) -> DataFrame:
    line = t.raw("lineitem").select(F.concat(F.lit("b"), "l_partkey", F.lit("@"), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("stable_id")).distinct().withColumn("has_text", F.lit(True))
    bases = t.raw("part").filter("p_partkey % 3 = 0").select(F.concat(F.lit("b"), "p_partkey").alias("stable_id"), F.lit(True).alias("has_text"))
    old = t.raw("part").select(F.concat(F.lit("b"), "p_partkey").alias("alias"), F.when(F.col("p_partkey") % 7 == 0, "kept").otherwise("old").alias("canonical_id"), F.when(F.col("p_partkey") % 7 == 0, "manual").otherwise("version").alias("owner"))
    edges = t.spark.createDataFrame([], "dst_id string")
    return Re.refresh_version_aliases(line.unionByName(bases), old, edges)[0]


@query("SELECT 'The ' || p_name || ' Regulations ' || p_size AS ref, min(p_partkey) AS stable_id FROM part GROUP BY p_name, p_size HAVING count(*) = 1")
def resolve_statutes(t: Tables) -> DataFrame:
    p = t.raw("part")
    held = p.select(F.col("p_partkey").alias("stable_id"), F.concat(F.col("p_name"), F.lit(" regs. "), F.col("p_size")).alias("title"))
    return Re.match_statutes(p.select(F.concat(F.lit("The "), "p_name", F.lit(" Regulations "), "p_size").alias("ref")), held)


@query("SELECT a.c_custkey AS left_id, b.s_suppkey AS right_id, CASE WHEN a.c_custkey % 3 = 0 THEN 0.45 ELSE 1.0 END AS score FROM customer a JOIN supplier b ON a.c_nationkey = b.s_nationkey AND b.s_suppkey % 3 = a.c_custkey % 3 AND (a.c_custkey % 3 = 0 OR a.c_custkey % 3 = b.s_suppkey % 3)")
def resolve_applicants(t: Tables) -> DataFrame:
    def case(key: str, nation: str) -> F.Column:
        k = F.col(key) % 3
        state = F.element_at(F.array(F.lit("Turkey"), F.lit("France")), (F.col(nation) % 2 + 1).cast("int"))
        return F.concat(F.when(k == 0, "M.C.").when(k == 1, "Ivanova").otherwise("Petrov and Petrov"), F.lit(" v "), state)

    left = t.raw("customer").select(F.col("c_custkey").alias("id"), case("c_custkey", "c_nationkey").alias("name"), (1950 + 10 * F.col("c_nationkey")).alias("year"))
    right = t.raw("supplier").select(F.col("s_suppkey").alias("id"), case("s_suppkey", "s_nationkey").alias("name"), (1950 + 10 * F.col("s_nationkey")).alias("year"))
    return Re.match_applicants(left, right, ("Turkey", "France"))


@query("SELECT ref, suggested_id, CASE WHEN ref % 3 = 0 THEN 'accepted' ELSE 'pending' END AS status, CASE WHEN ref % 3 <> 0 AND ref % 2 = 0 THEN 0.9 ELSE 0.5 END AS score FROM (SELECT p_partkey AS ref, p_size AS suggested_id FROM part) UNION ALL SELECT p_partkey, p_size + 100, 'pending', 0.9 FROM part WHERE p_partkey % 2 = 0")
def resolve_suggestions(t: Tables) -> DataFrame:
    p = t.raw("part")
    held = p.select(F.col("p_partkey").alias("ref"), F.col("p_size").alias("suggested_id"), F.when(F.col("p_partkey") % 3 == 0, "accepted").otherwise("pending").alias("status"), F.lit(0.5).alias("score"))
    even = p.filter("p_partkey % 2 = 0")
    new = even.select(F.col("p_partkey").alias("ref"), F.col("p_size").alias("suggested_id"), F.lit(0.9).alias("score")).unionByName(even.select(F.col("p_partkey").alias("ref"), (F.col("p_size") + 100).alias("suggested_id"), F.lit(0.9).alias("score")))
    return Re.put_suggestions(held, new)


ROUTED = "CASE l_partkey % 4 WHEN 0 THEN '6' || year(l_shipdate) || 'CJ' || lpad(CAST(l_partkey % 10000 AS VARCHAR), 4, '0') WHEN 1 THEN 'ukpga/' || l_partkey WHEN 2 THEN 'ECLI:NL:' || l_partkey ELSE 'odd ' || l_partkey END"


@query(f"WITH c AS (SELECT {ROUTED} AS candidate, count(*) AS n FROM lineitem GROUP BY 1) SELECT CASE WHEN candidate LIKE '6%' THEN 'CJEU judgment' WHEN candidate LIKE 'ukpga%' THEN 'UK legislation' WHEN candidate LIKE 'ECLI%' THEN 'ECLI judgment (NL)' ELSE 'unknown' END AS form, sum(n)::BIGINT AS occurrences, count(*) AS candidates FROM c WHERE candidate NOT LIKE 'ukpga/1%' GROUP BY 1")
def agg_frontier(t: Tables) -> DataFrame:
    part, k = F.col("l_partkey"), F.col("l_partkey") % 4
    shape = F.when(k == 0, F.concat(F.lit("6"), F.year("l_shipdate"), F.lit("CJ"), F.lpad((part % 10000).cast("string"), 4, "0"))).when(k == 1, F.concat(F.lit("ukpga/"), part)).when(k == 2, F.concat(F.lit("ECLI:NL:"), part)).otherwise(F.concat(F.lit("odd "), part))
    counts = t.raw("lineitem").groupBy(shape.alias("candidate")).agg(F.count("*").alias("occurrences"))
    held = counts.filter(F.col("candidate").like("ukpga/1%")).select(F.col("candidate").alias("stable_id"))
    return Re.frontier(counts, held).select("form", "occurrences", "candidates")


@query("SELECT 'a' || p_size AS alias, count(DISTINCT p_brand) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def quality_chamber_aliases(t: Tables) -> DataFrame:
    return Re.contested_divisions(t.raw("part").select(F.concat(F.lit("a"), "p_size").alias("alias"), F.col("p_brand").alias("canonical_id")))


@query(
    """WITH d AS (SELECT p_brand AS canonical_id, 'a' || p_size AS alias FROM part GROUP BY ALL), c AS (SELECT alias FROM d GROUP BY 1 HAVING count(*) > 1), x AS (SELECT 'a' || p_size AS alias, lower(p_name) AS context FROM part), w AS (SELECT DISTINCT p_brand AS canonical_id, lower(left(p_name, 3)) AS word FROM part),
    h AS (SELECT alias, canonical_id, count(*) AS n FROM d JOIN c USING (alias) JOIN w USING (canonical_id) JOIN x USING (alias) WHERE contains(context, word) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY n DESC, canonical_id) AS r, lead(n) OVER (PARTITION BY alias ORDER BY n DESC, canonical_id) AS nxt FROM h)
    SELECT alias, canonical_id FROM r WHERE r = 1 AND (nxt IS NULL OR n > nxt)"""
)
def resolve_divisions(t: Tables) -> DataFrame:
    p = t.raw("part")
    alias = F.concat(F.lit("a"), "p_size").alias("alias")
    return Re.divisions_settled(p.select(alias, F.col("p_brand").alias("canonical_id")).distinct(), p.select(alias, F.col("p_name").alias("context")), p.select(F.col("p_brand").alias("canonical_id"), F.lower(F.left("p_name", F.lit(3))).alias("word")).distinct())


@query("SELECT doc_id, 'License' AS shorthand, 1 AS candidate_id, CAST(len(regexp_extract_all(text, '(^|[^\\p{L}\\p{N}])License([^\\p{L}\\p{N}]|$)')) AS INTEGER) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND regexp_matches(text, '(^|[^\\p{L}\\p{N}])License([^\\p{L}\\p{N}]|$)')")
def resolve_shorthands(t: Tables) -> DataFrame:
    store = t.spark.createDataFrame([("License", 1, 5, False), ("Public", 2, 2, False), ("General", 3, 9, True), ("Version", 4, 9, False), ("version", 5, 9, False)], "shorthand string, candidate_id int, doc_count int, blocked boolean")
    cited = t.raw("labels").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("candidate_id"))
    return Re.apply_shorthands(store, cited, t.documents.select("doc_id", "text"))


@query("""SELECT 'ref-' || p_partkey AS citation, CAST(p_partkey AS VARCHAR) AS candidate, CASE WHEN p_size > 20 THEN CAST(p_partkey AS VARCHAR) END AS stable_id, p_size > 20 AS held, CASE WHEN p_size > 20 THEN left(repeat(p_name || ' ', 20), 50) END AS preview, CASE WHEN p_size > 20 THEN length(repeat(p_name || ' ', 20)) > 50 END AS truncated, CAST(NULL AS VARCHAR) AS link FROM part
    UNION ALL SELECT 'Name ' || p_partkey, 'Name ' || p_partkey, CASE WHEN p_size > 20 THEN CAST(p_partkey AS VARCHAR) END, p_size > 20, CASE WHEN p_size > 20 THEN left(repeat(p_name || ' ', 20), 50) END, CASE WHEN p_size > 20 THEN length(repeat(p_name || ' ', 20)) > 50 END, NULL FROM part WHERE p_partkey % 2 = 0
    UNION ALL SELECT 'ukpga/2000/7', 'ukpga/2000/7', NULL, false, NULL, NULL, 'https://www.legislation.gov.uk/ukpga/2000/7'""")
def service_lookup(t: Tables) -> DataFrame:
    p = t.raw("part")
    docs = p.filter("p_size > 20").select(F.col("p_partkey").cast("string").alias("stable_id"), F.repeat(F.concat("p_name", F.lit(" ")), 20).alias("text"))
    aliases = p.filter("p_partkey % 2 = 0").select(F.concat(F.lit("name "), "p_partkey").alias("alias"), F.col("p_partkey").cast("string").alias("canonical_id"))
    asked = p.select(F.concat(F.lit("ref-"), "p_partkey").alias("citation")).unionByName(p.filter("p_partkey % 2 = 0").select(F.concat(F.lit("Name "), "p_partkey").alias("citation"))).unionByName(t.spark.createDataFrame([("ukpga/2000/7",), ("  ",)], "citation string"))
    return Sv.lookup(asked, docs, aliases, 50)


@query("SELECT doc_id, '2' AS label, text AS passage FROM (SELECT conv_id AS doc_id, text, turn FROM conversations) WHERE turn = 2")
def service_passage(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    c = t.raw("conversations").select(F.col("conv_id").alias("doc_id"), "turn", "text")
    before = F.coalesce(F.sum(F.length("text") + 1).over(Window.partitionBy("doc_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    segments = c.select("doc_id", F.col("turn").cast("string").alias("label"), before.alias("char_start"), F.length("text").alias("n")).withColumn("char_end", F.col("char_start") + F.col("n")).drop("n")
    docs = c.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return Sv.passage(docs, segments, c.filter("turn = 2").select("doc_id", F.lit("2").alias("label")))


@query("SELECT src_id, type, count(*) AS n, string_agg(DISTINCT dst_anchor, ';' ORDER BY dst_anchor) AS pins, round(coalesce(max(weight), 0), 2) AS rank FROM rel LEFT JOIN docs_l ON src_id = stable_id WHERE status = 'resolved' AND via <> 'inferred' AND type <> 'cited_by' AND src_id <> dst_id AND dst_id = 42 GROUP BY ALL", "docs_l rel")
def service_mentions(t: Tables) -> DataFrame:
    rank = t.docs_l.select(F.col("stable_id").alias("node"), F.col("weight").alias("rank"))
    return Sv.mentions(t.rel, rank, 42).select("src_id", "type", "n", F.array_join("pins", ";").alias("pins"), F.round("rank", 2).alias("rank"))


@query("WITH m AS (SELECT DISTINCT src_id, type FROM rel WHERE status = 'resolved' AND via <> 'inferred' AND type <> 'cited_by' AND src_id <> dst_id AND dst_id = 42 AND lower(translate(dst_anchor, ' .', '')) = 's5'), f AS (SELECT src_id, unnest([{'k': 'type', 'v': type}, {'k': 'source', 'v': source}, {'k': 'court', 'v': court}]) AS side FROM m LEFT JOIN docs_l ON src_id = stable_id) SELECT side.k AS facet, side.v AS value, count(DISTINCT src_id) AS n FROM f WHERE side.v IS NOT NULL GROUP BY ALL", "docs_l rel")
def service_mention_facets(t: Tables) -> DataFrame:
    rank = t.docs_l.select(F.col("stable_id").alias("node"), F.col("weight").alias("rank"))
    return Sv.mention_facets(Sv.mentions(t.rel, rank, 42, "s. 5"), t.docs_l)


@query("SELECT CAST(coalesce(candidate_id, CAST(substr(raw, 5) AS BIGINT)) AS VARCHAR) AS ref, count(DISTINCT src_id) AS citing, count(*) AS occurrences, 'unknown' AS form, CAST(NULL AS VARCHAR) AS adapter, false AS needs_identifier FROM rel WHERE status = 'pending' AND via <> 'inferred' GROUP BY 1", "rel")
def service_unresolved(t: Tables) -> DataFrame:
    junk = t.rel.limit(5).withColumn("raw", F.lit("#")).withColumn("candidate_id", F.lit(None).cast("long")).withColumn("status", F.lit("pending"))
    return Sv.unresolved(t.rel.unionByName(junk))


@query("SELECT status, count(*) AS n, count(dst_id) AS targets FROM (SELECT CASE WHEN status = 'pending' AND candidate_id % 3 = 0 THEN 'resolved' ELSE status END AS status, CASE WHEN status = 'pending' AND candidate_id % 3 = 0 THEN candidate_id ELSE dst_id END AS dst_id FROM rel) GROUP BY 1", "rel")
def service_manual_resolution(t: Tables) -> DataFrame:
    choices = t.docs_r.filter("stable_id % 3 = 0").select(F.col("stable_id").cast("string").alias("ref"), "stable_id")
    return Sv.resolved_by_hand(t.rel, choices).groupBy("status").agg(F.count("*").alias("n"), F.count("dst_id").alias("targets"))


@query("SELECT doc_id, substr(text, 101 - 50, 50 + 7 + 60) AS snippet, CAST(50 AS INTEGER) AS mark_start, CAST(57 AS INTEGER) AS mark_end FROM documents WHERE length(text) >= 107")
def service_reference_context(t: Tables) -> DataFrame:
    cites = t.documents.filter(F.length("text") >= 107).select("doc_id", F.lit(100).alias("char_start"), F.lit(107).alias("char_end"))
    return Sv.reference_context(cites, t.documents, 50, 60).select("doc_id", "snippet", F.col("mark_start").cast("int").alias("mark_start"), F.col("mark_end").cast("int").alias("mark_end"))


@query("WITH d AS (SELECT stable_id, 'Other' AS jurisdiction, CASE doc_type WHEN 'PROMO' THEN 'other' ELSE 'other' END AS kind, size FROM docs_r) SELECT jurisdiction, kind, count(*) AS n, (SELECT string_agg(stable_id, ',' ORDER BY size DESC, stable_id) FROM (SELECT * FROM d ORDER BY size DESC, stable_id LIMIT 5)) AS top FROM d GROUP BY ALL", "docs_r")
def service_corpus_shape(t: Tables) -> DataFrame:
    rank = t.docs_r.select(F.col("stable_id").alias("node"), F.col("size").cast("double").alias("rank"))
    return Sv.shape(t.docs_r, rank).select("jurisdiction", "kind", "n", F.array_join(F.transform("top", lambda x: x.cast("string")), ",").alias("top"))


@query("WITH top AS (SELECT stable_id, size FROM docs_r WHERE doc_type = 'PROMO' ORDER BY size DESC, stable_id LIMIT 20), c AS (SELECT DISTINCT dst_id AS stable_id, src_id FROM rel WHERE status = 'resolved' AND via <> 'inferred' AND type <> 'cited_by'), k AS (SELECT c.stable_id, d.doc_type AS t, count(*) AS n FROM c JOIN docs_l d ON src_id = d.stable_id GROUP BY ALL) SELECT top.stable_id, string_agg(t || '=' || n, ';' ORDER BY t) AS hanging FROM top LEFT JOIN k USING (stable_id) GROUP BY 1", "docs_l docs_r rel")
def service_drill(t: Tables) -> DataFrame:
    rank = t.docs_r.select(F.col("stable_id").alias("node"), F.col("size").cast("double").alias("rank"))
    found = Sv.drill(t.docs_r, t.rel, t.docs_l, rank, F.col("doc_type") == "PROMO")
    return found.select("stable_id", F.array_join(F.transform(F.map_entries("hanging"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("hanging"))


@query("SELECT src_id, doc_type = '1-URGENT' AS preliminary, coalesce(decision_date < DATE '1996-06-01', false) AS stale, string_agg(DISTINCT dst_anchor, ';' ORDER BY dst_anchor) AS anchors FROM rel JOIN docs_l ON src_id = stable_id WHERE dst_id = 42 OR candidate_id = 42 GROUP BY ALL", "docs_l rel")
def service_pending_proceedings(t: Tables) -> DataFrame:
    notices = t.docs_l.withColumn("procedure", F.when(F.col("doc_type") == "1-URGENT", "PREJ").otherwise("ANNU"))
    return Sv.pending_proceedings(notices, t.rel, 42, "2001-06-01").select("src_id", "preliminary", "stale", F.array_join("anchors", ";").alias("anchors"))


@query("SELECT 'other' AS kind, count(*) AS n, (SELECT string_agg(y || '=' || c, ';' ORDER BY y) FROM (SELECT year(decision_date) AS y, count(*) AS c FROM docs_l WHERE decision_date IS NOT NULL GROUP BY 1)) AS years FROM docs_l", "docs_l")
def agg_legislation_types(t: Tables) -> DataFrame:
    return Sv.legislation_types(t.docs_l).select("kind", "n", F.array_join(F.transform(F.map_entries("years"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("years"))


@query()
def agg_recall_audit(t: Tables) -> DataFrame:
    spans = Tx.citations(t.documents).select("doc_id", "char_start", "char_end")
    return Sv.uncovered_cues(t.documents.select("doc_id", "source", "text"), spans, {"licence": r"\bLicense\b", "url": r"https?://"})
