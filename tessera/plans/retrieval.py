"""Full text, vectors, fusion, text functions, tags, probes, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import legal as L
from ..functions import text as X
from ..operators import quality as Q
from ..operators import search as S
from ..operators import tagging as T
from ..operators import text as Tx
from ..session import shared_folder
from ..sources import readers, sinks
from ..streaming import streams
from ..views import Tables
from .registry import query

WORDS = r"[0-9]+(?:[/.][0-9]+)+|[\p{L}\p{N}]+(?:[''’][\p{L}]+)*"


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}])license([^\\p{L}\\p{N}]|$)') AND NOT regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}])gnu([^\\p{L}\\p{N}]|$)')")
def text_boolean(t: Tables) -> DataFrame:
    return S.search(t.documents, "license AND NOT gnu").select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}])general[\\s\\p{P}\\p{S}]{1,4}public([^\\p{L}\\p{N}]|$)')")
def text_phrase(t: Tables) -> DataFrame:
    return S.search(t.documents, '"general public"').select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}])idio')")
def text_prefix(t: Tables) -> DataFrame:
    return S.search(t.documents, "idio*").select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}])license([\\s\\p{P}\\p{S}]+[\\p{L}\\p{N}''’]+){0,5}[\\s\\p{P}\\p{S}]+version([^\\p{L}\\p{N}]|$)') OR regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}])version([\\s\\p{P}\\p{S}]+[\\p{L}\\p{N}''’]+){0,5}[\\s\\p{P}\\p{S}]+license([^\\p{L}\\p{N}]|$)')")
def text_near(t: Tables) -> DataFrame:
    return S.search(t.documents, "license NEAR/6 version").select("doc_id")


@query(
    f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORDS}') AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
    f AS (SELECT doc_id, len(t) AS length, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM d) WHERE term IN ('license', 'token') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM f GROUP BY 1)
    SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM f JOIN df USING (term), s GROUP BY 1"""
)
def text_bm25(t: Tables) -> DataFrame:
    return S.bm25(t.documents, "license token").select("doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT term, doc_id, CAST(count(*) AS INTEGER) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS term FROM documents) GROUP BY ALL")
def text_postings(t: Tables) -> DataFrame:
    return S.postings(t.documents).select("term", "doc_id", F.size("positions").alias("n"))


@query(
    f"""WITH m AS (SELECT doc_id, regexp_replace(text, '([.!?])(\\s+)([A-Z(\\[])', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g') AS t FROM documents),
    k AS (SELECT doc_id, regexp_replace(t, '(^|[^\\p{{L}}\\p{{N}}_])((?i:{'|'.join(Tx.ABBREVIATIONS)})|[0-9]+)\\.' || chr(1) || '(\\s+)' || chr(2), '\\1\\2.\\3', 'g') AS t FROM m),
    s AS (SELECT doc_id, [regexp_replace(x, '^\\s+|\\s+$', '', 'g') FOR x IN string_split_regex(t, chr(1) || '\\s+' || chr(2)) IF regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> ''] AS l FROM k)
    SELECT doc_id, unnest(l) AS sentence, CAST(unnest(generate_series(0, len(l) - 1)) AS INTEGER) AS sentence_no FROM s"""
)
def text_sentence_split(t: Tables) -> DataFrame:
    return Tx.sentence_rows(t.documents)


@query()
def text_chunk(t: Tables) -> DataFrame:
    return Tx.chunk_documents(t.documents)


@query("SELECT doc_id, -1 AS chunk_id, CASE WHEN length(text) > 2600 THEN trim(left(text, 1400)) || chr(10) || '…' || chr(10) || trim(right(text, 900)) ELSE trim(left(text, 1400)) END AS text, CAST(least(length(text), 1400) AS INTEGER) AS char_end FROM documents WHERE trim(text) <> ''")
def text_document_proxy(t: Tables) -> DataFrame:
    return Tx.document_proxy(t.documents)


@query(
    """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS no FROM documents),
    p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l),
    c AS (SELECT doc_id, pos, CAST(regexp_extract(regexp_extract(line, '^\\s*(?:\\[(\\d{1,4})\\]|(\\d{1,4})\\.)\\s'), '\\d+') AS INTEGER) AS n FROM p WHERE regexp_matches(line, '^\\s*(?:\\[(\\d{1,4})\\]|(\\d{1,4})\\.)\\s')),
    r AS (SELECT doc_id, 1 AS n, min(pos) AS pos FROM c WHERE n = 1 GROUP BY 1 UNION ALL SELECT r.doc_id, r.n + 1, min(c.pos) FROM r JOIN c ON c.doc_id = r.doc_id AND c.n = r.n + 1 AND c.pos > r.pos GROUP BY r.doc_id, r.n)
    SELECT doc_id, CAST(n AS VARCHAR) AS label, CAST(pos AS INTEGER) AS char_start, CAST(coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY n), (SELECT length(text) FROM documents d WHERE d.doc_id = r.doc_id)) AS INTEGER) AS char_end FROM r
    UNION ALL SELECT doc_id, 'line', CAST(pos AS INTEGER), CAST(pos + length(line) AS INTEGER) FROM p WHERE doc_id NOT IN (SELECT doc_id FROM r) AND regexp_matches(line, '\\S')"""
)
def text_segments(t: Tables) -> DataFrame:
    return Tx.paragraphs(t.documents)


@query(
    """WITH RECURSIVE p AS (SELECT doc_id, -1 AS part, '' AS piece, text AS rest FROM documents WHERE length(text) > 0
      UNION ALL SELECT doc_id, part + 1, left(rest, k), substr(rest, k + 1) FROM (SELECT *, CASE WHEN length(rest) <= 4000 THEN length(rest) WHEN strpos(reverse(left(rest, 4000)), chr(10) || chr(10)) > 0 AND 4000 - strpos(reverse(left(rest, 4000)), chr(10) || chr(10)) - 1 >= 2000
        THEN 4000 - strpos(reverse(left(rest, 4000)), chr(10) || chr(10)) - 1 ELSE 4000 END AS k FROM p) WHERE rest <> '')
    SELECT doc_id, part, piece AS text FROM p WHERE part >= 0"""
)
def text_full_text_parts(t: Tables) -> DataFrame:
    return Tx.full_text_parts(t.documents, most=4000)


@query()
def text_grammar_scan(t: Tables) -> DataFrame:
    return Tx.citations(t.documents)


@query()
def text_collapse_edges(t: Tables) -> DataFrame:
    return Tx.collapse_to_edges(Tx.citations(t.documents))


@query()
def text_treatment(t: Tables) -> DataFrame:
    return Tx.with_treatment(Tx.citations(t.documents)).select("doc_id", "char_start", "kind", "treatment")


@query("SELECT doc_id, trim(regexp_replace(substr(text, greatest(1, strpos(lower(text), 'license') - 160), 320), '^\\S*\\s|\\s\\S*$', '', 'g')) AS snippet FROM documents WHERE regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}])license([^\\p{L}\\p{N}]|$)')")
def text_snippet(t: Tables) -> DataFrame:
    return S.search(t.documents, "license").select("doc_id", S.snippet(F.col("text"), "license").alias("snippet"))


@query()
def text_hashed_embedding(t: Tables) -> DataFrame:
    return Tx.hashed_embedding(t.documents.select("doc_id", "text"), 64).select("doc_id", "vector")


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, CAST(len(list_distinct(regexp_extract_all(html, '(?i)<a\\b[^>]*?href=\"([^\"#]+)\"', 1))) AS INTEGER) AS links FROM pages")
def source_html_pages(t: Tables) -> DataFrame:
    return readers.pages(t.raw("pages")).select("page_id", "title", F.size("links").alias("links"))


@query("SELECT v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, v.vec_id LIMIT 10")
def vec_cosine_topk(t: Tables) -> DataFrame:
    q = t.vectors.filter("vec_id = 0").first()["embedding"]
    return S.vector_top_k(t.vectors, q, 10).select("vec_id", F.round("score", 6).alias("score"))


RANKED_VECTORS = """p AS (SELECT q.vec_id AS query_id, q.label AS q_label, v.vec_id, v.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS rank
    FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)"""


@query(f"WITH {RANKED_VECTORS} SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM p WHERE rank <= 5")
def vec_nearest_of_queries(t: Tables) -> DataFrame:
    return S.nearest_of_queries(t.vectors, t.vectors.filter("vec_id % 100 = 0"), 5).select("query_id", "vec_id", "rank")


@query(f"WITH {RANKED_VECTORS}, f AS (SELECT query_id, min(rank) FILTER (label = q_label) AS first FROM p WHERE rank <= 10 GROUP BY 1) SELECT count(*) AS queries, round(avg(CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END), 4) AS recall, round(avg(coalesce(1.0 / first, 0)), 4) AS mrr FROM f")
def vec_recall_mrr(t: Tables) -> DataFrame:
    labels = t.vectors.select("vec_id", "label")
    queries = t.vectors.filter("vec_id % 100 = 0")
    found = S.nearest_of_queries(t.vectors, queries, 10).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label")), "query_id")
    return S.recall_and_mrr(found, queries.select(F.col("vec_id").alias("query_id")), F.col("label") == F.col("q_label"))


@query(
    """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS rank FROM documents)
    SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1"""
)
def rrf_fuse(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "n_chars", "source")
    return S.reciprocal_rank_fusion([S.rank_all(d, [F.desc("n_chars"), F.asc("doc_id")]), S.rank_all(d, [F.asc("source"), F.asc("doc_id")])], "doc_id")


@query("WITH h AS (SELECT o_custkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_orderkey END AS chunk_id FROM orders) SELECT doc_id, chunk_id FROM h WHERE chunk_id <> -1 OR doc_id NOT IN (SELECT doc_id FROM h WHERE chunk_id <> -1)")
def rrf_containment(t: Tables) -> DataFrame:
    hits = t.raw("orders").select(F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("o_orderkey")).alias("chunk_id"))
    return S.containment(hits)


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY pagerank DESC, doc_id) AS INTEGER) AS rank FROM (SELECT DISTINCT c_custkey AS doc_id, n / 1000.0 AS pagerank FROM customer JOIN (SELECT src, count(*) AS n FROM cyclic GROUP BY 1) ON c_custkey = src)", "cyclic")
def rrf_authority_prior(t: Tables) -> DataFrame:
    authority = t.cyclic.groupBy(F.col("src").alias("node")).agg((F.count("*") / 1000.0).alias("rank"))
    return S.authority_prior(t.raw("customer").select(F.col("c_custkey").alias("doc_id")), authority).select("doc_id", "rank")


@query("SELECT doc_id FROM documents WHERE lower(text) LIKE '%license%' AND (lang = 'en' OR source IS DISTINCT FROM 'src1') AND NOT (lower(text) LIKE '%gnu%' AND n_chars >= 100)")
def tag_rule_tree(t: Tables) -> DataFrame:
    tree = {"op": "and", "children": [
        {"predicate": "literal", "args": {"value": "License"}},
        {"op": "or", "children": [{"predicate": "field", "args": {"field": "lang", "op": "eq", "value": "en"}}, {"predicate": "field", "args": {"field": "source", "op": "ne", "value": "src1"}}]},
        {"op": "not", "children": [{"predicate": "literal", "args": {"value": "gnu"}}, {"predicate": "field", "args": {"field": "n_chars", "op": "gte", "value": 100}}]},
    ]}
    return t.documents.filter(T.compile_tree(tree)).select("doc_id")


@query(f"SELECT DISTINCT doc_id FROM (SELECT doc_id, a.i AS i, b.i AS j FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORDS}') AS w FROM documents) d, unnest(generate_series(1, len(w))) a(i), unnest(generate_series(greatest(1, a.i - 3), least(len(w), a.i + 3))) b(i) WHERE w[a.i] = 'general' AND w[b.i] = 'license')")
def tag_proximity(t: Tables) -> DataFrame:
    return t.documents.filter(T.compile_tree({"predicate": "near", "args": {"first": "general", "second": "license", "within": 3}})).select("doc_id")


@query("SELECT doc_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM tags GROUP BY 1", "tags")
def tag_cache(t: Tables) -> DataFrame:
    return T.tag_cache(t.tags).select("doc_id", F.array_join("tags", ",").alias("tags"))


CITES = """SELECT l_orderkey AS src_id, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS citation_id, CAST(l_partkey % 400 AS INTEGER) AS char_start, CAST(l_partkey % 400 + l_quantity AS INTEGER) AS char_end,
    CASE l_linenumber % 3 WHEN 0 THEN 'case' WHEN 1 THEN 'directive' ELSE 'act' END AS kind, CASE l_returnflag WHEN 'A' THEN 'carry_forward' ELSE 'regex' END AS method, CASE WHEN l_suppkey % 2 = 0 THEN 'Paragraph ' ELSE 'Article ' END || l_linenumber AS raw,
    CASE WHEN l_suppkey % 3 = 0 THEN 'para ' ELSE 'art ' END || l_linenumber AS pinpoint, CASE l_partkey % 5 WHEN 0 THEN 'us/p/' WHEN 1 THEN 'us/a/' ELSE 'eu/' END || l_partkey AS candidate_id FROM lineitem"""
KINDS = "SELECT o_orderkey AS stable_id, CASE WHEN o_orderstatus = 'F' THEN 'judgment' ELSE 'legislation' END AS doc_type, CASE o_orderpriority WHEN '1-URGENT' THEN 'us-x' WHEN '2-HIGH' THEN 'ie-x' ELSE 'uk-x' END AS source FROM orders"


def _cites(t: Tables) -> DataFrame:
    """Citations with spans, of the line items."""
    part, line, supp = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey")
    said = lambda c, a, b: F.concat(F.when(c, F.lit(a)).otherwise(F.lit(b)), line)
    return t.raw("lineitem").select(
        F.col("l_orderkey").alias("src_id"), F.xxhash64("*").alias("citation_id"), (part % 400).cast("int").alias("char_start"), (part % 400 + F.col("l_quantity")).cast("int").alias("char_end"),
        F.when(line % 3 == 0, "case").when(line % 3 == 1, "directive").otherwise("act").alias("kind"), F.when(F.col("l_returnflag") == "A", "carry_forward").otherwise("regex").alias("method"), said(supp % 2 == 0, "Paragraph ", "Article ").alias("raw"),
        said(supp % 3 == 0, "para ", "art ").alias("pinpoint"), F.concat(F.when(part % 5 == 0, "us/p/").when(part % 5 == 1, "us/a/").otherwise("eu/"), part).alias("candidate_id"),
    )


def _kinds(t: Tables) -> DataFrame:
    source = F.when(F.col("o_orderpriority") == "1-URGENT", "us-x").when(F.col("o_orderpriority") == "2-HIGH", "ie-x").otherwise("uk-x")
    return t.raw("orders").select(F.col("o_orderkey").alias("stable_id"), F.when(F.col("o_orderstatus") == "F", "judgment").otherwise("legislation").alias("doc_type"), source.alias("source"))


PROBES = {
    "case_paragraph_carry_forward": "SELECT 1 FROM cites b JOIN cites a ON a.src_id = b.src_id AND a.kind = 'case' AND b.char_start - a.char_end BETWEEN 0 AND 10 WHERE b.method = 'carry_forward' AND lower(b.raw) LIKE 'para%'",
    "judgment_paragraph_carry_forward": "SELECT 1 FROM cites JOIN kinds ON src_id = stable_id WHERE method = 'carry_forward' AND lower(raw) LIKE 'para%' AND doc_type = 'judgment'",
    "para_pinpoint_on_eu_instrument": "SELECT 1 FROM cites WHERE kind = 'directive' AND pinpoint LIKE 'para %' AND method = 'carry_forward'",
    "self_citation": "SELECT 1 FROM rel WHERE src_id = dst_id",
    "year_shaped_pinpoint": "SELECT 1 FROM rel WHERE regexp_matches('para ' || (supp + 1950), '^para (19|20)\\d\\d$')",
    "kind_mismatch": "SELECT 1 FROM rel JOIN docs_r ON dst_id = stable_id WHERE doc_type IN ('ECONOMY', 'PROMO') AND dst_anchor = 's. 7'",
    "resolved_target_missing": "SELECT 1 FROM rel WHERE status = 'resolved' AND dst_id NOT IN (SELECT stable_id FROM docs_r WHERE size < 45)",
    "pending_but_held": "SELECT 1 FROM rel WHERE status = 'pending' AND candidate_id IN (SELECT stable_id FROM docs_r WHERE size < 10)",
    "alias_dangling": "SELECT 1 FROM docs_r WHERE stable_id + size * 37 NOT IN (SELECT stable_id FROM docs_r WHERE size > 10) AND stable_id + size * 37 NOT IN (SELECT stable_id FROM docs_r)",
    "anachronistic": "SELECT 1 FROM rel JOIN docs_l ON src_id = stable_id WHERE date_diff('day', decision_date, event_date) > 0",
    "future_dated": "SELECT 1 FROM docs_l WHERE decision_date > DATE '2001-01-01'",
    "forward_citation": "SELECT 1 FROM rel JOIN docs_l ON src_id = stable_id WHERE date_diff('day', decision_date, event_date) > 365",
    "misdated": "SELECT 1 FROM docs_l WHERE abs(1995 + stable_id % 7 - year(decision_date)) > 2",
    "never_extracted": "SELECT 1 FROM docs_l WHERE stable_id NOT IN (SELECT src_id FROM rel)",
    "duplicate_spans": "SELECT 1 FROM rel GROUP BY src_id, dst_anchor HAVING count(*) > 1",
    "ambiguous_us_reporter": "SELECT 1 FROM cites WHERE candidate_id LIKE 'us/p/%' OR (candidate_id LIKE 'us/a/%' AND src_id IN (SELECT stable_id FROM kinds WHERE source NOT LIKE 'us-%'))",
    "irish_case_cites_uk_legislation": "SELECT 1 FROM rel JOIN kinds ON src_id = stable_id WHERE source LIKE 'ie-%' AND via IN ('regex', 'inferred') AND (CAST(dst_id AS VARCHAR) LIKE '1%' OR CAST(dst_id AS VARCHAR) LIKE '2%')",
}


@query(f"WITH cites AS ({CITES}), kinds AS ({KINDS}) " + " UNION ALL ".join(f"SELECT '{k}' AS probe, count(*) AS n FROM ({q})" for k, q in PROBES.items()), "docs_l docs_r rel")
def probe_summary(t: Tables) -> DataFrame:
    rel, left, right, cites, kinds = t.rel, t.docs_l, t.docs_r, _cites(t), _kinds(t)
    aliases = right.select(F.col("stable_id").alias("alias"), (F.col("stable_id") + F.col("size") * 37).alias("canonical_id"))
    single = Q.counted_once(rel, {"self_citation": F.col("src_id") == F.col("dst_id"), "year_shaped_pinpoint": F.concat(F.lit("para "), F.col("supp") + 1950).rlike(r"^para (19|20)\d\d$")})
    dated = Q.counted_once(left.withColumn("slug", 1995 + F.col("stable_id") % 7), {"future_dated": F.col("decision_date") > F.to_date(F.lit("2001-01-01")), "misdated": F.abs(F.col("slug") - F.year("decision_date")) > 2})
    late = Q.counted_once(Q.with_lateness(rel, left), {"forward_citation": F.col("days_late") > 365, "anachronistic": F.col("days_late") > 0})
    pins = Q.counted_once(cites, {"para_pinpoint_on_eu_instrument": F.col("kind").isin("directive", "eu_instrument") & F.col("pinpoint").startswith("para ") & (F.col("method") == "carry_forward")})
    joined = Q.summary({
        "case_paragraph_carry_forward": Q.paragraph_after_case(cites), "judgment_paragraph_carry_forward": Q.paragraph_in_judgment(cites, kinds), "kind_mismatch": Q.kind_mismatch(rel, right, ("ECONOMY", "PROMO"), r"^s\. 7$"),
        "resolved_target_missing": Q.resolved_target_missing(rel, right.filter("size < 45")), "pending_but_held": Q.pending_but_held(rel, right.filter("size < 10")), "alias_dangling": Q.alias_dangling(aliases, right.filter("size > 10")),
        "never_extracted": Q.never_extracted(left, rel), "duplicate_spans": Q.duplicate_spans(rel, "src_id", "dst_anchor"), "ambiguous_us_reporter": Q.ambiguous_reporter(cites, kinds), "irish_case_cites_uk_legislation": Q.foreign_statute(rel, kinds, ("ie-",), ("1", "2")),
    })
    return joined.unionByName(single).unionByName(dated).unionByName(late).unionByName(pins)


@query("SELECT unnest(['self_citation', 'resolved_target_missing', 'pending_but_held', 'duplicate_spans', 'year_shaped_pinpoint', 'alias_dangling']) AS probe, CAST(0 AS BIGINT) AS n")
def repair_probes_are_zero(t: Tables) -> DataFrame:
    rel, right = t.rel, t.docs_r
    few, some = right.filter("size < 45"), right.filter("size < 10")
    years = rel.withColumn("dst_anchor", F.concat(F.lit("para "), F.col("supp") + 1950))
    aliases = right.select(F.col("stable_id").alias("alias"), (F.col("stable_id") + F.col("size") * 37).alias("canonical_id"))
    held = right.filter("size > 10")
    return Q.summary({
        "self_citation": Q.self_citation(Q.repair_self_citation(rel)), "resolved_target_missing": Q.resolved_target_missing(Q.repair_missing_target(rel, few), few), "pending_but_held": Q.pending_but_held(Q.repair_pending_but_held(rel, some), some),
        "duplicate_spans": Q.duplicate_spans(Q.repair_duplicate_spans(rel, "raw", "src_id", "dst_anchor"), "src_id", "dst_anchor"), "year_shaped_pinpoint": Q.year_shaped_pinpoint(Q.repair_year_pinpoint(years)), "alias_dangling": Q.alias_dangling(Q.repair_dangling_alias(aliases, held), held),
    })


@query("SELECT sha256('error|' || regexp_replace(props, '[0-9]+', '#', 'g')) AS fingerprint, count(*) AS seen_count FROM events WHERE event_type = 'error' GROUP BY 1")
def quality_issue_fingerprints(t: Tables) -> DataFrame:
    rows = t.events.filter("event_type = 'error'").select(F.col("event_type").alias("kind"), F.col("props").alias("message"), F.col("ts").alias("at"))
    return Q.issues(rows).select("fingerprint", "seen_count")


@query()
def shard_bin_packing(t: Tables) -> DataFrame:
    return sinks.shards(Tx.chunk_documents(t.documents).drop("text"), 500, buckets=4)


@query("SELECT vec_id AS doc_id, list_inner_product(embedding, embedding) > 0 AS unit FROM embeddings")
def vector_import(t: Tables) -> DataFrame:
    v = t.vectors.select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_id"), F.col("embedding").alias("vector"))
    done = sinks.import_vectors(v, v, 64)
    return done.select("doc_id", (F.abs(F.aggregate(F.transform("vector", lambda x: x * x), F.lit(0.0), lambda a, b: a + b) - 1) < 1e-6).alias("unit"))


@query("SELECT doc_id, lower(regexp_replace(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g')), '^-|-$', '', 'g')) AS slug FROM documents")
def scalar_slug(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.slug(F.col("text")).alias("slug"))


@query("SELECT DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN 'ukpga/1998/' || l_linenumber ELSE 'ukpga/Geo6/12/' || l_linenumber END AS act FROM lineitem")
def scalar_act_level(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    ident = F.when(n % 2 == 0, F.concat(F.lit("ukpga/1998/"), n, F.lit("/section/3"))).otherwise(F.concat(F.lit("ukpga/Geo6/12/"), n, F.lit("/part/1")))
    return t.raw("lineitem").select(L.act_level(ident).alias("act")).distinct()


def _stream(t: Tables) -> DataFrame:
    path = f"{t.sf_dir}/events.parquet"
    folder, _, name = path.rpartition("/")
    raw = t.raw("events")
    return t.spark.readStream.schema(raw.schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def _final(t: Tables, stream: DataFrame, name: str) -> DataFrame:
    return streams.run_to_table(stream, f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling_runs(t: Tables) -> DataFrame:
    return _final(t, streams.daily(_stream(t), "event_type"), "daily").select(F.to_date("day").cast("string").alias("day"), "event_type", "n")


@query("SELECT user_id, epoch_us(s) // 1000000 AS start, count(*) AS n FROM (SELECT user_id, unnest([time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL (15 * k) MINUTE FOR k IN [0, 1, 2, 3]]) AS s FROM events) GROUP BY ALL")
def stream_sliding_budget(t: Tables) -> DataFrame:
    return _final(t, streams.sliding_counts(_stream(t), "user_id"), "sliding").select("user_id", F.unix_seconds("start").alias("start"), "n")


@query(
    """WITH RECURSIVE e AS (SELECT user_id, ts, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
    r AS (SELECT user_id, k, ts, s, true AS allowed, 0.0::DOUBLE AS retry_after, [s] AS used FROM e WHERE k = 1
      UNION ALL SELECT e.user_id, e.k, e.ts, e.s, len(u.l) < 3, CASE WHEN len(u.l) < 3 THEN 0.0 ELSE u.l[len(u.l) - 2] + 86400 - e.s END, CASE WHEN len(u.l) < 3 THEN list_append(u.l, e.s) ELSE u.l END
      FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1, LATERAL (SELECT [x FOR x IN r.used IF x > e.s - 86400] AS l) u)
    SELECT CAST(user_id AS BIGINT) AS key, CAST(epoch_us(ts) AS BIGINT) AS us, allowed, round(retry_after, 3) AS retry_after FROM r"""
)
def stream_rolling_budget(t: Tables) -> DataFrame:
    out = f"{shared_folder(t.spark)}/budget-{uuid.uuid4().hex}"
    streams.run_once(streams.budget(_stream(t).withColumn("user_id", F.col("user_id").cast("long")), "user_id", 3, 86_400), f"{out}/rows", f"{out}/state")
    return t.spark.read.parquet(f"{out}/rows").select("key", F.unix_micros("ts").alias("us"), "allowed", F.round("retry_after", 3).alias("retry_after"))
