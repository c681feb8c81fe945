"""References and what follows them, search over the index, records and editions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import citing as Ct
from ..operators import search as S
from ..operators import text as Tx
from ..sources import records as Rc
from ..views import Tables
from .registry import query


@query("SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'para ' || (o_custkey % 900 + 1) WHEN 1 THEN 'para ' || (o_custkey % 900 + 1) || ', 44 and 46' WHEN 2 THEN 'para ' || (o_custkey % 900 + 1) || '–' || 950 END AS pinpoint FROM orders")
def text_pinpoints(t: Tables) -> DataFrame:
    k, n = F.col("o_orderkey") % 5, F.col("o_custkey") % 900 + 1
    after = F.when(k == 0, F.concat(F.lit(" at ["), n, F.lit("] it"))).when(k == 1, F.concat(F.lit(", at paras "), n, F.lit(" , 44 and 46."))).when(k == 2, F.concat(F.lit(" ["), n, F.lit("] - [950]"))).when(k == 3, " at [1998] 2").otherwise(" and others")
    cites = t.raw("orders").select(F.col("o_orderkey").alias("id"), F.lit("case").alias("kind"), after.alias("after"))
    return Ct.with_pinpoints(cites).select("id", "pinpoint")


@query("SELECT p_partkey AS doc_id, 'Charter' AS host, CAST(unnest([p_size, p_size + 10, p_size + 20, p_size + 21, p_size + 22]) AS VARCHAR) AS provision FROM part")
def text_provision_lists(t: Tables) -> DataFrame:
    n = F.col("p_size")
    text = F.concat(F.lit("See Articles "), n, F.lit(", "), n + 10, F.lit(" and "), n + 20, F.lit(" to "), n + 22, F.lit(" of the Charter; it says so."))
    return Ct.provision_lists(t.raw("part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))).select("doc_id", "host", "provision")


SPANS = """SELECT l_orderkey AS doc_id, CAST(l_partkey * 37 % 9000 AS INTEGER) AS char_start, CASE l_linenumber % 3 WHEN 0 THEN 'act' WHEN 1 THEN 'celex' ELSE 'article' END AS kind,
    CASE WHEN l_linenumber % 3 = 2 THEN (CASE WHEN l_suppkey % 2 = 0 THEN 'section ' ELSE 'Article ' END) || l_partkey || '.' || l_linenumber || '.' || l_suppkey ELSE 'x' || l_partkey || '.' || l_linenumber || '.' || l_suppkey END AS raw, CASE WHEN l_linenumber % 3 <> 2 THEN 'c' || l_partkey END AS candidate FROM lineitem"""


@query(
    f"""WITH s AS (SELECT DISTINCT * FROM ({SPANS})), w AS (SELECT *, last_value(CASE WHEN kind = 'celex' THEN [CAST(char_start AS VARCHAR), candidate] END IGNORE NULLS) OVER p AS eu, last_value(CASE WHEN kind = 'act' THEN [CAST(char_start AS VARCHAR), candidate] END IGNORE NULLS) OVER p AS act FROM s
      WINDOW p AS (PARTITION BY doc_id ORDER BY char_start, raw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), h AS (SELECT *, CASE WHEN raw LIKE 'section%' THEN act ELSE eu END AS host FROM w WHERE kind = 'article')
    SELECT doc_id, raw, host[2] AS host, CASE WHEN char_start - CAST(host[1] AS INTEGER) <= 500 THEN 'high' WHEN char_start - CAST(host[1] AS INTEGER) <= 3000 THEN 'medium' ELSE 'low' END AS confidence FROM h WHERE host IS NOT NULL"""
)
def text_carry_forward(t: Tables) -> DataFrame:
    n, part = F.col("l_linenumber") % 3, F.col("l_partkey")
    rest = F.concat_ws(".", part, "l_linenumber", "l_suppkey")
    cites = t.raw("lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (part * 37 % 9000).cast("int").alias("char_start"), F.when(n == 0, "act").when(n == 1, "celex").otherwise("article").alias("kind"),
        F.when(n == 2, F.concat(F.when(F.col("l_suppkey") % 2 == 0, "section ").otherwise("Article "), rest)).otherwise(F.concat(F.lit("x"), rest)).alias("raw"), F.when(n != 2, F.concat(F.lit("c"), part)).alias("candidate"),
    )
    return Ct.carried_forward(cites.distinct()).select("doc_id", "raw", "host", "confidence")


@query("SELECT p_partkey AS doc_id, 'Act' AS shorthand, 'c' || p_partkey AS candidate, CAST(1 + p_size % 3 AS INTEGER) AS n FROM part")
def text_defined_names(t: Tables) -> DataFrame:
    text = F.concat(F.lit('The Widgets Act 2001 ("the Act") binds. Actors act.'), F.repeat(F.lit(" The Act says so."), (1 + F.col("p_size") % 3).cast("int")))
    docs = t.raw("part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
    cites = docs.select("doc_id", F.lit(20).alias("char_end"), F.concat(F.lit("c"), "doc_id").alias("candidate"), F.substr("text", F.lit(21), F.lit(120)).alias("after"))
    return Ct.used_names(docs, Ct.defined_names(cites))


@query("SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem WHERE l_partkey % 5 <> 0 AND l_linenumber <> 7 GROUP BY 1")
def filter_suppressed(t: Tables) -> DataFrame:
    line = t.raw("lineitem")
    cites = line.select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("candidate"), F.concat(F.lit("r"), "l_linenumber").alias("raw"))
    vetoed = line.filter("l_partkey % 5 = 0").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("candidate"), F.lit(None).cast("string").alias("raw")).unionByName(line.filter("l_linenumber = 7").select(F.col("l_orderkey").alias("doc_id"), F.lit(None).cast("long").alias("candidate"), F.lit("r7").alias("raw")))
    return Ct.not_suppressed(cites, vetoed).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN l_partkey % 3 = 0 AND o_orderpriority <> '3-MEDIUM' THEN 'ie/act/' WHEN l_partkey % 3 = 0 THEN 'ukpga/' ELSE 'free/' END || l_partkey AS candidate, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT (l_partkey % 3 = 1 AND o_orderpriority <> '2-HIGH') OR l_partkey % 3 <> 1 GROUP BY ALL")
def filter_jurisdiction_guards(t: Tables) -> DataFrame:
    p, m = F.col("o_orderpriority"), F.col("l_partkey") % 3
    docs = t.raw("orders").select(F.col("o_orderkey").alias("doc_id"), F.when(p == "3-MEDIUM", "uk-x").when(p == "2-HIGH", "fr-x").otherwise("zz").alias("source"))
    cites = t.raw("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.when(m == 0, "ukpga/").when(m == 1, "loi/").otherwise("free/"), "l_partkey").alias("candidate"))
    rules = t.spark.createDataFrame([("ukpga/", "United Kingdom", "ie/act/"), ("loi/", "France", None)], "prefix string, jurisdiction string, rebind string")
    return Ct.guarded(cites, docs, rules).withColumn("candidate", F.regexp_replace("candidate", "^loi/", "free/")).groupBy("candidate").agg(F.count("*").alias("n"))


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\bthe\\b')) FROM documents) GROUP BY 1")
def text_extra_pass(t: Tables) -> DataFrame:
    import re

    word = re.compile(r"(?a:\b)the(?a:\b)")
    none = t.spark.createDataFrame([], "doc_id long, char_start int, char_end int")
    # windows overlap by more than a word, so a word at an edge is whole in one of them; cut words at the edges are left to the other
    found = Ct.extra_pass(t.documents, none, lambda w: [(m.start(), m.end(), m[0]) for m in word.finditer(w) if 0 < m.start() and m.end() < len(w)], 4000, 400)
    edges = t.documents.select("doc_id", F.when(F.col("text").rlike(r"^the(?![A-Za-z0-9_])"), 1).otherwise(0).alias("a"), F.when((F.length("text") > 3) & F.col("text").rlike(r"(?<![A-Za-z0-9_])the$"), 1).otherwise(0).alias("z")).select("doc_id", (F.col("a") + F.col("z")).alias("e")).filter("e > 0")
    rows = found.groupBy("doc_id").agg(F.count("*").alias("n")).join(edges, "doc_id", "full")
    return rows.select("doc_id", (F.coalesce("n", F.lit(0)) + F.coalesce("e", F.lit(0))).cast("long").alias("n"))


@query()
def text_language_grammars(t: Tables) -> DataFrame:
    return Ct.citations_by_language(t.documents.select("doc_id", "text", "lang"), lang="lang")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}])license([^\\p{L}\\p{N}]|$)') AND regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}])(the[\\s\\p{P}\\p{S}]{1,4}license|version)([^\\p{L}\\p{N}]|$)') AND NOT regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}])idio') ORDER BY doc_id LIMIT 25")
def text_index_search(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text")
    return S.full_text(S.postings(docs), docs, 'license ("the license" OR version) NOT idio*').page.select("doc_id")


@query("SELECT count(*) AS total FROM documents WHERE regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}])(license|token)([^\\p{L}\\p{N}]|$)')")
def text_index_total(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text")
    return S.full_text(S.postings(docs), docs, "license OR token").matched.agg(F.count("*").alias("total"))


@query("WITH p AS (SELECT doc_id, string_split(lower(text), 'general public') AS l FROM documents WHERE contains(lower(text), 'general public')), u AS (SELECT doc_id, unnest(l) AS piece, unnest(generate_series(1, len(l))) AS no, len(l) AS n FROM p), s AS (SELECT *, sum(length(piece) + 14) OVER (PARTITION BY doc_id ORDER BY no) - 14 AS at_ FROM u) SELECT doc_id, CAST(at_ AS INTEGER) AS char_start FROM s WHERE no < n")
def text_within_document(t: Tables) -> DataFrame:
    return S.within(t.documents, "general public").select("doc_id", "char_start")


@query("SELECT doc_id, CAST(a AS INTEGER) AS lexical_rank, CAST(b AS INTEGER) AS semantic_rank, doc_id % 7 / 7.0 AS percentile FROM (SELECT doc_id FROM documents) LEFT JOIN (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS a FROM documents ORDER BY a LIMIT 30) USING (doc_id) LEFT JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS b FROM documents ORDER BY b LIMIT 30) USING (doc_id)")
def rrf_signals(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "n_chars")
    top = lambda o: S.ranked(d.orderBy(*o).limit(30), o)
    authority = d.select(F.col("doc_id").alias("node"), (F.col("doc_id") % 7 / 7.0).alias("percentile"))
    return S.with_signals(d.select("doc_id"), {"lexical": top([F.desc("n_chars"), F.asc("doc_id")]), "semantic": top([F.asc("doc_id")])}, authority)


@query("SELECT doc_id FROM documents WHERE n_chars > 100 ORDER BY n_chars % 97 DESC, doc_id LIMIT 10")
def rrf_rerank(t: Tables) -> DataFrame:
    return S.reranked(t.documents.filter("n_chars > 100").select("doc_id", "n_chars"), F.col("n_chars") % 97, [F.asc("doc_id")]).limit(10).select("doc_id")


@query("SELECT count(*) AS with_index, 0 AS without FROM (SELECT 1 UNION ALL SELECT 2)")
def vec_index_gate(t: Tables) -> DataFrame:
    v = t.vectors.select(F.lit("small").alias("family"), F.col("embedding").alias("vector"))
    lists = [len(S.hybrid_lists(t.documents, t.documents, v, family, 64)) for family in ("small", "other")]
    return t.spark.createDataFrame([(lists[0], lists[1] - 1)], "with_index long, without int")


@query("SELECT 'case/' || o_custkey AS stable_id, arg_min(o_orderpriority || ' ' || o_orderkey, o_orderpriority || ' ' || o_orderkey) AS text, 'dump' AS source FROM orders WHERE o_orderstatus <> 'P' AND year(o_orderdate) >= 1997 GROUP BY o_custkey")
def source_row_parser(t: Tables) -> DataFrame:
    rows = Rc.parsed_rows(t.raw("orders"), {"stable_id": "concat('case/', o_custkey)", "text": "CASE WHEN o_orderstatus <> 'P' THEN concat(o_orderpriority, ' ', o_orderkey) ELSE ' ' END", "year": "year(o_orderdate)"}, "dump", F.col("year") >= 1997)
    return rows.select("stable_id", "text", "source")


@query("WITH p AS (SELECT DISTINCT dst_id, dst_anchor AS provision, src_id FROM rel WHERE status = 'resolved' AND via <> 'inferred' AND type <> 'cited_by') SELECT dst_id, provision, count(*) AS n, string_agg(src_id, ',' ORDER BY weight DESC, src_id) AS citers FROM p JOIN docs_l ON src_id = stable_id GROUP BY ALL", "docs_l rel")
def sink_edition(t: Tables) -> DataFrame:
    rank = t.docs_l.select(F.col("stable_id").alias("node"), F.col("weight").alias("rank"))
    return Rc.edition(t.rel, t.docs_l, rank).select("dst_id", "provision", "n", F.array_join(F.transform("citers", lambda x: x.cast("string")), ",").alias("citers"))


@query("SELECT (SELECT count(DISTINCT p_name) FROM part) + 1 AS docs, (SELECT count(DISTINCT p_name) FROM part) AS edges")
def source_imports(t: Tables) -> DataFrame:
    docs = t.spark.createDataFrame([("act/1", "An act", "Its text")], "stable_id string, title string, text string")
    rel = t.spark.createDataFrame([], "src_id string, dst_id string, type string, via string")
    notes = t.raw("part").select(F.col("p_brand").alias("title"), F.col("p_name").alias("text"), F.lit("act/1").alias("about"))
    d, r = Rc.imported(docs, rel, notes)
    return d.agg(F.count("*").alias("docs")).join(F.broadcast(r.agg(F.count("*").alias("edges"))))  # one row each
