"""Full-text and vector search, fusion."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.legal import cosine
from ..functions.text import tokens
from .ranking import rank_all


@dataclass(frozen=True)
class Node:
    """A node of a text query: op is term, prefix, phrase, near, and, or, not."""

    op: str
    words: tuple[str, ...] = ()
    parts: tuple[Node, ...] = field(default=())
    distance: int = 0


_LEX = re.compile(r'"([^"]*)"(?:~(\d+))?|(\()|(\))|\b(?:NEAR|near)/(\d+)\b|(?<!\S)/(\d+)\b|(\bAND\b|&&?)|(\bOR\b|\|\|?)|(\bNOT\b|!|(?<!\S)-(?=\S))|([^\s()"|&!]+)')
_WORD = re.compile(r"[0-9]+(?:[/.][0-9]+)+|[^\W_]+(?:['’][^\W\d_]+)*", re.UNICODE)


def words_of(text: str) -> tuple[str, ...]:
    return tuple(w.lower() for w in _WORD.findall(text))


def parse_query(query: str) -> Node | None:
    """Phrases, parentheses, ~N and NEAR/N, AND, OR and NOT in words and signs, word*, and AND where nothing stands between."""
    lexed = []
    for m in _LEX.finditer(query):
        phrase, near, left, right, n1, n2, and_, or_, not_, word = m.groups()
        if phrase is not None:
            ws = words_of(phrase)
            if ws:
                lexed.append(Node("near" if near else "phrase" if len(ws) > 1 else "term", ws, distance=int(near or 0)))
        elif left or right:
            lexed.append(left or right)
        elif n1 or n2:
            lexed.append(("near", int(n1 or n2)))
        elif and_ or or_ or not_:
            lexed.append("and" if and_ else "or" if or_ else "not")
        else:
            ws = words_of(word)
            if word.endswith("*") and ws:
                lexed.append(Node("prefix", ws[-1:]))
            elif ws:
                lexed.append(Node("term" if len(ws) == 1 else "phrase", ws))
    at = 0

    def peek():
        return lexed[at] if at < len(lexed) else None

    def either():
        nonlocal at
        parts = [both()]
        while peek() == "or":
            at += 1
            parts.append(both())
        parts = [p for p in parts if p]
        return parts[0] if len(parts) == 1 else Node("or", parts=tuple(parts)) if parts else None

    def both():
        nonlocal at
        parts = []
        while (x := peek()) is not None and x not in ("or", ")"):
            if x == "and":
                at += 1
                continue
            if isinstance(x, tuple):
                at += 1
                right = single()
                if parts and right and parts[-1].words and right.words:
                    parts[-1] = Node("near", parts[-1].words + right.words, distance=x[1])
                elif right:
                    parts.append(right)
                continue
            one = single()
            if one:
                parts.append(one)
        return parts[0] if len(parts) == 1 else Node("and", parts=tuple(parts)) if parts else None

    def single():
        nonlocal at
        x = peek()
        at += 1
        if x == "not":
            inner = single() if at < len(lexed) else None
            return Node("not", parts=(inner,)) if inner else None
        if x == "(":
            inner = either()
            if peek() == ")":
                at += 1
            return inner
        return x if isinstance(x, Node) else None

    out = either()
    while at < len(lexed):  # stray closing brackets
        at += 1
        more = either()
        out = Node("and", parts=(out, more)) if out and more else out or more
    return out


def _gap_pattern(words: tuple[str, ...], gap: str) -> str:
    return r"(?iU)(?<![\p{L}\p{N}])" + gap.join(re.escape(w) for w in words) + r"(?![\p{L}\p{N}])"


def matches(text: Column, node: Node | None) -> Column:
    """Whether the text satisfies a parsed query, read literally: words at word bounds, phrases with punctuation between."""
    if node is None:
        return F.lit(False)
    if node.op in ("term", "phrase"):
        return text.rlike(_gap_pattern(node.words, r"[\s\p{P}\p{S}]{1,4}"))
    if node.op == "prefix":
        return text.rlike(r"(?iU)(?<![\p{L}\p{N}])" + re.escape(node.words[0]))
    if node.op == "near":
        between = rf"(?:[\s\p{{P}}\p{{S}}]+[\p{{L}}\p{{N}}'’]+){{0,{max(node.distance - 1, 0)}}}[\s\p{{P}}\p{{S}}]+"
        return text.rlike(_gap_pattern(node.words, between)) | text.rlike(_gap_pattern(node.words[::-1], between))
    if node.op == "not":
        return ~matches(text, node.parts[0])
    join = (lambda a, b: a & b) if node.op == "and" else (lambda a, b: a | b)
    return reduce(join, (matches(text, p) for p in node.parts))


def search(docs: DataFrame, query: str, text: str = "text") -> DataFrame:
    """docs that satisfy a query."""
    return docs.filter(F.coalesce(matches(F.col(text), parse_query(query)), F.lit(False)))


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, doc_id, positions): the full-text index."""
    rows = docs.select(F.col(doc_id), F.posexplode(tokens(F.col(text))).alias("position", "term"))
    return rows.groupBy("term", doc_id).agg(F.array_sort(F.collect_list("position")).alias("positions"))


def bm25(docs: DataFrame, query: str, k1: float = 1.2, b: float = 0.75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of documents with a query word; statistics are over all documents, and only query words leave the scan."""
    words = sorted(set(words_of(query)))
    rows = docs.select(doc_id, tokens(F.col(text)).alias("t")).select(doc_id, F.size("t").alias("length"), F.filter("t", lambda x: x.isin(*words)).alias("hits"))
    whole = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    tf = rows.select(doc_id, "length", F.explode("hits").alias("term")).groupBy(doc_id, "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # at most a row for each query word
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return tf.join(F.broadcast(df), "term").join(F.broadcast(whole)).withColumn("part", part).groupBy(doc_id).agg(F.sum("part").alias("score"))


def snippet(text: Column, word: str, width: int = 320) -> Column:
    """The text around the first place of a word, cut at white space; the start of the text if it isn't there."""
    at = F.greatest(F.lit(1), F.instr(F.lower(text), word.lower()) - width // 2)
    return F.trim(F.regexp_replace(F.substring(text, at, F.lit(width)), r"^\S*\s|\s\S*$", ""))


def vector_top_k(vectors: DataFrame, query: list[float], k: int, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows nearest by cosine; equal scores by id. An exact scan: k rows a task reach the merge."""
    score = F.round(cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])), 9)
    return vectors.select(ident, score.alias("score")).orderBy(F.desc("score"), ident).limit(k)


#: Queries that are sent to all tasks at once.
QUERY_BLOCK = 2048


def nearest_of_queries(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest of each query, itself left out.

    queries is a stated set; it is taken in blocks of about `block` vectors, each a matrix that goes to all tasks.
    A task scores its vectors as matrix products and keeps k a query, and those are merged.
    """
    n = queries.count()
    parts = max(1, -(-n // block))
    found = [_nearest(vectors, queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == p) if parts > 1 else queries, k) for p in range(parts)]
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    rows = queries.select("vec_id", "embedding").filter(F.col("embedding").isNotNull()).collect()  # about a block
    q_ids = np.array([r["vec_id"] for r in rows], np.int64)
    q = np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), -1)
    q = q / np.maximum(np.sqrt((q * q).sum(1)), 1e-300)[:, None]
    shared = vectors.sparkSession.sparkContext.broadcast((q_ids, q))

    def best(ids: np.ndarray, query: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((ids, -score, query))
        first = np.searchsorted(query[order], query[order])
        keep = order[np.arange(len(order)) - first < k]
        return ids[keep], query[keep], score[keep]

    def run(batches):
        q_ids, q = shared.value
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for b in batches:
            if not b.num_rows or not len(q_ids):
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)
            v = np.stack([np.asarray(x, np.float64) for x in b.column(1).to_numpy(zero_copy_only=False)])
            norm = np.sqrt((v * v).sum(1))
            score = np.round(v @ q.T / np.maximum(norm, 1e-300)[:, None], 9)
            score[ids[:, None] == q_ids[None, :]] = -np.inf
            top = np.partition(score, max(0, len(ids) - k), axis=0)[max(0, len(ids) - k)]  # the k-th best of each query
            i, j = np.nonzero((score >= top[None, :]) & np.isfinite(score))
            held = best(np.r_[held[0], ids[i]], np.r_[held[1], q_ids[j]], np.r_[held[2], score[i, j]])
        yield pa.RecordBatch.from_arrays([pa.array(held[1]), pa.array(held[0]), pa.array(held[2])], names=["query_id", "vec_id", "score"])

    return vectors.filter(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "query_id long, vec_id long, score double")


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """rows with rank from 1; meant for lists that are cut already."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def reciprocal_rank_fusion(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """(key, score): the sum of 1 / (k + rank) over ranked lists."""
    union = reduce(DataFrame.unionByName, (x.select(key, "rank") for x in lists))
    return union.groupBy(key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))


def containment(hits: DataFrame) -> DataFrame:
    """Hits without the document chunk (-1) of documents of which a leaf chunk is there."""
    leaf = F.max((F.col("chunk_id") != -1).cast("int")).over(Window.partitionBy("doc_id"))
    return hits.withColumn("__leaf", leaf).filter((F.col("chunk_id") != -1) | (F.col("__leaf") == 0)).drop("__leaf")


def authority_prior(candidates: DataFrame, authority: DataFrame, key: str = "doc_id") -> DataFrame:
    """Candidates that have an authority row, once each, ranked by it; it brings in no others."""
    known = candidates.select(key).distinct().join(authority.select(F.col("node").alias(key), "rank").withColumnRenamed("rank", "pagerank"), key)
    return rank_all(known, [F.desc("pagerank"), F.asc(key)])


def recall_and_mrr(found: DataFrame, queries: DataFrame, relevant: Column) -> DataFrame:
    """One row: recall@k and mean reciprocal rank of ranked results (query_id, rank, ...) over all queries."""
    first = found.filter(relevant).groupBy("query_id").agg(F.min("rank").alias("first"))
    rows = queries.select("query_id").join(first, "query_id", "left")
    return rows.agg(F.count("*").alias("queries"), F.round(F.avg(F.col("first").isNotNull().cast("double")), 4).alias("recall"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 4).alias("mrr"))


def compile_query(node: Node | None) -> str | None:
    """A parsed query in the notation of a text index: 'word', 'word':*, <-> between the words of a phrase, <N> for near ones, &, | and !; negated phrases are left to the literal check."""
    if node is None:
        return None
    quoted = lambda w: "'" + w.replace("'", "") + "'"
    if node.op in ("term", "prefix"):
        return quoted(node.words[0]) + (":*" if node.op == "prefix" else "")
    if node.op in ("phrase", "near"):
        return "(" + (" <-> " if node.op == "phrase" else f" <{node.distance}> ").join(map(quoted, node.words)) + ")"
    if node.op == "not":
        inner = None if node.parts[0].op in ("phrase", "near") else compile_query(node.parts[0])
        return f"!({inner})" if inner else None
    parts = [x for x in map(compile_query, node.parts) if x]
    return None if not parts else parts[0] if len(parts) == 1 else "(" + (" & " if node.op == "and" else " | ").join(parts) + ")"


def candidates(index: DataFrame, node: Node | None) -> DataFrame | None:
    """(doc_id) of documents that may satisfy a query, from postings (term, doc_id, positions): words by equality, prefixes by range, phrases by
    adjacent positions, AND by semi joins, OR by unions. Exclusions narrow nothing here; None where the index can't bound the query."""
    if node is None:
        return None
    ids = lambda rows: rows.select("doc_id").distinct()
    if node.op == "prefix":
        return ids(index.filter(F.col("term").startswith(node.words[0])))
    if node.op in ("term", "phrase", "near"):
        found = None
        for word in node.words:
            rows = index.filter(F.col("term") == word).select("doc_id", "positions")
            if found is None:
                found = rows
            elif node.op == "phrase":
                met = found.join(rows.withColumnRenamed("positions", "__p"), "doc_id")
                found = met.select("doc_id", F.array_intersect(F.transform("positions", lambda x: x + 1), "__p").alias("positions")).filter(F.size("positions") > 0)
            else:
                found = found.join(rows.select("doc_id"), "doc_id", "left_semi")
        return ids(found)
    if node.op == "not":
        return None
    parts = [candidates(index, p) for p in node.parts]
    if node.op == "or":
        return None if any(p is None for p in parts) else reduce(DataFrame.unionByName, parts).distinct()
    known = [p for p in parts if p is not None]
    return reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), known) if known else None


@dataclass(frozen=True)
class Found:
    """Answers of a full-text search: all of them (doc_id, char_start), and one page with snippets."""

    matched: DataFrame
    page: DataFrame
    compiled: str | None


def full_text(index: DataFrame, docs: DataFrame, query: str, *, order: list | None = None, limit: int = 25, offset: int = 0, heading: str | None = None, width: int = 320) -> Found:
    """Documents whose text, or heading, satisfies a query: candidates from the index, each checked against its text, all of them counted; snippets only for the page.

    char_start: where the first positive word of the query stands, from 0; of a hit in a heading alone, 0.
    """
    node = parse_query(query)
    may = candidates(index, node)
    rows = docs if may is None else docs.join(may, "doc_id", "left_semi")
    body = F.coalesce(matches(F.col("text"), node), F.lit(False))
    titled = F.coalesce(matches(F.col(heading), node), F.lit(False)) if heading else F.lit(False)
    words = _positive(node)
    first = F.least(*(F.when(F.instr(F.lower("text"), w) > 0, F.instr(F.lower("text"), w) - 1) for w in words), F.lit(None).cast("int")) if words else F.lit(0)
    hits = rows.filter(body | titled).withColumn("char_start", F.when(body, F.coalesce(first, F.lit(0))).otherwise(0))
    ordered = hits.orderBy(*(order or [F.asc("doc_id")])).offset(offset).limit(limit)
    start = F.greatest(F.lit(1), F.col("char_start") + 1 - width // 2)
    shown = ordered.withColumn("snippet", F.trim(F.regexp_replace(F.substring("text", start, F.lit(width)), r"^\S*\s|\s\S*$", ""))).drop("text")
    return Found(hits.select("doc_id", "char_start"), shown, compile_query(node))


def _positive(node: Node | None) -> list[str]:
    if node is None or node.op == "not":
        return []
    return [*node.words, *(w for p in node.parts for w in _positive(p))]


def within(docs: DataFrame, words: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, char_start, char_end): every place of a phrase in each text, whatever the index holds."""
    pattern = _gap_pattern(words_of(words), r"[\s\p{P}\p{S}]{1,4}")
    pieces, found = F.split(F.col(text), pattern, -1), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    both = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, f: F.struct(F.length(p).alias("p"), F.length(f).alias("f")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<char_start:int,char_end:int>>").alias("out"))
    places = F.aggregate(both, start, lambda s, x: F.struct((s["at"] + x["p"] + x["f"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x["p"]).alias("char_start"), (s["at"] + x["p"] + x["f"]).alias("char_end")))).alias("out")))["out"]
    return docs.filter(F.col(text).rlike(pattern)).select(doc_id, F.inline(places))


def with_signals(fused: DataFrame, lists: dict[str, DataFrame], authority: DataFrame, key: str = "doc_id") -> DataFrame:
    """fused results with the rank each list gave them (null: none) and their percentile of authority."""
    for name, rows in lists.items():
        fused = fused.join(rows.groupBy(key).agg(F.min("rank").alias(f"{name}_rank")), key, "left")
    return fused.join(authority.select(F.col("node").alias(key), "percentile"), key, "left")


def reranked(rows: DataFrame, score: Column | None = None, order: list | None = None) -> DataFrame:
    """rows, of a list that is cut already, in the order of another score; without one as they are."""
    return rows if score is None else rows.withColumn("rerank_score", score).orderBy(F.desc("rerank_score"), *(order or []))


def hybrid_lists(lexical: DataFrame, semantic: DataFrame, vectors: DataFrame, family: str, dims: int) -> list[DataFrame]:
    """The lists to fuse: the semantic one only if vectors of the family and length are there."""
    ready = not vectors.filter((F.col("family") == family) & (F.size("vector") == dims)).limit(1).isEmpty()
    return [lexical, semantic] if ready else [lexical]
