"""Every query with SQL gives the rows that DuckDB gives."""

import decimal
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import text as Tx
from tessera.plans import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_are_those_of_the_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    rows = sorted((tuple(map(plain, r)) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def same_as_sql(spark, name, folder, **tables):
    """The rows of a query and of its SQL over made tables."""
    c = duckdb.connect()
    for t, rows in tables.items():
        rows.write.parquet(f"{folder}/{t}.parquet")
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got, want = QUERIES[name](spark, str(folder)), c.sql(ORACLE_SQL[name])
    at = [want.columns.index(x) for x in got.columns]
    rows = sorted((tuple(map(plain, r)) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    return rows


def test_frontier_rounds_halves_to_even(spark, tmp_path):
    events = [(1, 1, "view", 2.5), (2, 2, "view", 3.5), (4, 3, "view", 7.0), (5, 3, "view", None), (7, 4, "view", None), (8, 5, "error", 4.0), (10, 5, None, 4.0)]
    rows = spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    assert same_as_sql(spark, "ingest_backfill_frontier", tmp_path, events=rows) == [(1, 2), (2, 4), (3, 7), (4, None)]


def test_sentences_behind_abbreviations(spark, tmp_path):
    texts = ["La no. No. El. Ie. Ch. Ungach.", "No. R. V. P. Art. Xyz. No.", "At 12345678901234567890. The end 7. Then", "art\u017f. (a) Nos. [b] \u212ano. No. A", "One.\x0bTwo. \x0b Three.\u0085 Four.  Five \u0085", "Xno. A _no. B éno. C no.. D", "", " \n ", None, "a.\x01 \x02B"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(same_as_sql(spark, "text_sentence_split", tmp_path, documents=docs))
    assert [s for d, _, s in rows if d == 0] == ["La no. No.", "El.", "Ie. Ch.", "Ungach."]
    for d, text in enumerate(texts[:6]):
        assert [text[a:z].strip(Tx.WHITE) for a, z in Tx._sentence_spans(text)] == [s for x, _, s in rows if x == d]


#: Queries that SQL can't say, each with a test of its rows below or in the tests of its operator.
WITHOUT_SQL = {"text_chunk", "text_grammar_scan", "text_collapse_edges", "text_treatment", "text_hashed_embedding", "graph_components_veto", "shard_bin_packing", "text_reanchor", "agg_recall_audit", "text_language_grammars"}


def test_every_query_has_sql_or_a_test():
    assert {n for n in set(QUERIES) - set(ORACLE_SQL)} <= WITHOUT_SQL


def test_chunks_hold_every_word(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    held: dict = {}
    for r in QUERIES["text_chunk"](spark, DIR).collect():
        held.setdefault(r["doc_id"], []).append(r)
        assert r["text"].split()[0] == texts[r["doc_id"]][r["char_start"] :].split()[0]
    for d, t in texts.items():
        own = sorted(held.get(d, []), key=lambda r: r["chunk_id"])
        assert [r["chunk_id"] for r in own] == list(range(len(own))) and set(t.split()) == {w for r in own for w in r["text"].split()}
        for a, b in zip(own, own[1:]):
            assert a["char_start"] < b["char_start"]


def test_citations_are_those_of_the_patterns(spark):
    import re

    from tessera.operators.text import GRAMMARS

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = QUERIES["text_grammar_scan"](spark, DIR).collect()
    everything = {(d, m.start(), m.end(), k) for d, t in texts.items() for k, p in GRAMMARS for m in p.finditer(t)}
    assert got and {(r["doc_id"], r["char_start"], r["char_end"], r["kind"]) for r in got} <= everything
    assert all(r["raw"] == texts[r["doc_id"]][r["char_start"] : r["char_end"]] and r["context"] == texts[r["doc_id"]][max(0, r["char_start"] - 200) : r["char_start"]] for r in got)
    for d, a, z, _ in everything:  # what was dropped lies within or across something kept
        assert any(r["doc_id"] == d and r["char_start"] < z and a < r["char_end"] for r in got)
    edges = QUERIES["text_collapse_edges"](spark, DIR).collect()
    want: dict = {}
    for r in sorted(got, key=lambda r: (r["char_start"], r["char_end"], r["raw"])):
        want.setdefault((r["doc_id"], r["kind"], r["raw"].lower()), []).append(r["char_start"])
    assert {(r["doc_id"], r["kind"], r["raw"].lower()): (r["char_start"], r["occurrences"]) for r in edges} == {k: (v[0], len(v)) for k, v in want.items()}
    treated = {(r["doc_id"], r["char_start"]): r["treatment"] for r in QUERIES["text_treatment"](spark, DIR).collect()}
    assert len(treated) == len(got) and all(treated[r["doc_id"], r["char_start"]] is None for r in got if r["kind"] != "case")
    assert re.compile(GRAMMARS[0][1].pattern)


def test_hashed_embeddings(spark):
    import hashlib
    import re

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").limit(20).collect()}
    for r in QUERIES["text_hashed_embedding"](spark, DIR).collect():
        if r["doc_id"] in texts:
            v = [0.0] * 64
            for w in re.findall(r"\w+", texts[r["doc_id"]].lower()):
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                v[int.from_bytes(h[:4], "big") % 64] += 1.0 if h[4] & 1 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            assert r["vector"] == pytest.approx([x / n for x in v], abs=1e-5)


def test_components_veto_is_the_ordered_merge(spark):
    rel = duckdb.sql(f"SELECT 'd' || l_orderkey AS a, 'c' || l_partkey AS b, count(*) AS n FROM '{DIR}/lineitem.parquet' WHERE l_linestatus = 'F' GROUP BY ALL").fetchall()
    parent, names = {}, {}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in rel:
        for x in (a, b):
            parent[x] = x
            names[x] = {x[-2:]} if x[0] == "d" and len(x) % 2 == 0 else set()
    for a, b, _ in sorted(rel, key=lambda r: (-r[2], r[0], r[1])):
        x, y = sorted((top(a), top(b)))
        if x != y and len(names[x] | names[y]) <= 1:
            parent[y], names[x] = x, names[x] | names[y]
    groups: dict = {}
    for x in parent:
        groups.setdefault(top(x), set()).add(x)
    got: dict = {}
    for r in QUERIES["graph_components_veto"](spark, DIR).collect():
        got.setdefault(r["cluster"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_reanchored_places(spark):
    import re

    want = set()
    for r in spark.read.parquet(f"{DIR}/documents.parquet").filter("length(text) >= 80").collect():
        t, old = r["text"], 40 if r["doc_id"] % 2 == 0 else 55
        raw = t[40:80]
        low = max(0, old - 5000)
        places = [m.start() + low for m in re.finditer(re.escape(raw), t[low : old + 5040])]
        want.add((r["doc_id"], old if t[old : old + 40] == raw else min(places, key=lambda p: (abs(p - old), p))))
    assert {tuple(r) for r in QUERIES["text_reanchor"](spark, DIR).collect()} == want


def test_recall_audit(spark):
    import re
    from collections import Counter

    spans: dict = {}
    for r in QUERIES["text_grammar_scan"](spark, DIR).collect():
        spans.setdefault(r["doc_id"], []).append((r["char_start"] - 2, r["char_end"] + 2))
    hits, bare = Counter(), Counter()
    for r in spark.read.parquet(f"{DIR}/documents.parquet").collect():
        for cue, pattern in (("licence", r"\bLicense\b"), ("url", r"https?://")):
            for m in re.finditer(pattern, r["text"]):
                hits[cue, r["source"]] += 1
                bare[cue, r["source"]] += not any(s <= m.end() and m.start() <= e for s, e in spans.get(r["doc_id"], ()))
    got = {(r["cue"], r["source"]): (r["hits"], r["uncovered"]) for r in QUERIES["agg_recall_audit"](spark, DIR).collect()}
    assert got == {k: (n, bare[k]) for k, n in hits.items()} and got


def test_shards(spark):
    chunks = QUERIES["text_chunk"](spark, DIR).groupBy("doc_id").count().collect()
    got = QUERIES["shard_bin_packing"](spark, DIR).select("doc_id", "shard").collect()
    assert len(got) == sum(r["count"] for r in chunks) and len({(r["doc_id"], r["shard"]) for r in got}) == len(chunks)


def test_the_rest_works_without_the_llm_folders(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    script = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(s) <= set(q) and 'pipeline' not in q and not any(n.startswith('op1_') for n in q)"
    subprocess.run([sys.executable, "-c", script], cwd=tmp_path / "copy", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    os.remove(tmp_path / "copy" / "corpus_pipeline.py")
    subprocess.run([sys.executable, "-c", script], cwd=tmp_path / "copy", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).limit(5).collect()
    assert rows and rows[0]["citing"] >= rows[-1]["citing"]
    assert set(e.oracle_sql()) <= set(e.queries())
