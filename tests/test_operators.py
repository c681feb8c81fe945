"""Facts about single operators, on literals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import legal as L
from tessera.functions import text as X
from tessera.operators import filters as Fi
from tessera.operators import graph as G
from tessera.operators import ingest as I
from tessera.operators import joins as J
from tessera.operators import ranking as R
from tessera.operators import resolve as Re
from tessera.operators import search as S
from tessera.operators import tagging as T
from tessera.operators import text as Tx
from tessera.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_decay_halves_in_ten_years(spark):
    assert one(spark, L.decay_weight(F.lit(2016), 2026)) == pytest.approx(0.5)
    assert one(spark, L.decay_weight(F.lit(2030), 2026)) == 1.0
    assert one(spark, L.decay_weight(F.lit(None).cast("int"), 2026)) == pytest.approx(0.5**1.5)
    assert one(spark, L.decay_weight(F.lit(0), 2026)) == pytest.approx(0.5**1.5)


def test_backoff_doubles_up_to_a_limit(spark):
    assert [one(spark, L.backoff_days(F.lit(k))) for k in range(5)] == [21, 42, 84, 168, 168]


def test_version_suffix(spark):
    for v, base, date in (("a/b@2020-01-02", "a/b", dt.date(2020, 1, 2)), ("x-20210304", "x", dt.date(2021, 3, 4)), ("plain", "plain", None)):
        got = one(spark, L.version_base_and_date(F.lit(v)))
        assert (got["base"], got["date"]) == (base, date)


def test_effective_date_ladder(spark):
    of = lambda i: one(spark, L.effective_date(F.lit(None).cast("date"), F.lit(i)))
    assert of("ECLI:EU:C:2020:559")["date"] == dt.date(2020, 12, 31) and of("uksc/2019/4")["origin"] == "identifier" and of("nothing")["origin"] == "none"


def test_fold_and_anchor(spark):
    assert one(spark, X.fold_latin(F.lit("Élan Çà"))) == "elan ca"
    assert one(spark, X.fold_citation(F.lit("  E.W.C.A.  Civ. 1.5 "))) == "ewca civ 1.5"
    assert one(spark, X.anchor_norm(F.lit("§ 33A (1)."))) == "33a(1)"
    assert one(spark, X.anchor_in_family(F.lit("s33a(1)"), F.lit("s33a"))) and not one(spark, X.anchor_in_family(F.lit("s33a"), F.lit("s3")))
    assert spark.createDataFrame([("Ⅷ Straße",), (None,)], "t string").select(X.fold(F.col("t")).alias("f")).orderBy(F.col("f").isNull()).first()["f"] == "viii strasse"


def test_matchers_take_the_first_shape(spark):
    got = one(spark, L.match_reference(F.lit("see Case C-311/18 (x)")))
    assert (got["matcher"], got["candidate"]) == ("case_number", "c-311/18")
    assert one(spark, L.match_reference(F.lit("nothing")))["matcher"] is None


def test_pagerank_on_a_small_graph(spark):
    # a ring of three, one more page that points into it, and a page that points nowhere
    e = spark.createDataFrame([("p", "q"), ("q", "r"), ("r", "p"), ("s", "q"), ("q", "t")], "src string, dst string")
    want = dict.fromkeys("pqrst", 0.2)
    for _ in range(12):
        lost = want["t"]
        given = {"p": want["r"], "q": want["p"] + want["s"], "r": want["q"] / 2, "s": 0.0, "t": want["q"] / 2}
        want = {k: 0.03 + 0.17 * lost + 0.85 * v for k, v in given.items()}
    rank = {r["node"]: r["rank"] for r in G.pagerank(e, 12).collect()}
    assert rank == pytest.approx(want)
    auth = {r["node"]: r for r in G.authority(e, iterations=12).collect()}
    assert auth["q"]["percentile"] == 100 and (auth["q"]["in_degree"], auth["q"]["out_degree"]) == (2, 2) and auth["s"]["percentile"] is None
    assert {k: auth[k]["percentile"] for k in "prt"} == {k: 100 * sum(round(rank[x], 12) <= round(rank[k], 12) for x in "pqrt") / 4 for k in "prt"}


def test_decayed_rank_prefers_recent_citers(spark):
    e = spark.createDataFrame([("old", "x", 0.1), ("new", "y", 1.0)], "src string, dst string, w double")
    rank = {r["node"]: r["rank"] for r in G.pagerank(e, 4, weight="w").collect()}
    assert rank["y"] > rank["x"] and sum(rank.values()) == pytest.approx(1)


def test_veto_keeps_two_names_apart(spark):
    links = spark.createDataFrame([("n1", "r", 5), ("n2", "r", 3)], "a string, b string, support long")
    kinds = spark.createDataFrame([("n1", "N1"), ("n2", "N2"), ("r", None)], "node string, neutral string")
    got = {r["node"]: r["cluster"] for r in G.components_with_veto(links, kinds).collect()}
    assert got["n1"] == got["r"] != got["n2"]


def test_veto_merges_like_the_ordered_loop_without_a_python_task(spark, monkeypatch):
    import random

    from pyspark.sql import GroupedData

    def refuse(*_):
        raise AssertionError("a component in one task")

    monkeypatch.setattr(GroupedData, "applyInPandas", refuse)
    draw = random.Random(3)
    links = [(f"{g}a{draw.randrange(n)}", f"{g}{draw.choice('ab')}{draw.randrange(n)}", draw.randrange(1, 4)) for g, n, m in ((0, 4, 8), (1, 12, 30), (2, 40, 60), (3, 60, 200)) for _ in range(m)]
    links = [*{(a, b): (a, b, s) for a, b, s in links}.values(), ("lone", "lone", 1)] + [(f"p{i:02}", f"p{i + 1:02}", 9) for i in range(40)]
    kinds = {x: draw.choice("MNO") for e in links for x in e[:2] if draw.random() < 0.2} | {"p00": "M", "p40": "N"}
    parent = {x: x for e in links for x in e[:2]}
    names = {x: {kinds[x]} if x in kinds else set() for x in parent}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in sorted(links, key=lambda e: (-e[2], e[0], e[1])):
        x, y = sorted((top(a), top(b)))
        if x != y and len(names[x] | names[y]) <= 1:
            parent[y], names[x] = x, names[x] | names[y]
    with_null = spark.createDataFrame([*links, ("gone", None, 1)], "a string, b string, support long")
    got = G.components_with_veto(with_null, spark.createDataFrame([*kinds.items(), ("0a0", None)], "node string, neutral string")).collect()
    assert sorted(map(tuple, got)) == sorted((x, top(x)) for x in parent)


def test_asof_takes_the_latest_and_drops_the_rest(spark):
    v = spark.createDataFrame([(1, dt.date(2020, 1, 1)), (1, dt.date(2021, 1, 1))], "base_id long, version_date date")
    r = spark.createDataFrame([("a", 1, dt.date(2021, 1, 1)), ("b", 1, dt.date(2020, 6, 1)), ("c", 1, dt.date(2019, 1, 1)), ("d", 2, dt.date(2022, 1, 1))], "ref_id string, base_id long, ref_date date")
    assert [(x[0], x[1].year) for x in rows(J.asof_latest(v, r), "ref_id", "version_date")] == [("a", 2021), ("b", 2020)]


def test_division_needs_two_targets(spark):
    e = spark.createDataFrame([(1, 7), (1, 8), (2, 7)], "src_id long, dst_id long")
    assert rows(J.relational_division(e, [7, 8])) == [(1,)] and J.relational_division(e, [7]).count() == 0


def test_chase(spark):
    a = spark.createDataFrame([("x", "y"), ("y", "z"), ("q", "lost")], "alias string, canonical_id string")
    assert rows(J.chase(a, spark.createDataFrame([("z",)], "stable_id string"))) == [("x", "z"), ("y", "z")]


def test_resolution_passes(spark):
    docs = spark.createDataFrame([("d1", "E1"), ("d2", None)], "stable_id string, ecli string")
    al = spark.createDataFrame([("Name A", "d2"), ("s.i. no. 4", "d1")], "alias string, canonical_id string")
    p = spark.createDataFrame([(1, "E1", "r"), (2, "NAME A", "r"), (3, None, "Name A"), (4, None, "S.I. No 4"), (5, "none", "Name A")], "edge_id long, candidate string, raw string")
    assert rows(Re.resolve(p, docs, al), "edge_id", "resolved", "pass") == [(1, "d1", 1), (2, "d2", 2), (3, "d2", 3), (4, "d1", 4), (5, None, None)]


def test_names_refuse_ambiguity(spark):
    left = spark.createDataFrame([(1, "Smith v Jones", 2001)], "id long, name string, year int")
    right = spark.createDataFrame([(7, "Smith v Jones", 2001), (8, "Jones v Smith", 2000)], "id long, name string, year int")
    assert Re.match_names(left, right).count() == 0 and rows(Re.match_names(left, right.limit(1)), "right_id") == [(7,)]


def test_rank_fusion_and_containment(spark):
    a = S.ranked(spark.createDataFrame([("a", 0.9), ("b", 0.8)], "k string, s double"), [F.desc("s")])
    b = S.ranked(spark.createDataFrame([("b", -1.0), ("c", -2.0)], "k string, s double"), [F.desc("s")])
    got = S.reciprocal_rank_fusion([a, b], "k").orderBy(F.desc("score")).collect()
    assert got[0]["k"] == "b" and got[0]["score"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)
    hits = spark.createDataFrame([("d", -1), ("d", 3), ("e", -1)], "doc_id string, chunk_id int")
    assert rows(S.containment(hits)) == [("d", 3), ("e", -1)]


def test_queries_are_parsed_and_matched(spark):
    q = S.parse_query('alpha (beta | "gamma delta") -epsilon')
    assert q.op == "and" and q.parts[1].op == "or" and q.parts[2].op == "not"
    docs = spark.createDataFrame([(1, "Alpha, beta."), (2, "alpha gamma, delta"), (3, "alpha beta epsilon"), (4, "alphabet beta"), (5, None)], "doc_id long, text string")
    assert rows(S.search(docs, 'alpha (beta | "gamma delta") -epsilon'), "doc_id") == [(1,), (2,)]
    assert rows(S.search(docs, "alphab*"), "doc_id") == [(4,)] and S.search(docs, "").count() == 0
    assert rows(S.search(docs, "alpha NEAR/3 epsilon"), "doc_id") == [(3,)]


def test_cosine_of_a_zero_vector(spark):
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, L.cosine(a(0, 0), a(1, 0))) == 0 and one(spark, L.cosine(a(2, 0), a(1, 0))) == 1
    assert one(spark, L.l2_normalise(a(3, 4))) == pytest.approx([0.6, 0.8]) and one(spark, L.l2_normalise(a(0, 0))) == [0, 0]


def test_rules_treat_nulls_as_missing(spark):
    docs = spark.createDataFrame([(1, "x", None), (2, "x", "en")], "doc_id long, text string, lang string")
    f = lambda op, v: rows(docs.filter(T.compile_tree({"predicate": "field", "args": {"field": "lang", "op": op, "value": v}})), "doc_id")
    assert f("ne", "en") == [(1,)] and f("eq", "en") == [(2,)] and f("in", ["en"]) == [(2,)] and f("gte", "a") == [(2,)]
    both = {"op": "not", "children": [{"predicate": "literal", "args": {"value": "X"}}, {"predicate": "field", "args": {"field": "lang", "op": "eq", "value": "en"}}]}
    assert rows(docs.filter(T.compile_tree(both)), "doc_id") == [(1,)]
    assert T.validate_tree({"op": "xor"}) and T.validate_tree({"predicate": "regex", "args": {"pattern": "("}}) and not T.validate_tree(both)


def test_rules_leave_manual_tags(spark):
    docs = spark.createDataFrame([(1, "hit"), (2, "hit"), (3, "no")], "doc_id long, text string")
    old = spark.createDataFrame([(1, "t", "manual", None), (3, "t", "rule", 5)], "doc_id long, tag string, added_by string, rule_id long")
    got = T.apply_rule(docs, {"predicate": "literal", "args": {"value": "hit"}}, "t", old, rule_id=5)
    assert rows(got, "doc_id", "added_by") == [(1, "manual"), (2, "rule")]


def test_treatment_takes_the_nearest_cue(spark):
    of = lambda c, k=None: one(spark, Tx.treatment(F.lit(c), F.lit(k).cast("string")))
    assert of("the court followed X but distinguished ") == "distinguishes" and of("We overruled A. It also noted ") == "considers"
    assert of("it declined to follow ") == "follows"  # the later cue wins, even inside a longer one
    assert of("applied", "legislation") is None and of("plain words") is None and of("considered") is None and of("It DISAPPROVED of ", "case") == "overrules"


def test_sentences_and_chunks(spark):
    assert one(spark, Tx.sentences(F.lit("See Art. 5 of it. The end came. It did."))) == ["See Art. 5 of it.", "The end came.", "It did."]
    assert Tx.chunks("") == [] and Tx.chunks(None) == []
    text = "\n\n".join(f"Block {k} " + "word " * 30 for k in range(6))
    got = Tx.chunks(text, least=64)
    assert [c[0] for c in got] == [0, 1, 2] and all(len(c[1].split()) == 64 for c in got)
    long = " ".join(f"Sentence number {k} has a few words in it." for k in range(200))
    parts = Tx.chunks(long)
    assert len(parts) > 2 and all(len(p[1].split()) <= 400 for p in parts)
    nested = Tx.chunks("aa bb", [("Part 1", 0, 2, 1), ("s 1", 3, 5, 2)], least=0)
    assert [c[2:4] for c in nested] == [("Part 1", ""), ("s 1", "Part 1")]


def test_overlaps():
    found = [(0, 10, "act", "x"), (2, 8, "url", "y"), (9, 15, "act", "z"), (12, 20, "case", "w")]
    assert [f[3] for f in Tx.drop_overlaps(found)] == ["x", "w"]


def test_upserts(spark):
    cur = spark.createDataFrame([("a", "h1", 1, True), ("b", "h2", 1, False)], "stable_id string, payload_hash string, version int, search_excluded boolean")
    new = spark.createDataFrame([("a", "h9", 1, False), ("b", "h2", 1, False), ("c", "h3", 1, False)], cur.schema)
    assert rows(I.upsert_versions(cur, new)) == [("a", "h9", 2, True), ("b", "h2", 1, False), ("c", "h3", 1, False)]
    assert rows(I.archived(cur, new), "stable_id") == [("a",)]


def test_watermark_stops_at_a_failure(spark):
    d = lambda n: dt.date(2024, 1, n)
    run = spark.createDataFrame([(d(1), True), (d(3), True), (d(4), False), (d(6), True)], "date date, ok boolean")
    assert I.next_watermark(run, "2024-01-31").first()[0] == d(3) and I.next_watermark(run, "2024-01-02").first()[0] == d(2)
    assert I.since(run, "2024-01-05", 2).count() == 3 and I.since(run, None).count() == 4


def test_new_stubs(spark):
    stubs = spark.createDataFrame([("a", "u1"), ("b", "u2"), ("c", "u3"), ("c", "u4"), ("d", "u5")], "stable_id string, landing_url string")
    held = spark.createDataFrame([("a", None), ("z", "u2")], "stable_id string, landing_url string")
    assert rows(I.new_stubs(stubs, held, spark.createDataFrame([("d", "x")], "alias string, canonical_id string")), "stable_id") == [("c",)]


def test_filters_without_scope_fit_nothing(spark):
    docs = spark.createDataFrame([("s", "c", dt.date(2020, 1, 1))], "source string, court string, decision_date date")
    assert docs.filter(Fi.source_or_court([])).count() == 0 and Fi.retrieval_prefilter(docs, scopes=[]).count() == 0
    assert docs.filter(Fi.year_range("decision_date", 2020, 2020)).count() == 1


def test_capped_count(spark):
    assert tuple(R.capped_count(spark.range(10), 5).first()) == (5, True) and tuple(R.capped_count(spark.range(3), 5).first()) == (3, False)


def test_shards_hold_whole_documents(spark):
    c = spark.createDataFrame([(d, k) for d in range(40) for k in range(d % 4 + 1)], "doc_id long, chunk_id int")
    got = sinks.shards(c, 10, buckets=2)
    assert got.count() == c.count() and got.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count() == 0


def test_archives(spark, tmp_path):
    import io
    import zipfile

    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("b.txt", "two")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.txt", "one")
        z.writestr("in.zip", inner.getvalue())
    got = readers.archive_members(spark, str(tmp_path), ".txt").collect()
    assert sorted((r["member"], bytes(r["content"])) for r in got) == [("a.txt", b"one"), ("in.zip/b.txt", b"two")]


def test_html(spark):
    p = spark.createDataFrame([(1, "u", '<html><title>A &amp; B</title><script>x</script><p>Hi <a href="/q">there</a></p>')], "page_id long, url string, html string")
    r = readers.pages(p).first()
    assert r["text"] == "A & B Hi there" and r["links"] == ["/q"]


def test_fuzzy_names_match_over_all_of_part(spark):
    import math

    from tessera.plans import graphs
    from tessera.views import Tables

    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    names = [(r[0], set(r[1]), r[2]) for r in part.select("p_partkey", Re.surnames(F.concat_ws(" ", "p_name", "p_brand")), F.col("p_size") + 1990).collect()]
    want = set()
    for i, a, y in names:
        scores = []
        for j, b, z in names:
            both = len(a & b)
            if i != j and -2 <= z - y <= 1 and both and (both >= 2 or both == len(a)):
                scores.append((-math.floor((0.5 * both / len(a | b) + 0.5 * both / len(a)) * 1000 + 0.5) / 1000, j))
        scores.sort()
        if scores and (len(scores) == 1 or scores[1][0] - scores[0][0] >= 0.08):
            want.add((i, scores[0][1], -scores[0][0]))
    got = {tuple(r) for r in graphs.match_fuzzy_names(Tables(spark, "/root/testdata/sf0.001")).collect()}
    assert got == want and {i % 7 for i, *_ in got} == set(range(7))


def test_names_of_copies_and_repeated_ids(spark):
    import random

    r = random.Random(7)
    words = ["alder", "birch", "cedar", "maple", "rowan", "willow"]
    table = [(k if k % 9 else k - 1, " ".join(r.sample(words, r.choice((1, 2, 3, 3, 4)))), 2000 + r.randrange(3)) for k in range(70)]
    table += [(500, "alder elm larch", 2003), (501, "alder elm larch pine", 2002), (600, None, 2001), (None, "oak elm yew", 2003)]
    df = spark.createDataFrame(table, "id long, name string, year int")
    for least, itself in ((2, False), (1, False), (2, True)):
        by: dict = {}
        for i, n, y in table:
            for j, m, z in table:
                a, b = frozenset((n or "").split()), frozenset((m or "").split())
                if (itself or i is not None and j is not None and i != j) and a & b and -2 <= z - y <= 1 and (len(a & b) >= least or len(a & b) == len(a)):
                    by.setdefault(i, set()).add((-round(0.5 * len(a & b) / len(a | b) + 0.5 * len(a & b) / len(a) + 1e-9, 3), -1 if j is None else j, a, b))
        want = set()
        for i, found in by.items():
            first, *rest = sorted(found, key=lambda x: x[:2])
            if not rest or round(rest[0][0] - first[0], 3) >= 0.08:
                want.add((i, None if first[1] < 0 else first[1]))
        assert {tuple(x) for x in Re.match_names(df, df, least_shared=least, itself=itself).select("left_id", "right_id").collect()} == want and want
    plan = Re.match_names(df, df, itself=False)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_applicants_share_words_once(spark):
    left = spark.createDataFrame([(1, "Anna Ivanova Petrova v France", 2000), (2, "M.C. v Turkey", 2001), (3, "Anna v Spain", 2000), (4, None, 2000)], "id long, name string, year int")
    right = spark.createDataFrame([(7, "Ivanova Anna v France", 2001), (8, "M. C.", 2000), (9, "Petrova v Turkey", 2000), (10, "Anna v Norway", 2000)], "id long, name string, year int")
    got = Re.match_applicants(left, right, ("Turkey", "France"))
    assert rows(got) == [(1, 7, 0.833), (2, 8, 0.45)]
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate [left_id" not in plan  # no shuffle of pairs


def test_grammars_of_languages(spark):
    from tessera.operators import citing as Ct

    texts = {
        "de": ("nach § 823 Abs. 1 BGB und BGH, Urteil vom 1. Mai, VI ZR 45/09 gilt", ["§ 823 Abs. 1 BGB", "BGH, Urteil vom 1. Mai, VI ZR 45/09"]), "at": ("OGH 4 Ob 123/10x zu § 879 ABGB", ["OGH 4 Ob 123/10x", "§ 879 ABGB"]),
        "fr": ("l'article 1240 du code civil, n° 12-34.567", ["article 1240 du code civil", "n° 12-34.567"]), "nl": ("artikel 6:162 lid 2 BW; LJN: BC1234", ["artikel 6:162 lid 2 BW", "LJN: BC1234"]),
        "it": ("art. 2043 c.c. e Cass. civ. n. 1234/2010", ["art. 2043 c.c.", "Cass. civ. n. 1234/2010"]), "es": ("artículo 24 de la Constitución, STC 31/1981", ["artículo 24 de la Constitución", "STC 31/1981"]),
        "da": ("§ 3, stk. 2 i lov nr. 502 og UfR 2010.1234", ["§ 3, stk. 2 i lov nr. 502", "UfR 2010.1234"]), "sv": ("NJA 2010 s. 12 och 3 kap. 1 § brottsbalken", ["NJA 2010 s. 12", "3 kap. 1 § brottsbalken"]), "fi": ("KKO 2010:12", ["KKO 2010:12"]),
        "et": ("RKTKo 3-2-1-5-10", ["RKTKo 3-2-1-5-10"]), "sk": ("§ 5 ods. 1 zákona č. 40/1964 Zb.", ["§ 5 ods. 1 zákona č. 40/1964 Zb."]), "us": ("410 U.S. 113 and 42 U.S.C. § 1983", ["410 U.S. 113", "42 U.S.C. § 1983"]), "cw": ("[2010] HCA 5; 2010 SCC 5", ["[2010] HCA 5", "2010 SCC 5"]),
    }
    docs = spark.createDataFrame([(k, t, k) for k, (t, _) in texts.items()], "doc_id string, text string, lang string")
    got = {}
    for r in Ct.citations_by_language(docs, lang="lang").filter("lang = doc_id").orderBy("doc_id", "char_start").collect():
        assert texts[r["doc_id"]][0][r["char_start"] : r["char_end"]] == r["raw"]
        got.setdefault(r["doc_id"], []).append(r["raw"])
    assert got == {k: w for k, (_, w) in texts.items()}


def test_queries_compile_for_an_index(spark):
    of = lambda q: S.compile_query(S.parse_query(q))
    assert of('alpha (beta | "gamma delta") -eps*') == "('alpha' & ('beta' | ('gamma' <-> 'delta')) & !('eps':*))"
    assert of('alpha NOT "x y"') == "'alpha'" and of("") is None and of("a NEAR/3 b") == "('a' <3> 'b')"
    docs = spark.createDataFrame([(1, "alpha gamma delta"), (2, "alpha delta gamma"), (3, "beta alpha"), (4, "none")], "doc_id long, text string")
    index = S.postings(docs)
    ids = lambda q: sorted(r[0] for r in S.full_text(index, docs, q).matched.collect())
    for q in ("alpha", '"gamma delta"', "alpha -beta", "alpha OR none", "-alpha", "gam*", "alpha NEAR/2 gamma"):
        assert ids(q) == sorted(r["doc_id"] for r in S.search(docs, q).collect()), q
    titled = docs.withColumn("heading", F.when(F.col("doc_id") == 4, "alpha"))
    everything = S.postings(titled.withColumn("text", F.concat_ws(" ", "text", "heading")))
    assert [r["doc_id"] for r in S.full_text(everything, titled, "alpha", heading="heading", limit=2, offset=2).page.collect()] == [3, 4]


def test_feeds_registry_files(spark, tmp_path):
    import zipfile

    from tessera.sources import records as Rc

    (tmp_path / "feed.jsonl").write_text('{"stable_id": "a", "text": "x", "date": "2024-01-02"}\nbroken\n{"stable_id": "b", "text": "y", "date": "2023-01-02"}\n')
    spark.dataSource.register(Rc.FeedSource)
    assert [tuple(r) for r in spark.read.format("feed").option("path", str(tmp_path / "feed.jsonl")).option("since", "2024").load().select("stable_id", "text").collect()] == [("a", "x")]
    reg = Rc.Registry()
    reg.register(Rc.Source("uk-x", lambda s, o: s.range(int(o["n"])), "bulk", "United Kingdom"))
    assert reg.read(spark, "uk-x", n="3").filter("source = 'uk-x'").count() == 3 and rows(reg.catalogue(spark)) == [("uk-x", "bulk", "United Kingdom")]
    with pytest.raises(ValueError):
        reg.register(reg.sources["uk-x"])
    folder = tmp_path / "files"
    folder.mkdir()
    with zipfile.ZipFile(folder / "a.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>One &amp; two</w:t></w:p><w:p><w:t>three</w:t></w:p>")
    (folder / "b.rtf").write_text(r"{\rtf1{\fonttbl{\f0 Arial;}}\f0 Caf\'e9\par next}")
    (folder / "c.html").write_text("<html><script>x</script><p>Hi <b>you</b></p></html>")
    (folder / "d.pdf").write_bytes(b"%PDF-1.4 stream endstream")
    (folder / "e.docx").write_bytes(b"not a zip")
    (folder / "f.txt").write_text("plain")
    got = {r["path"][-5:]: (r["text"], r["needs_ocr"]) for r in Rc.files_text(spark, str(folder)).collect()}
    assert got["a.docx"[-5:]][0] in ("One & two\nthree", "") and got["b.rtf"[-5:]] == ("Café\nnext", False) and got["c.html"[-5:]] == ("Hi you", False) and got["d.pdf"[-5:]][1] and got["f.txt"[-5:]] == ("plain", False)


def test_alerts_are_pushed(spark, tmp_path):
    from tessera.sources import records as Rc

    spark.range(7).write.parquet(str(tmp_path / "alerts"))
    sent = []
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "alerts"))
    Rc.pushed(stream, sent.append, str(tmp_path / "state"), 3).awaitTermination()
    assert sorted(x["id"] for b in sent for x in b) == list(range(7)) and max(map(len, sent)) == 3


def test_headers_and_chains(spark):
    got = one(spark, Tx.header(F.lit("s 45"), F.lit("A › B › C › D"), place=F.lit("UK"), court=F.lit(None).cast("string"), year=F.lit(2018), title=F.lit("T" * 90)))
    assert got == "[UK · 2018 · " + "T" * 77 + "… · B › C › D · s 45] "
    chain = [(f"n{k}", f"n{k + 1}") for k in range(40)] + [("x", "y"), ("y", "x")]
    a = spark.createDataFrame(chain, "alias string, canonical_id string")
    found = J.chase(a, spark.createDataFrame([("n40",)], "stable_id string")).collect()
    assert {r["alias"] for r in found} == {f"n{k}" for k in range(40)} and {r["stable_id"] for r in found} == {"n40"}


def test_who_may_start(spark):
    from tessera.operators import jobs as Jb

    j = lambda rows_: spark.createDataFrame(rows_, "job_id long, kind string, status string, source string, params string, started_at long")
    running = j([(1, "scan", "running", "a", "{}", 1), (2, "read", "running", None, "{}", 1)])
    queued = j([(3, "scan", "queued", "a", "{}", 2), (4, "scan", "queued", "b", "{}", 3), (5, "other", "queued", None, "{}", 4), (6, "read", "queued", None, "{}", 5)])
    assert rows(Jb.claimable(queued, running, exempt=("read",), most=2, scans=("scan",)), "job_id") == [(4,), (6,)]
