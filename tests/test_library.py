"""Every query with SQL against DuckDB, and operators on the survey's small fixtures."""

import duckdb
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from folioscope import queries as Q
from folioscope.functions import text as T
from folioscope.operators import batch, context, dedup, glossary, ledger, matching, prompts, retrieval
from folioscope.plans.graph import connected_components, forest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(norm, x))
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_against_duckdb(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    want = con.sql(Q.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in cols]
    assert sorted(want.columns) == cols
    assert got == sorted(repr(tuple(norm(r[k]) for k in at)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for name in ("html_segments", "mock_embeddings"):
        assert entry.queries()[name](spark, SF).count() > 0


def test_anchor_join_equals_pattern_join(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(-1, "a (b) the reino of rei, ++ the of", None, None, 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    terms = spark.createDataFrame([("a", "the"), ("b", "of the"), ("c", "rei"), ("d", "(b)"), ("e", "++"), ("f", "the reino of")], "entry_id string, term string")
    got = {tuple(r) for r in matching.term_matches(docs, terms).collect()}
    p = terms.withColumn("p", T.term_pattern(F.array("term")))
    want = docs.join(F.broadcast(p)).select("doc_id", "entry_id", "term", F.expr("regexp_count(text, p)").cast("bigint").alias("n")).where("n > 0")
    assert got == {tuple(r) for r in want.collect()}
    assert {r[1] for r in got if r[0] == -1} == {"a", "c", "d", "e", "f"}
    s = matching.glossary_spans(spark.createDataFrame([(1, "the x the")], "doc_id int, text string"), spark.createDataFrame([("a", ["the"])], "entry_id string, terms array<string>")).collect()
    assert sorted((x["start"], x["end"]) for x in s) == [(0, 3), (6, 9)]


def test_rename_is_literal(spark):
    df = spark.createDataFrame([(1, "rei do reino, rei")], "id int, target_text string")
    r = matching.rename(df, "rei", "$1\\x").first()
    assert (r["target_text"], r["replacements"]) == ("$1\\x do reino, $1\\x", 2)


def test_dialogue_and_space(spark):
    rows = [('"Yes," he said', True), ("“Yes”", True), ("「はい」", True), ("— Come", True), ("«Oui»", True), ("plain prose", False), ("mid—word", False), (None, False), ("", False), ("‘Come in,’ he said", True), ("‚Ja‘", True), ("—", False), ("3〝x", False)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert df.where(T.dialogue(F.col("t")) != F.col("want")).count() == 0
    sp = spark.createDataFrame([("  a\n", "b"), ("a ", " b"), ("a", "b")], "s string, t string").select(T.outer_space(F.col("s"), F.col("t")).alias("x"))
    assert [r["x"] for r in sp.collect()] == ["  b\n", " b ", "b"]
    assert spark.range(1).select(T.jtrim(F.lit(" ﻿ x \n")).alias("x")).first()["x"] == "x"


def test_clusters_on_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], "t"), (2, [0.999, 0.001, 0.0, 0.0], "t"), (3, [0.0, 1.0, 0.0, 0.0], "t"), (4, [1.0, 0.0, 0.0, 0.0], "u")], "id bigint, v array<double>, k string")
    pairs = dedup.cosine_pairs(df, "id", "v", "k", 0.92)
    assert [(r["component"], r["members"]) for r in dedup.clusters(pairs).collect()] == [(1, [1, 2])]
    top = dedup.top_k(df.where("id = 1"), df, "id", "v", 3)
    assert [r["ref_id"] for r in top.orderBy("place").collect()] == [4, 2, 3]
    assert dedup.top_k(df, df, "id", "v", 0).count() == 0


def test_propose_and_duplicates(spark):
    old = spark.createDataFrame([("x1", "FIFA", "proposed", "term")], "id string, source_term string, status string, type string")
    new = spark.createDataFrame([(1, "The FIFA (", "t", "organization"), (2, "Fifa", "t", "term"), (3, "House", "t", "place")], "seq int, source_term string, target_term string, type string")
    got = {r["canon"]: (r["entry_id"], r["type"], r["outcome"]) for r in glossary.propose(new, old).collect()}
    assert got == {"fifa": ("x1", "organization", "matched"), "house": (None, "place", "created")}


def test_prompts(spark):
    df = spark.createDataFrame([("src & <b>", [(1, "near"), (2, "far <x>")], None), ("s", [], "h")], "s string, c array<struct<back:int,t:string>>, h string")
    a, b = (r["m"] for r in df.select(prompts.user_message(F.col("s"), F.col("c"), F.col("h")).alias("m")).collect())
    assert a == "<context>\nfar &lt;x&gt;\nnear\n</context>\n\n<source>\nsrc & <b>\n</source>" and b == "<hints>\nh\n</hints>\n\n<source>\ns\n</source>"
    r = spark.createDataFrame([('{"translation": "x"}',), ('ok: {"translation": "y"} done',), ("{}",), ("none",)], "t string").select(prompts.parsed(F.col("t"), "translation string", "translation").alias("p")).collect()
    assert [x["p"]["ok"] for x in r] == [True, True, False, False] and r[1]["p"]["value"]["translation"] == "y" and [x["p"]["error"] for x in r[2:]] == ["no translation", "no JSON"]
    e = spark.range(1).select(prompts.entity(F.lit(" Rome "), F.lit("planet"), F.lit(7)).alias("e"), prompts.skeleton(F.lit("[]")).alias("k"), prompts.skeleton(F.lit(None).cast("string")).alias("n"), prompts.style(F.lit("Formal-Plain"), F.lit(None).cast("string"), [("audience", "children", "kids"), ("register", "formal_plain", "f")]).alias("s"), prompts.clamped(F.lit("9"), 2, 0, 5).alias("c")).first()
    assert (e["e"]["term"], e["e"]["type"], e["e"]["confidence"], e["s"], e["c"], e["n"]["host_total_parts"]) == ("Rome", "term", 1.0, "f", 5.0, 1)
    lang = spark.createDataFrame([("pt", "Portuguese", 1), ("pt-BR", "Brazilian", 2), ("en", "English", 3)], "k string, name string, o int")
    tags = spark.createDataFrame([("pt-br",), ("pt-PT",), ("xx",)], "tag string")
    assert {r["tag"]: r["name"] for r in prompts.by_tag(tags, "tag", lang, "k", "name").collect()} == {"pt-br": "Brazilian", "pt-PT": "Portuguese", "xx": None}
    assert [r["k"] for r in prompts.search(lang, "PT", "k", "name", "o").collect()] == ["pt", "pt-BR"]


def test_retrieval(spark):
    seg = spark.createDataFrame([(k, 0, k, "translated", "t", "x" * 500) for k in range(4)], "id int, spine int, idx int, status string, target_text string, source_text string")
    vec = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (3, [1.0, 0.05])], "id int, vector array<double>")
    assert {r["id"]: r["refs"] for r in retrieval.relevant(seg, vec).collect()} == {1: [0], 3: [0]}
    prop = spark.createDataFrame([(7, "zeta", [1.0, 0.0]), (8, "alpha", [0.9, 0.1]), (9, "no", [0.0, 1.0])], "id int, source_term string, vector array<double>")
    assert [r["hints"] for r in retrieval.hints(vec.where("id = 0"), prop).collect()] == [["8", "7"]]
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, q array<double>")
    ents = spark.createDataFrame([("a", "e1", [1.0, 0.0]), ("a", "e2", [0.9, 0.2]), ("b", "e3", [0.0, 1.0])], "lore_id string, id string, vector array<double>")
    att = spark.createDataFrame([("a", 1, 0.5), ("b", 0, None)], "lore_id string, top_k int, min_similarity double")
    assert {r["id"] for r in retrieval.from_books(q, ents, att).collect()} == {"e1", "e3"}
    inv = spark.createDataFrame([("s", "1", "m"), ("s", "1", "n"), ("s", "2", "n")], "scope string, ref_id string, model string")
    assert tuple(retrieval.inventory(inv, F.lit("m")).first()) == ("s", 3, 2, 1, 1)
    hosts = spark.createDataFrame([("c", "/p[1]", 0), ("c", "/p[1]", 1), ("c", "/p[2]", 2)], "chapter string, host_path string, idx int")
    img = spark.createDataFrame([("c", "i1", 1), ("c", "i2", 9)], "chapter string, src string, splice_at int")
    assert {r["src"]: r["before_idx"] for r in retrieval.image_places(hosts, img).collect()} == {"i1": 2, "i2": 2**31 - 1}


def test_batch_run(spark):
    seg = spark.createDataFrame([(1, "c", 1, "the king"), (2, "c", 2, "[[T0]] "), (3, "c", 3, "no term")], "id int, chapter string, idx int, source_text string")
    ent = spark.createDataFrame([("g", "the", "der", [], "locked", True)], "id string, source_term string, target_term string, target_aliases array<string>, status string, source_known boolean")
    none = spark.createDataFrame([], "call_id string, created_at bigint, cache_key string, cost double, ok boolean")
    one = {r["id"]: r for r in batch.run(seg, ent, none, "0" * 32, price=1.0).collect()}
    assert (one[1]["status"], one[2]["status"], one[3]["status"]) == ("flagged", "translated", "translated")
    assert one[2]["cost"] == 0 and one[3]["target_text"] == "[mock-tr] no term"
    calls = spark.createDataFrame([("k", 1, one[3]["cache_key"], 1.0, True)], none.schema)
    two = {r["id"]: r for r in batch.run(seg, ent, calls, "0" * 32, price=1.0).collect()}
    assert two[3]["cache_hit"] == 1 and two[3]["cost"] == 0
    assert batch.run(seg, ent, none, "0" * 32, price=1.0, budget=1.0).count() == 1
    many = spark.createDataFrame([(k, "ab"[k // 10], k % 10, f"the the king {k}") for k in range(20)], seg.schema)
    got = {r["id"]: r["status"] for r in batch.run(many, ent.limit(0), none, "0" * 32, fails=F.col("id").isin(2, 7, 8, 9, 11, 15), window=4, trip=3).collect()}
    # three failures within four rows end the run at 9, for good; repeated particles flag the rest
    assert got == {k: "failed" if k in (2, 7, 8, 9) else "flagged" for k in range(10)}
    assert {r["status"] for r in batch.run(many, ent.limit(0), none, "0" * 32, target_lang="pt").collect()} == {"translated"}
    # the budget counts over the whole run, not by chapter
    cost = sorted(r["cost"] for r in batch.run(many, ent.limit(0), none, "0" * 32, price=1.0).collect())
    assert batch.run(many, ent.limit(0), none, "0" * 32, price=1.0, budget=sum(cost[:12]) - 0.5).count() == 12


def test_negative_tokens_fail(spark):
    with pytest.raises(Exception, match="negative"):
        spark.range(1).select(ledger.cost(F.lit(-1), F.lit(1), F.lit(1.0), F.lit(1.0))).collect()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
def test_forest(edges):
    import numpy as np

    up = {k: k for k in range(31)}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    a, b = (np.array(c, np.int64) for c in (zip(*edges) if edges else ([], [])))
    got = dict(zip(*forest(a, b))) if edges else {}
    assert all(got.get(k, k) == root(k) for e in edges for k in e)


def test_components_on_a_path(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7), (None, 3)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in connected_components(path.repartition(8), "a", "b").collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500}


def test_previous_context(spark):
    df = spark.createDataFrame([("c", k, t) for k, t in enumerate(["aaaa", " ", "bb", "cc", "“hi”"])], "g string, i int, t string")
    got = {r["i"]: [x["t"] for x in r["context"]] for r in context.previous(df, "g", "i", "t", most=2, budget=4).collect()}
    assert got == {0: [], 1: ["aaaa"], 2: ["aaaa"], 3: ["bb"], 4: ["cc", "bb"]}
    only = {r["i"]: [x["t"] for x in r["context"]] for r in context.previous(df, "g", "i", "t", only=T.dialogue(F.col("t"))).collect()}
    assert all(not v for v in only.values())
