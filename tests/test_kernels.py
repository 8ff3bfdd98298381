"""Kernels against plain loops, on rows with ties, nulls and groups of every size."""

import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from folioscope.operators import dedup, harvest, matching, nearest, proposals
from folioscope.plans import greedy


def plain_chunks(rows, budget):
    groups = {}
    for g, i, t in rows:
        groups.setdefault(g, []).append((i is not None, i or 0, t))
    out = []
    for g, xs in groups.items():
        chunk, filled = -1, 0
        for has, i, t in sorted(xs):
            if chunk < 0 or filled + t > budget:
                chunk, filled = chunk + 1, 0
            filled += t
            out.append((g, i if has else None, t, chunk))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [0, 1, 60, 3000])
@pytest.mark.parametrize("partitions", [1, 8, 23])
def test_greedy_packing(spark, n, partitions):
    rng = random.Random(n + partitions)
    rows = [(rng.choice(["a"] * 6 + ["b", "c", None]), rng.choice([rng.randint(0, 900), None]) if rng.random() < 0.1 else k, rng.choice([0, 1, 5, 20, 200, 1500])) for k in range(n)]
    df = spark.createDataFrame(rows, "grp string, idx int, tok int")
    for budget in (1, 100, 1000):
        assert sorted(map(tuple, greedy.chunked(df, "grp", "idx", F.col("tok"), budget, partitions).collect()), key=str) == plain_chunks(rows, budget)


def test_block_tables_say_what_a_loop_says():
    rng = random.Random(3)
    for _ in range(300):
        budget = rng.randint(1, 30)
        t = np.array([rng.choice([0, 1, 2, 7, 40]) for _ in range(rng.randint(1, 25))])
        state, opened = greedy.block_table(t, budget)
        for s in range(budget + 3):
            filled, n = s - 1, 0
            for x in t.tolist():
                if filled < 0 or filled + x > budget:
                    filled, n = 0, n + 1
                filled += x
            assert (int(state[s]), int(opened[s])) == (min(filled, budget + 1) + 1, n)


def plain_spans(text, entries):
    out = []
    for entry, terms in entries:
        terms = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
        if terms:
            p = regex.compile(r"(?<![\p{L}\p{N}_])(?:" + "|".join(map(regex.escape, terms)) + r")(?![\p{L}\p{N}_])")
            out += [(m.start(), m.end(), entry, m[0]) for m in p.finditer(text or "")]
    return [(e, term, s, x, k) for k, (s, x, e, term) in enumerate(sorted(out))]


def test_spans_of_a_glossary(spark):
    rng = random.Random(8)
    words = ["of", "the", "of the", "House", "House of", "é", "a_b", "_", "++", "(b)", "Saint-Élise", "Élise", "x", "x x", "x x x", "東", "3"]
    entries = [(f"e{k:02}", rng.sample(words, rng.randint(1, 4)) + rng.choice([[], [""], [None]])) for k in range(25)]
    texts = [(k, "".join(rng.choice(words) + rng.choice([" ", " ", ", ", "", "  ", "\n"]) for _ in range(rng.randint(0, 40)))) for k in range(120)] + [(500, None), (501, ""), (502, "Saint-Élise Élise x x x x")]
    df, e = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(entries, "entry_id string, terms array<string>")
    worded = [(i, ws) for i, ws in entries if "++" not in ws]
    for some, small in ((entries, 500), (worded, 2)):  # sent whole, and met on first words
        want = sorted((k, *x) for k, t in texts for x in plain_spans(t, [(i, [w for w in ws if w]) for i, ws in some]))
        assert sorted(map(tuple, matching.glossary_spans(df, spark.createDataFrame(some, e.schema), small=small).collect())) == want
    with pytest.raises(ValueError):
        matching.glossary_spans(df, spark.createDataFrame([("a", ["+", "-", "*"])], e.schema), small=2).collect()


@pytest.mark.parametrize("tile,stripe", [(4096, 16), (7, 2), (40, 1)])
def test_earlier_top_k(spark, tile, stripe):
    rng = np.random.default_rng(tile)
    v = rng.integers(-2, 3, (150, 4)).astype(float)  # many equal directions
    rows = [(k, int(rng.integers(0, 4)), int(rng.integers(0, 30)), v[k].tolist() if k % 13 else None, bool(k % 3)) for k in range(150)]
    df = spark.createDataFrame(rows, "id int, spine int, idx int, vector array<double>, ok boolean")
    got = sorted(map(tuple, nearest.earlier_top_k(df, "id", "vector", ["spine", "idx"], F.col("ok"), 3, 0.3, tile, stripe).select("query_id", "place", "ref_id").collect()))
    unit = v / np.where(np.linalg.norm(v, axis=1) == 0, 1, np.linalg.norm(v, axis=1))[:, None]
    want = []
    for q in rows:
        near = [(-round(float(unit[q[0]] @ unit[r[0]]), 12), r[0]) for r in rows if r[3] and q[3] and r[4] and r[1:3] < q[1:3]]
        want += [(q[0], p, r) for p, (s, r) in enumerate(sorted(x for x in near if -x[0] >= 0.3)[:3], 1)]
    assert got == sorted(want)


@pytest.mark.parametrize("block", [4096, 11])
def test_top_k_by_group(spark, block):
    rng = np.random.default_rng(block)
    v = rng.integers(-2, 3, (120, 4)).astype(float)
    limits = {"a": (2, 0.1), "b": (5, 0.5), "c": (0, 0.9), "d": (-1, 0.0)}
    refs = [(k, v[k].tolist() if k % 9 else None, "abcd"[min(k % 7, 3)], *limits["abcd"[min(k % 7, 3)]]) for k in range(120)]
    df = spark.createDataFrame(refs, "id int, vector array<double>, book string, k int, least double")
    q = spark.createDataFrame([(k, v[k].tolist()) for k in range(0, 120, 10)], "id int, vector array<double>")
    got = sorted((r["query_id"], r["book"], r["ref_id"]) for r in nearest.top_k_by_group(q, df, "id", "vector", "book", "k", "least", block).collect())
    unit = v / np.where(np.linalg.norm(v, axis=1) == 0, 1, np.linalg.norm(v, axis=1))[:, None]
    want = []
    for a in range(0, 120, 10):
        for g, (k, least) in limits.items():
            if k <= 0:
                want += [(a, g, r[0]) for r in refs if r[2] == g]
            else:
                near = sorted((-round(float(unit[a] @ unit[r[0]]), 12), r[0]) for r in refs if r[2] == g and r[1])
                want += [(a, g, r) for s, r in near if -s >= least][:k]
    assert got == sorted(want)


def one_after_another(raw, entries):
    """The glossary after each proposal has met what the ones before it left."""
    state = {e[0]: dict(zip(("id", "source", "target", "type", "status"), e, strict=True), aliases=[]) for e in entries}
    canon = lambda t: regex.sub(r" (?:company|society)$", "", t.lower().strip().rstrip(".,;:!?")).rstrip(".,;:!?")
    bare = lambda t: regex.sub(r"^(?:the|an|a) ", "", t, flags=regex.I) if t else t
    out = []
    for seq, source, target, kind in raw:
        if not (source or "").strip() or regex.fullmatch(r"\d{1,4}", source.strip()):
            continue
        source, target = source.strip(), (target or "").strip() or None
        target = None if target == source else target
        source, target = bare(source), bare(target)
        target = None if target == source else target
        kind = kind if kind in ("place", "term", "event") else "term"
        exact = [e for e in sorted(state.values(), key=lambda e: e["id"]) if e["source"] == source]
        alike = [e for e in sorted(state.values(), key=lambda e: (e["source"] or "", e["id"])) if e["source"] and canon(source) and canon(e["source"]) == canon(source)]
        how = "exact" if exact else "canonical" if alike else "created"
        if how == "created":
            e = state[f"p{seq}"] = {"id": f"p{seq}", "source": source, "target": target or source, "type": kind, "status": "proposed", "aliases": []}
        else:
            e = (exact or alike)[0]
            if how == "canonical" and source.lower() != e["source"].lower() and source not in e["aliases"]:
                e["aliases"].append(source)
            if e["status"] == "proposed" and e["type"] == "term" and kind != "term":
                e["type"] = kind
            if e["status"] == "proposed" and target and e["target"] == e["source"]:
                e["target"] = target
        out.append((seq, e["id"], how))
    touched = {x[1] for x in out}
    return out, sorted((e["id"], e["source"], e["target"], e["type"], e["status"], tuple(sorted(e["aliases"]))) for e in state.values() if e["id"] in touched)


def test_proposals_are_resolved_as_one_after_another(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("text").collect()
    words = [w for r in docs for w in (r["text"] or "").split()][:6000]
    rng = random.Random(9)
    raw = []
    for seq in range(1500):
        w = words[rng.randrange(len(words))]
        form = rng.choice([w, w, w.upper(), f"The {w}", f"{w} Company", f"{w}.", f" {w} Society ", "...", "1066", ""])
        raw.append((seq, form, rng.choice([None, w, w[::-1], f"a {w[::-1]}"]), rng.choice(["place", "term", "event", "planet", None])))
    entries, seen = [], set()
    for k in range(150):
        w = words[rng.randrange(len(words))]
        if w not in seen:
            seen.add(w)
            entries.append((f"e{k}", w, rng.choice([w, "x"]), rng.choice(["term", "event"]), rng.choice(["proposed", "locked"])))
    e = spark.createDataFrame(entries, "id string, source_term string, target_term string, type string, status string").withColumn("source_aliases", F.array().cast("array<string>"))
    df = spark.createDataFrame([(s, "g", a, b, c, None) for s, a, b, c in raw], "seq int, segment_id string, source string, target string, type string, evidence string")
    plain = [r for r in raw if all(ord(c) < 128 and c not in "()-" for c in (r[1] + (r[2] or "")))]
    got = proposals.resolve(proposals.candidates(df.where(F.col("seq").isin([r[0] for r in plain]))), e, "en", "en")
    want, after = one_after_another(plain, entries)
    assert len(want) > 700 and {x[2] for x in want} == {"exact", "canonical", "created"}
    assert sorted((r["seq"], r["entry_id"], r["how"]) for r in got.collect()) == sorted(want)
    assert sorted((*r[:5], tuple(r[5])) for r in map(tuple, proposals.applied(got, e).collect())) == after


@pytest.mark.parametrize("distance,block", [(2, 3), (1, 2), (3, 1)])
def test_near_pairs_reach_all_pairs(spark, distance, block):
    rng = random.Random(distance)
    keys = ["".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 8, 12]))) for _ in range(220)] + [None, "abcabc", "abcabc"]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = []
    for j, b in enumerate(keys):
        for i, a in enumerate(keys[:j]):
            n = min(block, len(a or ""), len(b or ""))
            if n and a[:n] == b[:n] and edits(a, b) <= distance:
                want.append((i, j))
    df = spark.createDataFrame(list(enumerate(keys)), "id int, k string")
    assert sorted(map(tuple, dedup.near_pairs(df, "id", "k", distance, block).collect())) == sorted(want)


def test_prose_chunks_follow_the_loop(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("source", "doc_id", "text")
    long = [("z", 1, "x" * 700), ("z", 2, "a. " * 300), ("z", 3, "[[T0]] "), ("z", 4, None), ("z", 5, "End! " + "y" * 400 + " tail"), (None, 1, "alone")]
    df = docs.unionByName(spark.createDataFrame(long, "source string, doc_id bigint, text string"))
    books = {}
    for r in sorted(df.collect(), key=lambda r: r["doc_id"]):
        t = regex.sub(r"\s+", " ", regex.sub(r"\[\[/?T\d+\]\]", "", r["text"] or "")).strip()
        if t:
            books.setdefault(r["source"], []).append(t)
    want = []
    for most in (300, 1200):
        for book, texts in books.items():
            chunks, held = [], ""
            for t in texts:
                if held and len(held) + len(t) + 2 > most:
                    chunks.append(held)
                    held = ""
                held = f"{held}\n\n{t}" if held else t
                while len(held) > most:
                    window = held[: most + 2]
                    para = window.rfind("\n\n")
                    stop = max(window.rfind(m) for m in (". ", "! ", "? "))
                    blank = held[: most + 1].rfind(" ")
                    at = para if para > most / 2 else stop + 2 if stop > most / 2 else blank if blank > 0 else most
                    chunks.append(held[:at].strip())
                    held = held[at:].strip()
            want += [(most, book, k, c) for k, c in enumerate([*chunks, held] if held else chunks)]
    got = [(most, *r) for most in (300, 1200) for r in map(tuple, harvest.prose_chunks(df, "source", "doc_id", "text", most).collect())]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(len(r[3]) <= r[0] + 1 for r in got)  # a full stop may stand just behind the length


@pytest.mark.parametrize("most", [0, 5, 48])
def test_near_pairs_by_rests_and_by_segments(spark, most):
    rng = random.Random(most)
    keys = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(150)})
    df = spark.createDataFrame(list(enumerate(keys)), "id int, k string")
    want = df.toDF("a", "x").crossJoin(df.toDF("b", "y")).where("a < b and levenshtein(x, y) <= 2 and left(x, least(3, length(x), length(y))) = left(y, least(3, length(x), length(y)))")
    assert sorted(map(tuple, dedup.near_pairs(df, "id", "k", most=most).collect())) == sorted(map(tuple, want.select("a", "b").collect()))


def test_numbered_names_do_not_all_meet(spark):
    """Names that differ in their last digits share their other segments with all."""
    names = spark.range(1000).selectExpr("format_string('Supplier#%09d', id) as k").withColumn("r", F.length("k"))
    met = dedup.met_by_rest(names, 2, 3)
    near = names.alias("a").join(names.alias("b"), F.expr("a.k < b.k and levenshtein(a.k, b.k, 2) >= 0")).count()
    assert near <= met.count() < 3 * near and met.where("levenshtein(x, y, 2) >= 0").distinct().count() == near


def test_whole_groups_are_not_ranked(spark):
    """What a group without limit returns takes no part in a shuffle."""
    refs = spark.range(300).selectExpr("id", "array(1f, cast(id as float)) as vector", "cast(id % 3 as int) as book", "if(id % 3 = 0, 2, 0) as k", "0.0d as least")
    got = nearest.top_k_by_group(refs.where("id < 40").select("id", "vector"), refs, "id", "vector", "book", "k", "least")
    rows = got.where("book > 0").groupBy("query_id").count().collect()
    assert len(rows) == 40 and {r["count"] for r in rows} == {200}
    branches = got._jdf.queryExecution().optimizedPlan().children()
    assert ["Window" in branches.apply(n).toString() for n in range(branches.size())] == [True, False]
