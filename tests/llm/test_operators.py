"""Operators against brute force, on a fixture with every odd case and on a small table."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F, types as T

from folioscope.llm import exact, langid, lattice, mixing, packing, passages, quality, queries, simhash, suffix, vectors

SF = "/root/testdata/sf0.001"
WHITE = b" \t\n\r\x0b\f"

LONG = " ".join(f"word{k % 977} and{k % 13}" for k in range(12_000))
BASE = "the quick brown fox jumps over the lazy dog while nine tall giants walk along the river bank and sing songs of old times " * 3
ROWS = [
    (1, BASE, "en", "a", 7),
    (2, BASE.upper(), "en", "a", 7),
    (3, BASE + " tail", "en", "a", None),
    (4, None, None, None, 1),
    (5, "", "en", "b", 1),
    (6, "  \n\t ", "xx", "b", 1),
    (7, "one two", "en", "b", 2),
    (8, "one two", "de", "b", 2),
    (8, "one two", "de", "b", 2),
    (9, LONG, "de", "a", 3),
    (10, "prefix " + BASE, "fr", None, 3),
    (11, "ünïcödé ñandú 東京  x " * 8, "fr", "c", 3),
    (None, "null id here", "en", "c", 3),
    (12, "<|endoftext|> special", "en", "c", 4),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, fp0 int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, repeated, very long texts, and columns whose names the operators use inside."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("digest", "slice", "size", "rank", "score", "component", "_text", "_kept_id", "_mix_n", "row", "doc", "node", "kept"):
        df = df.withColumn(c, F.lit("own"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def components(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


# 1 SimHash


def plain_fingerprint(text, words=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    parts = [b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_simhash(which, request):
    df = request.getfixturevalue(which)
    rows = texts(df)
    fps = [plain_fingerprint(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    comp = components(len(rows), links)
    want = []
    for k, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[k] and rows[j][0] is not None]
        want.append((doc, f"{fps[k]:016x}", min(ids, default=None)))
    got = [tuple(r) for r in simhash.near_duplicates(df).collect()]
    assert collections.Counter(got) == collections.Counter(want)


def test_tree_join_finds_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = set(base.tolist())
    for b in base.tolist():
        for _ in range(30):
            for bit in rng.integers(0, 64, rng.integers(1, 13)).tolist():
                b ^= 1 << bit
            codes.add(b)
    fp = np.array(sorted(codes), np.uint64)
    for distance in (0, 1, 2, 5, 10):
        blocks, got = simhash.Blocks(distance), set()
        for p in range(len(blocks.passes)):
            code, width = blocks.code(fp, p)
            bucket = (code >> np.uint64(64 - width)).astype(np.int64)
            order = np.lexsort((simhash.gray_rank(code), bucket))
            for a, b in simhash.tree_join(bucket[order], code[order], width, distance):
                x, y = order[a], order[b]
                ok = blocks.first(fp[x] ^ fp[y], p)
                for i, j in zip(x[ok], y[ok]):
                    pair = (min(i, j), max(i, j))
                    assert pair not in got
                    got.add(pair)
        want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= distance}
        assert got == want


def jaccard_links(texts_, least=0.8):
    """Brute force: every pair that shares a shingle is compared."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in ((t or "").encode().lower().split() for t in texts_)]
    holders = collections.defaultdict(list)
    for d, x in enumerate(sets):
        for g in x:
            holders[g].append(d)
    common = collections.Counter((a, b) for ds in holders.values() for k, a in enumerate(ds) for b in ds[:k])
    return [(a, b) for (a, b), n in common.items() if n >= least * (len(sets[a]) + len(sets[b]) - n)]


def test_similar_groups(docs, odd, empty):
    rows = texts(docs)
    links = jaccard_links([t for _, t in rows])
    comp = components(len(rows), links)
    got = {r["doc_id"]: r for r in simhash.similar_groups(docs).collect()}
    assert {d: r["component_id"] for d, r in got.items()} == {d: rows[comp[k]][0] for k, (d, _) in enumerate(rows)}
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())
    for df in (odd, odd.where("doc_id is null or doc_id in (8, 5, 6)")):
        rows = simhash.similar_groups(df, carry=("slice",)).collect()
        assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(d for d, _ in texts(df)) and {r["slice"] for r in rows} == {"own"}
        group = collections.defaultdict(list)
        for r in rows:
            group[r["component_id"]].append(r["kept"])
        assert all(sum(k) == 1 for c, k in group.items() if c is not None)
    assert simhash.similar_groups(empty).count() == 0


def test_similar_groups_one_row_of_equal_ids_and_of_null_ids(spark):
    df = spark.createDataFrame([(1, BASE), (1, BASE), (None, LONG), (None, LONG), (None, BASE + " x")], "doc_id bigint, text string")
    rows = simhash.similar_groups(df).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in rows) == sorted([("1", "1", True), ("1", "1", False), ("None", "1", False), ("None", "None", True), ("None", "None", False)])


def test_similar_groups_recall_of_pairs_at_the_limit(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    rows = []
    for _ in range(150):
        n = int(rng.integers(60, 400))
        base = [word() for _ in range(n)]
        cut = set(rng.choice(n // 10, max(1, n // 46), replace=False).tolist())
        rows += [" ".join(base), " ".join(word() if p % 10 == 0 and p // 10 in cut else w for p, w in enumerate(base))]
    links = jaccard_links(rows)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")).collect()}
    assert len(links) >= 60 and sum(got[a] == got[b] for a, b in links) >= 0.9 * len(links)
    assert sum(d != c for d, c in got.items()) <= len(links)


def test_similar_groups_do_not_depend_on_the_number_of_rows(spark, monkeypatch):
    """Pairs at the limit have the same groups in a table that says it has a hundred million rows."""
    rng = np.random.default_rng(10)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    rows = []
    for _ in range(150):
        base = [word() for _ in range(int(rng.integers(60, 400)))]
        cut = set(rng.choice(len(base) // 10, max(1, len(base) // 46), replace=False).tolist())
        rows += [" ".join(base), " ".join(word() if p % 10 == 0 and p // 10 in cut else w for p, w in enumerate(base))]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    groups = lambda: {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df).collect()}
    want = groups()
    monkeypatch.setattr(type(df), "count", lambda self: 100_000_000)
    assert groups() == want


def test_close_pairs_match_definition(monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 16)
    monkeypatch.setattr(simhash, "TILE", 40)
    rng = np.random.default_rng(15)
    key = np.repeat(np.arange(6), [1, 16, 90, 17, 0, 7])
    fp = rng.integers(0, 1 << 20, len(key), dtype=np.uint64)
    got = [(int(max(i, j)), int(min(i, j))) for a, b in simhash.close_pairs(key, fp, 7) for i, j in zip(a, b, strict=True)]
    want = {(i, j) for i in range(len(key)) for j in range(i) if key[i] == key[j] and (int(fp[i]) ^ int(fp[j])).bit_count() <= 7}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_similar_groups_check_what_thinning_left_out(spark, monkeypatch):
    rng = np.random.default_rng(4)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    base = [word() for _ in range(300)]
    # variants of one template, near the base but not near each other; the forests are made to keep bad links
    texts_ = [" ".join(base)] + [" ".join(word() if p in set(range(20 * k % 280 + 5, 300, 50)) else w for p, w in enumerate(base)) for k in range(12)]
    df = spark.createDataFrame(list(enumerate(texts_)), "doc_id bigint, text string")
    comp = components(13, jaccard_links(texts_))
    right = simhash.nearest_forest
    monkeypatch.setattr(simhash, "nearest_forest", lambda a, b, d: right(a, b, -d))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df, near=24, wide=80).collect()}
    assert got == {k: comp[k] for k in range(13)}


def test_crowded_buckets_stay_connected(monkeypatch):
    monkeypatch.setattr(simhash, "BIG", 40)
    rng = np.random.default_rng(12)
    fp = []
    for size in (300, 30, 90):  # families around one fingerprint each
        centre = int(rng.integers(0, 1 << 63))
        for _ in range(size):
            x = centre
            for bit in rng.integers(0, 64, int(rng.integers(0, 11))).tolist():
                x ^= 1 << bit
            fp.append(x)
    fp = np.unique(np.array(fp, np.uint64))
    fp = fp[np.argsort(simhash.gray_rank(fp), kind="stable")]
    key = np.zeros(len(fp), np.uint32)
    found, left = simhash.crowded(key, fp, 17)
    some = np.flatnonzero(left)
    links = [(int(a), int(b)) for x, y in [*found, *((some[i], some[j]) for i, j in simhash.tree_join(key[some], fp[some], 0, 17))] for a, b in zip(x, y, strict=True)]
    assert all(int(fp[a] ^ fp[b]).bit_count() <= 17 for a, b in links)
    want = [(a, b) for a in range(len(fp)) for b in range(a) if int(fp[a] ^ fp[b]).bit_count() <= 17]
    assert components(len(fp), links) == components(len(fp), want)


# 2 quality


def test_quality(spark, docs, odd, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels, "doc_id", "text", "quality")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    lab = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert sum((got[d] >= 0.3) == bool(q) for d, q in lab.items()) >= 0.95 * len(lab)
    odds = quality.score(odd, model).collect()
    assert len(odds) == len(ROWS) and all(0 <= r["score"] <= 1 for r in odds)
    assert quality.score(empty, model).count() == 0
    both = labels.unionByName(labels.where("doc_id % 3 = 0").withColumn("quality", 1 - F.col("quality")))
    one = quality.fit(docs, labels.where("doc_id % 3 <> 0"), "doc_id", "text", "quality")
    two = quality.fit(docs, both.repartition(3), "doc_id", "text", "quality")
    assert (one[0] == two[0]).all() and one[1] == two[1]
    none = quality.fit(docs, labels.where("false"), "doc_id", "text", "quality")
    assert {r["score"] for r in quality.score(odd, none).collect()} == {0.5}


def test_quality_features_match_the_definition():
    """Buckets of words, word pairs and n-grams, hashed one by one."""
    text = "Ab cé cé  dog"
    m, mod = quality.MULT, 1 << 64
    poly = lambda b: sum(x * pow(m, k, mod) for k, x in enumerate(b)) % mod
    number = lambda h, salt: int(quality.bucket(np.array([h], np.uint64), salt)[0])
    words = text.encode().split()
    want = collections.Counter(number(poly(w), 1) for w in words)
    want.update(number((poly(a) * m + poly(b)) % mod, 2) for a, b in zip(words, words[1:]))
    padded = " " + text + " "
    for n in quality.GRAMS:
        for k in range(len(padded) - n + 1):
            gram = padded[k : k + n]
            if " " not in gram[1:-1]:
                want[number(poly(gram.encode()), n)] += 1
    (b, w), = quality.bags([text.encode()])
    got = dict(zip(b.tolist(), w.tolist(), strict=True))
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(c / sum(want.values()), rel=1e-5) for k, c in want.items())


def test_quality_features_match_plain_averages():
    parts = [b"a bb ccc", b"", b"x x", "ü".encode() * 3]
    table = np.random.default_rng(1).normal(size=1 << quality.BITS)
    for text in parts:
        one = quality.bags([text])[0]
        both = quality.bags([b"zz", text, b"q"])[1]
        assert (one[0] == both[0]).all() and np.allclose(one[1], both[1])
    long = b"word " * 300_000
    (b, w), = quality.bags([long])
    assert abs(w.sum() - 1) < 1e-4 and len(b) < 60 and np.isfinite(table[b] @ w)


def test_quality_held_out(spark):
    df = queries.op2_quality(spark, "/root/testdata/sf0.01")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = df.join(lab, "doc_id").where("held_out and quality is not null").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.9 * len(rows)


# 3 embeddings


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = [(k, (base[k % 60] + 0.12 * rng.normal(size=16) * (k >= 60)).tolist()) for k in range(260)]
    rows += [(1000 + k, base[0].tolist()) for k in range(700)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, [float("inf")] + [1.0] * 15), (2006, [1.0, 2.0]), (2007, [2.0, 4.0])]
    rows += [(None, base[1].tolist()), (None, [0.0] * 15 + [3.0]), (None, [0.0] * 15 + [3.0]), (None, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("rep", F.lit(1))
    ok = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, n = [], collections.Counter()
    for dim in (2, 16):
        idx = [k for k in ok if len(rows[k][1]) == dim]
        x = np.array([rows[k][1] for k in idx])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.9, 1)), strict=True):
            links.append((idx[a], idx[b]))
            n[idx[a]] += 1
            n[idx[b]] += 1
    comp = components(len(rows), links)
    low = [min((rows[j][0] for j in range(len(rows)) if comp[j] == comp[k] and rows[j][0] is not None), default=None) for k in range(len(rows))]
    want = collections.Counter((rows[k][0], n[k], low[k], rows[k][0] == low[k]) for k in range(len(rows)))
    assert collections.Counter(tuple(r) for r in vectors.near_duplicates(df).collect()) == want
    assert vectors.near_duplicates(df.where("false")).count() == 0


def test_vectors_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = df.orderBy("vec_id").toPandas()
    x = np.stack(pdf["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = int((np.triu(x @ x.T >= 0.9, 1)).sum())
    assert sum(r["n_links"] for r in vectors.near_duplicates(df).collect()) >= 0.9 * 2 * want


def test_vectors_miss_no_pair_of_a_loose_group(spark):
    # 20,000 vectors, a third of them in one group of mutual cosine 0.8 with pairs of cosine 0.93 inside it
    rng = np.random.default_rng(17)
    unit = lambda a: a / np.linalg.norm(a, axis=-1, keepdims=True)
    x = unit(rng.normal(size=(20_000, 64)))
    x[:6_600] = unit(np.sqrt(0.8) * x[-1] + np.sqrt(0.2) * x[:6_600])
    x[:600:2] = unit(x[1:600:2] + 0.39 * unit(rng.normal(size=(300, 64))))
    n = np.zeros(len(x), int)
    for at in range(0, len(x), 2000):
        n[at : at + 2000] = (x[at : at + 2000] @ x.T >= 0.9).sum(1) - 1
    got = vectors.near_duplicates(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id bigint, embedding array<double>")).collect()
    assert n.sum() >= 500 and {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(n.tolist()))


# 4 suffix arrays


def plain_removal(rows, length=100):
    seen, out = set(), []
    for _, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                gone[k : k + length] = True
            seen.add(s)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.append(False, gone).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_suffix(which, request, monkeypatch):
    df = request.getfixturevalue(which)
    rows = sorted(texts(df), key=lambda r: (r[0] is None, r[0] or 0))
    want = [(r[0], *x) for r, x in zip(rows, plain_removal(rows), strict=True)]
    got = [tuple(r) for r in suffix.remove_repeats(df).collect()]
    assert collections.Counter(got) == collections.Counter(want)


def test_suffix_family_over_many_batches():
    rng = np.random.default_rng(9)
    pool = [rng.integers(97, 101, 260, dtype=np.uint8) for _ in range(12)]
    stretches, doc = [], 0
    for _ in range(60):
        stretches.append((doc, np.concatenate([pool[rng.integers(12)][rng.integers(0, 50) :], pool[rng.integers(12)]])))
        doc += 1
    order = rng.permutation(60)
    family = suffix.Family(100)
    for at in range(0, 60, 7):
        some = sorted((stretches[k] for k in order[at : at + 7]), key=lambda x: x[0])
        d = np.array([x[0] for x in some])
        family.add(np.concatenate([x[1] for x in some]), np.cumsum([len(x[1]) for x in some]), d, np.zeros_like(d), np.zeros_like(d))
    got = {(int(a), int(s)) for d, _, st in family.later for a, s in zip(d, st, strict=True)}
    seen, want = set(), set()
    for d, t in stretches:
        b = t.tobytes()
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                want.add((d, k))
            seen.add(b[k : k + 100])
    assert got == want
    assert all((v.text[1:] > v.text[:-1]).all() for v in family.levels)
    sizes = [len(v.text) for v in family.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def test_suffix_over_several_batches(spark, docs, monkeypatch):
    """Small batches and few buckets: every bucket grows several levels, and they merge."""
    seen = []

    class Seen(suffix.Family):
        def add(self, *a):
            super().add(*a)
            seen.append(len(self.levels))

    monkeypatch.setattr(suffix, "BATCH", 3_000)
    monkeypatch.setattr(suffix, "SLICE", 20_000)
    some = docs.where("length(text) < 4000").coalesce(3)
    rows = sorted(texts(some))
    want = [(r[0], *x) for r, x in zip(rows, plain_removal(rows), strict=True)]
    assert collections.Counter(tuple(r) for r in suffix.remove_repeats(some).collect()) == collections.Counter(want)
    # the same batches by hand, to see that levels do pile up and merge
    family = Seen(100)
    for k, (d, t) in enumerate(rows):
        b = np.frombuffer((t or "").encode(), np.uint8)
        if len(b) >= 100:
            family.add(b, np.array([len(b)]), np.array([d]), np.array([k]), np.array([0]))
    assert max(seen) >= 3 and len(seen) > 3 * max(seen)


def test_suffix_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_SLICES", 3)
    passage = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(400))
    rows = [(k, f"{k:05d}" * 8 + passage + f"{k * 7:06d}" * 9) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    want = [(r[0], *x) for r, x in zip(rows, plain_removal(rows), strict=True)]
    assert {tuple(r) for r in suffix.remove_repeats(df).collect()} == set(want)


def test_suffix_keeps_text_and_empty(odd, empty):
    for r in suffix.remove_repeats(odd, keep_text=True).collect():
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"]
    assert suffix.remove_repeats(empty).count() == 0


# 5 mixing


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_mixing(which, request):
    df = request.getfixturevalue(which)
    got = mixing.mix(df).collect()
    size = collections.Counter((r["doc_id"], len((r["text"] or "").encode().split())) for r in df.collect())
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == size
    by = collections.defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    total = sum(r["size"] for r in got)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, share, free = 1.5 * total, {}, set(names)
    while True:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * by[s][0]["source_size"]]
        if not over:
            break
        for s in over:
            share[s] = 2.0 * by[s][0]["source_size"]
        free -= set(over)
        left = 1.5 * total - sum(share.values())
    share |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    for s in names:
        assert by[s][0]["source_size"] == sum(r["size"] for r in by[s])
        assert by[s][0]["target"] == pytest.approx(share[s], rel=1e-9)
        taken, target = sum(r["taken"] for r in by[s]), by[s][0]["target"]
        assert abs(taken - target) <= 1 + mixing.LEEWAY * (target + 256) and taken <= 2 * by[s][0]["source_size"]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df).collect()))


def test_mixing_follows_the_draw(spark):
    """Each source's slots are what the multinomial draw gave it, within the leeway; another seed draws other counts."""
    words = " w" * 4000
    df = spark.createDataFrame([(k, words, f"s{k % 5}") for k in range(400)], "doc_id bigint, text string, source string")
    got = {}
    for seed in (1, 2):
        docs = df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
        plan = mixing.planned(docs, (5, 2, 1), 1.5, 2.0, 128, seed)
        runs = mixing.draws(plan, seed).collect()
        want = {r["no"]: r for r in plan.collect()}
        total = sum(r["slots"] for r in want.values())
        drawn = collections.Counter(r["no"] for r in runs for _ in range(r["start"], r["stop"]))
        assert {(r["no"], i) for r in runs for i in range(r["start"], r["stop"])} == {(k, i) for k, n in drawn.items() for i in range(n)}
        shards = -(-total // max(1024, math.isqrt(total)))  # the number of the shard that settles
        raw_ = collections.Counter({k: sum(r["stop"] - r["start"] for r in runs if r["no"] == k and r["shard"] < shards) for k in want})
        for k, r in want.items():
            assert abs(drawn[k] - r["slots"]) <= mixing.LEEWAY * r["slots"] and drawn[k] <= 2 * r["n"]
            if abs(raw_[k] - r["slots"]) <= mixing.LEEWAY * r["slots"] and raw_[k] < 2 * r["n"]:
                assert drawn[k] == raw_[k]
        chance = [abs(drawn[k] - r["slots"]) / math.sqrt(r["slots"] * (1 - r["slots"] / total)) for k, r in want.items()]
        assert 0 < max(chance) < 5
        taken = collections.Counter()
        for r in mixing.mix(df, seed=seed).collect():
            taken[r["source"]] += r["taken"]
        for k, r in want.items():
            assert drawn[k] == r["slots"] or abs(taken[r["source"]] - 128 * drawn[k]) <= 2 * 128
        got[seed] = dict(drawn)
    assert got[1] != got[2]


def test_mixing_empty(empty):
    assert mixing.mix(empty).count() == 0


def test_mix_does_not_broadcast_blocks(spark):
    """Blocks grow with the corpus, though their plan looks as small as the draws it starts from."""
    df = spark.range(50).selectExpr("id as doc_id", "repeat('w ', 400) as text", "if(id % 2 = 0, 'a', 'b') as source")
    mixed = mixing.mix(df)
    joins = [line for line in mixed._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "LeftOuter" in line and "block#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        df = spark.range(n).withColumn("n", F.lit(n).cast("bigint")).withColumn("k", F.lit(3))
        there = mixing.permuted(df, "id", "n", ["k"], "to", 5)
        back = mixing.permuted(there, "to", "n", ["k"], "from", 5, back=True).collect()
        assert sorted(r["to"] for r in back) == list(range(n)) and all(r["from"] == r["id"] for r in back)


# 6 language


def test_langid(spark, odd, empty):
    df = queries.op6_langid(spark, "/root/testdata/sf0.01")
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = [r for r in df.collect() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.95 * len(rows)
    got = langid.identify(odd, odd).collect()
    assert len(got) == len(ROWS)
    assert {r["lang_pred"] for r in got if not (r["text"] or "").strip()} == {"und"}
    assert all(r["score"] == 0 and not r["accepted"] for r in got if r["lang_pred"] == "und")
    assert langid.identify(empty, odd).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, empty).collect()} == {"und"}


def test_langid_learns_from_long_texts(spark):
    """A language whose documents are all longer than a dictionary is still learnt."""
    rng = np.random.default_rng(1)
    kinds = {"aa": "kalo mire tuna sebo rani".split(), "bb": "øxty grønf jælp vømt".split()}
    text = lambda lang, n: " ".join(kinds[lang][i] + kinds[lang][j] for i, j in zip(rng.integers(0, 4, n), rng.integers(0, 4, n)))
    rows = [(k, text("aa", 20_000), "aa") for k in range(3)] + [(10 + k, text("bb", 60), "bb") for k in range(20)]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = langid.dictionaries(train, "doc_id", "text", "lang")
    assert set(found) == {"aa", "bb"} and 30_000 < len(found["aa"]) <= langid.DICT_BYTES
    ask = spark.createDataFrame([(1, text("aa", 40)), (2, text("bb", 40))], "doc_id bigint, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(ask, train).collect()} == {1: "aa", 2: "bb"}


# 7 lattice


def test_lattice(odd, empty, docs):
    for df in (odd, docs):
        rows = texts(df)
        words = [[*(t or "").encode().lower().split(), None] for _, t in rows]
        held = [zlib.crc32(str(d).encode()) % 7 == 2 if d is not None else False for d, _ in rows]
        count = collections.Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
        n, v = sum(count.values()), len(count)
        want = sorted((str(d), h, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for (d, _), h, ws in zip(rows, held, words, strict=True))
        got = lattice.score(df).collect()
        assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lattice.score(empty).count() == 0


def brute_lattice(word, pieces, single):
    """Sum over all segmentations, written out."""
    if not word:
        return 1.0
    out = math.exp(sum(single[b] for b in word[0].encode())) * brute_lattice(word[1:], pieces, single)
    return out + sum(math.exp(pieces[word[:k]]) * brute_lattice(word[k:], pieces, single) for k in range(1, len(word) + 1) if word[:k] in pieces)


def test_lattice_sums_all_segmentations():
    lat = lattice.Lattice(lattice.default_vocabulary())
    pieces, single = lattice.vocabulary(lattice.default_vocabulary())
    assert sum(map(math.exp, [*pieces.values(), *single.values()])) + lattice.END_SHARE == pytest.approx(1)
    for w in ("the", "houses", "ñandú", "東京", "qzx"):
        assert lat.word(w) == pytest.approx(math.log(brute_lattice(lattice.MARK + w, pieces, single)), rel=1e-9)
    assert math.isfinite(lat.word("x" * 3000))


def test_lattice_scores_whole_texts(spark):
    """The score of a text is the interpolation of corpus counts and all its words' segmentations, and of its end."""
    pieces, single = lattice.vocabulary(lattice.default_vocabulary())
    rows = [(k, t) for k, t in enumerate(["the cat sat", "the the dog", None, "unseen wörd the", "Cat DOG  sat", "", "zq the"])]
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    rows += [(next(d for d in range(100, 200) if zlib.crc32(str(d).encode()) % 7 == 2), "the other zebra")]
    held |= {rows[-1][0]: True}
    words = {d: (t or "").lower().split() for d, t in rows}
    for train in (True, False):
        got = lattice.score(spark.createDataFrame(rows if train else rows[-1:], "doc_id bigint, text string")).collect()
        count = collections.Counter(w for d, ws in words.items() if train and not held[d] for w in ws)
        ends = sum(not held[d] for d, _ in rows) if train else 0
        n, v = sum(count.values()) + ends, len(count) + (ends > 0)
        share = lambda c, p: (c + v * p) / (n + v) if n else p
        for r in got:
            want = sum(math.log10(share(count[w], brute_lattice(lattice.MARK + w, pieces, single))) for w in words[r["doc_id"]])
            assert r["score"] == pytest.approx(want + math.log10(share(ends, lattice.END_SHARE)), rel=1e-9)


# 8 exact


@pytest.mark.parametrize("counters", [2, 1024])
@pytest.mark.parametrize("which", ["odd", "docs"])
def test_exact(which, counters, request):
    df = request.getfixturevalue(which)
    rows = [(d, bytes((t or "").encode()).lower()) for d, t in texts(df)]
    group = collections.defaultdict(list)
    for d, t in rows:
        group[t].append(d)
    top = {t: max((d for d in ds if d is not None), default=None) for t, ds in group.items()}
    want = [(d, top[t], len(group[t]), hashlib.sha256(t).hexdigest()) for d, t in rows]
    got = exact.dedup(df, counters=counters).collect()
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == collections.Counter(want)
    # one row of each group, and its id is the group's largest; a null one only where there is no other
    assert collections.Counter(r["text_sha256"] for r in got if r["kept"]) == {hashlib.sha256(t).hexdigest(): 1 for t in group}
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_keeps_one_of_equal_and_of_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "A"), (None, "b"), (None, "B"), (None, "a")], "doc_id bigint, text string").withColumn("row", F.lit(7))
    for counters in (1, 1024):
        got = exact.dedup(df, counters=counters, carry=("row",)).collect()
        assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["kept"], r["row"]) for r in got) == sorted([("1", "1", True, 7), ("1", "1", False, 7), ("None", "None", True, 7), ("None", "None", False, 7), ("None", "1", False, 7)])


def test_misra_gries_keeps_heavy():
    rng = np.random.default_rng(2)
    stream = [0] * 400 + [1] * 250 + list(range(10, 700))
    rng.shuffle(stream)
    held = {}
    for x in stream:
        held[x] = held.get(x, 0) + 1
        held = exact.summarise(held, 6)
    assert {0, 1} <= set(held) and len(held) <= 6


def test_exact_empty(empty):
    assert exact.dedup(empty).count() == 0


# 9 packing


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_packing(which, request):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for d, t in texts(df):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, n in enumerate([len(ids) % 2048] * (len(ids) % 2048 > 0) + [2048] * (len(ids) // 2048)):
            want.append((d, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at += n
    got = packing.pack(df).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == collections.Counter(want)
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 2048
    assert len(by) <= math.ceil(sum(r["length"] for r in got) / 2048) * 1.02 + 1


def test_packing_cuts_long_text_only_at_tokens(monkeypatch, empty):
    tok = packing.default_tokenizer()
    text = LONG + " x" * 50 + "\n\n  y " + "é ü" * 100
    whole = packing.encode(text, tok)
    monkeypatch.setattr(packing, "LONG", 1000)
    assert (packing.encode(text, tok) == whole).all()
    assert packing.pack(empty).count() == 0


def plain_best_fit(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        k = min((k for k, g in enumerate(gaps) if g >= x), key=lambda k: gaps[k], default=None)
        if k is None:
            gaps.append(capacity - x)
        else:
            gaps[k] -= x
    return len(gaps)


def test_sweep_matches_plain_best_fit():
    rng = np.random.default_rng(4)
    lengths = sorted(rng.integers(1, 65, 500).tolist(), reverse=True)
    gap, offset, rooms = packing.sweep(lengths, [], True, 64)
    assert len(rooms) == plain_best_fit(lengths, 64)
    gap, offset, rooms = packing.sweep([40, 30, 30, 9], [10, 35, 64], False, 64)
    assert gap == [2, 1, -1, 0] and offset == [0, 29, 0, 54] and rooms == [1, 5, 24]


@pytest.mark.parametrize("kind", ["mixed", "short", "one", "thirds", "long"])
def test_packing_rounds(spark, kind):
    rng = np.random.default_rng(3)
    lengths = {
        "mixed": rng.integers(1, 257, 3000), "short": np.minimum(256, rng.geometric(0.05, 4000)), "one": np.ones(3000, int),
        "thirds": np.where(rng.random(2000) < 0.34, 90, rng.integers(1, 257, 2000)), "long": rng.integers(129, 257, 1000),
    }[kind]
    rows = list(enumerate(lengths.tolist()))
    cut = spark.createDataFrame(rows, "no bigint, length bigint")
    got = {r["no"]: (r["sequence_id"], r["offset"]) for r in packing.best_fit(cut, 256, 300).collect()}
    assert set(got) == set(dict(rows))
    by = collections.defaultdict(list)
    for k, n in rows:
        by[got[k][0]].append((got[k][1], n))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 256
    assert len(by) <= 1.01 * plain_best_fit(lengths.tolist(), 256) + 1
    assert got == {r["no"]: (r["sequence_id"], r["offset"]) for r in packing.best_fit(cut.repartition(5), 256, 300).collect()}


def test_packing_ids_match_the_json_tokenizer_on_a_larger_table(spark):
    """Every id of every text of sf0.1, through the crc32 of its pieces."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    want = collections.Counter()
    rows = texts(df)
    for at in range(0, len(rows), 500):
        for (d, _), e in zip(rows[at : at + 500], tok.encode_batch([t or "" for _, t in rows[at : at + 500]], add_special_tokens=False), strict=True):
            ids = np.array([*e.ids, 0], "<u4")
            cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
            want.update((d, k, x, y - x, zlib.crc32(ids[x:y].tobytes())) for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)))
    got = packing.pieces(df, "doc_id", "text", 2048, packing.default_tokenizer()).drop("no").collect()
    assert collections.Counter(map(tuple, got)) == want


# 10 passages


def test_compact_windows_match_definition():
    rng = np.random.default_rng(6)
    h = rng.integers(0, 40, 60, dtype=np.uint64)
    ends = np.array([25, 25, 60])
    c = passages.minima(h, passages.valid_starts(ends, 7), 7)
    lo, hi = passages.compact_windows(h, ends, c)
    got = set(zip(c.tolist(), lo.tolist(), hi.tolist(), strict=True))
    want = {}
    for a, b in ((0, 25), (25, 60)):
        for i in range(a, b):
            for j in range(i + 6, b):
                k = i + int(np.argmin(h[i : j + 1]))
                x, y = want.get(k, (i, j))
                want[k] = (min(x, i), max(y, j))
    assert got == {(k, x, y) for k, (x, y) in want.items()}


def test_passages(spark, odd, empty):
    rng = np.random.default_rng(8)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    passage = [word() for _ in range(60)]
    edited = [*passage[:30], word(), *passage[31:]]
    rows = []
    for k in range(30):
        own = [word() for _ in range(120)]
        cut = int(rng.integers(10, 110))
        middle = passage if k in (3, 9, 20) else edited if k == 25 else []
        rows.append((k, " ".join(own[:cut] + middle + own[cut:])))
    rows += [(40, rows[5][1]), (41, rows[5][1]), (50, None), (51, "short")]
    got = passages.near_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r["doc_id"], r["ref_doc_id"]) for r in got} >= {(9, 3), (20, 3), (25, 3), (40, 5), (41, 5)}
    assert {r["doc_id"] for r in got} == {9, 20, 25, 40, 41}
    for r in got:
        assert r["end_word"] - r["start_word"] >= 50 and r["similarity"] >= 0.8
        if r["doc_id"] in (9, 20):
            a = dict(rows)[r["doc_id"]].split()[r["start_word"] : r["end_word"]]
            assert set(passage) <= set(a)
    assert passages.near_passages(odd).count() >= 2
    assert passages.near_passages(empty).count() == 0


def test_passages_of_the_least_length_are_all_found(spark):
    """Fifty words and no more: each of their shingles counts."""
    rng = np.random.default_rng(50)
    word = lambda n: ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n)]
    rows = []
    for k in range(200):
        passage = word(50)
        rows += [(2 * k, " ".join(word(30) + passage + word(30))), (2 * k + 1, " ".join(word(70) + passage + word(10)))]
    got = passages.near_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert {(r["doc_id"], r["ref_doc_id"]) for r in got} == {(2 * k + 1, 2 * k) for k in range(200)}
    assert all((r["start_word"], r["end_word"], r["ref_start"], r["ref_end"]) == (70, 120, 30, 80) for r in got)


def test_passages_reach_brute_force(spark, docs):
    rows = texts(docs)
    grams = collections.defaultdict(set)
    for d, t in rows:
        w = t.lower().split()
        for k in range(len(w) - 54):
            grams[" ".join(w[k : k + 55])].add(d)
    want = {d for ds in grams.values() if len(ds) > 1 for d in ds}
    got = {x for r in passages.near_passages(docs).collect() for x in (r["doc_id"], r["ref_doc_id"])}
    assert want <= got


def test_best_stretch_joins_over_an_insertion_and_cuts_loose_text():
    rng = np.random.default_rng(21)
    new = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    # 80 words, 9 more put into the middle: 13 foreign shingles between two runs of 36
    ref = new(76)
    doc = np.concatenate([ref[:36], new(13), ref[40:]])
    (s, e, _, _, j), *_ = passages.verified(doc, ref, 46, 0.8)
    assert (s, e) == (0, len(doc)) and j >= 0.8
    # 60 words with one of them changed, next to text that shares a shingle in every twelve
    core = new(56)
    loose = new(240)
    other = np.where(np.arange(240) % 12 == 0, loose, new(240))
    got = passages.verified(np.concatenate([core[:25], new(5), core[30:], other]), np.concatenate([core, loose]), 46, 0.8)
    assert any(s == 0 and 56 <= e < 80 and j >= 0.8 for s, e, _, _, j in got)


def test_equal_surroundings_are_settled_with_the_first():
    # rows 1 and 4 have equal surroundings; the last row has another signature
    rows = [(7, d, k) for d, k in ((1, 10), (2, 11), (3, 12), (4, 10), (5, 13))] + [(8, 1, 10)]
    t = np.zeros((passages.FIELDS, len(rows)), np.int64)
    for k, (sig, doc, key) in enumerate(rows):
        for f, x in ((passages.SIG, sig), (passages.ID, doc), (passages.DOC, doc), (passages.UID, doc), (passages.KEY, key)):
            t[f, k] = x
    t, to, lead = passages.settled(t)
    assert [(int(t[passages.ID][k]), int(t[passages.ID][to[k]])) for k in np.flatnonzero(~lead)] == [(4, 1)]
    some = t[:, lead]
    got = {(int(some[passages.ID][x]), int(some[passages.ID][y])) for i, j in passages.all_pairs(some[passages.SIG]) for x, y in zip(i, j, strict=True)}
    assert got == {(2, 1), (3, 1), (3, 2), (5, 1), (5, 2), (5, 3)}


@pytest.mark.parametrize("holders,rare", [(0, 32), (6, 32), (20, 32), (80, 32), (80, 4)])
def test_passages_among_documents_that_hold_parts(spark, monkeypatch, holders, rare):
    monkeypatch.setattr(passages, "RARE", rare)
    rng = np.random.default_rng(holders)
    word = lambda n: ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n)]
    rows, want = [], set()
    for k in range(10):
        passage = word(60)
        parts = [(1000 * k + n, word(40) + passage[n % 30 : n % 30 + 30] + word(40)) for n in range(holders)]
        whole = [(1000 * k + 300, word(30) + passage + word(50)), (1000 * k + 600, word(50) + passage + word(20))]
        late = [(d + 800, w) for d, w in parts[: holders // 2]]
        rows += [(d, " ".join(w)) for d, w in parts[holders // 2 :] + whole + late]
        want.add((1000 * k + 600, 1000 * k + 300))
    got = passages.near_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {(r["doc_id"], r["ref_doc_id"]) for r in got} == want
    assert all(r["end_word"] - r["start_word"] >= 60 for r in got)


def test_passages_recall_of_near_pairs(spark):
    """Planted passages with edits, against the similarity of the stretches as planted; classes count, not single pairs."""
    rng = np.random.default_rng(77)
    word = lambda n: ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n)]
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    rows, pairs = [], []
    for k in range(120):
        base = word(int(rng.integers(60, 200)))
        two = [word(1)[0] if rng.random() < 0.018 else w for w in base]
        one, other = grams(base), grams(two)
        rows += [(2 * k, " ".join(word(30) + base + word(30))), (2 * k + 1, " ".join(word(20) + two + word(60)))]
        if len(one & other) >= 0.8 * len(one | other):
            pairs.append((2 * k + 1, 2 * k))
    got = {(r["doc_id"], r["ref_doc_id"]) for r in passages.near_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert len(pairs) >= 60 and len(got & set(pairs)) >= 0.95 * len(pairs)


def test_passages_of_templates(spark):
    """Pairs in text made of a few sentences in a few versions: signatures are frequent, and the changed word may be any."""
    rng = np.random.default_rng(31)
    word = lambda n: ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n)]
    versions = [[word(10) for _ in range(3)] for _ in range(6)]
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    rows, held = [], []
    for k in range(300):
        base = [w for v in versions for w in v[int(rng.integers(0, 3))]]
        for n in range(2):
            at = int(rng.integers(0, 60))
            two = base if n == 0 else [*base[:at], *word(1), *base[at + 1 :]]
            rows.append((2 * k + n, " ".join(word(20) + two + word(20))))
            held.append(grams(two))
    near = [(k, j) for k in range(600) for j in range(k) if len(held[k] & held[j]) >= 0.8 * len(held[k] | held[j])]
    found = passages.near_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    want, got = components(600, near), components(600, [(r["doc_id"], r["ref_doc_id"]) for r in found])
    # classes count: each pair that is near by definition is in one class
    apart = sum(got[a] != got[b] for a, b in near)
    assert len(set(want)) < 600 and apart <= 0.02 * len(near)
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(300)) >= 0.95 * sum((2 * k + 1, 2 * k) in set(near) for k in range(300))


def test_passages_twice_in_one_document(spark):
    """Both places of a passage are reported, though one leads the other and they do not match each other."""
    rng = np.random.default_rng(3)
    word = lambda n: ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n)]
    rows, want = [], set()
    for k in range(20):
        p = word(60)
        once, twice = (2 * k, 2 * k + 1) if k % 4 < 2 else (2 * k + 1, 2 * k)
        rows += [(twice, " ".join(word(40) + p + word(80) + p + word(40))), (once, " ".join(word(30) + (p[:20] + word(1) + p[21:] if k % 2 else p) + word(50)))]
        want |= {(twice, 0), (twice, 1)}
    got = passages.near_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    held = {(d, at > 110) for r in got for d, at in ((r["doc_id"], r["start_word"]), (r["ref_doc_id"], r["ref_start"]))}
    assert want <= held


def test_passages_beside_one_that_all_hold(spark, monkeypatch):
    """A match elsewhere in two regions does not stand for the passage of a signature."""
    monkeypatch.setattr(passages, "RARE", 2)
    rng = np.random.default_rng(5)
    word = lambda n: ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n)]
    versions, common = [[word(10) for _ in range(3)] for _ in range(6)], word(60)
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    rows, held = [], []
    for k in range(100):
        base = [w for v in versions for w in v[int(rng.integers(0, 3))]]
        for n in range(2):
            at = int(rng.integers(0, 60))
            two = base if n == 0 else [*base[:at], *word(1), *base[at + 1 :]]
            rows.append((2 * k + n, " ".join(common + word(5) + two + word(20))))
            held.append(grams(two))
    near = [(k, j) for k in range(200) for j in range(k) if len(held[k] & held[j]) >= 0.8 * len(held[k] | held[j])]
    found = passages.near_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    got = components(200, [(r["doc_id"], r["ref_doc_id"]) for r in found if min(r["end_word"], r["ref_end"]) >= 110])
    assert sum(got[a] != got[b] for a, b in near) <= 0.02 * len(near)


def test_passages_meet_beyond_first_and_previous(spark, monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    base = [word() for _ in range(98)]
    at = 5 + rng.permutation(88)
    # every variant has two edits of its own: near the base, too far from each other
    variants = {k: [word() if p == at[2 * k] or p == at[2 * k + 1] else w for p, w in enumerate(base)] for k in range(12)}
    rows = [(100 if k < 0 else k if k < 6 else 100 + k, " ".join(base if k < 0 else variants[k])) for k in range(-1, 12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    grams = {d: {tuple(t.split()[k : k + 5]) for k in range(94)} for d, t in rows}
    near = {d for d in grams for e in grams if e < d and len(grams[d] & grams[e]) >= 0.8 * len(grams[d] | grams[e])}
    assert {r["doc_id"] for r in passages.near_passages(df).where("end_word - start_word >= 80").collect()} >= near >= {106, 107, 108, 109, 110, 111}
    # the same class of documents where every signature counts as frequent
    want = {x for r in passages.near_passages(df).collect() for x in (r["doc_id"], r["ref_doc_id"])}
    monkeypatch.setattr(passages, "RARE", 2)
    got = passages.near_passages(df).collect()
    assert {x for r in got for x in (r["doc_id"], r["ref_doc_id"])} == want
    place = {d: k for k, d in enumerate(sorted(want))}
    assert len(set(components(len(place), [(place[r["doc_id"]], place[r["ref_doc_id"]]) for r in got]))) == 1
