"""Operators 11 to 13 against the libraries and the definitions, text by text."""

import collections
import hashlib
import itertools
import random
import zlib
from fractions import Fraction

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import alignment, bpe, periodic, queries

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{k % 977} and{k % 13}" for k in range(12_000))
ODD = [
    None, "", " ", "  \n\t ", "a", " a ", "One two", "One  two\tthree\n\nfour ", "it's O'Neil's 'sss' we'LL", "<|endoftext|> special <|ENDOFTEXT|>x<|startoftext|>",
    "ünïcödé ñandú 東京  x " * 8, "é ́x İstanbul ΣΑΣ K", "a b　c\x1cd\x85e", "▁x ▁", "<s> </s> <unk> <0x0A>", "😀 👩‍👩‍👧 x😀y", "\x00 \x01", "x" * 5000,
    "ab" * 3000, LONG, "one two", "one two", "no1 2nd 12345 ½ ² ٣", "the end.", "the end.", "!!! ... ?!'s", "ȟɏɐʰ ﬁ ﬀ", "w " * 50, "a b c " * 9 + "tail", "a a a a a",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k if k != 4 else None, t) for k, t in enumerate(ODD)] + [(9, "again"), (9, "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for c in ("slice", "bucket", "ids", "runs", "words", "pair", "n", "a", "of", "decoded"):
        df = df.withColumn(c, F.lit("own"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def same(got, want):
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, want))


# 11 BPE encoding and decoding


@pytest.mark.parametrize("which", ["odd", "docs"])
@pytest.mark.parametrize("slice_", [bpe.SLICE, 2_000])
def test_bpe(which, slice_, request, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", slice_)
    df = request.getfixturevalue(which)
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for doc, t in texts(df):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((doc, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    out = bpe.decode(bpe.encode(df))
    got = out.select("doc_id", F.size("ids"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256), F.sha2(F.col("decoded").cast("binary"), 256))
    same(got.collect(), want)


def test_bpe_query_is_the_operator(spark):
    rows = {r["doc_id"]: r for r in queries.op11_bpe(spark, SF).collect()}
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for doc, t in texts(spark.read.parquet(f"{SF}/documents.parquet")):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert tuple(rows[doc]) == (doc, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n'sdl<|>endoftext́İΣ ")), max_size=40))
def test_bpe_words_are_independent(text):
    tok = bpe.tokenizer(bpe.default_tokenizer())
    words = [w.decode() for w in text.encode().split()]
    assert tok.encode(text, add_special_tokens=False).ids == [k for w in words for k in tok.encode(w, add_special_tokens=False).ids]


def test_bpe_forgets_and_encodes_again(spark, docs, monkeypatch):
    want = {r["doc_id"]: r["ids"] for r in bpe.encode(docs).collect()}
    monkeypatch.setattr(bpe, "KNOWN", 10)
    monkeypatch.setattr(bpe, "SLICE", 50_000)
    assert {r["doc_id"]: r["ids"] for r in bpe.encode(docs).collect()} == want


def test_decode_skips_ids_the_vocabulary_lacks(spark):
    df = spark.createDataFrame([(1, [320, 99_999, -3, 49407]), (2, []), (3, None)], "doc_id int, ids array<int>")
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(df).collect()}
    assert got == {1: tok.decode([320, 49407], skip_special_tokens=False), 2: "", 3: None}
    with pytest.raises(ValueError):
        bpe.decode(df, tokenizer_path=P.path("byte_bpe_50k.json"))


def test_bpe_empty(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.decode(bpe.encode(none)).collect() == []


# 12 Cross-tokenizer alignment


def byte_of():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def plain_alignment(rows):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    back = byte_of()
    out, counts = [], collections.Counter()
    for _, t in rows:
        a = tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        x = [bytes(back[c] for c in tok.id_to_token(k)) for k in a]
        y = [bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if not t or b"".join(x) != (" " + t).encode() or b"".join(y) != (" " + t).encode():
            out.append(([], [], [], ""))
            continue
        ends_a, ends_b = list(itertools.accumulate(map(len, x))), list(itertools.accumulate(map(len, y)))
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            m, n = i, j
            while m < len(a) and ends_a[m] <= cut:
                m += 1
            while n < len(b) and ends_b[n] <= cut:
                n += 1
            groups.append((a[i:m], b[j:n]))
            i, j = m, n
        links = [(p, q) for g, h in groups for p in g for q in h]
        counts.update(set(links))
        out.append((a, b, links, (len(groups), sha(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)))))
    best = collections.defaultdict(int)
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    want = []
    for (doc, _), (a, b, links, shown) in zip(rows, out, strict=True):
        n_groups, text = shown or (0, "")
        want.append((doc, len(a), len(b), n_groups, len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), text))
    return want


@pytest.mark.parametrize("which", ["odd", "docs"])
@pytest.mark.parametrize("slice_,links", [(alignment.SLICE, alignment.LINKS), (3_000, 100)])
def test_alignment(which, slice_, links, request, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", slice_)
    monkeypatch.setattr(alignment, "LINKS", links)
    df = request.getfixturevalue(which)
    same(alignment.align(df).collect(), plain_alignment(texts(df)))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("  ab'\n▁é東")), min_size=1, max_size=40))
def test_alignment_of_parts_is_that_of_the_text(text):
    paths = alignment.default_tokenizers()
    parts = alignment.SPLIT.split(text)
    got, whole = alignment.aligned_parts(parts, paths), alignment.aligned_parts([text], paths)
    assert got["ok"].all() == whole["ok"][0]
    if whole["ok"][0]:
        assert ";".join(got["shown"]) == whole["shown"][0]
        assert got["pair"].tolist() == whole["pair"].tolist()
        assert all(got[c].sum() == whole[c][0] for c in ("n_a", "n_b", "groups", "links"))


def test_alignment_empty(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


# 13 Periodic run detection


def plain_runs(x, least=6, times=4):
    found = {}
    for q in range(1, len(x) // times + 1):
        i = 0
        while i + q < len(x):
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_op13(rows):
    for doc, t in rows:
        w = (t or "").encode().split()
        n, h = len(w), zlib.crc32(str(doc).encode())
        g = h // 10
        if doc is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        top = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
        drop = {i for s, e, q in runs for i in range(s + q, e)}
        four = (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2]) if top else (None,) * 4
        kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
        yield (doc, len(runs), *four, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("which", ["odd", "docs"])
@pytest.mark.parametrize("slice_", [periodic.SLICE, 1_000])
def test_periodic(which, slice_, request, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(periodic, "SLICE", slice_)
    df = request.getfixturevalue(which)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = list(plain_op13(texts(df)))
    assert any(r[1] for r in want)
    same(queries.op13_periodic(spark, str(tmp_path)).collect(), want)


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_all_runs_of_small_alphabets(data):
    rng = random.Random(data.draw(st.integers(0, 10**9)))
    x = []
    for _ in range(rng.randint(1, 6)):
        unit = [rng.randint(0, 2) for _ in range(rng.randint(1, 5))]
        x += (unit * 8)[: rng.randint(1, 8 * len(unit))]
    for least, times in ((6, 4), (4, 2), (3, 3), (12, 2)):
        assert periodic.find_runs(x, least, times) == plain_runs(x, least, times)


@pytest.mark.parametrize("least,times", [(6, 4), (4, 2), (12, 2), (9, 3)])
def test_stretches_lose_no_run(spark, least, times):
    rng = random.Random(least * times)
    rows = []
    for k in range(150):
        x = [rng.randint(0, 40) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            at, unit = rng.randint(0, len(x)), [rng.randint(0, 3) for _ in range(rng.randint(1, 7))]
            x[at:at] = (unit * 9)[: rng.randint(1, 9 * len(unit))]
        rows.append((k, " ".join(map(str, x))))
    got = periodic.periodic_runs(spark.createDataFrame(rows, "doc_id int, text string"), least=least, times=times)
    for r in got.collect():
        want = plain_runs(rows[r["doc_id"]][1].split(), least, times)
        assert [(x["start"], x["start"] + x["length"], x["period"]) for x in r["runs"]] == want


def test_periodic_long_and_empty(spark):
    text = " ".join(["x"] * 100_000 + [f"w{k % 5000}" for k in range(60_000)])
    r, = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert [tuple(x) for x in r["runs"]] == [(0, 100_000, 1), (100_000, 60_000, 5000)]
    assert r["collapsed"] == " ".join(["x", *(f"w{k}" for k in range(5000))])
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
