"""SimHash near-duplicates through a Gray-order hierarchical index.

A document's fingerprint has a bit set where more than half of the XXH64
values of its word shingles have it set. Two fingerprints within ``distance``
bits agree on at least two of ``distance + 2`` blocks of bits, so every pair of
blocks deals the distinct fingerprints to buckets. Inside a bucket the
fingerprints are sorted by Gray rank; runs that share a masked bit pattern
become nodes of a tree, and a walk over pairs of nodes adds up their
differences and drops whole groups as soon as the sum passes the limit.

Defined results: a null or wordless text has fingerprint zero and links like
any other; rows that repeat a document keep one row each; null ``doc_id`` rows
take part but never name a component; an empty table gives an empty result.
Columns other than the two that are read may have any name.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.common import all_pairs, raw, runs, slices, whole_groups
from folioscope.plans.graph import connected_components, forest
from folioscope.plans.staging import stage, unstage

PAIRS_AT_ONCE = 1_000_000
COUNT, BIG, TILE, SMALL = 3, 512, 4096, 256  # fingerprints of a document for Jaccard groups; rows of a crowded bucket; rows of a tile; rows of a key without tiles
BLOCK, TURNED = 16, 3  # bits of a block and how many of them are turned, whatever the number of rows
SEED = 42
MULT = np.uint64(0x9E3779B97F4A7C15)


def remixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another hash of the same shingles, by a mix that loses nothing; the first one is ``h`` itself."""
    if k:
        h = h * np.uint64(2 * k + 1) * MULT
        h = (h ^ (h >> np.uint64(32))) * MULT
        h ^= h >> np.uint64(29)
    return h


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; one of the empty string without words."""
    w = text.lower().split()
    parts = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in parts), np.uint64, max(1, len(w) - words + 1))


def votes(h: np.ndarray, count: int) -> np.ndarray:
    """How often each of 64 bits is set, under each of ``count`` hash functions; the first is ``h`` itself."""
    set_in = np.zeros((count, 64), np.int64)
    for at in range(0, len(h), 65536):
        some = h[at : at + 65536]
        for k in range(count):
            set_in[k] += np.unpackbits(remixed(some, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return set_in


def majority(set_in: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(set_in * 2 > n, axis=1, bitorder="little").view(np.int64).ravel()


def shingle_bits(text: bytes, words: int, count: int = 1) -> list[int]:
    """``count`` 64-bit fingerprints, the first on plain XXH64; ``text`` is UTF-8."""
    if not text.split():
        return [0] * count
    h = shingle_hashes(text, words)
    return majority(votes(h, count), len(h)).tolist()


def fingerprints(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``(doc_id, fp0)`` with signed 64-bit fingerprints."""

    def run(batches):
        for b in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_bits(t, words)[0] for t in raw(b.column(1))], pa.int64())], ["doc_id", "fp0"])

    got = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return got.mapInArrow(run, "doc_id bigint, fp0 bigint")


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Place of each code in the binary reflected Gray sequence."""
    r = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class Blocks:
    """Bit blocks of a 64-bit fingerprint and the codes that put two of them first."""

    def __init__(self, distance: int):
        n = max(4, distance + 2)  # two blocks then hold 32 bits at most
        edges = [round(64 * k / n) for k in range(n + 1)]
        self.parts = [(64 - b, b - a) for a, b in zip(edges, edges[1:], strict=False)]  # (shift, width), highest bits first
        self.passes = list(combinations(range(n), 2))

    def get(self, fp: np.ndarray, k: int) -> np.ndarray:
        shift, width = self.parts[k]
        return (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)

    def code(self, fp: np.ndarray, p: int) -> tuple[np.ndarray, int]:
        """The fingerprint with the two blocks of pass ``p`` moved to the front, and their width."""
        i, j = self.passes[p]
        order = [i, j, *(k for k in range(len(self.parts)) if k not in (i, j))]
        out = np.zeros_like(fp)
        for k in order:
            out = (out << np.uint64(self.parts[k][1])) | self.get(fp, k)
        return out, self.parts[i][1] + self.parts[j][1]

    def first(self, diff: np.ndarray, p: int) -> np.ndarray:
        """Whether pass ``p`` is the first one in which a pair with these differing bits meets."""
        i, j = self.passes[p]
        ok = np.ones(len(diff), bool)
        for k in range(j):
            if k != i:
                ok &= self.get(diff, k) != 0
        return ok


def tree_join(bucket: np.ndarray, code: np.ndarray, fixed: int, distance: int):
    """Yield index arrays (a, b) of pairs within ``distance``; input sorted by bucket and Gray rank, codes of a bucket distinct."""
    levels = [fixed, *range(fixed + 8, 64, 8), 64]
    starts, patterns = [], []
    before = 0
    for at in levels:
        key = code >> np.uint64(64 - at) if at else np.zeros_like(code)
        new = np.ones(len(code), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1])
        st = np.flatnonzero(new)
        starts.append(st)
        patterns.append(key[st] & np.uint64((1 << (at - before)) - 1))
        before = at
    children = [np.append(np.searchsorted(starts[k + 1], starts[k]), len(starts[k + 1])) for k in range(len(levels) - 1)]
    size = np.diff(np.append(starts[0], len(code)))
    roots = np.flatnonzero(size > 1)
    todo = [(0, roots, roots, np.zeros(len(roots), np.uint8))]
    while todo:
        level, a, b, acc = todo.pop()
        lo = children[level]
        na, nb = lo[a + 1] - lo[a], lo[b + 1] - lo[b]
        total = np.cumsum(na * nb)
        if len(a) > 1 and total[-1] > PAIRS_AT_ONCE:
            cut = min(max(1, int(np.searchsorted(total, total[-1] // 2))), len(a) - 1)
            todo += [(level, a[:cut], b[:cut], acc[:cut]), (level, a[cut:], b[cut:], acc[cut:])]
            continue
        if not len(a):
            continue
        pair = np.repeat(np.arange(len(a)), na * nb)
        off = np.arange(total[-1]) - np.repeat(total - na * nb, na * nb)
        x, y = lo[a][pair] + off // nb[pair], lo[b][pair] + off % nb[pair]
        pat = patterns[level + 1]
        got = acc[pair] + np.bitwise_count(pat[x] ^ pat[y])
        last = level + 2 == len(levels)
        keep = (got <= distance) & ((x < y) if last else (x <= y))
        x, y, got = x[keep], y[keep], got[keep]
        if last:
            if len(x):
                yield starts[-1][x], starts[-1][y]
        elif len(x):
            todo.append((level + 1, x, y, got))


def nearest_forest(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Indexes of a minimum spanning forest of the links, closest first."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.argsort(d, kind="stable")
    u, v = at[: len(a)][order], at[len(a) :][order]
    up = list(range(len(nodes)))

    def root(x):
        while (y := up[x]) != x:
            up[x] = up[y]
            x = y
        return x

    keep, done, size = [], 0, 10_000
    while done < len(order):
        # most links of a large group end within what is joined already
        lab = np.array(up)
        while not np.array_equal(nxt := lab[lab], lab):
            lab = nxt
        some = np.flatnonzero(lab[u[done : done + size]] != lab[v[done : done + size]]) + done
        for k, p, q in zip(some.tolist(), u[some].tolist(), v[some].tolist(), strict=True):
            x, y = root(p), root(q)
            if x != y:
                up[max(x, y)] = min(x, y)
                keep.append(k)
        done, size = done + size, 2 * size
    return order[np.array(keep, np.int64)]


def links(fps: DataFrame, distance: int) -> DataFrame:
    """Spanning links ``(a, b)`` among the distinct values of ``fp0`` that are within ``distance`` bits."""
    blocks = Blocks(distance)

    def deal(batches):
        for pdf in batches:
            fp = pdf["fp0"].to_numpy().view(np.uint64)
            for p in range(len(blocks.passes)):
                code, width = blocks.code(fp, p)
                bucket = (np.uint64(p) << np.uint64(40)) + (code >> np.uint64(64 - width))
                yield pd.DataFrame({"bucket": bucket.view(np.int64), "fp0": pdf["fp0"]})

    def run(batches):
        for rows in whole_groups(batches, ["bucket"], 200_000):
            b, fp = rows["bucket"].to_numpy(), rows["fp0"].to_numpy().view(np.uint64)
            u, v = np.empty(0, np.int64), np.empty(0, np.int64)
            for p in np.unique(b >> 40):
                at = np.flatnonzero(b >> 40 == p)
                code, width = blocks.code(fp[at], int(p))
                order = np.lexsort((gray_rank(code), b[at]))
                at, code = at[order], code[order]
                for x, y in tree_join(b[at], code, width, distance):
                    x, y = fp[at[x]], fp[at[y]]
                    keep = blocks.first(x ^ y, int(p))
                    u, v = forest(np.concatenate([u, x[keep].view(np.int64)]), np.concatenate([v, y[keep].view(np.int64)]))
            yield pd.DataFrame({"a": u, "b": v})

    dealt = fps.select("fp0").distinct().mapInPandas(deal, "bucket bigint, fp0 bigint")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(run, "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for every input row."""
    fps = stage(fingerprints(df, id_col, text_col, words), "simhash")
    comp = connected_components(links(fps, distance), "a", "b")
    low = fps.groupBy("fp0").agg(F.min("doc_id").alias("low"))
    low = low.join(comp, low["fp0"] == comp["node"], "left").select("fp0", "low", F.coalesce("component", "fp0").alias("root"))
    low = stage(low, "simhash-low")
    named = low.groupBy("root").agg(F.min("low").alias("component_id")).withColumnRenamed("root", "r")
    named = low.join(named, low["root"] == named["r"]).select(F.col("fp0").alias("f"), "component_id")
    out = fps.join(named, fps["fp0"] == named["f"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")


def close_pairs(key: np.ndarray, fp: np.ndarray, near: int):
    """Yield index arrays (i, j) of all rows of one key within ``near`` bits; equal keys are in a row, larger ones go tile against tile."""
    cut = runs(key)
    size = np.diff(cut)
    small = np.flatnonzero(np.repeat(size, size) <= SMALL)
    for i, j in all_pairs(key[small]):
        ok = np.bitwise_count(fp[small[i]] ^ fp[small[j]]) <= near
        yield small[i[ok]], small[j[ok]]
    for x, y in zip(cut[:-1][size > SMALL].tolist(), cut[1:][size > SMALL].tolist(), strict=True):
        for a in range(x, y, SMALL):
            for b in range(a, y, TILE):
                i, j = np.nonzero(np.bitwise_count(fp[a : min(a + SMALL, y), None] ^ fp[b : min(b + TILE, y)]) <= near)
                ok = a + i < b + j
                yield a + i[ok], b + j[ok]


def probes(fps: np.ndarray, margins: np.ndarray, width: int, turned: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all blocks of all fingerprints, with every choice of the ``turned`` least certain bits of a block turned, and the row of each."""
    n, count = fps.shape
    low = (1 << width) - 1
    keys = []
    for k in range(count):
        for b in range(64 // width):
            val = (fps[:, k] >> np.uint64(b * width)) & np.uint64(low)
            weak = np.argsort(margins[:, k, b * width : (b + 1) * width], axis=1, kind="stable")[:, :turned]
            flips = np.zeros((n, 1), np.uint64)
            for j in range(turned):
                flips = np.concatenate([flips, flips ^ (np.uint64(1) << weak[:, j : j + 1].astype(np.uint64))], axis=1)
            keys.append((val[:, None] ^ flips) | np.uint64((k * (64 // width) + b) << width))
    keys = np.concatenate(keys, axis=1)
    return keys.ravel(), np.repeat(np.arange(n), keys.shape[1])


def crowded(key: np.ndarray, fp: np.ndarray, near: int):
    """Settle buckets of more than BIG rows around their centre: links (a, b) found so far, and which rows are left to be compared.

    Rows within half of ``near`` of the bits' majority are within ``near`` of
    each other, so links to the one closest to it connect them. A row outside
    needs one of them: a few are tried, and all of them if those fail.
    """
    left, found = np.ones(len(key), bool), []
    cut = runs(key)
    for x, y in zip(cut[:-1], cut[1:], strict=True):
        at = np.arange(x, y)
        while len(at) > BIG:
            code = fp[at]
            bits = np.unpackbits(code.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
            centre = np.packbits(2 * bits > len(at), bitorder="little").view(np.uint64)[0]
            d = np.bitwise_count(code ^ centre)
            ball = d <= near // 2
            if ball.sum() < len(at) // 10 + 2:
                break
            inside, at = at[ball], at[~ball]
            lead = inside[np.argmin(d[ball])]
            left[inside] = False
            found.append((np.full(len(inside) - 1, lead), inside[inside != lead]))
            alone = at
            for some in (inside[:64], inside[64:]):
                for c in range(0, len(alone) if len(some) else 0, 256):
                    part = alone[c : c + 256]
                    i, j = np.nonzero(np.bitwise_count(fp[part][:, None] ^ fp[some][None, :]) <= near)
                    found.append((part[i], some[j]))
                alone = np.setdiff1d(alone, np.concatenate([a for a, _ in found]))
    return found, left


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similar: float = 0.8, near: int = 17, wide: int = 44, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, component_id, kept, *carry)``: groups of documents with a Jaccard similarity of ``similar`` or more on their shingles.

    One row for every input row; ``component_id`` is the smallest ``doc_id`` of
    the group (null if it has none) and one row of the group, one with that id,
    is ``kept``. Each document has COUNT fingerprints. Texts at a similarity of
    0.8 differ in one bit of seven, and mostly in bits that few votes decided:
    so each block of bits names a bucket, and so does the block with every
    choice of its least certain bits turned, at any number of rows. Buckets
    hold another of the fingerprints; all of one key are compared, those within
    ``near`` bits are found, and candidates are within ``wide`` bits over all. Links are thinned to
    spanning forests and each document's closest one is verified on the
    shingles; where documents that candidates join are still in several groups,
    all candidates between those groups are verified too.
    """
    spark = df.sparkSession
    names = [f"fp{k}" for k in range(COUNT)]
    fields = ["node", "n", *names, "m", "h"]

    def vote(batches):
        part, k = TaskContext.get().partitionId() << 33, 0
        for b in slices(batches, "_similar_text"):
            at = b.schema.get_field_index("_similar_text")
            out = []
            for t in raw(b.column(at)):
                h = shingle_hashes(t, words)
                v = votes(h, COUNT)
                fp = majority(v, len(h)) if t.split() else np.zeros(COUNT, np.int64)
                sure = np.minimum(np.abs(2 * v - len(h)) * 64 / np.sqrt(len(h)), 255).astype(np.uint8)
                some = np.unique((h >> np.uint64(32)).astype(np.uint32))
                out.append((part + k, len(some), *fp.tolist(), sure.tobytes(), some.tobytes()))
                k += 1
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * (2 + COUNT), pa.binary(), pa.binary()), strict=True)]
            keep = [c for c in range(b.num_columns) if c != at]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], [*(b.schema.names[c] for c in keep), *("_similar_" + f for f in fields)])

    rows = df.select(F.col(id_col).cast("bigint").alias("_similar_doc"), *(F.col(c).alias("_with_" + c) for c in carry), F.col(text_col).cast("string").alias("_similar_text"))
    schema = rows.drop("_similar_text")
    for f in fields:
        schema = schema.withColumn("_similar_" + f, F.lit(None).cast("binary" if f in "mh" else "bigint"))
    held = stage(rows.mapInArrow(vote, schema.schema), "similar")
    fps = held.select(*(F.col("_similar_" + f).alias(f) for f in ("node", "n", *names, "m")))
    buckets = 8 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    per = 64 // BLOCK

    def deal(batches):
        for pdf in batches:
            pdf = pdf.drop_duplicates(names)
            fp = np.stack([pdf[c].to_numpy().view(np.uint64) for c in names], axis=1)
            key, row = probes(fp, np.frombuffer(b"".join(pdf["m"]), np.uint8).reshape(-1, COUNT, 64), BLOCK, TURNED)
            of = (key >> np.uint64(BLOCK)).astype(np.int64) // per
            other = fp[row, (of + 1) % COUNT]
            b = (key * MULT >> np.uint64(40)).astype(np.int64) % buckets
            order = np.lexsort((key, b))
            b, key, other = b[order], key[order].astype(np.uint32), other[order]
            cut = runs(b)
            yield pd.DataFrame([(int(b[x]), key[x:y].tobytes(), other[x:y].tobytes()) for x, y in zip(cut, cut[1:], strict=False)], columns=["bucket", "k", "f"])

    def search(batches):
        for pdf in whole_groups(batches, ["bucket"], 1):
            cut = runs(pdf["bucket"].to_numpy())
            for x, y in zip(cut, cut[1:], strict=False):
                key = np.concatenate([np.frombuffer(v, np.uint32) for v in pdf["k"].iloc[x:y]])
                fp = np.concatenate([np.frombuffer(v, np.uint64) for v in pdf["f"].iloc[x:y]])
                order = np.lexsort((fp, key))
                order = order[runs(key[order], fp[order])[:-1]]
                key, fp = key[order], fp[order]
                of = ((key >> np.uint32(BLOCK)) // np.uint32(per)).astype(np.int64)
                found, left = crowded(key, fp, near)
                some = np.flatnonzero(left)
                held_, n = [], 0
                for i, j in chain(found, ((some[i], some[j]) for i, j in close_pairs(key[some], fp[some], near))):
                    held_.append(np.stack([of[i], fp[i].view(np.int64), fp[j].view(np.int64)]))
                    n += len(i)
                    if n > 2_000_000:
                        held_ = [thinned(held_)]
                        n = held_[0].shape[1]
                if held_:
                    yield pd.DataFrame(thinned(held_).T, columns=["of", "a", "b"])

    def thinned(held_) -> np.ndarray:
        """A spanning forest of the closest links, for each fingerprint."""
        t = np.concatenate(held_, axis=1)
        out = []
        for k in range(COUNT):
            some = t[:, t[0] == k]
            some[1:] = np.sort(some[1:], axis=0)
            some = np.unique(some, axis=1)
            out.append(some[:, nearest_forest(some[1], some[2], np.bitwise_count(some[1] ^ some[2]).astype(np.int64))] if some.shape[1] else some)
        return np.concatenate(out, axis=1)

    dealt = fps.select(*names, "m").mapInPandas(deal, "bucket int, k binary, f binary")
    near_ = stage(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(search, "of int, a bigint, b bigint").distinct(), "similar-near")
    kinds = stage(fps.groupBy(*names).agg(F.min("node").alias("node"), F.min("n").alias("n")), "similar-kinds")
    bits = lambda a, b: sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(COUNT)), F.lit(0))
    one, two = (kinds.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), *(F.col(c).alias(f"{s}{k}") for k, c in enumerate(names))) for s in "xy")
    cand = fps.join(kinds.select(*names, F.col("node").alias("x")), names).select("x", F.col("node").alias("y"), F.lit(0).alias("d")).where("x <> y")
    for k in range(COUNT):
        other = (k + 1) % COUNT
        pairs = near_.where(F.col("of") == k).join(one, F.col("a") == F.col(f"x{other}")).join(two, F.col("b") == F.col(f"y{other}"))
        pairs = pairs.where((bits("x", "y") <= wide) & (F.least("nx", "ny") >= similar * F.greatest("nx", "ny")))
        cand = cand.unionByName(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), bits("x", "y").alias("d")))
    cand = stage(cand.distinct(), "similar-pairs")

    def check(batches):
        for pdf in batches:
            keep = [alike(np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32), similar) for p, q in zip(pdf["p"], pdf["q"], strict=True)]
            yield pdf.loc[np.array(keep, bool), ["x", "y"]]

    # first each document's closest candidate and the one with the smallest number: most groups need no more
    both = cand.select(F.col("x").alias("i"), F.col("y").alias("j"), "d").union(cand.select("y", "x", "d"))
    few = both.groupBy("i").agg(F.min(F.struct("d", "j"))["j"].alias("one"), F.min("j").alias("two"))
    few = few.select("i", "one").union(few.select("i", "two")).select(F.least("i", "one").alias("x"), F.greatest("i", "one").alias("y")).distinct()
    sets = held.select(F.col("_similar_node").alias("k"), F.col("_similar_h").alias("h"))
    pairs = few.join(sets.toDF("k", "p"), F.col("x") == F.col("k")).drop("k").join(sets.toDF("k", "q"), F.col("y") == F.col("k")).select("x", "y", "p", "q")
    good = stage(pairs.mapInPandas(check, "x bigint, y bigint"), "similar-linked")
    comp = stage(connected_components(good, "x", "y"), "similar-comp")
    rest = stage(unchecked(fps, sets, cand, comp, similar, wide), "similar-rest")
    if not rest.isEmpty():
        comp = stage(connected_components(good.unionByName(rest), "x", "y"), "similar-comp")
    out = held.select(F.col("_similar_doc").alias("doc_id"), *("_with_" + c for c in carry), "_similar_node")
    comp = comp.select(F.col("node").alias("_similar_c"), F.col("component").alias("_similar_l"))
    out = out.join(comp, F.col("_similar_node") == F.col("_similar_c"), "left").withColumn("_similar_root", F.coalesce("_similar_l", "_similar_node"))
    best = out.groupBy(F.col("_similar_root").alias("_similar_r")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_similar_node")).alias("_similar_best"))
    out = out.join(best, F.col("_similar_root") == F.col("_similar_r"))
    out = out.select("doc_id", F.col("_similar_best.doc_id").alias("component_id"), (F.col("_similar_node") == F.col("_similar_best._similar_node")).alias("kept"), *(F.col("_with_" + c).alias(c) for c in carry))
    out = stage(out, "similar-groups")
    for table in (held, near_, kinds, cand, good, rest, comp):
        unstage(table)
    return out


def alike(one: np.ndarray, two: np.ndarray, similar: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``similar`` or more."""
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both >= similar * (len(one) + len(two) - both)


def unchecked(fps: DataFrame, sets: DataFrame, cand: DataFrame, comp: DataFrame, similar: float, wide: int) -> DataFrame:
    """``(x, y)``: verified links between documents of different groups in ``comp``, as many as join them.

    Candidate links join what all links join. So a pair that was not verified
    lies within one component of ``cand``, and only those with several groups
    are searched, tile against tile. A tile looks at its closest pairs first,
    and a pair whose groups it has joined already needs no look.
    """
    wider = connected_components(cand, "x", "y").select("node", F.col("component").alias("wider"))
    label = wider.join(comp, "node", "left").select(F.col("node").alias("i"), "wider", F.coalesce("component", "node").alias("label"))
    open_ = label.groupBy("wider").agg(F.min("label").alias("m"), F.max("label").alias("top"), F.count(F.lit(1)).alias("size"))
    open_ = open_.where("m <> top and size > 2").select("wider", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    names = [f"fp{k}" for k in range(COUNT)]
    some = stage(label.join(open_, "wider"), "similar-open")
    mine = fps.select("node", "n", *names).join(some, F.col("node") == F.col("i")).withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    mine = mine.join(sets, F.col("node") == F.col("k")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    mine = mine.select("wider", F.least("t", "o").alias("lo"), F.greatest("t", "o").alias("hi"), "t", "node", "n", "label", *names, "h")
    by = ["wider", "lo", "hi"]

    def compare(batches):
        for pdf in whole_groups(batches, by, 1):
            cut = runs(*(pdf[c].to_numpy() for c in by))
            fp = np.stack([pdf[c].to_numpy().view(np.uint64) for c in names])
            node, n, t, lo = (pdf[c].to_numpy() for c in ("node", "n", "t", "lo"))
            label_ = np.unique(pdf["label"].to_numpy(), return_inverse=True)[1]
            set_of = [np.frombuffer(h, np.uint32) for h in pdf["h"]]
            up = list(range(label_.max() + 1))

            def root(x):
                while (y := up[x]) != x:
                    up[x] = up[y]
                    x = y
                return x

            out = []
            for x, y in zip(cut, cut[1:], strict=False):
                a = np.flatnonzero(t[x:y] == lo[x]) + x
                b = np.flatnonzero(t[x:y] != lo[x]) + x
                same = not len(b) and pdf["hi"].iloc[x] == lo[x]
                for at in range(0, len(a), 256):
                    i = a[at : at + 256]
                    j = a[at:] if same else b
                    if not len(j):
                        continue
                    now = np.array([root(k) for k in range(len(up))])[label_]
                    d = sum(np.bitwise_count(f[i][:, None] ^ f[j]).astype(np.int16) for f in fp)
                    ok = (d <= wide) & (now[i][:, None] != now[j]) & (np.minimum(n[i][:, None], n[j]) >= similar * np.maximum(n[i][:, None], n[j]))
                    p, q = np.nonzero(ok)
                    order = np.argsort(d[p, q], kind="stable")
                    for g, h in zip(i[p[order]].tolist(), j[q[order]].tolist(), strict=True):
                        u, v = root(label_[g]), root(label_[h])
                        if u != v and alike(set_of[g], set_of[h], similar):
                            up[max(u, v)] = min(u, v)
                            out.append((min(node[g], node[h]), max(node[g], node[h])))
            yield pd.DataFrame(out, columns=["x", "y"])

    return mine.repartition(*by).sortWithinPartitions(*by).mapInPandas(compare, "x bigint, y bigint")
