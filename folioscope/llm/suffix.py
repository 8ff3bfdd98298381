"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

Every string of ``length`` bytes is named after its anchor, the leftmost
smallest k-gram hash in it, so equal strings share the anchor's hash wherever
they stand (winnowing, Schleimer et al., SIGMOD 2003). Anchors that occur once
in the corpus cannot start a repeat; the text around all others is dealt to
buckets by anchor hash, where an index family takes it in batches: a batch gets
a suffix array (prefix doubling to depth ``length``), which is scanned in suffix
order against every existing level, what was first stays first, and levels of
like size merge into one suffix array. Whole copies of a text are settled by
digest, and equal stretches of text by their bytes, before they are indexed: so
a group of copies costs no more than its members.

Documents are held in slices, compressed, and all that concerns a slice returns
to it by its number. An anchor that is found in very many slices is dealt by
single strings instead, so a passage that a large share of documents holds does
not meet in one bucket.

Defined results: null text is empty; matches never cross documents; a null id
comes after all others; of rows with equal id and equal text one is first and
the others are copies of it; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.common import raw, runs, slices, whole_groups
from folioscope.llm.quality import powers
from folioscope.plans.staging import stage

GRAM, SLICE, BATCH, HOT_SLICES = 32, 3_000_000, 2_000_000, 512
LAST = np.iinfo(np.int64).max


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def prefix(buf: np.ndarray) -> np.ndarray:
    pre = np.zeros(len(buf) + 1, np.uint64)
    tail = pre[1:]
    tail += buf
    tail += np.uint64(1)
    tail *= powers(len(buf) + 1)[0][: len(buf)]
    np.cumsum(tail, out=tail)
    return pre


def spans_hash(pre: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    h = pre[start + size]
    h -= pre[start]
    h *= powers(len(pre))[1][start]
    return mixed(h)


def anchor_runs(buf: np.ndarray, ends: np.ndarray, length: int, gram: int = GRAM):
    """(first start, last start, anchor hash) of each run of strings with one anchor; texts end at ``ends``."""
    none = np.empty(0, np.int64)
    if len(buf) < length:
        return none, none, np.empty(0, np.uint64)
    pre = prefix(buf)
    n = len(buf) - gram + 1
    full = pre[gram:] - pre[:n]
    full *= powers(len(pre))[1][:n]
    full = mixed(full)
    del pre
    val, pos, width = (full >> np.uint64(32)).astype(np.uint32), np.arange(n, dtype=np.int32), 1
    want = length - gram + 1
    while width < want:
        step = min(width, want - width)
        a, b = val[: len(val) - step], val[step:]
        later = b < a
        val, pos = np.where(later, b, a), np.where(later, pos[step:], pos[: len(pos) - step])
        width += step
    # a start counts if the string ends within its text
    sizes = np.diff(np.append(0, ends))
    left = np.repeat(ends, sizes) - np.arange(len(buf))
    ok = np.flatnonzero(left >= length)
    if not len(ok):
        return none, none, np.empty(0, np.uint64)
    cut = runs(pos[ok], (ok + left[ok]))
    return ok[cut[:-1]], ok[cut[1:] - 1], full[pos[ok[cut[:-1]]]]


def suffix_classes(buf: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``starts`` to depth ``length`` and, in its order, whether a suffix differs from the one before."""
    pad = np.concatenate([buf, np.zeros(length + 8, np.uint8)]).astype(np.uint64)
    n = len(buf)
    rank = np.zeros(n + length, np.uint64)
    for k in range(8):
        rank = (rank << np.uint64(8)) | pad[k : k + n + length]
    depth = 8
    while depth < length:
        _, rank = np.unique(rank, return_inverse=True)
        step = min(depth, length - depth)
        keep = len(rank) - step
        rank = (rank[:keep].astype(np.uint64) << np.uint64(32)) | rank[step:].astype(np.uint64)
        depth += step
    r = rank[starts]
    order = np.argsort(r, kind="stable")
    r = r[order]
    return order, np.append(True, r[1:] != r[:-1])[: len(r)]


class Level:
    """A suffix array to the depth of ``length`` bytes: distinct strings in suffix order, each with its first place.

    ``text`` holds the strings as fixed-width bytes, which numpy compares as
    the suffixes themselves.
    """

    def __init__(self, text, doc, tie, start):
        self.text, self.doc, self.tie, self.start = text, doc, tie, start

    def take(self, at) -> Level:
        return Level(*(x[at] for x in vars(self).values()))

    def places(self, other: Level) -> np.ndarray:
        """Where each string of ``other`` stands in this order."""
        return np.searchsorted(self.text, other.text)

    def merged(self, other: Level) -> Level:
        """Both in one suffix order; no string is in both."""
        at = self.places(other) + np.arange(len(other.text))
        mine = np.ones(len(self.text) + len(at), bool)
        mine[at] = False
        out = []
        for a, b in zip(vars(self).values(), vars(other).values(), strict=True):
            both = np.empty(len(mine), a.dtype)
            both[mine], both[at] = a, b
            out.append(both)
        return Level(*out)


class Family:
    """Suffix arrays of geometrically growing size over the strings of one bucket."""

    def __init__(self, length: int):
        self.length, self.levels, self.later = length, [], []

    def add(self, buf: np.ndarray, ends: np.ndarray, doc: np.ndarray, tie: np.ndarray, first: np.ndarray) -> None:
        """Index a batch of stretches of text (end in ``buf``, document, its start there); stretches in document order."""
        sizes = np.diff(np.append(0, ends))
        n = sizes - self.length + 1
        owner = np.repeat(np.arange(len(ends)), n)
        off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = (ends - sizes)[owner] + off
        order, new = suffix_classes(buf, starts, self.length)
        owner, off, starts = owner[order], off[order], starts[order]
        self._drop(doc, tie, first, owner[~new], off[~new])  # the sort is stable: the earliest of a class leads it
        owner, off, starts = owner[new], off[new], starts[new]
        text = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, self.length)[starts]).view(f"S{self.length}").ravel()
        batch = Level(text, doc[owner], tie[owner], first[owner] + off)
        for level in self.levels:
            batch = self._scan(batch, level)
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2].text) <= 2 * len(self.levels[-1].text):
            last = self.levels.pop()
            self.levels[-1] = self.levels[-1].merged(last)

    def _drop(self, doc, tie, first, owner, off) -> None:
        self.later.append((doc[owner], tie[owner], first[owner] + off))

    def _scan(self, batch: Level, level: Level) -> Level:
        """Scan a batch and a level in suffix order; matched strings leave the batch, the later place of each pair is dropped."""
        at = level.places(batch)
        here = np.flatnonzero(at < len(level.text))
        b = here[level.text[at[here]] == batch.text[here]]
        v = at[b]
        older = (batch.doc[b] < level.doc[v]) | ((batch.doc[b] == level.doc[v]) & ((batch.tie[b] < level.tie[v]) | ((batch.tie[b] == level.tie[v]) & (batch.start[b] < level.start[v]))))
        for side, row in ((batch, b[~older]), (level, v[older])):
            self.later.append((side.doc[row], side.tie[row], side.start[row]))
        for name in ("doc", "tie", "start"):
            getattr(level, name)[v[older]] = getattr(batch, name)[b[older]]
        left = np.ones(len(batch.text), bool)
        left[b] = False
        return batch.take(np.flatnonzero(left))


def equal_to_earlier(buf: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which stretches of ``buf`` hold the same bytes as one before them."""
    h = spans_hash(prefix(buf), begin, size)
    order = np.lexsort((np.arange(len(h)), size, h))
    same = np.zeros(len(h), bool)
    text = buf.tobytes()
    lead = -1
    for k, new in zip(order, np.append(True, (h[order][1:] != h[order][:-1]) | (size[order][1:] != size[order][:-1]))[: len(h)], strict=True):
        if new:
            lead = text[begin[k] : begin[k] + size[k]]
        elif text[begin[k] : begin[k] + size[k]] == lead:
            same[k] = True
    return same


def merge_spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans; touching spans become one."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.append(True, lo[1:] > hi[:-1])
    return lo[new], np.append(hi[:-1][new[1:]], hi[-1])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, keep_text: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept])``, one row for every input row; ``kept`` holds the remaining bytes."""
    spark = df.sparkSession
    buckets = 8 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def cut(batches):
        part, k = TaskContext.get().partitionId(), 0
        packer = zstandard.ZstdCompressor(level=3)
        for b in slices(batches, "t", SLICE):
            texts = raw(b.column(1))
            ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
            buf = np.frombuffer(b"".join(texts), np.uint8)
            digests = [hashlib.sha256(t).digest() for t in texts]
            ids = [LAST if x is None else x for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pylist([{"slice": (part << 32) + k, "ids": ids, "nulls": [x is None for x in b.column(0).to_pylist()], "digests": digests, "ends": ends.tobytes(), "z": packer.compress(buf.tobytes())}], pa.schema(fields))
            k += 1

    fields = [("slice", pa.int64()), ("ids", pa.list_(pa.int64())), ("nulls", pa.list_(pa.bool_())), ("digests", pa.list_(pa.binary())), ("ends", pa.binary()), ("z", pa.binary())]
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    held = stage(rows.mapInArrow(cut, "slice bigint, ids array<bigint>, nulls array<boolean>, digests array<binary>, ends binary, z binary"), "suffix")

    each = held.select("slice", F.posexplode(F.arrays_zip("ids", "digests")).alias("i", "x")).select("slice", "i", F.col("x.ids").alias("id"), F.col("x.digests").alias("d"))
    first = each.groupBy("d").agg(F.min(F.struct("id", "slice", "i")).alias("m")).groupBy("m.slice").agg(F.collect_list("m.i").alias("firsts"))

    def ask(batches):
        for pdf in whole_groups(batches, ["bucket"], 1):
            cut_ = runs(pdf["bucket"].to_numpy())
            for x, y in zip(cut_, cut_[1:], strict=False):
                hs = [np.frombuffer(v, np.uint64) for v in pdf["h"].iloc[x:y]]
                every, inv, n = np.unique(np.concatenate(hs), return_inverse=True, return_counts=True)
                many = np.zeros(len(every), bool)
                many[inv[np.concatenate([np.frombuffer(v, bool) for v in pdf["many"].iloc[x:y]])]] = True
                dup, hot = (n > 1) | many, n >= HOT_SLICES
                at, out = 0, []
                for s, h in zip(pdf["slice"].iloc[x:y], hs, strict=True):
                    i = inv[at : at + len(h)]
                    at += len(h)
                    if dup[i].any():
                        out.append((s, h[dup[i]].tobytes(), h[hot[i]].tobytes(), None))
                yield pd.DataFrame(out, columns=["slice", "dup", "hot", "firsts"])

    def anchors(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.z), np.uint8)
                h, n = np.unique(anchor_runs(buf, np.frombuffer(row.ends, np.int64), length)[2], return_counts=True)
                at = (h % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(at, kind="stable")
                at, h, n = at[order], h[order], n[order]
                edge = runs(at)
                yield pd.DataFrame([(at[x], row.slice, h[x:y].tobytes(), (n[x:y] > 1).tobytes()) for x, y in zip(edge, edge[1:], strict=False)], columns=["bucket", "slice", "h", "many"])

    asked = held.select("slice", "ends", "z").mapInPandas(anchors, "bucket int, slice bigint, h binary, many binary")
    answers = asked.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(ask, "slice bigint, dup binary, hot binary, firsts array<int>")
    answers = answers.unionByName(first.select("slice", F.lit(None).cast("binary").alias("dup"), F.lit(None).cast("binary").alias("hot"), "firsts"))

    def stretches(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        packer, out = zstandard.ZstdCompressor(level=1), []
        empty = np.empty(0, np.uint64)
        dup, hot = (np.sort(np.concatenate([empty, *(np.frombuffer(v, np.uint64) for v in right[c] if v is not None)])) for c in ("dup", "hot"))
        lead = {int(i) for v in right["firsts"] if v is not None for i in v}
        for row in left.itertuples(index=False):
            buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.z), np.uint8)
            ends = np.frombuffer(row.ends, np.int64)
            lo, hi, h = anchor_runs(buf, ends, length)
            d = np.searchsorted(ends, lo, "right")
            known = np.isin(h, dup) & np.isin(d, np.fromiter(lead, np.int64, len(lead)))
            lo, hi, h, d = lo[known], hi[known], h[known], d[known]
            if not len(lo):
                continue
            burst = np.isin(h, hot)
            n = np.where(burst, hi - lo + 1, 1)
            pick = np.repeat(np.arange(len(lo)), n)
            off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            single = burst[pick]
            lo, hi, h, d = lo[pick] + off, np.where(single, lo[pick] + off, hi[pick]), h[pick], d[pick]
            pre = prefix(buf)
            size = hi - lo + length
            whole = spans_hash(pre, lo, size)
            h = np.where(single, whole, h)
            ids, ties = np.array(row.ids, np.int64), np.array([int.from_bytes(x[:8], "little") >> 1 for x in row.digests], np.int64)
            order = np.lexsort((lo, ties[d], ids[d], whole))
            lo, size, h, d, whole = lo[order], size[order], h[order], d[order], whole[order]
            # equal stretches within the slice: all but the first are settled here
            same = equal_to_earlier(buf, lo, size)
            begins = np.append(0, ends)[:-1]
            if same.any():
                w = lo[same] - begins[d[same]]
                out.append((-1 - int(row.slice) % buckets, row.slice, np.stack([d[same], w, w + size[same]]).tobytes(), b""))
            lo, size, h, d = lo[~same], size[~same], h[~same], d[~same]
            b = (h % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((lo, ties[d], ids[d], b))
            lo, size, h, d, b = lo[order], size[order], h[order], d[order], b[order]
            text = buf.tobytes()
            cut_ = runs(b)
            for x, y in zip(cut_, cut_[1:], strict=False):
                meta = np.stack([d[x:y], ids[d[x:y]], ties[d[x:y]], lo[x:y] - begins[d[x:y]], size[x:y], h[x:y].view(np.int64)])
                out.append((int(b[x]), row.slice, meta.tobytes(), packer.compress(b"".join(text[p : p + q] for p, q in zip(lo[x:y], size[x:y], strict=True)))))
        return pd.DataFrame(out, columns=["bucket", "slice", "meta", "z"])

    dealt = held.select("slice", "ids", "digests", "ends", "z").groupBy("slice").cogroup(answers.groupBy("slice")).applyInPandas(stretches, "bucket int, slice bigint, meta binary, z binary")

    def index(batches):
        for pdf in whole_groups(batches, ["bucket"], 1):
            cut_ = runs(pdf["bucket"].to_numpy())
            for x, y in zip(cut_, cut_[1:], strict=False):
                some = pdf.iloc[x:y]
                if some["bucket"].iloc[0] < 0:
                    yield pd.DataFrame({"slice": some["slice"], "spans": some["meta"]})
                    continue
                family, held_, room = Family(length), [], BATCH
                metas, where = [], []
                for s, m, z in zip(some["slice"], some["meta"], some["z"], strict=True):
                    meta = np.frombuffer(m, np.int64).reshape(6, -1)
                    held_.append((meta, np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8)))
                    metas.append(np.unique(meta[:3], axis=1))
                    where.append(np.full(metas[-1].shape[1], s))
                    room -= len(held_[-1][1])
                    if room < 0:
                        add(family, held_, False)
                        held_, room = [], BATCH
                if held_:
                    add(family, held_, room + sum(len(t) for _, t in held_) == BATCH and not family.levels)
                if not family.later:
                    continue
                late = [np.concatenate(c) for c in zip(*family.later, strict=True)]
                if len(late[0]):
                    yield back(late, np.concatenate(metas, axis=1), np.concatenate(where))

    def add(family: Family, held_, whole: bool) -> None:
        """Index a batch; ``whole`` if the bucket has no other."""
        meta = np.concatenate([m for m, _ in held_], axis=1)
        buf = np.concatenate([t for _, t in held_])
        begin = np.cumsum(meta[4]) - meta[4]
        order = np.lexsort((meta[3], meta[2], meta[1]))  # document order
        meta, begin = meta[:, order], begin[order]
        # stretches that equal an earlier one are settled as they are
        same = equal_to_earlier(buf, begin, meta[4])
        for k in np.flatnonzero(same):
            n = int(meta[4, k]) - length + 1
            family.later.append((np.full(n, meta[1, k]), np.full(n, meta[2, k]), meta[3, k] + np.arange(n)))
        keep = ~same
        if whole:  # an anchor with one distinct stretch has nothing to match
            _, inv, n = np.unique(meta[5][keep], return_inverse=True, return_counts=True)
            keep[keep] = n[inv] > 1
        meta, begin = meta[:, keep], begin[keep]
        if not meta.shape[1]:
            return
        size = meta[4]
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        family.add(buf[at], np.cumsum(size), meta[1], meta[2], meta[3])

    def back(late, docs, where) -> pd.DataFrame:
        """Spans of later strings, grouped by the slice that holds their document."""
        doc, tie, start = late
        order = np.lexsort((start, tie, doc))
        doc, tie, start = doc[order], tie[order], start[order]
        cut_ = runs(doc, tie)
        new = np.append(True, (start[1:] > start[:-1] + length) | (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]))
        at = np.flatnonzero(new)
        lo, hi = start[at], start[np.append(at[1:], len(start)) - 1] + length
        place = {(int(a), int(t)): (int(s), int(i)) for i, a, t, s in zip(docs[0], docs[1], docs[2], where, strict=True)}
        owner = np.searchsorted(cut_, at, "right") - 1
        who = [place[int(doc[c]), int(tie[c])] for c in cut_[:-1]]
        s = np.array([w[0] for w in who])[owner]
        i = np.array([w[1] for w in who])[owner]
        order = np.argsort(s, kind="stable")
        s, i, lo, hi = s[order], i[order], lo[order], hi[order]
        cut_ = runs(s)
        return pd.DataFrame([(int(s[x]), np.stack([i[x:y], lo[x:y], hi[x:y]]).tobytes()) for x, y in zip(cut_, cut_[1:], strict=False)], columns=["slice", "spans"])

    spans = dealt.repartition("bucket").sortWithinPartitions("bucket", "slice").mapInPandas(index, "slice bigint, spans binary")
    spans = spans.select("slice", "spans", F.lit(None).cast("array<int>").alias("firsts")).unionByName(first.select("slice", F.lit(None).cast("binary").alias("spans"), "firsts"))

    def settle(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        lead = {int(i) for v in right["firsts"] if v is not None for i in v}
        got = np.concatenate([np.empty((3, 0), np.int64), *(np.frombuffer(v, np.int64).reshape(3, -1) for v in right["spans"] if v is not None)], axis=1)
        got = got[:, np.argsort(got[0], kind="stable")]
        out = []
        for row in left.itertuples(index=False):
            text = zstandard.ZstdDecompressor().decompress(row.z)
            ends = np.frombuffer(row.ends, np.int64)
            cut_ = np.searchsorted(got[0], np.arange(len(ends) + 1))
            at = 0
            for k, end in enumerate(ends):
                t, at = text[at:end], end
                if k in lead:
                    lo, hi = merge_spans(got[1, cut_[k] : cut_[k + 1]], got[2, cut_[k] : cut_[k + 1]])
                else:
                    lo, hi = (np.zeros(1, np.int64), np.array([len(t)])) if len(t) >= length else (np.empty(0, np.int64), np.empty(0, np.int64))
                kept = b"".join(t[x:y] for x, y in zip(np.append(0, hi), np.append(lo, len(t)), strict=True))
                out.append((None if row.nulls[k] else row.ids[k], len(t), len(t) - len(kept), len(lo), hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
        pdf = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])])
        return pdf.astype({"doc_id": "Int64"})

    result = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text
    return held.select("slice", "ids", "nulls", "ends", "z").groupBy("slice").cogroup(spans.groupBy("slice")).applyInPandas(settle, result)
