"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Documents become pieces of at most ``capacity`` tokens, which are packed in
bulk-synchronous rounds. A round opens sequences for the longest waiting pieces,
as many as the waiting tokens need at least, takes up the longest of the others
(SHARE of their tokens; short ones are kept for what long ones leave) and sorts
them by length and all gaps by room, longest first. Both orders are cut into ranges
that hold equal shares of their tokens, and the ranges of like place meet in
one task. There a sweep gives each piece, longest first, its successor among
the gaps: the smallest one that holds it. Where pieces claim the same gap, the
earlier rank has it and the later one goes to the next; what is left of a gap
takes part at once. Pieces that found none wait, changed gaps go back into the
order, and the next round follows. Once one task can hold the waiting pieces,
the last round opens sequences within its sweep, against as many of the
largest gaps as pieces wait; a table that one task can hold has that round
alone, which is plain best-fit decreasing.

The driver sees the number of pieces and gaps of each size (at most two rows a
token of ``capacity``) and sets the ranges' borders from these. A size may hold
any share of the rows: within it, a hash of the piece's number deals them.

Defined results: null text packs as empty text (one token, the separator);
rows that repeat a document are packed as often as they come; null ids stay
null; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.common import runs, slices, whole_groups
from folioscope.plans.staging import stage

SAFE = re.compile(r"(?<=\S) (?=[^\W\d_])")  # a token always starts at such a blank
LONG = 1_000_000
END = 0
PER_TASK, ROUNDS, SHARE = 200_000, 14, 0.6  # rows of a sweep; rounds before the last one at most; part of the waiting tokens that a round takes up
GAP, WAITING, PLACED = 0, 1, 2


@lru_cache(maxsize=4)
def encoder(ranks: str, pattern: str, special: tuple[tuple[str, int], ...]):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=table, special_tokens=dict(special))


def default_tokenizer() -> tuple[str, str, tuple[tuple[str, int], ...]]:
    """The byte-level BPE of 50,257 entries: the JSON tokenizer's vocabulary, read as ranks."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN, (("<|endoftext|>", 50256),)


def encode(text: str, tok) -> np.ndarray:
    """Ids as uint32; long texts are cut only where a token starts anyway."""
    enc = encoder(*tok)
    if len(text) <= LONG:
        return enc.encode_to_numpy(text, allowed_special="all")
    out, at = [], 0
    while at < len(text):
        m = SAFE.search(text, at + LONG)
        to = m.start() if m else len(text)
        out.append(enc.encode_to_numpy(text[at:to], allowed_special="all"))
        at = to
    return np.concatenate(out)


def pieces(df: DataFrame, id_col: str, text_col: str, capacity: int, tok) -> DataFrame:
    """``(no, doc_id, piece, start, length, ids_crc32)``; of a longer document the first piece is the shorter one."""

    def run(batches):
        no = TaskContext.get().partitionId() << 40
        for b in slices(batches, "t"):
            ids, out = b.column(0).to_pylist(), []
            for doc, text in zip(ids, b.column(1).to_pylist(), strict=True):
                t = np.append(encode(text or "", tok), np.uint32(END)).astype("<u4")
                cuts = [0, *range(len(t) % capacity or capacity, len(t) + 1, capacity)]
                out += [(no + len(out) + k, doc, k, x, y - x, zlib.crc32(t[x:y].tobytes())) for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))]
            no += len(out)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["no", "doc_id", "piece", "start", "length", "ids_crc32"])

    got = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return got.mapInArrow(run, "no bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def sweep(lengths: list[int], rooms: list[int], opening: bool, capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit of pieces, longest first: each piece's gap (-1: none) and offset, and all gaps' rooms afterwards, new ones at the end."""
    of: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, some = list(rooms), 0  # bit k of `some`: a gap has room k
    for g in range(len(rooms) - 1, -1, -1):
        of[rooms[g]].append(g)
        some |= 1 << rooms[g]
    gap, offset = [], []
    for n in lengths:
        fits = some >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            g = of[room].pop()
            if not of[room]:
                some ^= 1 << room
        elif opening:
            room, g = capacity, len(rooms)
            rooms.append(capacity)
        else:
            gap.append(-1)
            offset.append(0)
            continue
        gap.append(g)
        offset.append(capacity - room)
        rooms[g] = room - n
        if room > n:
            of[room - n].append(g)
            some |= 1 << (room - n)
    return gap, offset, rooms


def opened(waiting: dict[int, int], gaps: dict[int, int], capacity: int) -> tuple[int, float]:
    """(length, share): pieces longer than that open sequences, and of those as long as that this share.

    Pieces of k tokens or more only fit gaps of that room, so their tokens and
    their number both say how many sequences are missing at least.
    """
    size, n = np.array(sorted(waiting)), np.array([waiting[k] for k in sorted(waiting)])
    room, m = np.array(sorted(gaps), np.int64), np.array([gaps[k] for k in sorted(gaps)], np.int64)
    left = 0
    for k in size.tolist():
        tokens = int((size * n)[size >= k].sum() - (room * m)[room >= k].sum())
        pieces_ = int(n[size >= k].sum() - (room // k * m).sum())
        left = max(left, -(-tokens // capacity), -(-pieces_ // (capacity // k)))
    for k in sorted(waiting, reverse=True):
        if left <= waiting[k]:
            return k, left / waiting[k]
        left -= waiting[k]
    return 0, 0.0


def borders(sizes: dict[int, int], ranges: int) -> dict[int, tuple[float, float]]:
    """For each size, the place where its rows begin in the descending order and the stretch they take, in ranges."""
    total, at, out = sum(k * n for k, n in sizes.items()), 0, {}
    for k in sorted(sizes, reverse=True):
        out[k] = (ranges * at / total, ranges * k * sizes[k] / total)
        at += k * sizes[k]
    return out


def one_round(state: DataFrame, capacity: int, ranges: int, opening: bool, waiting: dict[int, int], gaps: dict[int, int], r: int) -> DataFrame:
    """``(kind, no, size, sequence_id, offset)`` after a round over the gaps and waiting pieces of ``state``."""
    longest, share = (capacity + 1, 0.0) if opening else opened(waiting, gaps, capacity)
    u = F.shiftrightunsigned(F.xxhash64("no", F.lit(r)), 11) / F.lit(float(1 << 53))
    rows = state.withColumn("u", u)
    opens = (F.col("kind") == WAITING) & ((F.col("size") > longest) | ((F.col("size") == longest) & (F.col("u") < share)))
    rows = rows.withColumn("opens", opens)
    waiting, gaps = dict(waiting), dict(gaps)
    for k in [k for k in waiting if k >= longest]:
        n = waiting.pop(k) if k > longest else round(share * waiting[k])
        if k == longest:
            waiting[k] -= n
        if capacity > k:
            gaps[capacity - k] = gaps.get(capacity - k, 0) + n
    shortest, left = 0, (1 if opening else SHARE) * sum(k * n for k, n in waiting.items())
    for k in sorted(waiting, reverse=True):
        shortest, left = k, left - k * waiting[k]
        if left <= 0:
            break
    waiting = {k: n for k, n in waiting.items() if k >= shortest}
    # sequences that open now are gaps of this round, under the number of their first piece
    room = F.when(F.col("opens"), capacity - F.col("size")).otherwise(F.col("size"))
    kind = F.when(F.col("opens"), GAP).otherwise(F.col("kind"))
    dealt = rows.select(kind.alias("kind"), "no", room.alias("size"), "u").where("size > 0")
    short = dealt.where((F.col("kind") == WAITING) & (F.col("size") < shortest))
    dealt = dealt.where((F.col("kind") == GAP) | (F.col("size") >= shortest))
    at = [(kind, k, *x) for kind, sizes in ((GAP, gaps), (WAITING, waiting)) for k, x in borders({k: max(n, 1) for k, n in sizes.items()}, ranges).items()]
    bounds = state.sparkSession.createDataFrame(at or [(GAP, 0, 0.0, 0.0)], "k int, s long, begin double, stretch double")  # at most 2 * capacity rows
    dealt = dealt.join(F.broadcast(bounds), (F.col("kind") == F.col("k")) & (F.col("size") == F.col("s")))
    dealt = dealt.withColumn("p", F.least(F.floor(F.col("begin") + F.col("u") * F.col("stretch")), F.lit(ranges - 1)).cast("int"))

    def run(batches):
        for pdf in whole_groups(batches, ["p"], 1):
            cut = runs(pdf["p"].to_numpy())
            for x, y in zip(cut, cut[1:], strict=False):
                kinds, no, size = (pdf[c].to_numpy()[x:y] for c in ("kind", "no", "size"))
                g, w = kinds == GAP, kinds == WAITING
                order = np.lexsort((no[w], -size[w]))  # ranks: length, then number
                item, length = no[w][order], size[w][order]
                order = np.lexsort((no[g], size[g]))
                seq, rooms = no[g][order], size[g][order]
                gap, offset, left = sweep(length.tolist(), rooms.tolist(), opening, capacity)
                gap, left = np.array(gap, np.int64), np.array(left, np.int64)
                # a sequence that opens here takes the number of its first piece
                new, lead = np.unique(gap[gap >= len(seq)], return_index=True)
                seq = np.append(seq, item[np.flatnonzero(gap >= len(seq))[lead]])
                ok = gap >= 0
                yield pd.DataFrame({"kind": PLACED, "no": item[ok], "size": length[ok], "sequence_id": seq[gap[ok]], "offset": np.array(offset, np.int64)[ok]})
                yield pd.DataFrame({"kind": WAITING, "no": item[~ok], "size": length[~ok], "sequence_id": 0, "offset": 0})
                if not opening:
                    some = left > 0
                    yield pd.DataFrame({"kind": GAP, "no": seq[some], "size": left[some], "sequence_id": 0, "offset": 0})

    swept = dealt.select("p", "kind", "no", "size").repartition(ranges, "p").sortWithinPartitions("p").mapInPandas(run, "kind int, no bigint, size bigint, sequence_id bigint, offset bigint")
    first = rows.where("opens").select(F.lit(PLACED).alias("kind"), "no", "size", F.col("no").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    short = short.select("kind", "no", "size", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return stage(swept.unionByName(first).unionByName(short), "pack-round")


def best_fit(cut: DataFrame, capacity: int, per_task: int) -> DataFrame:
    """``(no, sequence_id, offset)`` of all pieces ``(no, length)``."""
    state = cut.select(F.lit(WAITING).alias("kind"), "no", F.col("length").alias("size"))
    done = []
    for r in range(ROUNDS + 1):
        counts = state.groupBy("kind", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("kind") != PLACED).collect()
        waiting, gaps = ({x["size"]: x["n"] for x in counts if x["kind"] == kind} for kind in (WAITING, GAP))
        if not waiting:
            break
        least = min(waiting)  # smaller gaps hold nothing any more
        gaps = {k: n for k, n in gaps.items() if k >= least}
        state = state.where((F.col("kind") == WAITING) | ((F.col("kind") == GAP) & (F.col("size") >= least))).select("kind", "no", "size")
        opening = 2 * sum(waiting.values()) <= per_task or r == ROUNDS
        if opening:
            floor, left = least, sum(waiting.values())
            for k in sorted(gaps, reverse=True):
                floor, left = k, left - gaps[k]
                if left <= 0:
                    break
            gaps = {k: n for k, n in gaps.items() if k >= floor}
            state = state.where((F.col("kind") == WAITING) | (F.col("size") >= floor))
        ranges = max(1, round((sum(waiting.values()) + sum(gaps.values())) / per_task))
        state = one_round(state, capacity, ranges, opening, waiting, gaps, r)
        done.append(state.where(F.col("kind") == PLACED).select("no", "sequence_id", "offset"))
        if opening:
            break
    out = cut.select("no", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")).limit(0)
    for d in done:
        out = out.unionByName(d)
    return out


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer=None, per_task: int = PER_TASK) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row for every piece."""
    cut = stage(pieces(df, id_col, text_col, capacity, tokenizer or default_tokenizer()), "pack")
    return cut.join(best_fit(cut, capacity, per_task), "no").drop("no")
