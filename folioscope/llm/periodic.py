"""Runs of periodic words: Main and Lorentz's divide and conquer over interned word ids.

A run is a stretch of consecutive words with smallest period q and at least
``max(least, times * q)`` words that no neighbouring word extends keeping q.
A stretch of words is halved again and again; at each midpoint, Z-functions
over the right half and the left half, and over each reversed, tell for every
period how far the words on both sides keep it, so all repetitions that cross
the midpoint come out at once (Main and Lorentz, "An O(n log n) algorithm for
finding all repetitions in a string", 1984). One that a word beyond the stretch
extends also crosses a midpoint further up, which finds it whole, and goes; of
equal intervals the smallest period stays.

Only stretches that can hold a run are halved: with g words so few that every
g words of a run come twice in it, these are the stretches in which all g
words in a row come again in their document. For 6 words and 4 times, g is 5.

A document is one row of its task, wherever Spark put it; nothing is shuffled.

Defined results: null text counts as empty and has no runs; words are split at
the ASCII white space alone and compared byte by byte; texts may have any
length; rows that repeat a document or lack an id get one row each; an empty
table gives an empty result; other columns are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folioscope.llm.common import raw, runs, slices

SLICE = 8_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def z_function(s: list[int]) -> list[int]:
    """For each place, the length of the longest common prefix of ``s`` and what starts there."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def find_runs(x: list[int], least: int, times: int) -> list[tuple[int, int, int]]:
    """All runs ``(start, end, period)`` of ``x``, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    todo = [(0, len(x))]
    while todo:
        low, high = todo.pop()
        if high - low < least:
            continue
        mid = (low + high) // 2
        left, right = x[low:mid], x[mid:high]
        n, m = len(left), len(right)
        onward = z_function([*right, -1, *left])
        back = z_function([*left[::-1], -1, *right[::-1]])
        for q in range(1, min(n, (high - low) // times) + 1):
            # how far the words keep period q: after mid + q, before mid - q, and between
            over, under = (onward[q] if q < m else 0), (back[q] if q < n else 0)
            fore, aft = onward[m + 1 + n - q], back[n + 1 + m - q]
            if fore == q:
                spans = ((mid - q - under, mid + q + over),)
            else:
                spans = ((mid - aft, mid + q + over), (mid - q - under, mid + fore))
            need = max(least, times * q)
            for s, e in spans:
                if e - s < need or (s == low > 0 and x[s - 1] == x[s - 1 + q]) or (e == high < len(x) and x[e] == x[e - q]):
                    continue
                if q < found.get((s, e), q + 1):
                    found[s, e] = q
        todo += [(low, mid), (mid, high)]
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def repeated_stretches(code: np.ndarray, ends: np.ndarray, g: int) -> list[tuple[int, int]]:
    """Maximal stretches of words in which each ``g`` words in a row come again in their document (equal hashes may add some)."""
    n = len(code) - g + 1
    if n <= 0:
        return []
    doc = np.searchsorted(ends, np.arange(len(code)), side="right")
    key = doc[:n].astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(g):
            key = (key ^ (key >> np.uint64(29))) * MIX + code[k : k + n].astype(np.uint64)
    at = np.flatnonzero(doc[:n] == doc[g - 1 :])  # not over a document's end
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(n + 1, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    cut = runs(again, np.append(doc[:n], -1))
    return [(u, v + g - 1) for u, v in zip(cut.tolist(), cut[1:].tolist(), strict=False) if again[u]]


def shortest_repeated(least: int, times: int) -> int:
    """So many words in a row of a run always come twice in it."""
    return max(1, min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 1)))


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """``(doc_id, n_words, runs array<struct<start, length, period>>, collapsed)``.

    ``collapsed`` has the words that no run holds after its first period, joined by one blank.
    """
    if times < 2 or least < 2:
        raise ValueError("a run repeats its period at least twice")
    g = shortest_repeated(least, times)

    def run(batches):
        for b in slices(batches, "t", SLICE):
            index: dict[bytes, int] = {}
            texts = [t.split() for t in raw(b.column(1))]
            ends = np.cumsum([len(w) for w in texts])
            code = np.fromiter((index.setdefault(x, len(index)) for w in texts for x in w), np.int64, int(ends[-1]))
            starts, of = ends - [len(w) for w in texts], [[] for _ in texts]
            for u, v in repeated_stretches(code, ends, g):
                d = int(np.searchsorted(ends, u, side="right"))
                base = u - int(starts[d])
                of[d] += [(base + s, e - s, q) for s, e, q in find_runs(code[u:v].tolist(), least, times)]
            for d, found in enumerate(of):
                if found:
                    drop = np.zeros(len(texts[d]) + 1, np.int64)
                    for s, n, q in found:
                        drop[s + q] += 1
                        drop[s + n] -= 1
                    texts[d] = [w for w, k in zip(texts[d], np.cumsum(drop)[:-1].tolist(), strict=True) if not k]
            flat = np.array([r for found in of for r in found], np.int64).reshape(-1, 3)
            rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(f) for f in of])), pa.int32()), rows)
            collapsed = pa.array([b" ".join(w) for w in texts], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ends - starts, pa.int64()), lists, collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    got = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return got.mapInArrow(run, "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def strongest(found: Column) -> Column:
    """The run with the greatest exact length / period; of equal ones the first, then that of the smallest period; null without runs."""
    better = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])  # noqa: E731  they come by start, then period
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.reduce(found, none, lambda a, b: F.when(better(a, b), b).otherwise(a))


def with_planted_periods(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` where documents whose crc32(id as text) ends in 0 become periodic from some word on.

    With h that checksum, g = h div 10 and n words, word i >= a becomes word a + (i - a) mod p, where a = g mod n and
    p = 1 + (n - a) div (3 + g mod 8). Other texts, those without words and those without an id stay as they are.
    """
    d = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    d = d.withColumn("g", F.floor(h / 10)).withColumn("words", F.when(h % 10 == 0, words)).withColumn("n", F.nullif(F.size("words"), F.lit(0)))
    d = d.withColumn("a", (F.col("g") % F.col("n")).cast("int")).withColumn("rest", F.col("n") - F.col("a"))
    d = d.withColumn("p", (1 + F.floor(F.col("rest") / (3 + F.col("g") % 8))).cast("int"))
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    again = F.slice(F.flatten(F.array_repeat(period, F.ceil(F.col("rest") / F.col("p")).cast("int"))), F.lit(1), F.col("rest"))
    made = F.concat_ws(" ", F.slice("words", F.lit(1), F.col("a")), again)
    return d.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))
