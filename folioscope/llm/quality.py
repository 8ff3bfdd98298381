"""Quality classifier on supervised subword embeddings.

Words and character n-grams of three to five characters (within a word and its
blanks) hash to a table of vectors; a document is the average of its vectors
and a softmax layer scores it (Joulin et al., "Bag of Tricks for Efficient
Text Classification", 2016). Pairs of neighbouring words hash to it as well.
numpy stochastic gradient descent trains vectors and layer on at most
``TRAIN_PER_CLASS`` labelled documents a class, the first in a fixed hash
order; whole texts are used. What reaches the driver is the distinct features
of those documents with their shares, 8 bytes each and at most 2 MB a document.

With a linear output, the score of a text is an average of one number a
feature, so scoring needs one table of 2^18 numbers a task.

Defined results: null text scores as empty text, from the output layer's bias
alone; labels other than 0 and 1 are left out, and so are those of a document
that is given both; with a single class or no labels
the score is the share of label 1 (0.5 without labels); rows that repeat a
document get one row each; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.common import raw, slices
from folioscope.plans.staging import stage

TRAIN_PER_CLASS, BITS, DIM, EPOCHS, RATE, LEAST_STEPS = 2500, 18, 12, 4, 0.5, 6000
GRAMS = (3, 4, 5)
PIECE = 1 << 19
MULT = 0x9E3779B97F4A7C15
M64 = (1 << 64) - 1
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling multiplier and of its inverse modulo 2^64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 2 * PIECE)
        for name, base in (("up", MULT), ("down", pow(MULT, -1, 1 << 64))):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt * 0xD6E8FEB86659FD93 & M64)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - BITS)).astype(np.int32)


def cut_long(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Pieces of at most about PIECE bytes, cut at blanks where there are any, and the text each belongs to."""
    parts, owner = [], []
    for k, t in enumerate(texts):
        at = 0
        while len(t) - at > PIECE:
            to = at + PIECE
            while to < len(t) and not SPACE[t[to]] and to < at + 2 * PIECE:
                to += 1
            parts.append(t[at:to])
            owner.append(k)
            at = to
        parts.append(t[at:])
        owner.append(k)
    return parts, np.array(owner, np.int64)


def features(parts: list[bytes]):
    """Yield (buckets, the part each feature belongs to) for each kind of feature; parts ascend."""
    buf = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    up, down = powers(len(buf) + 1)
    blank = SPACE[buf]
    val = np.where(blank, 32, buf).astype(np.uint64)
    pre = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(val * up[: len(buf)], out=pre[1:])
    ends = np.cumsum([len(p) + 1 for p in parts])  # a part owns the bytes after the blank before it
    word = ~blank
    first = np.flatnonzero(word & ~np.append(False, word[:-1]))
    last = np.flatnonzero(word & ~np.append(word[1:], False)) + 1
    h = (pre[last] - pre[first]) * down[first]
    own = np.searchsorted(ends, first, "left")
    yield bucket(h, 1), own
    next_ = np.flatnonzero(own[1:] == own[:-1]) + 1
    yield bucket(h[next_ - 1] * np.uint64(MULT) + h[next_], 2), own[next_]
    start = np.flatnonzero((buf & 0xC0) != 0x80)
    sp = blank[start]
    inner = np.append(0, np.cumsum(sp))
    at = np.append(start, len(buf))
    for n in GRAMS:
        if len(start) < n:
            continue
        k = np.flatnonzero(inner[n - 1 :][: len(start) - n + 1] == inner[1 : len(start) - n + 2])
        s, e = start[k], at[k + n]
        yield bucket((pre[e] - pre[s]) * down[s], n), np.minimum(np.searchsorted(ends, s, "right"), len(parts) - 1)


def grouped(texts: list[bytes]):
    """Yield (indexes, pieces) with a bounded number of bytes each."""
    parts, owner = cut_long(texts)
    at, n = 0, 0
    for k, p in enumerate(parts):
        if n and n + len(p) > PIECE:
            yield owner[at:k], parts[at:k]
            at, n = k, 0
        n += len(p) + 1
    if parts:
        yield owner[at:], parts[at:]


def bags(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their shares, for each text."""
    held: list[list[np.ndarray]] = [[] for _ in texts]
    for owner, parts in grouped(texts):
        for b, own in features(parts):
            cut = np.searchsorted(own, np.arange(len(parts) + 1))
            for k in range(len(parts)):
                held[owner[k]].append(b[cut[k] : cut[k + 1]])
    out = []
    for x in held:
        b, n = np.unique(np.concatenate(x) if x else np.empty(0, np.int32), return_counts=True)
        out.append((b, (n / max(1, n.sum())).astype(np.float32)))
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, share: float, seed: int = 7) -> tuple[np.ndarray, float]:
    """One number a bucket and a bias, so that sigmoid(average + bias) scores a text."""
    prior = float(np.log(share / (1 - share))) if 0 < share < 1 else 0.0
    if len(set(y.tolist())) < 2:
        return np.zeros(1 << BITS, np.float32), prior if 0 < share < 1 else (np.inf if share >= 1 else -np.inf) if len(y) else 0.0
    rng = np.random.default_rng(seed)
    vec = rng.uniform(-1, 1, (1 << BITS, DIM)).astype(np.float32) / DIM
    out = np.zeros((2, DIM), np.float32)
    bias = np.zeros(2, np.float32)
    steps = max(EPOCHS * len(rows), LEAST_STEPS)
    of = [np.flatnonzero(y == c) for c in (0, 1)]
    # both classes in turn, each through its own documents in random order
    turns = [np.concatenate([rng.permutation(k) for _ in range(-(-steps // (2 * len(k))))]) for k in of]
    for step in range(steps):
        k = turns[step % 2][step // 2]
        b, w = rows[k]
        rate = RATE * (1 - step / steps)
        hid = w @ vec[b] if len(b) else np.zeros(DIM, np.float32)
        z = out @ hid + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y[k]] -= 1
        back = out.T @ p
        out -= rate * np.outer(p, hid)
        bias -= rate * p
        if len(b):
            vec[b] -= (rate / max(float(w @ w), 1e-4)) * 0.1 * np.outer(w, back)
    return vec @ (out[1] - out[0]), float(bias[1] - bias[0]) + prior


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int = TRAIN_PER_CLASS) -> tuple[np.ndarray, float]:
    """Train on at most ``per_class`` documents of each label; ``labels`` holds the rows that may be learnt from."""
    lab = labels.select(F.col(id_col).cast("bigint").alias("k"), F.col(label_col).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    lab = lab.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("k", "y")
    n = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pick = [lab.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(per_class) for y in (0, 1)]
    some = pick[0].unionByName(pick[1])

    def count(batches):
        for b in slices(batches, "t", 1_000_000):
            got = bags(raw(b.column(2)))
            cols = [b.column(0), b.column(1), pa.array([x.astype("<u4").tobytes() for x, _ in got], pa.binary()), pa.array([w.astype("<f4").tobytes() for _, w in got], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["k", "y", "b", "w"])

    text = docs.select(F.col(id_col).cast("bigint").alias("k"), F.col(text_col).cast("string").alias("t"))
    rows = text.join(F.broadcast(some), "k").select("k", "y", "t").mapInArrow(count, "k bigint, y int, b binary, w binary")  # 2 * per_class ids
    got = list(stage(rows, "quality-bags").orderBy(F.xxhash64("k"), "k", "b").toLocalIterator())
    total = sum(n.values())
    share = n.get(1, 0) / total if total else 0.5
    return train([(np.frombuffer(r["b"], "<u4"), np.frombuffer(r["w"], "<f4")) for r in got], np.array([r["y"] for r in got], np.int64), share)


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)``, one row for every input row."""
    table, bias = model
    table = table.astype(np.float32)

    def run(batches):
        for b in slices(batches, "t"):
            texts = raw(b.column(1))
            total, n = np.zeros(len(texts)), np.zeros(len(texts))
            for owner, parts in grouped(texts):
                for k, own in features(parts):
                    cut = np.searchsorted(own, np.arange(len(parts) + 1))
                    run_ = np.append(0.0, np.cumsum(table[k], dtype=np.float64))
                    np.add.at(total, owner, run_[cut[1:]] - run_[cut[:-1]])
                    np.add.at(n, owner, cut[1:] - cut[:-1])
            with np.errstate(over="ignore"):
                s = 1 / (1 + np.exp(-(np.where(n > 0, total / np.maximum(n, 1), 0.0) + bias)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id bigint, score double")
