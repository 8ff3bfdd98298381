"""Language-model scoring on a subword lattice.

The pieces of an existing public vocabulary carry unigram probabilities, which
weight all segmentations: the lattice probability L of a word is the sum over
its segmentations into pieces of the product of the pieces' probabilities,
found by a forward recursion in log space. No piece crosses white space, so a
text's lattice probability is the product of its words' sums and the end's.

What a score means: a unigram model's scores are log probabilities and are used
as they are. The scores of a BPE model only rank its pieces (minus the merge
rank), so they are read as ranks in Zipf's law: a piece of rank r weighs
1 / (r + 10). ``END_SHARE`` of the mass is the end's.

What is learnt: words of the training documents are counted over the whole
corpus and interpolated with the lattice (Witten and Bell 1991): with N training
tokens of V kinds, the end among them, P(w) = (c(w) + V L(w)) / (N + V). So a
word that the corpus holds keeps its share, and all others share V / (N + V) by
their lattice probability. Each distinct word of the corpus is summed once.

Words travel as batch dictionaries: each slice of documents lists its distinct
words once, the words meet their corpus counts and scores in a join by word,
and the answers return to the slice, whose documents are stored as codes.

Defined results: null text counts as empty, that is as the end alone; words
hold any bytes, characters missing from the vocabulary are spelt in bytes;
without training documents the lattice alone scores; rows that repeat a
document get one row each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.common import raw, slices
from folioscope.llm.langid import crc_mod
from folioscope.plans.staging import stage

MARK = "▁"
END_SHARE = 1 / 256
SLICE, WORDS = 24_000_000, 50_000  # bytes of a slice; words of a task


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str, float], dict[int, float]]:
    """Natural log probabilities of the pieces by text, and of the byte pieces by value."""
    import sentencepiece as spm

    sp = spm.SentencePieceProcessor(model_file=path)
    use = [k for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))]
    score = np.array([sp.get_score(k) for k in use])
    if np.all(score == np.round(score)):  # ranks
        w = np.empty(len(use))
        w[np.argsort(-score, kind="stable")] = 1.0 / (np.arange(len(use)) + 10.0)
    else:
        w = np.exp(score)
    logp = np.log(w / w.sum() * (1 - END_SHARE)).tolist()
    pieces = {sp.id_to_piece(k): p for k, p in zip(use, logp, strict=True) if not sp.is_byte(k)}
    return pieces, {int(sp.id_to_piece(k)[3:5], 16): p for k, p in zip(use, logp, strict=True) if sp.is_byte(k)}


def default_vocabulary() -> str:
    import public_tokenizers as P

    return P.path("piece_bpe_32k.model")


class Lattice:
    """Forward recursion over the pieces of one word (with its leading mark)."""

    def __init__(self, path: str):
        self.logp, self.byte = vocabulary(path)
        self.longest = max(map(len, self.logp), default=1)

    def word(self, w: str) -> float:
        """Natural log of the summed probability of all segmentations."""
        s = MARK + w
        n, get, longest = len(s), self.logp.get, self.longest
        f = [0.0] * (n + 1)
        for j in range(1, n + 1):
            terms = []
            for i in range(max(0, j - longest), j):
                p = get(s[i:j])
                if p is not None:
                    terms.append(f[i] + p)
            # any character can also be spelt in bytes
            terms.append(f[j - 1] + sum(self.byte[b] for b in s[j - 1].encode("utf-8", "surrogatepass")))
            top = max(terms)
            f[j] = top + math.log(sum(math.exp(t - top) for t in terms)) if len(terms) > 1 else top
        return f[n]


def coded(df: DataFrame, id_col: str, text_col: str, held_mod: int, held_at: int) -> DataFrame:
    """One row a slice: document ids, token ends and codes, and the slice's distinct words with their training counts."""

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        for b in slices(batches, "t", SLICE):
            index: dict[bytes, int] = {}
            codes, ends, at = [], [], 0
            for text in raw(b.column(2)):
                w = text.lower().split()
                codes.append(np.fromiter((index.setdefault(x, len(index)) for x in w), np.int32, len(w)))
                at += len(w)
                ends.append(at)
            code = np.concatenate(codes) if codes else np.empty(0, np.int32)
            held = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            trained = np.repeat(~held, np.diff([0, *ends]))
            n = np.bincount(code[trained], minlength=len(index)).astype(np.int64)
            ids = pa.array([b.column(0).to_pylist()], pa.list_(pa.int64()))
            row = [pa.array([(part << 32) + k], pa.int64()), ids, *(pa.array([x.tobytes()], pa.binary()) for x in (held, np.array(ends, np.int64), code)), pa.array([int((~held).sum())], pa.int64())]
            words = pa.array([[x.decode("utf-8", "replace") for x in index]], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*row, words, pa.array([n.tolist()], pa.list_(pa.int64()))], ["slice", "ids", "held", "ends", "codes", "trained", "words", "counts"])
            k += 1

    got = df.select(F.col(id_col).cast("bigint").alias("doc_id"), (crc_mod(F.col(id_col), held_mod) == held_at).alias("h"), F.col(text_col).cast("string").alias("t"))
    return got.mapInArrow(run, "slice bigint, ids array<bigint>, held binary, ends binary, codes binary, trained bigint, words array<string>, counts array<bigint>")


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_mod: int = 7, held_at: int = 2, vocabulary_path: str | None = None) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``; scores are log10 probabilities."""
    spark, path = df.sparkSession, vocabulary_path or default_vocabulary()
    kept = stage(coded(df, id_col, text_col, held_mod, held_at), "lm-slices")
    asked = kept.select("slice", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "x")).select("slice", "code", F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    vocab = stage(asked.groupBy("word").agg(F.sum("c").alias("c")), "lm-words")
    trained, = kept.agg(F.coalesce(F.sum("trained"), F.lit(0))).first()
    tokens, kinds = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    N, V = tokens + trained, kinds + (trained > 0)  # the end is a token too
    low = math.log10(N + V + 1)
    all_kinds = vocab.count()

    def forward(batches):
        lattice = Lattice(path)
        for pdf in batches:
            log_sum = np.array([lattice.word(w) for w in pdf["word"]])
            with np.errstate(divide="ignore"):
                seen = np.log(pdf["c"].to_numpy().astype(float))
            pdf["lp"] = (np.logaddexp(seen, log_sum + math.log(V)) - math.log(N + V) if N else log_sum) / math.log(10)
            yield pdf

    end_log10 = math.log10((trained + V * END_SHARE) / (N + V) if N else END_SHARE)
    # words are dealt by number, whatever files they fall into
    dealt = vocab.repartition(max(spark.sparkContext.defaultParallelism, all_kinds // WORDS + 1), "word")
    answers = asked.select("slice", "code", "word").join(dealt.mapInPandas(forward, "word string, c bigint, lp double"), "word").select("slice", "code", "c", "lp")

    def sums(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        c, lp = np.zeros(len(right), np.int64), np.zeros(len(right))
        at = right["code"].to_numpy()
        c[at], lp[at] = right["c"].to_numpy(), right["lp"].to_numpy()
        out = []
        for ids, held, ends, codes in zip(left["ids"], left["held"], left["ends"], left["codes"], strict=True):
            code, stop = np.frombuffer(codes, np.int32), np.frombuffer(ends, np.int64)
            start = np.append(0, stop)[:-1]

            def total(x):
                run = np.append(np.zeros(1, x.dtype), np.cumsum(x))
                return run[stop] - run[start]

            base = np.log10(c + 1.0) - low
            size = stop - start
            out.append(pd.DataFrame({"doc_id": pd.array(list(ids), "Int64"), "held_out": np.frombuffer(held, bool), "n_tokens": size + 1, "n_known": total((c[code] > 0).astype(np.int64)) + int(trained > 0), "train_tokens": int(N), "base_score": total(base[code]) + math.log10(trained + 1) - low, "score": total(lp[code]) + end_log10}))
        return pd.concat(out)

    left = kept.select(F.col("slice").alias("at"), "ids", "held", "ends", "codes").groupBy("at")
    return left.cogroup(answers.groupBy("slice")).applyInPandas(sums, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
