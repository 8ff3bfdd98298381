"""Alignment of two tokenizers' ids over the same texts, and counts of the pairs they form.

Both tokenizers spell the text with one blank before it. Byte offsets where a
token of each ends cut their tokens into groups; an occurrence of an A token
and one of a B token link where they share a group. The token lengths' running
sums are the ends, their intersection the cuts, a binary search for a token's
end among the cuts is its group, and each A token repeated by the B tokens of
its group makes the links.

A single blank between other characters begins a token of both sides, so texts
split there, and a slice of documents (about SLICE bytes of text) aligns each
distinct part once; documents are lists of parts. Per slice the distinct id
pairs carry the number of documents that hold them. A pair comes at most once
a slice; its counts are summed in two shuffles, first by pair and salt, then by
pair, and the totals, with a mark for those that reach the highest total of
their A id, go back to the slices. The highest totals are broadcast: one row
an id of A's vocabulary at most.

Defined results: null and empty texts, and texts that one of the tokenizers
does not spell byte by byte (a B that writes U+2581 for blanks cannot tell the
two apart), have no tokens: zeros and ''. Special tokens' strings are ordinary
text. Rows that repeat a document count as documents of their own; those
without an id get a row like any other; an empty table gives an empty result;
other columns are left out, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.bpe import packed, unpacked
from folioscope.llm.common import slices
from folioscope.plans.staging import stage

SLICE, PARTS, LINKS, SALTS = 8_000_000, 30_000, 1_000_000, 16  # bytes of a slice; parts and links that are held at once; salts of a pair's counts
SPLIT = re.compile(r"(?<=\S) (?=\S)")
PLAIN = re.compile(r"[\x00-ɏ]*").fullmatch  # characters whose classes no version of Unicode in use disagrees about
B_SHIFT = 20  # bits of a pair's B id


def default_tokenizers() -> tuple[str, str, str]:
    """Byte-level BPE (JSON, and its ranks) and the sentence-piece model."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``start[0], start[0] + 1, ... (n[0] of them), start[1], ...``"""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


@lru_cache(maxsize=2)
def side_a(json_path: str, ranks_path: str):
    """A function from parts to ids, and each id's byte length."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(x): int(k) for x, k in map(bytes.split, f)}
    quick = tiktoken.Encoding("byte_bpe", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(json_path)
    exact.encode_special_tokens = True
    exact.no_truncation()
    exact.no_padding()
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    size[list(ranks.values())] = [len(x) for x in ranks]

    def encode(parts: list[str], n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All parts' ids behind one another, and how many each has. Parts without blanks at their ends are read as one text."""
        quickly = np.array([PLAIN(p) is not None and p == p.strip() for p in parts], bool)
        one = quick.encode_to_numpy("".join([" " + p for p, q in zip(parts, quickly.tolist(), strict=True) if q])).astype(np.int64)
        ends = np.searchsorted(np.cumsum(size[one]), np.cumsum(n_bytes[quickly])) + 1
        rest = [quick.encode(" " + p) if PLAIN(p) else exact.encode(" " + p, add_special_tokens=False).ids for p, q in zip(parts, quickly.tolist(), strict=True) if not q]
        n = np.empty(len(parts), np.int64)
        n[quickly], n[~quickly] = np.diff(ends, prepend=0), [len(x) for x in rest]
        ids = np.concatenate([one, np.fromiter((i for x in rest for i in x), np.int64, int(n[~quickly].sum()))])
        start = np.empty(len(parts), np.int64)
        for some, first in ((quickly, 0), (~quickly, len(one))):
            start[some] = first + np.cumsum(n[some]) - n[some]
        return ids[spread(start, n)], n

    return encode, size


@lru_cache(maxsize=2)
def side_b(model_path: str):
    """The model, each id's bytes, and whether a blank always begins a piece."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    names = [sp.id_to_piece(k) for k in range(sp.get_piece_size())]
    spelt = [bytes([int(x[3:5], 16)]) if sp.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(names)]
    return sp, spelt, all("▁" not in x.lstrip("▁") for x in names)


@lru_cache(maxsize=1)
def names(n: int) -> np.ndarray:
    """Ids below ``n`` in decimals with a comma, a bar or a semicolon behind: three a number."""
    return np.array([f"{k}{x}" for k in range(n) for x in ",|;"], object)


def in_order(parts: list[str], paths: tuple[str, str, str]) -> dict:
    """For each part: whether both sides spell it, its token and group counts, its groups as text, its number of links, and all links as pairs."""
    (encode, size_a), (sp, spelt, _) = side_a(*paths[:2]), side_b(paths[2])
    whole = [(" " + p).encode() for p in parts]
    n_bytes = np.array([len(w) for w in whole], np.int64)
    a, n_a = encode(parts, n_bytes)
    ids_b = sp.encode(parts, num_threads=1)
    n_b = np.array([len(x) for x in ids_b], np.int64)
    b = np.fromiter((i for y in ids_b for i in y), np.int64, int(n_b.sum()))
    size_b = np.array([len(x) for x in spelt])
    each = lambda x, n: np.diff(np.append(0, np.cumsum(x))[np.append(0, np.cumsum(n))])
    ok = (each(size_a[a], n_a) == n_bytes) & (each(size_b[b], n_b) == n_bytes)
    if not ok.all() or b"".join([spelt[i] for i in b.tolist()]) != b"".join(whole):
        ok &= np.array([b"".join([spelt[i] for i in y]) == w for y, w in zip(ids_b, whole, strict=True)], bool)
        a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
        n_a, n_b, n_bytes = n_a * ok, n_b * ok, n_bytes * ok
    # all parts behind one another: a part's end is an end of both sides
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    a_of, b_of = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
    first_b = np.cumsum(b_of) - b_of
    groups = np.diff(np.searchsorted(cuts, np.cumsum(n_bytes), side="right"), prepend=0)
    # a group's A tokens, a bar, its B tokens, a semicolon
    text = np.empty(len(a) + len(b), np.int64)
    text[np.arange(len(a)) + first_b[group_a]] = 3 * a + (np.diff(group_a, append=-1) != 0)
    text[np.arange(len(b)) + np.cumsum(a_of)[group_b]] = 3 * b + 2 * (np.diff(group_b, append=-1) != 0)
    shown, ends = names(max(len(size_a), len(size_b)))[text].tolist(), np.cumsum(n_a + n_b).tolist()
    shown = ["".join(shown[x:y])[:-1] for x, y in zip([0, *ends], ends, strict=False)]
    # each A token once for each B token of its group
    per_a = b_of[group_a]
    pair = np.empty(int(per_a.sum()), np.int64)
    done, cut = 0, np.append(np.searchsorted(np.cumsum(per_a), np.arange(0, len(pair), LINKS), side="left"), len(a))
    for x, y in zip(cut, cut[1:], strict=False):
        n = per_a[x:y]
        pair[done : done + int(n.sum())] = np.repeat(a[x:y], n) << B_SHIFT | b[spread(first_b[group_a[x:y]], n)]
        done += int(n.sum())
    return {"ok": ok, "n_a": n_a, "n_b": n_b, "groups": groups, "shown": shown, "links": each(per_a, n_a), "pair": pair}


def aligned_parts(parts: list[str], paths: tuple[str, str, str]) -> dict:
    """``in_order`` of all parts, PARTS of them at a time."""
    some = [in_order(parts[at : at + PARTS], paths) for at in range(0, max(1, len(parts)), PARTS)]
    return {c: [x for g in some for x in g[c]] if c == "shown" else np.concatenate([g[c] for g in some]) for c in some[0]}


def aligned_slices(df: DataFrame, id_col: str, text_col: str, paths: tuple[str, str, str]) -> DataFrame:
    """One row a slice: its documents' figures, their distinct pairs as numbers with how often they link, and the slice's pairs with the documents that hold them."""

    def run(batches):
        task, k = TaskContext.get().partitionId(), 0
        splits = side_b(paths[2])[2]
        for batch in slices(batches, "t", SLICE):
            index: dict[str, int] = {}
            code, count = [], []
            for t in batch.column(1).to_pylist():
                p = (SPLIT.split(t) if splits else [t]) if t else []
                code += [index.setdefault(x, len(index)) for x in p]
                count.append(len(p))
            got = aligned_parts(list(index), paths)
            code, count = np.array(code, np.int64), np.array(count, np.int64)
            doc = np.repeat(np.arange(len(count)), count)
            bad = np.zeros(len(count), bool)
            bad[doc[~got["ok"][code]]] = True
            good = ~bad[doc]
            code, doc = code[good], doc[good]
            total = lambda x: np.bincount(doc, x[code], len(count)).astype(np.int64)
            shown, at, hashes = got["shown"], 0, []
            for n in np.bincount(doc, minlength=len(count)).tolist():
                hashes.append(hashlib.sha256(";".join([shown[c] for c in code[at : at + n].tolist()]).encode()).hexdigest() if n else "")
                at += n
            pairs, number = np.unique(got["pair"], return_inverse=True)
            start = np.cumsum(got["links"]) - got["links"]
            held, ends, times, row = [], [0], [], np.append(0, np.cumsum(np.bincount(doc, minlength=len(count))))
            in_slice = np.zeros(len(pairs), np.int64)
            for x, y in blocks(total(got["links"])):
                own = code[row[x] : row[y]]
                n = got["links"][own]
                links = number[spread(start[own], n)] | np.repeat(doc[row[x] : row[y]], n) << 32
                one, often = np.unique(links, return_counts=True)
                held.append(one & 0xFFFFFFFF)
                times.append(often)
                ends += (ends[-1] + np.cumsum(np.bincount((one >> 32) - x, minlength=y - x))).tolist()
                in_slice += np.bincount(held[-1], minlength=len(pairs))
            there = np.flatnonzero(in_slice)  # parts of documents without tokens leave no pair
            renumber = np.cumsum(in_slice > 0) - 1
            held, times = renumber[np.concatenate([np.empty(0, np.int64), *held]).astype(np.int64)], np.concatenate([np.empty(0, np.int64), *times])
            figures = (total(got[c]) for c in ("n_a", "n_b", "groups", "links"))
            lists = [batch.column(0).to_pylist(), *(x.tolist() for x in figures), hashes]
            kinds = [pa.int64()] * 5 + [pa.string()]
            out = [pa.array([(task << 32) + k], pa.int64()), *(pa.array([x], pa.list_(t)) for x, t in zip(lists, kinds, strict=True))]
            out += [pa.array([packed(np.asarray(x))], pa.binary()) for x in (ends, held, times)]
            out += [pa.ListArray.from_arrays(pa.array([0, len(there)], pa.int32()), pa.array(x, pa.int64())) for x in (pairs[there], in_slice[there])]
            yield pa.RecordBatch.from_arrays(out, SLICE_COLUMNS)
            k += 1

    got = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return got.mapInArrow(run, SLICE_SCHEMA)


SLICE_COLUMNS = ["slice", "ids", "n_a", "n_b", "n_groups", "n_links", "hashes", "ends", "held", "times", "pairs", "docs"]
SLICE_SCHEMA = (
    "slice bigint, ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, hashes array<string>, "
    "ends binary, held binary, times binary, pairs array<bigint>, docs array<bigint>"
)


def blocks(n: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of documents with about LINKS links each."""
    cut, at = [0], 0
    run = np.cumsum(n)
    while at < len(n):
        at = max(at + 1, int(np.searchsorted(run, (run[at - 1] if at else 0) + LINKS, side="right")))
        cut.append(at)
    return list(zip(cut, cut[1:], strict=False))


def pair_counts(kept: DataFrame) -> DataFrame:
    """``(pair, n, best)``: the documents of all slices that hold the pair, and whether no pair of the same A id has more."""
    pairs = kept.select("slice", F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select("slice", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("n"))
    salted = pairs.groupBy("pair", F.pmod(F.xxhash64("slice"), F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    counts = stage(salted.groupBy("pair").agg(F.sum("n").alias("n")), "align-pairs")
    a = F.shiftright("pair", B_SHIFT)
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str, str] | None = None) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, one row for every input row."""
    kept = stage(aligned_slices(df, id_col, text_col, paths or default_tokenizers()), "align-slices")
    asked = kept.select("slice", F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(pair_counts(kept), "pair").select("slice", "at", "n", "best")

    def put_back(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        n, best = np.zeros(len(right), np.int64), np.zeros(len(right), np.int64)
        at = right["at"].to_numpy()
        n[at], best[at] = right["n"].to_numpy(), right["best"].to_numpy()
        row = left.iloc[0]
        ends, held, times = (unpacked(row[c]) for c in ("ends", "held", "times"))

        def total(x):
            run = np.append(0, np.cumsum(x[held] * times))
            return run[ends[1:]] - run[ends[:-1]]

        return pd.DataFrame(
            {
                "doc_id": pd.array(list(row["ids"]), "Int64"), "n_a": row["n_a"], "n_b": row["n_b"], "n_groups": row["n_groups"], "n_links": row["n_links"],
                "n_best": total(best), "count_sum": total(n), "groups_sha256": row["hashes"],
            }
        )

    docs = kept.withColumnRenamed("slice", "of").drop("pairs", "docs")
    out = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return docs.groupBy("of").cogroup(answers.groupBy("slice")).applyInPandas(put_back, out)
