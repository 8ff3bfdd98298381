"""BPE encoding and decoding through a table of distinct words.

The tokenizer's words end at white space, so a text's ids are its words' ids in
order. Spark splits the texts into words by slices (about SLICE bytes of text):
a slice lists its distinct words once and stores its documents as word numbers.
The lists travel in packets, one for each slice and hash bucket of words, so
that all slices' copies of a word meet in one task, where the library encodes
each distinct word once. The ids go back to the slice in a join by slice and
position, and replace the word numbers there. Decoding joins ids to pieces: the
id is the piece's row in the vocabulary's table, whose size is the vocabulary's.

A frequent word comes at most once a slice. A task forgets encoded words beyond
KNOWN of them and encodes them again where they come back, which costs time only.

Defined results: null text counts as empty, that is no ids and the empty text;
special tokens' strings inside texts are encoded as the library does (as special
tokens); rows that repeat a document or lack an id get one row each; an empty
table gives an empty result; other columns are left out, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.common import raw, runs, slices

SLICE, KNOWN, LOT = 8_000_000, 200_000, 5_000  # bytes of a slice; encoded words that a task remembers; words that the library encodes at once
IDS = 1_000_000  # ids that are decoded at once
PACKET = "slice bigint, bucket int, ids array<bigint>, ends binary, codes binary, buckets binary, words binary"


def default_tokenizer() -> str:
    """The lower-case word BPE of 49,408 entries."""
    import public_tokenizers as P

    return P.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def packed(x: np.ndarray) -> bytes:
    """Numbers below 2**32 by byte planes, compressed."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def numbered(code: np.ndarray) -> np.ndarray:
    """Word numbers, of which a word's first is the next free one, with all first ones as 0: they are many and otherwise the longest."""
    new = np.diff(np.maximum.accumulate(code), prepend=-1) > 0
    return np.where(new, 0, code + 1)


def unnumbered(x: np.ndarray) -> np.ndarray:
    return np.where(x == 0, np.cumsum(x == 0) - 1, x - 1)


def packets(df: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """For each slice its documents as word numbers, and a list of distinct words for each bucket; all dealt to ``buckets``."""

    def run(batches):
        import zstandard

        part, k = TaskContext.get().partitionId(), 0
        for b in slices(batches, "t", SLICE):
            index: dict[bytes, int] = {}
            codes, ends, at = [], [], 0
            for text in raw(b.column(1)):
                w = text.split()
                codes.append(np.fromiter((index.setdefault(x, len(index)) for x in w), np.int32, len(w)))
                at += len(w)
                ends.append(at)
            words, no = list(index), (part << 32) + k
            of = np.fromiter((zlib.crc32(x) % buckets for x in words), np.int64, len(words))
            order = np.argsort(of, kind="stable")
            used, first = np.unique(of[order], return_index=True)
            lists = [zstandard.compress(b"\n".join([words[i] for i in part_.tolist()]), 3) for part_ in np.split(order, first[1:])] if len(words) else []
            n = len(lists)
            ids = pa.array([b.column(0).to_pylist(), *[None] * n], pa.list_(pa.int64()))
            binary = lambda head, rest: pa.array([head, *rest], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([no] * (n + 1), pa.int64()), pa.array([(part + k) % buckets, *used.tolist()], pa.int32()), ids, binary(packed(np.array(ends)), [None] * n),
                    binary(packed(numbered(np.concatenate(codes))), [None] * n), binary(packed(of), [None] * n), binary(None, lists),
                ],
                ["slice", "bucket", "ids", "ends", "codes", "buckets", "words"],
            )
            k += 1

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, PACKET)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """``(doc_id, ids array<int>)``, one row for every input row. The tokenizer must drop white space between words."""
    path = tokenizer_path or default_tokenizer()
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def each_word_once(batches):
        """Word lists become ids and how many each word has; documents pass."""
        import zstandard

        tok, known = tokenizer(path), {}
        for b in batches:
            ids, sizes = [], []
            for data in b.column("words").to_pylist():
                words = zstandard.decompress(data).split(b"\n") if data is not None else []
                if len(known) > KNOWN:
                    known = {}
                new = [w for w in words if w not in known]
                for at in range(0, len(new), LOT):
                    some = new[at : at + LOT]
                    for w, e in zip(some, tok.encode_batch([w.decode("utf-8", "replace") for w in some], add_special_tokens=False), strict=True):
                        known[w] = np.array(e.ids, "<u4").tobytes()
                got = [known[w] for w in words]
                sizes.append(packed(np.fromiter(map(len, got), np.int64, len(got)) // 4))
                ids.append(packed(np.frombuffer(b"".join(got), "<u4")))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], [*b.schema.names[:-1], "sizes", "got"])

    met = packets(df, id_col, text_col, buckets).repartition(buckets, "bucket").mapInArrow(each_word_once, PACKET.replace("words binary", "sizes binary, got binary"))

    def put_back(rows: pa.Table) -> pa.Table:
        heads = rows["codes"].is_valid()
        row, lists = rows.filter(heads).to_pylist()[0], rows.filter(pa.compute.invert(heads)).sort_by("bucket")
        empty = np.empty(0, np.int64)
        sizes = np.concatenate([empty, *map(unpacked, lists["sizes"].to_pylist())])
        got = np.concatenate([empty, *map(unpacked, lists["got"].to_pylist())])
        code, stop = unnumbered(unpacked(row["codes"])), unpacked(row["ends"])
        order = np.argsort(unpacked(row["buckets"]), kind="stable")  # position in the lists -> word number
        size, start = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        size[order], start[order] = sizes, np.cumsum(sizes) - sizes
        n = size[code]
        ends = np.append(0, np.cumsum(n))
        flat = got[np.repeat(start[code] - ends[:-1], n) + np.arange(ends[-1])]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends[stop]), pa.int32()), pa.array(flat, pa.int32()))
        return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "ids": lists})

    return met.groupBy("slice").applyInArrow(put_back, "doc_id bigint, ids array<int>")


@lru_cache(maxsize=2)
def pieces(path: str) -> pa.Array:
    """The vocabulary's pieces by id; null where an id is free."""
    t = tokenizer(path)
    return pa.array([t.id_to_token(k) for k in range(max(t.get_vocab(with_added_tokens=True).values()) + 1)], pa.string())


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", tokenizer_path: str | None = None) -> DataFrame:
    """``df`` with the text of its ids: the pieces joined by one blank, as of a tokenizer without a decoder of its own.

    Ids that the vocabulary lacks are left out, as the library leaves them out; null ids give null.
    """
    path = tokenizer_path or default_tokenizer()
    if tokenizer(path).decoder is not None:
        raise ValueError("only tokenizers without a decoder are decoded here")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != out_col)
    rest = [c for c in df.columns if c != out_col]

    def join(batches):
        table = pieces(path)
        for whole in batches:
            sizes = pa.compute.fill_null(pa.compute.list_value_length(whole.column(ids_col)), 0).to_numpy(zero_copy_only=False)
            lots = np.cumsum(sizes) // IDS  # some IDS ids at a time, or one longer list
            cut = runs(lots).tolist()
            for x, y in zip(cut, cut[1:], strict=False):
                b = whole.slice(x, y - x)
                lists = b.column(ids_col)
                flat, ends = lists.flatten(), np.append(0, np.cumsum(sizes[x:y]))
                known = pa.compute.and_(pa.compute.greater_equal(flat, 0), pa.compute.less(flat, len(table)))
                got = table.take(pa.compute.if_else(known, flat, None))
                if got.null_count:
                    there = got.is_valid().to_numpy(zero_copy_only=False)
                    ends, got = np.append(0, np.cumsum(there))[ends], got.drop_null()
                texts = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), got), " ")
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.compute.if_else(lists.is_valid(), texts, None)], [*rest, out_col])

    return df.select(*rest).mapInArrow(join, f"{kinds}, `{out_col}` string")
