"""Language identification by compression.

For each language DOCS_PER_LANGUAGE training documents are chosen by a hash.
Their whole texts, long ones too, are cut into chunks, and as many chunks, again
by a hash, as DICT_BYTES hold are the raw content of a zstandard dictionary. A text is cut into blocks that are each
compressed with every dictionary; the language with the smallest sum wins, and
a text whose two smallest sums are too close is rejected.

Defined results: null texts and texts without a letter are ``und`` with score 0
and are rejected; equal sums go to the language that comes first by code point
and are rejected; without training documents everything is ``und``; an empty
table gives an empty result; rows that repeat a document get one row each.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscope.llm.common import slices, unused

DOCS_PER_LANGUAGE, DICT_BYTES, BLOCK, CHUNK, LEVEL = 256, 65_536, 1024, 512, 6
NARROW = 0.02
#: ASCII characters other than letters carry no language: all become blanks.
PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; a null id counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(PLAIN).split())


def chunks(text: str) -> list[tuple[int, bytes]]:
    """Chunks of a text with their hashes, the smallest hashes first and no more than a dictionary holds."""
    b = normal(text)
    cut = {b[k : k + CHUNK] for k in range(0, len(b), CHUNK)}
    return heapq.nsmallest(DICT_BYTES // CHUNK, ((xxhash.xxh64_intdigest(x) >> 1, x) for x in cut))


def dictionaries(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, bytes]:
    """Raw dictionary content by language, from chunks of at most DOCS_PER_LANGUAGE documents."""
    ok = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang"))
    ok = ok.where("lang is not null and t <> ''").withColumn("h", F.xxhash64("id", "t"))
    # a hash threshold by language keeps the ranking small however many tasks feed it; there are as many counts as dictionaries
    n = ok.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = (F.col("h") / F.lit(float(1 << 63)) + 1) / 2
    few = ok.select("lang", "h").join(F.broadcast(n), "lang").where(share * F.col("n") <= 4.0 * DOCS_PER_LANGUAGE).select("lang", "h")
    some = few.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("k") <= DOCS_PER_LANGUAGE).select("lang", "h").distinct()
    rows = ok.join(F.broadcast(some), ["lang", "h"]).select("lang", "t")  # ids of at most DOCS_PER_LANGUAGE documents a language

    def cut(batches):
        for pdf in batches:
            out = [(lang, h, x) for lang, t in zip(pdf["lang"], pdf["t"], strict=True) for h, x in chunks(t)]
            yield pd.DataFrame(out, columns=["lang", "h", "x"])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        held, room = [], DICT_BYTES
        for x in dict.fromkeys(pdf.sort_values(["h", "x"])["x"]):
            if len(x) < room:
                held.append(x)
                room -= len(x) + 1
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "d": [b" ".join(held)]})

    pieces = rows.mapInPandas(cut, "lang string, h bigint, x binary")
    return {r["lang"]: bytes(r["d"]) for r in pieces.groupBy("lang").applyInPandas(fill, "lang string, d binary").collect()}


@lru_cache(maxsize=64)
def compressor(content: bytes):
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=BLOCK, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)


def sizes(text: str, contents: list[bytes]) -> np.ndarray:
    b = normal(text)
    blocks = [b[k : k + BLOCK] for k in range(0, len(b), BLOCK)] or [b""]
    return np.array([sum(len(compressor(c).compress(x)) for x in blocks) for c in contents], np.int64)


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", narrow: float = NARROW) -> DataFrame:
    """``docs`` with ``lang_pred, score, accepted``; columns of ``docs`` with these names are replaced."""
    found = {k: v for k, v in dictionaries(train, id_col, text_col, lang_col).items() if v}
    names = sorted(found)
    contents = [found[k] for k in names]

    name = unused(docs.columns, "_text")

    def run(batches):
        for b in slices(batches, name):
            out = []
            for text in b.column(b.schema.get_field_index(name)).to_pylist():
                if not names or not text or not any(map(str.isalpha, text)):
                    out.append(("und", 0.0, False))
                    continue
                s = sizes(text, contents)
                best = int(s.argmin())
                near = float(np.partition(s, 1)[1] - s[best]) if len(s) > 1 else float(s[best])
                p = 1.0 / float(np.exp(-np.minimum(s - s[best], 700) * 0.7).sum())
                out.append((names[best], p, near > max(1.0, narrow * float(s[best]))))
            keep = [n for n in b.schema.names if n != name]
            new = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in keep] + new, [*keep, "lang_pred", "score", "accepted"])

    kept = docs.drop("lang_pred", "score", "accepted")
    schema = kept.limit(0).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).withColumn("accepted", F.lit(True)).schema
    return kept.withColumn(name, F.col(text_col).cast("string")).mapInArrow(run, schema)
