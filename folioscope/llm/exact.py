"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries (Misra and Gries 1982; merged as in Agarwal et al.,
"Mergeable Summaries", PODS 2012) name the digests that could hold more than
1/(k+1) of all rows. An exact count verifies them; the at most ``k`` winners
are broadcast and settle their rows on the map side. All other digests go
through an ordinary shuffle, where no key is heavy any more.

Defined results: null text equals empty text; a null ``doc_id`` never stays
unless its whole group has none; of each group exactly one row is kept, so of
rows that repeat text and ``doc_id`` (or lack an id) one; an empty table gives
an empty result.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from folioscope.llm.common import LOWER, UPPER
from folioscope.plans.staging import stage

COUNTERS = 1024


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER).cast("binary"), 256))


def summarise(counters: dict, k: int) -> dict:
    """Shrink a Misra-Gries summary to ``k`` counters."""
    if len(counters) <= k:
        return counters
    cut = heapq.nlargest(k + 1, counters.values())[-1]
    return {x: n - cut for x, n in counters.items() if n > cut}


def heavy_candidates(digests: DataFrame, k: int) -> DataFrame:
    """Digests that may hold more than 1/(k+1) of all rows: at most ``k`` a task, then at most ``k`` in all."""

    def run(batches):
        held: dict = {}
        for pdf in batches:
            for x, n in pdf["digest"].value_counts().items():
                held[x] = held.get(x, 0) + int(n)
            held = summarise(held, k)
        yield pd.DataFrame({"digest": pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})

    part = digests.select("digest").mapInPandas(run, "digest binary, n bigint")
    return part.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(k).select("digest")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256, *carry)``, one row for every input row; the largest ``doc_id`` stays."""
    rows = df.select(F.col(id_col).cast("bigint").alias("_exact_doc"), digest(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("_exact_row"), *(F.col(c).alias("_with_" + c) for c in carry))
    rows = stage(rows, "exact")  # the row numbers are fixed from here on
    likely = F.broadcast(heavy_candidates(rows, counters))  # at most `counters` digests of 32 bytes
    answer = (F.max(F.struct("_exact_doc", "_exact_row")).alias("top"), F.count(F.lit(1)).alias("group_size"))  # a null id comes first
    winners = rows.join(likely, "digest", "left_semi").groupBy("digest").agg(*answer)
    winners = stage(winners.where(F.col("group_size") > 1), "exact-heavy")  # verified: exact counts of at most `counters` digests
    heavy = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    light = rest.join(rest.groupBy("digest").agg(*answer), "digest")
    kept = (F.col("_exact_row") == F.col("top._exact_row")).alias("kept")
    cols = [F.col("_exact_doc").alias("doc_id"), F.col("top._exact_doc").alias("keep_id"), "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"), *(F.col("_with_" + c).alias(c) for c in carry)]
    return heavy.select(*cols).unionByName(light.select(*cols))
