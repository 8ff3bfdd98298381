"""Entries merged into others: what becomes of their aliases, mentions and revisions.

All merges of a glossary run together, as joins; no table is gone through by
entry. A pair of an entry with itself, or with one that does not exist, merges
nothing. Of several winners of one loser the smallest counts; an entry that is
to be both winner and loser is kept and its own losers are merged into it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioscope.operators import tables


def agreed(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """The pairs ``(winner_id, loser_id)`` that merge something, one a loser."""
    p = pairs.where("winner_id <> loser_id").groupBy("loser_id").agg(F.min("winner_id").alias("winner_id"))
    ids = entries.select(F.col("id").alias("_id"))
    for side in ("winner_id", "loser_id"):
        p = p.join(ids, F.col(side) == F.col("_id"), "left_semi")
    return p.join(p.select(F.col("winner_id").alias("_w")), F.col("loser_id") == F.col("_w"), "left_anti").select("winner_id", "loser_id")


def gained(entries: DataFrame, aliases: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(entry_id, side, text)``: terms and aliases of the losers that their winner does not have on that side."""
    words = lambda e: e.select("id", F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source_term").alias("text")), F.struct(F.lit("target").alias("side"), F.col("target_term").alias("text")))).alias("x")).select("id", "x.side", "x.text").where("text <> ''")
    every = words(entries).unionByName(aliases.select(F.col("entry_id").alias("id"), "side", "text").where("text is not null"))
    new = pairs.join(every, F.col("loser_id") == F.col("id")).select(F.col("winner_id").alias("entry_id"), "side", "text").distinct()
    own = every.select(F.col("id").alias("_e"), F.col("side").alias("_s"), F.col("text").alias("_t"))
    return new.join(own, (F.col("entry_id") == F.col("_e")) & (F.col("side") == F.col("_s")) & (F.col("text") == F.col("_t")), "left_anti")


def merged(entries: DataFrame, aliases: DataFrame, mentions: DataFrame, revisions: DataFrame, pairs: DataFrame, now: int, reason: str = "merge") -> dict[str, DataFrame]:
    """The four tables after the merges.

    Losers go with their aliases and revisions, their mentions become the
    winner's. A winner gets their words as aliases, one revision that leaves
    its target as it is, and a new date. Ids of new rows derive from what they hold.
    """
    p = agreed(pairs, entries)
    new = gained(entries, aliases, p).withColumn("id", F.left(F.sha2(F.concat_ws("\u0001", "entry_id", "side", "text"), 256), F.lit(32)))
    winners = p.select(F.col("winner_id").alias("_w")).distinct()
    touched = entries.join(winners, F.col("id") == F.col("_w"), "left")
    log = touched.where("_w is not null").select(
        F.left(F.sha2(F.concat_ws("\u0001", "id", F.lit(reason), F.lit(str(now))), 256), F.lit(32)).alias("id"), F.col("id").alias("entry_id"),
        F.col("target_term").alias("prev_target_term"), F.col("target_term").alias("new_target_term"), F.lit(reason).alias("reason"), F.lit(now).cast("bigint").alias("created_at"),
    )
    kept = touched.withColumn("updated_at", F.when(F.col("_w").isNotNull(), F.lit(now).cast("bigint")).otherwise(F.col("updated_at"))).select(*entries.columns)
    return {
        "entries": tables.delete(kept, p, "id", "loser_id"),
        "aliases": tables.delete(aliases, p, "entry_id", "loser_id").unionByName(new, allowMissingColumns=True),
        "mentions": tables.remap(mentions, "entry_id", p.select(F.col("loser_id").alias("old_id"), F.col("winner_id").alias("new_id"))),
        "revisions": tables.delete(revisions, p, "entry_id", "loser_id").unionByName(log, allowMissingColumns=True),
    }
