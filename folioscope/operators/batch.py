"""The batch run as one set-oriented chain: branch, context, key, replay, model, checks, summary.

Semantics are those of one worker in sequence order (chapter order, then
``idx``): the glossary is the snapshot at the start; a segment whose model call
fails is ``failed`` and costs nothing; the run ends with the segment whose cost
takes the running total of the whole run above the budget, or whose failure
trips the breaker, and what follows stays pending and is left out for good.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscope.functions import text as T
from folioscope.operators import context, ledger, matching


def doubled(segments: DataFrame, lang: str, key: str = "id", target: str = "target_text") -> DataFrame:
    """``(key, entry_id, severity)``: a warning, without an entry, for each particle that a target repeats."""
    found = segments.select(key, F.explode(T.doubled_particles(F.col(target), F.lit(lang))).alias("_x"))
    return found.select(key, F.lit(None).cast("string").alias("entry_id"), F.lit("warning").alias("severity"))


def until(rows: DataFrame, chapter: str, idx: str, cost: str, failed: Column, budget: float, window: int, trip: int) -> DataFrame:
    """Rows of one run, in order of chapter and place, up to the first that ends it.

    Running totals and failures are counted within chapters first and carried
    over by one row a chapter, so no task holds the run.
    """
    w = W.partitionBy(chapter).orderBy(idx)
    r = rows.withColumn("_f", failed.cast("int")).withColumn("_c", F.coalesce(F.col(cost), F.lit(0.0)))
    r = r.withColumn("_spent", F.sum("_c").over(w)).withColumn("_n", F.row_number().over(w).cast("bigint"))
    per = r.groupBy(chapter).agg(F.sum("_c").alias("_t"), F.count(F.lit(1)).alias("_m"))
    before = W.orderBy(chapter).rowsBetween(W.unboundedPreceding, -1)  # one row a chapter
    per = per.select(F.col(chapter).alias("_k"), F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_t0"), F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_n0"))
    r = r.join(per, F.col(chapter).eqNullSafe(F.col("_k"))).withColumn("_spent", F.col("_spent") + F.col("_t0")).withColumn("_n", F.col("_n") + F.col("_n0"))
    # the breaker looks at failures alone: the one that comes `trip` - 1 failures earlier must lie within the window
    bad = r.where("_f = 1").select("_n").withColumn("_z", F.lag("_n", trip - 1).over(W.orderBy("_n"))).where(F.col("_n") - F.col("_z") < max(window, trip)).agg(F.min("_n")).first()[0]
    over = r.where(F.col("_spent") > budget).agg(F.min("_n")).first()[0]
    ends = [x for x in (bad, over) if x is not None]
    r = r.where(F.col("_n") <= min(ends)) if ends else r
    return r.select(*rows.columns)


def asked(segments: DataFrame, glossary_hash: str, model: str, most: int = 3, chars: int = 400, system: str = "translate") -> DataFrame:
    """Segments that need a model call, with their ``context``, the text ``user`` that asks it and its ``cache_key``."""
    s = segments.where(~T.trivially_empty(F.col("source_text")))
    s = context.previous(s, "chapter", "idx", "source_text", most, chars)
    s = s.withColumn("user", F.concat_ws("\n\n", F.array_join(F.transform(F.reverse("context"), lambda c: c["t"]), "\n"), F.col("source_text")))
    hashes = ledger.message_hash(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), F.col("user").alias("content"))))
    return s.withColumn("_h", hashes).withColumn("cache_key", ledger.cache_key(F.lit(model), F.col("_h.sys"), F.col("_h.usr"), F.lit(glossary_hash))).drop("_h")


def run(segments: DataFrame, entries: DataFrame, calls: DataFrame, glossary_hash: str, model: str = "mock", price: float = 0.0, budget: float = float("inf"), window: int = 100, trip: int = 10, most: int = 3, chars: int = 400, target_lang: str = "en", fails: Column | None = None) -> DataFrame:
    """Outcome of each segment ``(id, chapter, idx, source_text)``: target, key, cache hit, cost, violations, status.

    ``fails`` says for which segments the model call fails.
    """
    s = asked(segments, glossary_hash, model, most, chars)
    reply = ledger.mock_chat(F.col("source_text"))
    s = ledger.replay(s.withColumn("price", F.lit(price) * reply["completion_tokens"]), calls)
    s = s.withColumn("target_text", T.outer_space(F.col("source_text"), reply["content"])).withColumn("tokens", reply["prompt_tokens"] + reply["completion_tokens"])
    bad = F.coalesce(fails, F.lit(False)) & (F.col("cache_hit") == 0) if fails is not None else F.lit(False)
    s = s.withColumn("_bad", bad).withColumn("target_text", F.when(~F.col("_bad"), F.col("target_text"))).withColumn("cost", F.when(F.col("_bad"), 0.0).otherwise(F.col("cost")))
    found = matching.violations(s.where("not _bad"), entries, "id").unionByName(doubled(s.where("not _bad"), target_lang))
    v = found.groupBy("id").agg(F.count(F.lit(1)).alias("n_violations"), F.max(((F.col("severity") == "error") | F.col("entry_id").isNull()).cast("int")).alias("errors"))
    s = s.join(v, "id", "left").withColumn("n_violations", F.coalesce("n_violations", F.lit(0)))
    s = s.withColumn("status", F.when(F.col("_bad"), "failed").when(F.coalesce("errors", F.lit(0)) > 0, "flagged").otherwise("translated")).drop("errors", "price", "_bad")
    empty = segments.where(T.trivially_empty(F.col("source_text"))).select("id", "chapter", "idx", "source_text", F.col("source_text").alias("target_text"), F.lit("translated").alias("status"), F.lit(0.0).alias("cost"))
    out = s.select("id", "chapter", "idx", "source_text", "target_text", "cache_key", "cache_hit", "tokens", "n_violations", "status", "cost").unionByName(empty, allowMissingColumns=True)
    out = out.withColumn("cache_hit", F.coalesce("cache_hit", F.lit(0))).withColumn("tokens", F.coalesce("tokens", F.lit(0))).withColumn("n_violations", F.coalesce("n_violations", F.lit(0)))
    return until(out, "chapter", "idx", "cost", F.col("status") == "failed", budget, window, trip)
