"""Requests seen before they are made, and replies taken from the ledger instead of a call.

A replay is no copy: its target is checked again, against the placeholders of
the segment and the glossary of today, so an old reply can come out flagged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.functions import text as T
from folioscope.operators import batch, matching, prompts
from folioscope.operators.imports import made_id

PURPOSE = "translate"
UNUSABLE = "cached call has no usable reply"


def first_good(calls: DataFrame) -> DataFrame:
    """One row a key: the first successful call, by date, then id."""
    rest = [c for c in calls.columns if c not in ("cache_key", "ok")]
    return calls.where("ok").groupBy("cache_key").agg(F.min_by(F.struct(*rest), F.struct("created_at", "call_id")).alias("hit"))


def preview(segments: DataFrame, calls: DataFrame, glossary_hash: str, model: str = "mock", system: str = "translate", most: int = 3, chars: int = 400) -> DataFrame:
    """What a run would ask for each segment, and whether the ledger knows the reply; nothing is called or written.

    ``(id, system_text, user_text, n_context, system_tokens, user_tokens,
    prompt_tokens, cache_key, cache_hit, hit_id)``. Segments that a run passes
    on without asking have no row.
    """
    s = batch.asked(segments, glossary_hash, model, most, chars, system)
    n = lambda c: T.rough_tokens(c, 0)
    s = s.select("id", F.lit(system).alias("system_text"), F.col("user").alias("user_text"), F.size("context").alias("n_context"), n(F.lit(system)).alias("system_tokens"), n(F.col("user")).alias("user_tokens"), "cache_key")
    s = s.withColumn("prompt_tokens", F.col("system_tokens") + F.col("user_tokens")).join(first_good(calls).select("cache_key", F.col("hit.call_id").alias("hit_id")), "cache_key", "left")
    return s.withColumn("cache_hit", F.col("hit_id").isNotNull())


def reply_target(response: Column) -> Column:
    """``(target, error)`` of a stored response: its trace's target, else what its content parses to."""
    trace = F.from_json(response, "trace struct<target:string>, content string")
    parsed = prompts.parsed(trace["content"], "target string", "target")
    target = F.coalesce(trace["trace"]["target"], parsed["value"]["target"])
    error = F.when(target.isNull(), F.when(trace["content"].isNotNull(), parsed["error"]).otherwise(UNUSABLE))
    return F.struct(target.alias("target"), error.alias("error"))


def replayed(requests: DataFrame, calls: DataFrame, entries: DataFrame, target_lang: str, now: int) -> dict[str, DataFrame]:
    """Requests ``(id, source_text, cache_key, kinds)`` answered by the ledger's calls.

    ``calls`` has ``call_id, cache_key, ok, created_at, model, prompt_tokens,
    completion_tokens, response``; ``kinds`` names the segment's placeholders,
    ``pair`` or ``void``. Returns ``segments`` ``(id, target_text, status,
    n_violations, error)``, the new rows ``calls`` (free, without a duration)
    and ``events``, and ``misses``, the requests that nothing answers. A reply
    that cannot be used, or that breaks a placeholder, is ``failed`` with its
    ``error`` and adds no rows.
    """
    got = requests.join(first_good(calls), "cache_key", "left")
    hits = got.where("hit is not null").withColumn("_r", reply_target(F.col("hit.response"))).withColumn("target_text", F.col("_r.target"))
    hits = hits.withColumn("error", F.coalesce(F.col("_r.error"), T.placeholder_error(F.col("target_text"), F.col("kinds")))).drop("_r")
    good = hits.where("error is null")
    found = matching.violations(good, entries, "id").unionByName(batch.doubled(good, target_lang))
    v = found.groupBy(F.col("id").alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.bool_or((F.col("severity") == "error") | F.col("entry_id").isNull()).alias("_bad"))
    out = hits.join(v, F.col("id") == F.col("_v"), "left").withColumn("n_violations", F.coalesce("_n", F.lit(0)))
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("_bad"), "flagged").otherwise("translated")
    out = out.withColumn("status", status).withColumn("llm_call_id", made_id("cache_key", F.col("id").cast("string"), F.lit(str(now))))
    done, stamp = out.where("error is null"), F.lit(now).cast("bigint")
    call = done.select(
        F.col("llm_call_id").alias("call_id"), F.col("id").alias("segment_id"), F.lit(PURPOSE).alias("purpose"), "hit.model", "hit.prompt_tokens", "hit.completion_tokens", F.lit(0.0).alias("cost_usd"), F.lit(1).alias("cache_hit"),
        "cache_key", F.col("hit.response").alias("response"), stamp.alias("created_at"), F.lit(None).cast("bigint").alias("duration_ms"),
    )
    payload = F.to_json(F.struct(F.lit(True).alias("cache_hit"), "llm_call_id", F.col("hit.model").alias("model"), F.col("id").alias("segment_id"), F.col("n_violations").alias("violations")))
    events = done.select(F.col("id").alias("segment_id"), F.explode(F.when(F.col("n_violations") > 0, F.array(F.lit("segment.translated"), F.lit("segment.flagged"))).otherwise(F.array(F.lit("segment.translated")))).alias("kind"), payload.alias("payload_json"), stamp.alias("ts"))
    segments = out.select("id", F.when(F.col("error").isNull(), F.col("target_text")).alias("target_text"), "status", "n_violations", "error")
    return {"segments": segments, "calls": call, "events": events, "misses": got.where("hit is null").drop("hit")}
