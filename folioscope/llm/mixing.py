"""Mixing sources to target weights, on the JVM only.

Each source's words form one stream that is packed into blocks of fixed
length. For every output shard the slots draw their source from the target
weights (a multinomial draw by inverse cumulative weights), and a source's
draws number its slots: so the draw says how much each source gives. Chance is
large only where slots are few; a source that the draw leaves more than
``LEEWAY`` of its slots off the target is settled to that distance in a last
shard, and one at its limit never goes above it. Slot ``i`` takes block
``perm(i mod n)`` of pass ``i div n``, where ``perm`` is a swap-or-not
permutation (Hoang, Morris and Rogaway 2012) keyed by source and pass. Blocks
and slots then join by index. Where a source gets just the slots of its target,
the last one is cut to the word.

Defined results: null and wordless texts have size 0 and take 0; a null source
is a source of its own, last in order; rows that repeat a document are mixed as
rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscope.llm.common import WORD
from folioscope.plans.prefix import exclusive_total
from folioscope.plans.staging import stage

SEED, ROUNDS, LEEWAY = 20_240, 8, 0.02


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def fill(sources: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """Targets for ``(source, source_size)``: shares by weight, stopped at ``most`` times the size, the excess shared again."""
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("no") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    s = sources.withColumn("no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn("w", w)
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = W.orderBy(F.col("cap") / F.col("w"), "no")
    level = (F.sum("source_size").over(W.partitionBy()) * share - F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("level", level)
    return s.withColumn("target", F.least("cap", F.col("w") * F.max("level").over(W.partitionBy()))).drop("level", "cap", "w")


def permuted(df: DataFrame, x: str, n: str, keys: list[str], out: str, seed: int, back: bool = False) -> DataFrame:
    """``out`` = place of ``x`` in a pseudorandom permutation of [0, n) that ``keys`` select; ``back`` inverts it."""
    size = F.col(n)

    def turn(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, *keys), size) - at, size)
        swap = F.xxhash64(F.bitwise_not(r), *keys, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(at)

    rounds = F.array(*(F.lit(seed + r).cast("bigint") for r in sorted(range(ROUNDS), reverse=back)))
    return df.withColumn(out, F.aggregate(rounds, F.col(x).cast("bigint"), turn))


def planned(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, block: int, seed: int) -> DataFrame:
    """For each source of ``(source, size)``: its blocks ``n``, the slots of its target and how much the last of these takes."""
    plan = fill(docs.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
    B = F.lit(block)
    plan = plan.withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("source_size") / B))).withColumn("goal", F.floor("target"))
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(F.lit(0)).cast("bigint"))
    plan = plan.withColumn("rem", F.col("goal") - F.col("whole") * F.col("source_size")).withColumn("short", F.col("n") * B - F.col("source_size"))
    # place of the one short block in the pass that is cut off
    plan = permuted(plan.withColumn("end", F.col("n") - 1), "end", "n", ["no", "whole"], "at", seed, back=True)
    cut = F.when(F.col("rem") == 0, 0).when(F.col("rem") <= F.col("at") * B, F.ceil(F.col("rem") / B)).otherwise(F.ceil((F.col("rem") + F.col("short")) / B))
    plan = plan.withColumn("cut", cut.cast("bigint")).withColumn("slots", F.col("whole") * F.col("n") + F.col("cut"))
    plan = plan.withColumn("last_take", F.col("rem") - (F.col("cut") - 1) * B + F.when(F.col("at") < F.col("cut") - 1, F.col("short")).otherwise(0))
    return plan.select("source", "no", "source_size", "target", "n", "short", "cut", "slots", "last_take", (F.floor(F.lit(float(most))) * F.col("n")).cast("bigint").alias("limit"))


def draws(plan: DataFrame, seed: int = SEED) -> DataFrame:
    """``(no, shard, start, stop)``: the slots of each source that each output shard draws; the last shard settles."""
    spark = plan.sparkSession
    total = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    per = max(1024, math.isqrt(total))
    shards, strips = -(-total // per), max(1, math.isqrt(total))
    # each source holds a stretch of [0, 1) as long as its weight; the stretches and the uniform numbers meet in strips
    run = W.orderBy("no").rowsBetween(W.unboundedPreceding, -1)
    edge = plan.where("slots > 0").select("no", (F.coalesce(F.sum("slots").over(run), F.lit(0)) / F.lit(max(1, total))).alias("lo"), (F.col("slots") / F.lit(max(1, total))).alias("w"))
    first, last = F.floor(F.col("lo") * strips), F.floor((F.col("lo") + F.col("w")) * strips)
    edge = edge.select(F.explode(F.sequence(first, F.least(last, F.lit(strips - 1)))).alias("strip"), "lo", F.col("no").alias("from"), F.lit(None).cast("int").alias("shard"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) / F.lit(float(1 << 53))
    ids = spark.range(0, total).select(F.floor(u * strips).alias("strip"), u.alias("lo"), F.lit(None).cast("int").alias("from"), (F.expr(f"id div {per}")).cast("int").alias("shard"))
    drawn = edge.unionByName(ids).withColumn("no", F.last("from", ignorenulls=True).over(W.partitionBy("strip").orderBy("lo", F.col("from").asc_nulls_last())))
    drawn = drawn.where("from is null").groupBy("no", "shard").agg(F.count(F.lit(1)).alias("got"))
    drawn = drawn.withColumn("start", F.coalesce(F.sum("got").over(W.partitionBy("no").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    had = drawn.groupBy("no").agg(F.sum("got").alias("had"))
    off = F.floor(F.col("slots") * LEEWAY)
    want = plan.join(had, "no", "left").select("no", F.coalesce("had", F.lit(0)).alias("had"), F.least(F.greatest(F.coalesce("had", F.lit(0)), F.col("slots") - off), F.col("slots") + off, "limit").alias("want"))
    want = want.select("no", "had", "want")
    runs = drawn.select("no", "shard", "start", (F.col("start") + F.col("got")).alias("stop")).join(want, "no")
    runs = runs.select("no", "shard", "start", F.least("stop", "want").alias("stop"))
    settle = want.select("no", F.lit(shards).cast("int").alias("shard"), F.col("had").alias("start"), F.col("want").alias("stop"))
    return runs.unionByName(settle).where("stop > start")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 128, seed: int = SEED) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)``, one row for every input row."""
    docs = stage(df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), "mix-docs")
    plan = stage(planned(docs, weights, share, most, block, seed), "mix-plan")
    runs, rows, B = stage(draws(plan, seed), "mix-draws"), docs.count(), F.lit(block)
    total = runs.agg(F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()[0]
    ends = runs.groupBy("no").agg(F.max("stop").alias("end"))
    runs = runs.join(ends, "no").join(plan.select("no", "n", "short", "cut", "slots", "last_take"), "no")
    # a few rows grow into all slots here: spread them by the slots they stand for
    spread = max(docs.sparkSession.sparkContext.defaultParallelism, total // 400_000 + 1)
    slots = runs.repartition(spread, "no", "shard").select("no", "n", "short", "cut", "slots", "end", "last_take", F.explode(F.sequence("start", F.col("stop") - 1)).alias("i"))
    slots = slots.withColumn("pass", F.expr("i div n")).withColumn("pos", F.expr("i % n"))
    slots = permuted(slots, "pos", "n", ["no", "pass"], "block", seed)
    holds = F.lit(block) - F.when(F.col("block") == F.col("n") - 1, F.col("short")).otherwise(0)
    part = (F.col("i") == F.col("slots") - 1) & (F.col("end") == F.col("slots")) & (F.col("cut") > 0) & (F.col("last_take") < holds)
    used = slots.groupBy("no", "block").agg(F.sum(F.when(part, 0).otherwise(1)).alias("times"), F.coalesce(F.max(F.when(part, F.col("last_take"))), F.lit(0)).alias("part"))

    keyed = docs.join(plan.select("source", "no"), docs["source"].eqNullSafe(plan["source"])).select("doc_id", "size", "no")
    keyed = exclusive_total(keyed, "no", ["doc_id", "size"], F.col("size"), rows, "start")
    spans = keyed.where("size > 0").select("doc_id", "size", "no", "start", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    lo, hi = F.greatest(F.col("start") - F.col("block") * B, F.lit(0)), F.least(F.col("start") + F.col("size") - F.col("block") * B, B)
    # Spark takes the blocks for as small as the draws they grew from and would broadcast them all
    spans = spans.withColumn("lo", lo).withColumn("hi", hi).join(used.hint("merge"), ["no", "block"], "left")
    words = F.coalesce(F.col("times") * (F.col("hi") - F.col("lo")) + F.greatest(F.lit(0), F.least("hi", "part") - F.col("lo")), F.lit(0))
    taken = spans.groupBy("doc_id", "size", "no", "start").agg(F.sum(words).alias("taken")).drop("start")
    taken = taken.unionByName(docs.where("size = 0").join(plan.select("source", "no"), docs["source"].eqNullSafe(plan["source"])).select("doc_id", "size", "no", F.lit(0).cast("bigint").alias("taken")))
    return taken.join(plan.select("no", "source", "source_size", "target"), "no").select("doc_id", "source", "size", "source_size", "target", "taken")
