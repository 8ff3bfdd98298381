"""Summaries of books whose parts are read one after another, each with the summary so far.

A part's request holds the reply to the part before, so a book is a chain. All
books take a step at once: a wave holds one part of every book that is long
enough, is written down before the next one starts, and is joined to the parts
of the next. So model calls are made once, a lost executor costs its tasks of
one wave, and there are as many waves as the longest book has parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscope.functions import text as T
from folioscope.operators import ledger
from folioscope.plans.staging import shared_dir, stage

SYSTEM = "summarize"


def request(prior: Column, text: Column) -> Column:
    """What a part asks: the summary so far, if there is one, and its own text."""
    return F.concat_ws("\n\n", F.concat(F.lit("Summary so far:\n"), prior), F.concat(F.lit("Next part:\n"), text))


def chained(parts: DataFrame, book: str, order: str, text: str, reply: Callable[[Column], Column], model: str, glossary_hash: str, calls: DataFrame | None = None) -> DataFrame:
    """``(book, order, part, prior, cache_key, status, summary)`` for every part with text; books and parts are unique together.

    ``reply`` makes a summary of a request, null where the call fails; the next
    part then goes on from the last summary there was. ``calls``
    ``(cache_key, ok, summary, created_at, call_id)`` holds earlier replies: the
    first good one of a key is taken instead of a call. ``status`` is
    ``cached``, ``called`` or ``failed``. Parts without text are left out.
    """
    spark, kind = parts.sparkSession, dict(parts.dtypes)
    rows = parts.where(T.jtrim(F.col(text)) != "").select(F.col(book).alias("book"), F.col(order).alias("o"), T.jtrim(F.col(text)).alias("t"))
    rows = rows.withColumn("part", F.row_number().over(W.partitionBy("book").orderBy("o")).cast("bigint"))
    waves = stage(rows, "parts", by="part")
    longest = waves.agg(F.max("part")).first()[0] or 0
    if calls is not None:
        calls = calls.where("ok").groupBy("cache_key").agg(F.min_by("summary", F.struct("created_at", "call_id")).alias("_known"))
    path = f"{shared_dir(spark)}/folioscope/summaries-{uuid.uuid4().hex}"
    schema = f"book {kind[book]}, o {kind[order]}, prior string, cache_key string, status string, summary string"
    before = None
    for n in range(1, longest + 1):
        now = waves.where(F.col("part") == n).drop("part")
        if before is None:
            now = now.withColumn("prior", F.lit(None).cast("string"))
        else:
            so_far = before.select(F.col("book").alias("_b"), F.coalesce("summary", "prior").alias("prior"))
            now = now.join(so_far, F.col("book").eqNullSafe(F.col("_b"))).drop("_b")
        asked = now.withColumn("_u", request(F.col("prior"), F.col("t")))
        message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
        h = ledger.message_hash(F.array(message("system", F.lit(SYSTEM)), message("user", F.col("_u"))))
        asked = asked.withColumn("_h", h).withColumn("cache_key", ledger.cache_key(F.lit(model), F.col("_h.sys"), F.col("_h.usr"), F.lit(glossary_hash)))
        asked = asked.join(calls, "cache_key", "left") if calls is not None else asked.withColumn("_known", F.lit(None).cast("string"))
        # a known reply is looked at first, so only what is not known costs a call
        done = asked.withColumn("summary", F.coalesce("_known", F.when(F.col("_known").isNull(), reply(F.col("_u")))))
        status = F.when(F.col("_known").isNotNull(), "cached").when(F.col("summary").isNotNull(), "called").otherwise("failed")
        done.select("book", "o", "prior", "cache_key", status.alias("status"), "summary").write.mode("overwrite").parquet(f"{path}/part={n}")
        before = spark.read.schema(schema).parquet(f"{path}/part={n}")
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/part=0")
    out = spark.read.schema(f"{schema}, part bigint").option("basePath", path).parquet(path)
    return out.select(F.col("book").alias(book), F.col("o").alias(order), "part", "prior", "cache_key", "status", "summary")


def of_books(chain: DataFrame, book: str) -> DataFrame:
    """``(book, parts, cached, failed, summary, error)``: a book's last summary, or why it has none."""
    g = chain.groupBy(book).agg(F.count(F.lit(1)).alias("parts"), F.count_if(F.col("status") == "cached").alias("cached"), F.count_if(F.col("status") == "failed").alias("failed"), F.max_by("summary", F.when(F.col("summary").isNotNull(), F.col("part"))).alias("summary"))
    return g.withColumn("error", F.when(F.col("summary").isNull(), "all summary chunks failed"))


def as_calls(chain: DataFrame) -> DataFrame:
    """A chain's replies in the form in which ``calls`` takes them."""
    return chain.where("status <> 'failed'").select("cache_key", F.lit(True).alias("ok"), "summary", F.col("part").alias("created_at"), F.col("cache_key").alias("call_id"))
