"""The call ledger: keys, replay, prices, outcomes, and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SEP, ROLE = "\u0001", "\u0000"


def message_hash(messages: Column) -> Column:
    """Hash of an array of (role, content): the system texts alone, the others with their roles."""
    sys = F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["content"]), SEP)
    usr = F.array_join(F.transform(F.filter(messages, lambda m: m["role"] != "system"), lambda m: F.concat(m["role"], F.lit(ROLE), m["content"])), SEP)
    return F.struct(F.sha2(sys, 256).alias("sys"), F.sha2(usr, 256).alias("usr"))


def cache_key(model: Column, sys: Column, usr: Column, glossary: Column) -> Column:
    return F.sha2(F.concat_ws(":", model, sys, usr, glossary), 256)


def replay(requests: DataFrame, calls: DataFrame, key: str = "cache_key") -> DataFrame:
    """Requests with the first successful call of their key; a hit costs nothing."""
    first = calls.where("ok").groupBy(key).agg(F.min_by(F.struct("call_id", "cost"), F.struct("created_at", "call_id")).alias("_c"))
    out = requests.join(first, key, "left")
    return out.select(*requests.columns, F.col("_c.call_id").alias("hit_id"), F.col("_c").isNotNull().cast("int").alias("cache_hit"), F.when(F.col("_c").isNotNull(), 0.0).otherwise(F.col("price")).alias("cost"))


def priced(models: DataFrame, prices: DataFrame) -> DataFrame:
    """``(model, matched, prompt_price, completion_price)``: exact, then without a date, then by shorter hyphen prefixes, else 0."""
    plain = F.regexp_replace("model", r"-\d{4}-\d{2}-\d{2}$", "")
    parts = F.split(plain, "-")
    tries = F.concat(F.array("model"), F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-")))
    m = models.select("model").distinct().withColumn("_t", F.explode(F.array_distinct(tries)))
    p = prices.select(F.col("name"), F.col("prompt_price").alias("_pp"), F.col("completion_price").alias("_cp"))
    best = m.join(p, F.col("_t") == F.col("name"), "left").groupBy("model").agg(F.max_by(F.struct("name", "_pp", "_cp"), F.when(F.col("name").isNotNull(), F.length("name"))).alias("b"))
    return best.select("model", F.col("b.name").alias("matched"), F.coalesce("b._pp", F.lit(0.0)).alias("prompt_price"), F.coalesce("b._cp", F.lit(0.0)).alias("completion_price"))


def cost(prompt: Column, completion: Column, prompt_price: Column, completion_price: Column) -> Column:
    bad = F.raise_error(F.lit("negative token count")).cast("double")
    return F.when((prompt < 0) | (completion < 0), bad).otherwise((prompt * prompt_price + completion * completion_price) / 1e6)


def outcomes(calls: DataFrame, group: str) -> DataFrame:
    """Batch summary: flagged if there is any violation, else cached, else translated; sums of tokens and cost."""
    kind = F.when(F.col("n_violations") > 0, "flagged").when(F.col("cache_hit") == 1, "cached").otherwise("translated")
    return calls.withColumn("outcome", kind).groupBy(group, "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"))


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, 4)).otherwise(F.lit(0.0))


def mock_chat(user: Column) -> Column:
    """The offline model: marks the text and counts tokens by length."""
    tokens = lambda c: F.greatest(F.lit(1), F.ceil(F.length(c) / 4)).cast("bigint")
    reply = F.concat(F.lit("[mock-tr] "), user)
    return F.struct(reply.alias("content"), tokens(user).alias("prompt_tokens"), tokens(reply).alias("completion_tokens"))
