"""Prompt assembly, reply parsing, and the small decision tables around them. Templates are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.functions import text as T

# Entity types; unknown ones become 'term'.
TYPES = ["character", "place", "organization", "event", "item", "date_or_time", "phrase", "term", "other"]


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def block(name: str, body: Column) -> Column:
    """An XML block, or null without a body."""
    return F.when(T.nonblank(body).isNotNull(), F.concat(F.lit(f"<{name}>\n"), body, F.lit(f"\n</{name}>")))


def context_lines(context: Column) -> Column:
    """Context rows (``back``, ``t``), farthest first, escaped."""
    far = F.array_sort(F.transform(context, lambda x: F.struct((-x["back"]).alias("o"), x["t"].alias("t"))))
    return F.array_join(F.transform(far, lambda x: escaped(x["t"])), "\n")


def user_message(source: Column, context: Column, hints: Column, toggles: dict[str, bool] | None = None) -> Column:
    on = {"context": True, "hints": True} | (toggles or {})
    parts = [block("context", context_lines(context)) if on["context"] else F.lit(None), block("hints", hints) if on["hints"] else F.lit(None), block("source", source)]
    return F.concat_ws("\n\n", *parts)


def parsed(reply: Column, schema: str, required: str) -> Column:
    """``(ok, value, error)``: the reply as JSON, or its first brace block; ``required`` must be there."""
    first = F.from_json(reply, schema, {"mode": "PERMISSIVE"})
    second = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), schema, {"mode": "PERMISSIVE"})
    value = F.when(first[required].isNotNull(), first).otherwise(second)
    ok = F.coalesce(value[required].isNotNull(), F.lit(False))
    return F.struct(ok.alias("ok"), F.when(ok, value).alias("value"), F.when(~ok, F.when(reply.contains("{"), f"no {required}").otherwise("no JSON")).alias("error"))


def entity(term: Column, kind: Column, confidence: Column) -> Column:
    """Whitelisted type and clamped confidence of a proposed entity, with the reason it is refused."""
    return F.struct(T.jtrim(term).alias("term"), F.when(kind.isin(*TYPES), kind).otherwise("term").alias("type"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence.cast("double"))).alias("confidence"), T.cap_violation(term).alias("refused"))


def by_tag(tags: DataFrame, tag: str, table: DataFrame, key: str, value: str) -> DataFrame:
    """``value`` for a language tag: the exact tag, else its primary subtag, else null."""
    low = table.groupBy(F.lower(key).alias("_k")).agg(F.first(value).alias("_v"))
    exact, primary = low.toDF("_k1", "_v1"), low.toDF("_k2", "_v2")
    t = tags.join(exact, F.lower(tag) == F.col("_k1"), "left").join(primary, F.lower(F.substring_index(tag, "-", 1)) == F.col("_k2"), "left")
    return t.withColumn(value, F.coalesce("_v1", "_v2")).drop("_k1", "_v1", "_k2", "_v2")


def search(table: DataFrame, text: str, key: str, name: str, order: str, limit: int = 12) -> DataFrame:
    """Exact, then prefix, then contained matches on key or name; all rows for an empty text."""
    q = text.strip().lower()
    k, n = F.lower(key), F.lower(name)
    rank = F.when(F.lit(q == ""), 0).when((k == q) | (n == q), 1).when(k.startswith(q) | n.startswith(q), 2).when(k.contains(q) | n.contains(q), 3)
    return table.withColumn("rank", rank).where("rank is not null").orderBy("rank", order).limit(limit)


def style(register: Column, audience: Column, rules: list[tuple[str, str, str]]) -> Column:
    """First rule ``(field, token, profile)`` whose token equals the normalised field, or null."""
    norm = lambda c: F.regexp_replace(F.lower(T.jtrim(c)), r"[\s\-_]+", "_")
    fields = {"register": norm(register), "audience": norm(audience)}
    return F.coalesce(*(F.when(fields[f] == token, profile) for f, token, profile in rules), F.lit(None).cast("string"))


def style_guide(custom: Column, profile_text: Column) -> Column:
    return F.coalesce(T.nonblank(custom), profile_text)


def may_apply(guide: Column, template: Column) -> Column:
    """A suggested profile replaces a guide only if nobody changed it."""
    return F.coalesce(guide.isNull() | (guide == template), F.lit(True))


def skeleton(c: Column) -> Column:
    """The stored envelope of a segment; a bare array is the old form."""
    items = "array<struct<tag:string,kind:string,attrs:map<string,string>>>"
    new = F.from_json(c, f"skeleton {items}, host_path string, host_part int, host_total_parts int")
    old = F.when(F.ltrim(c).startswith("["), F.from_json(c, items))
    return F.struct(F.coalesce(old, new["skeleton"], F.array().cast(items)).alias("skeleton"), F.coalesce(new["host_path"], F.lit("")).alias("host_path"), F.coalesce(new["host_part"], F.lit(0)).alias("host_part"), F.coalesce(new["host_total_parts"], F.lit(1)).alias("host_total_parts"))


def clamped(c: Column, default, low, high) -> Column:
    """A number option: its default when missing, else within bounds."""
    v = c.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(float(default))).otherwise(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v)))
