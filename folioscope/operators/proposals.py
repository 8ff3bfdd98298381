"""Entities that translations propose: resolved against the glossary and written back, as one after another would be.

Proposals meet entries by exact term, else by canonical form, the first entry
of that form in list order. A form without entries gets one from its earliest
proposal, and all later ones of the form match it; terms without a canonical
form only match exactly. So what a proposal meets does not depend on those
between the first one and itself, and one grouping gives what a loop gives,
however many proposals share a form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.functions import text as T
from folioscope.operators.prompts import TYPES


def candidates(raw: DataFrame) -> DataFrame:
    """What a translation's trace names, without blank terms and bare years; ``(seq, segment_id, source, target, type, evidence)``."""
    blank = lambda c: T.nonblank(F.col(c))
    r = raw.select("seq", "segment_id", blank("source").alias("source"), blank("target").alias("target"), F.lower(blank("type")).alias("type"), blank("evidence").alias("evidence"))
    r = r.where(F.col("source").isNotNull() & ~T.year_proposed(F.col("source")))
    kind = F.when(F.col("type").isin(*(t for t in TYPES if t != "other")), F.col("type")).otherwise("term")
    return r.withColumn("type", kind).withColumn("target", F.when(F.col("target") != F.col("source"), F.col("target")))


def _canon(term: Column) -> Column:
    return T.canonical(T.nfkc(term))


def resolve(proposals: DataFrame, entries: DataFrame, source_lang: str | None = None, target_lang: str | None = None) -> DataFrame:
    """``(seq, entry_id, how, term, target, type)``; ``how`` is ``exact``, ``canonical`` or ``created``.

    Leading particles are left off in the given languages. An entry that seq n
    creates has the id ``p`` and n. ``seq`` is unique.
    """
    bare = lambda c, lang: T.strip_particle(F.col(c), F.lit(lang)) if lang else F.col(c)
    p = proposals.select("seq", bare("source", source_lang).alias("term"), bare("target", target_lang).alias("target"), "type")
    p = p.withColumn("target", F.when(F.col("target") != F.col("term"), F.col("target"))).withColumn("canon", _canon(F.col("term")))
    e = entries.where("source_term is not null").select("id", "source_term")
    exact = e.groupBy(F.col("source_term").alias("term")).agg(F.min("id").alias("exact_id"))
    alike = e.withColumn("canon", _canon(F.col("source_term"))).where("canon <> ''").groupBy("canon").agg(F.min_by("id", F.struct("source_term", "id")).alias("alike_id"))
    # the earliest of each form, should the form have no entry; only those with no canonical form are told apart by the term
    form = F.when(F.col("canon") == "", F.concat(F.lit("="), "term")).otherwise(F.concat(F.lit("~"), "canon"))
    p = p.withColumn("form", form)
    first = p.groupBy("form").agg(F.min_by(F.struct("seq", "term"), "seq").alias("first"))
    got = p.join(exact, "term", "left").join(alike, "canon", "left").join(first, "form")
    own = F.concat(F.lit("p"), F.col("first.seq").cast("string"))
    entry = F.coalesce(F.col("exact_id").cast("string"), F.col("alike_id").cast("string"), own)
    fresh = F.col("exact_id").isNull() & F.col("alike_id").isNull()
    how = F.when(F.col("exact_id").isNotNull() | (fresh & (F.col("first.seq") != F.col("seq")) & (F.col("first.term") == F.col("term"))), "exact").when(fresh & (F.col("first.seq") == F.col("seq")), "created").otherwise("canonical")
    return got.select("seq", entry.alias("entry_id"), how.alias("how"), "term", "target", "type")


def applied(resolved: DataFrame, entries: DataFrame) -> DataFrame:
    """The entries that proposals made or touched: ``(id, source_term, target_term, type, status, source_aliases)`` after all of them.

    Only proposed entries change in type (from ``term`` to the first other
    type) and target (where it still repeats the term, to the first that does
    not); other spellings become aliases, once each.
    """
    none = F.array().cast("array<string>")
    old = entries.select(F.col("id").cast("string").alias("id"), "source_term", "target_term", "type", "status", F.coalesce("source_aliases", none).alias("source_aliases"))
    new = resolved.where("how = 'created'").select(F.col("entry_id").alias("id"), F.col("term").alias("source_term"), F.coalesce("target", "term").alias("target_term"), "type", F.lit("proposed").alias("status"), none.alias("source_aliases"))
    base = old.unionByName(new)
    r = resolved.select("seq", "entry_id", "how", "term", F.col("target").alias("offer"), F.col("type").alias("kind")).join(base, F.col("entry_id") == F.col("id"))
    other = (F.col("how") == "canonical") & (F.lower("term") != F.lower("source_term")) & ~F.array_contains("source_aliases", F.col("term"))
    earliest = lambda c, ok: F.min_by(F.when(ok, F.col(c)), F.when(ok, F.col("seq")))
    g = r.groupBy("id").agg(
        *(F.first(c).alias(c) for c in ("source_term", "target_term", "type", "status", "source_aliases")),  # one entry's own columns
        earliest("kind", F.col("kind") != "term").alias("kind"), earliest("offer", F.col("offer").isNotNull() & (F.col("offer") != F.col("source_term"))).alias("offer"),
        F.array_sort(F.collect_set(F.when(other, F.col("term")))).alias("more"),
    )
    open_ = F.col("status") == "proposed"
    kind = F.when(open_ & (F.col("type") == "term"), F.coalesce("kind", "type")).otherwise(F.col("type"))
    target = F.when(open_ & F.col("target_term").eqNullSafe(F.col("source_term")), F.coalesce("offer", "target_term")).otherwise(F.col("target_term"))
    return g.select("id", "source_term", target.alias("target_term"), kind.alias("type"), "status", F.array_sort(F.concat("source_aliases", "more")).alias("source_aliases"))
