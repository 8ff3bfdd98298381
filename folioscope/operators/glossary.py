"""Glossary projections, unions, merges and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscope.functions import text as T


def status_rank(c: Column) -> Column:
    return F.when(c == "locked", 0).when(c == "confirmed", 1).when(c == "proposed", 2).otherwise(99)


def with_aliases(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entries with their aliases by side, sorted."""
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("text"))))
    a = aliases.groupBy("entry_id").agg(side("source").alias("source_aliases"), side("target").alias("target_aliases"))
    none = F.array().cast("array<string>")
    out = entries.join(a, F.col("id") == F.col("entry_id"), "left").drop("entry_id")
    return out.withColumn("source_aliases", F.coalesce("source_aliases", none)).withColumn("target_aliases", F.coalesce("target_aliases", none))


def all_terms(term: Column, aliases: Column) -> Column:
    """The term first, then its aliases, without blanks and repeats."""
    return F.array_distinct(F.filter(F.concat(F.array(term), F.coalesce(aliases, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (T.jtrim(x) != "")))


def constraints(entries: DataFrame, project: str = "project_id") -> DataFrame:
    """Entries that bind a translation, with their place in the prompt of their project."""
    rows = entries.where("status <> 'proposed' and source_term is not null")
    return rows.withColumn("place", F.row_number().over(W.partitionBy(project).orderBy(status_rank(F.col("status")), "source_term", "id")).cast("bigint"))


def target_only(entries: DataFrame, project: str = "project_id") -> DataFrame:
    """Entries that only fix a target, with their place among those of their project."""
    rows = entries.where("status <> 'proposed' and source_term is null")
    return rows.withColumn("place", F.row_number().over(W.partitionBy(project).orderBy(status_rank(F.col("status")), "target_term", "id")).cast("bigint"))


def merged_books(project: DataFrame, books: DataFrame) -> DataFrame:
    """Project entries, then attached books by falling priority; a term already there wins, proposals stay out."""
    key = F.when(F.col("source_term").isNotNull(), F.concat_ws("::", F.col("type"), F.lower("source_term"))).otherwise(F.concat(F.lit("target::"), F.lower("target_term")))
    both = project.withColumn("tier", F.lit(0)).withColumn("priority", F.lit(0)).unionByName(books.where("status <> 'proposed'").withColumn("tier", F.lit(1)), allowMissingColumns=True)
    by = W.partitionBy("_key").orderBy("tier", F.desc("priority"), F.coalesce("source_term", "target_term"), "id")
    return both.withColumn("_key", key).withColumn("_rn", F.row_number().over(by)).where("_rn = 1").drop("_rn", "_key")


def duplicates(entries: DataFrame, key: str = "source_term") -> DataFrame:
    """Groups with equal terms: size and ids, the winner first."""
    rank = F.struct(status_rank(F.col("status")).alias("s"), F.when(F.col("type") == "term", 1).otherwise(0).alias("t"), F.col("created_at").alias("c"), F.col("id").alias("id"))
    g = entries.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(rank)).alias("r")).where("n > 1")
    return g.select(key, "n", F.transform("r", lambda x: x["id"]).alias("ids"))


def json_text(c: Column) -> Column:
    """A string as JSON writes it, null as null."""
    return F.when(c.isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1))


def glossary_hash(entries: DataFrame, project: str = "project_id") -> DataFrame:
    """One hash a project over its entries in term order, 32 hex digits; order of input, ids and dates do not matter.

    Keys are sorted and separated as ``", "`` and ``": "``. Columns
    ``source_aliases`` and ``target_aliases`` may be missing; they count as empty.
    """
    def value(name: str) -> Column:
        if name.endswith("_aliases"):
            words = F.coalesce(F.col(name), F.array()) if name in entries.columns else F.array()
            return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(words.cast("array<string>")), json_text), ", "), F.lit("]"))
        return F.coalesce(F.col(name).cast("string"), F.lit("null")) if name == "source_known" else json_text(F.col(name).cast("string"))

    names = ["gender", "notes", "source_aliases", "source_known", "source_term", "status", "target_aliases", "target_term", "type"]
    item = F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{n}": '), value(n)) for n in names)), F.lit("}"))
    rows = entries.select(project, F.struct(F.coalesce("source_term", F.lit("")).alias("a"), F.col("target_term").alias("b"), F.col("id").alias("c"), item.alias("j")).alias("x"))
    g = rows.groupBy(project).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    whole = F.concat(F.lit("["), F.array_join(F.transform("xs", lambda x: x["j"]), ", "), F.lit("]"))
    return g.select(project, F.left(F.sha2(whole, 256), F.lit(32)).alias("glossary_hash"))


def classify_import(incoming: DataFrame, existing: DataFrame, overwrite: bool) -> DataFrame:
    """``created``, ``updated`` or ``skipped`` for each incoming entry, by exact term and type."""
    e = existing.where("source_term is not null").select(F.col("source_term").alias("_s"), F.col("type").alias("_t"), F.lit(True).alias("_has")).distinct()
    out = incoming.join(e, (F.col("source_term") == F.col("_s")) & (F.col("type") == F.col("_t")), "left")
    return out.withColumn("outcome", F.when(F.col("_has").isNull(), "created").otherwise("updated" if overwrite else "skipped")).drop("_s", "_t", "_has")


def propose(incoming: DataFrame, existing: DataFrame, lang: str = "en") -> DataFrame:
    """Batch form of entity resolution on write: one row a canonical term, matched to the first existing entry or created."""
    i = incoming.withColumn("term", T.strip_particle(F.col("source_term"), F.lit(lang))).withColumn("canon", T.canonical(F.col("term")))
    i = i.groupBy("canon").agg(F.min_by(F.struct("term", "target_term", "type"), "seq").alias("x"), F.array_sort(F.collect_set("term")).alias("spellings"))
    e = existing.withColumn("canon_e", T.canonical(F.col("source_term"))).groupBy("canon_e").agg(F.min_by(F.struct("id", "source_term", "status", "type"), F.struct("source_term", "id")).alias("e"))
    out = i.join(e, F.col("canon") == F.col("canon_e"), "left")
    alias = F.filter("spellings", lambda s: F.lower(s) != F.lower(F.coalesce("e.source_term", "x.term")))
    kind = F.when((F.col("e.status") == "proposed") & (F.col("e.type") == "term"), F.col("x.type")).otherwise(F.coalesce("e.type", "x.type"))
    return out.select("canon", F.col("e.id").alias("entry_id"), F.coalesce("e.source_term", "x.term").alias("source_term"), kind.alias("type"), alias.alias("new_aliases"), F.when(F.col("e.id").isNull(), "created").otherwise("matched").alias("outcome"))


def merge_entries(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Aliases each winner gains from its losers: their terms and aliases, without its own."""
    l = pairs.join(entries, F.col("loser_id") == F.col("id")).select("winner_id", F.explode(F.concat(all_terms(F.col("source_term"), F.col("source_aliases")))).alias("alias"))  # noqa: E741
    w = entries.select(F.col("id").alias("winner_id"), all_terms(F.col("source_term"), F.col("source_aliases")).alias("own"))
    return l.distinct().join(w, "winner_id").where(~F.array_contains("own", F.col("alias"))).select("winner_id", "alias")
