"""Reading order, folds over it, mentions, intake runs, and the bookkeeping of stored vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscope.functions import text as T


def reading_order(spine: str = "spine_idx", idx: str = "idx") -> list[Column]:
    """Order of segments in a book; a chapter without a place counts as the first."""
    return [F.coalesce(F.col(spine), F.lit(0)), F.col(idx)]


def pending_in_order(segments: DataFrame, chapters: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Pending segments ``(id, chapter_id, idx, status)`` with their chapters' ``spine_idx``; ``only`` lists the chapter ids to take."""
    s = segments.where("status = 'pending'")
    if only is not None:
        s = s.join(only.select(F.col("chapter_id").alias("_only")), F.col("chapter_id") == F.col("_only"), "left_semi")
    c = chapters.select(F.col("id").alias("_c"), F.col("spine_idx").alias("_spine"))
    return s.join(c, F.col("chapter_id") == F.col("_c"), "left").select(*segments.columns, F.coalesce("_spine", F.lit(0)).alias("spine_idx"))


def initial(segments: DataFrame, n: int = 30, spine: str = "spine_idx", idx: str = "idx") -> DataFrame:
    """The first ``n`` segments of a book in reading order."""
    return segments.orderBy(*reading_order(spine, idx), "id").limit(n)


def first_set(rows: DataFrame, group: str, order: str, columns: list[str], notes: str | None = None) -> DataFrame:
    """For each group the first value of each column that is not blank, in order, and the list of notes that are not."""
    first = [F.min_by(F.struct(F.col(c).alias("x")), F.when(T.nonblank(F.col(c)).isNotNull(), F.col(order)))["x"].alias(c) for c in columns]
    said = F.when(T.nonblank(F.col(notes)).isNotNull(), F.struct(F.col(order).alias("o"), T.jtrim(F.col(notes)).alias("n"))) if notes else None
    more = [F.transform(F.array_sort(F.collect_list(said)), lambda x: x["n"]).alias("notes")] if notes else []
    return rows.groupBy(group).agg(*first, *more)


def distinct_mentions(mentions: DataFrame, key: str = "segment_id") -> DataFrame:
    """One mention a place: the first by ``created_at`` and id of those with equal segment, entry and span."""
    w = W.partitionBy(key, "entry_id", "start", "end").orderBy("created_at", "id")
    return mentions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def alias_changes(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``(key, added, removed, kept)`` between two alias lists ``aliases`` of each entry, in order of text."""
    none = F.array().cast("array<string>")
    n = new.select(F.col(key).alias("_k"), F.col("aliases").alias("_new"))
    both = old.select(key, "aliases").join(n, F.col(key) == F.col("_k"), "full")
    a, b = F.coalesce("aliases", none), F.coalesce("_new", none)
    pick = lambda c: F.array_sort(F.array_distinct(c))
    return both.select(F.coalesce(key, "_k").alias(key), pick(F.array_except(b, a)).alias("added"), pick(F.array_except(a, b)).alias("removed"), pick(F.array_intersect(a, b)).alias("kept"))


def augmented(glossary: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """The glossary, and those fresh entries whose ids it does not hold yet, each once."""
    have = glossary.select(F.col(key).alias("_have"))
    more = fresh.dropDuplicates([key]).join(have, F.col(key) == F.col("_have"), "left_anti")
    return glossary.unionByName(more.select(*glossary.columns))


def listed(entries: DataFrame, lore: bool = False) -> list[Column]:
    """Order of a glossary list; a lore book lists entries without a source by their target."""
    return [F.coalesce("source_term", "target_term") if lore else F.coalesce("source_term", F.lit("")), F.col("id")]


def sorted_by(key: str, descending: bool = False) -> list[Column]:
    """Order of a glossary table under one of its heads; ``uses`` is a column of mention counts. Ties go by id."""
    rank = F.when(F.col("status") == "proposed", 0).when(F.col("status") == "confirmed", 1).when(F.col("status") == "locked", 2).otherwise(99)
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    heads = {"status": rank, "type": F.coalesce("type", F.lit("")), "source": low("source_term"), "target": low("target_term"), "uses": F.coalesce("uses", F.lit(0)), "updated": F.coalesce("updated_at", F.lit(0))}
    return [heads[key].desc() if descending else heads[key].asc(), F.col("id").asc()]


def history(table: str) -> list[Column]:
    """Order of what belongs to one entry, book or segment: aliases by side and text, revisions as they came, sources and calls the newest first."""
    orders = {"aliases": ["side", "text"], "revisions": ["created_at", "id"], "sources": [F.desc("ingested_at"), "id"], "calls": [F.desc("created_at"), "call_id"]}
    return [F.col(c) if isinstance(c, str) else c for c in orders[table]]


def intake_runs(runs: DataFrame, kind: str | None = None, chapter: str | None = None, limit: int = 100) -> DataFrame:
    """The latest intake runs, optionally of one kind or chapter."""
    r = runs if kind is None else runs.where(F.col("kind") == kind)
    r = r if chapter is None else r.where(F.col("chapter_id") == chapter)
    return r.orderBy(F.desc("started_at"), "id").limit(limit)


def intake_totals(runs: DataFrame) -> DataFrame:
    """One row: runs, chunks, cached chunks, proposals, failures, tokens and cost."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return runs.agg(F.count(F.lit(1)).alias("runs"), *map(total, ("chunks", "cached_chunks", "proposed", "failed", "prompt_tokens", "completion_tokens")), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost"))


def run_record(notes: DataFrame, run: str = "run_id", order: str = "seq", note: str = "note") -> DataFrame:
    """``(run, notes)``: a run's notes as paragraphs, null without any."""
    item = F.when(T.nonblank(F.col(note)).isNotNull(), F.struct(F.col(order).alias("o"), T.jtrim(F.col(note)).alias("n")))
    g = notes.groupBy(run).agg(F.array_sort(F.collect_list(item)).alias("x"))
    return g.select(run, F.nullif(F.array_join(F.transform("x", lambda r: r["n"]), "\n\n"), F.lit("")).alias("notes"))


def appended(log: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """New rows of a log with ids that follow the largest one, in ``order``."""
    top = log.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    numbered = new.withColumn("_n", F.row_number().over(W.orderBy(*order)))  # a batch of new rows, not the log
    return numbered.withColumn("_at", F.lit(0)).join(F.broadcast(top.withColumn("_at", F.lit(0))), "_at").select((F.col("_top") + F.col("_n")).cast("bigint").alias(key), *new.columns)


def stale_vectors(vectors: DataFrame, model: str) -> DataFrame:
    """Vectors of references that the active model covers, under other models: what a purge deletes."""
    active = vectors.where(F.col("model") == model).select(F.col("scope").alias("_s"), F.col("ref_id").alias("_r"))
    return vectors.where(F.col("model") != model).join(active, (F.col("scope") == F.col("_s")) & (F.col("ref_id") == F.col("_r")), "left_semi")


def to_embed(refs: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """References ``(scope, ref_id)`` that have no vector of the active model yet."""
    active = vectors.where(F.col("model") == model).select(F.col("scope").alias("_s"), F.col("ref_id").alias("_r"))
    return refs.join(active, (F.col("scope") == F.col("_s")) & (F.col("ref_id") == F.col("_r")), "left_anti")
