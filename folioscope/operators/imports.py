"""Entries brought into a glossary from a snapshot or from another project, with all that follows from it.

The outcome is that of taking the incoming entries one after another, but all
of them are placed at once: an entry meets what is known under its exact term
and type, and among equals of one import the first creates and each later one
meets what the one before it left. So the steps of a term are a lag over its
rows, and no task goes through a glossary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.operators import glossary
from folioscope.plans import carry

FIELDS = ["target_term", "status", "gender", "notes"]
SIDES = ["source", "target"]
POLICIES = ("skip", "overwrite", "collect")


def distinct_words(words: Column, own: Column | None = None) -> Column:
    """Words in their order, without blanks, repeats and, if given, the entry's own term."""
    keep = F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "") & (F.lit(True) if own is None else ~x.eqNullSafe(own)))
    return F.array_distinct(keep)


def made_id(*parts) -> Column:
    return F.left(F.sha2(F.concat_ws("\u0001", *parts), 256), F.lit(32))


def placed(entries: DataFrame, incoming: DataFrame, project_id: str, policy: str, unknown: Column | None = None) -> DataFrame:
    """Incoming rows with ``entry_id``, ``outcome`` and ``prior``, the fields that each meets.

    ``incoming`` has a number ``seq`` for each row, which orders them.
    ``unknown`` says which rows fix a target only (by default those without a
    source term); they are always new. ``outcome`` is ``created``, ``skipped``,
    ``updated`` or ``conflict``.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {', '.join(POLICIES)}")
    here = entries.where((F.col("project_id") == project_id) & F.col("source_term").isNotNull())
    known = here.groupBy(F.col("source_term").alias("_s"), F.col("type").alias("_t")).agg(F.min_by(F.struct("id", *FIELDS), "id").alias("_known"))
    alone = (F.col("source_term").isNull() if unknown is None else unknown | F.col("source_term").isNull()).alias("_alone")
    rows = incoming.select("*", alone)
    # a row that fixes a target only is a key of its own, so that a crowd of them is no hot key
    rows = rows.withColumn("_own", F.when(F.col("_alone"), F.col("seq"))).withColumn("_key", F.when(~F.col("_alone"), F.col("source_term")))
    rows = carry.before(rows, ["_own", "_key", "type"], "seq", FIELDS, "_prev")
    first = rows.groupBy(F.col("_key").alias("_s"), F.col("type").alias("_t")).agg(F.min(F.when(~F.col("_alone"), F.col("seq"))).alias("_first")).where("_s is not null")
    met = (F.col("_key") == F.col("_s")) & (F.col("type") == F.col("_t"))
    rows = rows.join(first.join(known, ["_s", "_t"], "left"), met, "left")
    new = made_id(F.lit(project_id), F.lit("import"), F.coalesce("_first", "seq").cast("string"))
    start = F.col("_known").dropFields("id")
    if policy == "overwrite":
        prior = F.coalesce("_prev", start)
    else:  # what came first stays, so every later row meets it
        head = rows.where("seq = _first and _known is null").select(F.col("_key").alias("_hs"), F.col("type").alias("_ht"), F.struct(*FIELDS).alias("_head"))
        rows = rows.join(head, (F.col("_key") == F.col("_hs")) & (F.col("type") == F.col("_ht")), "left")
        prior = F.coalesce(start, F.when(F.col("seq") > F.col("_first"), F.col("_head")))
    outcome = F.when(F.col("prior").isNull(), "created").otherwise({"skip": "skipped", "overwrite": "updated", "collect": "conflict"}[policy])
    rows = rows.withColumn("entry_id", F.coalesce("_known.id", new)).withColumn("prior", prior).withColumn("outcome", outcome)
    return rows.withColumn("is_known", F.col("_known").isNotNull()).select(*incoming.columns, "_alone", "entry_id", "is_known", "prior", "outcome")


def _words(rows: DataFrame, own: bool) -> DataFrame:
    """``(entry_id, side, text)`` of the lists that rows carry."""
    def listed(side: str) -> Column:
        words = distinct_words(F.col(f"{side}_aliases"), F.col(f"{side}_term") if own else None)
        return F.transform(words, lambda x: F.struct(F.lit(side).alias("side"), x.alias("text")))

    lists = map(listed, SIDES)
    return rows.select("entry_id", F.explode(F.concat(*lists)).alias("_x")).select("entry_id", "_x.side", "_x.text")


def imported(entries: DataFrame, aliases: DataFrame, revisions: DataFrame, incoming: DataFrame, project_id: str, policy: str, now: int, reason: str = "import_json:overwrite", unknown: Column | None = None) -> dict[str, DataFrame]:
    """``entries``, ``aliases`` and ``revisions`` after an import, its ``outcomes`` by ``seq`` and its ``conflicts``.

    An overwritten entry takes the last row's fields and aliases; each step that
    changes target or status leaves a revision; the date changes if any field
    did. Under ``collect`` nothing that exists is touched and each meeting is a
    row of ``conflicts`` with both versions. Ids of new rows derive from what they hold.
    """
    p = placed(entries, incoming, project_id, policy, unknown)
    steps = p.where("outcome = 'updated'").withColumn("_changed", ~F.struct(*FIELDS).eqNullSafe(F.col("prior")))
    last = steps.groupBy("entry_id").agg(F.max_by(F.struct(*FIELDS, "source_aliases", "target_aliases"), "seq").alias("_l"), F.bool_or("_changed").alias("_c"))
    stamp = F.lit(now).cast("bigint")

    created = p.where("outcome = 'created'").join(last.withColumnRenamed("entry_id", "_e"), F.col("entry_id") == F.col("_e"), "left")
    field = lambda c: F.when(F.col("_l").isNotNull(), F.col(f"_l.{c}")).otherwise(F.col(c)).alias(c)
    fresh = created.select(
        F.col("entry_id").alias("id"), F.lit(project_id).alias("project_id"), F.when(~F.col("_alone"), F.col("source_term")).alias("source_term"), "type",
        *map(field, FIELDS), (~F.col("_alone")).alias("source_known"), stamp.alias("created_at"), stamp.alias("updated_at"),
    )
    old = entries.join(last.withColumnRenamed("entry_id", "_e"), F.col("id") == F.col("_e"), "left")
    date = F.when(F.col("_c"), stamp).otherwise(F.col("updated_at")).alias("updated_at")
    old = old.select(*(field(c) if c in FIELDS else date if c == "updated_at" else F.col(c) for c in entries.columns))

    first_words = _words(created.where("_l is null").withColumn("source_term", F.when(~F.col("_alone"), F.col("source_term"))), own=True)
    new_words = first_words.unionByName(_words(last.select("entry_id", "_l.source_aliases", "_l.target_aliases"), own=False))
    new_words = new_words.withColumn("id", made_id("entry_id", "side", "text"))
    kept_words = aliases.join(last.select(F.col("entry_id").alias("_e")), F.col("entry_id") == F.col("_e"), "left_anti")

    log = steps.where(~F.col("target_term").eqNullSafe(F.col("prior.target_term")) | ~F.col("status").eqNullSafe(F.col("prior.status"))).select(
        made_id("entry_id", F.lit(reason), F.lit(str(now)), F.col("seq").cast("string")).alias("id"), "entry_id", F.col("prior.target_term").alias("prev_target_term"), F.col("target_term").alias("new_target_term"), F.lit(reason).alias("reason"), stamp.alias("created_at"),
    )
    out = {
        "entries": old.unionByName(fresh, allowMissingColumns=True),
        "aliases": kept_words.unionByName(new_words, allowMissingColumns=True),
        "revisions": revisions.unionByName(log, allowMissingColumns=True),
        "outcomes": p.select("seq", "entry_id", "outcome"),
    }
    met = p.where("outcome = 'conflict'").withColumn("_seen", F.struct(*FIELDS, *(distinct_words(F.col(f"{s}_aliases")).alias(f"{s}_aliases") for s in SIDES)))
    have = glossary.with_aliases(met.select(F.col("entry_id").alias("id")).distinct(), out["aliases"])
    have = have.select(F.col("id").alias("_e"), *(F.col(f"{s}_aliases").alias(f"_{s}") for s in SIDES))
    both = met.join(have, F.col("entry_id") == F.col("_e"))
    there = F.struct(*(F.col(f"prior.{c}").alias(c) for c in FIELDS), *(F.col(f"_{s}").alias(f"{s}_aliases") for s in SIDES))
    out["conflicts"] = both.select("seq", F.col("entry_id").alias("existing_id"), "source_term", "type", there.alias("existing"), F.col("_seen").alias("incoming"))
    return out


def summary(outcomes: DataFrame) -> DataFrame:
    """One row with how many entries were created, updated, skipped or in conflict."""
    return outcomes.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("created", "updated", "skipped", "conflict")))
