"""A lore book as a portable bundle: its description, entries, aliases, revisions and sources, a JSONL folder each.

Ids are issued anew on import, derived from the new book's id and the old ones,
so an import that runs again makes the same rows. References between tables are
rewritten through the map of entry ids, by join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.operators import tables
from folioscope.operators.imports import made_id

VERSION, NAME_LENGTH = 1, 80
META = "schema_version int, exported_at bigint, id string, name string, source_lang string, target_lang string, description string, default_proposal_kind string, created_at bigint"
SCHEMAS = {
    "entries": "id string, project_id string, type string, source_term string, target_term string, gender string, status string, notes string, first_seen_segment_id string, created_at bigint, updated_at bigint, source_known boolean",
    "aliases": "id string, entry_id string, side string, text string",
    "revisions": "id string, entry_id string, prev_target_term string, new_target_term string, reason string, created_at bigint",
    "sources": "id string, project_id string, kind string, title string, path string, ingested_at bigint",
}


def export_lore(lore_id: str, meta: DataFrame, parts: dict[str, DataFrame], path: str, now: int) -> None:
    """Write one book's rows of ``meta`` (one row a book) and of the four tables below ``path``.

    A book without a row in ``meta`` is refused. Aliases and revisions follow
    the book's entries, sources its id; columns of a table's own are kept.
    """
    head = meta.where(F.col("id") == lore_id).withColumn("schema_version", F.lit(VERSION)).withColumn("exported_at", F.lit(now).cast("bigint"))
    if head.limit(1).count() == 0:
        raise ValueError(f"lore book not found: {lore_id}")
    entries = parts["entries"].where(F.col("project_id") == lore_id)
    ids = entries.select(F.col("id").alias("_e"))
    out = {"meta": head, "entries": entries, "sources": parts["sources"].where(F.col("project_id") == lore_id)}
    for name in ("aliases", "revisions"):
        out[name] = parts[name].join(ids, F.col("entry_id") == F.col("_e"), "left_semi")
    for name, df in out.items():
        df.write.option("ignoreNullFields", "false").json(f"{path}/{name}")


def import_lore(spark: SparkSession, path: str, new_id: str, now: int, preserve: bool = False, name: str | None = None) -> dict[str, DataFrame]:
    """``meta``, the four tables and ``events`` of the book that a bundle makes.

    Exactly version 1 is read, and the book needs a name. ``preserve`` keeps the
    rows' ids; the book's own id is new in any case. A reference to an entry
    that the bundle does not hold stays as it is. ``events`` has one row that
    says what was imported.
    """
    m = spark.read.schema(META).json(f"{path}/meta")
    head = m.first()
    if head is None or head["schema_version"] != VERSION:
        raise ValueError(f"lore bundle schema_version {head and head['schema_version']} not supported")
    if head["name"] is None:
        raise ValueError("lore bundle is missing required meta.name")
    got = {t: spark.read.schema(schema).json(f"{path}/{t}") for t, schema in SCHEMAS.items()}
    if not preserve:
        fresh = lambda c: made_id(F.lit(new_id), c)
        ids = got["entries"].select(F.col("id").alias("old_id"), fresh("id").alias("new_id"))
        for t in ("aliases", "revisions"):
            got[t] = tables.remap(got[t], "entry_id", ids)
        got = {t: df.withColumn("id", fresh("id")) for t, df in got.items()}
    for t in ("entries", "sources"):
        got[t] = got[t].withColumn("project_id", F.lit(new_id))
    title = F.substring(F.trim(F.lit(name)) if name is not None else F.col("name"), 1, NAME_LENGTH)
    got["meta"] = m.withColumn("id", F.lit(new_id)).withColumn("name", title).withColumn("created_at", F.lit(now).cast("bigint")).drop("schema_version", "exported_at")
    count = lambda t: got[t].agg(F.count(F.lit(1)).alias(t))
    both = count("entries").join(count("aliases"))  # one row each
    payload = F.to_json(F.struct(F.lit(head["id"]).alias("source_id"), "entries", "aliases", F.lit(VERSION).alias("schema_version")))
    got["events"] = both.select(F.lit(new_id).alias("project_id"), F.lit(now).cast("bigint").alias("ts"), F.lit("lore.imported").alias("kind"), payload.alias("payload_json"))
    return got
